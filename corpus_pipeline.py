"""Corpus preparation: stages over ``documents``, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``:

1. ``language_id`` rejects documents in no language: without a letter, or less likely under
   the best language mixture than a uniform guess among known trigrams. ``lang`` becomes the predicted language.
2. ``jaccard_join`` keeps the document with the smallest doc_id of each near-duplicate group.
3. ``mix_sources`` draws the sources at target weights. Every document is kept; documents of
   smaller sources come again, up to half of a second pass.
4. ``best_fit_packing`` packs all drawn documents into sequences of 2048 tokens.

Null texts have no letter and go in the first stage. Rows of one doc_id with different texts are different documents; of rows
repeated with doc_id and text one stays. Rows with a null doc_id have no identity to be joined on and pass the second stage unchanged. Columns beyond those named are carried along.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import language, mixing, packing
from demandloom.llm.jaccard import jaccard_components
from demandloom.llm.queries import vocabulary
from demandloom.session import shared_dir, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    model = language.fit_languages(docs.select("lang", "text").where(language.fold_of(F.col("doc_id"), 5) != 0))
    found = language.identify(docs.select([F.col(c).alias(f"in_{c}") for c in columns]), model, "in_text")
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("fit") > 0))
    return kept.select([F.col("lang_pred" if c == "lang" else f"in_{c}").alias(c) for c in columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id; a doc_id that stands with several texts is so many documents."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        dropped = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct()
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "rows")  # stored: the numbers stay
    found = jaccard_components(own.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    found = own.join(found, "row")
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    kept = found.join(first, "group").where(F.col("row") == F.col("first.row")).select(F.col("doc_id").alias("kept_id"), F.col("text").alias("kept_text"))
    same = (F.col("d.doc_id") == F.col("k.kept_id")) & F.col("d.text").eqNullSafe(F.col("k.kept_text"))
    left = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).alias("d").join(kept.alias("k"), same, "left_semi")
    return left.unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, evenness=1.0, max_repeats=1.5, cover=True).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"))
    digests = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.assign_sequences(digests)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None  # mixtures, sketches and tokens have no SQL form; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; intermediate tables stand in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline/{k}-{name}-{uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
