"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import ann, language, lexical, licenses, lm, mixing, near_vectors, packing, sharding, token_counts, warc, whitening
from demandloom.llm.jaccard import jaccard_components
from demandloom.session import shared_dir, stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_forest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = language.fold_of(F.col("doc_id"), 5)
    model = language.fit_languages(docs.where(fold != 0))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "lang_shares", "n_grams")


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"))


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mixed(_table(spark, folder, "documents"))
    return out.select("doc_id", "source", "pass", "block", "pass_order", F.round("weight", 9).alias("weight"))


OP5_SQL = r"""
WITH RECURSIVE narrow AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
totals AS (SELECT source, CAST(SUM(tokens) AS BIGINT) AS tokens, COUNT(*) AS n FROM narrow GROUP BY source),
shares AS (SELECT list_sort(list(CAST(tokens AS DOUBLE) / total)) AS p, any_value(total) AS total
           FROM (SELECT tokens, SUM(tokens) OVER () AS total FROM totals) WHERE tokens > 0),
one AS (SELECT p, total, p[1] AS low, 0.5 * ln(len(p)) - 0.5 * list_sum(list_transform(p, lambda x: x * ln(x))) AS target FROM shares),
tried(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, mid, ln(z) - mid * zl / z <= target + 1e-12 AND pow(low, mid - 1) / z <= 4 AS fits
        FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, low, target,
                     list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS z,
                     list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x))) AS zl
              FROM tried, one WHERE step < 50))),
chosen AS (
  SELECT p, total, a, list_sum(list_transform(p, lambda x: pow(x, a))) AS z
  FROM (SELECT p, total, CASE WHEN ln(len(p)) <= target + 1e-12 AND 1 / low / len(p) <= 4 THEN 0 ELSE round((SELECT hi FROM tried WHERE step = 50), 9) END AS a FROM one)),
plan AS (
  SELECT source, tokens, weight, CAST(floor(given / tokens) AS BIGINT) AS passes, given - CAST(floor(given / tokens) AS BIGINT) * tokens AS rest,
         CASE WHEN n <= 4096 THEN 0 ELSE CAST(ceil(round(ln(CAST(n AS DOUBLE) / 4096) / ln(16), 9)) AS INT) END AS digits
  FROM (SELECT source, tokens, n, weight, CAST(floor(round(weight * total, 3)) AS BIGINT) AS given
        FROM (SELECT source, tokens, n, total, round(pow(tokens / total, a) / z, 12) AS weight FROM totals, chosen WHERE tokens > 0))),
ranked AS (
  SELECT n.source, n.tokens, p.rest, md5('17:' || p.passes || ':' || n.doc_id) AS h FROM narrow n JOIN plan p ON n.source = p.source WHERE p.rest > 0),
cuts AS (SELECT source, MIN(h) AS cut FROM (SELECT source, h, rest, SUM(tokens) OVER (PARTITION BY source ORDER BY h) AS upto FROM ranked) WHERE upto > rest GROUP BY source),
drawn AS (
  SELECT n.doc_id, n.source, p.weight, p.digits, p.passes, p.rest, c.cut, t.turn AS pass, md5('17:' || t.turn || ':' || n.doc_id) AS pass_order
  FROM narrow n JOIN plan p ON n.source = p.source LEFT JOIN cuts c ON n.source = c.source
  CROSS JOIN LATERAL (SELECT unnest(range(0, p.passes + 1)) AS turn) t)
SELECT doc_id, source, CAST(pass AS INT) AS pass, substr(pass_order, 1, digits) AS block, pass_order, round(weight, 9) AS weight
FROM drawn WHERE pass < passes OR (rest > 0 AND pass_order < cut)
"""


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    digests = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.assign_sequences(digests)


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, folder, "embeddings"))


def op8_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    fold = language.fold_of(F.col("doc_id"), 10)
    out = lm.score_documents(docs, F.when(fold == 0, 0).when(fold == 1, lm.HELD).otherwise(lm.TRAIN))
    return out.withColumn("held_out", fold == 0)


def op9_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_dir(spark)}/warc/{uuid4().hex}"
    written = warc.write_archives(_table(spark, folder, "pages"), place)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if written.isEmpty():
        return written.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    found = warc.read_archives(spark, place, payloads=False, written=written)
    return found.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(True))).select(*columns)


OP9_SQL = """
WITH sized AS (
  SELECT page_id, COALESCE(html, '') AS html, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, MIN(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT s.page_id, s.payload_bytes, s.payload_digest, CASE WHEN f.first <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> s.page_id THEN f.first END AS refers_to
FROM sized s LEFT JOIN firsts f ON s.payload_digest = f.payload_digest AND s.payload_bytes >= 100
"""


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS t FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT COUNT(*) AS documents, CAST(SUM(len(t)) AS BIGINT) AS length FROM doc WHERE len(t) > 0),
held AS (SELECT r, doc_id, n, term, COUNT(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM held, size GROUP BY term),
scored AS (
  SELECT a.item_id, h.r, h.doc_id, CAST(SUM(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + (50 * h.n * s.documents) // s.length)))) AS BIGINT) AS score
  FROM asked a JOIN held h ON a.term = h.term JOIN weights w ON a.term = w.term, size s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_forest_neighbours, op2_token_counts, op3_language_id, op4_ngram_jaccard_join, op5_mix_sources, op6_best_fit_packing, op7_embedding_near_dedup, op8_deleted_interpolation, op9_warc_round_trip, op10_license_scan, op11_embedding_whitening, op12_ranked_lexical_search, op13_sharding)}
ORACLES: dict[str, str] = {"op5_mix_sources": OP5_SQL, "op9_warc_round_trip": OP9_SQL, "op12_ranked_lexical_search": OP12_SQL}
