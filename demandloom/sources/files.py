"""File sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.session import shared_dir


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and an explicit schema; header names become snake_case."""
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", encoding).csv(path)
    return raw.toDF(*[snake(c) for c in raw.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Path test on whatever file system the path names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def resolve(spark: SparkSession, *candidates: tuple[str, str]) -> DataFrame:
    """First existing (format, path) of the candidates: cleaned before raw, parquet before CSV."""
    for kind, path in candidates:
        if exists(spark, path):
            reader = spark.read.option("header", True) if kind == "csv" else spark.read
            return reader.format(kind).load(path)
    raise FileNotFoundError(", ".join(p for _, p in candidates))


def write_split(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> None:
    """One folder per value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def append_snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Append-only history, one partition per snapshot."""
    df.withColumn("snapshot_ts", F.lit(stamp)).write.mode("append").partitionBy("snapshot_ts").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path, size, lines and an order-free hash of the lines' bytes, per file of any format and size.

    Files are read as lines of bytes, so a large one is split over tasks; only counts and sums are shuffled.
    """
    options = {"pathGlobFilter": glob, "recursiveFileLookup": True}
    sizes = spark.read.format("binaryFile").options(**options).load(folder).select("path", F.col("length").alias("size"))
    lines = spark.read.options(**options).text(folder).select(F.col("_metadata.file_path").alias("path"), F.xxhash64(F.col("value").cast("binary")).cast("decimal(38,0)").alias("h"))
    hashed = lines.groupBy("path").agg(F.count("*").alias("lines"), F.format_string("%s", F.sum("h")).alias("content"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    return sizes.withColumn("at", plain).join(hashed.select(plain.alias("at"), "lines", "content"), "at", "left").select("path", "size", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("content", F.lit("0")).alias("content"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """dataset, file, format, columns, rows, bytes of every parquet and csv file below ``folder``.

    A dataset is an entry of the folder, a file or a folder of files of one schema. Rows are counted where the files are: from
    the footers of parquet, and by splitting csv (with a header) over tasks. One small plan per dataset, not per file.
    """
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    root = re.sub(r"^file:/+", "/", folder).rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    sizes = sizes.select(plain.alias("path"), "bytes").withColumn("dataset", F.regexp_extract(F.substring("path", len(root) + 2, 1 << 20), r"^([^/]+)", 1))
    kind = F.lower(F.regexp_extract("path", r"[.](parquet|csv)$", 1))
    sizes = sizes.withColumn("format", kind).where("format <> ''")
    out = None
    for dataset, fmt in sorted((r.dataset, r.format) for r in sizes.select("dataset", "format").distinct().collect()):
        reader = spark.read.format(fmt).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}")
        rows = (reader.option("header", True) if fmt == "csv" else reader).load(f"{folder}/{dataset}")
        counted = rows.groupBy(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("at")).agg(F.count("*").alias("rows"))
        files = sizes.where((F.col("dataset") == dataset) & (F.col("format") == fmt))
        part = files.join(counted, F.col("path") == F.col("at"), "left").select("dataset", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "format", F.lit(len(rows.columns)).alias("columns"), F.coalesce("rows", F.lit(0)).alias("rows"), "bytes")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "dataset string, file string, format string, columns int, rows long, bytes long") if out is None else out


def fingerprint(df: DataFrame, parts: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and an order-free content hash per partition value, computed where the rows are."""
    columns = list(columns or [c for c in df.columns if c not in parts])
    # a wrapping sum: copies and order do not cancel, no row is gathered
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    name = F.concat_ws("/", *[F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in parts])
    return df.groupBy(*parts).agg(F.count("*").alias("size"), F.format_string("%s", total).alias("sha256")).select(name.alias("path"), "size", "sha256")


def run_batch(spark: SparkSession, source: str, target: str, score, fmt: str = "parquet") -> DataFrame:
    """File in, scored file out."""
    rows = spark.read.format(fmt).load(source)
    score(rows).write.mode("overwrite").format(fmt).save(target)
    return spark.read.format(fmt).load(target)
