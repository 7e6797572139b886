"""Session set-up and the few cluster settings the library reads."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "demandloom", cores: str | int = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a folder of its
    own; anywhere else a missing setting is an error, since executors could not
    read a driver-local path.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    known = getattr(spark, "_demandloom_shared_dir", None)
    if known:
        return known
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="demandloom-")
    spark._demandloom_shared_dir = path
    return path


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate table once to the shared folder and read it back.

    For reduced tables that several parts of a plan need: the plan upstream runs
    once, later stages see its real size, and a lost executor costs a re-read.
    """
    path = f"{shared_dir(df.sparkSession)}/stages/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, steps: Sequence[Callable], at_once: int = 5) -> list:
    """Results of independent driver steps (model fits) in their order, a few at a time.

    A boosted fit is a chain of hundreds of short jobs that leave most cores idle; chains of other fits fill them.
    """
    with ThreadPoolExecutor(max(1, min(at_once, len(steps)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]
