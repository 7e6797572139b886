"""Comparing the members of large groups in pairs of bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, group: str, ident: str, sizes: DataFrame, block: int) -> DataFrame:
    """``members`` once for each pair of blocks of its group that its own block is in, with i <= j and side (0: in i).

    ``sizes``: ``group``, n. A block holds about ``block`` members. Rows are partitioned and sorted by (group, i, j).
    """
    rows = members.join(sizes.select(group, F.ceil(F.col("n") / block).cast("long").alias("_blocks")), group)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select(group, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), *[c for c in members.columns if c != group])
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of each run of equal values in the first ``keys`` long columns, across batches."""
    held: list[pa.RecordBatch] = []
    now: tuple[int, ...] | None = None
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1, [len(values)]])
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            name = tuple(int(x) for x in values[a])
            if name != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()
