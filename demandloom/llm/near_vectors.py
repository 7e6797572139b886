"""Embedding near-duplicates by random-hyperplane signs.

Several tables each hash a vector to the signs of its products with random
hyperplanes; vectors of equal signs in any table share a bucket. Buckets are cut into blocks and pairs of
blocks are compared by exact cosine. A pair that meets in several tables counts in the first one only,
which its sign codes tell. Components are joined from one edge per row and block pair.
Identical vectors are collapsed first and count with their number.

The signs in a table grow with the number of vectors, so that a bucket's expected size stays the same; the
number of tables follows from the recall wanted for a pair exactly at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.blocks import block_pairs, runs_of
from demandloom.llm.components import components
from demandloom.llm.vectors import matrix, usable
from demandloom.session import stored

BUCKET = 64  # expected vectors of a bucket
BLOCK = 512  # vectors of a block


def _plan(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    bits = int(min(24, max(4, ceil(log2(max(1, vectors) / BUCKET)))))
    agree = (1 - acos(min(1.0, threshold)) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - agree)))


def _components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label (smallest member) of each of ``n`` vertices under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: float = 0.998, seed: int = 5) -> DataFrame:
    """``key``, n_links, component_id, kept for each row of ``vectors``; other columns are left out.

    Links join vectors of one length with cosine >= ``threshold`` in double precision; ``recall`` is the chance that a pair exactly at
    the threshold is found. Vectors that are null, empty, zero or have null or non-finite components, and rows
    with a null key, link with nothing and are their own component. A repeated key counts as one more vector. No rows give none.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = rows.where(usable("v") & F.col("id").isNotNull())
    distinct = stored(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "vectors")
    total = distinct.count()
    bits, tables = _plan(total, threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for dim in map(int, np.unique(sizes)):
                part = batch.filter(pa.array(sizes == dim))
                x = matrix(part.column(0), dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                codes = ((x @ planes[dim]) > 0).reshape(len(x), tables, bits) @ weights
                packed = pa.array([c.astype("<i4").tobytes() for c in codes], pa.binary())
                for t in range(tables):
                    at = pa.array((dim * tables + t << 24) | codes[:, t], pa.int64())
                    yield pa.RecordBatch.from_arrays([at, part.column(1), part.column(2), packed, part.column(0)], ["bucket", "rep", "m", "codes", "v"])

    entries = distinct.mapInArrow(hashed, "bucket long, rep long, m long, codes binary, v array<double>")
    counts = stored(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in runs_of(batches, 3):
            yield from block(name, table)

    def block(name: tuple[int, ...], table: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(table) < 2:
            return
        bucket, i, j = name
        dim, t = divmod(bucket >> 24, tables)
        x = matrix(table.column("v").chunk(0), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side, rep, m = (table.column(c).to_numpy() for c in ("side", "rep", "m"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), "<i4").reshape(len(x), tables)
        if i == j:
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            a, b = left[a], right[b]
        if not len(a):
            return
        label = _components_of(len(x), a, b)
        if t:
            new = ~(codes[a, :t] == codes[b, :t]).any(1)
            a, b = a[new], b[new]
        links = np.bincount(a, m[b], len(x)) + np.bincount(b, m[a], len(x))
        some = (label != np.arange(len(x))) | (links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[label[some]])], ["rep", "links", "root"])

    found = block_pairs(entries, "bucket", "rep", counts, BLOCK).mapInArrow(compared, "rep long, links long, root long")
    found = stored(found.groupBy("rep", "root").agg(F.sum("links").alias("links")), "links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = distinct.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    linked = good.join(joined, "v").select("id", "n_links", "component_id")
    alone = rows.where(~(usable("v") & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
