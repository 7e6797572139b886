"""Packing documents into fixed-length token sequences by large-item matching.

Only sizes decide a packing, and there are at most ``capacity`` of them, so the plan is made on
the histogram of sizes: pieces above a third of the capacity stand at most two in a
sequence and are matched greedily (each with the largest that fits beside it), smaller ones
go, largest first, into the tightest gap that holds them, or open new sequences. The plan is a
list of patterns with counts, from which each piece's sequence follows
by its rank among pieces of its size; ranks come from counts per (size, block), so no size is
ever ranked in one task.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.hashing import slices
from demandloom.session import stored

RANKED = 50_000  # pieces of a rank block
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library.

    The file's own ranks are merged by tiktoken, which gives the same ids several times faster. A special token's
    string in a text is that token, as in the library.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
        self.coder = tiktoken.Encoding(uuid4().hex, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        ids = self.coder.encode(text, allowed_special="all") if any(x in text for x in self.special) else self.coder.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids of each document's pieces, over its whole text.

    A document is the text's ids, then ``end``; a null text is empty. Only a document of more than ``capacity`` ids is
    cut: the remainder comes first, then full pieces. ``ids``: binary, little-endian unsigned 32-bit. A null doc_id stays null; each
    of several equal rows has its own pieces; other columns are left out.
    """
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in slices(batches):
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(text or "") + stop
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [(doc, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                size += len(ids)
                if size > 1 << 24:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def packing_patterns(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in a sequence, number of such sequences) that hold ``sizes`` (size: count)."""
    left = {s: n for s, n in sizes.items() if n}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must be between 1 and the capacity")
    large = sorted(s for s in left if 3 * s > capacity)
    bins: list[tuple[tuple[int, ...], int]] = []
    while large:
        s = large[-1]
        at = bisect_left(large, capacity - s + 1) - 1
        if at < 0:
            pattern, n, used = (s,), left[s], {s: 1}
        elif large[at] == s and left[s] == 1 and at == 0:
            pattern, n, used = (s,), 1, {s: 1}
        else:
            at -= large[at] == s and left[s] == 1
            t = large[at]
            pattern, n, used = (s, t), left[s] // 2 if t == s else min(left[s], left[t]), {s: 2} if t == s else {s: 1, t: 1}
        bins.append((pattern, n))
        for size, k in used.items():
            left[size] -= k * n
            if not left[size]:
                large.remove(size)
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def add(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((pattern, n))

    for pattern, n in bins:
        add(pattern, n)
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                pattern, n = (), left[s]  # as many new sequences as it takes
                gap = capacity
            else:
                gap = order[at]
                pattern, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // s
            full = min(n, left[s] // each)
            rest = left[s] - full * each
            if full:
                add(pattern + (s,) * each, full)
            if full < n and rest and not (pattern == () and rest >= each):
                add(pattern + (s,) * rest, 1)
                full, rest = full + 1, 0
            if pattern and n > full:
                add(pattern, n - full)
            left[s] = rest
    return [x for v in gaps.values() for x in v]


def assign_sequences(items: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """``items`` (a stored table with ``keys`` and length) with sequence_id and offset added; both replace columns of that name.

    Sequences are filled without gaps from 0. Items of equal length are placed in order of a hash of
    the keys; equal rows are interchangeable.
    """
    items = items.drop("sequence_id", "offset")
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, n in packing_patterns(counts, capacity):
        offset = 0
        for s in pattern:
            slots.setdefault(s, []).append((sequence, n, offset))
            offset += s
        sequence += n
    tables = {s: (np.cumsum([0, *(n for _, n, _ in v)]), np.array([q for q, _, _ in v], np.int64), np.array([o for _, _, o in v], np.int64)) for s, v in slots.items()}

    blocks = max(1, sum(counts.values()) // RANKED)
    placed = items.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy(*keys)))
    before = placed.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    ranked = ranked.join(before, ["length", "_block"]).select(*items.columns, (F.col("_rank") + F.col("_before") - 1).alias("_rank"))
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            ids, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                bounds, first, offset = tables[int(s)]
                slot = np.searchsorted(bounds, rank[at], side="right") - 1
                ids[at], offsets[at] = first[slot] + rank[at] - bounds[slot], offset[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids), pa.array(offsets)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_sequences(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """Pieces of ``docs`` with their ids and places, as the two functions above say."""
    return assign_sequences(stored(token_pieces(docs, vocabulary, capacity), "pieces"), capacity)
