"""Ranked lexical search by presence masks.

A query set (items) is ranked against all documents. The terms of a batch of items get numbers; a pass over the whole
texts keeps, for each document, its length and the counts of those terms (postings). Documents are then looked at in
blocks: for an item, the bitmaps of its terms over the documents of a block are turned into one mask for each document,
and documents are grouped by mask. All documents of a mask hold the same terms, so one bound holds for the group (each
term at its highest count, the shortest document). Masks are scored by descending bound until the
item's k-th best score is above the next one: no document of the masks left can come among the first k, not
even by a tie. What a block sends on is its first k of each item; the first k of those are the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.hashing import slices
from demandloom.session import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BATCH_TERMS = 1 << 18  # (item, term) rows that all tasks hold at once
BLOCK = 1 << 14  # documents of a block
BLOCK_POSTINGS = 1 << 21  # and their postings, about
CELLS = 1 << 20  # (term, document) counts of an item at hand at once
FIRST = 64  # documents scored at a time, at least
UNIT = 1_000_000_000

# bytes of terms keep their place, A-Z become a-z, all else separates
_KEPT = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of a text in UTF-8."""
    return Counter((text or b"").translate(_KEPT).split())


def lowered(text: Column) -> Column:
    """A-Z as a-z; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term, batch); items of a batch have about BATCH_TERMS terms at most together."""
    found = items.select("item_id", F.explode(F.regexp_extract_all(lowered(F.col("text").cast("string")), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    found = stored(found, "item-terms")
    batches = found.count() // BATCH_TERMS + 1
    return found.withColumn("batch", F.pmod(F.xxhash64("item_id"), F.lit(batches)).cast("int"))


POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text), and the numbered terms in it with their counts, of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, terms, counts = [], [], []
            for text in batch.column(1):
                found = term_counts(text.as_py())
                held = [(at, c) for t, c in found.items() if (at := numbers.get(t)) is not None]
                total.append(found.total()), terms.append([at for at, _ in held]), counts.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary")).mapInArrow(run, POSTINGS)


def _frequencies(held: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each numbered term, from one row for each term of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def contributions(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of terms (rows) in documents (columns), in 64-bit integers; rises with tf, falls with m."""
    return weight[:, None] * (UNIT * tf // (1000 * tf + 20 * m))


def group_masks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal columns of a bitmap matrix (term x document): a column of each group, the group of each column."""
    packed = np.packbits(bits, axis=0)
    words = np.zeros((-(-len(packed) // 8) * 8, bits.shape[1]), np.uint8)
    words[: len(packed)] = packed
    keys = np.ascontiguousarray(words.T).view(np.uint64)
    group = np.zeros(bits.shape[1], np.int64)
    for k in range(keys.shape[1]):
        value = np.unique(keys[:, k], return_inverse=True)[1]
        group = np.unique(group * (int(value.max(initial=0)) + 1) + value, return_inverse=True)[1]
    return np.unique(group, return_index=True)[1], group


def best_of_block(tf: np.ndarray, m: np.ndarray, doc: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of an item's first ``k`` documents with a score above 0, best first, equal ones by ``doc``.

    ``tf``: counts (term x document); ``m`` and ``doc`` of each document; ``weight`` of each term.
    """
    some = np.flatnonzero((tf > 0).any(0))
    if not len(some):
        return some, np.empty(0, np.int64)
    tf, m = tf[:, some], m[some]
    member, group = group_masks(tf > 0)
    shortest = np.full(len(member), np.iinfo(np.int64).max)
    np.minimum.at(shortest, group, m)
    bound = np.where(tf[:, member] > 0, contributions(weight, np.repeat(tf.max(1)[:, None], len(member), axis=1), shortest), 0).sum(0)
    order = np.argsort(-bound, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    columns = np.argsort(place[group], kind="stable")  # documents by descending bound of their mask
    ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
    at, best, score = 0, np.empty(0, np.int64), np.empty(0, np.int64)
    while at < len(order) and bound[order[at]] > 0 and (len(best) < k or bound[order[at]] >= score[k - 1]):
        low = ends[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(ends, low + FIRST, side="right")))
        new = columns[low : ends[at - 1]]
        best, score = np.concatenate([best, new]), np.concatenate([score, contributions(weight, tf[:, new], m[new]).sum(0)])
        first = np.lexsort((doc[some[best]], -score))[:k]
        best, score = best[first], score[first]
    return some[best[score > 0]], score[score > 0]


NO_ID = np.iinfo(np.int64).max  # a null doc_id comes after all others


def _ranker(items: list[tuple[int, np.ndarray]], weight: np.ndarray, documents: int, length: int, k: int):
    """First ``k`` documents of each block for each item (number, terms)."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        doc = table.column("doc_id").fill_null(NO_ID).to_numpy()
        m = 50 + 50 * table.column("n").to_numpy() * documents // max(length, 1)
        terms = pa.concat_arrays(table.column("terms").chunks) if table.column("terms").num_chunks else pa.array([], pa.list_(pa.int32()))
        sizes = np.diff(terms.offsets.to_numpy())
        number, count = terms.flatten().to_numpy(), pa.concat_arrays(table.column("counts").chunks).flatten().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        by_term = np.argsort(number, kind="stable")
        row, count = row[by_term], count[by_term]
        starts = np.searchsorted(number[by_term], np.arange(len(weight) + 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for item, own in items:
            step = max(FIRST, CELLS // len(own))
            for low in range(0, len(doc), step):
                high = min(low + step, len(doc))
                tf = np.zeros((len(own), high - low), np.int64)
                for at, term in enumerate(own):
                    a, b = starts[term], starts[term + 1]
                    a, b = a + np.searchsorted(row[a:b], low), a + np.searchsorted(row[a:b], high)
                    tf[at, row[a:b] - low] = count[a:b]
                place, score = best_of_block(tf, m[low:high], doc[low:high], weight[own], k)
                found.append((np.full(len(place), item, np.int64), doc[low + place], score))
        columns = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found) if found else [[]] * 3)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=columns[1] == NO_ID), pa.array(columns[2])], ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                count += len(batch.column(2).flatten())
            if size >= BLOCK or count >= BLOCK_POSTINGS:
                yield block(held)
                held, size, count = [], 0, 0
        if held:
            yield block(held)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    A term's weight is w = floor(1000 * ln((2N + 2) / (2df + 1))), of N documents with a term and df that hold this one; a document
    of n terms has m = 50 + (50 * n * N) div L, L being all terms; the score adds w * ((10^9 * tf) div (1000 * tf + 20 * m))
    over an item's distinct terms. Only scores above 0 count; equal scores go by doc_id, null ones last. Rows of ``docs`` are
    documents, also repeated ones and those of one doc_id; rows of one item_id (also of none) are one item. Null and
    empty texts have no terms, an item without terms has no rows. Empty tables give an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    terms = item_terms(items)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for batch in sorted(r.batch for r in terms.select("batch").distinct().collect()):
        rows = terms.where(F.col("batch") == batch).select("item_id", "term").collect()  # about BATCH_TERMS
        numbers = {t: at for at, t in enumerate(sorted({r.term.encode() for r in rows}))}
        names = list({r.item_id: None for r in rows})
        own: dict = {x: [] for x in names}
        for r in rows:
            own[r.item_id].append(numbers[r.term.encode()])
        held = stored(postings(docs, numbers), "postings")
        size = held.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        frequency = _frequencies(held, len(numbers))
        weight = np.array([math.floor(1000 * math.log((2 * size.documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
        ranker = _ranker([(at, np.array(sorted(own[x]))) for at, x in enumerate(names)], weight, size.documents, size.length or 0, k)
        found = held.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(ranker, "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        known = spark.createDataFrame([(at, x) for at, x in enumerate(names)], f"number long, item_id {kind}")
        out = out.unionByName(found.join(known, F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score"))
    return out
