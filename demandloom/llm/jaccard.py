"""N-gram Jaccard join by parity sketches.

A document is its set of distinct 5-word shingles. The set's parity sketch has
2**j words of 64 bits, j by size band; each shingle is XOR-ed into the word that its hash
names. A shingle that two sets share cancels out, so the number of words in
which two sketches differ is at most the symmetric difference of the sets.
At a similarity of t, sets of sizes a <= b <= a/t differ in at most
d = (1 - t) / (1 + t) * (a + b) shingles: among any d + 1 words one is equal in both
(pigeonhole). Each document therefore emits only its first d + 1 non-empty words as join
keys. The words are taken in one order for all documents, words made of very
frequent shingles last; any fixed order keeps the join complete, since of the two lists the one
that ends earlier in that order lies within the other wherever the sketches agree.

Equal sets are collapsed before the join. A bucket (equal key) first pairs each
member with the bucket's first one; once those pairs are verified and
components known, members of different components that share a first one are compared by
size and dense sketch, in pairs of bounded blocks, and what these leave possible is verified. So a large group of near copies costs
pairs in proportion to its size, and no link between components is lost.
Candidates pass a size and a dense-sketch Hamming filter and are then verified
on the shingles of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.blocks import block_pairs, runs_of
from demandloom.llm.components import components
from demandloom.llm.hashing import batch_word_hashes, mix, shingles, signed, slices
from demandloom.session import stored

U = np.uint64
SMALL = 32  # smaller sets: a sketch word for each shingle
DENSE = 32  # longs of the dense sketch that filters candidates
CHUNK = 1 << 21  # shingles among which a task counts frequent ones
BLOCK = 512  # members compared with each other at once
HEAVY_LIMIT = 1 << 19  # frequent shingles sent to the tasks; they set the order only, never the result


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + U(0x14057B7EF767814F)))
    return int(np.int64(mix(np.array([a ^ U(len(s))]))[0].view(np.int64))), int(b.view(np.int64))


def dense_sketch(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((s >> U(20)).astype(np.int64) & (64 * DENSE - 1), minlength=64 * DENSE) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _bands(n: int, t: float) -> list[int]:
    """Exponents j of the sketches that a set of n shingles takes part in; 64: one word for each shingle."""
    least = int(np.ceil(t * n - 1e-9))
    return sorted({64 if k < SMALL else k.bit_length() - 1 for k in (least, n)})


def keys_of(s: np.ndarray, t: float, heavy: np.ndarray) -> np.ndarray:
    """Join keys of a set (sorted distinct shingle hashes)."""
    n, found = len(s), []
    if n == 0:
        return s
    common = np.zeros(n, bool)
    if len(heavy):
        common = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
    values = mix(s + U(0xD1B54A32D192ED03))
    need = int(np.floor((1 - t) / (1 + t) * (n + n / t) + 1e-9)) + 1  # a partner may be larger by 1/t
    for j in _bands(n, t):
        if j == 64:
            words, parity, all_common = s, values, common
        else:
            segment = s >> U(64 - j)
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            words, parity, all_common = segment[starts], np.bitwise_xor.reduceat(values, starts), np.logical_and.reduceat(common, starts)
        keys = mix(parity ^ mix(words * U(64) + U(j % 64) + U(1)))
        found.append(np.concatenate([keys[~all_common], keys[all_common]])[:need])
    return np.concatenate(found)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    yield from zip(ids, (shingles(w) for w in batch_word_hashes(batch.column(1).to_pylist())), strict=True)


_SUMMARY = "doc_id long, n_shingles long, fp long, fp2 long, heavy long, hits long, docs long, " + ", ".join(f"s{k} long" for k in range(DENSE))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SUMMARY.split(", ")]
    seen: dict[int, None] = {}
    chunk: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(chunk), return_counts=True) if chunk else (np.empty(0, U), np.empty(0, np.int64))
        often = count >= max(4, len(chunk) // 500)
        none = pa.nulls(int(often.sum()), pa.int64())
        columns = dict.fromkeys(names, none) | {"heavy": pa.array(signed(value[often])), "hits": pa.array(count[often].astype(np.int64))}
        return pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    for batch in slices(batches):
        ids, ns, fps, fp2s, sketches = [], [], [], [], []
        for doc, s in _texts(batch):
            a, b = fingerprint(s) if len(s) else (0, 0)
            ids.append(doc), ns.append(len(s)), fps.append(a), fp2s.append(b), sketches.append(dense_sketch(s))
            if len(s) and a not in seen:
                seen[a] = None
                chunk.append(s)
                size += len(s)
        k = len(ids)
        matrix = np.array(sketches, np.int64).reshape(k, DENSE)
        columns = {"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(ns, pa.int64()), "fp": pa.array(fps, pa.int64()), "fp2": pa.array(fp2s, pa.int64()), "heavy": pa.nulls(k, pa.int64()), "hits": pa.nulls(k, pa.int64()), "docs": pa.array([1] * k, pa.int64())} | {f"s{i}": pa.array(np.ascontiguousarray(matrix[:, i])) for i in range(DENSE)}
        yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)
        if size > CHUNK:
            yield frequent()
            seen, chunk, size = {}, [], 0
    yield frequent()


def _emitter(t: float, heavy: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            keys, ids = [], []
            for _, s in _texts(batch):
                if len(s):
                    fp = fingerprint(s)[0]
                    if fp in seen:  # the same set emits the same keys
                        continue
                    seen.add(fp)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    k = keys_of(s, t, heavy)
                    keys.append(k)
                    ids.append(np.full(len(k), fp, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ids))], ["key", "sid"])

    return emit


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets, from rows in order of (key, sid): each with the bucket's first member."""
    last_key, last_sid, lead = None, None, None
    for batch in batches:
        key, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        same = np.concatenate([[not new[0] and sid[0] == last_sid], ~new[1:] & (sid[1:] == sid[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        leads = np.where(first >= 0, sid[np.maximum(first, 0)], 0 if lead is None else lead)
        keep = ~new & ~same
        last_key, last_sid, lead = key[-1], sid[-1], leads[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(leads[keep]), pa.array(sid[keep])], ["lead", "sid"])


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b, sid_a, sid_b = (batch.column(k).to_pylist() for k in range(4))
            left, right = (list(batch_word_hashes(batch.column(k).to_pylist())) for k in (4, 5))
            keep = []
            known: tuple[int | None, np.ndarray | None] = (None, None)
            for i in range(len(a)):
                if known[0] != sid_a[i]:
                    known = (sid_a[i], shingles(left[i]))
                x, y = known[1], shingles(right[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both) and fingerprint(x)[0] == sid_a[i] and fingerprint(y)[0] == sid_b[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


FOLDED = 8


def _folded(k: int):
    """Long k of the dense sketch folded to a shorter one: bits of equal place are XOR-ed."""
    out = F.col(f"s{k}")
    for j in range(k + FOLDED, DENSE, FOLDED):
        out = out.bitwiseXOR(F.col(f"s{j}"))
    return out


def _near(percent: int):
    """Condition that sizes and folded sketches of sides a and b leave the similarity possible."""
    d = (100 - percent) / (100 + percent) * (F.col("n_a") + F.col("n_b"))
    hamming = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(FOLDED)), F.lit(0))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (hamming <= d + 1e-9)


def _side(sets: DataFrame, name: str) -> DataFrame:
    return sets.select(F.col("fp").alias(f"sid_{name}"), F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), *[_folded(k).alias(f"{name}{k}") for k in range(FOLDED)])


def _across(percent: int):
    """Pairs of members of different components, within a block pair, that sizes and sketches leave possible."""
    most = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in runs_of(batches, 3):
            c, rep, fp, n, side = (table.column(x).to_numpy() for x in ("c", "rep", "fp", "n", "side"))
            sketch = np.stack([table.column(f"s{k}").to_numpy() for k in range(DENSE)], axis=1).view(np.uint64)
            left, right = (np.arange(len(c)),) * 2 if i == j else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            for x in left:
                y = right[(c[right] != c[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x])) & ((right > x) | (i != j))]
                if len(y):
                    y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(1) <= most * (n[y] + n[x]) + 1e-9]
                if len(y):
                    low = rep[y] < rep[x]
                    a, b = (np.where(low, rep[y], rep[x]), np.where(low, fp[y], fp[x])), (np.where(low, rep[x], rep[y]), np.where(low, fp[x], fp[y]))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a[0], b[0], a[1], b[1])], ["a", "b", "sid_a", "sid_b"])

    return run


def long_sketch(s: np.ndarray) -> bytes:
    """Parity sketch of at least eight bits per shingle; folding a longer one gives the shorter ones."""
    bits = 8 << max(6, int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [s for _, s in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([long_sketch(s) for s in sets], pa.binary()), batch.column(1)], ["doc_id", "n", "sketch", "text"])


def _hamming_filter(percent: int):
    most = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for n_a, x, n_b, y in zip(*(batch.column(k).to_pylist() for k in range(4, 8)), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                keep.append(int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum()) <= most * (n_a + n_b) + 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "sid_a", "sid_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, sid_a, sid_b) that reach the similarity, as (a, b).

    Long sketches leave few pairs whose texts must meet. Both joins shuffle at every size.
    """
    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            own = texts.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
            pairs = pairs.hint("merge").join(own, side)
        return pairs.select("a", "b", "sid_a", "sid_b", *[f"{c}_{side}" for side in ("a", "b") for c in columns])

    close = stored(both(pairs, "n", "sketch").mapInArrow(_hamming_filter(percent), "a long, b long, sid_a long, sid_b long"), "close")
    return both(close, "text").mapInArrow(_verifier(percent), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents link when 100 * |A & B| >= ``percent`` * |A | B| over distinct 5-word shingles;
    component_id is the smallest doc_id reachable. A text that is null, empty or white space has no
    shingles and is alone. A row whose doc_id is null is returned with its size and a null component.
    Repeated rows are returned as often as they come; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = percent / 100
    summary = stored(docs.mapInArrow(_summaries, _SUMMARY), "sets")
    rows = summary.where("docs = 1").select("doc_id", "n_shingles", "fp", "fp2", *[f"s{k}" for k in range(DENSE)])
    sets = stored(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp", "fp2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), *[F.first(f"s{k}").alias(f"s{k}") for k in range(DENSE)]), "sets")
    total = sets.agg(F.count("*").alias("n"), F.sum("n").alias("tokens")).first()
    often = summary.where("heavy IS NOT NULL").groupBy("heavy").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= max(16, total.n // 1000))
    heavy = np.sort(np.array([r.heavy for r in often.orderBy(F.desc("hits"), "heavy").limit(HEAVY_LIMIT).collect()], np.int64).view(np.uint64))

    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    entries = named.mapInArrow(_emitter(t, heavy), "key long, sid long")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total.tokens or 0) // 3_000_000)
    turned = F.expr("sid ^ shiftleft(key & 3L, 61)")  # a group's buckets have one of four first members
    members = entries.repartition(tasks, "key").sortWithinPartitions("key", turned).mapInArrow(_runs, "lead long, sid long")
    first = stored(members.select(F.col("lead").alias("sid_a"), F.col("sid").alias("sid_b")).distinct(), "first")
    meant = first.select(F.explode(F.array("sid_a", "sid_b")).alias("fp")).distinct().join(sets, "fp").select(F.col("rep").alias("doc_id")).distinct()
    # the texts of all buckets' members are moved once, by shuffle at every size
    texts = stored(named.join(meant.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sketched, "doc_id long, n long, sketch binary, text string"), "texts")
    pairs = first.join(_side(sets, "a"), "sid_a").join(_side(sets, "b"), "sid_b").where(_near(percent))
    links = stored(_verified(pairs.select("a", "b", "sid_a", "sid_b"), texts, percent), "links")
    labels = components(links)

    # members that share a first one but are not yet one component may still be near
    place = sets.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("c", F.coalesce("label", "rep")).drop("label", "fp2")
    group = first.join(place.withColumnRenamed("fp", "sid_b"), "sid_b").withColumnsRenamed({"sid_a": "lead", "sid_b": "fp"})
    sizes = group.groupBy("lead").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    sizes = stored(sizes.select("lead", "n"), "groups")
    if not sizes.isEmpty():
        more = block_pairs(group, "lead", "fp", sizes, BLOCK).mapInArrow(_across(percent), "a long, b long, sid_a long, sid_b long")
        again = stored(_verified(more.distinct(), texts, percent), "links")
        if not again.isEmpty():
            labels = components(links.unionByName(again))

    reps = sets.select("fp", "fp2", F.col("n").alias("n_shingles"), "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("fp", "fp2", "n_shingles", F.coalesce("label", "rep").alias("c"))
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(reps, ["fp", "fp2", "n_shingles"]).select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    return joined.unionByName(alone)
