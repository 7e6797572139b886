"""Language-model scores by deleted interpolation.

A bigram model: P(w | v) mixes the maximum-likelihood estimates c(v, w) / c(v) and c(w) / N with
a uniform 1 / (V + 1); the mixture weights depend on the bucket of log2 c(v) and are learned by
expectation-maximisation on held-out counts: a tenth of the training documents is held
out, the estimates come from the others, and the final model counts both. Every word is a context; only
the start of a text and words never learned are the lowest bucket, which has no bigram term.

Words are 64-bit hashes. The most frequent (hot) words have their counts and the counts of their pairs at hand in
every task, so a hot word after a hot one is scored where the text is read. All other words travel as postings
(word, word before, hot word or partition after, document), packed by task and hash partition. The partition of a
word counts it and its bigrams over all documents; it scores its tokens, and the hot words after it. Of a bigram of
two other words, it is the partition of the second that counts it; the partition of the first sends its count there,
once for each partition. A hot word's postings would be the long ones; any other word is rarer than all of them.

Postings and sent counts are shuffled once, into tables bucketed by the partition of words; the passes that count, that
gather held-out cells and that score read these buckets as they lie, each only the columns it needs. Arrays travel
and lie there compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.hashing import batch_word_hashes, mix, slices
from demandloom.session import shared_dir, stored

U = np.uint64
END = U(0x1D8E4E27C47D124F)  # the token that ends a text
CHUNK = 1 << 20  # tokens packed together
BUCKETS = 48
NO_ID = -(1 << 63)  # stands for a null doc_id inside
TRAIN, HELD = 1, 2  # a document's part: 0 is not learned from
MOST_BUCKETS = 1 << 14  # of a table; more partitions share them
NONE, COLD = -1, -2  # instead of a hot word's index: no word or none that counts; any other word


@dataclass(frozen=True)
class Hot:
    """The most frequent training words by hash, with their counts, and the counts of pairs of them."""

    words: np.ndarray
    train: np.ndarray
    held: np.ndarray
    pairs: np.ndarray  # (first + 1) * len(words) + second, sorted; first is NONE after no context
    pair_train: np.ndarray
    pair_held: np.ndarray


def _shut():
    """Compressor of the arrays that travel: counts, places and document keys are mostly zero bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress


def _opened(rows: list[dict]) -> list[dict]:
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    return [{k: unzip(v) if isinstance(v, bytes) else v for k, v in r.items()} for r in rows]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of whole documents: document keys, parts, token hashes (with ends), token counts of the documents."""
    docs: list[int] = []
    parts: list[int] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in slices(batches):
        for key, part, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch_word_hashes(batch.column(2).to_pylist()), strict=True):
            docs.append(key), parts.append(part), texts.append(np.append(w, END))
            size += len(w) + 1
            if size > CHUNK:
                yield np.array(docs, np.int64), np.array(parts, np.int8), np.concatenate(texts), np.array([len(x) for x in texts])
                docs, parts, texts, size = [], [], [], 0
    if docs:
        yield np.array(docs, np.int64), np.array(parts, np.int8), np.concatenate(texts), np.array([len(x) for x in texts])


def _find(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each of ``x`` in ``sorted_values``, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, parts, w, n in _tokens(batches):
        part = np.repeat(parts, n)
        w, part = w[part > 0], part[part > 0]
        word, at = np.unique(w, return_inverse=True)
        train, held = np.bincount(at, part == TRAIN, len(word)), np.bincount(at, part == HELD, len(word))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(train.astype(np.int64)), pa.array(held.astype(np.int64))], ["word", "train", "held"])


def _around(index: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word before and after each token; NONE at the start and at the end of a text."""
    ends = np.cumsum(n)
    before, after = np.roll(index, 1), np.roll(index, -1)
    before[np.concatenate([[0], ends[:-1]])] = NONE
    after[ends - 1] = NONE
    return before, after


def _pair_counter(words: np.ndarray, cold: int):
    """Counts of hot words after hot ones and after NONE; ``cold``: what any other word is, COLD or NONE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts, w, n in _tokens(batches):
            index = _find(words, w)
            before, _ = _around(np.where(index < 0, cold, index), n)
            part = np.repeat(parts, n)
            use = (index >= 0) & (before != COLD) & (part > 0)
            pair, at = np.unique((before[use].astype(np.int64) + 1) * len(words) + index[use], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(at, part[use] == TRAIN, len(pair)).astype(np.int64)), pa.array(np.bincount(at, part[use] == HELD, len(pair)).astype(np.int64))], ["pair", "train", "held"])

    return run


def _width(words: int, partitions: int) -> str:
    """Type of an index of a hot word, or of NONE, COLD or a partition below them."""
    return "<i2" if max(words, partitions + 2) < 1 << 15 else "<i4"


def _poster(words: np.ndarray, keys: np.ndarray, cold: int):
    """Postings of the tokens that are no hot words: a row per chunk and partition; p is the partition's key.

    ``after`` is a hot word's index, NONE, or COLD less the partition of any other word; ``firsts`` has the words before
    tokens whose ``before`` is COLD. If ``cold`` is NONE, only hot words are contexts.
    """
    partitions = len(keys)
    kind = _width(len(words), partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shut = _shut()
        for docs, parts, w, n in _tokens(batches):
            index = _find(words, w).astype(np.int32)
            all_to = (mix(w) % U(partitions)).astype(np.int32)
            index[index < 0] = cold
            before, after = _around(index, n)
            if cold == COLD:
                after = np.where(after == COLD, COLD - np.roll(all_to, -1), after)
            else:
                after = np.full(len(w), NONE, np.int32)
            doc = np.repeat(np.arange(len(docs), dtype=np.int32), n)
            use = np.flatnonzero(index < 0)
            use = use[np.lexsort((w[use], all_to[use]))]
            first = w[use - 1]  # of no meaning at the start of a text
            w, before, after, doc = w[use], before[use], after[use], doc[use]
            cuts = np.searchsorted(all_to[use], np.arange(partitions + 1))
            del index, all_to, use
            rows, chunk = [], uuid4().int >> 65
            for p in range(partitions):
                a, b = cuts[p], cuts[p + 1]
                if a == b:
                    continue
                new = np.flatnonzero(np.concatenate([[True], w[a + 1 : b] != w[a : b - 1]]))
                used, at = np.unique(doc[a:b], return_inverse=True)
                made = (w[a:b][new], np.diff(np.append(new, b - a)).astype("<u4"), before[a:b].astype(kind), first[a:b][before[a:b] == COLD], after[a:b].astype(kind), at.astype("<u2" if len(used) < 65536 else "<u4"), docs[used], parts[used])
                rows.append((int(keys[p]), chunk, *[shut(x.tobytes()) for x in made]))
            names = ["p", "chunk", "words", "runs", "before", "firsts", "after", "at", "docs", "parts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(zip(*rows) if rows else [[]] * len(names))], names)

    return run


_POSTINGS = "p long, chunk long, words binary, runs binary, before binary, firsts binary, after binary, at binary, docs binary, parts binary"


@dataclass(frozen=True)
class Tokens:
    """Tokens of a partition: number of the word, part of the document."""

    names: np.ndarray  # words by number
    number: np.ndarray
    part: np.ndarray


def _joined(rows: list[dict], column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _places(rows: list[dict]) -> np.ndarray:
    """Document number of each token, over the documents of all rows."""
    out, base = [], 0
    for r in rows:
        k = len(r["parts"])
        out.append(np.frombuffer(r["at"], "<u2" if k < 65536 else "<u4").astype(np.int64) + base)
        base += k
    return np.concatenate(out)


def _unpack(rows: list[dict]) -> Tokens:
    words = np.repeat(_joined(rows, "words", "<u8"), _joined(rows, "runs", "<u4"))
    names, number = np.unique(words, return_inverse=True)
    return Tokens(names, number, _joined(rows, "parts", "i1")[_places(rows)])


def _bigrams(t: Tokens, before: np.ndarray, firsts: np.ndarray, width: int) -> np.ndarray:
    """Number of each token's pair of word before and word; ``width``: of the hot words."""
    own = before.astype(np.int64)
    if len(firsts):
        own[before == COLD] = width + np.unique(firsts, return_inverse=True)[1]
    return np.unique(t.number * (width + len(firsts) + 1) + own + 1, return_inverse=True)[1]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _by_chunk(fn):
    """Applies ``fn`` to the rows of each value of p, from batches in order of p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["p"] != now and held:
                    yield fn(held)
                    held = []
                now = row["p"]
                held.append(row)
        if held:
            yield fn(held)

    return run


def _keys(spark: SparkSession, partitions: int, buckets: int) -> np.ndarray:
    """A key for each partition, so that every bucket of a table gets as many of them: Spark deals keys by their hash."""
    each = -(-partitions // buckets)
    found = spark.range(buckets * (2 * each + 40)).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket")).toPandas()
    found = found[found.groupby("bucket").cumcount() < each].sort_values("id")["id"].to_numpy(np.int64)
    spare = np.arange(partitions) + (1 << 40)  # a bucket that found too few
    return np.concatenate([found, spare])[:partitions]


def _bucketed(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """``rows`` written once, bucketed by p, in the shared folder; grouping by p reads it without a shuffle."""
    spark = rows.sparkSession
    table = f"{name}_{uuid4().hex}"
    made = rows.repartition(buckets, "p").write.bucketBy(buckets, "p").sortBy("p").format("parquet")
    made.option("path", f"{shared_dir(spark)}/stages/{table}").saveAsTable(table)
    return spark.table(table)


def _rows(table: pa.Table) -> list[dict]:
    return _opened(table.to_pylist())


CELL = 8.0  # cells of a factor 2 in which held-out probabilities are gathered


def _cells(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Held-out tokens by bucket and (rounded logarithm of) both estimates; -1: zero."""
    q2, q1 = (np.where(p > 0, np.round(-CELL * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64) for p in (p2, p1))
    cell, at = np.unique((bucket * 4096 + q2 + 1) * 4096 + q1 + 1, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(at, weight, len(cell)).astype(float))], ["cell", "n"])


def learn_weights(cells: np.ndarray, n: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation."""
    rest, q1 = np.divmod(cells, 4096)
    bucket, q2 = np.divmod(rest, 4096)
    p = np.stack([np.where(q > 0, 2.0 ** (-(q - 1) / CELL), 0.0) for q in (q2, q1)] + [np.full(len(cells), floor)], axis=1)
    out = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    out[0] = [0.0, 0.5, 0.5]
    for _ in range(rounds):
        part = p * out[bucket]
        part *= (n / part.sum(1))[:, None]
        total = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1)
        seen = total.sum(1) > 0
        out[seen] = total[seen] / total[seen].sum(1, keepdims=True)
    out = np.maximum(out, 1e-7)  # no estimate may be the only one: each part can be zero elsewhere
    out[0, 0] = 0.0
    return out / out.sum(1, keepdims=True)


def score_documents(docs: DataFrame, part: Column, contexts: int | None = None, partition_tokens: int = 2_000_000, hot: int = 1024) -> DataFrame:
    """One row per document: its key columns doc_id, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``docs``: doc_id, text; ``part``: 0 a document that is only scored, 1 one to learn from, 2 one to learn from
    that weights are fitted on; null is 0. A null text is empty (the end token alone). Rows of one doc_id, or without
    any, are one document whose texts follow each other: their counts and scores are added. Without any training
    token, probabilities are uniform over the unknown. An empty table gives an empty one. ``hot``: words whose counts all
    tasks hold; results do not depend on it. ``contexts``: a smaller model, with only so many words as contexts.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), part.cast("int").alias("part"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.coalesce("part", F.lit(0)).alias("part"), "text")
    words = stored(docs.where("part > 0").mapInArrow(_count_rows, "word long, train long, held long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("held").alias("held")), "words")
    size = words.agg(F.count("*").alias("v"), F.sum("train").alias("train"), F.sum("held").alias("held"), F.sum((F.col("train") > 0).cast("long")).alias("v_train")).first()
    train_n, held_n, v = size.train or 0, size.held or 0, size.v
    total = train_n + held_n
    top = words.orderBy(F.desc(F.col("train") + F.col("held")), "word").limit(hot if contexts is None else contexts).toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)[order]
    own_train, own_held = top["train"].to_numpy(np.int64)[order], top["held"].to_numpy(np.int64)[order]
    cold = COLD if contexts is None else NONE
    # pairs of hot words: at most hot * (hot + 1) rows
    pairs = docs.where("part > 0").mapInArrow(_pair_counter(hashes, cold), "pair long, train long, held long").groupBy("pair").agg(F.sum("train").alias("train"), F.sum("held").alias("held")).toPandas().sort_values("pair")
    known = Hot(hashes, own_train, own_held, pairs["pair"].to_numpy(np.int64), pairs["train"].to_numpy(np.int64), pairs["held"].to_numpy(np.int64))
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // partition_tokens) + 1)
    buckets = min(partitions, MOST_BUCKETS)
    keys = _keys(docs.sparkSession, partitions, buckets)
    postings = _bucketed(docs.mapInArrow(_poster(hashes, keys, cold), _POSTINGS), buckets, "postings")
    width, kind = len(hashes), _width(len(hashes), partitions)

    sent_schema = "p long, sent binary, sent_train binary, sent_held binary"

    def counts_out(table: pa.Table) -> pa.Table:
        """Counts of each word for the partitions of the words after it."""
        rows = _rows(table)
        t, after = _unpack(rows), _joined(rows, "after", kind)
        train, held = np.bincount(t.number, t.part == TRAIN).astype(np.int64), np.bincount(t.number, t.part == HELD).astype(np.int64)
        use = after <= COLD
        to, number = np.divmod(np.unique((COLD - after[use].astype(np.int64)) * len(t.names) + t.number[use]), len(t.names))
        cuts = np.searchsorted(to, np.arange(partitions + 1))
        shut = _shut()
        out = [(int(keys[p]), *[shut(x[number[cuts[p] : cuts[p + 1]]].tobytes()) for x in (t.names, train, held)]) for p in np.flatnonzero(np.diff(cuts))]
        return pa.Table.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out) if out else [[]] * 4)], ["p", "sent", "sent_train", "sent_held"])

    if cold == COLD:
        sent = postings.select("p", "words", "runs", "after", "at", "parts").groupBy("p").applyInArrow(counts_out, sent_schema)
    else:
        sent = docs.sparkSession.createDataFrame([], sent_schema)
    sent = _bucketed(sent, buckets, "sent")

    def with_sent(fn, schema: str, *columns: str) -> DataFrame:
        """``fn`` of the postings of each partition and the counts of words before that others have sent there."""
        return postings.select("p", *columns).groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(fn, schema)

    def known_before(more: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted words of other partitions, their counts in training and held-out documents."""
        rows = _rows(more)
        names = _joined(rows, "sent", "<u8")
        order = np.argsort(names)
        return names[order], _joined(rows, "sent_train", "<i8")[order], _joined(rows, "sent_held", "<i8")[order]

    def of_before(before: np.ndarray, hot_counts: np.ndarray, cold_counts: np.ndarray) -> np.ndarray:
        """Count of the word before each token; ``cold_counts``: of those that are COLD, in order."""
        out = np.where(before >= 0, hot_counts[np.maximum(before, 0)], 0) if width else np.zeros(len(before), np.int64)
        out[before == COLD] = cold_counts
        return out

    def held_out(own: pa.Table, more: pa.Table) -> pa.Table:
        rows, (names, sent_train, _) = _rows(own), known_before(more)
        t, before, firsts, after = _unpack(rows), _joined(rows, "before", kind), _joined(rows, "firsts", "<u8"), _joined(rows, "after", kind)
        c1 = np.bincount(t.number, t.part == TRAIN)
        which = _bigrams(t, before, firsts, width)
        c2 = np.bincount(which, t.part == TRAIN)
        use = t.part == HELD
        context = of_before(before, known.train, sent_train[np.searchsorted(names, firsts)])[use]
        bucket, p2, p1 = [_bucket(context)], [np.where(context > 0, c2[which[use]] / np.maximum(context, 1), 0.0)], [c1[t.number[use]] / max(train_n, 1)]
        near = after >= 0
        if near.any():  # hot words after these
            number, following, use = t.number[near], after[near].astype(np.int64), t.part[near] == HELD
            which = np.unique(number * width + following, return_inverse=True)[1]
            c2, context = np.bincount(which, t.part[near] == TRAIN)[which[use]], c1[number[use]]
            bucket.append(_bucket(context)), p2.append(c2 / np.maximum(context, 1)), p1.append(known.train[following[use]] / max(train_n, 1))
        bucket, p2, p1 = (np.concatenate(x) for x in (bucket, p2, p1))
        return pa.Table.from_batches([_cells(bucket, p2, p1, np.ones(len(bucket)))])

    # a cell for each bucket and pair of rounded logarithms: bounded whatever the corpus
    cells = with_sent(held_out, "cell long, n double", "words", "runs", "before", "firsts", "after", "at", "parts").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float)
    if len(hashes):
        first, second = np.divmod(known.pairs, len(hashes))
        context = np.where(first > 0, known.train[first - 1], 0)
        near = _cells(_bucket(context), np.where(context > 0, known.pair_train / np.maximum(context, 1), 0.0), known.train[second] / max(train_n, 1), known.pair_held.astype(float))
        cell, n = (np.concatenate([x, near.column(k).to_numpy()]) for k, x in enumerate((cell, n)))
    weights = learn_weights(cell[n > 0], n[n > 0], 1 / (size.v_train + 1 if size.v_train else 1))
    count, pair_count, floor = known.train + known.held, known.pair_train + known.pair_held, 1 / (v + 1)
    base_rest = np.log10(total + 0.1 * (v + 1))

    def scores(context: np.ndarray, c2: np.ndarray, c1: np.ndarray) -> np.ndarray:
        w = weights[_bucket(context)]
        return np.log10(w[:, 0] * c2 / np.maximum(context, 1) + w[:, 1] * c1 / max(total, 1) + w[:, 2] * floor)

    def sums(k: int, at: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(at, c1 > 0, k).astype(np.int64), np.bincount(at, np.log10(c1 + 0.1) - base_rest, k).astype(float)

    names = ["key", "n_tokens", "n_known", "base", "score"]

    def near_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, w, length in _tokens(batches):
            index = _find(hashes, w)
            before, _ = _around(np.where(index < 0, cold, index), length)
            doc = np.repeat(np.arange(len(ids)), length)
            use = index >= 0
            index, before, doc = index[use], before[use], doc[use]
            c1 = count[index]
            n_known, base = sums(len(ids), doc, c1)
            use = before != COLD  # the others' partitions score the tokens after them
            index, before, doc = index[use], before[use], doc[use]
            pair = _find(known.pairs, (before + 1) * len(hashes) + index)
            c2 = np.where(pair >= 0, pair_count[pair], 0) if len(pair_count) else np.zeros(len(index))
            score = np.bincount(doc, scores(of_before(before, count, np.empty(0, np.int64)), c2, c1[use]), len(ids)).astype(float)  # no token: integers
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, length.astype(np.int64), n_known, base, score)], names)

    def far_scores(own: pa.Table, more: pa.Table) -> pa.Table:
        rows, (words_, sent_train, sent_held) = _rows(own), known_before(more)
        t, before, firsts, after, at = _unpack(rows), _joined(rows, "before", kind), _joined(rows, "firsts", "<u8"), _joined(rows, "after", kind), _places(rows)
        k, learned = sum(len(r["parts"]) for r in rows), t.part > 0
        c1 = np.bincount(t.number, learned).astype(np.int64)[t.number]
        which = _bigrams(t, before, firsts, width)
        c2 = np.bincount(which, learned)[which]
        context = of_before(before, count, (sent_train + sent_held)[np.searchsorted(words_, firsts)])
        n_known, base = sums(k, at, c1)
        score = np.bincount(at, scores(context, c2, c1), k)
        near = after >= 0
        if near.any():  # hot words after these
            following = after[near].astype(np.int64)
            which = np.unique(t.number[near] * width + following, return_inverse=True)[1]
            c2 = np.bincount(which, learned[near])[which]
            score += np.bincount(at[near], scores(c1[near], c2, count[following]), k)
        cuts = np.cumsum([len(r["docs"]) // 8 for r in rows])[:-1]
        shut = _shut()
        parts = [[shut(x.tobytes()) for x in np.split(x, cuts)] for x in (n_known, base, score)]
        return pa.Table.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([shut(r["docs"]) for r in rows], pa.binary()), *[pa.array(x, pa.binary()) for x in parts]], ["p", "docs", "n_known", "base", "score"])

    def gathered(rows: list[dict]) -> pa.RecordBatch:
        """The sums of a chunk's documents over all partitions of words."""
        rows = _opened(rows)
        ids, at = np.unique(np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows]), return_inverse=True)
        known_, base, score = (np.bincount(at, np.concatenate([np.frombuffer(r[c], t) for r in rows]), len(ids)) for c, t in (("n_known", np.int64), ("base", float), ("score", float)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, np.zeros(len(ids), np.int64), known_.astype(np.int64), base, score)], names)

    schema = "key long, n_tokens long, n_known long, base double, score double"
    far = with_sent(far_scores, "p long, docs binary, n_known binary, base binary, score binary", "chunk", "words", "runs", "before", "firsts", "after", "at", "docs", "parts")
    far = far.repartition(partitions, "p").sortWithinPartitions("p").mapInArrow(_by_chunk(gathered), schema)
    every = docs.mapInArrow(near_scores, schema).unionByName(far)
    summed = every.groupBy(F.col("key").alias("doc_id")).agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return summed.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
