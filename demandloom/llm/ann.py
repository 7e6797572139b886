"""Approximate nearest neighbours by a forest of random-projection trees.

The trees' splits (a random direction and the median of the projections) are fitted on a bounded sample; all vectors are
then dropped into leaves. A query descends all trees through one priority
queue ordered by the smallest margin on the way, until the leaves taken hold its budget of rows;
their rows are reranked by exact distance. The budget is a share of all rows, calibrated on
the sample: the smallest at which held-out queries find the wanted recall.

Identical vectors are collapsed, keeping as many of the smallest ids as any result can name, so a vector
with very many copies is one candidate. Leaves are cut into blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.vectors import matrix, usable
from demandloom.session import stored

BLOCK = 4096  # rows of a leaf that are reranked together


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: direction, threshold and children; a leaf has none and holds a share of the sample."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    roots: tuple[int, ...]
    share: np.ndarray
    budget: float

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x`` in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if not len(rows):
                    continue
                if self.children[node, 0] < 0:
                    out[rows, t] = node
                    continue
                right = x[rows] @ self.directions[node] > self.thresholds[node]
                todo += [(self.children[node, 0], rows[~right]), (self.children[node, 1], rows[right])]
        return out

    def search(self, q: np.ndarray, budget: float | None = None) -> Iterator[int]:
        """Leaves of all trees in the order of their smallest margin, until they hold the budget."""
        margins = self.directions @ q - self.thresholds
        queue = [(-np.inf, root) for root in self.roots]
        left = self.budget if budget is None else budget
        while queue and left > 0:
            worst, node = heappop(queue)
            a, b = self.children[node]
            if a < 0:
                left -= self.share[node]
                yield node
            else:
                heappush(queue, (max(worst, margins[node]), a))
                heappush(queue, (max(worst, -margins[node]), b))


def fit_forest(sample: np.ndarray, trees: int, leaf: int, k: int, recall: float, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    directions, thresholds, children, share, roots = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        node = len(directions)
        d = rng.standard_normal(sample.shape[1])
        d /= np.linalg.norm(d)
        p = sample[rows] @ d
        cut = float(np.median(p)) if len(rows) else 0.0
        right = p > cut
        directions.append(d), thresholds.append(cut), children.append((-1, -1)), share.append(len(rows) / max(1, len(sample)))
        if len(rows) > leaf and right.any() and not right.all():
            children[node] = (grow(rows[~right]), grow(rows[right]))
        return node

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample))))
    forest = Forest(np.array(directions), np.array(thresholds), np.array(children), tuple(roots), np.array(share), float(trees))
    asked = rng.choice(len(sample), min(100, len(sample)), replace=False)
    place = forest.leaves(sample)
    found = []
    for i in asked:  # the visited share at which each true neighbour is met
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        true = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        met, used = {}, 0.0
        for node in forest.search(sample[i], trees + 1.0):
            used += forest.share[node]
            met.setdefault(node, used)
        found += [min(met[n] for n in place[j]) for j in true]
    budget = float(np.quantile(found, min(1.0, recall))) if found else float(trees)
    return Forest(forest.directions, forest.thresholds, forest.children, forest.roots, forest.share, budget + 1e-9)


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, trees: int = 8, sample_rows: int = 8192, leaf: int = 16, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """query_id, rank, ``key``, score: the ``k`` nearest found of each query row among all other rows.

    Both tables have ``key`` and ``vector``; a row's own id is no candidate for it. Score: Euclidean distance in double precision; ties
    go to the smaller id. Vectors that are null, empty, zero, of another length than most of the
    sample, or have null or non-finite components take no part, nor do null ids; of rows with equal
    id and vector one counts. No rows give none. Splits and budget are
    fitted on at most ``sample_rows`` distinct vectors, taken by hash.
    """
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable("v") & F.col("id").isNotNull()).distinct()
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable("v") & F.col("id").isNotNull()).distinct()
    few = good.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asks = stored(asked.groupBy("v").agg(F.min("id").alias("rep")), "queries")
    drawn = [r.v for r in distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).collect()]
    lengths = [len(v) for v in drawn]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if drawn else 1
    forest = fit_forest(np.array([v for v in drawn if len(v) == dim], np.float64).reshape(-1, dim), trees, leaf, k, recall, seed)

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _slices(batch, 2048):
                places = forest.leaves(matrix(x.column(0), dim))
                for t in range(places.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(places[:, t]), x.column(1), x.column(0)], ["leaf", "ids", "v"])

    def _slices(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)

    same = distinct.where(F.size("v") == dim)
    entries = same.select("v", "ids").mapInArrow(dropped, "leaf long, ids array<long>, v array<double>")
    # at most one row per leaf of the forest, whose size the sample bounds
    blocks = {r.leaf: -(-r.n // BLOCK) for r in entries.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for row in range(len(x)):
                nodes = [(n, b) for n in forest.search(x[row]) for b in range(blocks.get(n, 0))]
                at = pa.array([row] * len(nodes), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in nodes], pa.int64()), pa.array([b for _, b in nodes], pa.int64()), batch.column(1).take(at), batch.column(0).take(at)], ["leaf", "block", "rep", "v"])

    wanted = asks.where(F.size("v") == dim).select("v", "rep").mapInArrow(visits, "leaf long, block long, rep long, v array<double>")
    sizes = vectors.sparkSession.createDataFrame([(int(a), int(b)) for a, b in blocks.items()], "leaf long, blocks long")
    data = entries.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64(F.element_at("ids", 1)), "blocks").alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rep"), "ids", "v")
    ask = wanted.select("leaf", "block", F.lit(1).alias("kind"), "rep", F.lit(None).cast("array<long>").alias("ids"), "v")

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        x, ids = np.empty((0, dim)), []
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, most = 0, 500_000

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, n, d = (np.concatenate(c) for c in zip(*best))
            order = np.lexsort((n, d, q))
            q, n, d = q[order], n[order], d[order]
            once = np.concatenate([[True], (q[1:] != q[:-1]) | (n[1:] != n[:-1])])
            q, n, d = q[once], n[once], d[once]
            first = np.concatenate([[True], q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            return q[place <= k], n[place <= k], d[place <= k]

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(keys[a, :2]) != now:
                    now, x, ids = tuple(keys[a, :2]), np.empty((0, dim)), []
                if keys[a, 2] == 0:
                    x = np.concatenate([x, matrix(part.column(5), dim)])
                    ids += part.column(4).to_pylist()
                    continue
                if not len(ids):
                    continue
                q, reps = matrix(part.column(5), dim), part.column(3).to_numpy()
                for i in range(len(q)):
                    d = np.sqrt(((x - q[i]) ** 2).sum(1))
                    near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                    named = [(n, d[j]) for j in near for n in ids[j]]
                    best.append((np.full(len(named), reps[i]), np.array([n for n, _ in named], np.int64), np.array([v for _, v in named])))
                    held += len(named)
                if held > most:
                    best = [merged()]
                    held = len(best[0][0])
                    most = max(most, 2 * held)
        if best:
            q, n, d = merged()
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(n), pa.array(d)], ["rep", "id", "d"])

    both = data.unionByName(ask).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    hits = both.mapInArrow(reranked, "rep long, id long, d double").distinct()
    top = hits.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("d", "id"))).where(F.col("n") <= k + 1).select("rep", "id", "d")
    pairs = asked.select(F.col("id").alias("query_id"), "v").join(asks, "v").select("query_id", "rep").join(top, "rep").where("query_id <> id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), F.col("d").alias("score"))
