import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from brute import LOWER
from compare import compare, connect
from pyspark.sql import functions as F

from demandloom.llm import lexical, sharding, whitening
from demandloom.llm.queries import ORACLES, QUERIES

TERM = re.compile(lexical.TERM)


def whole(v):
    return tuple(math.floor(256 * float(c)) for c in v)


def plain_covariance(fit):
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(x[i] for x in fit), n) for i in range(d)]
    return mean, [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("case", ["usual", "far", "flat", "wide"])
def test_whitening_equals_plain_covariance(spark, case):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((120, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1]) + 5
    if case == "far":  # beyond what a slice sums in 64 bits
        x = x * 1e9
    if case == "flat":
        x[:, 2:] = 1.5
    x[40:80] = x[40]
    rows = [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)]
    if case == "wide":
        rows = [(i, v[: 6 - i % 3], 1, 2) for i, v, *_ in rows]
    odd = [(200, None, 1, 2), (201, [float("nan")] * 6, 1, 2), (202, [None] * 6, 1, 2), (203, [float("-inf")] * 6, 1, 2), (204, [0.0] * 6, 1, 2), (None, [1.0] * 6, 1, 2), (204, [0.0] * 6, 1, 2)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int, component int").repartition(3)
    kept = [(i, whole([*v, *[0.0] * (6 - len(v))])) for i, v, *_ in rows + odd if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({v for _, v in kept})
    mean, cov = plain_covariance(fit)
    values, directions = np.linalg.eigh(np.array(cov, float))
    values, directions = values[::-1][:4], directions[:, ::-1][:, :4]
    out = whitening.whiten(table).collect()
    assert len(out) == 4 * len(kept) and Counter(r.vec_id for r in out) == Counter(i for i, _ in kept for _ in range(4))
    got = {(r.vec_id, r.component): r for r in out}
    live = 2 if case == "flat" else 4
    for i, v in kept:
        z = np.array([float(c - m) for c, m in zip(v, mean)])
        deviation = sum((len(fit) * c - sum(f[k] for f in fit)) ** 2 for k, c in enumerate(v))
        for k in range(4):
            r = got[i, k + 1]
            assert r.n == len(fit) and r.deviation == (deviation if deviation < 2**63 else None)
            if k < live or case != "flat":
                assert math.isclose(abs(r.whitened), abs(z @ directions[:, k]) / math.sqrt(values[k]), rel_tol=1e-6, abs_tol=1e-6)
                assert math.isclose(r.explained, values[k] / np.trace(np.array(cov, float)), rel_tol=1e-9) and r.identity_error < 1e-8
    one = [r for r in out if r.component == 1]
    assert len({math.copysign(1, r.whitened) * math.copysign(1, np.array([float(c - m) for c, m in zip(dict(kept)[r.vec_id], mean)]) @ directions[:, 0]) for r in one if abs(r.whitened) > 1e-3}) == 1


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [])]) == []
    same = of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    huge = of([(1, [3e38, -3e38]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])
    assert len(huge) == 6 and all(r.n == 3 for r in huge)
    assert {r.deviation for r in of([(1, [-0.001]), (2, [0.001])])} == {1}


def test_whitened_query(spark, sf):
    rows = QUERIES["op11_embedding_whitening"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL").count()
    assert len(rows) == 4 * n and max(r.identity_error for r in rows) < 1e-8 and len({r.identity_error for r in rows}) == 1


def ranking(texts, asked, k=50):
    terms = {i: Counter(TERM.findall((x or "").translate(LOWER))) for i, x in texts.items()}
    some = {i: t for i, t in terms.items() if t}
    documents, length = len(some), sum(t.total() for t in some.values())
    df = Counter(x for t in some.values() for x in t)
    out = {}
    for item, text in asked.items():
        own = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, t in some.items():
            m = 50 + 50 * t.total() * documents // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1))) * (10**9 * t[x] // (1000 * t[x] + 20 * m)) for x in own if x in t)
            if score:
                scores.append((-score, i))
        out |= {(item, rank + 1): (i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("block,cells,batch", [(1 << 14, 1 << 20, 1 << 18), (16, 64, 40)])
def test_search_equals_brute_force(spark, documents, texts, monkeypatch, block, cells, batch):
    monkeypatch.setattr(lexical, "BLOCK", block), monkeypatch.setattr(lexical, "CELLS", cells), monkeypatch.setattr(lexical, "BATCH_TERMS", batch), monkeypatch.setattr(lexical, "FIRST", 4)
    rng = random.Random(9)
    some = [w for x in (texts[12], texts[60], texts[131]) for w in x.split()]
    asked = {1: None, 2: "", 3: "?!", 4: "One two", 5: "ONE one Öne", 6: " ".join(rng.choices(some, k=90)), 7: "a b c d e f g h", 8: "no such words 123", 9: texts[70], 10: " ".join(some)}
    items = spark.createDataFrame([(i, x, 7) for i, x in asked.items()] + [(None, "one two", 7), (4, "One two", 7)], "item_id int, text string, rank int")
    docs = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = lexical.search(docs, items, k=7).collect()
    want = ranking(texts, asked, 7)
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows if r.item_id is not None} == want and len(want) > 30
    assert [(r["rank"], r.doc_id) for r in sorted((r for r in rows if r.item_id is None), key=lambda r: r["rank"])] == [(k, want[4, k][0]) for k in range(1, 8) if (4, k) in want]
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0


def test_search_of_repeated_and_nameless_rows(spark):
    docs = spark.createDataFrame([(3, "b a"), (3, "b a"), (None, "b a"), (1, "b a"), (2, "b"), (5, "Ä ä a-b_c9"), (6, "zz")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b"), (1, "b"), (2, "ä c9")], "item_id long, text string")
    rows = {(r.item_id, r["rank"]): r.doc_id for r in lexical.search(docs, items).collect()}
    assert [rows[1, k] for k in range(1, 5)] == [1, 3, 3, None] and rows[2, 1] == 5


def test_masks_are_those_of_columns():
    rng = np.random.default_rng(1)
    for terms in (1, 8, 63, 64, 65, 200):
        bits = rng.random((terms, 300)) < rng.choice([0.02, 0.5])
        member, group = lexical.group_masks(bits)
        assert (bits[:, member][:, group] == bits).all() and len({c.tobytes() for c in bits.T}) == len(member)


@pytest.mark.parametrize("name", ["op12_ranked_lexical_search"])
def test_search_equals_sql(spark, sf, name):
    status, detail, *_ = compare(spark, connect(sf), sf, name, QUERIES, ORACLES)
    assert status == "OK", detail


def drawn(key, weights, seed=29):
    """Rendezvous hashing, plainly."""
    import hashlib

    costs = [(-math.log((int(hashlib.md5(f"{seed}:{s}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / w, s) for s, w in enumerate(weights) if w]
    return min(costs)[1]


@pytest.mark.parametrize("block", [4096, 8])
def test_shards_equal_plain_rendezvous(spark, documents, texts, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    weights = [1.0, 2.0, 0.0, 1.0, 0.5]
    more = documents.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("row", F.lit(2)).withColumn("block", F.lit(2)).withColumn("n", F.lit(2))
    hot = more.where("doc_id = 12").select("*", F.explode(F.sequence(F.lit(1), F.lit(80)))).drop("col")  # a key with a third of the rows
    rows = sharding.shard_documents(more.unionByName(hot), weights, 1.5).collect()
    assert len(rows) == len(texts) + 2 + 80
    places = {}
    for r in rows:
        text = "no id here at all" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "key")
        assert r.shard == drawn(r.doc_id, weights) and r.grown_shard == drawn(r.doc_id, [*weights, 1.5]) and r.grown_shard in (r.shard, 5)
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and 2 not in places
    assert sharding.shard_documents(documents.limit(0)).count() == 0


def test_shards_follow_weights_and_move_little(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(docs, [1.0, 2.0, 1.0], 1.0)
    n = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}
    assert all(abs(n[s] / 20_000 - w / 4) < 0.02 for s, w in enumerate((1, 2, 1)))
    moved = rows.where("shard <> grown_shard")
    assert abs(moved.count() / 20_000 - 1 / 5) < 0.02 and moved.where("grown_shard <> 3").count() == 0
    for bad in ([], [0.0], [-1.0, 1.0], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.col("id"), bad)


def test_shards_run_no_python(spark, sf):
    plan = QUERIES["op13_sharding"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
