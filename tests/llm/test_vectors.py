import numpy as np
import pytest

from demandloom.llm.ann import nearest
from demandloom.llm.near_vectors import near_duplicates


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12))
    x[100:160] = x[100] + 0.08 * rng.standard_normal((60, 12))
    x[200:240] = x[200]
    rows = [(i, [float(v) for v in x[i]], i % 3, 1) for i in range(400)]
    odd = [(1000, None, 0, 1), (1001, [0.0] * 12, 0, 1), (1002, [float("nan")] + [1.0] * 11, 0, 1), (1003, [float("inf")] * 12, 0, 1), (1004, [None] + [1.0] * 11, 0, 1), (1005, [], 0, 1), (None, [1.0] * 12, 0, 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, n int"), x


def test_near_duplicates_equal_brute_force(spark, vectors):
    table, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    rows = near_duplicates(table).collect()
    assert len(rows) == 407
    for r in rows:
        if r.vec_id is not None and r.vec_id < 400:
            assert (r.n_links, r.component_id, r.kept) == (link[r.vec_id].sum(), label[r.vec_id], label[r.vec_id] == r.vec_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert near_duplicates(table.limit(0)).count() == 0


def test_neighbours_reach_recall_and_exact_order(spark, vectors):
    table, x = vectors
    rows = nearest(table, table.where("vec_id % 10 = 0")).collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 400, 10))
    hit = 0
    for q, near in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(400), d))[:10]
        hit += len(set(true) & {r.vec_id for r in near})
        assert [r["rank"] for r in near] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-9 for r in near)
        assert [(r.score, r.vec_id) for r in near] == sorted((r.score, r.vec_id) for r in near)
    assert hit >= 0.9 * 10 * len(found)
    copies = [r.vec_id for r in found[230]]
    assert copies == [i for i in range(200, 240) if i != 230][:10]  # ties to smaller ids
    assert nearest(table.limit(0), table.limit(0)).count() == 0
    few = table.where("vec_id < 4")
    assert nearest(few, few).count() == 12


def test_recall_of_registered_query(spark):
    from demandloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    rows = QUERIES["op1_forest_neighbours"](spark, sf).toPandas()
    hit = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(ids[np.argsort(d)[:10]]) & set(rows[rows.query_id == ids[q]].vec_id))
    assert hit >= 0.9 * 10 * len(asked)
