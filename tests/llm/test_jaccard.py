import numpy as np
from brute import near_components, shingle_set

from demandloom.llm.components import components
from demandloom.llm.hashing import shingles, word_hashes
from demandloom.llm.jaccard import jaccard_components, keys_of


def test_components_equal_brute_force(spark, documents, texts):
    rows = jaccard_components(documents).collect()
    want = near_components(texts)
    assert len(rows) == documents.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == (len(shingle_set(texts[r.doc_id])), want[r.doc_id])
    assert jaccard_components(documents.limit(0)).count() == 0


def test_query_equals_brute_force_on_whole_table(spark, sf):
    from demandloom.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = near_components(docs)
    found = {r.doc_id: r.component_id for r in QUERIES["op4_ngram_jaccard_join"](spark, sf).collect()}
    assert found == want and any(i != c for i, c in want.items())


def test_near_sets_share_a_key_whatever_is_frequent():
    rng = np.random.default_rng(1)
    for n in (1, 3, 8, 31, 32, 40, 64, 200, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = int((0.2 / 1.8) * 2 * len(a))
            cut = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, most - cut, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            heavy = np.sort(rng.choice(a, len(a) // 2, replace=False))
            assert len(np.intersect1d(keys_of(a, 0.8, heavy), keys_of(b, 0.8, heavy)))


def test_hashes_ignore_case_and_kind_of_white_space():
    assert (word_hashes("A b\tC") == word_hashes("a  B\nc")).all()
    assert len(word_hashes("é x")) == 1 and len(shingles(word_hashes("a b a b a b a b"))) == 2
    long = "w " * 2_000_000
    assert len(word_hashes(long)) == 2_000_000 and len(np.unique(word_hashes(long))) == 1


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3), (300, 200), (200, 300)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 7 for i in range(7, 60)) and found[300] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
