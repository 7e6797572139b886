import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import near_components
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from demandloom.llm import language, mixing, packing, warc
from demandloom.llm.queries import ORACLES, QUERIES, vocabulary
from demandloom.session import shared_dir, stored


@pytest.mark.parametrize("name", ["op5_mix_sources", "op9_warc_round_trip"])
def test_queries_equal_sql(spark, sf, name):
    status, detail, *_ = compare(spark, connect(sf), sf, name, QUERIES, ORACLES)
    assert status == "OK", detail


def test_mix_keeps_budgets(spark, documents):
    docs = documents.where("doc_id < 100").withColumn("weight", F.lit("clash"))
    totals = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("t")).collect()}
    rows = mixing.mixed(docs, evenness=0.9, max_repeats=3.0, budget=4000)
    drawn = {r.source: r.t for r in rows.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("t")).collect()}
    weight = {r.source: r.weight for r in rows.select("source", "weight").distinct().collect()}
    assert abs(sum(weight.values()) - 1) < 1e-6 and sum(drawn.values()) <= 4000
    longest = docs.agg(F.max(mixing.words(F.col("text")))).first()[0]
    assert all(4000 * weight[s] - longest <= drawn[s] <= 4000 * weight[s] + 1 for s in drawn)
    whole = mixing.mixed(documents, evenness=1.0, max_repeats=1.5, cover=True)
    assert whole.select("doc_id").distinct().count() == documents.select("doc_id").distinct().count()
    times = [r.n for r in whole.groupBy("doc_id").agg(F.max("pass").alias("n")).collect()]
    assert set(times) <= {0, 1} and mixing.mixed(documents.limit(0)).count() == 0
    assert set(whole.columns) == {*documents.columns, "pass", "block", "pass_order", "weight"} and totals


def test_mix_of_tables_with_clashing_names(spark, documents):
    docs = documents.where("doc_id < 60").select("doc_id", "source", "text")
    drawn = lambda rows: sorted((r.doc_id, r.source or "", r["pass"]) for r in rows)
    want = drawn(mixing.mixed(docs).collect())
    names = ["passes", "rest", "digits", "cut", "of_source", "of_docs", "key", "plan", "mix", "mix_", "p", "d", "h", "tokens", "rows", "with.dot", "Pass"]
    clash = docs
    for name in names:
        clash = clash.withColumn(name, F.lit("mine"))
    rows = mixing.mixed(clash).collect()
    assert drawn(rows) == want
    assert all(r[name] == "mine" for r in rows for name in names[:-1]) and "Pass" not in rows[0].asDict()


def test_blocks_of_a_large_source_cut_at_the_same_hash(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), F.lit("w w w").alias("text"))
    one = mixing.mixed(docs, budget=4000).select("doc_id", "pass").exceptAll(mixing.mixed(docs, budget=4000).select("doc_id", "pass")).count()
    want = {(r.doc_id, r["pass"]) for r in mixing.mixed(docs, budget=4000).collect()}
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    assert one == 0 and {(r.doc_id, r["pass"]) for r in mixing.mixed(docs, budget=4000).collect()} == want


def test_ids_equal_tokenizers():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    other, own = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(2)
    parts = ["a", "b ", "  ", "\n", " ", "'s", "\t", "é", "1", "<|endoftext|>", " ", "\0", "word", "\r\n", "!", "中"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert own.encode(text) == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert np.frombuffer(own.encode("<|endoftext|> a"), "<u4").tolist() == other.encode("<|endoftext|> a", add_special_tokens=False).ids and len(own.encode("<|endoftext|> a")) == 8


def test_patterns_hold_every_piece_and_few_sequences():
    rng = random.Random(5)
    for _ in range(500):
        cap = rng.choice([10, 30, 100])
        sizes: dict[int, int] = {}
        for _ in range(rng.randint(1, 30)):
            sizes[rng.randint(1, cap)] = rng.choice([1, 1, 2, 5, 40])
        used: dict[int, int] = {}
        patterns = packing.packing_patterns(sizes, cap)
        for pattern, n in patterns:
            assert sum(pattern) <= cap and n > 0
            for s in pattern:
                used[s] = used.get(s, 0) + n
        assert used == sizes
        gaps: list[int] = []  # best fit, one piece at a time, largest first
        for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((cap if fit is None else fit) - s)
        assert sum(n for _, n in patterns) <= len(gaps) * 1.05 + 1
    assert packing.packing_patterns({}, 10) == []


def test_packed_pieces_rebuild_the_documents(spark, documents, texts):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack_sequences(documents, path, 64).collect()
    docs: dict = {}
    places: dict = {}
    for r in rows:
        docs.setdefault(r.doc_id, {})[r.start] = r
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, x in texts.items():
        parts = [docs[i][s] for s in sorted(docs[i])]
        assert b"".join(p.ids for p in parts) == packing.encoder(path).encode(x or "") + b"\0\0\0\0"
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 64 for p in parts[1:])
    assert packing.pack_sequences(documents.limit(0), path, 64).count() == 0
    assert packing.assign_sequences(stored(documents.limit(0).select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(1).cast("long").alias("length")))).count() == 0


def test_packing_query_has_digests(spark, sf):
    rows = QUERIES["op6_best_fit_packing"](spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    coder = packing.encoder(vocabulary("byte_bpe_50k.json"))
    for r in rows:
        ids = coder.encode(text[r.doc_id]) + b"\0\0\0\0"
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


@pytest.fixture
def pages(spark):
    same = "<p>" + "same " * 40 + "</p>"
    rows = [(i, f"http://x/{i}\r\nq", same if i % 3 == 0 else f"<p>{i}</p>" * 50, "extra") for i in range(30)]
    rows += [(30, None, None, None), (31, "u", "", None), (32, "u", "short", None), (33, "u", "short", None), (0, "again", same, None), (None, "n", same, None), (34, "é", "ü" * 300_000, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, first string").repartition(3)


@pytest.mark.parametrize("size", [300, 1 << 27])
def test_archives_round_trip(spark, pages, size):
    place = f"{shared_dir(spark)}/warc-test-{size}"
    written = warc.write_archives(pages.withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1)), place, archive_bytes=size)
    assert written.agg(F.sum("records")).first()[0] == 37 and (written.count() > 3) == (size < 1000)
    broken = written.first().path
    with open(broken, "rb") as file, open(broken.replace("pages-", "stray-"), "wb") as other:  # of an attempt that does not count
        other.write(file.read()[:-3])
    rows = warc.read_archives(spark, place, written=written).collect()
    assert warc.read_archives(spark, place).count() > 37
    assert len(rows) == 37 and all(r.error is None for r in rows)
    html = {}
    for r in pages.collect():
        html.setdefault(r.page_id, (r.html or "").encode())
    for r in rows:
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest() and r.payload_bytes == len(html[r.page_id])
        revisit = (r.page_id is None or r.page_id % 3 == 0) and r.page_id not in (0, 30, 33)
        assert (r.record_type, r.refers_to) == (("revisit", 0) if revisit else ("response", None))
        assert (r.payload is None) if revisit else (r.payload == html[r.page_id])
    assert warc.write_archives(pages.limit(0), place + "-none").count() == 0


def test_broken_archives_are_reported():
    good = [warc.page_record(i, "u", b"x" * 200, None) for i in range(40)]
    data = b"".join(warc.archive(iter(good)))
    assert [r for r in warc.frames(data) if b"warcinfo" not in r] == good
    for cut in (3, len(data) - 5, len(data) // 2):
        rows = [x for b in warc._rows(iter([("a", data[:cut])]), True) for x in b.to_pylist()]
        assert rows[-1]["error"]
    import zstandard

    for raw in (b"HTTP", good[0][:-1], good[0].replace(b"WARC-Date", b"WARC-Dat"), good[0].replace(b"x" * 200, b"y" * 200), good[0].replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.WarcError):
            warc.page_of(raw)
        plain = zstandard.ZstdCompressor().compress(raw)
        assert [x["error"] is not None for b in warc._rows(iter([("a", plain)]), True) for x in b.to_pylist()] == [True]


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = language.fit_languages(spark.createDataFrame([(r.lang, r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5], "lang string, text string"))
    kept = {r.doc_id: r for r, x in zip(docs, language.infer(model, [r.text for r in docs])) if x[0] != "und" and x[4] > 0}
    groups = near_components({i: r.text for i, r in kept.items()})
    want = {i for i, c in groups.items() if i == c}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == want and len(kept) >= 0.99 * len(docs)
    coder = packing.encoder(vocabulary("byte_bpe_50k.json"))
    ids = {i: coder.encode(kept[i].text) + b"\0\0\0\0" for i in want}
    passes: dict[int, int] = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        passes[r.doc_id] = passes.get(r.doc_id, 0) + r.length
    assert all(passes[i] * 4 in (len(ids[i]), 2 * len(ids[i])) for i in want)


def test_stages_take_odd_rows(spark, documents):
    import corpus_pipeline

    frame = documents.withColumn("in_text", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (frame, frame.limit(0)):
            out = stage(spark, table, "")
            out.count()
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == frame.columns


def test_near_copies_of_a_repeated_id_lose_no_text(spark):
    import corpus_pipeline

    x, other, third = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(1, x, 5), (2, x, 5), (2, other, 5), (2, other, 5), (3, third, 5), (None, x, 5), (4, other + " end", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    out = corpus_pipeline.jaccard_join(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, x), (2, other), (3, third), (0, x)])


def test_every_query_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())
