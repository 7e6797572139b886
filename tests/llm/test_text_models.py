import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import base_scores, crc_fold, language_mixtures, licences, longest_match, words
from pyspark.sql import functions as F

from demandloom.llm import language, licenses, lm
from demandloom.llm.hashing import word_hashes
from demandloom.llm.queries import QUERIES, vocabulary
from demandloom.llm.token_counts import Automaton, automaton, token_counts


def test_counts_equal_greedy_matching(spark, documents, texts):
    machine = automaton(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(200):
        first = {b" " + bytes(rng.choices(b"ab", k=rng.randint(0, 4))) for _ in range(rng.randint(1, 6))}
        rest = {bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))}
        small = Automaton(first, rest)
        for _ in range(40):
            word = b" " + bytes(rng.choices(b"ab", k=rng.randint(1, 12)))
            assert small.pieces_in(word) == longest_match(word, first, rest)
    rows = token_counts(documents, vocabulary("byte_bpe_50k.json")).collect()
    assert len(rows) == documents.count()
    for r in rows:
        if r.doc_id is not None and r.doc_id < 60:
            own = (texts[r.doc_id] or "").encode().split()
            assert (r.n_words, r.n_tokens) == (len(own), sum(machine.pieces_in(b" " + w) for w in own))
    assert token_counts(documents.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_counts_equal_word_piece_of_tokenizers():
    from tokenizers import Tokenizer, models

    pieces = ["[UNK]", "un", "##aff", "##able", "##a", "##b", "##f", "##l", "##e", "a", "ab", "##abl", "u", "##n"]
    other = Tokenizer(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=1000))
    own = Automaton([p.encode() for p in pieces[1:] if p[:2] != "##"], [p[2:].encode() for p in pieces if p[:2] == "##"])
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choices("unafble", k=rng.randint(1, 12)))
        assert own.pieces_in(word.encode()) == len(other.encode(word).tokens)


def test_languages_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (crc_fold(r.doc_id, 5) == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_odd_texts(spark):
    en = "the quick brown fox jumps over the lazy dog while it was there and then that " * 3
    de = "der schnelle braune fuchs springt über den faulen hund und das ist nicht gut " * 3
    rows = [("en", en), ("de", de), (None, "abc"), ("fr", None), ("es", "123")]
    model = language.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert model.names == ("de", "en")
    texts = [en, de, en + de, None, "", "12 34!", "x", "中文", "the " * 400_000]
    found = language.infer(model, texts)
    assert [x[0] for x in found[:2]] == ["en", "de"] and set(found[2][2]) == {"de", "en"} and abs(found[2][1] - 0.5) < 0.1
    assert [x[0] for x in found[3:6]] == ["und"] * 3 and found[6][0] in model.names and found[7][0] in model.names and found[8][0] == "en"
    table = spark.createDataFrame([(i, x, "mine", 9) for i, x in enumerate(texts)], "doc_id long, text string, lang_pred string, fit int")
    assert [r.lang_pred for r in language.identify(table, model).orderBy("doc_id").collect()] == [x[0] for x in found]
    nothing = language.fit_languages(table.select(F.lit(None).cast("string").alias("lang"), "text"))
    assert {r.lang_pred for r in language.identify(table, nothing).collect()} == {"und"} and language.identify(table.limit(0), model).count() == 0


def test_mixtures_equal_brute_force(spark):
    rng = random.Random(12)
    speech = {x: ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(40)] for x, letters in {"a": "abcde", "b": "cdefg", "c": "efghé", "d": "xyzab"}.items()}
    labelled = [(x, " ".join(rng.choices(speech[x], k=60))) for x in speech for _ in range(5)] + [(None, "abc"), ("a", None), ("e", "123")]
    texts = [None, "", "99", "Abc-def, ghé!", "é"]
    for _ in range(40):
        some = rng.sample(sorted(speech), rng.randint(1, 3))
        texts.append(" ".join(rng.choice(speech[rng.choice(some)]) for _ in range(rng.randint(1, 200))))
    model = language.fit_languages(spark.createDataFrame(labelled, "lang string, text string").repartition(3))
    assert model.names == tuple(sorted(speech))
    for got, (name, shares) in zip(language.infer(model, texts), language_mixtures(labelled, texts), strict=True):
        assert got[0] == name and set(got[2]) == set(shares)
        assert all(math.isclose(got[2][x], v, rel_tol=1e-9) for x, v in shares.items())


def test_long_texts_count_as_in_one_piece(monkeypatch):
    text = "Ab c1de  fé,g " * 50
    whole = language._counts(text)
    monkeypatch.setattr(language, "PIECE", 7)
    cut = language._counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_scores_equal_brute_force(spark, documents, texts, monkeypatch):
    weights = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: weights.setdefault("w", learn(*a)))
    docs = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    fold = language.fold_of(F.col("doc_id"), 10)
    found = {r.doc_id: r for r in lm.score_documents(docs, F.when(fold == 0, 0).when(fold == 1, lm.HELD).otherwise(lm.TRAIN), contexts=50).collect()}
    w = weights["w"]
    assert set(found) == set(texts) and np.allclose(w.sum(1), 1) and w[0, 0] == 0
    for i, (n, known, train, base) in base_scores(texts).items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and math.isclose(r.base_score, base, rel_tol=1e-9)
    tokens = {i: [*words(x), None] for i, x in texts.items()}
    c, c2 = Counter(), Counter()
    for i, t in tokens.items():
        if crc_fold(i, 10):
            c.update(t)
    number = {x: int(np.int64(lm.END.view(np.int64))) if x is None else int(word_hashes(x).view(np.int64)[0]) for x in c}
    top = set(sorted(c, key=lambda x: (-c[x], number[x]))[:50])
    for i, t in tokens.items():
        if crc_fold(i, 10):
            c2.update((a, b) for a, b in zip(t, t[1:]) if a in top)
    total, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        score = 0.0
        for before, x in zip([None, *t], t):
            cv = c[before] if before in top and before is not None else 0
            b = min(int(math.log2(cv)) + 1, lm.BUCKETS - 1) if cv else 0
            score += math.log10((w[b, 0] * c2[before, x] / cv if cv else 0) + w[b, 1] * c[x] / total + w[b, 2] / (v + 1))
        assert math.isclose(found[i].score, score, rel_tol=1e-9)
    assert lm.score_documents(docs.limit(0), F.lit(1)).count() == 0
    both = lm.score_documents(documents, F.lit(lm.TRAIN))
    assert both.where("doc_id IS NULL").count() == 1 and both.count() == len(texts) + 1


@pytest.mark.parametrize("hot", [0, 20, 1024])
def test_every_word_is_a_context(spark, documents, texts, monkeypatch, hot):
    seen = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda cells, n, floor: seen.update(cells=cells, n=n, floor=floor, w=learn(cells, n, floor)) or seen["w"])
    docs = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    fold = language.fold_of(F.col("doc_id"), 10)
    found = {r.doc_id: r for r in lm.score_documents(docs, F.when(fold == 0, 0).when(fold == 1, lm.HELD).otherwise(lm.TRAIN), hot=hot).collect()}
    tokens = {i: [*words(x), None] for i, x in texts.items()}
    c, c2 = {k: Counter() for k in (lm.TRAIN, lm.HELD)}, {k: Counter() for k in (lm.TRAIN, lm.HELD)}
    for i, t in tokens.items():
        if crc_fold(i, 10):
            part = lm.HELD if crc_fold(i, 10) == 1 else lm.TRAIN
            c[part].update(t), c2[part].update(zip(["", *t], t))  # "": the start
    train, total = sum(c[lm.TRAIN].values()), sum(c[lm.TRAIN].values()) + sum(c[lm.HELD].values())
    pairs = [(c[lm.TRAIN][a], c2[lm.TRAIN][a, b], c[lm.TRAIN][b] / train, n) for (a, b), n in c2[lm.HELD].items()]
    context, together, p1, n = map(np.array, zip(*pairs))
    want = lm._cells(lm._bucket(context), together / np.maximum(context, 1) * (context > 0), p1, n)
    got = Counter()
    for cell, k in zip(seen["cells"], seen["n"]):
        got[int(cell)] += k
    assert got == dict(zip(want.column(0).to_pylist(), want.column(1).to_pylist())) and seen["floor"] == 1 / (len(c[lm.TRAIN]) + 1)
    w, both, both2 = seen["w"], c[lm.TRAIN] + c[lm.HELD], c2[lm.TRAIN] + c2[lm.HELD]
    for i, t in tokens.items():
        score = 0.0
        for before, x in zip(["", *t], t):
            cv = both[before]
            b = min(int(math.log2(cv)) + 1, lm.BUCKETS - 1) if cv else 0
            score += math.log10((w[b, 0] * both2[before, x] / cv if cv else 0) + w[b, 1] * both[x] / total + w[b, 2] / (len(both) + 1))
        assert math.isclose(found[i].score, score, rel_tol=1e-9)
        assert found[i].n_known == sum(both[x] > 0 for x in t)


def test_weights_recover_a_mixture():
    rng = np.random.default_rng(0)
    n = 20_000
    p2, p1 = np.exp2(-rng.integers(1, 8, n)), np.exp2(-rng.integers(6, 14, n))
    cells = lm._cells(np.full(n, 5), p2, p1, 0.7 * p2 + 0.3 * p1)
    w = lm.learn_weights(cells.column(0).to_numpy(), cells.column(1).to_numpy(), 1e-9)
    assert w[5, 0] > 0.9 * w[5, :2].sum() - 0.3 and np.isclose(w[5].sum(), 1)


def test_held_out_likelihood_beats_base(spark):
    rows = QUERIES["op8_deleted_interpolation"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


@pytest.fixture(scope="module")
def licensed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, licenses.scan(docs).collect()


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licence_scan_equals_brute_force(spark, classifier):
    rng = random.Random(21)
    notices = [n for v in licenses.NOTICES.values() for n in v]
    other = "the of to in and license software use terms version file any work public free copy under for is copyright general".split() + ["foo", "bar", "baz42", "x-y.z"]
    texts = [None, "", "MIT", "SPDX-License-Identifier: MIT", notices[0] + " " + notices[4], "\n".join(notices), " ".join(rng.choices(other, k=900))]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(" ".join(rng.choices(other, k=rng.randint(0, 60))))
            notice = rng.choice(notices).split(" ")
            notice = [w for w in notice if rng.random() > rng.choice([0, 0, 0.1, 0.3])]
            for _ in range(rng.choice([0, 0, 3])):
                notice.insert(rng.randint(0, len(notice)), rng.choice(other))
            parts.append(rng.choice([" ", "\n# ", "\r\n * "]).join(notice))
        texts.append("\n".join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in licenses.scan(rows, classifier=classifier).collect()}
    several = 0
    for i, text in enumerate(texts):
        want = licences(text, classifier, licenses)
        assert (found[i].families, found[i].n_notices) == (sorted(want), sum(n for n, _ in want.values()))
        if want:
            best = max(want, key=lambda x: (want[x][1], [-ord(c) for c in x]))
            assert math.isclose(found[i].probability, max(v[0] for _, v in want.values()), rel_tol=1e-9) and math.isclose(found[i].similarity, max(v[1] for _, v in want.values()))
            assert want[found[i].license][1] == pytest.approx(want[best][1])
        several += len(want) > 1
    assert several > 20


def test_classifier_names_families_and_knows_the_unknown(spark, classifier):
    """Held-out accuracy of the classifier alone, on notices and near misses in texts that it has not seen."""
    rng = random.Random(5)
    other = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(50).collect() if r.text and len(r.text.split()) > 30]
    rows = []
    for name, notices in licenses.NOTICES.items():
        for n in notices:
            for _ in range(4):
                text = rng.choice(other)
                at = rng.randint(0, 10)
                rows.append((len(rows), name, " ".join(text[:at]) + " " + n + " " + " ".join(text[at:20])))
                words_ = n.split(" ")
                if len(words_) >= 12:
                    rows.append((len(rows), None, " ".join(text[:20]) + " " + " ".join(words_[:3]) + " " + " ".join(text[20:30])))
    rows += [(len(rows) + k, None, " ".join(x)) for k, x in enumerate(other)]
    table = spark.createDataFrame([(i, x) for i, _, x in rows], "key int, text string")
    best = classifier.probabilities(licenses.windows(table)).select("key", F.slice("probabilities", 2, len(licenses.NAMES)).alias("p"))
    top = best.select("key", F.array_max("p").alias("p"), F.array_position("p", F.array_max("p")).alias("k")).groupBy("key").agg(F.max(F.struct("p", "k")).alias("x")).collect()
    said = {r.key: licenses.NAMES[r.x.k - 1] for r in top if r.x.p >= classifier.least}
    right = [said.get(i) == name for i, name, _ in rows if name]
    assert sum(right) >= 0.95 * len(right)
    assert sum(i in said for i, name, _ in rows if name is None) <= 0.1 * sum(name is None for _, name, _ in rows)
    assert licenses.LEAST <= classifier.least < 1


def test_licences_of_the_table(licensed):
    docs, rows = licensed
    says = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = {i: sorted({f for line, f in says.items() if line in x}) for i, x in text.items()}
    assert {r.doc_id: r.families for r in rows} == want and any(want.values())
    assert all((r.license is None) == (r.n_notices == 0) for r in rows)


def test_licences_of_odd_texts(spark, licensed):
    docs, _ = licensed
    rows = [(1_000_001, None), (1_000_002, ""), (1_000_003, "MIT"), (1_000_004, "so\nLicensed under the apache license,  version 2.0\r\nReleased under the MIT License."), (None, "Licensed under CC BY 4.0."), (1_000_005, "word " * 50_000)]
    table = docs.select("doc_id", "text").where("doc_id < 300").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("label", F.lit(5)).withColumn("features", F.lit("x"))
    found = {r.doc_id: r for r in licenses.scan(table).where("doc_id > 1000000 OR doc_id IS NULL").collect()}
    assert found[1_000_001].n_notices == found[1_000_002].n_notices == found[1_000_005].n_notices == 0
    assert found[1_000_004].families == ["Apache-2.0", "MIT"] and found[None].license == "CC-BY-4.0"
    assert licenses.scan(table.limit(0)).count() == 0


WRAPPED = {
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.""",
}


def test_wrapped_licences_and_several_in_a_line(spark, licensed):
    docs, _ = licensed
    marks = ["", "// ", " * ", "# ", "-- ", "    "]
    rows = [(2_000_000 + 10 * k + j, "#!/bin/sh\n\n" + "\n".join(mark + x for x in text.split("\n")) + "\n\nint main()") for k, text in enumerate(WRAPPED.values()) for j, mark in enumerate(marks)]
    rows += [(3_000_000, "Licensed under the Apache License, Version 2.0. Released under the MIT License."), (3_000_001, "Released under the MIT License.\n" * 3), (3_000_002, "// SPDX-License-Identifier: MIT\nint main()"), (3_000_003, "under the terms of the treaty, in all copies")]
    table = docs.select("doc_id", "text").where("doc_id < 300").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r for r in licenses.scan(table).where("doc_id >= 2000000").collect()}
    got = {(k, mark): (found[2_000_000 + 10 * i + j].families, found[2_000_000 + 10 * i + j].n_notices) for i, k in enumerate(WRAPPED) for j, mark in enumerate(marks)}
    assert got == {(k, mark): ([k], 1) for k in WRAPPED for mark in marks}
    assert found[3_000_000].families == ["Apache-2.0", "MIT"] and found[3_000_000].n_notices == 2
    assert found[3_000_001].n_notices == 3 and found[3_000_002].license == "MIT" and found[3_000_003].license is None


def test_postings_travel_compressed():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 300)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([lm.TRAIN] * 200, pa.int32()), pa.array(texts)], ["doc_id", "part", "text"])
    shut = [r for b in lm._poster(np.empty(0, np.uint64), np.arange(3), lm.COLD)(iter([batch])) for r in b.to_pylist()]
    rows = lm._opened(shut)
    size = lambda of: sum(len(v) for r in of for v in r.values() if isinstance(v, bytes))
    assert size(shut) < 0.7 * size(rows)
    assert sum(np.frombuffer(r["runs"], "<u4").sum() for r in rows) == 200 * 301 and len({w for r in rows for w in np.frombuffer(r["words"], "<u8")}) == len({w for t in texts for w in t.split()}) + 1
