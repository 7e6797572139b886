import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def texts():
    """Documents with a null, empty, blank and very long text, ties, near and exact copies."""
    import random

    rng = random.Random(3)
    pool = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    out: dict[int, str | None] = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "One", 5: "one two three", 6: "one two three four five"}
    for i in range(7, 60):
        out[i] = " ".join(rng.choices(pool, k=rng.randint(1, 300)))
    base = rng.choices(pool, k=400)
    for i in range(60, 110):  # a group of near copies, some too far apart to link
        copy = list(base)
        for _ in range(rng.randint(0, 30)):
            copy[rng.randrange(len(copy))] = rng.choice(pool)
        out[i] = " ".join(copy)
    for i in range(110, 130):
        out[i] = out[i - 60]
    for i in range(130, 160):  # a passage that many share
        out[i] = " ".join([*rng.choices(pool, k=60), *base[:25], *rng.choices(pool, k=40)])
    out[160] = " ".join(rng.choices(pool, k=60_000))
    out[161] = "x" * 200_000
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The same as a table, with extra columns of names the operators use inside, a repeated row and a null doc_id."""
    rows = [(i, x, "en", f"s{i % 3}" if i % 7 else None, None, 1, 2, 3) for i, x in texts.items()]
    rows += [rows[20], (None, "no id here at all", None, None, None, 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, c int, score int").repartition(3)
