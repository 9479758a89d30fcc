import random

import pytest


def words(rng, n):
    parts = ["la", "ti", "mo", "ren", "sta", "ho", "vi", "ku", "ber", "ne", "sol", "dra"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """id -> text, with edge cases, copies, near copies and shared passages."""
    rng = random.Random(3)
    out = {i: " ".join(words(rng, rng.randint(60, 300))) for i in range(60)}
    passage = " ".join(words(rng, 64))
    for i in (3, 7, 11):
        out[i] = f"{out[i]} {passage} tail{i} {out[i + 1][:80]}"
    base = words(rng, 400)
    for k in range(60, 130):  # near copies, a group larger than a leaf
        w = list(base)
        w[rng.randrange(400)] = f"edit{k}"
        out[k] = " ".join(w)
    for k in range(130, 140):
        out[k] = out[5]
    out |= {200: None, 201: "", 202: "   ", 203: "one two", 204: "one two", 205: "!!!", 206: out[5].upper(), 207: "x" * 30_000, 208: " ".join(words(rng, 12_000)), 209: "one two three four"}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names the operators use themselves; one row is there twice."""
    rows = [(i, t, "en", "s", i, t, i) for i, t in texts.items()]
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, words string, path long").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
