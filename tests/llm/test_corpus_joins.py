"""Ranked search, source divergence and signature joins against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import divergence, ranked_search, signature_join


def words(rng, n):
    parts = ["la", "ti", "mo", "ren", "sta", "ho", "vi", "ku", "ber", "ne", "sol", "dra"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- ranked search


def searched(rows, items, k=20):
    """item -> [(doc_id, score)], by the definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(term.findall(ascii_lower(t)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    number, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(term.findall(ascii_lower(t)))
    out = {}
    for item, own in asked.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * number) // length
            score = sum(times * math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in own.items() if c[t])
            if score > 0:
                scores.append((-score, (i is not None, i), i, score))
        out[item] = [(i, s) for _, _, i, s in sorted(scores, key=lambda x: x[:2])[:k]]
    return {i: v for i, v in out.items() if v}


def got_ranks(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r.rank):
        out[r.item_id].append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return dict(out)


@pytest.fixture(scope="module")
def asked(texts):
    rng = random.Random(9)
    some = [(k, " ".join(t.split()[:40])) for k, t in enumerate(texts[i] for i in (3, 8, 61, 140 - 5))]
    return [*some, (10, " ".join(words(rng, 25))), (11, None), (12, ""), (13, "!?"), (14, "neverthere"), (15, "ONE one Two"), (10, "sta ti mo"), (15, "ONE one Two"), (None, "la ti")]


def test_search_is_brute_force(spark, docs, texts, asked, monkeypatch):
    rows = [*texts.items(), list(texts.items())[4]]
    items = spark.createDataFrame(asked, "item_id long, text string")
    want = searched(rows, asked)
    assert len(want) == 7 and max(len(v) for v in want.values()) == 20 and len(want[15]) < 20
    assert got_ranks(ranked_search.search(docs, items)) == want
    # small blocks, a first search over a part of the rows, several batches of items
    monkeypatch.setattr(ranked_search, "BLOCK", 16)
    monkeypatch.setattr(ranked_search, "FIRST", 40)
    monkeypatch.setattr(ranked_search, "BATCH_BYTES", 500)
    assert got_ranks(ranked_search.search(docs, items)) == want
    assert got_ranks(ranked_search.search(docs, items, k=3)) == {i: v[:3] for i, v in want.items()}


def test_search_of_other_ids_and_nothing(spark, docs, empty, asked):
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(docs, items.filter("false")).collect() == []
    rows = [("b", "la ti mo"), ("a", "la ti mo"), (None, "la ti mo"), ("é", "la ti"), ("c", None)]
    named = spark.createDataFrame(rows, "doc_id string, text string")
    found = got_ranks(ranked_search.search(named, spark.createDataFrame([("x", "La mo")], "item_id string, text string")))
    assert [i for i, _ in found["x"]] == [None, "a", "b", "é"]
    assert found == searched(rows, [("x", "La mo")])


def test_search_stops_early_and_stays_whole():
    """Postings that are never read don't change what is returned."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, known = 3000, 60
    terms, tf = [], []
    for _ in range(n):
        own = np.flatnonzero(rng.random(known) < 0.3).astype(np.int32)
        terms.append(own.tobytes())
        tf.append(rng.geometric(0.4, len(own)).astype(np.int32).tobytes())
    block = ranked_search.Block(pa.array(range(n)), rng.integers(20, 400, n), terms, tf, n, 200 * n, known)
    read = []
    whole = block.complete
    block.complete = lambda some, factor: (read.append(len(some)), whole(some, factor))[1]
    for trial in range(20):
        own = rng.choice(known, 3, replace=False)
        factors = np.array([40_000, 900, 3], np.int64) * rng.integers(1, 3, 3)
        factor = np.zeros(known, np.int64)
        factor[own] = factors
        scores = whole(np.arange(n), factor)
        want = np.lexsort((np.arange(n), -scores))[:5]
        may, found = block.search(own, factors, factor, 5, 0)
        assert set(may) == set(want) and (found == scores[may]).all(), trial
    assert read and max(read) <= ranked_search.FEW


# ---------------------------------------------------------------- divergence


def audited(rows, least_docs, top):
    """Rows of the result, by the definition; rows: (text, lang, source)."""
    rows = [((t or ""), (lang or ""), (s or "")) for t, lang, s in rows]
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    out = []
    for lang in {r[1] for r in rows}:
        own = [(s, term.findall(ascii_lower(t))) for t, x, s in rows if x == lang]
        df = Counter(t for _, ts in own for t in set(ts))
        kept = [t for t in df if df[t] >= least_docs]
        groups = {s: Counter() for s, _ in own}
        for s, ts in own:
            groups[s].update(t for t in ts if df[t] >= least_docs)
        every = sum(groups.values(), Counter())

        def share(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + (10**9 * (c[t] + 2)) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def test_divergence_is_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(160):
        source = None if k % 17 == 0 else "" if k % 19 == 0 else f"s{k % 5}" if k % 3 else "s0"
        lang = rng.choice(["en", "en", "de", None])
        text = " ".join(words(rng, rng.randint(0, 60)))
        rows.append((text.title() + rng.choice(["", " Éa éa 3x7 \x01y", " ÄÄ", "!"]), lang, source))
    rows += [(None, "en", "s9"), ("", "fr", "alone"), ("only here", "fr", "two"), ("x" * 40_000, "en", "s1"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, n long, term string").repartition(4)
    monkeypatch.setattr(divergence, "HELD", 300)  # tables of counts are flushed
    for least, top in ((4, 10), (10, 3), (1000, 10)):
        got = sorted(tuple(r) for r in divergence.audit(df, least_docs=least, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == audited(rows, least, top)
    assert divergence.audit(df.filter("false")).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.sql("SELECT 3000000000000000000L AS c, 4000000000000000001L AS n, 7L AS v").select(F.expr(divergence._share("c", "n"))).first()
    assert row[0] == 1 + 10**9 * (3 * 10**18 + 2) // (4 * 10**18 + 15)


# ---------------------------------------------------------------- signature join


def near(rows, threshold=80, k=4):
    """doc_id -> (n_shingles, component_id), by the definition."""
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", ascii_lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k, 0) + 1)} if w else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    where = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    for i in ids:
        for j, both in Counter(j for s in sets[i] for j in where[s] if j > i).items():
            if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got_components(df):
    rows = df.collect()
    for r in rows:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_near_copies_are_brute_force(docs, texts):
    found = signature_join.near_copies(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.count() == len(texts) + 1
    assert got_components(found) == near(texts.items())


def test_long_lists_and_pages_of_one_template(spark):
    """Lists longer than a leaf: a chain of edits, and pages of one template that aren't similar enough."""
    rng = random.Random(8)
    rows, base = [], words(rng, 200)
    for k in range(90):  # each differs a little from the one before
        base[rng.randrange(200)] = f"chain{k}"
        rows.append((k, " ".join(base)))
    shared = words(rng, 150)
    for k in range(100, 200):
        rows.append((k, " ".join(shared + words(rng, 40))))
    for k in range(200, 240):  # copies of pages with an edit at the end: at the threshold or beyond
        rows.append((k, rows[100][1] + " " + " ".join(words(rng, k % 50))))
    rows += [(300, "a b c d"), (301, "A B C D"), (302, "a b c"), (303, "a\tb\nc\x0bd"), (304, "a b\x1cc d"), (305, None), (306, "\x0c \r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got_components(signature_join.near_copies(df)) == near(rows)


def test_near_copies_of_string_and_null_ids(spark):
    rows = [("b", "one two three four five"), ("a", "One Two three four five"), (None, "one two three four five"), (None, None), ("c", None), ("é", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(map(tuple, signature_join.near_copies(df).collect()), key=str)
    assert got == sorted([("b", 2, "a", False), ("a", 2, "a", True), (None, 0, None, True), (None, 0, None, True), ("c", 0, "c", True), ("é", 0, "é", True)], key=str)


def test_near_copies_of_nothing(empty):
    assert signature_join.near_copies(empty).collect() == []


def test_missed_links_are_rare():
    assert signature_join.missed(0.8) < 1e-5 < signature_join.missed(0.7)
