"""Exact, near and passage deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import components, exact_dedup, jaccard_join, suffix_dedup
from quire.llm.words import WordHashes, windows


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 30_000])
def test_binary_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    made = exact_dedup.BinaryFuse8.from_bytes(exact_dedup.BinaryFuse8.build(keys).to_bytes())
    assert made.contains(keys).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64) | np.uint64(1 << 63)
    assert made.contains(other).mean() < 0.02
    assert n < 1000 or len(made.slots) < 1.35 * n


def test_exact_dedup(docs, empty, texts):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(texts) + 1
    groups, sizes = defaultdict(list), Counter()
    for i, t in [*texts.items(), (4, texts[4])]:
        groups[norm(t)].append(i)
    for r in rows:
        own = groups[norm(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(norm(texts[r["doc_id"]]).encode()).hexdigest()
        sizes[len(own)] += 1
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_unequal_bytes_are_found(spark):
    """With a digest of the first letter only, texts that begin alike collide."""
    texts = {1: "ab", 2: "AB", 3: "ac", 4: "ad", 5: "ac", 6: "b", 7: None, 8: "", 9: "ad"} | {i: "az" for i in range(100, 900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")


    def weak_digest(data):
        return hashlib.sha256(data[:1]).digest()

    rows = exact_dedup.exact_dedup(docs, digest=weak_digest).collect()
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[norm(t)].append(i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert len(rows) == len(texts)


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(*[w[i:] for i in range(5)]))


def test_jaccard_join(docs, empty, texts):
    rows = jaccard_join.jaccard_join(docs).collect()
    assert len(rows) == len(texts) + 1
    every = [*texts.items(), (4, texts[4])]
    sets = [(i, shingles(t)) for i, t in every]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets):
            if a != b and x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(least.get(root(a), i), i)
    wanted = sorted((i, least[root(a)], links[a]) for a, (i, _) in enumerate(sets))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == wanted
    assert max(links) > 60
    assert jaccard_join.jaccard_join(empty).count() == 0



@pytest.mark.parametrize(("depth", "finish"), [(6, 2048), (1, 0)])
def test_jaccard_join_of_texts_that_share_a_passage(spark, monkeypatch, depth, finish):
    """Pairs of about 0.8 among thousands of texts with a common passage, finished at the root and at the last level."""
    monkeypatch.setattr(jaccard_join, "DEPTH", depth)
    monkeypatch.setattr(jaccard_join, "FINISH", finish, raising=False)
    rng = np.random.default_rng(6)
    passage = [f"p{k}" for k in range(40)]
    rows = {i: [*passage, *(f"w{x}" for x in rng.integers(0, 10**9, rng.integers(30, 90)))] for i in range(2000)}
    for i in range(200):
        rows[5000 + i] = [*rows[i][: -len(rows[i]) // 6], f"edit{i}"]
    sets = [(i, shingles(" ".join(w))) for i, w in rows.items()]
    links, least = Counter(), {i: i for i in rows}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):  # 0.8 of the union
                links.update((i, j))
                least[i] = min(least[i], j)
    assert len(links) > 200
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = jaccard_join.jaccard_join(d).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: links[i] for i in rows}
    assert {r["doc_id"]: r["class_id"] for r in got} == least

def test_deep_paths(spark, texts, monkeypatch):
    """Large nodes: pivots and deeper levels find what brute force finds."""
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    near = {i: t for i, t in texts.items() if 60 <= i < 130}
    docs = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    rows = jaccard_join.jaccard_join(docs).collect()
    assert {r["class_id"] for r in rows} == {60}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def repeated(texts, length=50):
    first, several, words = {}, set(), {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if first.setdefault(key, i) != i:
                several.add(key)
    out = set()
    for i, w in words.items():
        begin = end = None
        for k in range(len(w) - length + 1):
            if tuple(w[k : k + length]) in several:
                if end is not None and k > end:
                    out.add((i, begin, end))
                    begin = None
                begin = k if begin is None else begin
                end = k + length
        if end is not None:
            out.add((i, begin, end))
    return out


def test_repeated_passages(docs, empty, texts):
    rows = suffix_dedup.repeated_spans(docs).collect()
    wanted = repeated(texts)
    assert {(r["doc_id"], r["start"], r["end"]) for r in rows} == wanted
    assert len(rows) == len(wanted)
    assert {3, 7, 11} <= {i for i, _, _ in wanted}
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_windows_do_not_depend_on_place():
    own = WordHashes().of("a b c d e f g h i j k l m n o p")
    for k in (1, 2, 5, 7, 16):
        assert (windows(own[3:], k) == windows(own, k)[3:]).all()
        assert len(windows(own, k)) == 16 - k + 1
    assert len(windows(own, 17)) == 0


def test_minimisers_cover_every_window():
    seeds = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    at = suffix_dedup.minimisers(seeds, 9)
    assert all(any(k <= p < k + 9 for p in at) for k in range(500 - 8))


@pytest.mark.parametrize("size, n_far", [(3_949, 3_948), (4_096, 4_096), (4_500, 3_700), (40_000, 400)])
def test_rows_of_pairs_of_blocks_do_not_grow_with_the_square_of_a_node(spark, size, n_far):
    assert size * n_far <= jaccard_join.FINISH**2
    rows = spark.range(size).selectExpr("7L path", "id rep", f"id < {n_far} far", f"{size}L size", f"{n_far}L n_far", "binary('') values")
    dealt = jaccard_join.block_pairs(rows)
    assert size <= dealt.count() <= (size if size <= jaccard_join.FINISH else 2.5 * size)
    blocks = {(r.rep, r.own) for r in dealt.select("rep", "own").distinct().collect()}
    assert len(blocks) == size
    if size > jaccard_join.FINISH:  # every far set meets every set
        units = dealt.groupBy("i", "j").count().collect()
        n_own = {}
        for _, own in blocks:
            n_own[own] = n_own.get(own, 0) + 1
        far_own = {r.own for r in dealt.filter("far").select("own").distinct().collect()}
        assert {(u.i, u.j) for u in units} >= {(min(a, b), max(a, b)) for a in far_own for b in n_own}
