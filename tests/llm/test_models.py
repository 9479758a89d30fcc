"""Language, toxicity, decontamination, licenses, personal data."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, langid, licenses, pii, toxicity
from quire.llm.queries import crc_part

WORDS = {"xx": "der die das und nicht ist ein auf mit sich", "yy": "the of and to in is that for with was", "zz": "le la les et des est une pour dans qui"}


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(rng.choice([*WORDS]) for _ in range(400))]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !!", "yy"), (1003, "the of and", None), (1004, "the of and " * 20_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(languages):
    model = langid.train(languages, crc_part(4) != 2)
    got = {r["doc_id"]: r for r in langid.predict(languages, model).collect()}
    held = [r for r in languages.withColumn("h", crc_part(4) == 2).collect() if r["h"] and r["doc_id"] < 1000]
    assert held and np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[1003]["lang_pred"] == got[1004]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_language_without_labels(languages):
    model = langid.train(languages.filter("false"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(languages, model).collect()} == {"und"}
    assert langid.predict(languages.filter("false"), model).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], np.ones(langid.BUCKETS, np.float32), np.zeros((langid.BUCKETS, 2), np.float32))
    model.weights[0], model.weights[1] = (8, 0), (0, 8)
    rows = [(np.array([k]), np.ones(1, np.float32)) for k in (0, 1) * 200]
    y = np.array([0, 1] * 200)
    flip = rng.random(400) < 0.2
    t = langid.fit_temperature(model, rows, np.where(flip, 1 - y, y))
    assert 3 < t < 12  # confident weights, a fifth of them wrong: softened to about log(4)


def test_fm_learns_a_pair():
    """Neither word tells by itself; the two together do."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([*([1] if a else []), *([2] if b else []), *(10 + rng.integers(0, 50, 4))], np.int64))
        rows[-1] = np.unique(rows[-1])
        y.append(float(a and b))
    fm = toxicity.train_fm(rows, np.array(y), np.ones(len(y)), epochs=10)
    fm._known = {"p": (fm._row[1],), "q": (fm._row[2],)}
    both, one, other = fm.score("p q"), fm.score("p"), fm.score("q")
    assert both > 0.5 > max(one, other)
    assert any(np.abs(v).max() > 0.02 for v in fm.factors.values())


def test_toxicity_tables(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS["yy"].split()) for _ in range(40)) + (" idiot scum" if i % 9 == 0 else "")) for i in range(900)] + [(2000, None), (2001, ""), (2002, "idiot scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(900)] + [(0, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, crc_part(5) != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 903
    assert all(r["predicted"] == (r["doc_id"] % 9 == 0) for i, r in got.items() if i < 900)
    assert got[2002]["predicted"] == 1 and got[2000]["predicted"] == 0 and got[2000]["score"] == got[2001]["score"]
    assert toxicity.train(docs, labels.filter("false"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def edit_distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for ch in t:
        before, row[0] = row[:], 0
        for i, c in enumerate(p, 1):
            row[i] = min(before[i] + 1, row[i - 1] + 1, before[i - 1] + (c != ch))
        best = min(best, row[-1])
    return best


def test_myers():
    rng = random.Random(6)
    for _ in range(150):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (80, 120))
        assert decontam.Myers(p).best(t)[0] == edit_distance(p, t)


def test_decontamination(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice("la ti mo ren sta ho vi ku ber ne sol dra".split()) + str(rng.randint(0, 99)) for _ in range(n))
    items = {k: prose(30) for k in range(12)} | {50: "ab", 51: "", 52: None, 53: "!!", 54: "short item here"}
    docs = {}
    for i in range(60):
        t = items[i % 12]
        cut = list(t)
        for _ in range(i // 12 * 3):
            cut[rng.randrange(len(cut))] = rng.choice("abcx ")
        docs[i] = f"{prose(40)}. {''.join(cut).upper()}! {prose(20)}"
    docs |= {100: None, 101: "", 102: "ab", 103: "cab abc", 104: "x ab y", 105: items[3], 106: f"Short, item; here {items[1]} {items[2]}"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_items(d, b).collect()}
    wanted = {}
    for i, t in docs.items():
        n = decontam.normal(t)
        for j, item in items.items():
            p = decontam.normal(item)
            if not p:
                continue
            k = int(len(p) * 0.05)
            if k == 0:
                if f" {p} " in f" {n} ":
                    wanted[i, j] = 0
            elif (x := edit_distance(p, n)) <= k:
                wanted[i, j] = x
    assert got == wanted
    assert len({x for x in got.values()}) > 3
    assert decontam.find_items(d.filter("false"), b).count() == 0
    assert decontam.find_items(d, b.filter("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    b = spark.createDataFrame([(k, f"item number {k} with words of its own {k * 7919}") for k in range(20)], "item_id long, text string")
    d = spark.createDataFrame([(k, f"before item number {k} with words of its own {k * 7919} after") for k in range(20)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_items(d, b).filter("distance = 0").collect()} == {(k, k) for k in range(20)}


def test_licenses(spark, docs, empty):
    rng = random.Random(8)
    rows = {i: f"{'word ' * rng.randint(0, 40)}{t} {'more ' * rng.randint(0, 9)}" for i, t in enumerate(licenses.TEMPLATES.values())}
    rows |= {100: None, 101: "", 102: "licensed", 103: "Released under the BSD License.", 104: "license " * 20_000}
    cut = licenses.TEMPLATES["BSD"].split()
    rows[105] = " ".join(["x", *cut[:3], "uh", *cut[3:], "y"])
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    sets = {k: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", v.lower())] for i in range(len(w) - 4)} for k, v in licenses.TEMPLATES.items()}
    wanted = set()
    for i, t in rows.items():
        w = re.findall(r"\w+", (t or "").lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        wanted |= {(i, k) for k, s in sets.items() if len(s & own) >= 0.8 * len(s)}
    got = licenses.find_licenses(d).collect()
    assert {(r["doc_id"], r["license_id"]) for r in got} == wanted
    for r in got:
        if r["doc_id"] == 0:
            w = re.findall(r"\w+", rows[0].lower())
            assert w[r["start_word"] : r["end_word"]] == "released under the mit license".split()
    assert licenses.find_licenses(docs).count() == 0 and licenses.find_licenses(empty).count() == 0


def test_short_notices(spark):
    long = licenses.TEMPLATES["All-rights-reserved"]
    rows = {0: "All rights reserved.", 1: f"{'word ' * 30}\nALL  rights,reserved", 2: "x All rights reserved. Released under the MIT License.", 3: "all rights unreserved", 4: "overall rights reserved", 5: "all rights\tare reserved", 6: f"a {long} b", 7: None, 8: "all rights reserved " * 3}
    d = spark.createDataFrame([*rows.items(), (0, rows[0])], "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.find_licenses(d).collect())
    name = "All-rights-reserved"
    assert got == [(0, name, 1.0, 0, 3), (0, name, 1.0, 0, 3), (1, name, 1.0, 30, 33), (2, name, 1.0, 1, 4), (2, "MIT", 1.0, 4, 9), (6, name, 1.0, 1, 14), (8, name, 1.0, 0, 3)]
    own = licenses.find_licenses(d, {"short": "rights are", "none": "!"}).collect()
    assert [tuple(r) for r in own] == [(5, "short", 1.0, 1, 3)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0 if d else False
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_personal_data(spark, docs, empty):
    rng = random.Random(9)
    bits = ["a@b.c", "x@y", "+e@f.g", "1.2.3.4", ".5", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+49 30 ", "1234567", " ", "  ", "😀", "é", "-", ".", ",", "word", "12", "@", "password=abcd1234efgh5678", 'token = "0641917ea4e9feb9cda83477b57ac265"', "Dr. John Smith"]
    rows = {i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for i in range(400)}
    rows |= {900: None, 901: "", 902: "1" * 20_000, 903: "a." * 3_000 + "@"}
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.summary(pii.find_pii(d)).collect()}
    assert len(got) == len(rows)
    kinds = set()
    for i, t in rows.items():
        found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if fits(k, m.group()))
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in found) for k in BASE]
        spans = [s for s in got[i]["spans"].split(",") if s]
        assert set(joined.split(",")) - {""} <= set(spans)
        kinds |= {s.split(":")[0] for s in spans}
    assert "secret" in kinds
    plain = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find_pii(docs)).collect()}
    assert set(plain.values()) == {""}
    assert pii.find_pii(empty).count() == 0


def test_em_tells_labelers_apart():
    """Two labelers that agree outweigh one that votes at random."""
    rng = random.Random(10)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.3
        say = lambda right: (1 if true else -1) if rng.random() < right else (-1 if true else 1)
        votes = (say(0.95), say(0.95), say(0.5))
        counts[votes] = counts.get(votes, 0) + 1
    posterior = pii.estimate(counts)
    assert posterior[1, 1, -1] > 0.9 and posterior[-1, -1, 1] < 0.1
    assert pii.estimate({}) == {}


def test_any_ids_repeated_rows_and_clashing_columns(spark, texts):
    """String ids, a repeated row, nulls and columns with the operators' own names."""
    from quire.llm import decontam, jaccard_join, langid, toxicity

    rows = [(f"d{i}", t, "xx" if i % 2 else "yy", i, t, t) for i, t in texts.items()]
    rows += [rows[3], (None, texts[3], None, None, None, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, label long, used string, tf string").repartition(3)
    model = langid.train(docs, F.lit(True))
    assert langid.predict(docs, model).count() == len(rows)
    assert langid.train(docs.filter("false"), F.lit(True)).labels == []
    labels = docs.select("doc_id", (F.col("label") % 2).cast("int").alias("toxic"))
    scored = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True)))
    assert scored.count() == len(rows) and scored.filter("score < 0 or score > 1").count() == 0
    items = spark.createDataFrame([("q", texts[4]), (None, "x"), ("e", None)], "item_id string, text string")
    assert {r["doc_id"] for r in decontam.find_items(docs, items).collect()} >= {"d4"}
    joined = jaccard_join.jaccard_join(docs).collect()
    assert len(joined) == len(rows)
    assert {r["n_links"] for r in joined if r["doc_id"] is None} == {0}
    assert next(r for r in joined if r["doc_id"] == "d3")["n_links"] >= 1


def test_language_model_by_hand(spark, languages):
    """Document frequencies, TF-IDF, the FTRL step and its penalties, number by number."""
    from math import exp, log, log1p, sqrt

    from quire.llm import langid

    texts = ["der die das", "the of and", "le la les", "die die nicht", "to in is the", "et des une la", None, "123"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    df, total = langid.document_frequencies(docs)
    sets = [set(langid.grams(t).tolist()) for t in texts if t and t != "123"]
    assert total == len(sets) and {b: int(df[b]) for b in np.flatnonzero(df)} == {b: sum(b in s for s in sets) for b in set().union(*sets)}
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    rows = [langid.features(t) for t in texts[:6]]
    for t, (used, tf) in zip(texts, rows, strict=False):
        got = langid.grams(t).tolist()
        assert {int(b): round(float(v), 5) for b, v in zip(used, tf, strict=True)} == {b: round(log1p(got.count(b)), 5) for b in set(got)}
    y, l1, l2 = np.array([0, 1, 2, 0, 1, 2]), 0.01, 0.1
    model = langid.train_ftrl(rows, y, ["x", "y", "z"], idf, l1=l1, l2=l2, epochs=2, seed=3)
    z, n, order = {}, {}, np.random.default_rng(3)

    def weight(b, k):
        v = z.get((b, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - (l1 if v > 0 else -l1)) / (1 + sqrt(n.get((b, k), 0.0)) + l2)

    for _ in range(2):
        for i in order.permutation(6):
            x = {int(b): float(v) * float(idf[b]) for b, v in zip(*rows[i], strict=True)}
            size = sqrt(sum(v * v for v in x.values()))
            x = {b: v / size for b, v in x.items()}
            w = {(b, k): weight(b, k) for b in x for k in range(3)}
            e = [exp(sum(v * w[b, k] for b, v in x.items())) for k in range(3)]
            for (b, k), old in w.items():
                g = x[b] * (e[k] / sum(e) - (k == y[i]))
                more = n.get((b, k), 0.0) + g * g
                z[b, k] = z.get((b, k), 0.0) + g - (sqrt(more) - sqrt(n.get((b, k), 0.0))) * old
                n[b, k] = more
    wanted = np.zeros_like(model.weights)
    for b, k in z:
        wanted[b, k] = weight(b, k)
    assert np.abs(model.weights - wanted).max() < 1e-4
    assert (model.weights == 0).sum() > (model.weights != 0).sum()
    used, tf = rows[0]
    x = [float(v) * (log((1 + total) / (1 + int(df[b]))) + 1) for b, v in zip(used, tf, strict=True)]
    by_hand = sum(v / sqrt(sum(a * a for a in x)) * model.weights[b] for b, v in zip(used, x, strict=True))
    assert np.abs(model.logits(used, tf) - by_hand).max() < 1e-4
