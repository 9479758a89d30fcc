"""The pipeline's stages, each on its own input and against brute force."""

import random
import re
import sys
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, toxicity
from quire.llm.queries import crc_part, tokenizer_path
from quire.session import persist_table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, path long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A folder with labels and a benchmark, for documents of make()."""
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, int(i % 2 == 1)) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, "What is the name of the largest river that flows through the old town of Brana?"), (1, "Seven green frogs jumped over three very lazy dogs yesterday evening"), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["lake", "stone", "river", "paper", "window", "garden", "music", "table", "cloud", "story", "winter", "harbor"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    out = {i: prose(25) + (" you vile scum" if i % 2 else "") for i in range(240)}
    base = out[0].split()
    for k in range(240, 252):
        w = [*base, *prose(40).split()[:1]]
        w[k % 20] = "edit"
        out[k] = " ".join(w)
    long = prose(120).split()
    for k in range(252, 262):
        w = list(long)
        w[k - 252] = f"edit{k}"
        out[k] = " ".join(w)
    out |= {262: out[2].upper(), 263: out[2], 264: None, 265: "", 266: "   ", 267: "!", 268: "x" * 20_000, 269: None}
    item = "what is the name of the largest river that flows thru the old town of brana"
    out |= {270: f"{prose(10)} {item} {prose(5)}", 271: f"{prose(3)}. Seven green frogs, jumped over three very lazy dogs -- yesterday evening!", 272: prose(400) + " ✓ é"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 else "en", "s", None, t, i) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None, None, None)], SCHEMA).repartition(4)


def ids(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows.collect())


def kept(docs, gone):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in docs.collect() if r["doc_id"] not in gone)


def test_toxicity(spark, docs, texts, sf_dir):
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_part(5) != 0)
    terms = {i: {toxicity.bucket(x) for w in set(re.findall(r"\w+", (t or "").lower())) for x in toxicity.terms(w)} & set(model.weights) for i, t in texts.items()}
    gone = set()
    for i, own in terms.items():
        s = model.bias + sum(model.weights[b] for b in own) + sum(float(np.dot(model.factors[a], model.factors[b])) for a, b in combinations(sorted(own), 2))
        assert abs(model.score(texts[i]) - 1 / (1 + np.exp(-s))) < 1e-9
        if 1 / (1 + np.exp(-s)) >= 0.5:
            gone.add(i)
    assert gone == {i for i in range(240) if i % 2}
    out = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert out.columns == docs.columns and ids(out) == kept(docs, gone)


def test_copies(spark, docs, texts, sf_dir):
    norm = {i: "".join(c.lower() if c.isascii() else c for c in t or "") for i, t in texts.items()}
    last = {}
    for i, t in norm.items():
        last[t] = max(i, last.get(t, i))
    gone = {i for i, t in norm.items() if last[t] != i}
    assert {2, 262, 264, 265} <= gone
    assert ids(corpus_pipeline.drop_copies(spark, docs, sf_dir)) == kept(docs, gone)


def test_near_copies(spark, docs, texts, sf_dir):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[k:] for k in range(5))))
    least = {i: i for i in sets}
    for _ in range(4):
        for a, b in combinations(sets, 2):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    gone = {i for i in sets if least[i] != i}
    assert len(gone & set(range(252, 262))) == 9
    assert ids(corpus_pipeline.drop_near_copies(spark, docs, sf_dir)) == kept(docs, gone)


def distance(item, text):
    """Least edit distance of an item to any substring, by the table of the textbook."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for k, x in enumerate(item, 1):
            above, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, above + (x != c))
        best = min(best, row[-1])
    return best


def test_benchmark(spark, docs, texts, sf_dir):
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    some = {i: t for i, t in texts.items() if i >= 262 or i < 30}
    gone = {i for i, t in some.items() if any(x and distance(x, decontam.normal(t)[:2500]) <= decontam.budget(len(x), 0.05) for x in items)}
    assert gone == {270, 271}
    own = docs.filter(F.col("doc_id").isin(list(some)))
    assert ids(corpus_pipeline.drop_benchmark(spark, own, sf_dir)) == kept(own, gone)


def test_encoding(spark, docs, texts, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = corpus_pipeline.encode(spark, docs, sf_dir).collect()
    assert len(got) == docs.count()
    for r in got:
        wanted = library.encode("no id" if r["doc_id"] is None else texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == wanted and r["n_tokens"] == len(wanted)


@pytest.mark.parametrize("name", ["drop_toxic", "drop_copies", "drop_near_copies", "drop_benchmark", "encode"])
def test_empty(spark, docs, sf_dir, name):
    assert getattr(corpus_pipeline, name)(spark, docs.filter("false"), sf_dir).count() == 0


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {tuple(r) for r in docs.collect()}
        docs = persist_table(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert {tuple(r) for r in docs.collect()} <= before
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    with_llm = set(entry.queries())
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {q if q == "pipeline" else q.split("_")[0] + "_" for q in with_llm}
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not any(q.startswith("op1_") for q in entry.queries())
