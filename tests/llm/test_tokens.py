"""Token counts and BPE against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pytest

from quire.llm import bpe, token_counts
from quire.llm.queries import tokenizer_path

FUZZ = ["'s", "'re", "'r", "'v", "'ll", "'l", "'", " ", "  ", "\n", "\t", "　", "a", "B", "é", "中", "1", "²", "!", "...", "<|endoftext|>", "<|startoftext|>", "ſ", "\u0085", "\x1c", "İ", "Σ", "ΑΣ ", "don't", "​", "😀", "՘", "Ᲊ"]


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(FUZZ) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_counts_equal_the_library(texts):
    every = [t or "" for t in texts.values()] + fuzz(3000, 1)
    mine = token_counts.TokenCounter(tokenizer_path("byte_bpe_50k.json"))(every)
    assert mine.tolist() == [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(every, add_special_tokens=False)]


def test_scan_equals_sequential_run():
    step, emit = token_counts.compile_splitter()
    classes = np.random.default_rng(0).integers(0, 12, 5000).astype(np.uint8)
    state, cuts = 0, np.zeros(5001, bool)
    for i, c in enumerate(classes):
        out = emit[c * 13 + state]
        cuts[i] |= bool(out & 1)
        if i:
            cuts[i - 1] |= bool(out & 2)
        state = step[c * 13 + state]
    assert (token_counts.find_cuts(classes, step, emit) == cuts[:5000]).all()


def test_table_of_counts(docs, empty, texts):
    rows = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    tok = library("byte_bpe_50k.json")
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_bpe_equals_the_library(texts):
    mine, tok = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    for t in [*(t or "" for t in texts.values()), *fuzz(1500, 2), "ab" * 900]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.encode_bytes(t)[1] == tok.decode(ids, skip_special_tokens=False)


def test_table_of_codes(spark, docs, empty, texts):
    path = tokenizer_path("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in bpe.encode_texts(docs, path).collect()}
    digests = {r["doc_id"]: r for r in bpe.encode_digests(docs, path).collect()}
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(bpe.encode_texts(docs, path), path).collect()}
    for i, r in got.items():
        assert back[i] == r["decoded"]
        assert digests[i]["n_tokens"] == len(r["ids"])
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    assert got[200]["ids"] == [] and got[200]["decoded"] == ""
    assert bpe.encode_digests(empty, path).count() == 0
    assert bpe.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first()["decoded"] == ""


@pytest.mark.parametrize("text", ["a" * 4000, "中" * 900, "!" * 2001])
def test_long_words(text):
    mine = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json"))
    assert mine.encode(text) == library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids
    count = token_counts.TokenCounter(tokenizer_path("byte_bpe_50k.json"))([text])
    assert count[0] == len(library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)


def test_words_met_again_stay_when_the_table_is_full(monkeypatch):
    mine = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json"), limit=60)
    asked, encode_word = [], mine.encode_word
    monkeypatch.setattr(mine, "encode_word", lambda word: asked.append(word) or encode_word(word))
    text = " ".join(f"again {w}" for w in fuzz(40, 8) + ["abc", "def", "İx", "a\x1cb", "\x0b"] * 3)
    assert mine.encode(text) == library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids
    assert asked.count("again") == 1


def odd_words(n, seed, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñ中한") for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_new_words_are_merged_side_by_side(monkeypatch):
    mine, tok = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json"), limit=500), library("word_bpe_49k.json")
    alone, merge, encode_word = [], mine.merge, mine.encode_word
    monkeypatch.setattr(mine, "merge", lambda parts: alone.append(parts) or merge(parts))
    monkeypatch.setattr(mine, "encode_word", lambda word: alone.append(word) or encode_word(word))
    monkeypatch.setattr(bpe, "GROUP", 20_000)
    words = odd_words(6000, 9)
    every = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + fuzz(500, 10) + [" ".join(odd_words(5, 11, 200) + words[:900])]
    got = list(mine.encode_all(every))
    assert len(alone) < 600  # those longer than 64, and of few new words
    for t, (ids, decoded) in zip(every, got, strict=True):
        told = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == told
        assert decoded == tok.decode(told, skip_special_tokens=False)


def test_many_new_words_of_a_text_are_not_encoded_one_by_one(monkeypatch):
    mine = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json"))
    alone, encode_word = [], mine.encode_word
    monkeypatch.setattr(mine, "encode_word", lambda word: alone.append(word) or encode_word(word))
    text = " ".join(odd_words(3000, 13))
    assert mine.encode(text) == library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids
    assert len(alone) < 300


def test_words_side_by_side_equal_words_alone_where_the_vocabulary_lacks_symbols(tmp_path):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for t in ("e", "q</w>", "th", "ing</w>", "er"):
        del spec["model"]["vocab"][t]
    path = tmp_path / "lacking.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    mine = bpe.ForcedBoundaryBPE(str(path))
    words = odd_words(1500, 12) + ["e", "q", "the", "thing", "eeee"] + ["the" * k for k in range(1, 80)]
    assert list(mine.told_all(words)) == [mine.told(w) for w in words]


def test_composed_texts_are_normalised_as_the_library_does():
    mine, tok = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    every = ["Ça Éte Ñu", "Étȩ", "ΑΣ ΣΑ", "İI ẞ ﬁ", "가각 가", "à̕b", "É\u0085x　y", "Å Å Ω", "_a_b__ É_"]
    for t, (ids, _) in zip(every, mine.encode_all(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert {"É", "Ñ"} <= mine.even and "Σ" not in mine.even
