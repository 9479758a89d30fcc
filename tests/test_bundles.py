"""Bundles of documents, and what is told of them when something changed."""

import hashlib
import json

from pyspark.sql import functions as F

from quire.operators import detect, parts
from quire.sources import bundles


def test_bundles_vouch_for_each_other(spark, tmp_path):
    novel = "lời tựa\n" + "\n".join(f"Chương {n}: Mở\n“Anh đi.. đâu?” , cô hỏi. " + f"Câu số {n} dài vừa đủ. " * 60 for n in range(1, 5))
    texts = spark.createDataFrame([("a", novel, 1), ("b", "Không có chương nào.", 2), ("c", "!!!", 1)], "source string, text string, revision long")
    made = bundles.bundles(texts, detect.heading_spans(texts))
    written = parts.write_parts(made.files, str(tmp_path))
    written = spark.createDataFrame(written.collect(), written.schema)
    assert sorted(r.filename for r in written.collect()) == ["a/chunks.json", "a/chunks.txt", "b/chunks.json", "b/chunks.txt"]
    facts = {r.source: r for r in made.facts.collect()}
    for key in "ab":
        text, data = (tmp_path / key / "chunks.txt").read_bytes(), json.loads((tmp_path / key / "chunks.json").read_text())
        assert hashlib.sha256(text).hexdigest() == data["cleaned_text_sha256"] == facts[key].text_sha256
        assert data["chunk_count"] == len(data["chunks"]) and [c["order"] for c in data["chunks"]] == list(range(1, len(data["chunks"]) + 1))
        assert data["chunks_sha256"] == hashlib.sha256("\n".join(hashlib.sha256(c["text"].encode()).hexdigest() for c in data["chunks"]).encode()).hexdigest()
        bare = lambda t: "".join(t.split())
        assert bare("".join(c["text"] for c in data["chunks"])) == bare(text.decode())
    now = made.facts.select("source", "revision", "text_sha256", "chunks_sha256")
    states = lambda n, w: {r.source: r.state for r in bundles.check_bundles(made.facts, n, w).collect()}
    assert states(now, written) == {"a": "current", "b": "current"}
    assert states(now.withColumn("revision", F.when(F.col("source") == "a", 9).otherwise(F.col("revision"))), written) == {"a": "stale", "b": "current"}
    assert states(now, written.filter("filename <> 'b/chunks.json'")) == {"a": "current", "b": "missing"}
    assert states(now, written.withColumn("sha256", F.when(F.col("filename") == "a/chunks.txt", "x").otherwise(F.col("sha256")))) == {"a": "modified", "b": "current"}
