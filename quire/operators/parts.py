"""Long texts as ordered parts: rows (key, part, text) of bounded size, whose texts joined in order are the whole.

A key's pieces are dealt by ranges of their order, their lengths are added up by a prefix scan,
and all pieces that begin within the same stretch of characters are one part. So a part holds at
most about that many characters and one piece, however long the whole is. What needs the whole
in order (digests, files) reads the parts as a stream: a task holds a batch and a state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import SPACE
from quire.operators.scan import Ranges
from quire.session import in_batches

#: Characters of a part.
PART_CHARS = 8 << 20


def ordered_parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column, *, between: str = "", end: str | None = None, size: int = PART_CHARS) -> DataFrame:
    """keys, part (from 0), text: pieces in order, with between before each but the first; nulls count as no piece.

    end: the whole loses the white space at its end and gets this instead; parts that are
    nothing but white space at the end are left out. A key without a piece has no part. Pieces
    should differ in their order; equal ones follow one another by their text.
    """
    keys, order = list(keys), list(order)
    own = rows.select(*keys, *order, piece.alias("_piece")).filter("_piece is not null")
    scan = Ranges(own, keys, [*order, "_piece"]).number("_nth")
    text = F.when(F.col("_nth") > 1, F.concat(F.lit(between), F.col("_piece"))).otherwise(F.col("_piece")) if between else F.col("_piece")
    if end is None:
        told = scan.running("_upto", F.length(text).cast("long")).rows().withColumn("_text", text)
    else:
        filled = F.col("_piece").rlike(rf"(?!{SPACE})[\s\S]")
        told = scan.running("_upto", F.length(text).cast("long")).running("_filled", filled.cast("long")).rows()
        totals = told.groupBy(*keys).agg(F.max("_filled").alias("_every"))
        told = _with(told, totals, keys)
        last = F.when(F.col("_every") > 0, filled & (F.col("_filled") == F.col("_every"))).otherwise(F.col("_nth") == 1)
        closed = F.concat(F.regexp_replace(text, rf"{SPACE}+\z", ""), F.lit(end))
        told = told.withColumn("_text", F.when(last, closed).when(F.col("_filled") < F.col("_every"), text)).filter("_text is not null")
    told = told.withColumn("part", F.floor(F.greatest(F.col("_upto") - 1, F.lit(0)) / size).cast("long"))
    sorted_texts = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_text"))), lambda p: p["_text"])
    return told.groupBy(*keys, "part").agg(F.array_join(sorted_texts, "").alias("text"))


def _with(rows: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows joined to a row of more a key; nulls are equal."""
    named = more.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in more.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same).drop(*(f"_k{i}" for i in range(len(keys))))


def digests(parts: DataFrame, keys: Sequence[str], order: Sequence[str] = ("part",), *, text_col: str = "text", between: str = "") -> DataFrame:
    """keys, chars, sha256: of all texts of a key in order, with between between them; read as a stream by key, a batch at a time."""
    keys = list(keys)
    rows = parts.select(*keys, *order, F.col(text_col).alias("_text"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        now, state, chars = None, None, 0
        schema = None
        gap = between.encode()

        def out(done: list[tuple]):
            columns = list(zip(*done, strict=True))
            fields = [*(schema.field(i).type for i in range(n)), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], [*keys, "chars", "sha256"])

        for batch in batches:
            schema = batch.schema
            done = []
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))
            for key, text in zip(ids, batch.column(len(batch.schema) - 1), strict=True):
                data = text.as_py() or ""
                if state is None or key != now:
                    if state is not None:
                        done.append((*now, chars, state.hexdigest()))
                    now, state, chars = key, sha256(), 0
                else:
                    state.update(gap)
                    chars += len(between)
                state.update(data.encode())
                chars += len(data)
            if done:
                yield out(done)
        if state is not None:
            yield out([(*now, chars, state.hexdigest())])

    return in_batches(dealt).mapInArrow(run, f"{kinds}, chars long, sha256 string")


def tree_digests(parts: DataFrame, keys: Sequence[str], fan: int = 1024) -> DataFrame:
    """keys, parts, tree_sha256: a digest of a key's parts by levels, fan digests to a node, so that no task reads more than fan of them at once.

    It tells equal texts in equal parts, and can be renewed from the digests of the parts that changed.
    """
    keys = list(keys)
    level = parts.select(*keys, F.col("part").alias("at"), F.sha2("text", 256).alias("sha"))
    count = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.max("part").alias("_top"))
    top = count.agg(F.max("_top")).first()[0]
    while top is not None:
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha"))), lambda x: x["sha"])
        level = level.groupBy(*keys, F.floor(F.col("at") / fan).alias("node")).agg(F.sha2(F.array_join(nodes, "\n"), 256).alias("sha")).withColumnRenamed("node", "at")
        if top < fan:
            break
        top //= fan
    return _with(level.select(*keys, F.col("sha").alias("tree_sha256")), count.drop("_top"), keys).select(*keys, "parts", "tree_sha256")


def write_parts(parts: DataFrame, folder: str, encoding: str = "utf-8") -> DataFrame:
    """Write rows (filename, part, text) as files in a folder that all executors see; filename, bytes, sha256 of each.

    A file's parts go through one task one after the other, into a file of another name that is
    moved when it is whole, so a repeated task leaves one whole file. Runs when the result is read.
    """
    rows = parts.select("filename", "part", "text").repartition("filename").sortWithinPartitions("filename", "part")

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256
        from uuid import uuid4

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        now, out, state, size, place = None, None, None, 0, ""

        def close():
            out.close()
            store.move(place, f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([size], pa.int64()), pa.array([state.hexdigest()])], ["filename", "bytes", "sha256"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if name != now:
                    if out is not None:
                        yield close()
                    now, state, size = name, sha256(), 0
                    place = f"{root}/{name}.{uuid4().hex}.part"
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(place)
                data = (text.as_py() or "").encode(encoding)
                out.write(data)
                state.update(data)
                size += len(data)
        if out is not None:
            yield close()

    return in_batches(rows).mapInArrow(run, "filename string, bytes long, sha256 string")
