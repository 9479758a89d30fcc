"""Rendering and writing of chapters, chunks and groups.

Files are rows (key, filename, content) first, so that they can be checked, joined and
zipped as tables; write_files puts them where they belong, each under a temporary name that
is then moved, so a task that runs twice leaves one file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.text import SPACE, strip
from quire.operators.parts import ordered_parts
from quire.operators.records import range_label
from quire.operators.scan import Ranges


def _joined(rows: DataFrame, part: Column, order: Sequence[str], key: str) -> DataFrame:
    """key, text: parts in order as one text that ends with one line end."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("part")))), lambda p: p["part"])
    whole = F.regexp_replace(F.array_join(parts, ""), rf"{SPACE}+\z", "")
    return rows.groupBy(key).agg(F.concat(whole, F.lit("\n")).alias("text"))


def _head(header: Column) -> Column:
    return F.when(F.length(F.coalesce(header, F.lit(""))) > 0, F.concat(header, F.lit("\n\n"))).otherwise("")


def _rendered(separator: str) -> Column:
    body = strip(F.coalesce("text", F.lit("")))
    return F.concat(_head(F.col("header")), F.when(F.length(body) > 0, F.concat(body, F.lit(separator))).otherwise(""))


def render(chapters: DataFrame, key: str = "source", separator: str = "\n\n\n") -> DataFrame:
    """key, text: chapters (number, source_line, header, text) as one text: header, blank line, text without white space at its ends, separator; a chapter without a text as its header only. The text of a key must fit in a row (render_parts has no such limit)."""
    return _joined(chapters, _rendered(separator), ["number", "source_line"], key)


def render_parts(chapters: DataFrame, key: str = "source", separator: str = "\n\n\n") -> DataFrame:
    """key, part, text: the same in parts of bounded size, for keys of any size."""
    return ordered_parts(chapters, [key], ["number", "source_line"], _rendered(separator), end="\n")


def merged(chapters: DataFrame, key: str = "source", separator: str = "\n\n\n", headers: bool = True) -> DataFrame:
    """key, part, text: chapters as they are, each followed by the separator, empty ones too; in parts of bounded size."""
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(separator))
    return ordered_parts(chapters, [key], ["number", "source_line"], F.concat(_head(F.col("header")), body) if headers else body, end="\n")


def chapter_text(header: Column, text: Column) -> Column:
    """One chapter: header, blank line, text, line end; what is empty is left out."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.concat(_head(header), F.when(F.length(body) > 0, F.concat(body, F.lit("\n"))).otherwise(""))


def chunk_text(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: chunks (ord, title, text) joined, with a line of the title where it changes."""
    change = F.col("title") != F.coalesce(F.lag("title").over(W.partitionBy(key).orderBy("ord")), F.lit(""))
    part = F.concat(F.when(change, F.concat(F.lit("=== "), "title", F.lit(" ===\n\n"))).otherwise(""), "text")
    parts = F.array_sort(F.collect_list(F.struct("ord", "part")))
    return chunks.withColumn("part", part).groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("text"))


def chunk_json(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: an object with counts and the chunks in order."""
    items = F.array_sort(F.collect_list(F.struct("ord", "title", "text")))
    body = F.struct(F.count(F.lit(1)).alias("chunks"), F.countDistinct("title").alias("titles"), F.sum(F.length("text")).alias("characters"), items.alias("items"))
    return chunks.groupBy(key).agg(body.alias("body")).select(key, F.to_json("body").alias("json"))


def _lists(rows: DataFrame, name: str, order: Sequence[str], key: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias(name))


def detailed_json(texts: DataFrame, chapters: DataFrame, chunks: DataFrame, diagnostics: DataFrame | None = None, sources: DataFrame | None = None, key: str = "source") -> DataFrame:
    """key, json: text, chapters (by number, source_line), chunks (by ord), summary, and on demand diagnostics with counts by severity, and sources (by ord). Parts that a key lacks are empty lists."""
    out = texts.select(key, "text").join(_lists(chapters, "chapters", ["number", "source_line"], key), key, "left").join(_lists(chunks, "chunks", ["ord"], key), key, "left")
    size = F.transform(F.coalesce("chunks", F.array()), lambda c: F.length(c["text"]))
    n = F.size(size)
    total = F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x)
    summary = F.struct(F.length("text").alias("characters"), F.size(F.coalesce("chapters", F.array())).alias("chapter_count"), n.alias("chunk_count"), F.coalesce(F.array_min(size), F.lit(0)).alias("chunk_min"), F.coalesce(F.array_max(size), F.lit(0)).alias("chunk_max"), F.when(n > 0, F.floor(total / n)).otherwise(0).alias("chunk_avg"))
    parts = ["text", F.coalesce("chapters", F.array()).alias("chapters"), F.coalesce("chunks", F.array()).alias("chunks"), summary.alias("summary")]
    if diagnostics is not None:
        out = out.join(_lists(diagnostics, "diagnostics", ["stage", "severity", "code"], key), key, "left")
        every = F.coalesce("diagnostics", F.array())
        level = lambda s: F.size(F.filter(every, lambda d: d["severity"] == s))
        parts += [every.alias("diagnostics"), F.struct(F.size(every).alias("total"), level("error").alias("errors"), level("warning").alias("warnings"), level("info").alias("info")).alias("diagnostic_summary")]
    if sources is not None:
        out = out.join(_lists(sources, "sources", ["ord"], key), key, "left")
        parts.append(F.coalesce("sources", F.array()).alias("sources"))
    return out.select(key, F.to_json(F.struct(*parts)).alias("json"))


def range_manifest(chunks: DataFrame, size: int, key: str = "source") -> DataFrame:
    """key, range_start, range_end, chunks, chapters, characters by ranges of chapter numbers; empty ranges have no row."""
    start = F.floor((F.col("number") - 1) / size) * size + 1
    return chunks.withColumn("range_start", start).groupBy(key, "range_start").agg((F.first("range_start") + size - 1).alias("range_end"), F.count(F.lit(1)).alias("chunks"), F.countDistinct("number").alias("chapters"), F.sum(F.length("text")).alias("characters"))


def range_files(chunks: DataFrame, ranges: Sequence[tuple[int, int]], *, form: str = "json", folders: bool = False, manifest: bool = True, key: str = "source") -> DataFrame:
    """key, filename, part, text: a file for each range of chapter numbers that has chunks (number, ord, title, text), and manifest.json, in parts of bounded size.

    Ranges may overlap; index is a range's place in the list, those without chunks leave gaps.
    """
    listed = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for i, (a, b) in enumerate(ranges, 1)))
    own = chunks.withColumn("r", F.explode(F.filter(listed, lambda r: F.col("number").between(r["low"], r["high"])))).select(key, "r.index", range_label(F.col("r.low"), F.col("r.high")).alias("range"), "number", "ord", "title", "text")
    name = F.concat(F.when(F.lit(folders), F.concat(F.lit("range_"), F.lpad(F.col("index").cast("string"), 3, "0"), F.lit("/"))).otherwise(""), F.col("range"), F.lit(f".{form}"))
    own = own.withColumn("filename", name)
    counts = (F.count(F.lit(1)).alias("chunks"), F.countDistinct("number").alias("chapters"), F.sum(F.length("text")).alias("characters"))
    files = own.groupBy(key, "index", "range", "filename").agg(*counts)
    place = [key, "index", "range", "filename"]
    told = Ranges(own, place, ["number", "ord"]).number("_n").before("_number", F.col("number")).rows()
    if form == "json":
        told = told.join(files.select(key, "index", "chunks", "chapters"), [key, "index"])
        head = F.concat(F.lit('{"range":'), _quoted("range"), F.lit(',"chunks":['))
        tail = F.concat(F.lit('],"chunk_count":'), "chunks", F.lit(',"chapter_count":'), "chapters", F.lit("}"))
        one = F.to_json(F.struct("number", "ord", "title", "text"))
        piece = F.concat(F.when(F.col("_n") == 1, head).otherwise(","), one, F.when(F.col("_n") == F.col("chunks"), tail).otherwise(""))
        made = ordered_parts(told, place, ["_n"], piece)
    else:
        first = ~F.col("number").eqNullSafe(F.col("_number"))
        head = F.when(first, F.concat(F.lit("=== "), F.coalesce("title", F.concat(F.lit("Chương "), F.col("number").cast("string"))), F.lit(" ===\n\n"))).otherwise("")
        gap = F.when(first & (F.col("_n") > 1), "\n\n").otherwise("")
        made = ordered_parts(told, place, ["_n"], F.concat(gap, head, "text", F.lit("\n\n")), end="\n")
    out = made.select(key, "filename", "part", "text")
    if manifest:
        rows = F.array_sort(F.collect_list(F.struct("index", "range", "filename", "chunks", "chapters", "characters")))  # a row a range
        lists = files.groupBy(key).agg(F.to_json(F.struct(rows.alias("ranges"), F.lit(len(ranges)).alias("total_ranges"))).alias("text"))
        out = out.unionByName(lists.select(key, F.lit("manifest.json").alias("filename"), F.lit(0).cast("long").alias("part"), "text"))
    return out


def _quoted(column: str) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("x"))), r"(?s)\A\{\"x\":(.*)\}\z", 1)


def whole_files(parts: DataFrame, key: str = "source") -> DataFrame:
    """key, filename, content of parts (key, filename, part, text) whose files fit in a row each."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    return parts.groupBy(key, "filename").agg(F.array_join(texts, "").alias("content"))


def group_files(groups: DataFrame, key: str = "source") -> DataFrame:
    """key, filename, content: final.txt and final.json of each group (name, ord, group_id, label, range_label, start, end, source_sha256, text_sha256, slice) in a folder of its name, and chapter_groups.json."""
    facts = ("group_id", "ord", "label", "range_label", "start", "end", "source_sha256", "text_sha256")
    one = F.to_json(F.struct(F.lit(2).alias("schema_version"), F.col(key).alias("title"), *facts, F.col("slice").alias("text")))
    both = F.array(F.struct(F.concat("name", F.lit("/final.txt")).alias("filename"), F.col("slice").alias("content")), F.struct(F.concat("name", F.lit("/final.json")).alias("filename"), one.alias("content")))
    files = groups.select(key, F.inline(both))
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", *(f for f in facts if f != "ord"), F.sha2(one, 256).alias("json_sha256"))))
    listed = groups.groupBy(key).agg(F.to_json(F.struct(F.lit(2).alias("schema_version"), F.col(key).alias("title"), F.first("source_sha256").alias("source_sha256"), rows.alias("groups"))).alias("content"))
    return files.unionByName(listed.select(key, F.lit("chapter_groups.json").alias("filename"), "content"))


def timeline_script(pages: DataFrame, key: str) -> DataFrame:
    """key, script, json: the script that shows the pages (ord, file, start_us, end_us) one after the other, and their list.

    The last page is named once more as the end, a millisecond of its time taken off. A page
    whose time isn't positive makes the script null.
    """
    rows = F.array_sort(F.collect_list(F.struct("ord", "file", "start_us", "end_us")))
    made = pages.groupBy(key).agg(rows.alias("p"))
    quoted = lambda f: F.concat(F.lit("file '"), F.replace(f, F.lit("'"), F.lit("'\\''")), F.lit("'\n"))
    span = lambda p, i: p["end_us"] - p["start_us"] - F.when(i == F.size("p") - 1, 1000).otherwise(0)
    line = lambda p, i: F.concat(quoted(p["file"]), F.lit("duration "), F.format_string("%.9f", span(p, i).cast("double") / 1_000_000), F.lit("\n"))
    fine = F.forall(F.transform("p", span), lambda d: d > 0)
    script = F.concat(F.lit("ffconcat version 1.0\n"), F.array_join(F.transform("p", line), ""), quoted(F.element_at("p", -1)["file"]))
    return made.select(key, F.when(fine, script).alias("script"), F.to_json(F.struct(F.col("p").alias("pages"))).alias("json"))


def archives(files: DataFrame, key: str = "source") -> DataFrame:
    """key, archive: the files (filename, content) of each key as a ZIP archive, in order of their names; the same files give the same bytes. The files of one key must fit in a task."""
    kind = files.schema[key].dataType.simpleString()

    def build(group: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(group["filename"], group["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), content.encode())
        return pd.DataFrame({key: group[key].iloc[:1], "archive": [held.getvalue()]})

    return files.select(key, "filename", "content").groupBy(key).applyInPandas(build, f"{key} {kind}, archive binary")


def write_files(files: DataFrame, folder: str, encoding: str = "utf-8") -> DataFrame:
    """Write files (filename, content: text or binary) into a folder that all executors see; filename, bytes, sha256 of what was written.

    Each is written under a temporary name and moved, so a repeated task leaves one whole file. Runs when the result is read.
    """
    text = files.schema["content"].dataType.simpleString() == "string"

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256
        from uuid import uuid4

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            names, sizes, digests = batch.column(0).to_pylist(), [], []
            for name, content in zip(names, batch.column(1), strict=True):
                data = content.as_py().encode(encoding) if text else content.as_py()
                target = f"{root}/{name}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, target)
                sizes.append(len(data))
                digests.append(sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["filename", "bytes", "sha256"])

    return files.select("filename", "content").mapInArrow(run, "filename string, bytes long, sha256 string")


def write_texts(rendered: DataFrame, path: str) -> None:
    """One text file a row, in folders by key, through Spark's commit protocol."""
    name = next(c for c in rendered.columns if c != "text")
    rendered.select(name, "text").write.mode("overwrite").option("lineSep", "\n").partitionBy(name).text(path)


def write_jsons(rows: DataFrame, path: str) -> None:
    """Rows of key and json as text files, in folders by key."""
    name = next(c for c in rows.columns if c != "json")
    rows.select(name, F.col("json").alias("value")).write.mode("overwrite").partitionBy(name).text(path)
