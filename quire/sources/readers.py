"""Readers: text files, archives and nested JSON as tables.

Files are listed and read by Spark's binaryFile reader, so any store that Spark reads will
do and hidden files are passed over. Decoding and unzipping are small per-row helpers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import in_batches

# Suffixes and names that decide what is read, encodings in order, key names.
SUFFIXES = (".txt", ".text", ".md", ".log")
PASSED_OVER = ("readme", "metadata")
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "utf-32", "cp1258", "cp1252", "latin-1")
BYTE_ORDER_MARKS = {b"\xff\xfe\x00\x00": "utf-32", b"\x00\x00\xfe\xff": "utf-32", b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
CATEGORY_WEIGHTS = {"Co": 8, "Cn": 8, "Cs": 8, "Cc": 6}
SUSPICIOUS_LETTERS = "ÂÃâ€"
SUSPICIOUS_TOKENS = ("Ã", "á»", "áº", "Ä‘", "Ã¢", "Ã´")
MARK_BONUS = 0.5


def skip_reason(name: Column) -> Column:
    """Why an entry isn't read; null if it is."""
    low = F.lower(name)
    base = F.regexp_replace(low, "^.*/", "")
    return (
        F.when(low.endswith("/"), "directory")
        .when(low.startswith("__macosx/") | base.startswith("._"), "archive metadata")
        .when(base.startswith("."), "hidden")
        .when(F.regexp_replace(base, r"\.[^.]*$", "").isin(*PASSED_OVER), "readme or metadata")
        .when(~base.rlike(r"\.(?:txt|text|md|log)$"), "suffix")
    )


_weights = None


def _weight_table():
    """Weight of each code point in a decoded text, as an array."""
    global _weights
    if _weights is None:
        import unicodedata

        import numpy as np

        table = np.array([CATEGORY_WEIGHTS.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)], np.int64)
        table[[ord(c) for c in "\n\r\t"]] = 0
        table[[ord(c) for c in SUSPICIOUS_LETTERS]] = 1
        _weights = table
    return _weights


def penalty(text: str) -> float:
    """Signs of a wrong encoding in a thousand characters."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    signs = int(_weight_table()[points].sum()) + sum(map(text.count, SUSPICIOUS_TOKENS))
    return signs / max(1, len(text)) * 1000


@dataclass(frozen=True)
class Decoded:
    """A decoded text; uncertain: no encoding fitted, so characters may be wrong. passed_over: encodings tried in vain, sorted."""

    text: str
    encoding: str
    uncertain: bool = False
    passed_over: tuple[str, ...] = ()

    def note(self) -> str:
        """What a reader of the text should know."""
        notes = ["no encoding fits; read as latin-1, accents may be lost"] if self.uncertain else []
        if self.encoding == "cp1258":
            notes.append("read as Vietnamese cp1258")
        if self.passed_over:
            notes.append("passed over: " + ", ".join(self.passed_over))
        return "; ".join(notes) if self.text or self.uncertain else "empty file"


def decode(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> Decoded:
    """The encoding without decoding errors whose text has the least penalty; the earlier of equals. One that a byte order mark names comes first, with a bonus."""
    if not data:
        return Decoded("", "utf-8")
    marked = next((e for m, e in BYTE_ORDER_MARKS.items() if data.startswith(m)), None)
    found, over = [], set()
    for place, encoding in enumerate(dict.fromkeys((*((marked,) if marked else ()), *encodings))):
        try:
            text = data.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            text = "\ufffd"
        if "\ufffd" in text:
            over.add(encoding)
        else:
            found.append((penalty(text) - (MARK_BONUS if encoding == marked else 0), place, text, encoding))
    text, encoding = min(found)[2:] if found else (data.decode("latin-1"), "latin-1")
    return Decoded(text, encoding, not found, tuple(sorted(over)))


def had_mark(data: Column) -> Column:
    """Encoding that a file's byte order mark names; null without one."""
    head = F.hex(F.substring(data, 1, 4))
    out = F.lit(None).cast("string")
    for mark, encoding in reversed(BYTE_ORDER_MARKS.items()):
        out = F.when(head.startswith(mark.hex().upper()), encoding).otherwise(out)
    return out


def _below(path: str) -> str:
    """An expression for the files that a given path names or holds: whole parts of a path, with the wildcards that paths may have."""
    import re

    place = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", path).rstrip("/")
    marks = {"*": "[^/]*", "?": "[^/]", "[": "[", "]": "]", "{": "(?:", "}": ")", ",": "|" if "{" in place else ","}
    body = "".join(marks.get(c) or ("\\" + c if c in r"\.^$|()+-" else c) for c in place)
    begin = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" if place.startswith("/") else "(?:^|/)"
    return f"{begin}{body}(?:/|$)"


def read_texts(spark: SparkSession, path: str | list[str], include: list[str] | None = None, *, recursive: bool = False, sort: str = "natural") -> DataFrame:
    """path, name, text, encoding, uncertain, note, error, ord: text files and the text entries of ZIP archives in folders or files, to be ordered by ord.

    include: parts of which a name must have one, case aside. sort: natural, name, or selection
    (paths in the order given, files of a folder in natural order). Folders inside folders are
    read only if recursive. An unreadable archive gives a row with error file_unreadable, a path
    that isn't there one with path_missing. A file of no bytes gives no row.
    """
    import pandas as pd

    every = [path] if isinstance(path, str) else list(path)
    there, missing = [], []
    for one in every:
        target = spark._jvm.org.apache.hadoop.fs.Path(one)
        (there if target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) else missing).append(one)
    place = F.lit(len(every))
    for k, one in reversed(list(enumerate(every))):
        place = F.when(F.col("path").rlike(_below(one)), k).otherwise(place)
    if there:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(there).select("path", "content")
    else:
        files = spark.createDataFrame([], "path string, content binary")
    wanted = files.filter(F.lower("path").endswith(".zip") | skip_reason(F.col("path")).isNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        def told(data: bytes) -> tuple:
            d = decode(data)
            return d.text, d.encoding, d.uncertain, d.note()

        for batch in batches:
            rows = []
            for at, content in zip(batch["path"], batch["content"], strict=True):
                if not at.lower().endswith(".zip"):
                    rows.append((at, at.rsplit("/", 1)[-1], *told(bytes(content)), None))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        rows += [(at, info.filename, *told(z.read(info)), None) for info in z.infolist() if not info.is_dir()]
                except zipfile.BadZipFile:
                    rows.append((at, at.rsplit("/", 1)[-1], None, None, None, None, "file_unreadable"))
            yield pd.DataFrame(rows, columns=["path", "name", "text", "encoding", "uncertain", "note", "error"])

    from quire.functions.text import natural_key

    read = in_batches(wanted).mapInPandas(run, "path string, name string, text string, encoding string, uncertain boolean, note string, error string")
    read = read.filter(F.col("error").isNotNull() | skip_reason(F.col("name")).isNull())
    if include:
        test = F.lit(False)
        for part in include:
            test = test | F.contains(F.lower("name"), F.lit(part.lower()))
        read = read.filter(test)
    if missing:
        read = read.unionByName(spark.createDataFrame([(m, m.rsplit("/", 1)[-1], None, None, None, None, "path_missing") for m in missing], read.schema))
    if sort == "name":
        return read.withColumn("ord", F.concat_ws("/", F.lower("name"), "path"))
    if sort == "selection":
        return read.withColumn("ord", F.concat(F.lpad(place.cast("string"), 9, "0"), natural_key(F.concat_ws("/", "path", "name"))))
    return read.withColumn("ord", natural_key(F.concat_ws("/", "name", "path")))
