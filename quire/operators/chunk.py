"""Budget-bounded chunks of texts, their parts by chapter, and the proof that nothing is lost.

Chunks of one text depend on each other in order, texts don't: each text is planned in one
pass where it is read (quire.functions.boundaries), in time linear in its length, and
nothing is shuffled. Numbering and checks are windows and aggregations by key.

Defined results: null texts and texts without a letter or digit have no chunk. A text that
can't be cut (a token longer than the limit, say) has one row with error and no text, so
that it doesn't stop the others. Repeated rows give repeated chunks; empty tables none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.functions.boundaries import ABBREVIATIONS, CannotCut, half_split, plan_chunks, protected_spans, units
from quire.session import in_batches

LEAST, SOFT, MOST = 600, 700, 2000
#: Share of a page below which it counts as not filled.
FILLED = 0.55


def clamp(limit: int) -> int:
    """Limit within the sane range."""
    return max(LEAST, min(int(limit), MOST))


@dataclass(frozen=True)
class PageBudget:
    """A page of some lines of some columns; wide characters take two. Any object with lines_of and lines will do instead."""

    columns: int = 48
    lines: int = 14

    def lines_of(self, text: str) -> int:
        """Lines that a text takes, wrapped at spaces and, in longer words, anywhere."""
        import unicodedata

        used = 0
        for paragraph in text.split("\n"):
            used, at = used + 1, 0
            for word in paragraph.split():
                wide = len(word) if word.isascii() else sum((1 + (unicodedata.east_asian_width(c) in "WF")) * (not unicodedata.combining(c)) for c in word)
                if at and at + 1 + wide <= self.columns:
                    at += 1 + wide
                else:
                    used += (1 if at else 0) + max(0, wide - 1) // self.columns
                    at = (wide - 1) % self.columns + 1 if wide else 0
        return used

    def fits(self, text: str) -> bool:
        return self.lines_of(text) <= self.lines


def plan(texts: DataFrame, key: str = "doc_id", limit: int = SOFT, *, text_col: str = "text", budget: PageBudget | None = None, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """The columns of texts but for the text, with ord, text, chars, strategy, hard_split, reason, visible_lines and error of each chunk.

    visible_lines is null without a budget. key is only named for symmetry: every column is kept, but
    those of the names above, which are replaced.
    """
    kept = [f for f in texts.schema if f.name not in (text_col, *_MADE)]
    if key not in [f.name for f in kept]:
        raise ValueError(f"no column {key}")
    limit = clamp(limit)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            source, made = [], [[] for _ in _MADE]
            for row, value in enumerate(batch.column(batch.num_columns - 1)):
                text = value.as_py() or ""
                try:
                    chunks = plan_chunks(text, limit, MOST, fits=budget.fits if budget else None, abbreviations=abbreviations)
                    rows = [(k, piece, len(piece), strategy, hard, reason, budget.lines_of(piece) if budget else None, None) for k, (piece, strategy, hard, reason) in enumerate(chunks)]
                except CannotCut as error:
                    rows = [(0, None, None, None, None, None, None, str(error))]
                source += [row] * len(rows)
                for column, values in zip(made, zip(*rows, strict=True), strict=False):
                    column.extend(values)
            own = batch.select(range(batch.num_columns - 1)).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(made, _ARROW(pa), strict=True))], [*own.schema.names, *_MADE])

    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in _MADE.items())])
    return in_batches(texts.select(*(f.name for f in kept), F.col(text_col).alias("text"))).mapInArrow(run, schema)


_MADE = {"ord": T.LongType(), "text": T.StringType(), "chars": T.LongType(), "strategy": T.StringType(), "hard_split": T.BooleanType(), "reason": T.StringType(), "visible_lines": T.LongType(), "error": T.StringType()}
_ARROW = lambda pa: (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string())


def display_title(title: Column, header: Column, number: Column) -> Column:
    """Title of a chapter, else its header, else "Chương n"."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(header), F.lit("")), F.concat(F.lit("Chương "), number.cast("string")))


def plan_chapters(chapters: DataFrame, key: str = "source", limit: int = SOFT, *, with_header: bool = False, budget: PageBudget | None = None, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """key, number, source_line, chapter_title, ord, part, parts and the columns of plan, of chapters (key, number, source_line, header, title, text).

    No chunk crosses a chapter's end. with_header: a chapter's first chunk is its header.
    ord counts from 1 by key, over chapters by number and source_line; part within the chapter.
    """
    named = chapters.select(key, "number", "source_line", display_title(F.col("title"), F.col("header"), F.col("number")).alias("chapter_title"), "header", "text")
    made = plan(named, key, limit, budget=budget, abbreviations=abbreviations)
    if with_header:
        head = F.trim("header")
        told = F.when(F.length(head) > clamp(limit), "heading_exceeds_limit")
        first = named.filter(head.rlike(r"[\p{L}\p{N}]")).select(key, "number", "source_line", "chapter_title", "header", F.lit(-1).cast("long").alias("ord"), head.alias("text"), F.length(head).cast("long").alias("chars"), F.lit("paragraph").alias("strategy"), F.lit(False).alias("hard_split"), F.lit("chapter_heading").alias("reason"), F.lit(None).cast("long").alias("visible_lines"), told.alias("error"))
        made = made.unionByName(first)
    own = W.partitionBy(key, "number", "source_line")  # dealt and sorted as the order by key is, which is made first
    made = made.withColumn("_ord", F.row_number().over(W.partitionBy(key).orderBy("number", "source_line", "ord")).cast("long"))
    made = made.withColumn("part", F.row_number().over(own.orderBy("_ord")).cast("long")).withColumn("parts", F.count(F.lit(1)).over(own))
    return made.withColumn("ord", F.col("_ord")).drop("header", "_ord")


def chunk_diagnostics(chapters: DataFrame, chunks: DataFrame, key: str = "source", least: int = LEAST) -> DataFrame:
    """key, number, source_line, part, code: empty_chapter, hard_split_chunk, short_chunk (a chapter of one chunk below least) and cannot_chunk."""
    place = [key, "number", "source_line"]
    empty = chapters.select(*place).join(chunks.select(*place).distinct(), place, "left_anti").select(*place, F.lit(None).cast("long").alias("part"), F.lit("empty_chapter").alias("code"))
    codes = F.array_compact(F.array(F.when(F.col("hard_split"), "hard_split_chunk"), F.when((F.col("parts") == 1) & (F.col("chars") < least), "short_chunk"), F.when(F.col("error").isNotNull(), "cannot_chunk")))
    return chunks.select(*place, "part", F.explode(codes).alias("code")).unionByName(empty)


def fill_statistics(chunks: DataFrame, budget: PageBudget, keys: list[str]) -> DataFrame:
    """How pages are filled, by keys: limited_chunks, lines_max, fill_average, fill_min and fill_max, underfilled and final_underfilled.

    A text's last page and its heading may be short: they don't count in fill_min and underfilled.
    """
    fill = F.col("visible_lines") / budget.lines
    short = F.col("reason").isin("end_of_text", "chapter_heading")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return chunks.filter("visible_lines is not null").groupBy(*keys).agg(
        count(F.col("reason") == "next_unit_would_exceed_page_height").alias("limited_chunks"),
        F.max("visible_lines").alias("lines_max"),
        F.round(F.avg(fill), 4).alias("fill_average"),
        F.round(F.min(F.when(~short, fill)), 4).alias("fill_min"),
        F.round(F.max(fill), 4).alias("fill_max"),
        count(~short & (fill < FILLED)).alias("underfilled"),
        count((F.col("reason") == "end_of_text") & (fill < FILLED)).alias("final_underfilled"),
    )


def strategy_counts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks by the kind of place where they end."""
    return chunks.filter("error is null").groupBy(*keys, "strategy").agg(F.count(F.lit(1)).alias("n"))


def _pieces(texts: DataFrame, key: str, text_col: str, cut) -> DataFrame:
    """key, ord, unit, start: pieces of each text, with their offsets."""
    kind = texts.schema[key].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            source, order, begin, part = [], [], [], []
            for row, value in enumerate(batch.column(1)):
                at = 0
                for k, piece in enumerate(cut(value.as_py() or "")):
                    source.append(row)
                    order.append(k)
                    begin.append(at)
                    part.append(piece)
                    at += len(piece)
            ids = batch.column(0).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(order, pa.int64()), pa.array(begin, pa.int64()), pa.array(part, pa.string())], [key, "ord", "start", "unit"])

    return in_batches(texts.select(key, text_col)).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("ord", T.LongType()), T.StructField("start", T.LongType()), T.StructField("unit", T.StringType())]))


def split_units(texts: DataFrame, key: str = "doc_id", kind: str = "sentence", *, text_col: str = "text", abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """key, ord, start, unit: sentences or clauses; joined in order they are the text. A null or empty text is one empty unit."""
    return _pieces(texts, key, text_col, lambda t: units(t, kind, abbreviations))


def protected(texts: DataFrame, key: str = "doc_id", *, text_col: str = "text", abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """key, start, end, token: technical tokens that are never cut, a row each."""
    kind = texts.schema[key].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(row, a, b, t[a:b]) for row, value in enumerate(batch.column(1)) if (t := value.as_py()) for a, b in sorted(set(protected_spans(t, abbreviations)))]
            rows, a, b, token = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(token, pa.string())], [key, "start", "end", "token"])

    return in_batches(texts.select(key, text_col)).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("token", T.StringType())]))


def halves(texts: DataFrame, key: str = "doc_id", *, text_col: str = "text") -> DataFrame:
    """key, ord (0, 1), start, unit: the halves of each text by half_split; the second is empty where it can't be cut."""
    return _pieces(texts, key, text_col, half_split).drop("start")


def integrity(texts: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lossless: whether the chunks, in order and without white space, are the text without white space."""
    bare = lambda c: F.regexp_replace(c, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+", "")
    joined = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("joined"))
    both = texts.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).join(joined, key, "left")
    return both.select(key, F.coalesce(bare(F.col("joined")) == bare(F.col("text")), F.lit(False)).alias("lossless"))
