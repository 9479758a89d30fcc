"""How the sources of a language differ: wide term vectors and exact triangular divergences.

Texts are counted where they are read, into bounded tables of (language, source, term), which
are flushed when full and summed by Spark. Each term of a language that enough documents hold
is pivoted into one row: an array of its counts, indexed by the language's sources in order.
From that array a higher-order function makes the scaled shares of all sources, and from these
the contribution of each pair of sources, which are summed map-side, so that what is shuffled
is a row a pair and task, whatever the number of terms. The contribution of a pair is the same
both ways and is made once.

A row holds as many numbers as its language has sources; the number of pairs, and so the
result, is the square of that. A source with a third of all rows is no more than one cell of
each vector. Of the terms that tell a source from its language, each task passes on the best
ten of a source.

Defined results: null text, language or source is ''. Documents are rows: one that is there
twice counts twice. A language whose documents share no kept term gives pairs of value 0 and
no terms. A table without rows gives none. Arithmetic is exact: decimals where 64 bits might
not do.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.words import BROADCAST_ROWS, ascii_table
from quire.session import in_batches, persist_table

#: Entries that a task holds, and bytes of texts that it reads, before it sends its counts on; rows of a batch that it sends.
HELD, HELD_BYTES, SENT = 400_000, 64 << 20, 50_000
#: Scale of the shares.
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term): summed in part, by task."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    table = ascii_table(string.ascii_letters)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> Iterator:
            for (lang, source), (n, has) in held.items():
                terms, counts, of = list(n), list(n.values()), list(map(has.__getitem__, n))
                for at in range(0, len(terms), SENT):
                    some = pa.array(terms[at : at + SENT], pa.binary()).cast(pa.string())
                    ends = (at, at + SENT)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.repeat(source, len(some)), some, pa.array(counts[slice(*ends)], pa.int64()), pa.array(of[slice(*ends)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        entries = size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                text = text.as_py()
                words = text.translate(table).split()
                n, has = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                has.update(set(words))
                entries += len(n) - before
                size += len(text)
                if entries > HELD or size > HELD_BYTES or len(held) > HELD:
                    yield from flush()
                    entries = size = 0
        yield from flush()

    return in_batches(rows).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _sources(docs: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """lang, sources (its sources in order)."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()
    return groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))


def term_vectors(counts: DataFrame, sources: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total, counts (an array along sources) of the terms that least_docs documents of the language hold.

    The counts are dealt by language and term once: what comes of one term is summed as it is
    read, a row a source.
    """
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("cells"))
    wide = wide.filter(F.col("docs") >= least_docs).join(sources, "lang")
    return wide.select("lang", "term", "total", F.expr("transform(sources, s -> coalesce(try_element_at(cells, s), 0L))").alias("counts"))


def _sizes(vectors: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, sources, ns (occurrences of kept terms in each), v (kept terms), l (their occurrences)."""
    ns = vectors.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    ns = ns.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("ns"))
    of_lang = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("l"))
    return sources.join(ns, "lang").join(of_lang, "lang").select("lang", "sources", F.col("ns.n").alias("ns"), "v", "l")


def _share(count: str, of: str) -> str:
    return f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({of} + 2 * v as decimal(20,0))"


def audit(docs: DataFrame, *, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: divergence of a source from each other one ('pair'), and the terms by which it exceeds its language ('term', ranks to top)."""
    sources = persist_table(_sources(docs, lang_col, source_col), "sources")
    few = (sources.agg(F.sum(F.size("sources"))).first()[0] or 0) <= BROADCAST_ROWS
    vectors = persist_table(term_vectors(term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col), F.broadcast(sources) if few else sources, least_docs), "vectors")
    sizes = persist_table(_sizes(vectors, sources), "sizes")
    wide = vectors.join(F.broadcast(sizes) if few else sizes, "lang").withColumn("p", F.expr(f"zip_with(counts, ns, (c, n) -> {_share('c', 'n')})"))

    ones = wide.select("lang", "p", F.posexplode("p").alias("i", "own"))
    ones = ones.select("lang", "i", F.posexplode(F.expr("transform(slice(p, i + 2, size(p)), x -> ((own - x) * (own - x)) div (own + x))")).alias("k", "f"))
    sums = ones.groupBy("lang", "i", "k").agg(F.sum("f").alias("f")).select("lang", "i", (F.col("i") + 1 + F.col("k")).alias("j"), "f")
    both = sources.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).filter("a <> b")
    both = both.select("lang", "source", "item", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    pairs = both.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).alias("value"))

    terms = wide.select("lang", "term", F.expr(_share("total", "l")).alias("q"), F.explode(F.arrays_zip("sources", "counts", "p")).alias("c")).filter("c.counts > 0 and c.p > q")
    terms = terms.select("lang", F.col("c.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((c.p - q) * (c.p - q)) div (c.p + q)").alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
