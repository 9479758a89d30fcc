"""The subpackage's registered queries and their DuckDB counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; QUIRE_TOKENIZERS overrides the folder."""
    folder = os.environ.get("QUIRE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def crc_part(parts: int):
    """Remainder of the CRC-32 of an id's text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import langid

    docs = _documents(spark, sf_dir)
    model = langid.train(docs, crc_part(4) != 2)
    return langid.predict(docs, model).select("doc_id", (crc_part(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import toxicity

    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_part(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (crc_part(5) == 0).alias("held_out"), "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.licenses import find_licenses

    return find_licenses(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import pii

    return pii.summary(pii.find_pii(_documents(spark, sf_dir)))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.bpe import encode_digests

    return encode_digests(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontam import find_items

    return find_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard_join import jaccard_join

    return jaccard_join(_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import repeated_spans

    return repeated_spans(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ranked_search import search

    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.divergence import audit

    return audit(_documents(spark, sf_dir))


def op13_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.signature_join import near_copies

    return near_copies(_documents(spark, sf_dir))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS texts, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
m AS (SELECT r, 100 - 25 + (25 * len(w) * texts) // length AS m FROM d, s WHERE len(w) > 0),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(w) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * texts + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, texts),
e AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM e WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""

OP13_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM h GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS x FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n
      HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
q AS (SELECT rep AS a, rep AS b FROM c UNION SELECT q.a, l.b FROM q JOIN l ON l.a = q.b),
g AS (SELECT a AS rep, min(b) AS component FROM q GROUP BY a)
SELECT doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN doc_id ELSE component END AS component_id, c.n = 0 OR doc_id = component AS kept
FROM h JOIN c USING (s) JOIN g USING (rep)
"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS l FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS n FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, term, x.n, 1 + (1000000000::HUGEINT * (x.n + 2)) // (s.n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (l + 2 * v) AS q
      FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_near_copies": OP13_SQL}
