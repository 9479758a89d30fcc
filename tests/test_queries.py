"""Every registered query against its DuckDB counterpart, and its independence of the partitioning."""

import os

import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    wanted = plain(duck.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
    assert got == wanted


def test_partitioning_does_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    query = registry.queries()["chapter_dedupe_stats"]
    wanted = plain(query(spark, SF).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert plain(query(spark, SF).collect()) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_letters_that_would_be_abbreviations(spark, tmp_path):
    """Of secrets and the like letters remain that are an abbreviation (or www) before a period."""
    import duckdb

    texts = ["key AKIA0TS9 ends", "seen by Mr. else", "DR e", "prof em ths em ts", "see www.em.vn", "TS", "x v.d. e P.S. e U.S. e"]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plain(registry.queries()["sanitize_steps"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == plain(c.execute(registry.oracle_sql()["sanitize_steps"]).fetchall())
