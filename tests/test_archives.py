"""Archives read by entries and written as a stream."""

import zipfile

from pyspark.sql import functions as F

from quire.sources import archives


def test_archives_are_read_by_entries(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("d/", "")
            for i in range(40):
                z.writestr(f"d/{i}.txt", f"{k} {i} " * 100)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    paths = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.iterdir())] + [(str(tmp_path / "none.zip"),)], "path string")
    entries = archives.archive_entries(paths)
    assert {r.path.rsplit("/", 1)[-1] for r in entries.filter("error is not null").collect()} == {"bad.zip", "none.zip"}
    assert entries.filter("error is null").count() == 80
    read = archives.read_entries(entries.filter(F.col("name").endswith("7.txt")), range_bytes=1000)
    got = {(r.path.rsplit("/", 1)[-1], r.name): bytes(r.content).decode() for r in read.collect()}
    assert got == {(f"{k}.zip", f"d/{i}.txt"): f"{k} {i} " * 100 for k in range(2) for i in (7, 17, 27, 37)}
    every = archives.read_entries(entries, range_bytes=5000)
    assert every.count() == 80 and every.select(F.spark_partition_id()).distinct().count() > 2
    assert archives.read_entries(entries.filter("false")).collect() == []


def test_archives_are_written_as_a_stream(spark, tmp_path):
    rows = [(f"{a}.zip", f"x/{f}.txt", p, f"{a}{f}é{p}\n" * 20) for a in "pq" for f in range(5) for p in range(7)]
    table = spark.createDataFrame(rows, "archive string, filename string, part long, text string").repartition(6)
    told = {r.archive: (r.files, r.bytes) for r in archives.write_archives(table, str(tmp_path)).collect()}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p.zip", "q.zip"]
    for a in "pq":
        path = tmp_path / f"{a}.zip"
        assert told[f"{a}.zip"] == (5, path.stat().st_size)
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [f"x/{f}.txt" for f in range(5)]
            assert z.read("x/3.txt").decode() == "".join(f"{a}3é{p}\n" * 20 for p in range(7))
    before = (tmp_path / "p.zip").read_bytes()
    archives.write_archives(table.repartition(2), str(tmp_path)).collect()
    assert (tmp_path / "p.zip").read_bytes() == before
