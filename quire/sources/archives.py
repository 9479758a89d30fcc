"""ZIP archives of any size: entries as rows that are told before they are read, and archives written as a stream.

The directory at an archive's end is read first, a row an entry. What isn't wanted is filtered
out as rows, and what is left is dealt out in ranges of an archive's entries, so that an archive
is read by several tasks, and no row holds more than one entry. The files are opened where the
tasks run: local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import in_batches

#: Bytes (unpacked) of the entries that one task reads, about.
RANGE_BYTES = 64 << 20


def _open(path: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return store.open_input_file(place)


def archive_entries(paths: DataFrame) -> DataFrame:
    """path, nr, name, size, error: the entries of the archives at paths (path), without folders; an archive that can't be read is one row with error file_unreadable."""

    def run(batches: Iterator) -> Iterator:
        import zipfile

        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with _open(path) as file, zipfile.ZipFile(file) as z:
                        rows += [(path, nr, info.filename, info.file_size, None) for nr, info in enumerate(z.infolist()) if not info.is_dir()]
                except (zipfile.BadZipFile, OSError, pa.ArrowInvalid):
                    rows.append((path, 0, path.rsplit("/", 1)[-1], 0, "file_unreadable"))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "nr", "name", "size", "error"])

    return paths.select("path").mapInArrow(run, "path string, nr long, name string, size long, error string")


def read_entries(entries: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, nr, name, content of entries (path, nr, name, size) without an error; each archive in ranges of about so many bytes."""
    from quire.operators.scan import Ranges

    own = entries.filter("error is null").select("path", "nr", "name", "size")
    told = Ranges(own, ["path"], ["nr"]).running("_upto", F.col("size")).rows()
    part = F.floor(F.col("_upto") / range_bytes)
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since the rows to be dealt are small and would be put together again
    dealt = told.withColumn("_part", part).repartition(n, "path", "_part").sortWithinPartitions("path", "nr").select("path", "nr", "name")

    def run(batches: Iterator) -> Iterator:
        import zipfile

        import pyarrow as pa

        now, file, z = None, None, None
        try:
            for batch in batches:
                for path, nr, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != now:
                        if z is not None:
                            z.close()
                            file.close()
                        file = _open(path)
                        z, now = zipfile.ZipFile(file), path
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([nr], pa.int64()), pa.array([name]), pa.array([z.read(z.infolist()[nr])], pa.binary())], ["path", "nr", "name", "content"])
        finally:
            if z is not None:
                z.close()
                file.close()

    return in_batches(dealt).mapInArrow(run, "path string, nr long, name string, content binary")


def write_archives(parts: DataFrame, folder: str, encoding: str = "utf-8") -> DataFrame:
    """Write rows (archive, filename, part, text) as ZIP archives in a folder that all executors see; archive, files, bytes of each.

    An archive's files stand in order of their names, each of its parts in order; they are packed
    as they are read, into a file of another name that is moved when it is whole. The same files
    give the same bytes. Runs when the result is read.
    """
    rows = parts.select("archive", "filename", "part", "text").repartition("archive").sortWithinPartitions("archive", "filename", "part")

    def run(batches: Iterator) -> Iterator:
        import zipfile
        from uuid import uuid4

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        now, name, out, z, entry, files, place = None, None, None, None, None, 0, ""

        def close():
            entry.close()
            z.close()
            out.close()
            store.move(place, f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([files], pa.int64()), pa.array([store.get_file_info(f"{root}/{now}").size], pa.int64())], ["archive", "files", "bytes"])

        for batch in batches:
            for archive, filename, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != now:
                    if z is not None:
                        yield close()
                    now, name, files, place = archive, None, 0, f"{root}/{archive}.{uuid4().hex}.part"
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(place)
                    z, entry = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), None
                if filename != name:
                    if entry is not None:
                        entry.close()
                    info = zipfile.ZipInfo(filename)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    entry, name, files = z.open(info, "w", force_zip64=True), filename, files + 1
                entry.write((text or "").encode(encoding))
        if z is not None:
            yield close()

    return in_batches(rows).mapInArrow(run, "archive string, files long, bytes long")
