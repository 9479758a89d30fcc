"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quire", cpus: str = "*") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that setting is missing, a folder of our own is made if the master is local; on a
    cluster nothing of this machine is shared, so a ValueError says what to set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-quire-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs no recomputation of what stands before,
    and what is computed once is not computed again by later reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes and rows of whole texts that Spark hands to Python at a time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def in_batches(rows: DataFrame) -> DataFrame:
    """rows, with the session set to hand them to Python in small batches, so that memory doesn't grow with the length of texts.

    The setting stays, since Spark reads it when the query runs; smaller ones of the user's are kept.
    """
    conf = rows.sparkSession.conf
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        now = conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return rows
