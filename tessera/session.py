"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app_name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE with skew handling, UTC)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables (``spark.checkpoint.dir``).

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a local relation.

    The planner knows its size and sends it to all tasks. Rows handed over without one count as endless: a join then
    spreads the other side by the few keys of these rows, and all rows of a large table meet in one task.
    """
    fields = T.StructType.fromDDL(schema)
    table = pa.table({f.name: [row[i] for row in rows] for i, f in enumerate(fields)})
    return spark.createDataFrame(table, fields)


#: Spark's setting to delete the shuffle files of a query when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner real sizes. The shuffle files of the write are deleted
    when it ends: nothing reads them again, and a long chain of tables would fill the disks with them.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that a later one replaces; frames made from them cannot be used again."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if not files or not os.path.dirname(files[0]).removeprefix("file://").startswith(checkpoint_dir(spark).removeprefix("file://")):
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def opened(path: str):
    """File system and path in it of a URI or an absolute path, for tasks that read written files through pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)
