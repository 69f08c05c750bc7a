"""Written stages (embedded, sliced, ...), run results and statistics."""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import config_map


def stage_path(root: str, stage: str, config: Mapping[str, object]) -> str:
    """Folder of a stage; the name is a hash of the whole configuration, so no setting can be forgotten."""
    digest = hashlib.sha256(json.dumps(dict(config), sort_keys=True, default=str).encode()).hexdigest()[:24]
    return posixpath.join(root, stage, digest)


def save_stage(df: DataFrame, path: str, partition_by: str | None = "lake") -> None:
    """Overwrite a stage, one folder per lake; a hot lake is spread over as many files as it has tasks."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read a stage; lake names that look like numbers stay text."""
    df = spark.read.parquet(path)
    if "lake" in df.columns and df.schema["lake"].dataType != T.StringType():
        fields = [T.StructField("lake", T.StringType()) if f.name == "lake" else f for f in df.schema.fields]
        df = spark.read.schema(T.StructType(fields)).parquet(path)
    return df


def stage_exists(spark: SparkSession, path: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "_SUCCESS"))
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def read_or_compute(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], partition_by: str | None = "lake"
) -> DataFrame:
    """The stage if it was completely written before, else compute, write and read it."""
    if not stage_exists(spark, path):
        save_stage(compute(), path, partition_by)
    return load_stage(spark, path)


def _children(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def save_version(frames: Mapping[str, DataFrame], root: str) -> str:
    """Write the frames of a lake (cells, tiles, vectors, truths, ...) as one version and return its name.

    Data come first, then a manifest that names them; a version without a complete manifest is never read, so a write
    that breaks off leaves the last version in force. Names of versions ascend with time.
    """
    spark = next(iter(frames.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in frames.items():
        df.write.parquet(posixpath.join(root, "data", version, name))
    listed = spark.createDataFrame([(name, df.schema.json()) for name, df in frames.items()], "name string, schema string")
    listed.coalesce(1).write.json(posixpath.join(root, "manifests", version))
    return version


def load_version(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The frames of a version, by default of the newest complete one."""
    manifests = posixpath.join(root, "manifests")
    complete = [v for v in _children(spark, manifests) if stage_exists(spark, posixpath.join(manifests, v))]
    if not complete or (version is not None and version not in complete):
        raise FileNotFoundError(f"no complete version {version or ''} under {root}")
    chosen = version or complete[-1]
    listed = spark.read.schema("name string, schema string").json(posixpath.join(manifests, chosen)).collect()
    return {
        r["name"]: spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(posixpath.join(root, "data", chosen, r["name"]))
        for r in listed}


def add_config(results: DataFrame, config_name: str) -> DataFrame:
    """Add one column per ``k=v`` of a configuration name."""
    tail = config_name.split("/")[-1]
    pairs = dict(part.split("=")[:2] for part in tail.split("_"))
    return results.withColumns({k: F.lit(v) for k, v in pairs.items()})


def add_config_columns(results: DataFrame, keys: list[str], config_name: str = "config_name") -> DataFrame:
    """The same for a frame that holds many configurations, one name per row."""
    parsed = config_map(F.col(config_name))
    return results.withColumns({k: F.try_element_at(parsed, F.lit(k)) for k in keys})


def save_run(results: DataFrame, root: str, config_name: str) -> None:
    """One CSV folder per run."""
    path = posixpath.join(root, config_name.split("/")[-1] + ".csv")
    add_config(results, config_name).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_runs(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """All runs under ``root`` united by column name: each run is read by its own header, missing columns are null.

    ``schema`` gives the types of the columns it names; others are text. One plan branch per run.
    """
    files = spark.read.text(posixpath.join(root, "*.csv")).select("_metadata.file_path").distinct().collect()
    runs = sorted({posixpath.dirname(r["file_path"]) for r in files})
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    united = concat_runs([reader.csv(run) for run in runs])
    if schema is None:
        return united
    types = spark.createDataFrame([], schema).schema
    return united.select(*[F.col(f.name).cast(f.dataType) for f in types], *[c for c in united.columns if c not in types.names])


def concat_runs(runs: list[DataFrame]) -> DataFrame:
    united = runs[0]
    for run in runs[1:]:
        united = united.unionByName(run, allowMissingColumns=True)
    return united


def save_statistics(counters: DataFrame, path: str) -> None:
    counters.write.mode("overwrite").json(path)
