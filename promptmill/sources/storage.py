"""Where intermediate tables live, and how they are cut from their lineage."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table, in bytes of values, that this package asks Spark to broadcast.
BROADCAST_BYTES = 128 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`.

    A session that runs in one process (`local[n]`, as in tests) may leave it unset and gets a
    folder that is removed when the process ends. Any other session must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="promptmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder and read back.

    Later jobs neither recompute the table nor depend on the executors that made it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, nbytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast only when the measured size allows it; else the join shuffles."""
    return F.broadcast(df) if nbytes <= limit else df


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list of fixed rows as a table that is planned, and broadcast, without a job."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    fields = ", ".join(f"{part.split()[0]}: {part.split()[1]}" for part in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_finished(spark: SparkSession, path: str) -> bool:
    """True when a whole result is there: Spark marks it last, so a folder without the mark is half written."""
    target, files = _path(spark, f"{path}/_SUCCESS")
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def _rename(spark: SparkSession, source: str, path: str) -> None:
    target, files = _path(spark, path)
    files.mkdirs(target.getParent())
    if not files.rename(_path(spark, source)[0], target):
        raise OSError(f"cannot move {source} to {path}")


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def replace_all(spark: SparkSession, sources: dict[str, str]) -> None:
    """Put finished folders, by the path where each belongs, in place of whatever is there.

    Everything old is set aside before the first new folder comes, so old and new ones never lie side by side. When a
    move fails, all old folders are put back; when the driver is lost, paths are missing and what was set aside stays.
    """
    aside = {path: f"{path.rstrip('/')}.old-{uuid.uuid4().hex}" for path in sources if exists(spark, path)}
    set_aside, placed = [], []
    try:
        for path, old in aside.items():
            _rename(spark, path, old)
            set_aside.append(path)
        for path, source in sources.items():
            _rename(spark, source, path)
            placed.append(path)
    except Exception:
        for path in placed:
            remove(spark, path)
        for path in set_aside:
            _rename(spark, aside[path], path)
        raise
    for old in aside.values():
        remove(spark, old)
