"""Results to files: annotated corpora, predictions, metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.sources.corpus import CSV_WRITE
from promptmill.sources.storage import exists, is_finished, materialize, replace_all


def write_csv(df: DataFrame, path: str, index: str = "guid") -> None:
    """The row id first, under its own name, then all other columns."""
    rest = [c for c in df.columns if c != index]
    df.select(index, *rest).write.options(**CSV_WRITE).csv(path)


def write_annotated(df: DataFrame, path: str, fmt: str = "csv", index: str = "guid") -> None:
    """Original columns plus `senti_pre`, the row id kept."""
    if fmt == "csv":
        write_csv(df, path, index)
    else:
        df.write.parquet(path)


def write_if_absent(targets: dict[str, DataFrame], fmt: str = "csv") -> bool:
    """Compute and write all targets unless every one of them is finished; returns whether it wrote.

    The check comes before any job is planned, so a complete set costs nothing. Otherwise the whole set
    is written beside the targets and moved into place when all of it is there; see `replace_all`. A half-written
    target does not count.
    """
    if all(is_finished(df.sparkSession, path) for path, df in targets.items()):
        return False
    session = next(iter(targets.values())).sparkSession
    staged = {path: f"{path.rstrip('/')}.{uuid.uuid4().hex}" for path in targets}
    for path, df in targets.items():
        write_annotated(df, staged[path], fmt)
    replace_all(session, staged)
    return True


def write_predictions(predictions: DataFrame, path: str) -> None:
    """The predicted class with its key, so that the file can be joined back."""
    predictions.select("guid", F.col("pred").cast("int").alias("pred")).write.parquet(path)


def append_metrics(log: DataFrame, path: str) -> None:
    """Add rows of run, step, split, metric, value to the log, one folder per run.

    A row replaces an earlier one of the same run, step, split and metric, so a run that is repeated, in whole or in
    part, leaves its rows once; within `log` they must be unique. Only the folders of its runs are read and written
    anew. One job at a time may write a run.
    """
    spark, key = log.sparkSession, ["run", "step", "split", "metric"]
    new = materialize(log, "metrics")
    rows = new
    if exists(spark, path):
        earlier = spark.read.schema(log.schema).parquet(path)
        kept = earlier.join(new.select("run").distinct(), "run", "left_semi").join(new, key, "left_anti")
        rows = materialize(new.unionByName(kept), "metrics")
    dealt = rows.hint("rebalance", "run")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
