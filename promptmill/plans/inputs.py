"""Example, vector and history inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions.arrays import dot
from promptmill.functions.text import tokens
from promptmill.operators.ordering import range_slices, row_index
from promptmill.tasks import TASKS

# Session setting: partitions among which a corpus is dealt out when it is read.
SCAN_PARTITIONS = "promptmill.scan.partitions"

# Classes of the vector labels.
VECTOR_CLASSES = tuple(range(10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, with its row id as `guid`.

    A corpus stored as one row group is read by one task. A session may set SCAN_PARTITIONS to deal
    such a corpus out by key; nothing does so unasked.
    """
    rows = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "guid")
    asked = spark.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(asked), "guid") if asked else rows


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """guid, text_a, label, senti_gold, split: one row per labelled document."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "guid")
    docs = documents(spark, sf_dir).select("guid", "text", "lang")
    senti = F.when(F.col("quality") == 0, 0).when(F.col("lang") == "en", 2).otherwise(1)
    tail = F.col("guid") % 10
    split = F.when(tail < 8, "train").when(tail == 8, "dev").otherwise("test")
    return docs.join(labels, "guid").select(
        "guid",
        F.col("text").alias("text_a"),
        F.col("toxic").alias("label"),
        senti.alias("senti_gold"),
        split.alias("split"),
    )


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("guid", tokens(F.col("text")).alias("tokens"))


def task_of(guid: Column) -> Column:
    """One of the task names for every row, in upper case for some rows."""
    names = F.array(*[F.lit(t.task) for t in TASKS])
    name = F.get(names, (guid % len(TASKS)).cast("int"))
    return F.when(guid % 2 == 0, F.upper(name)).otherwise(name)


def task_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples spread over all tasks; their label is the one the task's label words can take."""
    rows = examples(spark, sf_dir)
    return rows.select(
        "guid", "text_a", "label", F.col("senti_gold").alias("senti_pre"), task_of(F.col("guid")).alias("task")
    )


def vector_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """guid, label, logits array<double>: each vector against the mean vector of every class.

    The ten means are one scalar subquery, so the vectors are read once more and never shuffled.
    """
    vectors = table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("placed"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("label", F.transform("placed", lambda p: p["mean"]).alias("mean")))),
                lambda r: r["mean"],
            ).alias("means")
        )
    )
    rows = vectors.select(F.col("vec_id").alias("guid"), "label", "embedding", means.scalar().alias("means"))
    logits = F.transform("means", lambda m: dot(F.col("embedding"), m))
    return rows.select("guid", "label", logits.alias("logits"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, step, value, test_value: the events of a user, in time order, as evaluations of a run."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        "value",
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("test_value"),
    )
    order = ["at", "event_id"]
    steps = row_index(range_slices(events, order), order, "slice", ["run"], "step")
    return steps.select("run", F.col("step").cast("bigint").alias("step"), "value", "test_value")
