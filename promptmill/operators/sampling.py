"""Reproducible orders, samples and batches, and the grid of sweep runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions.text import key_range, shuffle_key
from promptmill.operators.ordering import range_slices, row_index, smallest_per_group
from promptmill.sources.storage import fixed_table
from promptmill.tasks import SEEDS, SIZES


def seeded_shuffle(df: DataFrame, seed: int, epochs: int = 1, key: str = "guid") -> DataFrame:
    """Add `epoch` and `shuffle_pos`: a new order per epoch, the same one on every cluster."""
    keyed = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn(
        "shuffle_key", shuffle_key(seed, F.col("epoch"), F.col(key))
    )
    sliced = keyed.withColumn("slice", key_range(F.col("shuffle_key")))
    indexed = row_index(sliced, ["shuffle_key", key], "slice", ["epoch"], "shuffle_pos")
    return indexed.drop("slice", "shuffle_key")


def assign_batches(df: DataFrame, batch_size: int, key: str = "guid") -> DataFrame:
    """Add `batch_id` and `pos`: consecutive runs of rows in key order, the last one short."""
    indexed = row_index(range_slices(df, [key]), [key], "slice", [], "idx")
    zero = F.col("idx") - 1
    return (
        indexed.withColumn("batch_id", F.floor(zero / batch_size).cast("bigint"))
        .withColumn("pos", (zero % batch_size).cast("int"))
        .drop("slice", "idx")
    )


def collate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per batch with an array per column. A group holds `batch_size` rows, never more."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    grouped = df.groupBy("batch_id").agg(rows.alias("rows"))
    return grouped.select("batch_id", *[F.col("rows")[c].alias(c) for c in columns])


def few_shot(df: DataFrame, seeds: Sequence[int] = SEEDS, largest: int = SIZES[-1], key: str = "guid") -> DataFrame:
    """seed, rank: for every seed its `largest` first rows in shuffled order.

    A sample of n rows is the rows with rank up to n, so the samples of a seed are nested.
    """
    per_seed = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    keyed = per_seed.withColumn("shuffle_key", shuffle_key(F.col("seed"), F.col(key)))
    return smallest_per_group(keyed, ["seed"], "shuffle_key", key, largest).drop("shuffle_key")


def sizes_holding(rank: Column, sizes: Sequence[int] = SIZES) -> Column:
    """The sample sizes that a row of this rank belongs to."""
    return F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: rank <= n)


def sweep_grid(spark: SparkSession, sizes: Sequence[int] = SIZES, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """cell, n, seed: all runs of a sweep, from two fixed lists."""
    cells = [(i * len(seeds) + j, n, s) for i, n in enumerate(sizes) for j, s in enumerate(seeds)]
    return fixed_table(spark, cells, "cell int, n int, seed int")


def step_counts(rows: Column, batch_size: int, epochs: int, warmup_ratio: float) -> tuple[Column, Column]:
    """Training steps of a run, and how many of them are warm-up."""
    steps = F.ceil(rows / batch_size) * epochs
    return steps.cast("bigint"), F.floor(steps * F.lit(warmup_ratio)).cast("bigint")
