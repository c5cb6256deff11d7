"""Positions and running values over orders too long, or groups too large, for one task.

Every function cuts the order into slices first. A slice is a bounded share of the rows, so one
group that holds a third of the data is spread over many tasks; only one row per slice travels on
to the step that links the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions.text import key_range
from promptmill.sources.storage import materialize

# Rows that share a slice, at most.
SLICE_ROWS = 1 << 17


def slice_count(df: DataFrame) -> int:
    """Slices for a stored table: as many as the shuffle has, more when they would exceed SLICE_ROWS rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS))


def range_slices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows, stored, with the `slice` of the whole order that each is in.

    The input is read once. Cuts fall anywhere in the order, so rows that share a value of its first column are
    spread too; they are stored with the rows, since a cut found again could fall elsewhere.
    """
    stored = materialize(df, "unsliced")
    ranged = stored.repartitionByRange(slice_count(stored), *order)
    return materialize(ranged.withColumn("slice", F.spark_partition_id()), "sliced")


def slice_splits(df: DataFrame, column: str, slices: int | None = None) -> list[float]:
    """Cut points that split a numeric column evenly: a bounded list, whatever the row count.

    The cuts only balance the work. Results do not depend on where they fall.
    """
    slices = slices or slice_count(df)
    shares = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), shares).alias("cuts")).first()["cuts"]
    return [float("-inf"), *sorted(set(found or [])), float("inf")]


def with_slice(df: DataFrame, column: str, splits: list[float], out: str = "slice") -> DataFrame:
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    source = f"{out}_of"
    numbered = df.withColumn(source, F.col(column).cast("double"))
    cut = Bucketizer(splits=splits, inputCol=source, outputCol=out).transform(numbered)
    return cut.withColumn(out, F.col(out).cast("int")).drop(source)


def step_slice(step: Column) -> Column:
    """Slice of a unique integer order: no slice of one run can exceed SLICE_ROWS rows."""
    return F.floor(step / SLICE_ROWS).cast("bigint")


def _before(group: Sequence[str], slice_column: str):
    return (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy(slice_column)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def linked(
    df: DataFrame,
    order: Sequence[str],
    slice_column: str,
    group: Sequence[str],
    index: str | None = None,
    tops: dict[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based position of every row in its group, as `index`, and running maxima.

    `tops` names, for each added column, the column whose largest value over the earlier rows of
    the group it holds; null on the first row. Slices must follow the order. The rows are shuffled
    once, by group and slice; one row per slice is linked across the group.
    """
    group, tops = list(group), tops or {}
    key = [*group, slice_column]
    sizes = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("slice_rows"), *[F.max(value).alias(f"{out}_slice") for out, value in tops.items()]
    )
    before = _before(group, slice_column)
    starts = sizes.select(
        *key,
        F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("rows_before"),
        *[F.max(f"{out}_slice").over(before).alias(f"{out}_before") for out in tops],
    )
    inside = Window.partitionBy(*key).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = df.select(
        "*",
        F.row_number().over(inside).alias("row_in_slice"),
        *[F.max(value).over(earlier).alias(f"{out}_inside") for out, value in tops.items()],
    )
    added = [F.greatest(f"{out}_before", f"{out}_inside").alias(out) for out in tops]
    if index:
        added.append((F.col("rows_before") + F.col("row_in_slice")).alias(index))
    return placed.join(starts, key).select(*[F.col(c) for c in df.columns], *added)


def row_index(
    df: DataFrame, order: Sequence[str], slice_column: str = "slice", group: Sequence[str] = (), out: str = "idx"
) -> DataFrame:
    """1-based position of every row in its group."""
    return linked(df, order, slice_column, group, index=out)


def smallest_per_group(
    df: DataFrame, group: Sequence[str], key: str, tie: str, k: int, out: str = "rank", digits: int = 4
) -> DataFrame:
    """The k rows with the smallest hex keys in every group, ranked.

    A count per key prefix finds how far each group has to be read. Only that head, about one
    prefix more than k rows, is shuffled and ranked, however large the group is. `group` must be a
    fixed short list of values (such as the seeds), since one row of each is broadcast.
    """
    group = list(group)
    keyed = df.withColumn("prefix", key_range(F.col(key), digits))
    counts = keyed.groupBy(*group, "prefix").agg(F.count(F.lit(1)).alias("rows_at"))
    before = F.coalesce(F.sum("rows_at").over(_before(group, "prefix")), F.lit(0))
    heads = (
        counts.withColumn("rows_before", before)
        .filter(F.col("rows_before") < k)
        .groupBy(*group)
        .agg(F.max("prefix").alias("last_prefix"))
    )
    ranked = Window.partitionBy(*group).orderBy(key, tie)
    return (
        keyed.join(F.broadcast(heads), group)
        .filter(F.col("prefix") <= F.col("last_prefix"))
        .withColumn(out, F.row_number().over(ranked))
        .filter(F.col(out) <= k)
        .drop("prefix", "last_prefix")
    )
