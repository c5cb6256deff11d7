"""Exact classification metrics over distributed predictions. No prediction reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.functions.arrays import cross_entropy, gather, softmax
from promptmill.operators.ordering import slice_splits, with_slice
from promptmill.operators.sampling import assign_batches
from promptmill.sources.storage import materialize


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0 where there is nothing to divide by."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label and prediction: the only table the label metrics need."""
    return predictions.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


BINARY_COUNTS = ("n_rows", "hits", "tp", "positives", "actuals")


def binary_counts() -> list[Column]:
    """Aggregates of `label` and `pred` for the positive class 1, named as in BINARY_COUNTS."""
    actual, said = F.col("label") == 1, F.col("pred") == 1
    found = (F.count(F.lit(1)), F.count_if(F.col("label") == F.col("pred")), F.count_if(actual & said), F.count_if(said), F.count_if(actual))
    return [count.alias(name) for count, name in zip(found, BINARY_COUNTS)]


def binary_ratios(sums: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, n_rows, precision, accuracy, f1_score from the counts."""
    return sums.select(
        *keep,
        "n_rows",
        _ratio(F.col("tp"), F.col("positives")).alias("precision"),
        _ratio(F.col("hits"), F.col("n_rows")).alias("accuracy"),
        _ratio(2 * F.col("tp"), F.col("positives") + F.col("actuals")).alias("f1_score"),
    )


def binary_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, accuracy, f1_score for the positive class 1, in one pass."""
    return binary_ratios(predictions.groupBy(*by).agg(*binary_counts()), by)


def macro_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, and F1 averaged over the classes found among labels or predictions."""
    by = list(by)
    cells = confusion(predictions, by)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("is_label")),
        F.struct(F.col("pred").alias("class"), F.lit(0).alias("is_label")),
    )
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    per_class = (
        cells.select(*by, F.col("n"), hit.alias("hit"), F.explode(sides).alias("side"))
        .groupBy(*by, F.col("side.class").alias("class"))
        .agg(
            F.sum("n").alias("both"),
            F.sum("hit").alias("twice_tp"),
            F.sum(F.when(F.col("side.is_label") == 1, F.col("n")).otherwise(0)).alias("actual"),
        )
    )
    return per_class.groupBy(*by).agg(
        F.sum("actual").alias("n_rows"),
        (F.sum("twice_tp") / 2 / F.sum("actual")).alias("accuracy"),
        F.avg(F.col("twice_tp") / F.col("both")).alias("f1_score"),
    )


def batch_losses(rows: DataFrame, ce: str = "ce") -> DataFrame:
    """Mean cross-entropy of every batch."""
    return rows.groupBy("batch_id").agg(F.avg(ce).alias("loss"), F.count(F.lit(1)).alias("n_rows"))


def reported_loss(losses: DataFrame) -> DataFrame:
    """The sum of batch means, which depends on the batch size, and the plain mean beside it."""
    return losses.agg(
        F.sum("loss").alias("loss"), (F.sum(F.col("loss") * F.col("n_rows")) / F.sum("n_rows")).alias("mean_loss")
    )


def with_cross_entropy(rows: DataFrame, target: str, logits: str = "logits", positions: Sequence[int] | None = None, out: str = "ce") -> DataFrame:
    """Cross-entropy over all logits, or over the label words at `positions` only."""
    values = F.col(logits)
    if positions is not None:
        values = gather(values, F.array(*[F.lit(p) for p in positions]))
    return rows.withColumn(out, cross_entropy(values, F.col(target)))


def auroc_ovo(rows: DataFrame, classes: Sequence[int], slices: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-one macro AUROC from `label` and `probs`, for each group of `by`; equal scores count one half.

    Rows are first counted per class and distinct score, as stored. Each class's scores are then cut into
    even slices; ranks are summed inside the slices and linked by one row per slice, so the work
    spreads over the cluster even when nearly all scores differ. A pair with an empty side gives
    a null score and `undefined_pairs` above 0.
    """
    k, by = len(classes), list(by)
    scored = rows.select(
        *by, "label", F.posexplode(F.array(*[F.col("probs")[i] for i in range(k)])).alias("class", "score")
    )
    counts = materialize(
        scored.groupBy(*by, "class", "score").agg(
            *[F.count_if(F.col("label") == c).alias(f"n{i}") for i, c in enumerate(classes)]
        ),
        "score_counts",
    )
    cut = with_slice(counts, "score", slice_splits(counts, "score", slices))
    names, key = [f"n{i}" for i in range(k)], [*by, "class"]
    per_slice = cut.groupBy(*key, "slice").agg(*[F.sum(n).alias(n) for n in names])
    link = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        *key, "slice", *[F.coalesce(F.sum(n).over(link), F.lit(0)).alias(f"{n}_start") for n in names]
    )
    inside = Window.partitionBy(*key, "slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = cut.select(
        *key, "slice", *names, *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_inside") for n in names]
    ).join(starts, [*key, "slice"])

    own = F.element_at(F.array(*names), F.col("class") + 1)
    wins = below.groupBy(*key).agg(
        F.sum(own).alias("positives"),
        *[F.sum(n).alias(n) for n in names],
        *[
            F.sum(own * (F.col(f"{n}_start") + F.col(f"{n}_inside") + F.col(n) / 2.0)).alias(f"{n}_wins")
            for n in names
        ],
    )
    pairs = wins.select(
        *key,
        F.posexplode(
            F.array(
                *[(F.col(f"{n}_wins") / F.nullif(F.col("positives") * F.col(n), F.lit(0))).alias(n) for n in names]
            )
        ).alias("other", "auc"),
    ).filter(F.col("class") != F.col("other"))
    return pairs.groupBy(*by).agg(
        F.when(F.count("auc") == k * (k - 1), F.avg("auc")).alias("AUROC_score"),
        F.count_if(F.col("auc").isNull()).alias("undefined_pairs"),
    )


def metric_log(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per metric: the keys, `metric`, `value`."""
    doubles = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot(list(keys), list(names), "metric", "value")


def evaluate(scored: DataFrame, task_type: str, classes: Sequence[int], batch_size: int, split: str) -> DataFrame:
    """split, metric, value: all metrics of a task type, and the loss, from stored predictions.

    `scored` holds guid, label, pred and logits. It is read once per family of metrics, so it should
    be a stored table. An unknown task type is treated as binary, as everything but `multiclass` is.
    """
    if task_type == "multiclass":
        ranked = auroc_ovo(scored.select("label", softmax(F.col("logits")).alias("probs")), classes)
        families = [(macro_metrics(scored), ["accuracy", "f1_score"]), (ranked, ["AUROC_score"])]
    else:
        families = [(binary_metrics(scored), ["precision", "accuracy", "f1_score"])]
    batches = assign_batches(with_cross_entropy(scored, "label"), batch_size)
    families.append((reported_loss(batch_losses(batches)), ["loss"]))
    logs = [metric_log(df.withColumn("split", F.lit(split)), ["split"], names) for df, names in families]
    return reduce(DataFrame.unionByName, logs)
