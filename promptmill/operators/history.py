"""What happened during runs, read from a table of scores: run, step, value.

`step` is unique within a run. A run may hold a third of all rows; it is worked on in slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.operators.ordering import linked, step_slice
from promptmill.sources.storage import materialize

# Fixed value: the score every first evaluation has to beat.
START_SCORE = -1.0


def due(step: Column, every: int) -> Column:
    """True on the steps at which an evaluation is made."""
    return F.pmod(step, F.lit(every)) == 0


def best_so_far(history: DataFrame) -> DataFrame:
    """Add `eval_no`, `best_before`, the best earlier score, and `improved`, 1 when it is strictly beaten."""
    sliced = history.withColumn("slice", step_slice(F.col("step")))
    best = linked(sliced, ["step"], "slice", ["run"], index="eval_no", tops={"best_before": "value"})
    best_before = F.greatest(F.coalesce("best_before", F.lit(START_SCORE)), F.lit(START_SCORE))
    return best.withColumn("best_before", best_before).withColumn(
        "improved", (F.col("value") > F.col("best_before")).cast("int")
    )


def early_stop(history: DataFrame, patience: int) -> DataFrame:
    """run, n_evals, stop_step: where `patience` evaluations in a row brought no improvement.

    The streak at an evaluation is its number minus the number of the last improving one, so it
    needs a running maximum, not a loop. The judged rows are stored between the two passes over
    them. `stop_step` is null for runs that never stop early, and for all runs when `patience` is 0
    or less.
    """
    improved_at = F.when(F.col("improved") == 1, F.col("eval_no")).alias("improved_at")
    judged = materialize(best_so_far(history).select("run", "step", "slice", "eval_no", improved_at), "judged")
    last = linked(judged, ["step"], "slice", ["run"], tops={"last_before": "improved_at"})
    streak = F.col("eval_no") - F.coalesce(F.greatest("improved_at", "last_before"), F.lit(0))
    stops = F.when((F.lit(patience) > 0) & (streak >= patience), F.col("step"))
    return last.groupBy("run").agg(F.count(F.lit(1)).alias("n_evals"), F.min(stops).alias("stop_step"))


def best_checkpoint(history: DataFrame) -> DataFrame:
    """run, best_step, best_value: the best score, the earliest step on ties."""
    best = F.max(F.struct("value", -F.col("step"))).alias("best")
    return history.groupBy("run").agg(best).select(
        "run", (-F.col("best.col2")).alias("best_step"), F.col("best.value").alias("best_value")
    )


def tests_of_improved_steps(dev: DataFrame, test: DataFrame) -> DataFrame:
    """Test scores of the steps at which the dev score improved."""
    improved = best_so_far(dev).filter(F.col("improved") == 1).select("run", "step")
    return test.join(improved, ["run", "step"], "left_semi")


def checkpoint_name(score: Column, prefix: str) -> Column:
    """Directory name of a saved model: its score, rounded to two places."""
    return F.concat(F.lit(prefix), F.round(score, 2).cast("string"), F.lit("/"))
