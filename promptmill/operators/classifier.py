"""A second trainer: logistic regression over weighted tokens, by gradient steps whose sums are whole numbers.

Tokens fall into a fixed number of buckets, so a model has a size of its own, whatever the corpus. Every value
that is summed over rows is a whole number; a step thus gives the same weights for every partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.operators.scorer import row_runs
from promptmill.sources.storage import materialize

BUCKETS = 1 << 12
STEPS = 12
RATE = 4.0
# Values of features, weights and gradients are whole numbers of this part.
UNIT = 1_000_000
# Logarithms of document shares are whole numbers of this part.
LOG_UNIT = 1000


def _nearest(value: np.ndarray) -> np.ndarray:
    """The nearest whole number; halves go up, which any engine computes alike."""
    return np.floor(value + 0.5).astype(np.int64)


def _distinct_buckets(run: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of all documents one after the other, and where each document's begin, with the end appended."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(run), 0)).astype(np.int64)
    coded = run.flatten().dictionary_encode()
    bucket = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:2], "big") % buckets for t in coded.dictionary.to_pylist()], np.int64)
    rows = np.repeat(np.arange(len(run)), lengths)
    pairs = np.unique(rows * buckets + bucket[coded.indices.to_numpy(zero_copy_only=False)])
    return pairs % buckets, np.searchsorted(pairs, np.arange(len(run) + 1) * buckets)


def token_buckets(tokens: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of a document's tokens; `buckets` is a power of two up to 65536."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, firsts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for run in row_runs(batch):
                own, first = _distinct_buckets(run, buckets)
                found.append(own)
                firsts.append(firsts[-1][-1] + first[1:])
            offsets = pa.array(np.concatenate(firsts).astype(np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32)))

    return of(tokens)


def _columns_of(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms and weights of a model by bucket: at most 65537 of each."""
    rows = model.select("bucket", "log", "weight").orderBy("bucket").toArrow()
    return rows.column("log").to_numpy().astype(np.int64), rows.column("weight").to_numpy().astype(np.int64)


def _scored(found: np.ndarray, first: np.ndarray, logs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of documents' buckets, their logarithms scaled to length 1, and the weighted sums in units of UNIT * UNIT.

    A sum has the constant, which is the last bucket, with a value of UNIT.
    """
    lengths = np.diff(first)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    log = logs[found]
    square = _row_sums(log * log, first)
    x = _nearest(log * float(UNIT) / np.sqrt(np.maximum(square, 1).astype(float))[rows])
    return x, _row_sums(weights[found] * x, first) + weights[-1] * UNIT


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(values)]
    return sums[first[1:]] - sums[first[:-1]]


def train_logistic(docs: DataFrame, label: str = "label", buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE) -> DataFrame:
    """Learn from rows of `tokens` and a label of 0 or 1; other labels and nulls are left out.

    Both labels weigh alike in sum, however rare one is. Returns `bucket, log, weight`, one row per bucket and one for the constant: write it as a table to keep it. A
    bucket counts by the logarithm of the share of documents that have it. Each step reads the stored buckets of
    the documents once; gradients are summed in the tasks, so that at most `buckets` rows per task are shuffled and
    as many rows in all reach the driver, which sends the new weights to the tasks. No rows give weights of 0.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), token_buckets(F.col("tokens"), buckets).alias("found"))
    stored = materialize(rows, "bucketed")
    total, ones = stored.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    counted = stored.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("held")).toArrow()
    held = np.zeros(buckets, np.int64)
    held[counted.column("bucket").to_numpy()] = counted.column("held").to_numpy()
    logs = np.r_[_nearest(float(LOG_UNIT) * np.log(float(total + 1) / (held + 1))), 0]
    weights = np.zeros(buckets + 1, np.int64)
    shares = np.array([total / (2.0 * max(total - ones, 1)), total / (2.0 * max(ones, 1))])
    for _ in range(steps if total else 0):
        shared = spark.sparkContext.broadcast((logs, weights))

        def pull(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            logs, weights = shared.value
            gradient = np.zeros(buckets + 1, np.int64)
            for batch in batches:
                labels, lo = batch.column("label").to_numpy(), 0
                for run in row_runs(batch.column("found")):
                    own = labels[lo : lo + len(run)]
                    lo += len(run)
                    first = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(run)).astype(np.int64))]
                    found = run.flatten().to_numpy().astype(np.int64)
                    x, score = _scored(found, first, logs, weights)
                    with np.errstate(over="ignore"):
                        share = 1.0 / (np.exp(-(score / (float(UNIT) * UNIT))) + 1.0)
                    error = _nearest((share - own) * shares[own] * float(UNIT))
                    # whole numbers far below 2**53, so that their sums as doubles are exact
                    pulls = _nearest(np.repeat(error, np.diff(first)) * x / float(UNIT))
                    gradient[:buckets] += np.bincount(found, pulls, buckets).astype(np.int64)
                    gradient[buckets] += _nearest(error * UNIT / float(UNIT)).sum()
            moved = np.flatnonzero(gradient)
            yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), pa.array(gradient[moved])], ["bucket", "gradient"])

        summed = stored.mapInArrow(pull, "bucket int, gradient bigint").groupBy("bucket").agg(F.sum("gradient").alias("gradient")).toArrow()
        gradient = np.zeros(buckets + 1, np.int64)
        gradient[summed.column("bucket").to_numpy()] = summed.column("gradient").to_numpy()
        weights = weights - _nearest(float(rate) * gradient / float(max(total, 1)))
        shared.unpersist()
    model = pa.table({"bucket": pa.array(np.arange(buckets + 1, dtype=np.int32)), "log": pa.array(logs), "weight": pa.array(weights)})
    return materialize(spark.createDataFrame(model, "bucket int, log bigint, weight bigint"), "logistic")


def predict_logistic(model: DataFrame, docs: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The columns of `keep`, `score` (whole, in units of UNIT * UNIT) and `pred`: 1 where the score is above 0.

    Documents are scored where they are read. Null tokens count as none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_columns_of(model))

    @F.arrow_udf("bigint")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores = [_scored(*_distinct_buckets(run, buckets), *shared.value)[1] for run in row_runs(batch)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *scores]))

    return docs.select(*keep, score(F.col("tokens")).alias("score")).withColumn("pred", (F.col("score") > 0).cast("int"))
