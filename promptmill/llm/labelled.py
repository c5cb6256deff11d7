"""The labelled rows from which a text classifier learns, and sums over the tasks that learn from them.

A fit sees every labelled row that is not held out. Features are made where the texts are and stored; tasks learn from
the rows they read, and Spark adds up what they found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import doc_key, text_chunks
from promptmill.sources.storage import broadcast_if_small, materialize

# One in so many labelled rows sets thresholds instead of weights.
CHECKING = 5

# Tasks that add up what others learned, and the bytes of a label that is sent to the texts.
PARTS, LABEL_BYTES = 16, 32

# Margins are counted by steps of this part, up to a largest margin.
MARGIN_STEP, MOST_MARGIN = 1 / 1024, 64.0

_STEPS = 1 << 20


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`: null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, most_rows: int | None = None) -> DataFrame:
    """`doc, text, label` of all labelled rows that are not held out; of about `most_rows` of them, if a caller asks for fewer.

    Labels other than 0 and 1 teach nothing; of several labels of a doc_id the largest counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(modulus, rest)).groupBy("doc_id").agg(F.max(label).alias("label"))
    usable = usable.where("doc_id is not null")
    n = usable.count()
    chosen = usable
    if most_rows is not None:
        share = min(1.0, most_rows / max(1, n))
        number = F.xxhash64(F.lit(11), "doc_id")
        # 62 bits of the hash, so that the share is met for any number of labels; compared as a double, which keeps 53 of them
        place = F.pmod(number, F.lit(_STEPS)) + F.pmod(F.shiftrightunsigned(number, 20), F.lit(1 << 42)) / float(1 << 42)
        chosen, n = usable.where(place < share * _STEPS), min(n, most_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # labels go to the texts, unless there are too many to send
    return texts.join(broadcast_if_small(chosen, n * LABEL_BYTES), "doc_id").select(doc_key().alias("doc"), "text", F.col("label").cast("int"))


def stored_features(rows: DataFrame, features: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """`label, checks, features` of labelled texts, stored: `features` gives values and row offsets of a chunk of texts.

    A row checks, which depends on its doc_id alone, or it teaches.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                values, cuts = features(data, offsets)
                made = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column("label"), own.column("checks"), pa.array(made, pa.binary())], ["label", "checks", "features"]
                )

    checks = F.pmod(F.xxhash64(F.lit(13), "doc"), F.lit(CHECKING)) == 0
    made = rows.withColumn("checks", checks).mapInArrow(extract, "label int, checks boolean, features binary")
    return materialize(made, "labelled-features")


def class_sizes(rows: DataFrame) -> dict[tuple[bool, int], int]:
    """Rows by whether they check and by their label."""
    return {(r["checks"], r["label"]): r["count"] for r in rows.groupBy("checks", "label").count().collect()}


def read_features(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Values, labels and whether they check of stored rows, some at a time."""
    for batch in batches:
        column = batch.column("features")
        if not len(column):
            continue
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most_bytes, "right")) - 1)
            own = batch.slice(lo, hi - lo)
            values = [np.frombuffer(v, np.int32) for v in own.column("features").to_pylist()]
            yield values, own.column("label").to_numpy(), own.column("checks").to_numpy(zero_copy_only=False)
            lo = hi


def number_counts(rows: DataFrame, size: int, numbers: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have each number below `size`, and those of them with label 1; `numbers` are those of a row's values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, ones = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for values, labels, _ in read_features(batches):
            for own, label in zip(values, labels):
                found = np.unique(numbers(own))
                having[found] += 1
                ones[found] += label
        seen = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(having[seen]), pa.array(ones[seen])], ["number", "having", "ones"])

    counted = rows.mapInArrow(count, "number long, having long, ones long")
    found = counted.groupBy("number").agg(F.sum("having").alias("having"), F.sum("ones").alias("ones")).toArrow()
    out = np.zeros((2, size), np.int64)
    out[:, found.column("number").to_numpy()] = found.column("having").to_numpy(), found.column("ones").to_numpy()
    return out[0], out[1]


def summed_moves(rows: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, np.ndarray, float, float, float]], width: int):
    """What tasks learned, as one: mean moves by id, weighed by the rows of the tasks that made them, and the loss and its weight.

    `learn` gives, from a task's rows, the ids it moved, their moves (a line of `width` numbers each), its number of rows, a loss and its
    weight. Tasks are added up in the order of their numbers, so a sum does not depend on which one ends first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, moves, weight, loss, n = learn(batches)
        task = TaskContext.get().partitionId()
        part = ids % PARTS
        for k in range(PARTS):
            own = part == k
            if own.any() or (k == 0 and n):
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([k], pa.int32()), "task": pa.array([task], pa.int32()), "weight": pa.array([float(weight)]),
                        "loss": pa.array([float(loss if k == 0 else 0)]), "n": pa.array([float(n if k == 0 else 0)]),
                        "ids": pa.array([ids[own].astype(np.int32).tobytes()], pa.binary()),
                        "moves": pa.array([moves[own].astype(np.float32).tobytes()], pa.binary()),
                    }
                )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")
        every = [np.frombuffer(x, np.int32) for x in frame["ids"]]
        ids = np.unique(np.concatenate(every))
        sums, weights = np.zeros((len(ids), width)), np.zeros(len(ids))
        for own, weight, moves in zip(every, frame["weight"], frame["moves"]):
            at = np.searchsorted(ids, own)
            sums[at] += weight * np.frombuffer(moves, np.float32).reshape(-1, width)
            weights[at] += weight
        means = (sums / weights[:, None]).astype(np.float32)
        return pd.DataFrame({"loss": [frame["loss"].sum()], "n": [frame["n"].sum()], "ids": [ids.tobytes()], "moves": [means.tobytes()]})

    made = rows.mapInArrow(run, "part int, task int, weight double, loss double, n double, ids binary, moves binary")
    found = made.groupBy("part").applyInPandas(add, "loss double, n double, ids binary, moves binary").collect()
    ids = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(r["ids"], np.int32) for r in found]])
    moves = np.concatenate([np.zeros((0, width), np.float32), *[np.frombuffer(r["moves"], np.float32).reshape(-1, width) for r in found]])
    return ids, moves, sum(r["loss"] for r in found), sum(r["n"] for r in found)


def margin_counts(rows: DataFrame, margins: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """`kind, margin, n, ones`: stored rows by kind and margin in steps of MARGIN_STEP; `margins` gives kinds and margins of some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, labels, _ in read_features(batches):
            kinds, found = margins(values)
            steps = np.floor(np.clip(found, -MOST_MARGIN, MOST_MARGIN) / MARGIN_STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(steps), pa.array(labels.astype(np.int64))], ["kind", "step", "label"])

    counted = rows.mapInArrow(run, "kind long, step long, label long").groupBy("kind", "step")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
    return counted.select("kind", ((F.col("step") + 0.5) * MARGIN_STEP).alias("margin"), "n", "ones").orderBy("kind", "margin").toArrow()
