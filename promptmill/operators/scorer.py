"""The count-based scorer: learn token weights, score documents, save and load.

A scorer holds one model per cell. A single model is cell 0; a sweep keeps all its models in one
scorer, so that they learn and are applied together. Weights are whole numbers in units of 1e-9:
sums of them do not depend on the order in which partitions arrive, so the same rows win on every
cluster layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.serializers import CPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions.arrays import argmax, let
from promptmill.operators.examples import require_unique
from promptmill.operators.vocabulary import most_frequent
from promptmill.sources.storage import BROADCAST_BYTES, materialize

UNIT = 1_000_000_000
# Weights that a task adds up at once, over all cells and classes.
ADDED_AT_ONCE = 1 << 20
# Tokens of texts that a task works on at once.
TOKENS_AT_ONCE = 1 << 20
# Tokens of a larger scorer that are broadcast at most; a task has them in its memory.
HOT_TOKENS = 1 << 18
# Every document carries it once and its weights are the priors; no text can produce it.
PRIOR_TOKEN = ""


@dataclass
class TokenScorer:
    """weights: token, cells array<struct<cell, n array<bigint>, weight array<bigint>>>.

    The inner arrays have one entry per class. A token lists only the cells that know it.
    """

    classes: int
    weights: DataFrame
    cell_bytes: dict[int, int]

    @property
    def nbytes(self) -> int:
        return sum(self.cell_bytes.values())


def train(docs: DataFrame, classes: int) -> TokenScorer:
    """Learn from rows of `cell` (a number from 0), `class` and `tokens`, in one pass over them.

    Weight of a token in a class: ln((n + 1) / (N + V)), n its count in the class, N all counts of
    the class, V the distinct tokens of the cell. Prior: ln((docs + 1) / (docs of the cell + classes)),
    from the counts of the token that every document carries once. Counts are partial before the
    shuffle, so a frequent token does not weigh on one task.
    """
    n = F.array(*[F.count_if(F.col("class") == k) for k in range(classes)])
    carried = F.explode(F.concat(F.array(F.lit(PRIOR_TOKEN)), F.col("tokens")))
    counts = docs.select("cell", "class", carried.alias("token")).groupBy("token", "cell").agg(n.alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("cell", "n")))
    stored = materialize(counts.groupBy("token").agg(entries.alias("cells")), "token_counts")
    totals = cell_totals(stored, classes)

    cells = 1 + max([r["cell"] for r in totals], default=0)
    bottoms = [[1] * cells for _ in range(classes)]
    prior_bottom = [1] * cells
    for r in totals:
        prior_bottom[r["cell"]] = sum(r["docs"]) + classes
        for k in range(classes):
            bottoms[k][r["cell"]] = r["occurrences"][k] + r["distinct"]

    def weighted(entry):
        is_prior = F.col("token") == PRIOR_TOKEN
        below = [F.when(is_prior, _at(prior_bottom, entry["cell"])).otherwise(_at(b, entry["cell"])) for b in bottoms]
        weight = [F.rint(F.log((entry["n"][k] + 1) / below[k]) * UNIT).cast("bigint") for k in range(classes)]
        return F.struct(entry["cell"].alias("cell"), entry["n"].alias("n"), F.array(*weight).alias("weight"))

    weights = stored.select("token", F.transform("cells", weighted).alias("cells"))
    if cells > 1:
        # A sweep may be read in several shares; its weights are worked out once.
        weights = materialize(weights, "token_weights")
    return TokenScorer(classes, weights, {r["cell"]: r["nbytes"] for r in totals})


def _at(numbers: list[int], position: Column) -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in numbers]), position)


def cell_totals(stored: DataFrame, classes: int) -> list:
    """Per cell: documents and occurrences per class, distinct tokens, bytes. One row per cell."""
    real = F.col("token") != PRIOR_TOKEN

    def per_class(condition):
        return F.array(*[F.coalesce(F.sum(F.when(condition, F.col("n")[k])), F.lit(0)) for k in range(classes)])

    rows = stored.select("token", F.inline("cells"))
    return (
        rows.groupBy("cell")
        .agg(
            per_class(~real).alias("docs"),
            per_class(real).alias("occurrences"),
            F.count_if(real).alias("distinct"),
            F.sum(F.octet_length("token") + 48 + 16 * classes).alias("nbytes"),
        )
        .collect()
    )


def one_model(docs: DataFrame, label: str, classes: int) -> DataFrame:
    """Training rows of a single model. A label outside the classes fails the job: turn such rows away before."""
    known = F.when(F.col(label).between(0, classes - 1), F.col(label)).otherwise(
        F.raise_error("a training row has an unknown label").cast("int")
    )
    return docs.select(F.lit(0).alias("cell"), known.alias("class"), "tokens")


def token_frequencies(tokens: Column) -> Column:
    """array<struct<token, tf>> of a non-empty token array, worked out within the row.

    Sorted tokens form runs; the distance between the starts of two runs is a frequency.
    """

    def from_starts(words, starts):
        end = F.size(words)
        return F.transform(
            starts,
            lambda at, j: F.struct(F.get(words, at).alias("token"), (F.coalesce(F.get(starts, j + 1), end) - at).alias("tf")),
        )

    def from_sorted(words):
        places = F.sequence(F.lit(0), F.size(words) - 1)
        return let(
            F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))),
            lambda starts: from_starts(words, starts),
        )

    return let(F.sort_array(tokens), from_sorted)


def weight_table(scorer: TokenScorer, weights: DataFrame | None = None) -> tuple[pa.Array, np.ndarray]:
    """All tokens, or those of `weights`, and a row of weights for each: the classes of the first cell, then of the next.

    For a scorer, or a part of one, whose bytes were found to fit a broadcast. One more row, of zeros, is for unknown tokens.
    """
    cells = {cell: i for i, cell in enumerate(sorted(scorer.cell_bytes))}
    weights = scorer.weights if weights is None else weights
    found = weights.select("token", F.inline("cells")).select("token", "cell", "weight").toArrow()
    coded = found.column("token").combine_chunks().dictionary_encode()
    table = np.zeros((len(coded.dictionary) + 1, len(cells) * scorer.classes), np.int64)
    if len(coded):
        weights = found.column("weight").combine_chunks().flatten().to_numpy().reshape(-1, scorer.classes)
        at = np.array([cells[c] for c in found.column("cell").to_pylist()]) * scorer.classes
        rows = coded.indices.to_numpy()
        for k in range(scorer.classes):
            table[rows, at + k] = weights[:, k]
    return coded.dictionary, table


def row_runs(batch: pa.Array, most: int = TOKENS_AT_ONCE) -> Iterator[pa.Array]:
    """Runs of rows of a list array with about `most` elements each, at least one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch), 0)).astype(np.int64))
    lo, before = 0, 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo, before = hi, ends[hi - 1]


def _added(codes: np.ndarray, lengths: np.ndarray, table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """For every row the prior plus the lines of its codes."""
    ends = np.cumsum(lengths)
    sums = np.tile(prior, (len(lengths), 1))
    lo = 0
    while lo < len(lengths):
        start = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, start + max(1, ADDED_AT_ONCE // table.shape[1]), "right")))
        filled = lo + np.flatnonzero(lengths[lo:hi])
        if len(filled):
            firsts = ends[filled] - lengths[filled] - start
            sums[filled] += np.add.reduceat(table[codes[start : ends[hi - 1]]], firsts, axis=0)
        lo = hi
    return sums


def _lists(sums: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))


def units_in_place(scorer: TokenScorer) -> Callable[[Column], Column]:
    """A function of a token column: prior plus weights of all tokens, for every cell and class in one array.

    The scorer is broadcast and each row is summed where it is read: nothing is shuffled, and rows that
    share a key stay apart. For scorers whose bytes were found to fit.
    """
    shared = scorer.weights.sparkSession.sparkContext.broadcast(weight_table(scorer))

    @F.arrow_udf("array<bigint>")
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, table = shared.value
        prior_at = pc.index_in(pa.array([PRIOR_TOKEN]), value_set=words)[0].as_py()
        prior = table[-1] if prior_at is None else table[prior_at]
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch), 0))
            codes = np.asarray(pc.fill_null(pc.index_in(batch.flatten(), value_set=words), len(words)))
            # a text cannot hold the prior's token
            codes = np.where(codes == prior_at, len(words), codes) if prior_at is not None else codes
            yield _lists(_added(codes, lengths, table, prior))

    return units


def hot_units_in_place(scorer: TokenScorer, limit: int) -> Callable[[Column], Column]:
    """A function of a token column: prior plus weights of the most frequent tokens as `all_units`, and all other tokens as `rare`.

    The most frequent tokens are broadcast, as many as fit the limit; a row's other tokens come once each, with their number.
    """
    shared = scorer.weights.sparkSession.sparkContext.broadcast(weight_table(scorer, hot_tokens(scorer, limit)))

    @F.arrow_udf("struct<all_units: array<bigint>, rare: array<struct<token: string, tf: bigint>>>")
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, table = shared.value
        prior_at = pc.index_in(pa.array([PRIOR_TOKEN]), value_set=words)[0].as_py()
        prior = table[-1] if prior_at is None else table[prior_at]
        for batch in batches:
            sums, firsts, tokens, times = [np.zeros((0, table.shape[1]), np.int64)], [np.zeros(1, np.int64)], [], []
            for run in row_runs(batch):
                lengths = np.asarray(pc.fill_null(pc.list_value_length(run), 0)).astype(np.int64)
                coded = run.flatten().dictionary_encode()
                known = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1)).astype(np.int64)
                known[known == prior_at] = len(words)  # a text cannot hold the prior's token
                own = coded.indices.to_numpy(zero_copy_only=False)
                codes = known[own]
                cold = np.flatnonzero(codes < 0)
                codes[cold] = len(words)
                sums.append(_added(codes, lengths, table, prior))
                size = len(coded.dictionary) + 1
                rows = np.repeat(np.arange(len(run)), lengths)[cold]
                pairs, n = np.unique(rows * size + own[cold], return_counts=True)
                of_row, which = np.divmod(pairs, size)
                firsts.append(firsts[-1][-1] + np.searchsorted(of_row, np.arange(1, len(run) + 1)))
                tokens.append(coded.dictionary.take(pa.array(which)))
                times.append(n.astype(np.int64))
            entries = [pa.concat_arrays([pa.array([], pa.string()), *[t.cast(pa.string()) for t in tokens]]), pa.array(np.concatenate([np.zeros(0, np.int64), *times]))]
            rare = pa.StructArray.from_arrays(entries, ["token", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(firsts).astype(np.int32)), rare)
            yield pa.StructArray.from_arrays([_lists(np.concatenate(sums)), lists], ["all_units", "rare"])

    return units


def score_cells(
    docs: DataFrame, scorer: TokenScorer, keep: Sequence[str] = ("guid",), limit: int = BROADCAST_BYTES
) -> DataFrame:
    """keep, cell, units array<bigint>: prior plus the weights of all tokens; unknown ones add nothing.

    A scorer that fits the limit is broadcast and rows are scored where they are read. Of a larger one the most frequent
    tokens are broadcast; a row's sum over them is stored with its other tokens, once each, which alone are joined by shuffle.
    So no text is read twice and no stop word gathers in one task; `keep` must then be unique, which is checked.
    """
    keep = list(keep)
    cells = sorted(scorer.cell_bytes)
    entry = "transform(array({}), (c, i) -> struct(c as cell, slice(all_units, i * {} + 1, {}) as units))"
    entries = F.expr(entry.format(", ".join(map(str, cells)), scorer.classes, scorer.classes))
    if scorer.nbytes <= limit:
        whole = docs.select(*keep, units_in_place(scorer)(F.col("tokens")).alias("all_units"))
        return whole.select(*keep, F.inline_outer(entries))
    found = docs.select(*keep, hot_units_in_place(scorer, limit)(F.col("tokens")).alias("found"))
    stored = materialize(found.select(*keep, "found.*"), "hot_units")
    require_unique(stored, keep)
    names = [f"units{k}" for k in range(scorer.classes)]
    in_place = stored.select(*keep, F.inline_outer(entries)).select(
        *keep, "cell", *[F.get("units", F.lit(k)).alias(u) for k, u in enumerate(names)]
    )
    rare = stored.select(*keep, F.inline("rare")).join(flat(scorer.weights, names), "token")
    # The outer form keeps Catalyst from adding a size check, which would work out all weights twice.
    joined = rare.select(*keep, "tf", F.inline_outer("cells")).filter(F.col("cell").isNotNull())
    more = joined.select(*keep, "cell", *[(F.col(u) * F.col("tf")).alias(u) for u in names])
    sums = in_place.unionByName(more).groupBy(*keep, "cell").agg(*[F.sum(u).alias(u) for u in names])
    return sums.select(*keep, "cell", F.array(*names).alias("units"))


def flat(weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """Weights in their smallest form for a join: token, cells array<struct<cell, units0, ...>>."""
    entry = lambda c: F.struct(c["cell"].alias("cell"), *[c["weight"][k].alias(u) for k, u in enumerate(names)])
    return weights.select("token", F.transform("cells", entry).alias("cells"))


def hot_tokens(scorer: TokenScorer, limit: int) -> DataFrame:
    """The most frequent tokens of a scorer, HOT_TOKENS or as many as fit the limit if every cell knew them; the prior always."""
    k = min(HOT_TOKENS, 1 + limit // (48 + len(scorer.cell_bytes) * (16 + 16 * scorer.classes)))
    in_cell = F.transform("cells", lambda c: F.aggregate(c["n"], F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    frequency = F.aggregate(in_cell, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    is_prior = F.col("token") == PRIOR_TOKEN
    others = most_frequent(scorer.weights.filter(~is_prior).withColumn("n", frequency), k - 1).drop("n")
    return scorer.weights.filter(is_prior).unionByName(others)


def decide(units: Column) -> tuple[Column, Column]:
    """The class with the largest logit, the lowest class on ties, and the logits themselves."""
    logits = F.transform(units, lambda u: u / F.lit(float(UNIT)))
    return argmax(units).alias("pred"), logits.alias("logits")


def score(docs: DataFrame, scorer: TokenScorer, keep: Sequence[str] = ("guid",), limit: int = BROADCAST_BYTES) -> DataFrame:
    """keep, pred, logits of a single model."""
    return score_cells(docs, scorer, keep, limit).select(*keep, *decide(F.col("units")))


def class_in_place(scorer: TokenScorer) -> Callable[[Column], Column]:
    """The predicted class as a function of a token column, for a single model that fits a broadcast."""
    units = units_in_place(scorer)
    return lambda tokens: argmax(units(tokens))


def save_scorer(scorer: TokenScorer, path: str) -> None:
    """Write the scorer as one table, replacing an earlier one."""
    scorer.weights.write.mode("overwrite").parquet(path)


def load_scorer(spark: SparkSession, path: str) -> TokenScorer:
    weights = spark.read.parquet(path)
    prior = weights.filter(F.col("token") == PRIOR_TOKEN).select(F.size(F.col("cells")[0]["n"]).alias("classes"))
    classes = prior.first()["classes"]
    totals = cell_totals(weights, classes)
    return TokenScorer(classes, weights, {r["cell"]: r["nbytes"] for r in totals})


def append_predictions(corpus: DataFrame, predictions: DataFrame, key: Sequence[str], column: str = "senti_pre") -> DataFrame:
    """Add the predicted class to the corpus by key, for predictions that were made elsewhere.

    Keys must be unique on both sides, which is checked; a row without a prediction fails the job.
    """
    require_unique(corpus.select(*key), key)
    require_unique(predictions.select(*key), key)
    joined = corpus.drop(column).join(predictions.select(*key, F.col("pred").alias(column)), list(key), "left")
    present = F.when(F.col(column).isNotNull(), F.col(column)).otherwise(
        F.raise_error("a corpus row has no prediction").cast("int")
    )
    return joined.withColumn(column, present)


# Models of this Python worker, by the pickled factory that made them.
_models: dict[bytes, Callable[[pd.DataFrame], list]] = {}


def score_batches(
    encoded: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], list]], keep: Sequence[str] = ("guid",)
) -> DataFrame:
    """keep, logits: apply an external model to Arrow batches of encoded rows.

    `make_scorer` is called once per Python worker, which serves many tasks, so a model loads once there;
    what it returns gets the `keep` columns, input_ids, attention_mask, token_type_ids, mask_pos and gives
    one list of logits per row, at the mask position only. `spark.sql.execution.arrow.maxRecordsPerBatch`
    sets the batch size.
    """
    keep = list(keep)
    columns = [*keep, "input_ids", "attention_mask", "token_type_ids", "mask_pos"]
    made_by = CPickleSerializer().dumps(make_scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if made_by not in _models:
            _models[made_by] = CPickleSerializer().loads(made_by)()
        model = _models[made_by]
        for batch in batches:
            yield batch[keep].assign(logits=list(model(batch)))

    kinds = dict(encoded.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], "logits array<double>"])
    return encoded.select(*columns).mapInPandas(run, schema)
