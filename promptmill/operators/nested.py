"""Scorers of nested samples: all runs of a sweep from counts that are stored once.

The samples of a seed are nested: the rows of a size are those of the next smaller one and a band of new ones. A token's counts are
kept where they enter, per seed, band and class; the counts of a size are running sums over the bands. Weights are worked out
where a token is met, so no token is stored or sent for every run that knows it, and no row is made per token and run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.operators.scorer import ADDED_AT_ONCE, PRIOR_TOKEN, UNIT, row_runs
from promptmill.sources.storage import BROADCAST_BYTES, fixed_table, materialize


# Bytes below which a share is not cut further: every share is a job.
LEAST_SHARE = 1 << 18


class _Share(NamedTuple):
    """Some tokens, and what entered of each: `first` says where a token's entries begin."""

    tokens: pa.Array
    first: np.ndarray
    slot: np.ndarray
    n: np.ndarray


@dataclass
class NestedScorer:
    """Counts by token and slot, sent in shares of the tokens; a slot is a seed, a band and a class.

    `below` and `prior` hold, by seed, size and class, what counts are divided by, and the units of an empty text.
    """

    spark: SparkSession
    sizes: tuple[int, ...]
    seeds: tuple[int, ...]
    shares: list[Broadcast]
    below: np.ndarray
    prior: np.ndarray

    @property
    def classes(self) -> int:
        return self.prior.shape[2]

    def runs(self) -> DataFrame:
        """cell, n, seed of every run, in the order of their units."""
        every = [(n, seed) for seed in self.seeds for n in self.sizes]
        return fixed_table(self.spark, [(i, *run) for i, run in enumerate(every)], "cell int, n int, seed int")


def train_nested(rows: DataFrame, sizes: Sequence[int], seeds: Sequence[int], classes: int, limit: int = BROADCAST_BYTES) -> NestedScorer:
    """Learn from rows of `seed`, `rank`, `class` and `tokens`, in one pass: a row counts in every size that its rank fits.

    Weights are those of `scorer.train`, with the sample of each size and seed as one cell. The counts are fetched and sent in as many
    shares as `limit` asks for, one after the other. The samples bound them: a seed has no more rows than its largest size.
    """
    sizes, seeds = tuple(sorted(set(sizes))), tuple(seeds)
    shape = (len(seeds), len(sizes), classes)
    per_seed = len(sizes) * classes
    smaller = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n < F.col("rank"))
    seed_no = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("seed")).cast("int") - 1
    slot = seed_no * per_seed + F.size(smaller) * classes + F.col("class")
    carried = F.explode(F.concat(F.array(F.lit(PRIOR_TOKEN)), F.col("tokens")))
    counts = rows.select(slot.cast("int").alias("slot"), carried.alias("token")).groupBy("token", "slot").agg(F.count(F.lit(1)).alias("n"))
    deltas = materialize(counts, "nested_counts")
    nbytes = deltas.agg(F.sum(F.octet_length("token") + 16).alias("nbytes")).first()["nbytes"] or 0
    several = max(1, -(-nbytes // max(LEAST_SHARE, limit)))

    docs, occurrences, distinct = (np.zeros(shape) for _ in range(3))
    shares = []
    for i in range(several):
        found = deltas.filter(F.pmod(F.xxhash64("token"), F.lit(several)) == i).toArrow().combine_chunks()
        coded = found.column("token").combine_chunks().dictionary_encode()
        codes, slots, n = coded.indices.to_numpy(), found.column("slot").to_numpy(), found.column("n").to_numpy()
        order = np.lexsort((slots, codes))
        codes, slots, n = codes[order], slots[order].astype(np.int64), n[order]
        carrier = pc.index(coded.dictionary, PRIOR_TOKEN).as_py()
        taught = codes == carrier
        docs += np.bincount(slots[taught], weights=n[taught], minlength=docs.size).reshape(shape)
        occurrences += np.bincount(slots[~taught], weights=n[~taught], minlength=docs.size).reshape(shape)
        # a token is new in the band of the first slot it has in a seed
        first_in_seed = np.ones(len(codes), bool)
        first_in_seed[1:] = (codes[1:] != codes[:-1]) | (slots[1:] // per_seed != slots[:-1] // per_seed)
        distinct += np.bincount(slots[first_in_seed & ~taught], minlength=docs.size).reshape(shape)
        first = np.searchsorted(codes, np.arange(len(coded.dictionary) + 1))
        share = _Share(coded.dictionary, first, slots.astype(np.int32), n)
        shares.append(rows.sparkSession.sparkContext.broadcast(share))
    docs, occurrences, distinct = (np.cumsum(x, axis=1) for x in (docs, occurrences, distinct))
    prior = np.rint(np.log((docs + 1) / (docs.sum(2, keepdims=True) + classes)) * UNIT).astype(np.int64)
    below = np.maximum(occurrences + distinct.sum(2, keepdims=True), 1)
    if not docs.any():
        # no training row, no run; with one, every seed draws it
        seeds, below, prior = (), below[:0], prior[:0]
    return NestedScorer(rows.sparkSession, sizes, seeds, shares, below, prior)


def _weights(share: _Share, at: np.ndarray, logs: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Whole-unit weights of the tokens at `at`, for all runs and classes; 0 in runs that do not know them."""
    lengths = share.first[at + 1] - share.first[at]
    rows = np.repeat(np.arange(len(at)), lengths)
    places = np.repeat(share.first[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    counts = np.zeros((len(at), int(np.prod(shape))), np.int64)
    counts[rows, share.slot[places]] = share.n[places]
    counts = np.cumsum(counts.reshape(len(at), *shape), axis=2)
    units = np.rint((np.log(counts + 1.0) - logs) * UNIT).astype(np.int64)
    units *= counts.sum(3, keepdims=True) > 0
    return units.reshape(len(at), int(np.prod(shape)))


def units_of_runs(scorer: NestedScorer) -> Callable[[Column], Column]:
    """A function of a token column: prior plus weights of all tokens, for every run and class in one array.

    Rows are scored where they are read, in one scan, whatever the number of shares.
    """
    sent, shape = scorer.shares, scorer.prior.shape
    logs, prior = np.log(scorer.below), scorer.prior.reshape(-1)
    width, carrier = len(prior), PRIOR_TOKEN

    def added(run: pa.Array) -> np.ndarray:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(run), 0)).astype(np.int64)
        coded = run.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = [np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=s.value.tokens), -1)) for s in sent]
        own = pc.index(coded.dictionary, carrier).as_py()
        ends = np.cumsum(lengths)
        sums = np.tile(prior, (len(run), 1))
        lo = 0
        while lo < len(run) and width:
            start = ends[lo] - lengths[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, start + max(1, ADDED_AT_ONCE // width), "right")))
            filled = lo + np.flatnonzero(lengths[lo:hi])
            # a long text is added up in pieces, too
            step = max(1, ADDED_AT_ONCE // width) if hi == lo + 1 else ends[hi - 1] - start
            for at_ in range(start, ends[hi - 1], max(1, step)):
                here, which = np.unique(codes[at_ : min(at_ + step, ends[hi - 1])], return_inverse=True)
                table = np.zeros((len(here), width), np.int64)
                for share, at in zip(sent, found):
                    # a text cannot hold the token that every document carries
                    known = np.flatnonzero((at[here] >= 0) & (here != own))
                    table[known] = _weights(share.value, at[here[known]], logs, shape)
                firsts = [0] if hi == lo + 1 else ends[filled] - lengths[filled] - start
                sums[filled] += np.add.reduceat(table[which], firsts, axis=0)
            lo = hi
        return sums

    @F.arrow_udf("array<bigint>")
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sums = np.concatenate([np.zeros((0, width), np.int64), *map(added, row_runs(batch))])
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width)
            yield pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))

    return units


def each_run(scored: DataFrame, scorer: NestedScorer, keep: Sequence[str], units: str = "all_units") -> DataFrame:
    """keep, cell, units: a row for every run."""
    k = scorer.classes
    entry = f"transform(sequence(0, size({units}) div {k} - 1), c -> struct(c as cell, slice({units}, c * {k} + 1, {k}) as units))"
    return scored.filter(F.size(units) > 0).select(*keep, F.inline(F.expr(entry)))
