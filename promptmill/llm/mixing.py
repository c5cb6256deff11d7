"""Mixing sources to target weights by subset sums over exact lengths.

Texts are counted by source and exact length. A source takes all its documents as often as its
target holds them whole; of the rest, a fixed share of each length is taken, then longest lengths
first, and a bounded-knapsack dynamic program over the remaining counts fills what is left. Which
documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.common import WORD, as_doc_id, doc_key, free_names
from promptmill.sources.storage import materialize

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 7

# Words that the dynamic program fills. More are first taken by length.
PROGRAM_WORDS = 1 << 16
# Hash slices of the documents of one length, so that no task ranks all documents of a hot length.
RANK_SLICES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """`source, source_size, target` from `source, source_size`: one small row per source.

    Targets are min(level * weight, most * size), with the one level at which they add up to all
    sizes: this is where resharing the excess by weight ends.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    # sources in the order in which a rising level reaches their bound
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = weighted.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(rest),
    )
    # levels before the right one exceed the bound of their source; levels after it only fall
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("source_size") * most, F.col("level"))).over(everything)
    return levels.select("source", "source_size", F.least(level * F.col("weight"), (F.col("source_size") * most).cast("double")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their words come nearest to a budget.

    counts bounds each size. A proportional share comes first, then sizes from the longest down while
    more than PROGRAM_WORDS are open, then the best subset sum of what is open.
    """
    total = int((sizes * counts).sum())
    take = (counts * min(1.0, budget / total)).astype(np.int64) if total else np.zeros(len(sizes), np.int64)
    take = np.minimum(take, counts)
    left = budget - int((sizes * take).sum())
    while left < 0:  # only after rounding of huge counts
        i = int(np.argmax(take * sizes))
        take[i] -= 1
        left += int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):
        if left <= PROGRAM_WORDS:
            break
        more = min(int(counts[i] - take[i]), (left - PROGRAM_WORDS) // int(sizes[i]))
        take[i] += max(more, 0)
        left -= max(more, 0) * int(sizes[i])
    return take + subset_sum(sizes, counts - take, left)


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts of each size whose sum is nearest to the budget, the lower of two.

    Sums are the bits of one integer, up to twice the budget, beyond which nothing is nearer than no
    document at all. Counts are split into powers of two; for every sum, the first part that reached it
    is remembered.
    """
    take = np.zeros(len(sizes), np.int64)
    top = 2 * max(budget, 0)
    usable = [i for i in range(len(sizes)) if 0 < sizes[i] <= top and counts[i] > 0]
    if not usable:
        return take
    parts: list[tuple[int, int]] = []
    for i in usable:
        open_count, n = min(int(counts[i]), top // int(sizes[i])), 1
        while open_count > 0:
            n_taken = min(n, open_count)
            parts.append((i, n_taken))
            open_count -= n_taken
            n *= 2
    mask = (1 << (top + 1)) - 1
    reached, first = 1, np.full(top + 1, -1, np.int32)
    for k, (i, n) in enumerate(parts):
        new = (reached << (int(sizes[i]) * n)) & mask & ~reached
        if new:
            first[_bits(new, top)] = k
            reached |= new
        if reached >> budget & 1:
            break
    sums = _bits(reached, top)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = parts[first[at]]
        take[i] += n
        at -= int(sizes[i]) * n
    return take


def _bits(number: int, top: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(number.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little"))


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """One source: its lengths (never more than the square root of twice its words) and its target."""
    sizes, counts = rows["size"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64)
    order = np.lexsort((sizes,))
    sizes, counts = sizes[order], counts[order]
    words = int((sizes * counts).sum())
    target = float(rows["target"].iloc[0])
    whole = min(int(target // words), MOST_REPEATS) if words else 0
    rest = int(round(target - whole * words)) if whole < MOST_REPEATS else 0
    return pd.DataFrame(
        {"source_no": rows["source_no"].iloc[0], "size": sizes, "whole": whole, "extra": fit(sizes, counts, rest)}
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """How many words a mix takes of each document; reads `doc_id, text, source`.

    Returns one row per input row: `doc_id, source, size, source_size, target, repeats, taken`. A null text
    has size 0, and a document of size 0 gives no words. Null is a source of its own, after all others.
    A null doc_id counts as the largest. Rows that repeat doc_id and text are documents of their own: they
    share a rank, ties being equal rows. Other columns are not read. An empty table gives no rows.
    """
    sized = materialize(docs.select(doc_key().alias("doc"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("docs"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = source_targets(sources, weights).withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    )
    targets = materialize(targets, "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    numbered = lengths.join(targets, same(lengths, targets)).select("source_no", "size", "docs", "target")
    plan = numbered.groupBy("source_no").applyInPandas(_fit_source, "source_no int, size long, whole long, extra long")
    plan = materialize(plan, "mix-plan")

    # Documents of a length are ordered by slice, hash, doc. A slice is taken whole while the count
    # lasts; only the documents of the slice where it ends are ranked.
    rank_hash = F.xxhash64(F.lit(seed), F.col("doc"))
    keyed = sized.join(targets, same(sized, targets)).select(
        "doc", targets["source"], "source_no", "size", "source_size", "target", rank_hash.alias("rank"), F.pmod(rank_hash, F.lit(RANK_SLICES)).alias("slice")
    )
    slices = keyed.groupBy("source_no", "size", "slice").agg(F.count("*").alias("in_slice"))
    filled = slices.withColumn(
        "before", F.sum("in_slice").over(Window.partitionBy("source_no", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    ).fillna(0, ["before"])
    quotas = filled.join(plan, ["source_no", "size"]).select(
        "source_no", "size", "slice", "whole", "in_slice",
        F.greatest(F.lit(0), F.least(F.col("in_slice"), F.col("extra") - F.col("before"))).alias("quota"),
    )
    chosen = keyed.join(quotas, ["source_no", "size", "slice"])
    settled = chosen.where("quota = 0 or quota = in_slice").withColumn("more", (F.col("quota") > 0).cast("long"))
    ranked = Window.partitionBy("source_no", "size", "slice").orderBy("rank", "doc")
    partial = chosen.where("quota > 0 and quota < in_slice").withColumn(
        "more", (F.row_number().over(ranked) <= F.col("quota")).cast("long")
    )
    repeats = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0))
    return settled.unionByName(partial).select(
        as_doc_id(F.col("doc")).alias("doc_id"), "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken")
    )


MIX_COLUMNS = ("size", "source_size", "target", "repeats", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Every row with all its columns and with what `mix` says of it, in place of columns of those names; `repeats` is 0 for one that the mix leaves out.

    Rows that share doc_id, source and size share their rank, too, and are one choice: each of them gets the largest repeats of them.
    Nulls, ties and empty tables as for `mix`.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in MIX_COLUMNS])
    key = free_names(docs, "mix_doc", "mix_source", "mix_source_missing", "mix_size")
    missing, source = F.col("source").isNull(), F.coalesce(F.col("source"), F.lit(""))
    found = mix(docs, weights, seed).select(
        doc_key().alias(key[0]), source.alias(key[1]), missing.alias(key[2]), F.col("size").alias(key[3]), *MIX_COLUMNS
    )
    last = [F.max(c).alias(c) for c in MIX_COLUMNS]
    named = docs.withColumns(dict(zip(key, (doc_key(), source, missing, word_count(F.col("text"))))))
    return named.join(found.groupBy(*key).agg(*last), key).drop(*key)
