"""Per-row array arithmetic: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so a lambda over a long array does not work it out per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def total_int(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    """Inner product in double, always summed from the first position to the last."""
    return total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def gather(values: Column, positions: Column) -> Column:
    """Values at the given 0-based positions, in the order of the positions."""
    return F.transform(positions, lambda i: F.get(values, i))


def argmax(values: Column) -> Column:
    """0-based position of the largest value; the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    def normalise(shifted):
        return let(total(shifted), lambda s: F.transform(shifted, lambda e: e / s))

    return let(F.array_max(logits), lambda m: let(F.transform(logits, lambda x: F.exp(x - m)), normalise))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log of the softmax at the 0-based target position."""
    return let(
        F.array_max(logits),
        lambda m: m + F.log(total(F.transform(logits, lambda x: F.exp(x - m)))) - F.get(logits, target),
    )


def max_abs(values: Column) -> Column:
    return F.array_max(F.transform(values, lambda x: F.abs(x.cast("double"))))


def repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), times.cast("int"))


def kept_lengths(lengths: Column, budget: Column) -> Column:
    """How much of every part stays when the longest part gives way until all fit the budget.

    Equal to popping from the longest part, the first on ties, one element at a time. Levels above
    the budget cannot fit, so the search never grows with the text.
    """

    def fill(level, sizes):
        return F.aggregate(sizes, F.lit(0), lambda acc, v: acc + F.least(v, level))

    def with_level(sizes, level):
        spare = budget - fill(level, sizes)
        longer = F.size(F.filter(sizes, lambda v: v > level))
        return let(
            longer - spare,
            lambda skip: F.transform(
                sizes,
                lambda v, i: F.least(v, level)
                + F.when(
                    (v > level) & (F.size(F.filter(F.slice(sizes, 1, i + 1), lambda u: u > level)) > skip), 1
                ).otherwise(0),
            ),
        )

    def level_of(sizes):
        candidates = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.array_max(sizes), budget)))
        return F.array_max(F.filter(candidates, lambda x: fill(x, sizes) <= budget))

    return let(
        lengths,
        lambda sizes: F.when(total_int(sizes) <= budget, sizes).otherwise(
            let(level_of(sizes), lambda level: with_level(sizes, level))
        ),
    )
