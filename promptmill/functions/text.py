"""Text to tokens, and reproducible hash keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits run together; every other visible character stands alone.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Lower-cased word and punctuation tokens of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def sentiment_token(sentiment: Column) -> Column:
    """One extra feature token for the predicted sentiment; no text can produce it."""
    return F.concat(F.lit("<senti:"), sentiment.cast("string"), F.lit(">"))


def shuffle_key(*parts) -> Column:
    """An evenly spread hex key that any engine with md5 reproduces."""
    return F.md5(F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def key_range(key: Column, digits: int = 4) -> Column:
    """The leading hex digits of a shuffle key as a number: equal slices of the key order."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def unit_interval(key: Column) -> Column:
    """A shuffle key as a number in [0, 1): 52 bits of it, so the double is exact."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
