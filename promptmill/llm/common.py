"""Columns and numpy helpers that several corpus operators share.

Byte and word windows are compared by rolling hashes: a sum of byte (or word) values times powers of
an odd base, modulo 2**64, mixed at the end. Sums are taken once per chunk of texts, so the hash of
any window is a difference of two sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.sources.storage import materialize

# Fixed patterns of words. The first takes a text as it is, the second one with A-Z lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Texts that are hashed together in a task, in bytes; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.RandomState(20).randint(1, 2**63 - 1, (2, 256), dtype=np.int64).astype(np.uint64)
_powers: dict[int, np.ndarray] = {}


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of one byte a character take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """All matches of ALNUM_WORD in the lower-cased text, in order; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def scan_splits(df: DataFrame) -> int:
    """Number of partitions in which Spark reads a table; it grows with the input."""
    return df.rdd.getNumPartitions()


def slices_for(df: DataFrame) -> int:
    """Into how many groups hashes of a table are dealt: more for a larger table, never fewer than the shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * scan_splits(df))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


# Stands for a missing doc_id, which so counts as the largest.
NO_ID = (1 << 63) - 1


def doc_key(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(NO_ID).cast("long")).cast("long")


def as_doc_id(key: Column) -> Column:
    return F.when(key != NO_ID, key)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them; Spark does not tell upper from lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def first_copies(docs: DataFrame) -> DataFrame:
    """`doc, text_key, first, copies` of every row; `first` is the smallest doc with the same text.

    Both sides of the join are stored: of plain tables Spark splits a large group of copies.
    """
    keys = materialize(docs.select(doc_key().alias("doc"), text_key(F.col("text")).alias("text_key")), "text-keys")
    groups = keys.groupBy("text_key").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
    return keys.join(materialize(groups, "text-groups"), "text_key")


def distinct_texts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """`doc, text`: each text once, under the smallest doc that has it.

    The texts are dealt by doc, so a large group of copies is never in one place.
    """
    firsts = copies.where("doc = first").select("doc").distinct()
    texts = docs.select(doc_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(firsts.hint("merge"), "doc", "left_semi")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[: n + 1]


class RollingHash:
    """Hashes of any window of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.sums) - 1, _INVERSE)
        raw = (self.sums[ends] - self.sums[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of one size, by their start."""
        n = len(self.sums) - 1
        if n < size:
            return np.zeros(0, np.uint64)
        inverse = powers(n, _INVERSE)[: n - size + 1]
        return mix((self.sums[size:] - self.sums[: n - size + 1]) * inverse + np.uint64(size))


def byte_hash(data: np.ndarray, which: int = 0) -> RollingHash:
    """One of two hashes that have nothing in common but the base."""
    return RollingHash(_BYTE_VALUES[which][data])


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch: first row, end row, their UTF-8 bytes, and the offset of each row in them."""
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a chunk of texts: where they start and end in its bytes, and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE):
        inside = ~separator[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        #: of each row, its first word; one more for the end
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, data: np.ndarray, which: int = 0) -> np.ndarray:
        return byte_hash(data, which).of(self.starts, self.ends)

    def whole(self, size: int) -> np.ndarray:
        """For each window of so many words, whether it lies in one row."""
        n = len(self.rows) - size + 1
        return self.rows[size - 1 :] == self.rows[:n] if n > 0 else np.zeros(0, bool)


def smallest_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its smallest one, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place, span = values, np.arange(len(values), dtype=np.int64), 1
    while 2 * span <= width:
        take = best[span:] < best[:-span]
        place = np.where(take, place[span:], place[:-span])
        best = np.where(take, best[span:], best[:-span])
        span *= 2
    if span < width:
        rest = width - span
        take = best[rest:] < best[:-rest]
        place = np.where(take, place[rest:], place[:-rest])
    return place[:n]



def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, with the end appended."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, len(sorted_values)]
