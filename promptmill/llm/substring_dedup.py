"""Repeated passages by level-wise doubling of word windows.

A window of `window` words can repeat only if the shorter windows in it do. So short windows are
looked up first, and only where they repeat are windows of twice that length formed, up to the wanted
one, which is compared by 128 bits. Of the short windows inside one wanted window, the one with the smallest hash stands for all:
equal windows choose the same one, so nothing is lost and few are looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import (
    RollingHash, Words, as_doc_id, distinct_texts, first_copies, group_starts, slices_for, smallest_in_window, text_chunks,
)
from promptmill.sources.storage import materialize

WINDOW = 13

# Hashes that a task gathers before it hands them on.
GATHERED = 1 << 22


def levels(window: int) -> list[int]:
    """Lengths to look up: half the window (rounded up), or shorter, doubled until the window is reached."""
    length = window
    while length > 12:
        length = -(-length // 2)
    found = [length]
    while found[-1] < window:
        found.append(min(2 * found[-1], window))
    return found


def _marked(words: Words, grams: RollingHash, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each wanted window: whether it lies in one text, where its smallest gram of `length` words is, and all gram hashes."""
    whole = words.whole(window)
    gram = grams.windows(length)
    place = smallest_in_window(gram, window - length + 1)[: len(whole)]
    return whole, place, gram


def _listed_mask(values: np.ndarray, rows: np.ndarray, lists: pa.ListArray, lo: int, hi: int) -> np.ndarray:
    """Whether each value is in the list of its row."""
    own = lists.slice(lo, hi - lo)
    lengths = np.asarray(own.value_lengths().fill_null(0))
    flat = np.asarray(own.flatten()).astype(np.uint64)
    if not len(flat) or not len(values):
        return np.zeros(len(values), bool)
    # pairs of row and value, as one mixed number
    salt = np.uint64(0x9E3779B97F4A7C15)
    known = flat + np.repeat(np.arange(hi - lo, dtype=np.uint64), lengths) * salt
    return np.isin(values + rows.astype(np.uint64) * salt, known)


def _emit(length: int, before: int | None, window: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task: hashes of the windows of `length` words that are still in question, dealt by slice.

    A hash that several documents of one task have is handed on once, under the smallest doc; the
    others are settled here (`known`). So a very frequent window makes one entry per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        checks: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = np.asarray(batch.column("doc"))
            for lo, hi, data, offsets in text_chunks(batch):
                words = Words(data, offsets)
                grams = RollingHash(words.hashes(data))
                open_, place, gram = _marked(words, grams, length, window)
                if before is not None:
                    _, at, short = _marked(words, grams, before, window)
                    open_ = open_ & _listed_mask(short[at], words.rows[: len(at)], batch.column("marks"), lo, hi)
                chosen = np.unique(place[open_])
                hashes.append(gram[chosen])
                if length == window:
                    checks.append(RollingHash(words.hashes(data, 1)).windows(length)[chosen])
                docs.append(ids[words.rows[chosen] + lo])
                held += len(chosen)
                if held >= GATHERED:
                    yield _dealt(hashes, checks, docs, slices)
                    hashes, checks, docs, held = [], [], [], 0
        if held:
            yield _dealt(hashes, checks, docs, slices)

    return run


_DEALT = "slice int, hashes binary, checks binary, docs binary, known_hashes binary, known_docs binary"


def _dealt(hashes: list[np.ndarray], checks: list[np.ndarray], docs: list[np.ndarray], slices: int) -> pa.RecordBatch:
    """Entries by slice. Only the last level has checks, the second half of its hashes."""
    last = bool(checks)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    c = np.concatenate(checks) if last else np.zeros(len(h), np.uint64)
    order = np.lexsort((d, c, h))
    h, c, d = h[order], c[order], d[order]
    other = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    new = np.r_[True, other | (d[1:] != d[:-1])]
    h, c, d = h[new], c[new], d[new]
    first = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    # at the last level only later documents are marked, before it all that share a window
    shared = ~first if last else ~first | np.r_[~first[1:], False]
    known_h, known_d = h[shared], d[shared]
    h, c, d = h[first], c[first], d[first]
    to = (h >> np.uint64(33)) % np.uint64(slices)
    order = np.argsort(to, kind="stable")
    h, c, d, to = h[order], c[order], d[order], to[order]
    cuts = group_starts(to)
    known_to = np.linspace(0, len(known_h), len(cuts)).astype(np.int64)
    pieces = [
        (int(to[a]), h[a:b].tobytes(), c[a:b].tobytes() if last else b"", d[a:b].tobytes(), known_h[x:y].tobytes(), known_d[x:y].tobytes())
        for a, b, x, y in zip(cuts[:-1], cuts[1:], known_to[:-1], known_to[1:])
    ]
    columns = list(zip(*pieces))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *(pa.array(column, pa.binary()) for column in columns[1:])],
        ["slice", "hashes", "checks", "docs", "known_hashes", "known_docs"],
    )


def _settle(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One slice: the documents of each hash that is in more than one of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
        d = np.frombuffer(b"".join(rows["docs"]), np.int64)
        c = np.frombuffer(b"".join(rows["checks"]), np.uint64) if last else np.zeros(len(h), np.uint64)
        order = np.lexsort((d, c, h))
        h, c, d = h[order], c[order], d[order]
        cuts = np.r_[0, np.flatnonzero((h[1:] != h[:-1]) | (c[1:] != c[:-1])) + 1, len(h)] if len(h) else np.zeros(1, np.int64)
        sizes = np.diff(cuts)
        smallest = np.repeat(d[cuts[:-1]], sizes)
        largest = np.repeat(d[cuts[1:] - 1], sizes)
        marked = d > smallest if last else largest > smallest
        known_h = np.frombuffer(b"".join(rows["known_hashes"]), np.uint64)
        known_d = np.frombuffer(b"".join(rows["known_docs"]), np.int64)
        return pd.DataFrame({"doc": np.r_[d[marked], known_d], "mark": np.r_[h[marked], known_h].astype(np.int64)})

    return run


def _joined(data: np.ndarray, offsets: np.ndarray, words: Words, keep: np.ndarray) -> list[bytes]:
    """The wanted words of each row, joined by one space."""
    starts, ends, rows = words.starts[keep], words.ends[keep], words.rows[keep]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    wanted = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    spaces = starts[1:][rows[1:] == rows[:-1]] - 1
    wanted[spaces] = True
    text = data.copy()
    text[spaces] = 0x20
    out = text[wanted].tobytes()
    cuts = np.r_[0, np.cumsum(wanted)][offsets]
    return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _kept(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task: words outside marked windows, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                words = Words(data, offsets)
                grams = RollingHash(words.hashes(data)).windows(window)
                whole = words.whole(window)
                hit = np.flatnonzero(whole & _listed_mask(grams, words.rows[: len(grams)], batch.column("marks"), lo, hi))
                edge = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                raw = data.tobytes()
                n_words = np.diff(words.first)
                n_removed = np.diff(np.r_[0, np.cumsum(covered)][words.first])
                kept = _joined(data, offsets, words, ~covered)
                whole_text = [hashlib.sha256(t).hexdigest() for t in _joined(data, offsets, words, np.ones(len(covered), bool))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(lo, hi - lo),
                        pa.array([hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                        pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()), pa.array(whole_text),
                    ],
                    ["doc", "text_key", "n_words", "n_removed", "kept_text", "whole_sha256"],
                )

    return run


def repeated_words(docs: DataFrame, copies: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each distinct text without the words of windows that start in a document with a smaller doc_id.

    One row per distinct text, under its smallest doc: `doc, text_key, n_words, n_removed, kept_text, whole_sha256`.
    """
    texts = distinct_texts(docs, copies)
    slices = slices_for(docs)
    marks, before = None, None
    for length in levels(window):
        source = texts if marks is None else texts.join(marks.hint("merge"), "doc", "left")
        dealt = source.mapInArrow(_emit(length, before, window, slices), _DEALT)
        settled = dealt.groupBy("slice").applyInPandas(_settle(length == window), "doc long, mark long")
        marks = settled.groupBy("doc").agg(F.collect_list("mark").alias("marks"))
        before = length
    return texts.join(marks.hint("merge"), "doc", "left").mapInArrow(
        _kept(window), "doc long, text_key binary, n_words long, n_removed long, kept_text string, whole_sha256 string"
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words that repeat in a window of an earlier document, removed; reads `doc_id, text`.

    Returns one row per input row: `doc_id, n_words, n_removed, kept_sha256`. A null text has no words.
    A null doc_id counts as the largest. Rows that repeat a doc_id are the same document: they are not
    earlier than one another, and each is judged by its own text. Of equal texts, the one with the
    smallest doc_id is earlier than the others, which lose every word if they have a window at all.
    Other columns are not read. An empty table gives no rows.
    """
    copies = first_copies(docs)
    unique = repeated_words(docs, copies, window).select(
        F.col("doc").alias("first"), "text_key", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "whole_sha256"
    ).dropDuplicates(["first", "text_key"])
    # stored, so that the join is one of two plain tables, in which Spark splits a large group of copies
    rows = copies.select("doc", "first", "text_key").join(materialize(unique, "unique-texts"), ["first", "text_key"])
    own = F.col("doc") == F.col("first")
    nothing = F.sha2(F.lit(""), 256)
    covered = F.col("n_words") >= window
    return rows.select(
        as_doc_id(F.col("doc")).alias("doc_id"), "n_words",
        F.when(own, F.col("n_removed")).when(covered, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(own, F.col("kept_sha256")).when(covered, nothing).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
    )
