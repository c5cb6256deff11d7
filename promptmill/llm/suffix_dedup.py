"""Repeated byte strings by suffix arrays built with two-stage sorting.

A string of `window` bytes is found by the smallest hash among its shorter grams: equal strings have
the same one, at the same place. Pieces of text around grams that occur once cannot repeat and stay
where they are. The other pieces meet by gram, and each meeting place builds a suffix array of its
distinct pieces: the suffixes smaller than their successors are sorted directly, the rest is induced
by scans over the buckets of first bytes, and common prefixes of neighbours tell which strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import as_doc_id, byte_hash, distinct_texts, first_copies, group_starts, slices_for, smallest_in_window, text_chunks
from promptmill.sources.storage import materialize

WINDOW, GRAM = 100, 32

# Entries and bytes that a task gathers before it hands them on.
GATHERED, GATHERED_BYTES = 1 << 22, 32 << 20
# Bytes of pieces in one suffix array; the pieces of one gram stay together.
ARRAY_BYTES = 1 << 20
# A gram with more places, in all or in one task, is dealt by whole strings instead, so that no task gets it all.
MOST_PLACES, MOST_IN_TASK = 16384, 256


def _runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive strings with the same smallest gram: its hash, first start, number of strings, row."""
    hashes = byte_hash(data).windows(gram)
    place = smallest_in_window(hashes, window - gram + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    starts = np.flatnonzero(ends - np.arange(len(place)) >= window)
    if not len(starts):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    anchor = place[starts]
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    first = starts[new]
    return hashes[anchor[new]], first, np.diff(np.r_[new, len(starts)]), np.searchsorted(offsets, first, "right") - 1


def _emit_grams(window: int, gram: int, slices: int, most_in_task: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task: the grams of its texts, with their documents and number of places.

    Of a gram that is very frequent here, the documents are settled here (`known`), and one is handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = np.asarray(batch.column("doc"))
            for lo, _, data, offsets in text_chunks(batch):
                found, _, _, rows = _runs(data, offsets, window, gram)
                hashes.append(found)
                docs.append(ids[rows + lo])
                held += len(found)
                if held >= GATHERED:
                    yield _dealt(hashes, docs, slices, most_in_task)
                    hashes, docs, held = [], [], 0
        if held:
            yield _dealt(hashes, docs, slices, most_in_task)

    return run


_DEALT = "slice int, hashes binary, docs binary, counts binary, known_hashes binary, known_docs binary"


def _dealt(hashes: list[np.ndarray], docs: list[np.ndarray], slices: int, most_in_task: int) -> pa.RecordBatch:
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    cuts = group_starts(h)
    sizes = np.diff(cuts)
    first = np.zeros(len(h), bool)
    first[cuts[:-1]] = True
    count = np.zeros(len(h), np.uint32)
    count[cuts[:-1]] = sizes
    frequent = np.repeat(sizes > most_in_task, sizes)
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    known_h, known_d = h[new & frequent], d[new & frequent]
    sent = first | new & ~frequent
    h, d, count = h[sent], d[sent], count[sent]
    to = (h >> np.uint64(33)) % np.uint64(slices)
    order = np.argsort(to, kind="stable")
    h, d, count, to = h[order], d[order], count[order], to[order]
    cuts = group_starts(to)
    known = np.linspace(0, len(known_h), len(cuts)).astype(np.int64)
    columns = list(
        zip(
            *[
                (int(to[a]), h[a:b].tobytes(), d[a:b].tobytes(), count[a:b].tobytes(), known_h[x:y].tobytes(), known_d[x:y].tobytes())
                for a, b, x, y in zip(cuts[:-1], cuts[1:], known[:-1], known[1:])
            ]
        )
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
        ["slice", "hashes", "docs", "counts", "known_hashes", "known_docs"],
    )


def _settle(most: int, most_in_task: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One slice: the documents of each gram that has several places, and whether it is very frequent."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
        d = np.frombuffer(b"".join(rows["docs"]), np.int64)
        count = np.frombuffer(b"".join(rows["counts"]), np.uint32).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, d, count = h[order], d[order], count[order]
        cuts = group_starts(h)
        sizes = np.diff(cuts)
        total = np.add.reduceat(count, cuts[:-1]) if len(h) else count
        largest = np.maximum.reduceat(count, cuts[:-1]) if len(h) else count
        several = np.repeat(total > 1, sizes)
        frequent = np.repeat((total > most) | (largest > most_in_task), sizes)
        known_h = np.frombuffer(b"".join(rows["known_hashes"]), np.uint64)
        known_d = np.frombuffer(b"".join(rows["known_docs"]), np.int64)
        return pd.DataFrame(
            {
                "doc": np.r_[d[several], known_d],
                "mark": np.r_[h[several], known_h].astype(np.int64),
                "frequent": np.r_[frequent[several], np.ones(len(known_h), bool)],
            }
        )

    return run


class _Pieces:
    """Distinct pieces of a task, each under its earliest place; the other places are covered at once."""

    schema = "gram long, doc long, row_key long, start long, strings int, piece binary"

    def __init__(self, window: int):
        self.window = window
        self.best: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        self.covered: list[tuple[int, int, int, int, int, bytes | None]] = []
        self.bytes = 0

    def add(self, gram: int, doc: int, row_key: int, start: int, piece: bytes) -> None:
        place, key = (doc, start, row_key), (gram, piece)
        old = self.best.get(key)
        if old is None:
            self.best[key] = place
            self.bytes += len(piece) + 64
            return
        if place[:2] == old[:2]:  # a repeated row, or another text of the same doc_id
            if place != old:
                self.covered.append((gram, doc, row_key, start, len(piece) - self.window + 1, piece))
            return
        later = max(place, old)
        if place < old:
            self.best[key] = place
        self.covered.append((gram, later[0], later[2], later[1], len(piece) - self.window + 1, None))

    def _merged(self) -> list[tuple[int, int, int, int, int, bytes | None]]:
        """Covered places; those that follow each other in one text are one."""
        merged: list[tuple[int, int, int, int, int, bytes | None]] = [c for c in self.covered if c[5] is not None]
        last = None
        for g, doc, key, start, strings, _ in sorted((c for c in self.covered if c[5] is None), key=lambda c: c[1:4]):
            if last and last[1:3] == (doc, key) and start <= last[3] + last[4]:
                last = (*last[:4], max(last[4], start + strings - last[3]), None)
            else:
                merged += [last] if last else []
                last = (g, doc, key, start, strings, None)
        return merged + ([last] if last else [])

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [(g, p[0], p[2], p[1], len(t) - self.window + 1, t) for (g, t), p in self.best.items()] + self._merged()
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["gram", "doc", "row_key", "start", "strings", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        self.best, self.covered, self.bytes = {}, [], 0


def _text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return byte_hash(data).of(offsets[:-1], offsets[1:]).astype(np.int64)


def _emit_pieces(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task: the pieces around grams that occur more than once; of very frequent grams, single strings under their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(window)
        for batch in batches:
            ids = np.asarray(batch.column("doc"))
            for lo, hi, data, offsets in text_chunks(batch):
                found, first, strings, rows = _runs(data, offsets, window, gram)
                paired = _paired(found, rows)
                wanted = np.flatnonzero(np.isin(paired, _listed(batch.column("marks"), lo, hi)))
                if not len(wanted):
                    continue
                frequent = np.isin(paired, _listed(batch.column("frequent"), lo, hi))
                keys, raw = _text_keys(data, offsets), data.tobytes()
                whole = byte_hash(data).windows(window).astype(np.int64) if frequent.any() else None
                signed = found.astype(np.int64)
                for i in wanted:
                    a, n, row = int(first[i]), int(strings[i]), int(rows[i])
                    place = int(ids[row + lo]), int(keys[row])
                    base = int(offsets[row])
                    if frequent[i]:
                        for start in range(a, a + n):
                            pieces.add(int(whole[start]), *place, start - base, raw[start : start + window])
                    else:
                        pieces.add(int(signed[i]), *place, a - base, raw[a : a + n - 1 + window])
                if pieces.bytes > GATHERED_BYTES:
                    yield from pieces.flush()
        yield from pieces.flush()

    return run


def _paired(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return values + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _listed(lists: pa.ListArray, lo: int, hi: int) -> np.ndarray:
    own = lists.slice(lo, hi - lo)
    lengths = np.asarray(own.value_lengths().fill_null(0))
    return _paired(np.asarray(own.flatten()).astype(np.uint64), np.repeat(np.arange(hi - lo), lengths))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of uint8 `text`, ordered by their first `depth` bytes at least.

    Suffixes smaller than their successors are sorted directly. The others follow from scans over the
    buckets in order of the first byte: the predecessor of each suffix met, if it is larger, is the
    next of its own bucket.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(text.astype(np.int16)))
    # equal neighbours compare as the next unequal ones do; the last suffix is larger than nothing
    places = np.where(step != 0, np.arange(n - 1), n - 1)
    decided = np.minimum.accumulate(places[::-1])[::-1] if n > 1 else places
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.r_[step, -1][decided] > 0

    direct = np.flatnonzero(smaller)
    width = -(-depth // 8) * 8
    padded = np.r_[text, np.zeros(width, np.uint8)]
    keys = np.lib.stride_tricks.sliding_window_view(padded, width)[direct].view(f"S{width}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    by_first = np.searchsorted(text[direct], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    ordered: list[np.ndarray] = []
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == byte) & ~smaller[before]]
        bucket.append(direct[by_first[byte] : by_first[byte + 1]])
        met = np.concatenate(bucket)
        if not len(met):
            continue
        ordered.append(met)
        before = met[met > 0] - 1
        before = before[(text[before] > byte) & ~smaller[before]]
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        cuts = group_starts(text[before])
        for a, b in zip(cuts[:-1], cuts[1:]):
            waiting[text[before[a]]].append(before[a:b])
    return np.concatenate(ordered)


def common_prefixes(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, `depth` at most; the first has 0."""
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    found = np.zeros(len(starts), np.int64)
    for a in range(1, len(starts), 1 << 16):
        own = np.lib.stride_tricks.sliding_window_view(padded, depth)[starts[a - 1 : a + (1 << 16)]]
        differs = own[1:] != own[:-1]
        found[a : a + (1 << 16)] = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
    return found


def repeated_strings(pieces: list[bytes], strings: np.ndarray, rank_of: np.ndarray, window: int) -> np.ndarray:
    """For all strings of the pieces, one after the other, whether an equal one has a smaller rank."""
    lengths = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)  # no UTF-8 byte is 0xff
    at_piece = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    inside = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    starts = np.repeat(at_piece, strings) + inside
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = suffix_array(text, window)
    order = order[number[order] >= 0]
    new = np.flatnonzero(common_prefixes(text, order, window) < window)
    ranks = rank_of[number[order]]
    least = np.minimum.reduceat(ranks, new)
    repeated = np.zeros(len(starts), bool)
    repeated[number[order]] = ranks > np.repeat(least, np.diff(np.r_[new, len(order)]))
    return repeated


def _suffixes(window: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One slice: covered ranges of its pieces."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        settled = rows[rows["piece"].isna()]
        found = [(settled["doc"].to_numpy(), settled["row_key"].to_numpy(), settled["start"].to_numpy(), (settled["start"] + settled["strings"] - 1 + window).to_numpy())]
        rows = rows[rows["piece"].notna()].sort_values(["gram", "doc", "start"], kind="stable")
        size = rows["piece"].str.len().to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        grams = group_starts(rows["gram"].to_numpy())
        volume = np.r_[0, np.cumsum(size)]
        lo = 0
        while lo < len(grams) - 1:
            hi = int(np.searchsorted(volume[grams], volume[grams[lo]] + ARRAY_BYTES, "right")) - 1
            hi = min(max(hi, lo + 1), len(grams) - 1)
            own = rows.iloc[grams[lo] : grams[hi]]
            lo = hi
            strings = own["strings"].to_numpy(np.int64)
            doc, key, start = (np.repeat(own[c].to_numpy(np.int64), strings) for c in ("doc", "row_key", "start"))
            start = start + np.arange(len(start)) - np.repeat(np.cumsum(strings) - strings, strings)
            order = np.lexsort((start, doc))
            new = np.r_[False, (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new)
            covered = np.flatnonzero(repeated_strings(list(own["piece"]), strings, rank, window))
            if not len(covered):
                continue
            piece = np.repeat(np.arange(len(own)), strings)[covered]
            begins = np.r_[True, (np.diff(covered) > 1) | (piece[1:] != piece[:-1])]
            last = covered[np.r_[begins[1:], True]]
            first = covered[begins]
            found.append((doc[first], key[first], start[first], start[last] + window))
        doc, key, start, end = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        return pd.DataFrame({"doc": doc, "row_key": key, "start": start, "end": end})

    return run


def covered_ranges(texts: DataFrame, slices: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`doc, row_key, start, end`: byte ranges of `doc, text` covered by strings that also start earlier; ranges may overlap."""
    dealt = texts.mapInArrow(_emit_grams(window, gram, slices, MOST_IN_TASK), _DEALT)
    settled = dealt.groupBy("slice").applyInPandas(_settle(MOST_PLACES, MOST_IN_TASK), "doc long, mark long, frequent boolean")
    marks = settled.groupBy("doc").agg(
        F.collect_list("mark").alias("marks"), F.collect_list(F.when(F.col("frequent"), F.col("mark"))).alias("frequent")
    )
    pieces = texts.join(marks.hint("merge"), "doc").mapInArrow(_emit_pieces(window, gram), _Pieces.schema)
    # covered places need no meeting: they are spread by document
    key = F.when(F.col("piece").isNull(), F.xxhash64("doc", "start")).otherwise(F.xxhash64("gram"))
    dealt = pieces.withColumn("slice", F.pmod(key, F.lit(slices)))
    return dealt.groupBy("slice").applyInPandas(_suffixes(window), "doc long, row_key long, start long, end long")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: bytes outside all ranges, of each text."""
    for batch in batches:
        ranges = batch.column("ranges")
        for lo, hi, data, offsets in text_chunks(batch):
            keys, raw = _text_keys(data, offsets), data.tobytes()
            own = ranges.slice(lo, hi - lo)
            rows = np.repeat(np.arange(hi - lo), np.asarray(own.value_lengths().fill_null(0)))
            flat = own.flatten()
            same = np.asarray(flat.field("row_key")) == keys[rows] if len(rows) else np.zeros(0, bool)
            edge = np.zeros(len(data) + 1, np.int64)
            if same.any():
                np.add.at(edge, np.asarray(flat.field("start"))[same] + offsets[rows[same]], 1)
                np.add.at(edge, np.asarray(flat.field("end"))[same] + offsets[rows[same]], -1)
            covered = np.cumsum(edge[:-1]) > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            begins[inner] = covered[inner]
            removed = np.diff(np.r_[0, np.cumsum(covered)][offsets])
            spans = np.diff(np.r_[0, np.cumsum(begins)][offsets])
            kept = data[~covered].tobytes()
            cuts = np.r_[0, np.cumsum(~covered)][offsets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").slice(lo, hi - lo),
                    pa.array([hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                    pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                    pa.array([kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ],
                ["doc", "text_key", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def without_repeats(docs: DataFrame, copies: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each distinct text, under its smallest doc, without repeated strings: `doc, text_key, n_bytes, n_removed, n_spans, kept`."""
    texts = distinct_texts(docs, copies)
    ranges = covered_ranges(texts, slices_for(docs), window, gram)
    lists = ranges.groupBy("doc").agg(F.collect_list(F.struct("row_key", "start", "end")).alias("ranges"))
    return texts.join(lists.hint("merge"), "doc", "left").mapInArrow(
        _kept, "doc long, text_key binary, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Bytes covered by a string of `window` bytes that also starts earlier, removed; reads `doc_id, text`.

    Returns one row per input row: `doc_id, n_bytes, n_removed, n_spans, kept_sha256`. Earlier means in a document
    with a smaller doc_id, or before in the same one. A null text counts as empty. A null doc_id counts as
    the largest. Rows that repeat a doc_id are the same document, each judged by its own text; rows equal in doc_id and
    text are one. Of equal texts all but the one with the smallest doc_id lose every byte, if they have a string at
    all. Other columns are not read. An empty table gives no rows.
    """
    copies = first_copies(docs)
    unique = without_repeats(docs, copies, window, gram).select(
        F.col("doc").alias("first"), "text_key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    ).dropDuplicates(["first", "text_key"])
    rows = copies.join(materialize(unique, "unique-texts"), ["first", "text_key"])
    own = F.col("doc") == F.col("first")
    long_ = F.col("n_bytes") >= window
    return rows.select(
        as_doc_id(F.col("doc")).alias("doc_id"), "n_bytes",
        F.when(own, F.col("n_removed")).when(long_, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(own, F.col("n_spans")).when(long_, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(own, F.col("kept_sha256")).when(long_, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("text_key"))).alias("kept_sha256"),
    )
