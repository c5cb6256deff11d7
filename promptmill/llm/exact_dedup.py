"""Exact duplicates by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of its last bytes says so, hence equal texts are cut
alike. Chunks become identifiers that are verified on their bytes, and documents are compared by
their ordered lists of identifiers: the bytes of a chunk travel once, to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.common import _SPACE, as_doc_id, byte_hash, doc_key, free_names, group_starts, text_chunks
from promptmill.sources.storage import materialize

# White space that normalisation deletes.
BLANK = " \t\n\x0b\x0c\r"

# A cut depends on so many bytes before it; one byte in MEAN_CHUNK is a cut; no chunk is longer than LONGEST_CHUNK.
WINDOW, MEAN_CHUNK, LONGEST_CHUNK = 48, 4096, 65536


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of chunks in normalised texts that lie one after the other."""
    windows = byte_hash(data).windows(WINDOW)
    ends = np.flatnonzero((windows & np.uint64(MEAN_CHUNK - 1)) == 0) + WINDOW
    row = np.searchsorted(offsets, ends, "left") - 1
    ends = ends[ends - WINDOW >= offsets[row]]
    ends = np.union1d(ends, offsets[1:])
    ends = ends[ends > 0]
    starts = np.r_[0, ends[:-1]]
    extra = [np.arange(a + LONGEST_CHUNK, b, LONGEST_CHUNK) for a, b in zip(starts, ends) if b - a > LONGEST_CHUNK]
    return np.union1d(ends, np.concatenate(extra)) if extra else ends


def _chunk_rows(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch):
            keep = ~_SPACE[data]
            offsets = np.r_[0, np.cumsum(keep)][offsets]
            data = data[keep]
            ends = _cuts(data, offsets)
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            hashes = byte_hash(data).of(starts, ends).astype(np.int64)
            first = np.searchsorted(starts, offsets).astype(np.int32)
            if with_bytes:
                raw = data.tobytes()
                order = np.argsort(hashes, kind="stable")
                seen: set[tuple[int, bytes]] = set()
                for i in order:
                    seen.add((int(hashes[i]), raw[starts[i] : ends[i]]))
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([h for h, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.binary())],
                        ["chunk_hash", "chunk"],
                    )
            else:
                recipe = pa.ListArray.from_arrays(pa.array(first), pa.array(hashes))
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("row_key"), recipe], ["doc", "row_key", "recipe"])


def chunk_table(texts: DataFrame) -> DataFrame:
    """`chunk_hash, chunk`: every distinct chunk with its bytes, moved once."""
    pieces = texts.mapInArrow(lambda it: _chunk_rows(it, True), "chunk_hash long, chunk binary")
    return pieces.groupBy("chunk_hash", "chunk").agg(F.count("*").alias("times"))


def clashes(table: DataFrame, shared: DataFrame) -> DataFrame:
    """`chunk_hash, chunk, variant` of different chunks under one hash, numbered from 0."""
    variant = F.row_number().over(Window.partitionBy("chunk_hash").orderBy("chunk")) - 1
    return table.join(shared, "chunk_hash", "left_semi").select("chunk_hash", "chunk", variant.alias("variant"))


def recipes(texts: DataFrame) -> DataFrame:
    """`doc, row_key, recipe`: the ordered verified identifiers of each row of `doc, row_key, text`.

    A hash is an identifier when one chunk alone has it. Otherwise, which 64 bits make rare at any
    size, its documents are cut again and get the variant of each chunk as well.
    """
    # only hashes of several chunks are stored: nearly always none
    table = chunk_table(texts)
    shared = materialize(table.groupBy("chunk_hash").agg(F.count("*").alias("variants")).where("variants > 1"), "chunk-clashes")
    lists = texts.mapInArrow(lambda it: _chunk_rows(it, False), "doc long, row_key long, recipe array<long>")
    if shared.isEmpty():
        return lists.select("doc", "row_key", F.transform("recipe", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("variant"))).alias("recipe"))
    clashing = materialize(clashes(table, shared.select("chunk_hash")), "chunk-variants")
    chunks = texts.mapInArrow(_placed_chunks, "doc long, row_key long, place int, chunk_hash long, chunk binary")
    named = chunks.join(clashing, ["chunk_hash", "chunk"], "left")
    identifier = F.struct("place", F.struct(F.col("chunk_hash").alias("hash"), F.coalesce("variant", F.lit(0)).alias("variant")).alias("id"))
    ordered = named.groupBy("doc", "row_key").agg(F.array_sort(F.collect_set(identifier)).alias("ids"))
    return lists.select("doc", "row_key").distinct().join(ordered, ["doc", "row_key"], "left").select(
        "doc", "row_key", F.coalesce(F.expr("ids.id"), F.expr("cast(array() as array<struct<hash: bigint, variant: int>>)")).alias("recipe")
    )


def _placed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch):
            keep = ~_SPACE[data]
            offsets = np.r_[0, np.cumsum(keep)][offsets]
            data = data[keep]
            ends = _cuts(data, offsets)
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            rows = np.searchsorted(offsets, starts, "right") - 1
            bounds = group_starts(rows)
            place = np.arange(len(rows)) - np.repeat(bounds[:-1], np.diff(bounds))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(rows + lo)),
                    batch.column("row_key").take(pa.array(rows + lo)),
                    pa.array(place, pa.int32()),
                    pa.array(byte_hash(data).of(starts, ends).astype(np.int64)),
                    pa.array([raw[a:b] for a, b in zip(starts, ends)], pa.binary()),
                ],
                ["doc", "row_key", "place", "chunk_hash", "chunk"],
            )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are equal without white space; reads `doc_id, text`.

    Returns one row per input row: `doc_id, keep_id, group_size, kept, text_sha256`. The row with the
    most code points in its original text stays, of those the one with the smallest doc_id. A null
    text counts as empty, and all empty texts are equal. A null doc_id counts as the largest; if such
    a row stays, keep_id is null. Rows that repeat both doc_id and text all count in group_size and are
    kept or dropped together. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        doc_key().alias("doc"),
        F.xxhash64(text).alias("row_key"),
        F.length(text).cast("long").alias("points"),
        F.sha2(F.translate(text, BLANK, ""), 256).alias("text_sha256"),
    )
    lists = recipes(docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("row_key"), text.alias("text")))
    known = materialize(rows.join(lists.dropDuplicates(["doc", "row_key"]), ["doc", "row_key"]), "recipes")
    groups = known.groupBy("recipe").agg(
        F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("points"), "doc")).alias("best")
    )
    # stored, so that the join is one of two plain tables, in which Spark splits a large group of copies
    joined = known.join(materialize(groups, "recipe-groups"), "recipe")
    return joined.select(
        as_doc_id(F.col("doc")).alias("doc_id"),
        as_doc_id(F.col("best.doc")).alias("keep_id"),
        "group_size",
        ((F.col("doc") == F.col("best.doc")) & (F.col("points") == -F.col("best.points"))).alias("kept"),
        "text_sha256",
    )


def keep_unique(docs: DataFrame) -> DataFrame:
    """The rows of a table that stay, with all their columns; rows that repeat doc_id and text stay once.

    Null texts count as empty, a null doc_id as the largest; an empty table gives no rows.
    """
    key = free_names(docs, "doc_key", "text_digest")
    found = exact_duplicates(docs).where("kept").select(doc_key().alias(key[0]), F.col("text_sha256").alias(key[1])).distinct()
    named = docs.withColumns(dict(zip(key, (doc_key(), F.sha2(F.translate(F.coalesce("text", F.lit("")), BLANK, ""), 256)))))
    return named.join(found, key, "left_semi").dropDuplicates(key).drop(*key)
