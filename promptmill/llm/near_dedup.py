"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

Every shingle ranks all places of a signature by one random permutation, so the ranks of an element
are spread evenly and signatures vary less than with independent hashes; a text is finished as soon as
no later rank can win. Texts with an equal band are candidates. Candidates are compared on their
full shingle sets, group by group, and links are joined by union-find in tasks and by star
contraction between them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import RollingHash, Words, as_doc_id, doc_key, free_names, group_starts, mix, slices_for, text_chunks, text_key
from promptmill.sources.storage import materialize

SHINGLE = 5
# Documents are linked from this many hundredths of the union of their sets on; op7 asks for 85.
PERCENT = 80
# A pair at the threshold shares no band with this chance at most, or 4 in a million.
MISS = 4.3e-6
# Shingles that one side of a comparing task holds, about, but for one longer text.
SIDE_SHINGLES = 1 << 16

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _step(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLDEN) % (1 << 64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    data = _FOLD[data]
    words = Words(data, offsets)
    grams = RollingHash(words.hashes(data))
    ok = words.whole(SHINGLE)
    hashes, rows = grams.windows(SHINGLE)[ok], words.rows[: len(ok)][ok]
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        hashes = np.r_[hashes, grams.of(words.first[short], words.first[short + 1])]
        rows = np.r_[rows, short]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def superminhash(hashes: np.ndarray, cuts: np.ndarray, places: int) -> np.ndarray:
    """A signature of each set: for each place the smallest (rank, random value) of any element.

    In round j every element gives its j-th place the value (j, random). A set that has a smaller value
    than (j, 0) in every place takes part no more.
    """
    n_rows = len(cuts) - 1
    signature = np.full((n_rows, places), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = signature.reshape(-1)
    rows = np.repeat(np.arange(n_rows), np.diff(cuts))
    order = np.tile(np.arange(places, dtype=np.uint16), (len(hashes), 1))
    line = np.arange(len(hashes))
    for j in range(places):
        if not len(hashes):
            break
        value = (mix(hashes + _step(2 * j + 1)) >> np.uint64(16)) | (np.uint64(j) << np.uint64(48))
        pick = j + (((mix(hashes + _step(2 * j + 2)) >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        place = order[line, pick].astype(np.int64)
        order[line, pick] = order[line, j]
        np.minimum.at(flat, rows * places + place, value)
        open_ = signature.max(axis=1) >= np.uint64((j + 1) << 48) if j + 1 < places else np.zeros(n_rows, bool)
        go_on = open_[rows]
        if not go_on.all():
            hashes, rows, line = hashes[go_on], rows[go_on], line[go_on]
    return signature


def banding(percent: int) -> tuple[int, int]:
    """Bands and places of each for a threshold: (32, 7) at 85, (41, 6) at 80.

    A band is equal by chance t**rows at the threshold t. Rows are as many as leave a quarter, 7 at most; bands
    as many as (1 - t**rows)**bands needs to be no more than MISS.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be in 1 to 100, not {percent}")
    t = percent / 100
    rows = 7 if percent == 100 else max(1, min(7, math.floor(math.log(0.25) / math.log(t))))
    return 1 if percent == 100 else math.ceil(math.log(MISS) / math.log(1 - t**rows)), rows


def _bands(hashes: np.ndarray, cuts: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """Band keys of each set, a row of n_bands; sets are signed a few at a time."""
    out = np.zeros((len(cuts) - 1, n_bands), np.uint64)
    lo = 0
    while lo < len(cuts) - 1:
        hi = int(np.searchsorted(cuts, cuts[lo] + (1 << 16), "right")) - 1
        hi = min(max(hi, lo + 1), len(cuts) - 1)
        signature = superminhash(hashes[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], n_bands * n_rows)
        for band in range(n_bands):
            key = np.full(hi - lo, band + 1, np.uint64)
            for k in range(band * n_rows, (band + 1) * n_rows):
                key = mix(key * _GOLDEN + signature[:, k])
            out[lo:hi, band] = key
        lo = hi
    return out


def _sign(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_bands, n_rows = banding(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                hashes, cuts = shingle_sets(data, offsets)
                keys = _bands(hashes, cuts, n_bands, n_rows).astype(np.int64)
                raw = hashes.tobytes()
                digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:])]
                flat = pa.array(keys.reshape(-1))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc"), own.column("text_key"), pa.array(np.diff(cuts), pa.int64()), pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * n_bands), flat),
                    ],
                    ["doc", "text_key", "n_shingles", "digest", "bands"],
                )

    return sign


def components(edges: DataFrame) -> DataFrame:
    """`node, component` of every node of `a, b`; component is the smallest node that can be reached.

    Large and small stars in turn: every node hangs its larger neighbours, then its smaller ones, on its
    smallest neighbour, until nothing changes. Each round is written and read back.
    """
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(ordered, "edges")
    state = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = seen
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(smallest, "a")
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))
        current = materialize(small.distinct(), "edges")


class _Forest:
    """Union-find over places of a list."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> _Forest:
    """Union-find of all sets whose intersection is `percent` hundredths of their union; every pair that shares an element is counted."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    cuts = group_starts(flat[order])
    counts = np.diff(cuts)
    postings = owner[order]
    element = np.empty(len(flat), np.int64)
    element[order] = np.repeat(np.arange(len(counts)), counts)
    shared = counts[element] > 1
    starts = np.r_[0, np.cumsum(sizes)]
    forest = _Forest(len(sets))
    for i in range(len(sets)):
        own = element[starts[i] : starts[i + 1]][shared[starts[i] : starts[i + 1]]]
        lengths = counts[own]
        if not len(own):
            continue
        at = np.repeat(cuts[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        both = np.bincount(postings[at], minlength=len(sets))
        both[: i + 1] = 0
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[i] + sizes - both))):
            forest.join(i, int(j))
    return forest


def _verify(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of all comparing tasks of one slice, as edges to the smallest linked node."""
    found_a, found_b = [], []
    for _, own in rows.groupby("task", sort=False):
        own = own.sort_values("node", kind="stable")
        if len(own) < 2:
            continue
        nodes = own["node"].to_numpy()
        forest = linked([np.frombuffer(s, np.uint64) for s in own["shingles"]], percent)
        roots = nodes[[forest.root(i) for i in range(len(nodes))]]
        far = roots != nodes
        found_a.append(nodes[far])
        found_b.append(roots[far])
    empty = [np.zeros(0, np.int64)]
    return pd.DataFrame({"a": np.concatenate(found_a or empty), "b": np.concatenate(found_b or empty)})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch):
            hashes, cuts = shingle_sets(data, offsets)
            raw = hashes.tobytes()
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column("node"), own.column("tasks"), pa.array([raw[8 * a : 8 * b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                ["node", "tasks", "shingles"],
            )


def comparing_tasks(candidates: DataFrame, percent: int) -> DataFrame:
    """`node, tasks` from `node, n_shingles, group`: in which comparing tasks each node takes part.

    A group whose sets fit one task is one. A larger one is cut by size class, where only equal and
    neighbouring classes can reach the threshold, and each class into blocks; every pair of blocks is a task.
    """
    whole = candidates.groupBy("group").agg(F.sum("n_shingles").alias("group_shingles"))
    sized = candidates.join(whole, "group").withColumn(
        "class",
        F.when(F.col("group_shingles") <= SIDE_SHINGLES, F.lit(0)).otherwise(
            F.floor(F.log(F.col("n_shingles").cast("double")) / float(-np.log(min(percent, 99) / 100))) + 1
        ).cast("int"),
    )
    classes = sized.groupBy("group", "class").agg(F.ceil(F.sum("n_shingles") / SIDE_SHINGLES).cast("int").alias("blocks"))
    above = classes.select("group", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = classes.select("group", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    known = classes.join(above, ["group", "class"], "left").join(below, ["group", "class"], "left").fillna(0, ["above", "below"])
    placed = sized.join(known, ["group", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = F.expr(
        "concat("
        " transform(sequence(0, blocks - 1), k -> xxhash64(group, class, 'same', least(k, block), greatest(k, block))),"
        " if(above > 0, transform(sequence(0, above - 1), k -> xxhash64(group, class, 'next', block, k)), cast(array() as array<bigint>)),"
        " if(below > 0, transform(sequence(0, below - 1), k -> xxhash64(group, class - 1, 'next', k, block)), cast(array() as array<bigint>)))"
    )
    return placed.select("node", tasks.alias("tasks"))


def _linked_sets(docs: DataFrame, percent: int, through_doc: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, nodes and components of nodes of `doc_id, text`.

    Rows are `doc, text_key, n_shingles, digest, bands`. Rows with equal sets are one node, `digest, doc, text_key, bands, n_shingles, node`,
    which stands for all of them under the smallest doc that has it; nodes are numbered in the order of (doc, digest). Components are
    `node, component` of nodes with links, component the smallest node. With `through_doc`, rows of one doc are linked, too.
    """
    texts = docs.select(doc_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", text_key(F.col("text")))
    signed = texts.mapInArrow(_sign(percent), "doc long, text_key binary, n_shingles long, digest binary, bands array<long>")
    signed = materialize(signed, "signatures")
    filled = signed.where("n_shingles > 0")
    least = filled.groupBy("digest").agg(F.min(F.struct("doc", "text_key", "bands", "n_shingles")).alias("least"))
    ordered = least.select("digest", "least.*").sort("doc", "digest")
    nodes = materialize(ordered.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last")
    stars = keys.join(buckets, "key").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = components(stars)

    candidates = groups.join(nodes.select("node", "n_shingles"), "node").select("node", "n_shingles", F.col("component").alias("group"))
    tasks = comparing_tasks(candidates, percent).join(nodes.select("node", "doc", "text_key"), "node")
    tasks = materialize(tasks, "comparing-tasks")
    # One text of each node: rows that repeat a doc and its text are one.
    read = texts.join(tasks.hint("merge"), ["doc", "text_key"]).select("node", "tasks", "text")
    sets = read.mapInArrow(_sets, "node long, tasks array<long>, shingles binary")
    dealt = sets.select("node", "shingles", F.explode("tasks").alias("task"))
    sliced = dealt.withColumn("slice", F.pmod("task", F.lit(slices_for(docs))))
    links = sliced.groupBy("slice").applyInPandas(lambda rows: _verify(rows, percent), "a long, b long")
    if through_doc:
        named = filled.select("doc", "digest").distinct().join(nodes.select("digest", "node"), "digest").select("doc", "node")
        named = materialize(named, "doc-nodes")
        several = named.groupBy("doc").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last")
        same = named.join(materialize(several, "repeated-docs"), "doc").where("node != first")
        links = links.unionByName(same.select(F.col("node").alias("a"), F.col("first").alias("b")))
    return signed, nodes, components(links)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by nearly equal shingle sets; reads `doc_id, text`.

    Two documents are linked if their sets share `percent` hundredths of their union. Returns one row per input row: `doc_id, n_shingles,
    component_id, kept`. Documents with equal sets are
    one node, which stands for all of them. A null text, or one without words, has an empty set, is
    linked with nothing, and is its own component. A null doc_id counts as the largest, and gives a null
    component_id where it is the smallest of its component. Rows that repeat a doc_id are one document: they are linked
    with each other through it. Other columns are not read. An empty table gives no rows.
    """
    signed, nodes, joined = _linked_sets(docs, percent, through_doc=True)
    firsts = nodes.select(F.col("node").alias("component"), F.col("doc").alias("component_doc"))
    placed = nodes.select("digest", "node", "doc").join(joined, "node", "left").join(firsts, "component", "left")
    placed = placed.select("digest", F.coalesce("component_doc", "doc").alias("component"))
    found = signed.join(materialize(placed, "set-components"), "digest", "left")
    found = found.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))
    return found.select(
        as_doc_id(F.col("doc")).alias("doc_id"), "n_shingles", as_doc_id(F.col("component")).alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )


def keep_representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: the document with the smallest doc_id, once.

    A document is a doc_id with its text. Different texts under one doc_id, or without one, are documents of their own and linked by
    their sets only. A text without words is linked with nothing; of rows that repeat a doc_id and its text one stays. Null texts are without words; an empty table
    gives no rows.
    """
    key = free_names(docs, "doc_key", "text_digest")
    pair = [F.col("doc").alias(key[0]), F.col("text_key").alias(key[1])]
    signed, nodes, joined = _linked_sets(docs, percent, through_doc=False)
    gone = joined.where("node != component").select("node")
    kept = nodes.join(gone, "node", "left_anti").select(*pair)
    wordless = signed.where("n_shingles = 0").select(*pair)
    kept = materialize(kept.unionByName(wordless.distinct()), "kept-documents")
    named = docs.withColumns(dict(zip(key, (doc_key(), text_key(F.col("text"))))))
    return named.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)
