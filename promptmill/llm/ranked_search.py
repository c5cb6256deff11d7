"""The best documents for each query by a ranked lexical score, found by best-first search over intervals of documents.

Documents are read in segments, ordered by doc_id. A segment has a posting list for each term of the queries: the documents
that hold it, with the impact that one occurrence of the term in a query has there. Over all lists lie sparse tables of range
maxima. An interval of documents is bounded by the sum, over a query's terms, of the largest impact in it. The interval with the highest
bound is split at the document of its largest impact, which is scored, until no interval can still hold one of the best; the documents
of an interval of few postings are all scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptmill.llm.common import NO_ID, Words, alnum_words, as_doc_id, doc_key, text_chunks
from promptmill.sources.storage import materialize

# Best documents of each query that are returned.
BEST = 20

# Terms of queries, repeats included, that are searched for in one pass over the documents.
BLOCK_TERMS = 1 << 18

# Postings of a segment at most, unless one document has more; it bounds the memory of a task.
SEGMENT_POSTINGS = 1 << 20

# Postings of an interval that is scored whole instead of being split on.
WHOLE_POSTINGS = 1024

# Bytes of text whose terms are found at once.
READ_BYTES = 2 << 20

# Fixed values of the score.
SCALE, FLAT, SLOPE, SATURATION, UNIT = 1000, 75, 25, 12, 1_000_000_000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The largest power of two in a length, as its exponent.
_LEVEL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int64) - 1
_POWER = np.int64(1) << np.arange(62, dtype=np.int64)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased terms of a chunk of texts as binary values, and the first term of each row with the end appended."""
    found = Words(data, offsets, _SEPARATOR)
    letters = _LOWER[data[~_SEPARATOR[data]]]
    cuts = np.zeros(len(found.starts) + 1, np.int32)
    np.cumsum(found.ends - found.starts, out=cuts[1:])
    return pa.Array.from_buffers(pa.binary(), len(found.starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]), found.first


def _counted(words: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a chunk; then row, code and number of occurrences for each term of each row, by row."""
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, tf = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(pairs, size)
    return coded.dictionary, row, code, tf


def statistics(docs: DataFrame) -> DataFrame:
    """`term, df` of every term; the row of the null term has in `df` the documents with terms, in `length` all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, size=READ_BYTES):
                words, first = _terms(data, offsets)
                terms, _, code, _ = _counted(words, first)
                df = np.bincount(code, minlength=len(terms))
                held = int(np.count_nonzero(np.diff(first)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([terms, pa.nulls(1, pa.binary())]),
                        pa.array(np.r_[df, held].astype(np.int64)),
                        pa.array(np.r_[np.zeros(len(terms)), len(words)].astype(np.int64)),
                    ],
                    ["term", "df", "length"],
                )

    found = docs.select("text").mapInArrow(count, "term binary, df long, length long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))


class Queries(NamedTuple):
    """Queries of a block: distinct terms with their weights, and for each query its terms with their repeats."""

    terms: pa.Array
    weights: np.ndarray
    number: list[int]
    of: list[tuple[np.ndarray, np.ndarray]]


class Segment:
    """Posting lists of the terms of some documents, with sparse tables of range maxima over all of them.

    `term, doc, impact` are sorted by term, then doc; docs are numbered from 0 in order of doc_id.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = n_docs
        self.doc, self.impact = doc, impact
        self.base = np.arange(n_terms, dtype=np.int64) * (n_docs + 1)
        self.keys = self.base[term] + doc
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        longest = int(np.diff(self.first).max(initial=0))
        # row k: the place of the largest impact among 2**k postings from each one on, the first of equal ones
        self.tables = np.zeros((max(1, longest.bit_length()), len(doc)), np.int32)
        self.tables[0] = np.arange(len(doc))
        for k in range(1, len(self.tables)):
            span = 1 << (k - 1)
            left, right = self.tables[k - 1, :-span], self.tables[k - 1, span:]
            self.tables[k, :-span] = np.where(impact[right] > impact[left], right, left)
        self.flat = self.tables.reshape(-1)

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the largest impact in each range lo..hi of postings, none of which is empty, and that impact."""
        level = _LEVEL[hi - lo] if int((hi - lo).max()) < len(_LEVEL) else np.frexp((hi - lo).astype(np.float64))[1] - 1
        row = level * len(self.doc)
        left, right = self.flat[row + lo], self.flat[row + hi - _POWER[level]]
        of_left, of_right = self.impact[left], self.impact[right]
        return np.where(of_right > of_left, right, left), np.maximum(of_left, of_right)


def best_in(segment: Segment, terms: np.ndarray, repeats: np.ndarray, ids: np.ndarray, best: int, floor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """(score, document number) of the `best` documents of a query, equal scores by number.

    `floor` is a (score, doc_id) that a document has to beat. Scores are exact; documents that score 0 are none.
    """
    lo, hi = segment.first[terms], segment.first[terms + 1]
    there = lo < hi
    if not there.any():
        return []
    terms, repeats, lo, hi = terms[there], repeats[there], lo[there], hi[there]
    found: list[tuple[int, int]] = []  # a heap whose first entry is the worst: (score, -number)

    def useless(bound: int, first: int) -> bool:
        if floor is not None and (bound, -ids[first]) <= (floor[0], -floor[1]):
            return True
        return len(found) == best and (bound, -first) <= found[0]

    def take(score: int, number: int) -> None:
        if not useless(score, number):
            (heapq.heappush if len(found) < best else heapq.heappushpop)(found, (score, -number))

    def bounded(start, terms, repeats, lo, hi):
        top, impacts = segment.largest(lo, hi)
        gains = impacts * repeats
        return -int(gains.sum()), start, int(segment.doc[top[int(np.argmax(gains))]]), terms, repeats, lo, hi

    first = bounded(0, terms, repeats, lo, hi)
    open_, order = [(first[0], first[1], 0, first[2:])], 0
    while open_:
        bound, start, _, (split, terms, repeats, lo, hi) = heapq.heappop(open_)
        if bound == 0 or useless(-bound, start):
            # no later interval has a higher bound; one with an equal bound starts later
            break
        sizes = hi - lo
        if (size := int(sizes.sum())) <= WHOLE_POSTINGS:
            # an interval of few postings is scored whole
            places = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(size)
            docs = segment.doc[places]
            scores = np.zeros(int(docs.max()) - start + 1, np.int64)
            np.add.at(scores, docs - start, segment.impact[places] * np.repeat(repeats, sizes))
            worst = max(1, found[0][0] if len(found) == best else 1, floor[0] if floor else 1)
            for number in np.flatnonzero(scores >= worst).tolist():
                take(int(scores[number]), start + number)
            continue
        at = np.searchsorted(segment.keys, segment.base[terms] + split)
        at = np.minimum(np.maximum(at, lo), hi)
        inside = at < hi
        holds = inside.copy()
        holds[inside] = segment.doc[at[inside]] == split
        score = int((segment.impact[at[holds]] * repeats[holds]).sum())
        if score:
            take(score, split)
        for begin, a, b in ((start, lo, at), (split + 1, at + holds, hi)):
            some = a < b
            if some.any():
                part = bounded(begin, terms[some], repeats[some], a[some], b[some])
                if not useless(-part[0], begin):
                    order += 1
                    heapq.heappush(open_, (part[0], part[1], order, part[2:]))
    return [(score, -number) for score, number in sorted(found, reverse=True)]


def _searched(batches: Iterator[pa.RecordBatch], queries: Broadcast, n_docs: int, length: int, best: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each query in every segment of a task; what one segment finds, the next ones have to beat."""
    q: Queries = queries.value
    tops: list[list[tuple[int, int]]] = [[] for _ in q.of]
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def search():
        nonlocal held, size
        ids = np.concatenate([h[0] for h in held])
        starts = np.cumsum([0, *(len(h[0]) for h in held)])
        row = np.concatenate([h[1] + s for h, s in zip(held, starts)])
        term, tf, n = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
        held, size = [], 0
        by_id = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        ids, doc = ids[by_id], number[row]
        m = FLAT + (SLOPE * n * n_docs) // length
        impact = q.weights[term] * ((UNIT * tf) // (SCALE * tf + SATURATION * m))
        order = np.lexsort((doc, term))
        segment = Segment(term[order], doc[order], impact[order], len(ids), len(q.terms))
        for k, (terms, repeats) in enumerate(q.of):
            full = len(tops[k]) == best
            floor = (tops[k][-1][0], -tops[k][-1][1]) if full else None
            more = best_in(segment, terms, repeats, ids, best, floor)
            if more:
                tops[k] = sorted([*tops[k], *((score, -int(ids[d])) for score, d in more)], reverse=True)[:best]

    for batch in batches:
        keys = batch.column("doc").to_numpy()
        for lo, hi, data, offsets in text_chunks(batch, size=READ_BYTES):
            words, first = _terms(data, offsets)
            terms, row, code, tf = _counted(words, first)
            wanted = pc.fill_null(pc.index_in(terms, value_set=q.terms), -1).to_numpy().astype(np.int64)
            own = wanted[code] >= 0
            row, tf = row[own], tf[own].astype(np.int64)
            if size and size + len(row) > SEGMENT_POSTINGS:
                search()
            used, which = np.unique(row, return_inverse=True)  # documents without a term of any query are in no list
            held.append((keys[lo:hi][used], which, wanted[code[own]], tf, np.diff(first)[used][which]))
            size += len(row)
    if held:
        search()
    rows = [(q.number[k], -doc, score) for k, top in enumerate(tops) for score, doc in top]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query", "doc", "score"])


def _blocks(items: DataFrame, n_blocks: int, stats: DataFrame, n_docs: int) -> Iterator[Queries]:
    """Queries with the weights of their terms, in blocks of about BLOCK_TERMS terms."""
    for block in range(n_blocks):
        own = items.where(F.col("block") == block).select("query", F.explode("terms").alias("word"))
        counted = own.groupBy("query", F.col("word").cast("binary").alias("term")).agg(F.count(F.lit(1)).alias("repeats"))
        found = counted.join(stats.where("term is not null"), "term").select("query", "term", "repeats", "df").toPandas()
        weights = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))) for t, df in zip(found["term"], found["df"])}
        weights = {t: w for t, w in weights.items() if w}
        terms = sorted(weights)
        number = {t: i for i, t in enumerate(terms)}
        of, numbers = [], []
        for query, rows in found.groupby("query"):
            known = sorted((number[t], r) for t, r in zip(rows["term"], rows["repeats"]) if t in number)
            if known:
                numbers.append(int(query))
                of.append((np.array([t for t, _ in known], np.int64), np.array([r for _, r in known], np.int64)))
        if of:
            yield Queries(pa.array(terms, pa.binary()), np.array([weights[t] for t in terms], np.int64), numbers, of)


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The `best` documents for each item: `item_id, rank, doc_id, score`; reads `doc_id, text` and `item_id, text`.

    Scores sum, over the item's terms with repeats, the term's weight times its saturated frequency in the document, in whole numbers. Ranks
    count from 1; equal scores come by ascending doc_id, a null one last. Only scores above 0 are returned. A null text has no
    terms; rows that repeat a doc_id are documents of their own, and so are rows that repeat an item_id, each with ranks of its own. A null
    item_id is an item like any other. Other columns are not read. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    stats = materialize(statistics(docs), "term-statistics")
    total = stats.where("term is null").first()
    named = items.select("item_id", alnum_words(F.col("text")).alias("terms"))
    named = materialize(named.select(F.monotonically_increasing_id().alias("query"), "*", F.size("terms").alias("n")), "queries")
    n_blocks = 1 + (named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // BLOCK_TERMS)
    blocks = named.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks)))
    given = docs.select(doc_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    if total is not None and total["df"]:
        for block in _blocks(blocks, n_blocks, stats, total["df"]):
            sent = spark.sparkContext.broadcast(block)
            run = lambda b, sent=sent: _searched(b, sent, total["df"], total["length"], best)
            parts.append(materialize(given.mapInArrow(run, "query long, doc long, score long"), "found"))
    found = spark.createDataFrame([], "query long, doc long, score long")
    for part in parts:
        found = found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(named.select("query", "item_id"), "query").select("item_id", "rank", as_doc_id(F.col("doc")).alias("doc_id"), "score")
