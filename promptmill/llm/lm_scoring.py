"""Scores of texts by a causal self-attention model over subword ids, beside a base score by word counts.

Words and their counts are gathered from every training text. Subwords follow a public vocabulary, whose file is a parameter; a word
is cut the same way wherever it stands, so its pieces are worked out once for each part of the texts. Pieces are ranked by their
counts: the first ones are leaves of the model, the rest share the last class's leaves by their counts. The model learns by steps along
gradients over all windows of the training texts, each once, in all tasks at once, whose parameters Spark averages after each round. Texts are scored where they are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.llm import attention
from promptmill.llm.attention import CLASSES, FRESH, LEAVES, WINDOW
from promptmill.llm.common import _SPACE, Words, mix, text_chunks
from promptmill.llm.labelled import held_out
from promptmill.operators.vocabulary import most_frequent
from promptmill.sources.storage import materialize

# Subwords as ranks: lines of a piece in base64 and its id. The first id that is free ends a text.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Places of a window that only see: they were scored in the window before.
CONTEXT = WINDOW - FRESH

# Every window of the training texts is learned from, in one of so many rounds.
ROUNDS, RATE = 6, 0.03

# Windows of a step along a gradient, and the steps that a task makes in a round at least.
BATCH, LEAST_STEPS = 64, 48

# Windows that are cut at once, and those that are gone through at once: the last batch of these is a shorter one.
SENT_WINDOWS, RUN_WINDOWS = 1 << 13, 10_000

# Most words whose counts and pieces are sent to the tasks, the most frequent ones of so many bytes at most; all others are joined.
HOT_WORDS, HOT_BYTES = 1 << 17, 64

# Bytes of text that are worked on at once when words are counted, and when texts are scored.
COUNTED_BYTES, SCORED_BYTES = 8 << 20, 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# A piece never reaches over a word; a word of many letters is cut before it is looked up.
_PATTERN = r" ?[^ ]{1,32}"


class Encoder:
    """Pieces of words after a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.end = max(ranks.values(), default=-1) + 1
        self.size = self.end + 1
        self._encode = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self._begins = np.zeros(self.size, bool)
        self._begins[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's begin, with the end appended."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py()
        ids = self._encode(" " + joined.decode("utf-8", "replace"), disallowed_special=()).astype(np.int32)
        starts = np.flatnonzero(self._begins[ids])
        return ids, np.r_[starts, len(ids)]


class Ranks(NamedTuple):
    """A vocabulary that was sent to the tasks, and the digest of its file."""

    digest: str
    sent: Broadcast


_encoders: dict[str, Encoder] = {}


def _encoder(ranks: Ranks) -> Encoder:
    """The encoder of a vocabulary, once per Python worker."""
    if ranks.digest not in _encoders:
        _encoders[ranks.digest] = Encoder(ranks.sent.value)
    return _encoders[ranks.digest]


def send_ranks(spark: SparkSession, path: str) -> Ranks:
    """Read by the driver alone; executors need no file."""
    data = Path(path).read_bytes()
    own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.split(b"\n")))}
    return Ranks(hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(own))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of a chunk of texts as binary values, and the first word of each row with the end appended."""
    found = Words(data, offsets)
    letters = _LOWER[data[~_SPACE[data]]]
    cuts = np.zeros(len(found.starts) + 1, np.int32)
    np.cumsum(found.ends - found.starts, out=cuts[1:])
    words = pa.Array.from_buffers(pa.binary(), len(found.starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)])
    return words, found.first


class Vocabulary(NamedTuple):
    """What the model knows of pieces, by id: the leaf, and the natural logarithm of the share within it."""

    leaf: np.ndarray
    within: np.ndarray


class Model(NamedTuple):
    vocabulary: Vocabulary
    params: attention.Params


def vocabulary(counts: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """Leaves of all pieces from their counts plus one, and the mass of each leaf.

    The most frequent pieces are leaves of their own; the rest is dealt by rank to the leaves of the last class.
    """
    mass = counts + 1.0
    order = np.lexsort((np.arange(len(mass)), -mass))
    single = (CLASSES - 1) * LEAVES
    places = np.arange(len(mass))
    leaf = np.empty(len(mass), np.int16)
    leaf[order] = np.where(places < single, places, single + places % LEAVES)
    leaf_mass = np.bincount(leaf, weights=mass, minlength=CLASSES * LEAVES)
    within = np.log(mass / leaf_mass[leaf]).astype(np.float32)
    return Vocabulary(leaf, within), leaf_mass


def first_params(leaf_mass: np.ndarray) -> attention.Params:
    mass = np.maximum(leaf_mass, 1e-9).reshape(CLASSES, LEAVES)
    by_class = mass.sum(1)
    return attention.initial(np.log(by_class / by_class.sum()), np.log(mass / by_class[:, None]))


class HotWords(NamedTuple):
    """The most frequent words: logarithms of their counts plus one, and their pieces as `Encoder.pieces` gives them."""

    words: pa.Array
    logs: np.ndarray
    ids: np.ndarray
    starts: np.ndarray

    def code(self, words: pa.Array, encoder: Encoder) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Codes of words, the words that are not in here, whose codes follow, and the pieces of all codes."""
        coded = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        cold = np.flatnonzero(known < 0)
        known[cold] = len(self.words) + np.arange(len(cold))
        others = coded.dictionary.take(pa.array(cold))
        ids, starts = encoder.pieces(others)
        return known[coded.indices.to_numpy()], others, np.r_[self.ids, ids], np.r_[self.starts[:-1], starts + len(self.ids)]


def hot_words(words: DataFrame, most: int, encoder: Encoder) -> HotWords:
    """The `most` most frequent words of no more than HOT_BYTES."""
    found = most_frequent(words.where(F.octet_length("token") <= HOT_BYTES), most).orderBy("token").toArrow()
    tokens = found.column("token").combine_chunks()
    return HotWords(tokens, np.log10(found.column("n").to_numpy() + 1.0), *encoder.pieces(tokens))


def _sequences(codes: np.ndarray, first: np.ndarray, ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all rows, each row closed by `end`, and the offsets of rows, from the word codes of a chunk."""
    rows = len(first) - 1
    sizes = np.diff(starts)
    # an end is one more word of one piece
    ids, starts, sizes = np.r_[ids, np.int32(end)], starts, np.r_[sizes, 1]
    codes = np.insert(codes, first[1:], len(sizes) - 1)
    lengths = sizes[codes]
    cuts = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lengths, out=cuts[1:])
    # places of half the size where they fit: there are several for each word
    small = np.int32 if cuts[-1] + len(ids) < 1 << 31 else np.int64
    places = np.repeat((starts[codes] - cuts[:-1]).astype(small), lengths)
    places += np.arange(cuts[-1], dtype=small)
    return ids[places], cuts[first + np.arange(rows + 1)]


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all rows: the row, and the place in all pieces of the first one that it scores."""
    several = -(-np.diff(offsets) // FRESH)
    rows = np.repeat(np.arange(len(several)), several)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(several) - several, several)
    return rows, offsets[rows] + nth * FRESH


def _views(leaves: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of windows, and targets and whether there are any. An input is the piece before its target; `begin` is before every row."""
    before = starts[:, None] + np.arange(-CONTEXT, FRESH)
    inputs = leaves.take(before - 1, mode="clip")
    inputs[:, : CONTEXT + 1][before[:, : CONTEXT + 1] <= offsets[rows][:, None]] = begin
    own = before[:, CONTEXT:]
    return inputs, leaves.take(own, mode="clip"), own < offsets[rows + 1][:, None]


def word_counts(texts: DataFrame) -> DataFrame:
    """`token, n`: every lower-cased word as bytes with its occurrences, and each text's end as null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, size=COUNTED_BYTES):
                words, _ = _words(data, offsets)
                found = words.value_counts()
                tokens, n = found.field("values"), found.field("counts")
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([tokens, pa.nulls(1, pa.binary())]), pa.concat_arrays([n, pa.array([hi - lo], pa.int64())])], ["token", "n"]
                )

    return texts.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, ranks: Ranks, size: int) -> np.ndarray:
    """Occurrences of every piece id, from the counts of words; no more sums than the vocabulary has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        sums = np.zeros(encoder.size)
        for batch in batches:
            for part in (batch.slice(lo, 4096) for lo in range(0, batch.num_rows, 4096)):
                ids, starts = encoder.pieces(part.column("token"))
                n = part.column("n").to_numpy().astype(float)
                sums += np.bincount(ids, weights=np.repeat(n, np.diff(starts)), minlength=encoder.size)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen])], ["id", "n"])

    found = words.where("token is not null").mapInArrow(count, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


def _cut(batches: Iterator[pa.RecordBatch], ranks: Ranks, hot: Broadcast) -> Iterator[pa.RecordBatch]:
    """`seen, pieces`: every window of every text. The first `seen` pieces are context.

    Windows of texts that are cut at once come in the order of a hash of what they hold, so that a step mixes them.
    """
    encoder = _encoder(ranks)
    mixed = mix(np.arange(encoder.size, dtype=np.uint64))
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch, size=SCORED_BYTES):
            words, first = _words(data, offsets)
            codes, _, ids, starts = hot.value.code(words, encoder)
            pieces, cuts = _sequences(codes, first, ids, starts, encoder.end)
            rows, begins = _windows(cuts)
            sums = np.zeros(len(pieces) + 1, np.uint64)
            mixed.take(pieces, out=sums[1:])
            np.cumsum(sums, out=sums)
            ends = np.minimum(begins + FRESH, cuts[rows + 1])
            own = np.argsort(mix(sums[ends] - sums[begins]), kind="stable")
            seen = np.minimum(begins[own] - cuts[rows[own]], CONTEXT + 1)
            froms, lengths = begins[own] - seen, ends[own] - begins[own] + seen
            del words, codes, sums
            for a in range(0, len(own), SENT_WINDOWS):
                part = slice(a, a + SENT_WINDOWS)
                offs = np.r_[0, np.cumsum(lengths[part])]
                places = np.repeat(froms[part] - offs[:-1], lengths[part]) + np.arange(offs[-1])
                raw = [None, pa.py_buffer((offs * 4).astype(np.int32)), pa.py_buffer(pieces[places].astype(np.int32))]
                column = pa.Array.from_buffers(pa.binary(), len(offs) - 1, raw)
                yield pa.RecordBatch.from_arrays([pa.array(seen[part].astype(np.int32)), column], ["seen", "pieces"])


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, `size` at once; the last ones may be fewer."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while rows + batch.num_rows >= size:
            yield pa.concat_batches([*held, batch.slice(0, size - rows)])
            batch, held, rows = batch.slice(size - rows), [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def training_windows(texts: DataFrame, ranks: Ranks, hot: Broadcast) -> DataFrame:
    """The rows of `_cut` as a table."""
    return texts.mapInArrow(lambda batches: _cut(batches, ranks, hot), "seen int, pieces binary")


class Rounds(NamedTuple):
    """The training windows by round: those of the texts that a hash deals to it. Nothing is stored or shuffled."""

    texts: DataFrame
    ranks: Ranks
    hot: Broadcast
    rounds: int

    def of(self, k: int) -> DataFrame:
        """`text` of a round. Copies of a text are dealt to all rounds by their doc_id."""
        return self.texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.rounds)) == k).select("text")

    def __call__(self, k: int) -> DataFrame:
        return training_windows(self.of(k), self.ranks, self.hot)


def _by_round(texts: DataFrame, ranks: Ranks, hot: Broadcast, rounds: int = ROUNDS) -> Rounds:
    return Rounds(texts, ranks, hot, rounds)


def _stacked(batch: pa.RecordBatch, leaf: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and scored places of windows as `training_windows` gives them."""
    column = batch.column("pieces")
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    pieces = np.frombuffer(column.buffers()[2], np.int32, count=cuts[-1])
    place = np.arange(WINDOW + 1) - (CONTEXT + 1 - batch.column("seen").to_numpy())[:, None]
    inside = (place >= 0) & (place < np.diff(cuts)[:, None])
    whole = np.full(inside.shape, end, np.int32)
    whole[inside] = pieces[cuts[0] :]
    leaves = leaf[whole].astype(np.int64)
    return leaves[:, :-1], leaves[:, CONTEXT + 1 :], inside[:, CONTEXT + 1 :]


def _steps(flat: np.ndarray, like: attention.Params, parts: Iterator[tuple], rate: float) -> tuple[np.ndarray, float, int]:
    """Parameters after steps along the gradients of BATCH windows each, the loss and the scored pieces of the first pass.

    Fewer windows than LEAST_STEPS batches are gone through again, in order, until so many steps are made.
    """
    adam = attention.Adam(len(flat), rate)
    flat = flat.astype(np.float64)
    loss, seen, made = 0.0, 0, 0
    kept: list[tuple] = []

    def step(views):
        sums, more, n = attention.gradient(attention.unpack(flat, like), *views)
        slope = attention.pack(sums, np.float64)
        slope /= max(n, 1)
        adam.move(flat, slope)
        return more, n

    for views in parts:
        for lo in range(0, len(views[0]), BATCH):
            own = tuple(v[lo : lo + BATCH] for v in views)
            more, n = step(own)
            loss, seen, made = loss + more, seen + n, made + 1
            if made < LEAST_STEPS:
                kept.append(own)
    again = made
    while kept and again < LEAST_STEPS:
        step(kept[again % made])
        again += 1
    return flat, loss, seen


def learn(windows: Rounds, counts: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model from all windows, in rounds over those that `windows` has for each.

    In a round every task goes its own steps over its windows from the same parameters; the means over the tasks, by scored
    pieces, begin the next round. Spark adds them up, so the driver sees at most 16 rows. A task cuts its windows in the
    Python process that learns from them: a second one would hold the vocabulary and the words again, and pass all windows through the JVM.
    """
    vocab, leaf_mass = vocabulary(counts)
    like = first_params(leaf_mass)
    end = len(counts) - 1
    flat = attention.pack(like)
    ranks, hot = windows.ranks, windows.hot
    for number in range(rounds):
        own = windows.of(number)
        context = own.sparkSession.sparkContext
        if not number:
            leaf = context.broadcast(vocab.leaf)
        sent = context.broadcast(flat.astype(np.float32))
        now = rate * (1 - number / rounds)

        def walk(batches: Iterator[pa.RecordBatch], sent=sent, now=now) -> Iterator[pa.RecordBatch]:
            cut = _runs(_cut(batches, ranks, hot), RUN_WINDOWS)
            parts = (_stacked(batch, leaf.value, end) for batch in cut)
            reached, loss, seen = _steps(sent.value, like, parts, now)
            if seen:
                columns = [pa.array([loss]), pa.array([seen], pa.int64()), pa.array([(reached * seen).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["loss", "seen", "params"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(s) for s in frame["params"]], axis=0)
            return pd.DataFrame({"loss": [frame["loss"].sum()], "seen": [frame["seen"].sum()], "params": [total.tobytes()]})

        made = own.mapInArrow(walk, "loss double, seen long, params binary")
        parts = made.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("part")
        rows = parts.applyInPandas(add, "loss double, seen long, params binary").collect()
        seen = sum(r["seen"] for r in rows)
        if seen:
            flat = np.sum([np.frombuffer(r["params"]) for r in sorted(rows)], axis=0) / seen
        sent.unpersist()
    return Model(vocab, attention.unpack(flat, like))


def _scored(batches: Iterator[pa.RecordBatch], ranks: Ranks, hot: Broadcast, model: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each text: words, words and logarithms of counts that are known here, the score, and all other words."""
    encoder = _encoder(ranks)
    vocab, params = model.value
    begin = int(vocab.leaf[encoder.end])
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch, size=SCORED_BYTES):
            words, first = _words(data, offsets)
            codes, others, ids, starts = hot.value.code(words, encoder)
            pieces, cuts = _sequences(codes, first, ids, starts, encoder.end)
            warm = codes < len(hot.value.words)

            rows = np.repeat(np.arange(hi - lo), np.diff(first))
            logs = np.bincount(rows[warm], weights=hot.value.logs[codes[warm]], minlength=hi - lo).astype(float)
            n_known = np.bincount(rows[warm], minlength=hi - lo)

            scores = np.bincount(np.repeat(np.arange(hi - lo), np.diff(cuts)), weights=vocab.within[pieces], minlength=hi - lo)
            leaves = vocab.leaf[pieces].astype(np.int64)
            of, begins = _windows(cuts)
            for a in range(0, len(of), 1 << 11):
                part = slice(a, a + (1 << 11))
                inputs, targets, scored = _views(leaves, cuts, of[part], begins[part], begin)
                found = attention.log_shares(params, inputs, targets, scored)
                scores += np.bincount(np.repeat(of[part], scored.sum(1)), weights=found, minlength=hi - lo)

            # words of a row that are not known here, once each with their number
            size = len(others) + 1
            pairs, times = np.unique(rows[~warm] * size + codes[~warm] - len(hot.value.words), return_counts=True)
            of_row, which = np.divmod(pairs, size)
            rare = pa.StructArray.from_arrays([others.take(pa.array(which)), pa.array(times.astype(np.int64))], ["token", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of_row, np.arange(hi - lo + 1)).astype(np.int32)), rare)
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("doc_id"), own.column("held_out"), own.column("row"), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(n_known.astype(np.int64)), pa.array(logs, pa.float64()), pa.array(scores / np.log(10), pa.float64()), lists,
                ],
                ["doc_id", "held_out", "row", "n_words", "n_known", "logs", "score", "rare"],
            )


def score(docs: DataFrame, modulus: int = 7, rest: int = 2, ranks_path: str = RANKS, most: int = HOT_WORDS) -> DataFrame:
    """Scores of all texts, learned from those whose crc32(doc_id as text) modulo `modulus` is not `rest`; reads `doc_id, text`.

    Returns one row per input row: `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`. Tokens are the words of the text with A-Z lower-cased, then
    one end. The base score adds log10((c+1)/(N+V+1)) over the tokens: c the token's count in the training texts, N all, V distinct ones.
    `score` is the model's log10 probability of the same tokens as subwords, the end included. A null text is empty; a null doc_id is
    not held out. Rows that repeat a doc_id or a text each count and are each scored. Other columns are not read. Without
    training texts all counts are 0 and the model predicts pieces alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ranks = send_ranks(spark, ranks_path)
    texts = docs.where(~held_out(modulus, rest)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(word_counts(texts.select("text")), "word-counts")
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("token").isNull(), F.col("n"))), F.lit(0)).alias("ends")
    ).first()
    encoder = _encoder(ranks)
    of_pieces = piece_counts(counts, ranks, encoder.size)
    of_pieces[encoder.end] = total["ends"]
    words = counts.where("token is not null")
    hot = spark.sparkContext.broadcast(hot_words(words, most, encoder))
    model = learn(_by_round(texts, ranks, hot), of_pieces)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select(
        "doc_id", held_out(modulus, rest).alias("held_out"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text")
    )
    schema = f"doc_id {kind}, held_out boolean, row long, n_words long, n_known long, logs double, score double, rare array<struct<token: binary, tf: long>>"
    scored = materialize(given.mapInArrow(lambda b: _scored(b, ranks, hot, shared), schema), "scored-texts")
    rare = scored.select("row", F.inline("rare")).join(words, "token").groupBy("row").agg(
        F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more_logs")
    )
    below = float(np.log10(total["n"] + total["v"] + 1))
    end_log = float(np.log10(total["ends"] + 1))
    n_tokens = F.col("n_words") + 1
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if total["ends"] else 0)).cast("long").alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end_log - n_tokens * below).alias("base_score"),
        "score",
    )
