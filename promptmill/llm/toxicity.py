"""Toxicity by a convolutional text classifier, trained in numpy by all tasks, whose weights Spark averages.

A word is the sum of hashed embeddings of itself and of its first letters. Filters of several widths
slide over the words, the largest answer of each filter counts, and one linear layer joins them. The
score is shifted by language, so that the threshold is the best one for each; the language of a
text is told by its most frequent function words.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm import labelled
from promptmill.llm.common import Words, as_doc_id, byte_hash, doc_key, mix, text_chunks

MODULUS, REST = 4, 2
THRESHOLD = 0.3

BITS = 20
DIMENSION = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
HEADS = (4, 5)
# Hashes that fewer training texts have are all one unknown word.
LEAST_TEXTS = 3
EPOCHS, BATCH, RATE, EMBEDDING_RATE = 8, 64, 0.005, 0.5

# Function words that tell a language.
FUNCTION_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "den", "zu", "nicht"],
    "en": ["the", "of", "and", "to", "is", "that", "it", "for"],
    "es": ["el", "los", "que", "y", "por", "las", "con", "su"],
    "fr": ["le", "la", "les", "et", "des", "est", "pour", "une"],
}
LANGUAGES = sorted(FUNCTION_WORDS)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(byte_hash(data).of(np.array([0]), np.array([len(data)]))[0])


_TOLD = {_word_hash(w): LANGUAGES.index(lang) for lang, own in FUNCTION_WORDS.items() for w in own}
_TOLD_HASHES = np.array(sorted(_TOLD), np.uint64)
_TOLD_LANGUAGES = np.array([_TOLD[int(h)] for h in _TOLD_HASHES])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash numbers of each word (a column for the word, one for each head), where each text's words begin, its language."""
    data = _FOLD[data]
    words = Words(data, offsets, _BREAK)
    hashes = byte_hash(data)
    whole = hashes.of(words.starts, words.ends)
    columns = [whole] + [mix(hashes.of(words.starts, np.minimum(words.starts + k, words.ends)) + np.uint64(k)) for k in HEADS]
    numbers = np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in columns], axis=1)
    at = np.searchsorted(_TOLD_HASHES, whole).clip(max=len(_TOLD_HASHES) - 1)
    told = _TOLD_HASHES[at] == whole
    votes = np.zeros((len(offsets) - 1, len(LANGUAGES)), np.int64)
    np.add.at(votes, (words.rows[told], _TOLD_LANGUAGES[at[told]]), 1)
    return numbers, words.first, votes.argmax(axis=1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the fit: of each text its language, then its words' numbers."""
    numbers, first, language = tokens(data, offsets)
    width = numbers.shape[1]
    lengths = np.diff(first) * width + 1
    cuts = np.r_[0, np.cumsum(lengths)]
    out = np.empty(cuts[-1], np.int32)
    heads = np.zeros(len(out), bool)
    heads[cuts[:-1]] = True
    out[heads] = language
    out[~heads] = numbers.reshape(-1)
    return out, cuts


@dataclass
class Model:
    known: np.ndarray  # sorted hash numbers with an embedding of their own
    embeddings: np.ndarray  # row 0 is the unknown word
    filters: dict[int, np.ndarray]  # by width: width * DIMENSION by FILTERS
    biases: dict[int, np.ndarray]
    output: np.ndarray
    offset: float
    shifts: np.ndarray  # by language

    def ids(self) -> np.ndarray:
        """The row of each hash number in the embeddings."""
        found = np.zeros(1 << BITS, np.int32)
        found[self.known] = np.arange(1, len(self.known) + 1)
        return found


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the words when every text is followed by empty ones, and where each text begins then."""
    gap = max(WIDTHS)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = first[:-1] + gap * np.arange(len(first) - 1)
    return np.arange(first[-1]) + gap * rows, starts, int(first[-1] + gap * (len(first) - 1))


def forward(model: Model, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Logits of the texts; also the pooled answers, the padded words and the filter answers, for training."""
    places, starts, n = _padded(first)
    words = np.zeros((n, DIMENSION), np.float32)
    words[places] = sum(model.embeddings.take(column, axis=0) for column in ids.T)
    pooled, answers = [], {}
    for width in WIDTHS:
        answer = np.zeros((n, FILTERS), np.float32)
        for j in range(width):
            answer[: n - j] += words[j:] @ model.filters[width][j * DIMENSION : (j + 1) * DIMENSION]
        answer += model.biases[width]
        np.maximum(answer, 0, out=answer)
        answers[width] = answer
        pooled.append(np.maximum.reduceat(answer, starts, axis=0))
    joined = np.concatenate(pooled, axis=1)
    return joined @ model.output + model.offset, joined, words, answers


def _gradients(model: Model, ids: np.ndarray, first: np.ndarray, error: np.ndarray, state: tuple) -> dict:
    """Gradients of all weights from the errors of the logits; only the pooled places pass them on. Those of embeddings by id."""
    _, joined, words, answers = state
    places, starts, n = _padded(first)
    rows = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    found = {"output": joined.T @ error, "offset": error.sum()}
    d_words = np.zeros_like(words)
    for k, width in enumerate(WIDTHS):
        pooled = joined[:, k * FILTERS : (k + 1) * FILTERS]
        passed = error[:, None] * model.output[k * FILTERS : (k + 1) * FILTERS] * (pooled > 0)
        at_max = np.argwhere((answers[width] == pooled[rows]) & (pooled[rows] > 0))
        cell = rows[at_max[:, 0]] * FILTERS + at_max[:, 1]
        _, one = np.unique(cell, return_index=True)
        place, flt = at_max[one, 0], at_max[one, 1]
        amount = passed[rows[place], flt].astype(np.float32)
        d_filter = np.zeros_like(model.filters[width])
        for j in range(width):
            inside = place + j < n
            p, f, a = place[inside] + j, flt[inside], amount[inside]
            np.add.at(d_filter.T, (f, slice(j * DIMENSION, (j + 1) * DIMENSION)), a[:, None] * words[p])
            np.add.at(d_words, p, a[:, None] * model.filters[width][j * DIMENSION : (j + 1) * DIMENSION, f].T)
        found[f"filter{width}"] = d_filter
        found[f"bias{width}"] = np.bincount(flt, amount, FILTERS)
    of_words = d_words[places]
    touched = np.flatnonzero(np.abs(of_words).sum(axis=1))
    which, at = np.unique(ids[touched], return_inverse=True)
    slopes = np.zeros((len(which), DIMENSION), np.float32)
    at = at.reshape(len(touched), ids.shape[1])
    for column in range(ids.shape[1]):
        np.add.at(slopes, at[:, column], of_words[touched])
    return found | {"embeddings": (which[which > 0], slopes[which > 0])}


NAMES = ["output", "offset"] + [f"{k}{w}" for w in WIDTHS for k in ("filter", "bias")]


def _lines(model: Model) -> np.ndarray:
    """All weights but the embeddings, as lines as long as an embedding."""
    parts = [model.output, np.array([model.offset])] + [m[w].reshape(-1) for w in WIDTHS for m in (model.filters, model.biases)]
    flat = np.concatenate(parts)
    return np.r_[flat, np.zeros(-len(flat) % DIMENSION)].astype(np.float32).reshape(-1, DIMENSION)


def _with_lines(model: Model, lines: np.ndarray) -> None:
    flat, at = lines.reshape(-1), len(WIDTHS) * FILTERS
    model.output, model.offset = flat[:at].copy(), float(flat[at])
    at += 1
    for width in WIDTHS:
        for kind in (model.filters, model.biases):
            size = kind[width].size
            kind[width] = flat[at : at + size].reshape(kind[width].shape).copy()
            at += size


def _epoch(model: Model, parts: Iterator[tuple], share: float, whole: bool, random: np.random.RandomState) -> tuple[np.ndarray, int, float, float]:
    """Steps over the teaching rows of a task: ids of moved embeddings, and the rows. Also the loss of the checking rows before, and their number."""
    first_moment = {k: 0.0 for k in NAMES}
    second_moment = {k: 0.0 for k in NAMES}
    step, taught, loss, n_check = 0, 0, 0.0, 0
    moved = np.zeros(len(model.embeddings), bool)
    before, of_number = copy.deepcopy(model), model.ids()
    for values, labels, checks in parts:
        ids = [of_number[v[1:].reshape(-1, 1 + len(HEADS))] for v in values]
        labels = labels.astype(np.float64)
        every = np.arange(len(ids))
        check, train = (every, every) if whole else (every[checks], every[~checks])
        if len(check):
            logits = _logits(before, ids, check)
            loss += float(np.sum(np.logaddexp(0, np.where(labels[check] == 1, -logits, logits)) * np.where(labels[check] == 1, share, 1.0)))
            n_check += len(check)
        shuffled = random.permutation(train)
        for at in range(0, len(shuffled), BATCH):
            batch = shuffled[at : at + BATCH]
            first = np.r_[0, np.cumsum([len(ids[i]) for i in batch])]
            words = np.concatenate([ids[i] for i in batch])
            state = forward(model, words, first)
            p = 1 / (1 + np.exp(-np.clip(state[0], -30, 30)))
            weight = np.where(labels[batch] == 1, share, 1.0)
            error = ((p - labels[batch]) * weight / len(batch)).astype(np.float32)
            gradients = _gradients(model, words, first, error, state)
            # plain steps for embeddings: a word that few texts have stays near its start
            which, slopes = gradients["embeddings"]
            model.embeddings[which] -= EMBEDDING_RATE * slopes
            moved[which] = True
            step += 1
            for name in NAMES:
                g = gradients[name]
                first_moment[name] = 0.9 * first_moment[name] + 0.1 * g
                second_moment[name] = 0.999 * second_moment[name] + 0.001 * np.square(g)
                move = RATE * (first_moment[name] / (1 - 0.9**step)) / (np.sqrt(second_moment[name] / (1 - 0.999**step)) + 1e-8)
                _apply(model, name, move)
        taught += len(train)
    return np.flatnonzero(moved), taught, loss, n_check


def _logits(model: Model, ids: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    first = np.r_[0, np.cumsum([len(ids[i]) for i in which])]
    return forward(model, np.concatenate([ids[i] for i in which]), first)[0]


def learn(rows: DataFrame) -> Model | None:
    """A model from all stored rows of `label, checks, features`; None without any row.

    Words are known by counts over all rows. In a round every task goes its own steps over all its teaching rows from the same weights;
    Spark adds up the mean moves, with which the next round begins. The checking rows tell which round was the best, and set the thresholds.
    """
    sizes = labelled.class_sizes(rows)
    total = sum(sizes.values())
    if not total:
        return None
    ones = sum(n for (_, label), n in sizes.items() if label == 1)
    random = np.random.RandomState(5)
    if ones in (0, total):  # one class alone: its score for every text
        model = _first(np.zeros(0, np.int32), random)
        model.output[:] = 0
        model.offset = 6.0 if ones else -6.0
        return model
    columns = 1 + len(HEADS)
    having, toxic = labelled.number_counts(rows, 1 << BITS, lambda own: own[1:])
    known = np.flatnonzero(having >= LEAST_TEXTS).astype(np.int32)
    model = _first(known, random)
    _start(model, having[known], toxic[known], ones / total)
    # a fifth of the rows sets the thresholds, unless there are too few
    whole = min(sizes.get((checks, 1), 0) for checks in (True, False)) < 5
    taught = [sum(n for (checks, label), n in sizes.items() if label == k and (whole or not checks)) for k in (0, 1)]
    share = min(4.0, taught[0] / max(1, taught[1]))
    context = rows.sparkSession.sparkContext
    best_loss, best = np.inf, copy.deepcopy(model)
    for number in range(EPOCHS + 1):
        sent = context.broadcast(vars(model))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> tuple[np.ndarray, np.ndarray, float, float, float]:
            from pyspark import TaskContext

            own = copy.deepcopy(Model(**sent.value))
            parts = labelled.read_features(batches)
            if number == EPOCHS:  # nothing left to learn: the last weights are checked alone
                parts = ((v, y, c) for v, y, c in parts if whole or c.any())
                parts = (([v[i] for i in at], y[at], np.ones(len(at), bool)) for v, y, c in parts for at in [np.flatnonzero(c | whole)])
                ids, taught, loss, n = _epoch(own, parts, share, False, np.random.RandomState(0))
                return np.zeros(0, np.int64), np.zeros((0, DIMENSION)), taught, loss, n
            seed = np.random.RandomState((7 + number * 100_003 + TaskContext.get().partitionId()) % (1 << 31))
            ids, taught, loss, n = _epoch(own, parts, share, whole, seed)
            before = Model(**sent.value)
            if not taught:
                return np.zeros(0, np.int64), np.zeros((0, DIMENSION)), 0, loss, n
            lines = _lines(own) - _lines(before)
            moves = np.concatenate([own.embeddings[ids] - before.embeddings[ids], lines])
            return np.r_[ids, len(own.embeddings) + np.arange(len(lines))], moves, taught, loss, n

        ids, moves, loss, n = labelled.summed_moves(rows, run, DIMENSION)
        sent.unpersist()
        if number and n and loss / n < best_loss:
            best_loss, best = loss / n, copy.deepcopy(model)
        words = ids < len(model.embeddings)
        model.embeddings[ids[words]] += moves[words]
        lines = _lines(model)
        lines[ids[~words] - len(model.embeddings)] += moves[~words]
        _with_lines(model, lines)
    model = best
    shared = context.broadcast(vars(model))

    def margins(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = Model(**shared.value)
        of_number = own.ids()
        ids = [of_number[v[1:].reshape(-1, columns)] for v in values]
        return np.array([v[0] for v in values]), _logits(own, ids, np.arange(len(ids)))

    found = labelled.margin_counts(rows if whole else rows.where("checks"), margins)
    language, margin, n, ones = (found.column(c).to_numpy() for c in ("kind", "margin", "n", "ones"))
    model.shifts[:] = _best_threshold(margin, n, ones)
    for k in range(len(LANGUAGES)):
        own = language == k
        if ones[own].sum() >= 10 and (n - ones)[own].sum() >= 10:
            model.shifts[k] = _best_threshold(margin[own], n[own], ones[own])
    return model


def _first(known: np.ndarray, random: np.random.RandomState) -> Model:
    return Model(
        known,
        (random.randn(len(known) + 1, DIMENSION) * 0.02).astype(np.float32),
        {w: (random.randn(w * DIMENSION, FILTERS) * 0.3).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        (random.randn(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32),
        0.0,
        np.zeros(len(LANGUAGES)),
    )


def _start(model: Model, having: np.ndarray, toxic: np.ndarray, rate: float) -> None:
    """Begin near what counts of texts tell: one dimension of a word says how many deviations more toxic texts have it than by chance."""
    deviations = (toxic - having * rate) / np.sqrt(np.maximum(having, 1) * rate * (1 - rate))
    model.embeddings[1:, 0] = np.clip(deviations / 8, -1, 3)
    model.embeddings[0] = 0
    for width in WIDTHS:
        model.filters[width][:DIMENSION, 0] = 0
        model.filters[width][0, 0] = 1.0
    model.output[::FILTERS] = 1.0


def _apply(model: Model, name: str, move: np.ndarray) -> None:
    if name == "output":
        model.output -= move.astype(np.float32)
    elif name == "offset":
        model.offset -= float(move)
    else:
        kind, width = name.rstrip("0123456789"), int(name.lstrip("abcdefghijklmnopqrstuvwxyz"))
        target = model.filters if kind == "filter" else model.biases
        target[width] = target[width] - move.astype(np.float32)


def _best_threshold(margins: np.ndarray, n: np.ndarray, ones: np.ndarray) -> float:
    """The logit between two margins at which predicting 1 from there up has the best F1; the middle of the widest such gap.

    Rows are given by their margins, of which each may come several times, and how many of them have label 1.
    """
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(ones[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + ones.sum())
    ranked = margins[order]
    # a margin of two languages is one margin
    last = np.r_[ranked[1:] != ranked[:-1], True]
    f1, ranked = f1[last], ranked[last]
    nxt = np.r_[ranked[1:], ranked[-1] - 2.0]
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((ranked - nxt)[best])]
    return float((ranked[k] + nxt[k]) / 2)


def _trained(docs: DataFrame, labels: DataFrame) -> Broadcast:
    """The fields of a model learned from all labelled documents that are not held out."""
    rows = labelled.stored_features(labelled.sample(docs, labels, "toxic", MODULUS, REST), features)
    model = learn(rows)
    if model is None:
        model = _first(np.zeros(0, np.int32), np.random.RandomState(5))
        model.output[:] = 0
        model.offset = -40.0
    return docs.sparkSession.sparkContext.broadcast(vars(model))


def _scores(model: Model, of_number: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and languages of a chunk of texts."""
    numbers, first, language = tokens(data, offsets)
    base = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    logits = forward(model, of_number[numbers], first)[0] - model.shifts[language] + base
    return (1 / (1 + np.exp(-np.clip(logits, -40, 40)))).astype(np.float64), language


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of each text; reads `doc_id, text` and `doc_id, toxic`.

    Returns one row per input row: `doc_id, held_out, score, predicted, language`. The fit sees every
    labelled row that is not held out; scores come from the whole text alone. A null text
    is scored like an empty one. Labels that are null or neither 0 nor 1 are not learned from; with one
    class alone every text gets its score, with none score 0. Rows that repeat a doc_id are scored each;
    a null doc_id is not held out. Other columns are not read. An empty table gives no rows.
    """
    shared = _trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        of_number = model.ids()
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                score, language = _scores(model, of_number, data, offsets)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc"), own.column("held_out"), pa.array(score), pa.array([LANGUAGES[k] for k in language], pa.string())],
                    ["doc", "held_out", "score", "language"],
                )

    texts = docs.select(doc_key().alias("doc"), labelled.held_out(MODULUS, REST).alias("held_out"), "text")
    scored = texts.mapInArrow(run, "doc long, held_out boolean, score double, language string")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select(as_doc_id(F.col("doc")).alias("doc_id"), "held_out", "score", predicted, "language")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; they are filtered where they are read."""
    shared = _trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        of_number = model.ids()
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                score, _ = _scores(model, of_number, data, offsets)
                yield batch.slice(lo, hi - lo).filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
