"""Text quality by a linear model on n-gram indicators scaled by log-count ratios.

Each indicator is scaled by how much likelier it is in one class (naive Bayes), then a linear
hinge-loss model is fitted by dual coordinate descent. n-grams are words, pairs of words, word edges
and triples of word shapes, where a shape says whether a word repeats the one before, is in capitals,
or has no letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm import labelled
from promptmill.llm.common import RollingHash, Words, as_doc_id, byte_hash, doc_key, mix, text_chunks

MODULUS, REST = 5, 0
THRESHOLD = 0.3

BITS = 18
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
# Rows, and numbers in them, of a block that is fitted at once; weights that a task hands on together.
BLOCK, BLOCK_VALUES, LINE = 4096, 1 << 23, 1024

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags)]
    return sums[ends] - sums[starts]


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the n-grams that each text has, and where each text's numbers begin."""
    words = Words(data, offsets)
    rows, n = words.rows, len(words.rows)
    bytes_ = byte_hash(data)
    whole = bytes_.of(words.starts, words.ends)
    heads = bytes_.of(words.starts, np.minimum(words.starts + 3, words.ends))
    tails = bytes_.of(np.maximum(words.ends - 3, words.starts), words.ends)
    same = np.zeros(n, np.uint64)
    if n > 1:
        same[1:] = (whole[1:] == whole[:-1]) & (rows[1:] == rows[:-1])
    letters = _within(_LETTER[data], words.starts, words.ends)
    capitals = _within(_CAPITAL[data], words.starts, words.ends)
    small = _within(_SMALL[data], words.starts, words.ends)
    shape = same + np.uint64(2) * (letters == 0) + np.uint64(4) * ((capitals > 1) & (small == 0))
    kinds = [(rows, whole), (rows, mix(heads + np.uint64(1))), (rows, mix(tails + np.uint64(2)))]
    for size, values in ((2, whole), (3, shape)):
        ok = words.whole(size)
        kinds.append((rows[: len(ok)][ok], mix(RollingHash(values).windows(size)[ok] + np.uint64(size + 1))))
    keys = np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for r, h in kinds])
    keys = np.unique(keys)
    cuts = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), cuts


@dataclass
class Model:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def margins(weights: np.ndarray, offset: float, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Weighted sums over each text's indicators, over the root of their number."""
    sums = np.r_[0, np.cumsum(weights[values].astype(np.float64))]
    return (sums[cuts[1:]] - sums[cuts[:-1]]) / np.sqrt(np.maximum(np.diff(cuts), 1)) + offset


def _descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, shares: tuple[float, float]) -> tuple[np.ndarray, float]:
    """Weights and offset by dual coordinate descent for 1/2 |w|^2 + C * hinge, the offset being one more weight."""
    weights, offset = np.zeros(len(ratio)), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, shares[1], shares[0])
    scale = [1 / np.sqrt(max(len(r), 1)) for r in rows]
    values = [ratio[r] * s for r, s in zip(rows, scale)]
    square = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    random = np.random.RandomState(3)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in random.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + offset) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), COST * share[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                offset += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-3:
            break
    return weights, offset


def learn(rows: DataFrame) -> Model | None:
    """A model from all stored rows of `label, features`; None without any row.

    The ratios come from counts over all rows. Blocks of rows are fitted where they are read, each by its own descent; their mean, by
    rows, is the model, and the curve through the margins is fitted to those of all rows, counted by small steps.
    """
    sizes = labelled.class_sizes(rows)
    total = sum(sizes.values())
    if not total:
        return None
    ones = sum(n for (_, label), n in sizes.items() if label == 1)
    size = 1 << BITS
    if ones in (0, total):  # one class alone: its score for every text
        return Model(np.zeros(size, np.float32), 0.0, 0.0, 6.0 if ones else -6.0)
    having, good = labelled.number_counts(rows, size, lambda own: own)
    bad = having - good + SMOOTHING
    good = good + SMOOTHING
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    ratio[(good + bad) < 2 * SMOOTHING + 2] = 0.0  # seen once: it says nothing about other texts
    shares = 0.5 * total / (total - ones), 0.5 * total / ones
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, float, float, float]:
        # the offset is the last weight
        sums, n = np.zeros(size + 1), 0
        held, held_labels = [], []

        def fit() -> None:
            weights, offset = _descent(held, np.array(held_labels), sent.value, shares)
            sums[:size] += weights * len(held)
            sums[size] += offset * len(held)

        for values, labels, _ in labelled.read_features(batches):
            held += values
            held_labels += labels.tolist()
            n += len(values)
            if len(held) >= BLOCK or sum(map(len, held)) >= BLOCK_VALUES:
                fit()
                held, held_labels = [], []
        if held:
            fit()
        # a task says a line on every weight, so that the means are over all rows
        return np.arange(-(-(size + 1) // LINE)) if n else np.zeros(0, np.int64), _in_lines(sums / n) if n else np.zeros((0, LINE)), n, 0.0, 0.0

    ids, means, _, _ = labelled.summed_moves(rows, run, LINE)
    mean = means[np.argsort(ids)].reshape(-1)
    final, offset = (mean[:size] * ratio).astype(np.float32), float(mean[size])
    shared = context.broadcast(final)

    def found_margins(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.r_[0, np.cumsum([len(v) for v in values])]
        return np.zeros(len(values), np.int64), margins(shared.value, offset, np.concatenate(values), cuts)

    counted = labelled.margin_counts(rows, found_margins)
    found, n, n_good = (counted.column(c).to_numpy() for c in ("margin", "n", "ones"))
    # a logistic curve through the margins; both classes count alike
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * found + shift, -40, 40)))
        error = shares[1] * n_good * (p - 1) + shares[0] * (n - n_good) * p
        slope -= 0.5 * (error @ found / total + 1e-3 * slope)
        shift -= 0.5 * error.sum() / total
    return Model(final, offset, float(max(slope, 1e-3)), float(shift))


def _in_lines(flat: np.ndarray) -> np.ndarray:
    return np.r_[flat, np.zeros(-len(flat) % LINE)].reshape(-1, LINE)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of each text; reads `doc_id, text` and `doc_id, quality`.

    Returns one row per input row: `doc_id, held_out, score, predicted`. The fit sees every
    labelled row that is not held out; scores come from the whole text alone. A null text
    is scored like an empty one. Labels that are null or neither 0 nor 1 are not learned from; with one
    class alone every text gets its score, with none score 0. Rows that repeat a doc_id are scored each;
    a null doc_id is not held out. Other columns are not read. An empty table gives no rows.
    """
    rows = labelled.stored_features(labelled.sample(docs, labels, "quality", MODULUS, REST), indicators)
    learned = learn(rows) or Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, -40.0)
    shared = docs.sparkSession.sparkContext.broadcast(vars(learned))  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                found = margins(model.weights, model.offset, *indicators(data, offsets))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc"), own.column("held_out"), pa.array(model.score(found))], ["doc", "held_out", "score"]
                )

    texts = docs.select(doc_key().alias("doc"), labelled.held_out(MODULUS, REST).alias("held_out"), "text")
    scored = texts.mapInArrow(run, "doc long, held_out boolean, score double")
    return scored.select(as_doc_id(F.col("doc")).alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
