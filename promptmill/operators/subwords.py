"""Greedy longest-match subwords over a vocabulary learned from the corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.operators.scorer import row_runs
from promptmill.operators.vocabulary import SPECIAL_TOKENS, most_frequent, token_counts

INNER = "##"
LONGEST_PIECE = 8
# Tokens of texts that a task cuts at once.
TOKENS_AT_ONCE = 1 << 18


def subword_vocab(docs: DataFrame, size: int, longest: int = LONGEST_PIECE) -> DataFrame:
    """piece, n: the most frequent word starts and word continuations, up to `longest` letters.

    Words are counted before they are cut into pieces, so a frequent word is cut once.
    """
    words = token_counts(docs)
    letters = F.sequence(F.lit(1), F.length("token"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("token") - F.col("start") + 1))
    lead = F.when(F.col("start") > 1, INNER).otherwise("")
    pieces = (
        words.select("token", "n", F.explode(letters).alias("start"))
        .select("token", "n", "start", F.explode(sizes).alias("size"))
        .select(F.concat(lead, F.substring("token", F.col("start"), F.col("size"))).alias("token"), "n")
    )
    counted = pieces.groupBy("token").agg(F.sum("n").alias("n"))
    return most_frequent(counted, size).withColumnRenamed("token", "piece")


class Trie:
    """A vocabulary as arrays: edges sorted by node and letter, and the piece that ends in each node, or -1.

    Node 0 is where a word begins, node 1 where it goes on.
    """

    def __init__(self, pieces: Sequence[str]):
        self.pieces = pa.array(pieces, pa.string())
        inner = np.array([p.startswith(INNER) for p in pieces], bool)
        bare = pa.array([p[len(INNER) :] if i else p for p, i in zip(pieces, inner)], pa.string())
        letters, offsets = letters_of(bare)
        lengths = np.diff(offsets)
        node, known, level = inner.astype(np.int64), 2, 0
        ends: dict[int, int] = {}
        edges, targets = [], []
        left = np.arange(len(pieces))
        for i in left[lengths == 0]:
            ends.setdefault(int(node[i]), int(i))
        while len(left := left[lengths[left] > level]):
            step = (node[left] << _LETTER_BITS) + letters[offsets[left] + level]
            found, which = np.unique(step, return_inverse=True)
            edges.append(found)
            targets.append(known + np.arange(len(found)))
            node[left] = known + which
            known += len(found)
            level += 1
            for i in left[lengths[left] == level]:
                ends[int(node[i])] = int(i)
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges, self.targets = self.edges[order], (np.concatenate(targets) if targets else self.edges)[order]
        self.ends = np.full(known, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.deepest = level

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next node of each, or -1."""
        if not len(self.edges):
            return np.full(len(node), -1, np.int64)
        wanted = (node << _LETTER_BITS) + letter
        at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[at] == wanted, self.targets[at], -1)

    def split(self, words: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words one after the other, and where each word's begin, with the end appended.

        All words are walked at once, a letter at a time: the longest known piece at each position; -1 for a word in which some
        position has none.
        """
        letters, offsets = letters_of(words)
        at, end = offsets[:-1].copy(), offsets[1:]
        lost = np.zeros(len(words), bool)
        owners, taken = [], []
        open_ = np.flatnonzero(at < end)
        while len(open_):
            node = (at[open_] > offsets[open_]).astype(np.int64)
            best = np.full(len(open_), -1, np.int64)
            size = np.zeros(len(open_), np.int64)
            here = np.arange(len(open_))
            for depth in range(min(longest, self.deepest)):
                here = here[at[open_[here]] + depth < end[open_[here]]]
                node[here] = self.step(node[here], letters[at[open_[here]] + depth])
                here = here[node[here] >= 0]
                whole = here[self.ends[node[here]] >= 0]
                best[whole], size[whole] = self.ends[node[whole]], depth + 1
            lost[open_[best < 0]] = True
            open_, best, size = open_[best >= 0], best[best >= 0], size[best >= 0]
            owners.append(open_)
            taken.append(best)
            at[open_] += size
            open_ = open_[at[open_] < end[open_]]
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        piece = np.concatenate([np.zeros(0, np.int64), *taken])
        keep = ~lost[owner]
        unknown = np.flatnonzero(lost)
        owner, piece = np.r_[owner[keep], unknown], np.r_[piece[keep], np.full(len(unknown), -1)]
        order = np.argsort(owner, kind="stable")
        return piece[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


_LETTER_BITS = 21


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words as numbers, and where each word's begin, with the end appended."""
    joined = "".join(words.to_pylist())
    letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return letters, np.r_[0, np.cumsum(np.asarray(pc.utf8_length(words), np.int64))].astype(np.int64)


def subwords(tokens: Column, vocab: DataFrame, longest: int = LONGEST_PIECE) -> Column:
    """Pieces of every token, in order; a word in which some position has no piece is one unknown mark.

    The vocabulary has at most its `size` rows, short ones. Each distinct word of a batch is walked once, all of them together, and its pieces are put
    where it stands.
    """
    context = vocab.sparkSession.sparkContext
    shared = context.broadcast(Trie([r["piece"] for r in vocab.select("piece").collect()]))
    unknown = SPECIAL_TOKENS[1]

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = shared.value
        names = pa.concat_arrays([trie.pieces, pa.array([unknown])])
        for batch in batches:
            found = [np.zeros(1, np.int64)]
            pieces = []
            for run in row_runs(batch, TOKENS_AT_ONCE):
                lengths = np.asarray(pc.fill_null(pc.list_value_length(run), 0)).astype(np.int64)
                coded = pc.fill_null(run.flatten(), "").dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                piece, first = trie.split(coded.dictionary, longest)
                sizes = np.diff(first)[codes]
                ends = np.r_[0, np.cumsum(sizes)]
                places = np.repeat(first[:-1][codes] - ends[:-1], sizes) + np.arange(ends[-1])
                ids = np.where(piece < 0, len(trie.pieces), piece)[places]
                found.append(found[-1][-1] + ends[np.cumsum(lengths)])
                pieces.append(ids.astype(np.int32))
            offsets = np.concatenate(found).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(np.concatenate([np.zeros(0, np.int32), *pieces]))))

    return split(tokens)
