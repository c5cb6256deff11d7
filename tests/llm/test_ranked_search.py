"""Ranked search against brute force: intervals on random postings, whole tables with dirty rows, several blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from promptmill.llm import ranked_search

DOCS = "doc_id long, text string, doc long, term string, query long, score long, rank int, df long, length long, block int"
ITEMS = "item_id long, text string, doc_id long, query long, terms string, n int, block int, rank int"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return [t.translate(LOWER) for t in re.findall(TERM, text or "")]


def _brute(docs, items, best):
    """Multiset of (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    held = [c for _, c in counts if c]
    n_docs, length = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for doc, c in counts:
            n = sum(c.values())
            score = 0
            for t in _terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // length
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda s: s[:2] + (s[2] or 0,))[:best], 1):
            out[item, rank, doc, -score] += 1
    return out


def _texts():
    r = np.random.RandomState(8)
    words = ["The", "the", "naïve", "日本", "x1", "Über"] + [f"t{i}" for i in range(80)]
    draw = lambda n: " ".join(words[k] for k in np.minimum(r.zipf(1.3, n) - 1, len(words) - 1))
    docs = [(i, draw(r.randint(1, 60))) for i in range(150)]
    same = draw(25)
    docs += [(i, same) for i in range(300, 345)]  # more copies than ranks
    docs += [(5, docs[5][1]), (5, "t1 t2"), (None, same), (None, None), (400, ""), (401, " .,;! \n"), (402, "t3-t4_t5." * 4000)]
    items = [(k, draw(n)) for k, n in enumerate([5, 1, 40, 12, 30])] + [(10, same), (11, None), (12, "..."), (13, "unknownterm"), (None, "t7 T7 t9"), (10, "t1 t1 t1")]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = _texts()
    return (
        spark.createDataFrame([(i, t, 1, "t", 2, 3, 4, 5, 6, 7) for i, t in docs], DOCS).repartition(4),
        spark.createDataFrame([(i, t, 1, 2, "t", 3, 4, 5) for i, t in items], ITEMS),
    )


@pytest.mark.parametrize("best", [1, 20])
def test_dirty_rows_against_brute_force(tables, best):
    got = Counter(tuple(r) for r in ranked_search.search(*tables, best=best).select("item_id", "rank", "doc_id", "score").collect())
    assert got == _brute(*_texts(), best)


def test_blocks_of_queries_change_nothing(tables, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 20)
    got = Counter(tuple(r) for r in ranked_search.search(*tables).select("item_id", "rank", "doc_id", "score").collect())
    assert got == _brute(*_texts(), 20)


@pytest.mark.parametrize("whole", [0, 30, 1024])
@pytest.mark.parametrize("seed", range(6))
def test_intervals_against_brute_force(monkeypatch, seed, whole):
    monkeypatch.setattr(ranked_search, "WHOLE_POSTINGS", whole)
    r = np.random.RandomState(seed)
    n_docs, n_terms = int(r.randint(1, 400)), 12
    pairs = np.unique(r.randint(0, n_terms * n_docs, r.randint(1, 3 * n_docs)))
    term, doc = np.divmod(pairs, n_docs)
    impact = r.randint(0, 6 if seed % 2 else 10**9, len(pairs)).astype(np.int64)  # few values: many ties
    segment = ranked_search.Segment(term, doc, impact, n_docs, n_terms)
    ids = np.sort(r.randint(0, 2 * n_docs, n_docs))
    for _ in range(10):
        terms = np.sort(r.choice(n_terms, r.randint(1, n_terms), replace=False))
        repeats = r.randint(1, 4, len(terms))
        scores = np.zeros(n_docs, np.int64)
        for t, k in zip(terms, repeats):
            np.add.at(scores, doc[term == t], k * impact[term == t])
        order = sorted((-s, d) for d, s in enumerate(scores.tolist()) if s)
        assert ranked_search.best_in(segment, terms, repeats, ids, 7) == [(-s, d) for s, d in order[:7]]
        if len(order) > 3:
            floor = (-order[3][0], int(ids[order[3][1]]))
            want = [(-s, d) for s, d in order if (-s, -ids[d]) > (floor[0], -floor[1])]
            assert ranked_search.best_in(segment, terms, repeats, ids, 7, floor) == want[:7]


def test_range_maxima_take_the_first_of_equals():
    impact = np.array([3, 1, 3, 3, 0, 2, 2], np.int64)
    segment = ranked_search.Segment(np.zeros(7, np.int64), np.arange(7), impact, 7, 1)
    for lo in range(7):
        for hi in range(lo + 1, 8):
            place, value = segment.largest(np.array([lo]), np.array([hi]))
            assert (place[0], value[0]) == (lo + int(np.argmax(impact[lo:hi])), impact[lo:hi].max())


def test_empty_tables(spark, tables):
    docs, items = tables
    assert ranked_search.search(docs.where("false"), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0
    assert ranked_search.search(docs.where("doc_id >= 400"), items.where("item_id = 12")).count() == 0
