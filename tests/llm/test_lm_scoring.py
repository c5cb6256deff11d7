"""Language-model scores: counts by brute force, shares that add up to one, gradients by differences, dirty rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from promptmill.llm import attention, lm_scoring

SCHEMA = "doc_id long, text string, row long, token string, n int, held_out string, round int, logs double, score string, rare int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows():
    r = np.random.RandomState(3)
    words = ["The", "of", "käse", "Über", "&&&", "x" * 90, "a b", "日本語のことば", "end."] + [f"w{i}en" for i in range(60)]
    texts = [" ".join(words[k] for k in np.minimum(r.zipf(1.4, n) - 1, len(words) - 1)) for n in [30] * 60 + [3, 1, 32, 33, 24, 25, 900]]
    texts += [None, "", " \n\t", "one  two\x0bthree", texts[0], texts[0], "É" * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None), (3, texts[5])]
    return [(i, t, 1, "t", 2, "h", 3, 4.0, "s", 5) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def scored(spark, rows):
    return lm_scoring.score(spark.createDataFrame(rows, SCHEMA).repartition(3), most=7).collect()


def _base(rows):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    c = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    total, distinct = sum(c.values()), len(c)
    return [
        (i, h, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(np.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), 6))
        for (i, ws), h in zip(tokens, held)
    ]


def test_counts_and_base_scores_equal_brute_force(rows, scored):
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == Counter(_base(rows))


def test_scores_are_logarithms_of_shares(scored):
    assert all(r.score < 0 for r in scored)
    repeated = [r.score for r in scored if r.doc_id in (0, 71, 72)]
    assert len(repeated) == 3 and np.ptp(repeated) < 1e-4


def test_most_frequent_words_alone_change_nothing(spark, rows, scored):
    again = lm_scoring.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score)
    for a, b in zip(sorted(scored, key=key), sorted(again, key=key)):
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score, rel=1e-3)


def test_learned_scores_beat_counts_of_pieces_on_held_out_texts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = lm_scoring.score(docs).where("held_out").groupBy().sum("score").first()[0]
    steps = lm_scoring.learn
    monkeypatch.setattr(lm_scoring, "learn", lambda windows, counts: steps(windows, counts, rounds=0))
    plain = lm_scoring.score(docs).where("held_out").groupBy().sum("score").first()[0]
    assert learned > 0.9 * plain  # both negative: at least a tenth less surprise


@pytest.mark.parametrize("length", [1, 31, 32, 33, 55, 56, 57, 200])
def test_every_piece_is_scored_once(length):
    offsets = np.array([0, 1, 1 + length, 1 + length + 40])
    leaves = np.arange(offsets[-1])
    rows, starts = lm_scoring._windows(offsets)
    inputs, targets, scored = lm_scoring._views(leaves, offsets, rows, starts, -1)
    assert sorted(targets[scored].tolist()) == leaves.tolist()
    own = inputs[:, lm_scoring.CONTEXT :]
    assert (own[scored] == np.where(np.isin(targets[scored], offsets[:-1]), -1, targets[scored] - 1)).all()
    for line, row, start in zip(inputs, rows, starts):
        for place, value in enumerate(line[: lm_scoring.CONTEXT]):
            at = start - lm_scoring.CONTEXT + place - 1
            assert value == (at if at >= offsets[row] else -1)


def test_shares_add_up_to_one():
    counts = np.random.RandomState(1).poisson(3.0, 3000)
    vocab, mass = lm_scoring.vocabulary(counts)
    params = lm_scoring.first_params(mass)
    inputs = np.random.RandomState(2).randint(0, 1024, (1, 32))
    scored = np.zeros((1, 24), bool)
    scored[0, 12] = True
    total = 0.0
    for leaf in range(1024):
        targets = np.zeros((1, 24), np.int64)
        targets[0, 12] = leaf
        share = np.exp(attention.log_shares(params, inputs, targets, scored)[0].astype(float))
        total += share * np.exp(vocab.within[vocab.leaf == leaf].astype(float)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_a_place_sees_no_later_one():
    params = lm_scoring.first_params(np.ones(1024))
    r = np.random.RandomState(4)
    x, y, s = r.randint(0, 1024, (2, 32)), r.randint(0, 1024, (2, 24)), np.ones((2, 24), bool)
    one = attention.log_shares(params, x, y, s)
    x[:, 20:] = 5
    other = attention.log_shares(params, x, y, s)
    assert np.allclose(one.reshape(2, 24)[:, :12], other.reshape(2, 24)[:, :12]) and not np.allclose(one, other)


def test_gradients_equal_differences():
    params = lm_scoring.first_params(np.random.RandomState(0).poisson(5.0, 1024) + 1.0)
    params = {k: v.astype(np.float64) for k, v in params.items()}
    r = np.random.RandomState(5)
    views = r.randint(0, 1024, (5, 32)), r.randint(0, 1024, (5, 24)), r.rand(5, 24) < 0.7
    sums, _, count = attention.gradient(params, *views)
    assert count == views[2].sum()
    for name, value in params.items():
        flat, at = value.reshape(-1), int(np.argmax(np.abs(sums[name])))
        losses = []
        for move in (1e-5, -2e-5):
            flat[at] += move
            losses.append(attention.gradient(params, *views)[1])
        flat[at] += 1e-5
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(sums[name].reshape(-1)[at], rel=2e-2)


def test_pieces_of_words_join_to_the_words(spark):
    ranks = lm_scoring.send_ranks(spark, lm_scoring.RANKS)
    encoder = lm_scoring._encoder(ranks)
    words = ["the", "ß" * 70, "a ", " ", "x.y", "日本語", "&&&", "w" * 33]
    ids, starts = encoder.pieces(pa.array([w.encode() for w in words], pa.binary()))
    pieces = {i: p for p, i in ranks.sent.value.items()}
    assert [b"".join(pieces[i] for i in ids[a:b]).decode() for a, b in zip(starts, starts[1:])] == [" " + w for w in words]


def test_without_training_texts_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "some words", *_rows()[0][2:])], SCHEMA)
    (row,) = lm_scoring.score(df).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_window_of_every_training_text_teaches_once(spark, rows):
    texts = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("doc_id", "coalesce(text, '') AS text")
    ranks = lm_scoring.send_ranks(spark, lm_scoring.RANKS)
    encoder = lm_scoring._encoder(ranks)
    counts = lm_scoring.word_counts(texts.select("text"))
    hot = spark.sparkContext.broadcast(lm_scoring.hot_words(counts.where("token is not null"), 7, encoder))
    windows = lm_scoring._by_round(texts, ranks, hot, rounds=3)
    found = [(k, np.frombuffer(r.pieces, np.int32), r.seen) for k in range(3) for r in windows(k).collect()]
    assert {k for k, _, _ in found} == {0, 1, 2}
    got = np.bincount(np.concatenate([p[seen:] for _, p, seen in found]), minlength=encoder.size)
    want = lm_scoring.piece_counts(counts, ranks, encoder.size)
    want[encoder.end] = len(rows)
    assert (got == want).all()


def test_a_training_task_cuts_its_windows_in_the_process_that_learns(spark, rows, monkeypatch):
    # two Python processes for each core went over an executor's memory
    table = type(spark.range(1))
    plans, collect = [], table.collect
    monkeypatch.setattr(table, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    lm_scoring.score(spark.createDataFrame(rows, SCHEMA), most=7)
    learned = [p.count("MapInArrow") for p in plans if "FlatMapGroupsInPandas" in p]
    assert learned == [1] * lm_scoring.ROUNDS


def test_runs_keep_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array([f"{n}:{i}".encode() for i in range(n)], pa.binary())], ["v"]) for n in (0, 3, 25, 10, 0, 7)]
    runs = list(lm_scoring._runs(iter(batches), 10))
    assert [r.num_rows for r in runs] == [10, 10, 10, 10, 5]
    assert [v for r in runs for v in r.column("v").to_pylist()] == [v for b in batches for v in b.column("v").to_pylist()]
    assert list(lm_scoring._runs(iter(batches[:1]), 10)) == []


def test_gradients_of_many_windows_are_sums_of_blocks():
    params = lm_scoring.first_params(np.random.RandomState(0).poisson(5.0, 1024) + 1.0)
    r = np.random.RandomState(6)
    n = 2 * attention.TOGETHER + 5
    views = r.randint(0, 1024, (n, 32)), r.randint(0, 1024, (n, 24)), r.rand(n, 24) < 0.7
    whole = attention.gradient(params, *views)
    parts = [attention.gradient(params, *(v[a : a + attention.TOGETHER] for v in views)) for a in range(0, n, attention.TOGETHER)]
    assert whole[2] == sum(p[2] for p in parts) and whole[1] == pytest.approx(sum(p[1] for p in parts))
    assert all(np.allclose(whole[0][k], sum(p[0][k].astype(float) for p in parts), atol=1e-6) for k in params)
    none = attention.gradient(params, *(v[:0] for v in views))
    assert none[1:] == (0.0, 0) and all(not none[0][k].any() and none[0][k].shape == params[k].shape for k in params)
