"""Pipeline stages on tables whose columns are named as the working columns of the operators."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from promptmill.llm import decontaminate, exact_dedup, labelled, mixing, near_dedup, toxicity

NAMES = (
    "_doc _sha _key _text_key _w _hit spans doc_key DOC_KEY_ text_digest hit_spans all_words hit_places row_key mix_doc mix_size"
    " repeats_ slice node doc digest"
).split()
EXTRA = {n: f"{n}-value" for n in NAMES}


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, "a"), (2, long, "a"), (3, long + " more", "b"), (4, None, None), (None, "lone text of six words", "b"), (5, "benchmark item words here", "a")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], schema)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "benchmark item words here")], "item_id long, text string")


def _check(found, docs, kept, added=()):
    assert found.columns == [*docs.columns, *added]
    rows = found.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in kept)
    assert all({n: r[n] for n in NAMES} == EXTRA for r in rows)


def test_stages_keep_the_callers_columns(docs, benchmark):
    _check(exact_dedup.keep_unique(docs), docs, [1, 3, 4, None, 5])
    _check(near_dedup.keep_representatives(docs), docs, [1, 4, None, 5])
    _check(decontaminate.remove_documents(docs, benchmark), docs, [1, 2, 3, 4, None])
    _check(decontaminate.remove_spans(docs, benchmark), docs, [1, 2, 3, 4, 5, None], ["clean_words"])
    _check(mixing.mixed_documents(docs), docs, [1, 2, 3, 4, 5, None], mixing.MIX_COLUMNS)


def test_toxic_filter_keeps_the_callers_columns(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (5, 1)], "doc_id long, toxic int")
    found = toxicity.remove_toxic(docs, labels)
    assert found.columns == docs.columns and all({n: r[n] for n in NAMES} == EXTRA for r in found.collect())


def test_mixed_documents_agree_with_the_mix(docs):
    mixed = {(r.doc_id, r.source): (r.repeats, r.taken) for r in mixing.mixed_documents(docs).collect()}
    assert mixed == {(r.doc_id, r.source): (r.repeats, r.taken) for r in mixing.mix(docs).collect()}
    assert mixing.mixed_documents(docs.where("false")).count() == 0
    again = mixing.mixed_documents(mixing.mixed_documents(docs))
    assert {(r.doc_id, r.source): (r.repeats, r.taken) for r in again.collect()} == mixed


def test_a_share_of_any_number_of_labels_is_met(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "0 AS toxic")
    few = labelled.sample(docs, labels, "toxic", 4, 2, most_rows=1000).count()
    assert 850 < few < 1150
    # a share below one step of 2**-20 is no longer rounded down to nothing
    share = labelled._STEPS
    assert 0 < 4000 / 5e9 * share < 1


def test_pipeline_returns_texts(spark, sf):
    found = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {"doc_id", "text", "lang", "source", "repeats", "taken"} <= set(found.columns)
    assert found.where("text is not null and repeats > 0").count() > 0


@pytest.mark.parametrize("label, modulus, rest", [("toxic", 4, 2), ("quality", 5, 0)])
def test_every_label_that_is_not_held_out_teaches(spark, label, modulus, rest):
    docs = spark.range(9_000).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(9_000).selectExpr("id AS doc_id", f"cast(id % 2 AS int) AS {label}")
    rows = labelled.stored_features(labelled.sample(docs, labels, label, modulus, rest), toxicity.features)
    want = [i for i in range(9_000) if zlib.crc32(str(i).encode()) % modulus != rest]
    sizes = labelled.class_sizes(rows)
    assert [sum(n for (_, k), n in sizes.items() if k == one) for one in (0, 1)] == [sum(i % 2 == one for i in want) for one in (0, 1)]
    having, ones = labelled.number_counts(rows, 1 << toxicity.BITS, lambda own: own[1:])
    assert having.max() == len(want) and ones.max() == sum(i % 2 for i in want)


def test_moves_of_tasks_are_weighed_by_their_rows(spark):
    rows = spark.range(0, 4, 1, 4).selectExpr("cast(id AS int) AS id")

    def move(batches):
        (i,) = [x for b in batches for x in b.column("id").to_pylist()]
        return np.array([20, i]), np.array([[i, 1.0], [5.0, 6.0]]), i + 1, i, 1

    ids, moves, loss, n = labelled.summed_moves(rows, move, 2)
    got = dict(zip(ids.tolist(), moves.tolist()))
    assert (loss, n) == (6, 4) and got.keys() == {0, 1, 2, 3, 20}
    assert got[20] == pytest.approx([(0 + 2 + 6 + 12) / 10, 1.0]) and got[2] == [5.0, 6.0]
