import pytest
from pyspark.sql import functions as F

from promptmill.operators import prompts, vocabulary
from promptmill.tasks import TASKS


def test_vocabulary_order_and_size(spark):
    docs = spark.createDataFrame([(1, ["y", "y", "x", "z", "hate"]), (2, ["x", "zz"])], "guid bigint, tokens array<string>")
    full = vocabulary.build_vocab(docs).orderBy("id").collect()
    prompt_words = [r["token"] for r in full if r["n"] == 0][5:]
    assert [r["token"] for r in full[:5]] == list(vocabulary.SPECIAL_TOKENS)
    assert prompt_words == sorted(prompt_words) and "hate" in prompt_words
    assert [r["token"] for r in full if r["n"]] == ["x", "y", "z", "zz"]
    assert [r["id"] for r in full] == list(range(len(full)))
    small = vocabulary.build_vocab(docs, size=5 + len(prompt_words) + 2 + 10, reserved=10)
    assert [r["token"] for r in small.filter("n > 0").orderBy("id").collect()] == ["x", "y"]


def test_lookup_is_the_same_with_and_without_broadcast(spark):
    docs = spark.createDataFrame([(1, ["x", "a", "x"]), (2, []), (3, ["q"])], "guid bigint, tokens array<string>")
    vocab = spark.createDataFrame([("a", 7, 0), ("x", 8, 0)], "token string, id int, n bigint")
    for limit in (0, 1 << 20):
        ids = vocabulary.token_ids(docs, vocab, ["guid"], limit=limit)
        assert {r["guid"]: r["ids"] for r in ids.collect()} == {1: [8, 7, 8], 2: [], 3: [1]}
    plan = vocabulary.token_ids(docs, vocab, ["guid"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_most_frequent_breaks_ties_by_token(spark):
    counts = spark.createDataFrame([(f"t{i:03d}", 5 if i < 3 else 2 if i < 60 else 1) for i in range(200)], "token string, n bigint")
    for k in (1, 3, 10, 60, 61, 200, 500):
        got = {r["token"] for r in vocabulary.most_frequent(counts, k).collect()}
        assert got == {f"t{i:03d}" for i in range(min(k, 200))}


def test_more_ids_than_reserved_fail(spark):
    prompt = vocabulary.prompt_tokens(spark, spark.createDataFrame([], "token string, id int"))
    with pytest.raises(Exception, match="more than the 4 reserved ids"):
        vocabulary.reserved_ids(prompt, reserved=4).collect()
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(200)], "vec_id bigint, embedding array<float>")
    remap = spark.createDataFrame([(i, 100 + i) for i in range(70)], "old_id int, new_id int")
    with pytest.raises(ValueError):
        vocabulary.copy_rows(vectors, remap)
    assert vocabulary.copy_rows(vectors, remap, reserved=70).filter("vec_id = 169").first()["embedding"] == [69.0]


def test_reserved_ids_are_disjoint_from_the_sentiment_ids(spark):
    lookup = spark.createDataFrame([], "token string, id int")
    prompt = vocabulary.prompt_tokens(spark, lookup)
    reserved = vocabulary.reserved_ids(prompt, first=vocabulary.SENTIMENT_IDS)
    frame, words = vocabulary.sentiment_reserved_ids()
    assert frame == [30521, 30520, 30519] and words == [30518, 30517, 30516]
    for task in TASKS:
        ids = [r["new_id"] for r in reserved.filter(F.col("task") == task.task).orderBy("ord").collect()]
        assert ids == list(range(30515, 30515 - len(ids), -1))
        assert not set(ids) & set(frame + words)


def test_row_copy_and_overlap(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>")
    remap = spark.createDataFrame([(0, 4), (1, 3)], "old_id int, new_id int")
    got = {r["vec_id"]: r["embedding"][0] for r in vocabulary.copy_rows(vectors, remap).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: 1.0, 4: 0.0}
    with pytest.raises(ValueError):
        vocabulary.copy_rows(vectors, spark.createDataFrame([(0, 4), (4, 3)], "old_id int, new_id int"))


def test_random_rows_stay_in_bounds(spark):
    vectors = spark.createDataFrame([(i, [0.5, -2.0, 1.0]) for i in range(20)], "vec_id bigint, embedding array<float>")
    remap = spark.createDataFrame([(0, 19), (1, 18)], "old_id int, new_id int")
    got = {r["vec_id"]: r["embedding"] for r in vocabulary.randomize_rows(vectors, remap, 3).collect()}
    assert all(got[i] == [0.5, -2.0, 1.0] for i in range(18))
    assert all(abs(x) <= 2.0 for i in (18, 19) for x in got[i]) and got[18] != got[19]


def test_filter_lets_every_known_token_through_and_stops_most_others(spark):
    lookup = spark.range(3000).selectExpr("concat('k', id) AS token", "int(id) AS id")
    may = vocabulary.maybe_known(lookup)
    rows = spark.createDataFrame([(1, [f"k{i}" for i in range(3000)]), (2, [f"u{i}" for i in range(3000)]), (3, []), (4, None)], "guid int, tokens array<string>")
    got = {r["guid"]: r["m"] for r in rows.select("guid", may(F.col("tokens")).alias("m")).collect()}
    assert all(got[1]) and len(got[1]) == 3000 and sum(got[2]) < 90 and not got[3] and not got[4]
    assert len(vocabulary.known_filter(lookup, 0)) == 1 << (vocabulary.LEAST_BITS - 6)


def test_encoding_beyond_a_broadcast_is_the_same(spark, sf):
    from promptmill.plans import queries

    rows = queries._task_rows(spark, sf).withColumn("text_b", F.when(F.col("guid") % 3 == 0, F.concat(F.lit("second "), "text_a")))
    lookup = queries._lookup(spark, sf)
    slots = prompts.task_slots(vocabulary.prompt_tokens(spark, lookup))
    for given in (rows, rows.drop("text_b")):
        want, got = (prompts.encode(given, slots, lookup, 64, limit=limit) for limit in (vocabulary.BROADCAST_BYTES, 0))
        order = lambda df: sorted(map(str, df.collect()))
        assert want.columns == got.columns and order(want) == order(got)
