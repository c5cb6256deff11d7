"""Every operator as a query over the given tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions.arrays import argmax, gather, max_abs, softmax, total_int
from promptmill.operators import classifier, metrics, prompts, sampling, scorer, vocabulary
from promptmill.operators import history as runs
from promptmill.operators.examples import accepted, canonical, rejected
from promptmill.operators.subwords import subword_vocab, subwords
from promptmill.plans import inputs, stages
from promptmill.sources import corpus, sinks
from promptmill.sources.storage import materialize, new_path, remove
from promptmill.tasks import (
    MASK,
    TASKS,
    TEXT_A,
    TEXT_B,
    Task,
    has_sentiment,
    literal_parts,
    resolve_tasks,
)

# Parameters of the registered queries.
MAX_LEN = 512
SHORT_LEN = 16
BATCH = 32
TRAIN_BATCH = 16
EPOCHS = 10
WARMUP = 0.05
PATIENCE = 5
EVAL_EVERY = 10
SHOTS, SEED = 128, 9
LABEL_WORDS = (3, 5, 7)
SUBWORDS = 4000
PATTERNS = list(dict.fromkeys(t.pattern for t in TASKS))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(values: Column | str) -> Column:
    """An array as one string, so that any engine can compare it."""
    values = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


# --- sources and sinks ---------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    path = new_path(spark, "documents_csv")
    sinks.write_csv(inputs.documents(spark, sf), path)
    return corpus.read_csv(spark, path).withColumn("n_chars", F.col("n_chars").cast("bigint"))


@query
def csv_split_read(spark, sf):
    """Cells with quotes and line breaks, in files of which each is read by many tasks."""
    path = new_path(spark, "documents_lines_csv")
    text = F.replace("text", F.lit(". "), F.lit('.\n\n"'))
    sinks.write_csv(inputs.documents(spark, sf).select("guid", text.alias("text"), "lang"), path)
    return corpus.read_csv_split(spark, path)


def _read_family(spark, sf, task, column):
    path = new_path(spark, f"corpus_{column}")
    rows = inputs.examples(spark, sf).select(
        "guid", F.col("text_a").alias(column), "label", F.col("senti_gold").alias("senti_pre")
    )
    sinks.write_csv(rows, path)
    read = corpus.read_examples(spark, path, task, "train")
    return read.select("guid", "text_a", "text_b", "label", "idx", "senti_pre", F.size("meta").alias("n_meta"))


@query
def read_examples_post(spark, sf):
    return _read_family(spark, sf, "SBIC_v2", "post")


@query
def read_examples_text_joined(spark, sf):
    return _read_family(spark, sf, "hatexplain_thr", "text_joined")


@query
def read_examples_text(spark, sf):
    return _read_family(spark, sf, "hs18", "text")


@query
def read_examples_comment(spark, sf):
    return _read_family(spark, sf, "t4sa_ethos", "comment")


@query
def task_specs(spark, sf):
    rows = resolve_tasks(inputs.task_examples(spark, sf))
    return rows.select(
        "guid",
        "task",
        "text_column",
        "reads_sentiment",
        F.array_join("pattern", "|").alias("pattern"),
        joined("labels").alias("labels"),
        F.array_join("verbalizers", "|").alias("verbalizers"),
    )


def _train_rows(spark, sf):
    return inputs.examples(spark, sf).filter(F.col("split") == "train").select("guid", "label")


def _sample(spark, sf):
    return sampling.few_shot(_train_rows(spark, sf))


@query
def sweep_partition_read(spark, sf):
    path = new_path(spark, "sweep")
    rows = _sample(spark, sf).withColumn("n", F.explode(sampling.sizes_holding(F.col("rank"))))
    corpus.write_sweep(rows, path)
    return corpus.read_sweep(spark, path, 64, 99).select("n", "seed", "rank", "guid", "label")


def _annotated_documents(spark, sf):
    model = stages.learn_sentiment(inputs.examples(spark, sf))
    return stages.annotate(inputs.documents(spark, sf), model, ["guid"], "text")


@query
def annotate_sink(spark, sf):
    path = new_path(spark, "annotated_csv")
    sinks.write_annotated(_annotated_documents(spark, sf), path)
    back = corpus.read_csv(spark, path)
    return back.select(
        "guid",
        "text",
        "lang",
        "source",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.col("senti_pre").cast("int").alias("senti_pre"),
    )


@query
def sink_if_absent(spark, sf):
    rows = inputs.examples(spark, sf)
    folder = new_path(spark, "if_absent")

    def targets(value):
        return {
            f"{folder}/{s}": rows.filter(F.col("split") == s).select("guid", "split", value.alias("senti_pre"))
            for s in ("dev", "test")
        }

    # A target that was cut off before its end is not taken for a result.
    sinks.write_annotated(rows.select("guid", "split", F.lit(-2).alias("senti_pre")), f"{folder}/dev", "parquet")
    remove(spark, f"{folder}/dev/_SUCCESS")
    wrote = sinks.write_if_absent(targets(F.col("senti_gold")), "parquet")
    again = sinks.write_if_absent(targets(F.lit(-1)), "parquet")
    read = spark.read.parquet(f"{folder}/dev", f"{folder}/test")
    return read.withColumn("wrote", F.lit(wrote)).withColumn("wrote_again", F.lit(again))


@query
def predictions_sink(spark, sf):
    path = new_path(spark, "predictions")
    sinks.write_predictions(predict_argmax(spark, sf), path)
    return spark.read.parquet(path)


def _toxic_model(spark, sf):
    rows = stages.tokenized(inputs.examples(spark, sf).filter(F.col("split") == "train"))
    return scorer.train(scorer.one_model(rows, "label", 2), 2)


def _toxic_scores(spark, sf, splits=("dev", "test")):
    rows = stages.tokenized(inputs.examples(spark, sf).filter(F.col("split").isin(*splits)))
    return scorer.score(rows, _toxic_model(spark, sf), ["guid", "split", "label"])


@query
def metric_log_long(spark, sf):
    path = new_path(spark, "metric_log")
    scored = materialize(_toxic_scores(spark, sf, ("train", "dev", "test")), "scores")
    keys, names = ["run", "step", "split"], ["precision", "accuracy", "f1_score"]
    evaluated = metrics.binary_metrics(scored.filter(F.col("split") != "train"), ["split"])
    evaluated = evaluated.select(F.lit("toxic").alias("run"), F.lit(0).cast("bigint").alias("step"), "split", *names)
    sinks.append_metrics(metrics.metric_log(evaluated, keys, names), path)
    batches = sampling.assign_batches(scored.filter(F.col("split") == "train"), TRAIN_BATCH)
    losses = metrics.batch_losses(metrics.with_cross_entropy(batches, "label"))
    trained = losses.select(
        F.lit("toxic").alias("run"), (F.col("batch_id") + 1).alias("step"), F.lit("train").alias("split"), "loss"
    )
    sinks.append_metrics(metrics.metric_log(trained, keys, ["loss"]), path)
    return spark.read.parquet(path).select(*keys, "metric", r6("value").alias("value"))


@query
def scorer_roundtrip(spark, sf):
    path = new_path(spark, "scorer")
    scorer.save_scorer(_toxic_model(spark, sf), path)
    rows = stages.tokenized(inputs.examples(spark, sf).filter(F.col("split") != "train"))
    return scorer.score(rows, scorer.load_scorer(spark, path), ["guid", "split"]).select("guid", "split", "pred")


# --- projections and predicates ------------------------------------------------------------


@query
def canonical_examples(spark, sf):
    rows = canonical(inputs.examples(spark, sf))
    return rows.select(
        "guid", "text_a", "text_b", "label", "idx", "senti_pre",
        F.size("meta").alias("n_meta"), F.col("logits").isNull().alias("no_logits"),
    )


@query
def prompt_text(spark, sf):
    rows = inputs.examples(spark, sf).select("guid", "text_a", "senti_gold")
    patterns = F.array(*[F.array(*[F.lit(p) for p in pattern]) for pattern in PATTERNS])
    each = rows.select("*", F.posexplode(patterns).alias("pattern_no", "pattern"))
    text = prompts.prompt_text(F.col("pattern"), F.col("text_a"), F.col("senti_gold"))
    return each.select("guid", "pattern_no", text.alias("prompt"))


@query
def sentiment_prompt(spark, sf):
    rows = inputs.examples(spark, sf)
    return rows.select("guid", prompts.sentiment_prompt(F.col("senti_gold")).alias("sentiment_prompt"))


def _mixed_quality(spark, sf):
    """Examples of all tasks in which some texts, labels and sentiments cannot be used."""
    guid = F.col("guid")
    rows = inputs.examples(spark, sf).select(
        "guid",
        F.when(guid % 13 != 0, F.col("text_a")).alias("text_a"),
        F.lit(None).cast("string").alias("text_b"),
        F.col("senti_gold").alias("label"),
        F.when(guid % 11 == 0, 3).when(guid % 11 == 1, -1).otherwise(F.col("senti_gold")).alias("senti_pre"),
        inputs.task_of(guid).alias("task"),
    )
    return resolve_tasks(rows)


@query
def label_index(spark, sf):
    return accepted(_mixed_quality(spark, sf)).select("guid", "task", "label", "label_id")


@query
def label_rejects(spark, sf):
    return rejected(_mixed_quality(spark, sf)).select("guid", "task", "reason")


def _lookup(spark, sf):
    built = vocabulary.build_vocab(inputs.document_tokens(spark, sf))
    return vocabulary.lookup_ready(materialize(built, "vocab"))


def _task_rows(spark, sf):
    rows = resolve_tasks(inputs.task_examples(spark, sf).withColumn("text_b", F.lit(None).cast("string")))
    return accepted(rows)


def _encoded(spark, sf, max_len=MAX_LEN):
    lookup = _lookup(spark, sf)
    prompt = materialize(vocabulary.prompt_tokens(spark, lookup), "prompt_tokens")
    slots = prompts.task_slots(prompt)
    return prompts.encode(_task_rows(spark, sf), slots, lookup, max_len), prompt


@query
def verbalizer_target(spark, sf):
    slots = prompts.task_slots(vocabulary.prompt_tokens(spark, _lookup(spark, sf))).select("task", "verbalizer_ids")
    rows = _task_rows(spark, sf).join(F.broadcast(slots), "task")
    word = F.get("verbalizers", F.col("label_id"))
    return rows.select(
        "guid", "task", "label_id", word.alias("word"), F.get("verbalizer_ids", F.col("label_id")).alias("target_id")
    )


@query
def mask_position(spark, sf):
    rows, _ = _encoded(spark, sf)
    masks = F.size(F.filter("pet_flags", lambda f: f == -1))
    return rows.select(
        "guid", "task", prompts.mask_position(F.col("pet_flags")).alias("mask_pos"), masks.alias("n_masks")
    )


@query
def pattern_literals(spark, sf):
    rows = resolve_tasks(inputs.task_examples(spark, sf))
    literals = F.posexplode(literal_parts(F.col("pattern"))).alias("ord", "literal")
    return rows.select("task", literals).groupBy("task", "ord", "literal").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def eval_steps(spark, sf):
    steps = inputs.history(spark, sf)
    return steps.filter(runs.due(F.col("step"), EVAL_EVERY)).select("run", "step", "value")


@query
def has_sentiment_prompt(spark, sf):
    rows = resolve_tasks(inputs.task_examples(spark, sf))
    return rows.groupBy("task", has_sentiment(F.col("pattern")).alias("has_sentiment")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


# --- joins ---------------------------------------------------------------------------------


@query
def append_predictions(spark, sf):
    return _annotated_documents(spark, sf).select("guid", "lang", "source", "n_chars", "senti_pre")


@query
def vocab_ids(spark, sf):
    ids = vocabulary.token_ids(inputs.document_tokens(spark, sf), _lookup(spark, sf), ["guid"])
    return ids.select("guid", joined("ids").alias("ids"))


@query
def id_remap_first(spark, sf):
    rows, prompt = _encoded(spark, sf)
    remap = vocabulary.remap_columns(vocabulary.reserved_ids(prompt))
    done = prompts.get_strategy("skip_first")(rows, remap)
    return done.select("guid", "task", joined("input_ids").alias("input_ids"), "pet_label")


def _remapped_second(spark, sf, max_len=MAX_LEN):
    rows, prompt = _encoded(spark, sf, max_len)
    reserved = vocabulary.reserved_ids(prompt, first=vocabulary.SENTIMENT_IDS)
    sentiment_rows = rows.filter(has_sentiment(F.col("pattern")))
    return prompts.get_strategy("skip_second")(sentiment_rows, vocabulary.remap_columns(reserved))


@query
def id_remap_second(spark, sf):
    return _remapped_second(spark, sf).select("guid", "task", joined("input_ids").alias("input_ids"), "pet_label")


@query
def verbalizer_logits(spark, sf):
    rows = inputs.vector_logits(spark, sf)
    chosen = gather(F.col("logits"), F.array(*[F.lit(c) for c in LABEL_WORDS]))
    return rows.select("guid", F.posexplode(chosen).alias("pos", "logit")).withColumn("logit", r6("logit"))


@query
def target_ids(spark, sf):
    prompt = materialize(vocabulary.prompt_tokens(spark, _lookup(spark, sf)), "prompt_tokens")
    remap = vocabulary.remap_columns(vocabulary.reserved_ids(prompt)).select("task", "label_new")
    rows = _task_rows(spark, sf).join(F.broadcast(remap), "task")
    return rows.select("guid", "task", "label_id", F.get("label_new", F.col("label_id")).alias("target_id"))


def _vector_remap(spark, sf, vectors):
    prompt = vocabulary.prompt_tokens(spark, _lookup(spark, sf)).filter(F.col("task") == "sbic")
    return vocabulary.reserved_ids(prompt, vectors.count())


def _long_vectors(vectors):
    return vectors.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", "i", r6(F.col("x").cast("double")).alias("x")
    )


@query
def embedding_row_copy(spark, sf):
    vectors = inputs.table(spark, sf, "embeddings")
    remap = materialize(_vector_remap(spark, sf, vectors), "remap")
    return _long_vectors(vocabulary.copy_rows(vectors, remap))


@query
def encode_rejects(spark, sf):
    lookup = _lookup(spark, sf)
    slots = prompts.task_slots(vocabulary.prompt_tokens(spark, lookup))
    return prompts.encode_rejects(_task_rows(spark, sf), slots, lookup, SHORT_LEN)


# A task of the caller's own: a second text in the prompt.
PAIR_TASK = Task("pair", "text", False, (TEXT_A, TEXT_B, "Same tone ?", MASK, "."), ("No", "Yes"))


@query
def encode_own_task(spark, sf):
    """A pattern with two texts that is none of the 17; the second text is the document's language."""
    lookup = _lookup(spark, sf)
    slots = prompts.task_slots(vocabulary.prompt_tokens(spark, lookup, tasks=[PAIR_TASK]))
    rows = inputs.examples(spark, sf).select(
        "guid", "text_a", F.concat_ws(" ", F.lit("split"), "split").alias("text_b"), "label", F.lit(None).cast("int").alias("senti_pre"),
        F.lit("pair").alias("task"),
    )
    encoded = prompts.encode(accepted(resolve_tasks(rows, [PAIR_TASK])), slots, lookup, MAX_LEN)
    return encoded.select("guid", joined("input_ids").alias("input_ids"), joined("pet_flags").alias("pet_flags"), "first_segment", "pet_label")


@query
def encode_prompt(spark, sf):
    rows, _ = _encoded(spark, sf)
    return rows.select(
        "guid",
        "task",
        joined("input_ids").alias("input_ids"),
        joined("pet_flags").alias("pet_flags"),
        "first_segment",
        "pet_label",
    )


def _cells(spark, sf):
    held = (
        _sample(spark, sf)
        .select("seed", F.explode(sampling.sizes_holding(F.col("rank"))).alias("n"))
        .groupBy("n", "seed")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return F.broadcast(sampling.sweep_grid(spark)).join(held, ["n", "seed"])


@query
def sweep_grid(spark, sf):
    return _cells(spark, sf).select("cell", "n", "seed", "n_rows")


# --- aggregations --------------------------------------------------------------------------


@query
def batch_collate(spark, sf):
    rows = sampling.assign_batches(inputs.examples(spark, sf).select("guid", "label", "senti_gold"), TRAIN_BATCH)
    batches = sampling.collate(rows, ["guid", "label", "senti_gold"])
    return batches.select("batch_id", joined("guid").alias("guids"), joined("label").alias("labels"), joined("senti_gold").alias("sentis"))


def _vector_losses(spark, sf):
    rows = sampling.assign_batches(inputs.vector_logits(spark, sf), BATCH)
    return metrics.batch_losses(metrics.with_cross_entropy(rows, "label"))


@query
def batch_loss(spark, sf):
    return _vector_losses(spark, sf).select("batch_id", r6("loss").alias("loss"), "n_rows")


@query
def eval_loss(spark, sf):
    total = metrics.reported_loss(_vector_losses(spark, sf))
    return total.select(r6("loss").alias("loss"), r6("mean_loss").alias("mean_loss"))


def _vector_predictions(spark, sf):
    return inputs.vector_logits(spark, sf).select("guid", "label", argmax(F.col("logits")).alias("pred"))


@query
def confusion(spark, sf):
    return metrics.confusion(_vector_predictions(spark, sf))


def _rounded(df, names):
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


@query
def metrics_binary(spark, sf):
    return _rounded(metrics.binary_metrics(_toxic_scores(spark, sf)), ["precision", "accuracy", "f1_score"])


@query
def metrics_multi(spark, sf):
    return _rounded(metrics.macro_metrics(_vector_predictions(spark, sf)), ["accuracy", "f1_score"])


@query
def batch_precision(spark, sf):
    rows = sampling.assign_batches(materialize(_toxic_scores(spark, sf), "scores"), TRAIN_BATCH)
    by_batch = metrics.binary_metrics(rows, ["batch_id"])
    return by_batch.select("batch_id", "n_rows", r6("precision").alias("precision"), r6("accuracy").alias("micro_precision"))


def _even_logits(spark, sf):
    """Logits in whole millionths, so that equal scores are equal in any engine."""
    return inputs.vector_logits(spark, sf).withColumn("logits", F.transform("logits", r6))


@query
def auroc_ovo(spark, sf):
    rows = _even_logits(spark, sf).select("label", softmax(F.col("logits")).alias("probs"))
    result = metrics.auroc_ovo(rows, inputs.VECTOR_CLASSES)
    return result.select(r6("AUROC_score").alias("AUROC_score"), "undefined_pairs")


@query
def evaluate_task_types(spark, sf):
    vectors = _even_logits(spark, sf).withColumn("pred", argmax(F.col("logits")))
    several = metrics.evaluate(materialize(vectors, "scores"), "multiclass", inputs.VECTOR_CLASSES, BATCH, "all")
    toxic = materialize(_toxic_scores(spark, sf, ("test",)), "scores")
    two = metrics.evaluate(toxic, "binary", (0, 1), TRAIN_BATCH, "test")
    return several.unionByName(two).select("split", "metric", r6("value").alias("value"))


@query
def sweep_steps(spark, sf):
    steps, warmup = sampling.step_counts(F.col("n_rows"), TRAIN_BATCH, EPOCHS, WARMUP)
    return _cells(spark, sf).select("n", "seed", steps.alias("steps"), warmup.alias("warmup"))


def _parts(spark, sf, max_len):
    lookup = _lookup(spark, sf)
    slots = prompts.task_slots(vocabulary.prompt_tokens(spark, lookup))
    return prompts.fitted(_task_rows(spark, sf), slots, lookup, max_len, whole=True)


@query
def part_lengths(spark, sf):
    rows = _parts(spark, sf, MAX_LEN)
    return rows.select("guid", "task", total_int(F.col("part_lengths")).alias("total_length"))


@query
def vector_max_abs(spark, sf):
    return inputs.table(spark, sf, "embeddings").select("vec_id", r6(max_abs(F.col("embedding"))).alias("max_abs"))


@query
def vocab_build(spark, sf):
    return vocabulary.build_vocab(inputs.document_tokens(spark, sf))


@query
def train_token_weights(spark, sf):
    model = _toxic_model(spark, sf)
    entries = model.weights.filter(F.col("token") != scorer.PRIOR_TOKEN).select("token", F.inline("cells"))
    pairs = F.posexplode(F.arrays_zip("n", "weight")).alias("class", "pair")
    return entries.select("token", pairs).select(
        "class", "token", F.col("pair.n").alias("n"), F.round(F.col("pair.weight") / 1e9, 4).alias("weight")
    )


@query
def train_logistic(spark, sf):
    rows = stages.tokenized(inputs.examples(spark, sf))
    model = classifier.train_logistic(rows.filter(F.col("split") == "train"))
    return classifier.predict_logistic(model, rows.filter(F.col("split") != "train"), ["guid", "split", "label"])


# --- orders over long histories -------------------------------------------------------------


@query
def batch_assign(spark, sf):
    return sampling.assign_batches(inputs.examples(spark, sf).select("guid"), BATCH)


@query
def reserved_ids(spark, sf):
    prompt = materialize(vocabulary.prompt_tokens(spark, _lookup(spark, sf)), "prompt_tokens")
    first = vocabulary.reserved_ids(prompt).withColumn("strategy", F.lit("skip_first"))
    second = vocabulary.reserved_ids(prompt, first=vocabulary.SENTIMENT_IDS).withColumn("strategy", F.lit("skip_second"))
    return first.unionByName(second).select("strategy", "task", "kind", "ord", "token", "old_id", "new_id")


def _stored_history(spark, sf):
    return materialize(inputs.history(spark, sf), "history")


@query
def best_so_far(spark, sf):
    rows = runs.best_so_far(_stored_history(spark, sf))
    return rows.select("run", "step", "value", "best_before", "improved")


@query
def early_stop(spark, sf):
    return runs.early_stop(_stored_history(spark, sf), PATIENCE)


@query
def test_on_improve(spark, sf):
    rows = _stored_history(spark, sf)
    return runs.tests_of_improved_steps(
        rows.select("run", "step", "value"), rows.select("run", "step", "test_value")
    )


# --- sorts, samples, splits ------------------------------------------------------------------


@query
def predict_argmax(spark, sf):
    return _vector_predictions(spark, sf).select("guid", "pred")


@query
def seeded_shuffle(spark, sf):
    return sampling.seeded_shuffle(_train_rows(spark, sf), SEED, 2).select("guid", "epoch", "shuffle_pos")


@query
def best_checkpoint(spark, sf):
    return runs.best_checkpoint(inputs.history(spark, sf))


@query
def truncate_parts(spark, sf):
    rows = _parts(spark, sf, SHORT_LEN)
    return rows.select("guid", "task", joined("kept").alias("kept"))


@query
def few_shot_sample(spark, sf):
    return _sample(spark, sf).select("seed", "rank", "guid", "label")


@query
def concat_batches(spark, sf):
    model = _toxic_model(spark, sf)
    rows = stages.tokenized(inputs.examples(spark, sf))

    def scored(split):
        return scorer.score(rows.filter(F.col("split") == split), model, ["guid", "split"])

    return scored("dev").unionByName(scored("test")).select("guid", "split", "pred")


@query
def metrics_by_split(spark, sf):
    rows = metrics.binary_metrics(_toxic_scores(spark, sf), ["split"])
    return _rounded(rows, ["precision", "accuracy", "f1_score"])


# --- columns of the encode and score jobs ----------------------------------------------------


@query
def tokenize(spark, sf):
    rows = inputs.document_tokens(spark, sf)
    return rows.select("guid", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def subword_pieces(spark, sf):
    rows = inputs.document_tokens(spark, sf)
    vocab = materialize(subword_vocab(rows, SUBWORDS), "subwords")
    return rows.select("guid", subwords(F.col("tokens"), vocab).alias("pieces")).select(
        "guid", F.size("pieces").alias("n_pieces"), F.array_join("pieces", " ").alias("pieces")
    )


def _padded(spark, sf, max_len=MAX_LEN):
    rows, _ = _encoded(spark, sf, max_len)
    return prompts.pad(rows, max_len)


@query
def encode_padded(spark, sf):
    names = ["input_ids", "attention_mask", "token_type_ids", "pet_flags"]
    return _padded(spark, sf).select("guid", "task", "label_id", "senti_pre", *[joined(n).alias(n) for n in names])


def _long(df, column, value, *keep):
    return df.select(*keep, F.posexplode(column).alias("class", value)).withColumn(value, r6(value))


@query
def softmax_probs(spark, sf):
    rows = inputs.vector_logits(spark, sf).select("guid", softmax(F.col("logits")).alias("probs"))
    return _long(rows, "probs", "prob", "guid")


@query
def ce_labels(spark, sf):
    rows = inputs.vector_logits(spark, sf).filter(F.col("label").isin(*LABEL_WORDS))
    target = (F.array_position(F.array(*[F.lit(c) for c in LABEL_WORDS]), F.col("label")) - 1).cast("int")
    losses = metrics.with_cross_entropy(rows.withColumn("label_id", target), "label_id", positions=LABEL_WORDS)
    return losses.select("guid", "label_id", r6("ce").alias("ce"))


@query
def ce_full(spark, sf):
    rows = metrics.with_cross_entropy(inputs.vector_logits(spark, sf), "label")
    return rows.select("guid", r6("ce").alias("ce"))


@query
def checkpoint_name(spark, sf):
    best = runs.best_checkpoint(inputs.history(spark, sf))
    return best.select("run", runs.checkpoint_name(F.col("best_value"), "output/").alias("name"))


@query
def embedding_random_init(spark, sf):
    vectors = inputs.table(spark, sf, "embeddings")
    remap = materialize(_vector_remap(spark, sf, vectors), "remap")
    return _long_vectors(vocabulary.randomize_rows(vectors, remap, SEED))


# --- scoring -------------------------------------------------------------------------------


def checksum_scorer():
    """A stand-in for an external model: logits from the ids alone, the same in any engine."""

    def run(batch):
        out = []
        for ids, mask, types, at in zip(
            batch["input_ids"], batch["attention_mask"], batch["token_type_ids"], batch["mask_pos"]
        ):
            base = int((ids * mask).sum()) + 3 * int(types.sum()) + 7 * int(at)
            out.append([((base * (c + 1)) % 1009) / 1009 for c in range(2)])
        return out

    return run


@query
def batch_scorer(spark, sf):
    rows = _padded(spark, sf).withColumn("mask_pos", prompts.mask_position(F.col("pet_flags")))
    scored = scorer.score_batches(rows, checksum_scorer)
    return _long(scored, "logits", "logit", "guid")


@query
def score_tokens(spark, sf):
    scored = scorer.score(inputs.document_tokens(spark, sf), _toxic_model(spark, sf))
    rows = scored.select("guid", F.posexplode("logits").alias("class", "logit"))
    return rows.select("guid", "class", F.round("logit", 4).alias("logit"))


# --- whole jobs ----------------------------------------------------------------------------


def _stored_examples(spark, sf):
    """The labelled rows, so that a whole job reads the corpus once."""
    return materialize(inputs.examples(spark, sf), "examples")


@query
def stage1_sentiment(spark, sf):
    rows = _stored_examples(spark, sf)
    return stages.judge_sentiment(rows, stages.learn_sentiment(rows))


@query
def stage1_metrics(spark, sf):
    rows = _stored_examples(spark, sf)
    scored = stages.judge_sentiment(rows, stages.learn_sentiment(rows)).withColumnRenamed("senti_gold", "label")
    return _rounded(metrics.macro_metrics(scored, ["split"]), ["accuracy", "f1_score"])


@query
def stage2_annotate(spark, sf):
    model = stages.learn_sentiment(inputs.examples(spark, sf))
    turns = inputs.table(spark, sf, "conversations")
    documents = stages.annotate(inputs.documents(spark, sf), model, ["guid"], "text")
    talks = stages.annotate(turns, model, ["conv_id", "turn"], "text")
    return documents.select(
        F.lit("documents").alias("corpus"), "guid", F.lit(0).cast("bigint").alias("turn"), "text", "senti_pre"
    ).unionByName(
        talks.select(F.lit("conversations").alias("corpus"), F.col("conv_id").alias("guid"), "turn", "text", "senti_pre")
    )


@query
def stage2_rejects(spark, sf):
    """All documents, some without text: annotated or turned away."""
    model = stages.learn_sentiment(inputs.examples(spark, sf))
    text = F.when(F.col("guid") % 13 != 0, F.col("text"))
    corpus_rows = inputs.documents(spark, sf).select("guid", text.alias("text"))
    kept = stages.annotate(corpus_rows, model, ["guid"], "text").select("guid", "senti_pre", F.lit(None).cast("string").alias("reason"))
    away = stages.annotate_rejects(corpus_rows, "text").select("guid", F.lit(None).cast("int").alias("senti_pre"), "reason")
    return kept.unionByName(away)


def _with_predicted_sentiment(spark, sf):
    rows = _stored_examples(spark, sf)
    return materialize(stages.annotate(rows, stages.learn_sentiment(rows)), "annotated")


def _dirty_annotated(spark, sf):
    """Annotated examples in which some texts, labels and sentiments cannot be used."""
    guid = F.col("guid")
    rows = _with_predicted_sentiment(spark, sf)
    return rows.select(
        "guid", "split", F.when(guid % 13 != 0, F.col("text_a")).alias("text_a"),
        F.when(guid % 11 == 0, 7).when(guid % 11 != 1, F.col("label")).alias("label"),
        F.when(guid % 7 == 0, 3).otherwise(F.col("senti_pre")).alias("senti_pre"),
    )


@query
def stage3_rejects(spark, sf):
    """All examples of a dirty corpus: predicted, learned from, or turned away."""
    rows = _dirty_annotated(spark, sf)
    _, predicted = stages.classify(rows, SHOTS, SEED)
    none = F.lit(None).cast("string").alias("reason")
    learned = rows.filter(F.col("split") == "train").join(stages.classify_rejects(rows).select("guid"), "guid", "left_anti")
    away = stages.classify_rejects(rows).select("guid", "split", "reason")
    return predicted.select("guid", "split", none).unionByName(learned.select("guid", "split", none)).unionByName(away)


@query
def stage3_classify(spark, sf):
    _, predicted = stages.classify(_with_predicted_sentiment(spark, sf), SHOTS, SEED)
    return predicted.select(
        "guid", "split", "label", "senti_pre", "pred", F.round(F.get("probs", F.lit(1)), 4).alias("prob_yes")
    )


@query
def stage3_metrics(spark, sf):
    _, predicted = stages.classify(_with_predicted_sentiment(spark, sf), SHOTS, SEED)
    return _rounded(metrics.binary_metrics(predicted, ["split"]), ["precision", "accuracy", "f1_score"])


def _three_classes(spark, sf):
    rows = _stored_examples(spark, sf)
    annotated = stages.annotate(rows, stages.learn_sentiment(rows))
    return materialize(annotated.withColumn("label", F.col("senti_gold")), "annotated")


@query
def stage3_multiclass(spark, sf):
    _, predicted = stages.classify(_three_classes(spark, sf), SHOTS, SEED, 3)
    judged = stages.judge(predicted.drop("probs"), ["split"], 3, "multiclass")
    return _rounded(judged, ["accuracy", "f1_score", "AUROC_score", "loss"])


@query
def evaluate_saved(spark, sf):
    path = new_path(spark, "scorer")
    rows = _with_predicted_sentiment(spark, sf)
    scorer.save_scorer(stages.learn_few_shot(rows, SHOTS, SEED), path)
    _, log = stages.evaluate_saved(spark, path, rows, "test")
    return log.select("split", "metric", r6("value").alias("value"))


@query
def sweep_metrics(spark, sf):
    rows = stages.sweep(_with_predicted_sentiment(spark, sf))
    return _rounded(rows, ["precision", "accuracy", "f1_score", "loss"])


@query
def sweep_multiclass(spark, sf):
    rows = stages.sweep(_three_classes(spark, sf), classes=3, task_type="multiclass")
    return _rounded(rows, ["accuracy", "f1_score", "AUROC_score", "loss"])
