"""The three stages, evaluation and the sweep, as whole jobs.

Rows that a stage cannot use are turned away with a reason: kept rows and rejects are all rows.
`strict` makes a job fail on the first such row instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.functions.arrays import cross_entropy, softmax
from promptmill.functions.text import sentiment_token, tokens
from promptmill.operators.examples import kept_rows, row_reason, turned_away
from promptmill.operators.metrics import BINARY_COUNTS, auroc_ovo, binary_counts, binary_ratios, evaluate, macro_metrics
from promptmill.operators.nested import each_run, train_nested, units_of_runs
from promptmill.operators.ordering import range_slices, row_index
from promptmill.operators.sampling import few_shot
from promptmill.operators.scorer import (
    TokenScorer,
    append_predictions,
    class_in_place,
    decide,
    load_scorer,
    one_model,
    score,
    train,
)
from promptmill.sources.storage import BROADCAST_BYTES, broadcast_if_small, materialize
from promptmill.tasks import SEEDS, SENTIMENTS, SIZES

# Rows of an evaluation batch: the reported loss is the sum of batch means.
EVAL_BATCH = 16

# Bytes of a key and a prediction that are sent to the texts.
PREDICTION_BYTES = 48

# A sentiment model: a scorer learned here, or any function from a text column to a class column.
SentimentModel = TokenScorer | Callable[[Column], Column]


def tokenized(rows: DataFrame, text: str = "text_a") -> DataFrame:
    """The tokens in place of the text."""
    return rows.withColumn("tokens", tokens(F.col(text))).drop(text)


def learn_sentiment(examples: DataFrame, strict: bool = False) -> TokenScorer:
    """Stage 1: a three-class scorer from the training rows of `text_a` and `senti_gold`."""
    usable = kept_rows(examples.filter(F.col("split") == "train"), _sentiment_reason(), strict)
    return train(one_model(tokenized(usable), "senti_gold", len(SENTIMENTS)), len(SENTIMENTS))


def _sentiment_reason() -> Column:
    return row_reason("senti_gold", len(SENTIMENTS))


def sentiment_rejects(examples: DataFrame) -> DataFrame:
    """Rows that stage 1 neither learns from nor judges, with the reason."""
    return turned_away(examples, _sentiment_reason())


def judge_sentiment(examples: DataFrame, scorer: TokenScorer, strict: bool = False) -> DataFrame:
    """guid, split, senti_gold, pred of the dev and test rows."""
    held_out = kept_rows(examples.filter(F.col("split") != "train"), _sentiment_reason(), strict)
    return score(tokenized(held_out), scorer, ["guid", "split", "senti_gold"]).drop("logits")


def annotate(
    corpus: DataFrame,
    model: SentimentModel,
    key: Sequence[str] = ("guid",),
    text: str = "text_a",
    limit: int = BROADCAST_BYTES,
    strict: bool = False,
) -> DataFrame:
    """Stage 2: the corpus with its predicted sentiment in `senti_pre`.

    With a scorer that fits a broadcast, or an external model, every row is scored where it is read. With a
    larger scorer the narrow predictions are stored and joined by key, which must be unique then.
    """
    rows = kept_rows(corpus, row_reason(text=text), strict)
    if callable(model):
        return rows.withColumn("senti_pre", model(F.col(text)))
    if model.nbytes <= limit:
        return rows.withColumn("senti_pre", class_in_place(model)(tokens(F.col(text))))
    scored = score(tokenized(rows.select(*key, text), text), model, key, limit)
    stored = materialize(scored.select(*key, "pred"), "sentiments")
    # narrow rows go to the texts, unless there are too many to send
    return append_predictions(rows, broadcast_if_small(stored, stored.count() * PREDICTION_BYTES), key)


def annotate_rejects(corpus: DataFrame, text: str = "text_a") -> DataFrame:
    """Rows of a corpus that stage 2 turns away, with the reason."""
    return turned_away(corpus, row_reason(text=text))


def prompt_features(rows: DataFrame) -> DataFrame:
    """Text tokens plus the one token that stands for the sentiment in the prompt."""
    with_tokens = tokenized(rows)
    return with_tokens.withColumn("tokens", F.concat("tokens", F.array(sentiment_token(F.col("senti_pre")))))


def _stage3_reason(classes: int) -> Column:
    return row_reason("label", classes, "senti_pre")


def classify_rejects(examples: DataFrame, classes: int = 2) -> DataFrame:
    """Rows that stage 3 turns away, with the reason."""
    return turned_away(examples, _stage3_reason(classes))


def learn_few_shot(examples: DataFrame, n: int, seed: int, classes: int = 2, strict: bool = False) -> TokenScorer:
    """A scorer from n sampled training rows."""
    usable = kept_rows(examples.filter(F.col("split") == "train"), _stage3_reason(classes), strict)
    sample = few_shot(usable.select("guid", "label"), [seed], n).select("guid")
    # At most n keys, so the texts of the sample are picked without a shuffle.
    rows = prompt_features(usable.join(F.broadcast(sample), "guid", "left_semi"))
    return train(one_model(rows, "label", classes), classes)


def classify(
    examples: DataFrame,
    n: int,
    seed: int,
    classes: int = 2,
    strict: bool = False,
    model: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[TokenScorer | None, DataFrame]:
    """Stage 3: learn from n sampled training rows, predict the dev and test rows.

    `examples` holds guid, text_a, label, senti_pre, split. Labels of the evaluated rows are
    carried beside their predictions and used nowhere else. `model`, if given, takes the place of the scorer:
    it gets the usable held-out rows and returns them with `pred` and `logits`.
    """
    held_out = kept_rows(examples.filter(F.col("split") != "train"), _stage3_reason(classes), strict)
    keep = ["guid", "split", "label", "senti_pre"]
    if model is not None:
        scorer, predicted = None, model(held_out).select(*keep, "pred", "logits")
    else:
        scorer = learn_few_shot(examples, n, seed, classes, strict)
        predicted = score(prompt_features(held_out), scorer, keep)
    return scorer, predicted.withColumn("probs", softmax(F.col("logits")))


def evaluate_saved(
    spark: SparkSession, path: str, examples: DataFrame, split: str, task_type: str = "binary", batch_size: int = EVAL_BATCH
) -> tuple[DataFrame, DataFrame]:
    """A saved scorer on one split: its predictions (guid, label, pred, logits), and its metrics and loss as rows."""
    scorer = load_scorer(spark, path)
    rows = kept_rows(examples.filter(F.col("split") == split), _stage3_reason(scorer.classes))
    predicted = materialize(score(prompt_features(rows), scorer, ["guid", "label"]), "evaluated")
    return predicted, evaluate(predicted, task_type, tuple(range(scorer.classes)), batch_size, split)


def sweep(
    examples: DataFrame,
    sizes: Sequence[int] = SIZES,
    seeds: Sequence[int] = SEEDS,
    classes: int = 2,
    limit: int = BROADCAST_BYTES,
    task_type: str = "binary",
    batch_size: int = EVAL_BATCH,
) -> DataFrame:
    """n, seed, split, the metrics of the task type and the loss: all runs learn, predict and are judged together.

    The runs share one scorer of nested samples. Every sampled text is tokenized once, whatever the number of
    samples it is in, and the held-out texts are read and scored once for all runs, whatever `limit` lets be sent at once.
    """
    usable = kept_rows(examples, _stage3_reason(classes))
    train_rows = usable.filter(F.col("split") == "train")
    drawn = few_shot(train_rows.select("guid"), seeds, max(sizes)).groupBy("guid").agg(
        F.collect_list(F.struct("seed", "rank")).alias("draws")
    )
    # At most len(seeds) * max(sizes) keys, with at most one draw per seed each.
    texts = train_rows.join(F.broadcast(materialize(drawn, "few_shot")), "guid")
    stored = materialize(prompt_features(texts).select("label", "tokens", "draws"), "few_shot_texts")
    draws = stored.select(F.col("label").alias("class"), "tokens", F.inline("draws"))
    scorer = train_nested(draws, sizes, seeds, classes, limit)
    held_out = prompt_features(usable.filter(F.col("split") != "train"))
    keep = ["guid", "split", "label"]
    scored = materialize(held_out.select(*keep, units_of_runs(scorer)(F.col("tokens")).alias("all_units")), "scored")
    runs = each_run(with_batches(scored, batch_size), scorer, [*keep, "batch_id"])
    judged = runs.select("cell", *keep, "batch_id", *decide(F.col("units")))
    found = judge(judged, ["cell", "split"], classes, task_type, batch_size)
    return found.join(F.broadcast(scorer.runs()), "cell").drop("cell")


def judge(
    predicted: DataFrame, by: Sequence[str], classes: int = 2, task_type: str = "binary", batch_size: int = EVAL_BATCH
) -> DataFrame:
    """One row for each group of `by`, which includes split: the metrics of the task type, and the loss.

    `predicted` holds guid, split, label, pred, logits and the `by` columns. The loss is the sum over batches of guids in order of
    their mean cross-entropy; rows without a `batch_id` are stored and numbered first. Anything but `multiclass` is binary: counts and
    cross-entropies are added up per batch in one pass. Ranks of several classes need the rows, which are stored once.
    """
    by = list(by)
    if "batch_id" not in predicted.columns:
        predicted = with_batches(materialize(predicted, "predicted"), batch_size)
    rows = predicted.withColumn("ce", cross_entropy(F.col("logits"), F.col("label")))
    if task_type != "multiclass":
        batches = rows.groupBy(*by, "batch_id").agg(F.avg("ce").alias("mean"), *binary_counts())
        sums = batches.groupBy(*by).agg(F.sum("mean").alias("loss"), *[F.sum(c).alias(c) for c in BINARY_COUNTS])
        return binary_ratios(sums, [*by, "loss"])
    rows = materialize(rows, "judged")
    means = rows.groupBy(*by, "batch_id").agg(F.avg("ce").alias("mean"))
    losses = means.groupBy(*by).agg(F.sum("mean").alias("loss"))
    ranked = auroc_ovo(rows.select(*by, "label", softmax(F.col("logits")).alias("probs")), tuple(range(classes)), by=by)
    return macro_metrics(rows, by).join(ranked, by).join(losses, by)


def with_batches(stored: DataFrame, batch_size: int) -> DataFrame:
    """Stored rows with their `batch_id`: consecutive runs of guids within each split; rows that share a guid share it."""
    batches = split_batches(stored.select("guid", "split").distinct(), batch_size)
    return stored.join(batches, ["guid", "split"])


def split_batches(rows: DataFrame, batch_size: int) -> DataFrame:
    """guid, split, batch_id: consecutive runs of guids within each split."""
    placed = row_index(range_slices(rows, ["guid"]), ["guid"], "slice", ["split"])
    return placed.select("guid", "split", F.floor((F.col("idx") - 1) / batch_size).cast("bigint").alias("batch_id"))
