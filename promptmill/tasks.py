"""The task table: which column holds the text, how the prompt reads, what the labels mean."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.sources.storage import fixed_table

# Prompt slots, prompt words, label words, sentiment words, flags.
TEXT_A = "[text_a]"
TEXT_B = "[text_b]"
SENTIMENT = "[sentiment_prompt]"
MASK = "[mask]"

GROUP_QUESTION = "offensive towards a group ?"
ABUSE_QUESTION = "Verbal abuse directed at a group ?"
HATE_QUESTION = "Hate speech?"
IT_WAS = "It was"

NO_YES = ("No", "Yes")
HATE_LEVELS = ("normal", "offensive", "hatespeech")
SENTIMENTS = ("negative", "neutral", "positive")

FLAG_TEXT, FLAG_SPECIAL, FLAG_PROMPT, FLAG_MASK, FLAG_SENTIMENT = 0, 1, 2, -1, 3

# Sample sizes and seeds of a sweep.
SIZES = (16, 32, 64, 128, 256, 512, 1024)
SEEDS = (9, 99, 999, 9999, 11, 264, 8758, 5437, 4676, 2364)


class Task(NamedTuple):
    task: str
    text_column: str
    reads_sentiment: bool
    pattern: tuple[str, ...]
    verbalizers: tuple[str, ...]

    @property
    def labels(self) -> tuple[int, ...]:
        return tuple(range(len(self.verbalizers)))


def _plain(task: str, column: str, question: str, words: tuple[str, ...]) -> Task:
    return Task(task, column, False, (TEXT_A, question, MASK, "."), words)


def _with_sentiment(task: str, column: str, question: str, words: tuple[str, ...]) -> Task:
    return Task(task, column, True, (TEXT_A, SENTIMENT, question, MASK, "."), words)


# The 17 tasks.
TASKS = (
    _plain("sbic", "post", GROUP_QUESTION, NO_YES),
    _with_sentiment("sbic_v2", "post", GROUP_QUESTION, NO_YES),
    _with_sentiment("sbic_v2_prompt_v2", "post", ABUSE_QUESTION, NO_YES),
    _with_sentiment("sbic_v2_prompt_v3", "post", HATE_QUESTION, NO_YES),
    _with_sentiment("hatexplain_two", "text_joined", GROUP_QUESTION, NO_YES),
    _plain("hatexplain_thr", "text_joined", GROUP_QUESTION, HATE_LEVELS),
    _with_sentiment("hatexplain_thr_v2", "text_joined", GROUP_QUESTION, HATE_LEVELS),
    _with_sentiment("hs18", "text", GROUP_QUESTION, NO_YES),
    _with_sentiment("ethos", "comment", GROUP_QUESTION, NO_YES),
    _with_sentiment("toxigen", "text", GROUP_QUESTION, NO_YES),
    _plain("t4sa", "text", IT_WAS, SENTIMENTS),
    _plain("t4sa_sbic", "post", IT_WAS, SENTIMENTS),
    _plain("t4sa_hatexplaintwo", "text_joined", IT_WAS, SENTIMENTS),
    _plain("t4sa_hatexplainthr", "text_joined", IT_WAS, SENTIMENTS),
    _plain("t4sa_hs18", "text", IT_WAS, SENTIMENTS),
    _plain("t4sa_ethos", "comment", IT_WAS, SENTIMENTS),
    _plain("t4sa_toxigen", "text", IT_WAS, SENTIMENTS),
)


def get_task(name: str) -> Task:
    """Look a task up, ignoring case; an unknown name raises NotImplementedError."""
    for task in TASKS:
        if task.task == name.lower():
            return task
    raise NotImplementedError(f"unknown task: {name}")


def task_specs(spark: SparkSession, tasks: Sequence[Task] = TASKS) -> DataFrame:
    """The task table as a small dimension, 17 rows unless the caller brings tasks of their own."""
    rows = [
        (t.task, t.text_column, t.reads_sentiment, list(t.pattern), list(t.labels), list(t.verbalizers))
        for t in tasks
    ]
    schema = (
        "task string, text_column string, reads_sentiment boolean, "
        "pattern array<string>, labels array<int>, verbalizers array<string>"
    )
    return fixed_table(spark, rows, schema)


def resolve_tasks(df: DataFrame, tasks: Sequence[Task] = TASKS) -> DataFrame:
    """Attach the task columns to rows that carry a `task` name; an unknown name fails the job."""
    specs = task_specs(df.sparkSession, tasks)
    known = df.withColumn("task", F.lower("task")).join(F.broadcast(specs), "task", "left")
    checked = F.when(F.col("pattern").isNotNull(), F.col("pattern")).otherwise(
        F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce("task", F.lit("null")))).cast("array<string>")
    )
    return known.withColumn("pattern", checked)


def literal_parts(pattern):
    """The pattern parts that are plain words, not slots."""
    return F.filter(pattern, lambda p: ~p.startswith("["))


def has_sentiment(pattern):
    """True when the pattern carries the sentiment slot, so the sentiment encoder applies."""
    return F.array_contains(pattern, SENTIMENT)
