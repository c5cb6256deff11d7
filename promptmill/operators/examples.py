"""The canonical example row and the rules that turn a row away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.tasks import SENTIMENTS, TEXT_B, has_sentiment

# Column, type and default of an example row.
EXAMPLE_COLUMNS = {
    "guid": ("bigint", None),
    "text_a": ("string", None),
    "text_b": ("string", None),
    "label": ("int", None),
    "logits": ("array<double>", None),
    "meta": ("map<string,string>", F.create_map),
    "idx": ("int", lambda: F.lit(-1)),
    "senti_pre": ("int", None),
}


def canonical(df: DataFrame) -> DataFrame:
    """All example columns, in order and typed; absent or null ones get their default."""
    out = []
    for name, (kind, default) in EXAMPLE_COLUMNS.items():
        # A cell such as `1.0`, which gaps in a column make of 1, is a number; one that is none becomes null.
        value = _as_kind(name, kind, df) if name in df.columns else F.lit(None).cast(kind)
        if default is not None:
            value = F.coalesce(value, default().cast(kind))
        out.append(value.alias(name))
    return df.select(*out)


def _as_kind(name: str, kind: str, df: DataFrame) -> Column:
    if kind in ("int", "bigint") and dict(df.dtypes)[name] == "string":
        number = F.col(name).try_cast("double")
        return F.coalesce(F.col(name).try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind))
    return F.col(name).cast(kind)


def label_index(label: Column, labels: Column) -> Column:
    """Class index of a label in the task's list; -1 when the task does not know it."""
    return F.coalesce(F.array_position(labels, label) - 1, F.lit(-1)).cast("int")


def reject_reason(text_a="text_a", text_b="text_b", label="label", senti_pre="senti_pre") -> Column:
    """Why a row that carries its task columns cannot be used; null when it can."""
    senti = F.col(senti_pre)
    in_range = F.coalesce(senti.between(0, len(SENTIMENTS) - 1), F.lit(False))
    return (
        F.when(F.col(text_a).isNull(), "null text")
        .when(F.array_contains("pattern", TEXT_B) & F.col(text_b).isNull(), "null second text")
        .when(label_index(F.col(label), F.col("labels")) < 0, "unknown label")
        .when(has_sentiment(F.col("pattern")) & ~in_range, "sentiment out of range")
    )


def accepted(df: DataFrame, strict: bool = False) -> DataFrame:
    """Usable rows with their class index. Strict mode fails on the first unusable row."""
    reason = reject_reason()
    indexed = label_index(F.col("label"), F.col("labels"))
    if strict:
        message = F.concat(F.col("guid").cast("string"), F.lit(": "), reason)
        indexed = F.when(reason.isNull(), indexed).otherwise(F.raise_error(message).cast("int"))
        return df.withColumn("label_id", indexed)
    return df.filter(reason.isNull()).withColumn("label_id", indexed)


def rejected(df: DataFrame) -> DataFrame:
    """Rows turned away, each with its reason. A predicate, not an anti join."""
    return df.withColumn("reason", reject_reason()).filter(F.col("reason").isNotNull())


def row_reason(
    label: str | None = None, classes: int = 0, sentiment: str | None = None, text: str = "text_a", key: Sequence[str] = ()
) -> Column:
    """Why a row cannot be used in a stage; null when it can. Columns that are not named are not asked for."""
    reason = F.when(F.col(text).isNull(), "null text")
    for column in key:
        reason = reason.when(F.col(column).isNull(), "null key")
    if label is not None:
        reason = reason.when(~F.coalesce(F.col(label).between(0, classes - 1), F.lit(False)), "unknown label")
    if sentiment is not None:
        reason = reason.when(~F.coalesce(F.col(sentiment).between(0, len(SENTIMENTS) - 1), F.lit(False)), "sentiment out of range")
    return reason


def kept_rows(df: DataFrame, reason: Column, strict: bool = False) -> DataFrame:
    """Rows without a reason against them. Strict mode fails on the first one with a reason."""
    if strict:
        flagged = F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
        return df.filter(flagged)
    return df.filter(reason.isNull())


def turned_away(df: DataFrame, reason: Column) -> DataFrame:
    """The other rows, each with its `reason`: kept rows and these are all rows."""
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def require_unique(df: DataFrame, key: Sequence[str]) -> None:
    """Raise when two rows share a key. Reads the key columns only; equal keys meet pre-counted."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).limit(1).collect()
    if repeated:
        shown = ", ".join(f"{k}={repeated[0][k]}" for k in key)
        raise ValueError(f"{repeated[0]['rows']} rows share the key {shown}")
