"""CSV corpora whose cells hold line breaks, read by as many tasks as their bytes ask for.

Files are read line by line, so Spark splits them wherever it likes. A line break ends a record when the
number of quotes before it in the file is even. Inside a block only the quotes of that block are known;
each line is therefore stored with both answers, and the parity at the start of a block, a running sum
over one row per block, says later which of them holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptmill.sources.storage import broadcast_if_small, materialize

# Columns that `_numbered` adds to a line: its number in the block, whether an odd number of quotes stands before
# it in the block, and the last line up to it before which that number was even, or odd (-1: none yet).
_NUMBERED = "file string, block long, quotes int, blank boolean, value string, line long, odd boolean, since_even long, since_odd long"

# Bytes of a block's row beside the path of its file.
_BLOCK_BYTES = 64


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the lines of each block, in order, with what the quotes before them in the block tell."""
    at, line, parity, since = None, 0, 0, [-1, -1]
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file"), batch.column("block")
        n = batch.num_rows
        new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        cuts = [0, *(np.flatnonzero(np.asarray(new)) + 1).tolist(), n]
        quotes = np.asarray(batch.column("quotes")).astype(np.int64)
        lines, odd = np.empty(n, np.int64), np.empty(n, bool)
        last = np.empty((2, n), np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if at != (files[lo].as_py(), blocks[lo].as_py()):
                at, line, parity, since = (files[lo].as_py(), blocks[lo].as_py()), 0, 0, [-1, -1]
            sums = np.cumsum(quotes[lo:hi])
            lines[lo:hi] = np.arange(line, line + hi - lo)
            odd[lo:hi] = (parity + sums - quotes[lo:hi]) % 2 == 1
            for which in (0, 1):
                found = np.where(odd[lo:hi] == bool(which), lines[lo:hi], -1)
                last[which, lo:hi] = np.maximum(np.maximum.accumulate(found), since[which])
                since[which] = int(last[which, hi - 1])
            line, parity = line + hi - lo, int(parity + sums[-1]) % 2
        added = [pa.array(lines), pa.array(odd), pa.array(last[0]), pa.array(last[1])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "line", "odd", "since_even", "since_odd"])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.length("value") - F.length(F.translate("value", '"', ""))).alias("quotes"),
        F.col("value").isin("", "\r").alias("blank"),
        "value",
    ).mapInArrow(_numbered, _NUMBERED)


def _blocks(lines: DataFrame) -> DataFrame:
    """file, block, open, carried, header: one row per block.

    `open`: a quoted cell is open where the block starts. `carried`: where the record of such a cell began, in an
    earlier block. `header`: where the first record of the file begins.
    """
    sums = lines.groupBy("file", "block").agg(
        F.sum(F.col("quotes").cast("long")).alias("quotes"),
        F.max("since_even").alias("last_even"),
        F.max("since_odd").alias("last_odd"),
        F.min(F.when(~F.col("blank"), F.col("line"))).alias("first_text"),
    )
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = sums.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("open"), F.col("last_odd")).otherwise(F.col("last_even"))
    start = F.when(begun >= 0, F.struct("block", begun.alias("line")))
    unclosed = F.raise_error(F.concat(F.lit("a quote is never closed in "), "file")).cast("boolean")
    return opened.select(
        "file",
        "block",
        F.when(F.sum("quotes").over(whole) % 2 == 1, unclosed).otherwise(F.col("open")).alias("open"),
        F.last(start, ignorenulls=True).over(earlier).alias("carried"),
        F.min(F.when(F.col("first_text").isNotNull(), F.struct("block", F.col("first_text").alias("line")))).over(whole).alias("header"),
    )


def _checked(record: Column) -> Column:
    """The record without its carriage return; fails where a quote stands inside a cell that is not quoted."""
    text = F.when(record.endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(record)
    outside = F.regexp_replace(text, '"[^"]*"', '"')
    stray = text.contains('"') & outside.rlike('[^",]"|"[^",]')
    return F.when(stray, F.raise_error(F.lit("a quote inside a cell without quotes: read this file with read_csv"))).otherwise(text)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record: every record of the files but their first ones, the headers.

    Records end with a line feed, or a carriage return and a line feed. Empty lines are no records. Lines of one
    record meet by the place where it began; records of one line, all others, stay where they were read. A quote
    that is never closed, or one inside a cell without quotes, fails the job.
    """
    lines = materialize(_lines(spark, path), "csv-lines")
    blocks = materialize(_blocks(lines), "csv-blocks")
    nbytes = blocks.agg(F.sum(F.length("file") + _BLOCK_BYTES)).first()[0] or 0
    placed = lines.join(broadcast_if_small(blocks, nbytes), ["file", "block"])
    begins = F.col("odd") == F.col("open")
    alone = begins & (F.col("quotes") % 2 == 0)
    here = F.struct("block", "line")
    since = F.when(F.col("open"), F.col("since_odd")).otherwise(F.col("since_even"))
    start = F.when(since >= 0, F.struct("block", since.alias("line"))).otherwise(F.col("carried"))

    single = placed.filter(alone & ~F.col("blank")).select("file", here.alias("start"), "header", F.col("value").alias("record"))
    parts = placed.filter(~alone).select("file", start.alias("start"), "header", F.struct("block", "line", "value").alias("part"))
    several = parts.groupBy("file", "start").agg(
        F.any_value("header").alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"]), "\n").alias("record"),
    )
    records = single.unionByName(several).filter(F.col("start") != F.col("header"))
    return records.select("file", _checked(F.col("record")).alias("record"))
