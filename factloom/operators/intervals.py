"""Interval selection and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_overlapping(spans: DataFrame, cap: int = 20) -> DataFrame:
    """Greedy choice per file of spans(file, start, end): in order of start, then end, each span that begins after the last chosen one ends,
    up to `cap` a file. One sorted pass over each partition; only the end and the number of the last choice are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until, n = None, 0, 0
        for b in batches:
            keep = []
            for i, (f, s, e) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "start", "end")))):
                if f != key:
                    key, until, n = f, None, 0
                if n < cap and (until is None or s > until):
                    until, n = e, n + 1
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    s = spans.select("file", "start", "end").where("start IS NOT NULL AND end IS NOT NULL")
    ordered = s.repartition("file").sortWithinPartitions("file", "start", "end")
    return ordered.mapInArrow(run, ordered.schema)


def range_band(value: Column, least: float) -> Column:
    """Logarithmic band: floor(ln v / ln(1 / least)) + 1, and 0 for values up to 0. Values of similarity `least` are at most a band apart."""
    return F.when(value <= 0, 0).otherwise(F.floor(F.log(value) / F.log(F.lit(1.0 / least))) + 1)


def keep_recent(rows: DataFrame, ts: str, now: str, hours: float = 1.0) -> DataFrame:
    """Rows with their retention: expired once older than `hours` before the injected now; a null time never expires."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    return rows.withColumn("expired", F.coalesce(age > hours * 3600, F.lit(False)))


def two_key_lookup(rows: DataFrame, index: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Value of index(path, value) by the first key, else by the second."""
    a = index.select(F.col("path").alias(first), F.col(value).alias("__a"))
    b = index.select(F.col("path").alias(second), F.col(value).alias("__b"))
    return rows.join(a, first, "left").join(b, second, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")
