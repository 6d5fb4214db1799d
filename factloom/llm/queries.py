"""Queries over the test tables for the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import table
from . import mixing, mojibake, packing, parse_errors, topn


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors.invalid_files(table(spark, d, "source_files"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors.invalid_rates(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    top = topn.top_n_per_group(table(spark, d, "pattern_offenders"), ["snapshot_id", "pattern"], "offender_count", "file", "offender_id", 10)
    return top.select("offender_id")


def p5_top_offenders(spark: SparkSession, d: str) -> DataFrame:
    top = topn.top_n_per_group(table(spark, d, "pattern_offenders"), ["snapshot_id", "pattern"], "offender_count", "file", "offender_id", 10)
    return top.select("snapshot_id", "pattern", "rank", "file", "offender_count", "offender_id")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_unused_space(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused_space(p6_packed(spark, d), table(spark, d, "pack_sizes"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.affected_ids(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p5_found, p5_top_offenders, p6_packed, p6_unused_space, p7_mixed, p7_shares, p8_found, p8_restored)}
_P5 = """
SELECT {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id, pattern ORDER BY offender_count DESC, file ASC NULLS LAST, offender_id ASC) AS rank
  FROM (SELECT DISTINCT snapshot_id, pattern, offender_id, file, offender_count FROM pattern_offenders WHERE offender_count IS NOT NULL)
) WHERE rank <= 10
"""
SQL: dict[str, str] = {
    "p5_found": _P5.format(cols="offender_id"),
    "p5_top_offenders": _P5.format(cols="snapshot_id, pattern, CAST(rank AS INTEGER) AS rank, file, offender_count, offender_id"),
}
