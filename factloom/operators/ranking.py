"""Tier cascades over findings: first rule that holds wins; a missing input is unknown, not clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rules: list[tuple[Column, str, str]], default: tuple[str, str]) -> Column:
    """struct(tier, reason) of the first rule whose condition is true; null conditions do not hold."""
    pair = lambda t, r: F.struct(F.lit(t).alias("tier"), F.lit(r).alias("reason"))
    out = None
    for cond, tier, reason in rules:
        out = F.when(cond, pair(tier, reason)) if out is None else out.when(cond, pair(tier, reason))
    return pair(*default) if out is None else out.otherwise(pair(*default))


def rank(findings: DataFrame, max_ratio: float = 0.15) -> DataFrame:
    """Tier, reason and confidence of findings(id, policy_muted, executed, blocking_taint, unresolved_ratio, tainted, processed,
    safe_action, declaration_dependency, bucket, deep_import_risk, support_entry, support_callers)."""
    c = F.col
    rules = [
        (c("policy_muted"), "MUTED", "policy"),
        (c("executed"), "DEGRADED", "runtime-executed"),
        (c("blocking_taint"), "DEGRADED", "blocking-taint"),
        ((c("unresolved_ratio") >= max_ratio) & ~c("tainted"), "DEGRADED", "resolver-blind"),
        (~c("processed"), "DEGRADED", "unprocessed"),
        (~c("safe_action"), "REVIEW", "no-safe-action"),
        (c("declaration_dependency"), "REVIEW", "declaration-dependency"),
        (c("bucket") == "B", "REVIEW", "bucket-b"),
        (c("deep_import_risk"), "REVIEW", "deep-import-risk"),
        (~c("tainted"), "SAFE_FIX", "clean"),
    ]
    f = findings.withColumn("v", cascade(rules, ("REVIEW", "weaker-evidence")))
    both, one = c("support_entry") & c("support_callers"), c("support_entry") | c("support_callers")
    conf = F.when(F.col("v.tier") != "SAFE_FIX", None).when(both, "high").when(one, "medium_with_evidence").otherwise("medium")
    return f.select("id", "v.tier", "v.reason", conf.alias("confidence"))


def sarif(*lanes: DataFrame) -> DataFrame:
    """Rule rows (rule_id, level, file, line, message) of all lanes, ready to be written as results; muted ones are not in them."""
    return reduce(DataFrame.unionByName, lanes)
