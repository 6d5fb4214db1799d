"""Sinks: artifacts as JSON or Parquet, result logs, diagrams, manifests. Only bounded, ranked rows are rendered on the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_artifact(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_artifact(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The artifact, or None where there is none: absent is not empty."""
    try:
        return spark.read.format(fmt).load(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def mermaid_lines(pairs: DataFrame, k: int = 30) -> DataFrame:
    """Edges of a diagram, the k strongest of pairs(from_module, to_module, n), as text lines in order."""
    label = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9_]", "_")
    top = pairs.orderBy(F.col("n").desc(), "from_module", "to_module").limit(k)
    return top.select("n", F.concat(F.lit("  "), label("from_module"), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), label("to_module")).alias("line"))


def mermaid(pairs: DataFrame, k: int = 30) -> str:
    rows = mermaid_lines(pairs, k).collect()  # k rows at most
    return "\n".join(["graph LR", *(r.line for r in sorted(rows, key=lambda r: (-r.n, r.line)))])


def result_log(results: DataFrame, limit: int = 10_000) -> str:
    """A static-analysis result log of rows (rule_id, level, location, reason); beyond the limit write the rows as an artifact."""
    rows = results.orderBy("rule_id", "location", "reason").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many results to render: write them with write_artifact")
    items = [{"ruleId": r.rule_id, "level": r.level, "message": {"text": r.reason}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.location}}}]} for r in rows]
    rules = [{"id": x} for x in sorted({r.rule_id for r in rows})]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "factloom", "rules": rules}}, "results": items}]})


def manifest(artifacts: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """What was produced and what is missing: artifact, available, rows."""
    parts = [spark.createDataFrame([], "artifact string, available boolean, n bigint")]
    for name, df in sorted(artifacts.items()):
        if df is None:
            parts.append(spark.createDataFrame([(name, False, None)], "artifact string, available boolean, n bigint"))
        else:
            parts.append(df.agg(F.lit(name).alias("artifact"), F.lit(True).alias("available"), F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cell(text: object) -> str:
    """A value as a Markdown table cell."""
    return "" if text is None else str(text).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, k: int = 50) -> str:
    """The first k rows of a ranked frame as a Markdown table; k bounds what reaches the driver."""
    rows = df.limit(k).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(cell(v) for v in r)} |" for r in rows)])


def summary_report(title: str, sections: dict[str, DataFrame | None], k: int = 20) -> str:
    """A Markdown report; a section without data says so instead of being left out."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "unavailable" if df is None else markdown_table(df, k)]
    return "\n".join(out)


def exit_code(statuses: dict[str, str], strict: bool = False) -> int:
    """0 unless a step failed; in strict mode also for drift and for what is unavailable."""
    bad = {"failed"} | ({"drift", "unavailable"} if strict else set())
    return int(any(s in bad for s in statuses.values()))


def cached_artifact(spark: SparkSession, folder: str, request: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The artifact of a request, and whether it was there already: stored under the SHA-256 of the request's sorted JSON in a folder that
    all executors share. What decides the result (fingerprints of inputs, versions, options) belongs into the request. A write that does
    not end leaves no marker, so it is no hit."""
    key = hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return spark.read.parquet(path), True
    df = build()
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), False


def review_pack(title: str, claims: DataFrame, limits: list[str], k: int = 20) -> str:
    """A Markdown pack for a reviewer: the first k claims(claim, location, evidence, confidence) by confidence and location, each as a task to
    confirm, and what the evidence does not cover."""
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    rows = claims.select("claim", "location", "evidence", "confidence").orderBy(order, "location", "claim").limit(k).collect()
    out = [f"# {title}", "", "## Claims to confirm", ""]
    out += [f"- [ ] {cell(r.claim)} (`{cell(r.location)}`, {cell(r.confidence)}): {cell(r.evidence)}" for r in rows] or ["none"]
    return "\n".join([*out, "", "## Limits", "", *([f"- {cell(x)}" for x in limits] or ["none known"])])
