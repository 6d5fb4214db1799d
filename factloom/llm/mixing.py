"""Problem 7: mix sources to target shares of all tokens, by systematic sampling.

Every document of a source is expected to occur r times, r = target share x total / tokens of the source, at most the source's cap. The
expected copies are summed along the source, one random offset is added, and a document is used once for every integer that its stretch
of the sum crosses: floor(r) or ceil(r) times, so never above the cap, and the source as a whole hits its share to within a document.
Documents lie along the sum in order of length within chunks, so that lengths are sampled evenly.

The total: by default the largest one at which every source that has documents meets its share. A larger total may be asked for; sources
at their cap then give all they can, the others share the rest in proportion, and the report says who fell short.

Cases: sources are compared trimmed and in lower case; documents of null or unlisted sources and documents without tokens are not used;
a target source without tokens gets nothing and its share goes to the others in proportion; with no documents the mix is empty. Prefix
sums are taken in two steps (chunks of bounded size, then within chunks), so no source is a unit of work.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize
from .tokens import VOCABULARY, token_counts

CHUNK = 20_000
MAX_SOURCES = 10_000


def plan(targets: dict[str, tuple[float, int]], tokens: dict[str, int], total: float | None = None) -> dict[str, float]:
    """source -> expected copies of each of its documents. targets: source -> (share, cap)."""
    live = {s: (w, m) for s, (w, m) in targets.items() if tokens.get(s, 0) > 0 and w > 0 and m > 0}
    if not live:
        return {}
    weight = sum(w for w, _ in live.values())
    if total is None:
        total = min(m * tokens[s] * weight / w for s, (w, m) in live.items())
    rates: dict[str, float] = {}
    open_, left = dict(live), float(total)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [s for s, (w, m) in open_.items() if w / weight * left > m * tokens[s] * (1 + 1e-12)]
        if not full:
            return rates | {s: min(float(m), w / weight * left / tokens[s]) for s, (w, m) in open_.items()}
        for s in full:
            rates[s] = float(open_[s][1])
            left -= open_.pop(s)[1] * tokens[s]
    return rates


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(F.lower(F.trim("source")).alias("s"), "target_share", "max_repeats").where("s IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("mix_targets is larger than a list of sources may be")
    return {r.s: (float(r.target_share), int(r.max_repeats)) for r in rows}


def _offset(source: str, seed: int) -> float:
    return int.from_bytes(hashlib.sha256(f"{seed}:{source}".encode()).digest()[:6], "big") / 2**48


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, uses of every document used, report per target source)."""
    spark = docs.sparkSession
    want = _targets(targets)
    named = docs.withColumn("source", F.lower(F.trim("source"))).where(F.col("source").isin(sorted(want)))
    counted = materialize(token_counts(named, ["doc_id", "source"], vocabulary).where("n_tokens > 0"), "mix-counts")
    have = {r.source: (r.docs, r.tokens) for r in counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
    rates = plan(want, {s: t for s, (_, t) in have.items()}, total)
    chunks = max(1, -(-sum(n for n, _ in have.values()) // CHUNK))
    rate_rows = [(s, r, _offset(s, seed), want[s][1]) for s, r in sorted(rates.items())]
    rate = spark.createDataFrame(rate_rows, "source string, rate double, offset double, cap int")
    rows = counted.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    sizes = rows.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("source", "chunk", before.alias("before"))  # a row for every CHUNK documents
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("n_tokens", "doc_id")))
    # len(want) rows, bounded above
    placed = ranked.join(sizes, ["source", "chunk"]).join(F.broadcast(rate), "source")
    upto = lambda k: F.floor(F.col("rate") * (F.col("before") + F.col("rank") - k) + F.col("offset"))
    uses = F.least(F.col("cap").cast("bigint"), upto(0) - upto(1))
    used = placed.select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")
    got = used.groupBy("source").agg(F.count("*").alias("used_docs"), F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    listed = spark.createDataFrame([(s, w, m, *have.get(s, (0, 0)), rates.get(s, 0.0)) for s, (w, m) in sorted(want.items())], "source string, target_share double, max_repeats int, docs bigint, tokens bigint, expected_uses double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = listed.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "docs", "tokens", "expected_uses",
        *(zero(F.col(c)).alias(c) for c in ("used_docs", "used_tokens", "most_uses")),
        F.round(zero(F.col("used_tokens")) / F.sum(zero(F.col("used_tokens"))).over(Window.partitionBy(F.lit(1))), 6).alias("actual_share"),
        (F.col("expected_uses") >= F.col("max_repeats")).alias("at_cap"),
    )
    return used, report
