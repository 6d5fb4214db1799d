"""Structured Streaming: windows over an event stream, an event store with deduplicating counters, deliveries.

Streams run to the end of what is there (availableNow) and write to a folder that all executors share, with a checkpoint beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.session import shared_dir


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, with the table's own schema. The path may be a folder or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile():
        reader = reader.option("pathGlobFilter", jvm_path.getName())
        path = jvm_path.getParent().toString()
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end. In update mode every batch's rows are kept with the batch's number."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "update":
        query = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/part={n}")).start()
    else:
        query = writer.format("parquet").option("path", f"{base}/out").start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    schema = T.StructType([*stream.schema.fields, *[T.StructField("batch", T.IntegerType())][: mode == "update"]])
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out") if mode == "update" else spark.read.schema(schema).parquet(f"{base}/out")
    return out


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling windows per event type; a window is emitted once the watermark passes its end, later rows are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


#: fixed values: who may acknowledge an entry, the policy that keeps an archived entry from coming again, seconds to the next delivery
ACK_SOURCES = ("intentional", "fixed", "noted")
UNTIL_ACK = "until_ack"
REDELIVER_AFTER = 300

ENTRY = (
    "active boolean, acknowledged boolean, ack_source string, policy string, occurrence_count bigint, first_seen bigint, last_seen bigint, delivered_count bigint, "
    "next_redeliver_at bigint, archived_at bigint"
)
_FIELDS = [c.split()[0] for c in ENTRY.split(", ")]


def advance(entry: dict[str, Any] | None, action: str, at: int, delta: int | None, policy: str | None, source: str | None) -> dict[str, Any] | None:
    """An entry after one action (append, acknowledge, deliver, cleanup) at a time in microseconds; None: there is no entry.

    append: a new entry; a live one counts and is seen again, an acknowledged one stays as it is, and so does an archived one that
    holds until it was acknowledged, while any other archived one begins anew. acknowledge: by an allowed source, of an active entry.
    deliver: counts and puts the next delivery off. cleanup: archives an acknowledged entry."""
    if action == "append":
        if entry is not None and entry["active"]:
            if not entry["acknowledged"]:
                entry = dict(entry, last_seen=at, occurrence_count=entry["occurrence_count"] + max(1, delta or 1))
            return entry
        if entry is not None and entry["policy"] == UNTIL_ACK:
            return entry
        return dict.fromkeys(_FIELDS) | {"active": True, "acknowledged": False, "policy": policy or UNTIL_ACK, "occurrence_count": max(1, delta or 1), "first_seen": at, "last_seen": at, "delivered_count": 0}
    if entry is None:
        return None
    if action == "acknowledge" and source in ACK_SOURCES and entry["active"]:
        return dict(entry, acknowledged=True, ack_source=source)
    if action == "deliver":
        return dict(entry, delivered_count=entry["delivered_count"] + 1, next_redeliver_at=at + REDELIVER_AFTER * 1_000_000)
    if action == "cleanup" and entry["active"] and entry["acknowledged"]:
        return dict(entry, active=False, archived_at=at)
    return entry


def _store(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entry = dict(zip(_FIELDS, state.get)) if state.exists else None
    rows = [r for pdf in frames for r in zip(pdf["at"].astype("int64") // (1 if pdf["at"].dtype == "datetime64[us]" else 1000), pdf["ordinal"], pdf["action"], pdf["delta"], pdf["policy"], pdf["source"])]
    given = lambda x: None if x is None or x != x else x
    for at, _, action, delta, policy, source in sorted(rows, key=lambda r: (r[0], r[1])):
        delta = given(delta)
        entry = advance(entry, action, int(at), None if delta is None else int(delta), given(policy), given(source))
    if entry is None:
        return
    if entry["active"] or entry["policy"] == UNTIL_ACK:
        state.update(tuple(entry[f] for f in _FIELDS))
    elif state.exists:
        state.remove()  # it may come again as if it had never been, so nothing of it is kept
    out = pd.DataFrame({"session": [key[0]], "dedupe_key": [key[1]], **{f: [entry[f]] for f in _FIELDS}})
    for c in ("next_redeliver_at", "archived_at"):
        out[c] = out[c].astype("Int64")
    yield out


def event_store(actions: DataFrame) -> DataFrame:
    """Streaming store of actions(session, dedupe_key, at, ordinal, action, delta, policy, source): the entry of every touched key after each
    batch, times in microseconds. Actions of one batch are taken in order of time, then ordinal. Archived entries that may come again
    leave the state, so it holds what is live or must not be repeated."""
    a = actions.select("session", "dedupe_key", "at", "ordinal", "action", "delta", "policy", "source")
    return a.groupBy("session", "dedupe_key").applyInPandasWithState(_store, f"session string, dedupe_key string, {ENTRY}", ENTRY, "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, keys: tuple[str, ...] = ("session", "dedupe_key")) -> DataFrame:
    """Last state of every key over all batches."""
    cols = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("s")).select(*keys, "s.*")


def claim_due(entries: DataFrame, now: str, limit: int = 5) -> DataFrame:
    """The first `limit` due entries of every session, in order of arrival: active, not acknowledged, and no redelivery time or a past
    one. entries(session, entry, active, acked, next_redeliver_at)."""
    due = entries.where(F.col("active") & ~F.col("acked") & (F.col("next_redeliver_at").isNull() | (F.col("next_redeliver_at") <= F.lit(now).cast("timestamp"))))
    w = Window.partitionBy("session").orderBy("entry")
    return due.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def mark_delivered(entries: DataFrame, claimed: DataFrame, now: str, after: str = f"INTERVAL {REDELIVER_AFTER} SECONDS") -> DataFrame:
    """Entries with the claimed ones delivered once more and their next delivery put off."""
    c = claimed.select("session", "entry", F.lit(True).alias("hit"))
    j = entries.join(c, ["session", "entry"], "left")
    hit = F.coalesce("hit", F.lit(False))
    return j.withColumn("deliveries", F.col("deliveries") + hit.cast("int")).withColumn("next_redeliver_at", F.when(hit, F.lit(now).cast("timestamp") + F.expr(after)).otherwise(F.col("next_redeliver_at"))).drop("hit")


def increases(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose count grew, with the growth: the events of one edit."""
    b, a = before.groupBy(key).agg(F.count("*").alias("b")), after.groupBy(key).agg(F.count("*").alias("a"))
    return a.join(b, key, "left").fillna({"b": 0}).where("a > b").select(key, (F.col("a") - F.col("b")).alias("grown"))
