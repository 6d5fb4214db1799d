"""Session plumbing shared by all queries: table access, shared folder, shipping the package, size-checked lookups."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table of narrow rows may be broadcast (a few MB at most); beyond it the join is shuffled and salted.
BROADCAST_ROWS = 50_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers on any cluster, once per application."""
    sc: SparkContext = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    # only the driver reads this file: Spark's file server hands it to the executors
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}_src.zip")
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    # Python operators see long texts: keep their Arrow batches small, unless the session asks for other sizes
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        if not sc.getConf().contains(key):
            spark.conf.set(key, value)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Before a CPU-bound Python operator: repartition an input that comes in too few splits to fill the cluster.
    Inputs of many splits stay where they are, without a shuffle, and so does what comes out of a shuffle (to count its splits would run it)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan" or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(3 * cores, *cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session sets it, else a temporary one (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="factloom_shared_")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_written: list[str] = []
_kept: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def release(spark: SparkSession) -> None:
    """Delete the tables that materialize() wrote in this process. Call it once their results are stored: plans read them lazily."""
    jvm = spark._jvm
    _kept.clear()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, name: str, write: Callable[[str], DataFrame]) -> DataFrame:
    """A table that several queries of one application read, written to the shared folder by the first of them, until release(). It is
    written again where somebody cleared the folder in between."""
    key = (spark.sparkContext.applicationId, name)
    if key in _kept:
        path, df = _kept[key]
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            return df
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    _written.append(path)
    df = write(path)
    _kept[key] = (path, df)
    return df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def lookup(df: DataFrame, small: DataFrame, keys: list[str], n_small: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join df to a table with one row per key: broadcast while n_small is proven small, else shuffle with the lookup
    replicated over salts, so that one hot key of df spreads over many tasks. Null keys match null keys."""
    cols = [c for c in small.columns if c not in keys]
    small = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *cols)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    if n_small <= BROADCAST_ROWS:
        out = df.join(F.broadcast(small), cond, how)
    else:
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int"))
        small = small.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = df.join(small, cond & (F.col("__salt") == F.col("__s")), how).drop("__salt", "__s")
    return out.drop(*[f"__k_{k}" for k in keys])
