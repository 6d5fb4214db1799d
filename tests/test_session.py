from __future__ import annotations

import os

from factloom.plans import session


def test_lookup_paths_agree(spark):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, "x" if i % 3 else None, i) for i in range(200)], "a bigint, b string, v bigint")
    small = spark.createDataFrame([(k, b, f"{k}{b}") for k in (None, 1, 2, 3) for b in ("x", None)], "a bigint, b string, w string")
    for how in ("inner", "left"):
        rows = [sorted(map(str, session.lookup(df, small, ["a", "b"], n, how).collect())) for n in (8, session.BROADCAST_ROWS + 1)]
        assert rows[0] == rows[1] and len(rows[0]) == (200 if how == "left" else len(rows[0]))


def test_written_tables_can_be_released(spark):
    t = session.materialize(spark.range(3).toDF("x"), "t")
    path = session._written[-1].removeprefix("file://")
    assert t.count() == 3 and os.path.isdir(path)
    session.release(spark)
    assert not os.path.exists(path)


def test_shared_folder_is_the_sessions(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_spread_leaves_wide_inputs(spark):
    wide = spark.range(100, numPartitions=16)
    assert session.spread(wide) is wide
    assert session.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == 12


def test_kept_tables_are_written_once_or_again_when_gone(spark):
    import shutil

    calls = []

    def write(path):
        calls.append(path)
        spark.range(4).toDF("x").write.parquet(path)
        return spark.read.parquet(path)

    assert [session.written(spark, "kept", write).count() for _ in range(2)] == [4, 4] and len(calls) == 1
    shutil.rmtree(calls[0].removeprefix("file://"))
    assert session.written(spark, "kept", write).count() == 4 and len(calls) == 2
