"""Problem 5: the N highest-scoring items of every group, by simultaneous bisection.

Order within a group: score descending, then identifier text ascending by code point, then row id ascending; rows with a null
score are left out, a null identifier comes last. Repeats (same row in all listed columns) count once. Null group keys are
keys like any other. Groups smaller than N keep all rows; an empty table gives an empty result.

Plan: rows are counted per group first (a narrow scan). Groups of up to `small` rows are ranked directly, one shuffle on the
group key. Groups above that are hot: their rows are never brought to one task. All of them are bisected at once on an
order-preserving code of 64-bit digits (score, then the identifier seven bytes at a time, then the row id): in each round the
rows above every midpoint of a group's open interval are counted with map-side partial counts, the interval that holds the
N-th row becomes the new open interval, rows above it are accepted and rows below it are gone. Each round works on the rows
left in open intervals only, so the data shrinks geometrically. When no interval holds more than `small` rows, the accepted
and the open rows (bounded per group) are ranked for the final N.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import lookup, materialize

_CHUNK = 7
_TOP = (1 << (8 * _CHUNK)) - 1
_LOW = (1 << 32) - 1


def _digit(level: Column, last: int, score: str, ident: str, row_id: str) -> Column:
    """The code digit of a row at a level; higher is better at every level, and no digit needs more than 56 bits. Levels 0 and 1 are the
    halves of the score, 2 to last the identifier, last+1 and last+2 the halves of the row id."""
    raw = F.encode(F.col(ident), "utf-8")
    part = F.substring(raw, (F.lit(1) + (level - 2) * _CHUNK).cast("int"), F.lit(_CHUNK))
    value = F.conv(F.rpad(F.hex(part), 2 * _CHUNK, "0"), 16, 10).cast("bigint")
    text = F.when(F.col(ident).isNull(), F.lit(-1).cast("bigint")).otherwise(F.lit(_TOP).cast("bigint") - value)
    high = lambda c: F.shiftright(F.col(c).cast("bigint"), 32)
    low = lambda c: F.col(c).cast("bigint").bitwiseAND(F.lit(_LOW).cast("bigint"))
    return F.when(level == 0, high(score)).when(level == 1, low(score)).when(level <= last, text).when(level == last + 1, -high(row_id)).otherwise(-low(row_id))


def _ranked(df: DataFrame, keys: list[str], score: str, ident: str, row_id: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident).asc_nulls_last(), F.col(row_id).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_n_per_group(
    rows: DataFrame, keys: list[str], score: str, ident: str, row_id: str, n: int = 10, small: int = 256, ways: int = 64
) -> DataFrame:
    """keys, row_id, ident, score and rank of the first n rows of every group. score and row_id are integers.
    small: rows of a group that one task may rank (at least n); ways: midpoints tried at once in each round."""
    small = max(small, n)
    rows = rows.select(*keys, row_id, ident, score).where(F.col(score).isNotNull())
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > small)
    hot = materialize(counts.select(*keys), "topn-hot")
    n_hot = hot.count()
    if n_hot == 0:
        flat = rows
    else:
        # __hot is null for the groups ranked directly
        flagged = lookup(rows, hot.withColumn("__hot", F.lit(1)), keys, n_hot, "left")
        flat = flagged.where(F.col("__hot").isNull()).drop("__hot")
    # one exchange on the group key serves both the removal of repeats and the ranking
    direct = _ranked(flat.repartition(*keys).dropDuplicates([*keys, row_id, ident, score]), keys, score, ident, row_id, n)
    if n_hot == 0:
        return direct
    cols = [*keys, row_id, ident, score]
    open_rows = flagged.where(F.col("__hot").isNotNull()).select(*cols).dropDuplicates(cols)
    open_rows = materialize(open_rows, "topn-open")
    longest = open_rows.agg(F.max(F.octet_length(ident))).first()[0] or 0
    last = 1 + (longest + _CHUNK - 1) // _CHUNK
    # state of a hot group: rows still needed and the digit that its open rows are told apart by
    state = hot.withColumn("need", F.lit(n)).withColumn("level", F.lit(0))
    accepted: list[DataFrame] = []
    while True:
        joined = lookup(open_rows, state, keys, n_hot).withColumn("code", _digit(F.col("level"), last, score, ident, row_id))
        ends = joined.groupBy(*keys, "need", "level").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count("*").alias("rows"))
        # rows tied in every digit are one row with different texts: nothing tells them apart, so they go to the ranking
        tied = (F.col("level") == last + 2) & (F.col("lo") == F.col("hi"))
        ends = materialize(ends.withColumn("busy", (F.col("rows") > small) & ~tied), "topn-ends")
        n_open = ends.where("busy").count()
        if not n_open:
            break
        busy = ends.where("busy").withColumn("width", F.greatest(F.lit(1).cast("bigint"), F.expr(f"(hi - lo) div {ways} + 1")))
        counted = lookup(open_rows, busy, keys, n_open).withColumn("code", _digit(F.col("level"), last, score, ident, row_id))
        counted = counted.groupBy(*keys, "need", "level", "lo", "hi", "width", F.expr("(code - lo) div width").alias("bin")).agg(F.count("*").alias("c"))
        # at most `ways` bins a group
        w = Window.partitionBy(*keys).orderBy(F.col("bin").desc())
        cut = (
            counted.withColumn("upto", F.sum("c").over(w))
            .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
            .select(
                *keys,
                "level",
                (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
                F.least(F.col("hi"), F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1).alias("hi"),
                (F.col("need") - F.col("upto") + F.col("c")).cast("int").alias("need"),
            )
        )
        cut = materialize(cut, "topn-cut")
        # every hot group moves: those with few open rows keep their interval
        now = cut.unionByName(ends.where("NOT busy").select(*keys, "level", "lo", "hi", "need"))
        moved = lookup(open_rows, now, keys, n_hot).withColumn("code", _digit(F.col("level"), last, score, ident, row_id))
        moved = materialize(moved.where(F.col("code") >= F.col("lo")).withColumn("above", F.col("code") > F.col("hi")).select(*cols, "above"), "topn-rows")
        accepted.append(moved.where("above").select(*cols))
        open_rows = moved.where("NOT above").select(*cols)
        # an interval of one value is tied on this digit: go on with the next one
        nxt = F.least(F.lit(last + 2), F.col("level") + 1)
        state = now.select(*keys, "need", F.when(F.col("lo") == F.col("hi"), nxt).otherwise(F.col("level")).alias("level"))
        state = materialize(state, "topn-state")
    rest = reduce(DataFrame.unionByName, accepted, open_rows)
    return direct.unionByName(_ranked(rest, keys, score, ident, row_id, n))
