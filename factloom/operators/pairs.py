"""Pairs of rows that share a key, without a key as a unit of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a key that meet the rows of one other block (or their own) in one task
BLOCK = 2_000


def meet(rows: DataFrame, keys: list[str], ident: str, size: str, block: int = BLOCK) -> DataFrame:
    """l and r (structs of the columns of rows) and the keys of every two rows with equal keys and different ident, l the lesser one.
    size: the column with the number of rows of the key, which decides the number of blocks; a row has a key once.

    The rows of a key are cut into blocks by the hash of ident, and every two blocks meet at a place of their own: a key of n rows is
    (n / block) ** 2 / 2 places of about block ** 2 pairs, however frequent it is, and a row is copied n / block times. The pairs are
    still all pairs of the key: the caller's keys must be so narrow that those are the candidates it wants."""
    cols = [c for c in rows.columns if c not in (*keys, size)]
    b = rows.select(*keys, F.struct(*cols).alias("row"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col(size) / block)).alias("nb"))
    b = b.withColumn("at", F.pmod(F.xxhash64(F.col("row")[ident]), F.col("nb")))
    left = b.select(*keys, F.col("row").alias("a"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("nb") - 1)).alias("j"))
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("row").alias("z"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("at"))).alias("__i"), F.col("at").alias("__j"))
    on = (F.col("i") == F.col("__i")) & (F.col("j") == F.col("__j"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    less = F.col("a")[ident] < F.col("z")[ident]
    both = left.join(right, on & F.when(F.col("i") == F.col("j"), less).otherwise(F.col("a")[ident] != F.col("z")[ident]))
    return both.select(*keys, F.when(less, F.col("a")).otherwise(F.col("z")).alias("l"), F.when(less, F.col("z")).otherwise(F.col("a")).alias("r"))
