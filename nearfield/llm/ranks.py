"""Gapless numbering without one task that sees a whole group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_ranks(df: DataFrame, groups: list[str], order: list[str], out: str, salts: int | None = None, weight: str | None = None) -> DataFrame:
    """Adds a number from 0 in each group, in the order of a hash; with `weight`, the sum of that whole-number column over the
    rows before. The group is split by a hash of the order columns, which must name a row (repeated rows need a stored number
    of their own among them); a row's number is the rows in its group's earlier splits (a table of at most groups x salts
    sums) plus its place in its split. Internal columns have names that no input column has."""
    spark = df.sparkSession
    n = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = uuid.uuid4().hex
    salt, place, base, size = (f"{x}-{own}" for x in ("salt", "place", "base", "size"))
    keyed = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(n)).cast("int"))
    sizes = keyed.groupBy(*groups, salt).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias(size))
    before = Window.partitionBy(*groups).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(base, F.coalesce(F.sum(size).over(before), F.lit(0).cast("long"))).drop(size)
    starts = starts.select(*[F.col(c).alias(f"{c}-{own}") for c in groups], F.col(salt).alias(f"of-{own}"), base)
    inside = Window.partitionBy(*groups, salt).orderBy(*order)
    earlier = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inside) - 1
    on: Column = F.col(salt) == F.col(f"of-{own}")
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}-{own}"))
    both = keyed.withColumn(place, earlier).join(starts, on)
    return both.withColumn(out, (F.col(base) + F.col(place)).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], out)
