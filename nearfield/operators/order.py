"""Ranks and offsets in ordered groups, without a task that sees a whole group.

A group is cut by equal steps of a number between its least and greatest value in the table, which every evaluation of the
plan cuts alike. Windows run inside the cuts, and over the cuts' sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(df: DataFrame) -> int:
    """As many cuts of a group as the session has shuffle partitions, 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut(df: DataFrame, number: str, n: int) -> Column:
    """The cut, 0 to n - 1, of a numeric column; null for null."""
    low, high = (df.agg(f(F.col(number).cast("double"))).scalar() for f in (F.min, F.max))
    share = (F.col(number).cast("double") - low) / F.when(high > low, high - low).otherwise(1.0)
    return F.least(F.floor(share * n), F.lit(n - 1)).cast("int")


def running(by: list[str], order: str, amount: str) -> Column:
    """The sum of amount before a row."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long")


def id_ranks(df: DataFrame, by: list[str], number: str, out: str, n: int | None = None) -> DataFrame:
    """Adds each row's place from 0 in its group by a unique numeric column."""
    keyed = df.withColumn("_cut", cut(df, number, n or steps(df)))
    sizes = keyed.groupBy(*by, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_first", running(by, "_cut", "_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_cut").orderBy(number)) - 1
    return keyed.withColumn("_place", place).join(starts, [*by, "_cut"]).withColumn(out, (F.col("_first") + F.col("_place")).cast("long")).drop("_cut", "_first", "_place")


def value_offsets(df: DataFrame, by: list[str], value: str, n: int | None = None) -> DataFrame:
    """by, value, n, first, total: of each distinct numeric value of a group how often it is there, how many smaller ones
    there are and the group's size."""
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    keyed = values.withColumn("_cut", cut(df, value, n or steps(df)))
    sums = keyed.groupBy(*by, "_cut").agg(F.sum("n").alias("_n"))
    sums = sums.withColumn("_first", running(by, "_cut", "_n")).withColumn("total", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    inner = keyed.withColumn("_inner", running([*by, "_cut"], value, "n"))
    return inner.join(sums, [*by, "_cut"]).select(*by, value, "n", (F.col("_first") + F.col("_inner")).alias("first"), "total")


def ordered_ranks(df: DataFrame, by: list[str], value: str, tie: str, out: str) -> DataFrame:
    """Adds each row's place from 0 in its group by (value, tie); tie is a unique numeric column, value is numeric."""
    n = steps(df)
    keyed = df.withColumn("_tie", cut(df, tie, n))
    parts = keyed.groupBy(*by, value, "_tie").agg(F.count(F.lit(1)).alias("_m"))
    parts = parts.withColumn("_before", running([*by, value], "_tie", "_m")).drop("_m")
    starts = parts.join(value_offsets(df, by, value).drop("n", "total"), [*by, value])
    place = F.row_number().over(Window.partitionBy(*by, value, "_tie").orderBy(tie)) - 1
    ranked = keyed.withColumn("_place", place).join(starts, [*by, value, "_tie"])
    return ranked.withColumn(out, (F.col("first") + F.col("_before") + F.col("_place")).cast("long")).drop("_tie", "_before", "_place", "first")


def greatest_gaps(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """by, n, least, most: rows of a group and the least and greatest step between neighbours (null for a single row)."""
    keyed = df.withColumn("_cut", cut(df, number, steps(df)))
    inside = F.col(number) - F.lag(number).over(Window.partitionBy(*by, "_cut").orderBy(number))
    parts = keyed.withColumn("_gap", inside).groupBy(*by, "_cut").agg(F.count(F.lit(1)).alias("_n"), F.min("_gap").alias("_low"), F.max("_gap").alias("_high"), F.min(number).alias("_from"), F.max(number).alias("_to"))
    across = F.col("_from") - F.lag("_to").over(Window.partitionBy(*by).orderBy("_cut"))
    return parts.withColumn("_across", across).groupBy(*by).agg(F.sum("_n").alias("n"), F.least(F.min("_low"), F.min("_across")).alias("least"), F.greatest(F.max("_high"), F.max("_across")).alias("most"))


def disorder(df: DataFrame, by: list[str], place: str, number: str) -> DataFrame:
    """by, out_of_order, outside: rows whose number isn't over that of the row before, by place; and numbers under 0."""
    keyed = df.withColumn("_cut", cut(df, place, steps(df)))
    inside = Window.partitionBy(*by, "_cut").orderBy(place)
    late = (F.col(number) <= F.lag(number).over(inside)).cast("int")
    parts = keyed.withColumn("_late", late).groupBy(*by, "_cut").agg(F.coalesce(F.sum("_late"), F.lit(0)).alias("_l"), F.count_if(F.col(number) < 0).alias("_o"), F.min_by(number, place).alias("_from"), F.max_by(number, place).alias("_to"))
    across = F.col("_from") <= F.lag("_to").over(Window.partitionBy(*by).orderBy("_cut"))
    return parts.withColumn("_across", F.coalesce(across.cast("int"), F.lit(0))).groupBy(*by).agg(F.sum(F.col("_l") + F.col("_across")).cast("long").alias("out_of_order"), F.sum("_o").alias("outside"))
