"""Statistics of measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.operators import order


def geometric_mean(df: DataFrame, ratio: str) -> DataFrame:
    return df.agg(F.exp(F.avg(F.ln(ratio))).alias("geo_mean"))


def sign_flip(spark: SparkSession, ratios: list[float], tolerance: float = 1e-15) -> DataFrame:
    """Exact one- and two-sided p of the sum of log ratios under all 2^n sign vectors; for up to about 20 pairs."""
    logs = [math.log(r) for r in ratios]
    signed = [F.when(F.shiftright("id", k).bitwiseAND(F.lit(1).cast("bigint")) == 1, -x).otherwise(F.lit(x)) for k, x in enumerate(logs)]
    total = spark.range(1 << len(logs)).select(sum(signed, F.lit(0.0)).alias("t"))
    seen = sum(logs, 0.0)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return total.agg(share(F.col("t") >= seen - tolerance).alias("one_sided"), share(F.abs("t") >= abs(seen) - tolerance).alias("two_sided"))


def least_squares(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Slope and intercept; the slope is 0 where x doesn't vary."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(F.coalesce(F.regr_slope(a, b), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(a, b), F.avg(a)).alias("intercept"))


def spearman(df: DataFrame, x: str, y: str, tie: str, by: list[str]) -> DataFrame:
    """Correlation of places in sorted order; ties go by `tie`, a unique number, and aren't averaged."""
    placed = order.ordered_ranks(order.ordered_ranks(df.select(*by, x, y, tie), by, x, tie, "at_x"), by, y, tie, "at_y")
    return placed.groupBy(*by).agg(F.round(F.corr(F.col("at_x").cast("double"), F.col("at_y").cast("double")), 9).alias("rho"))


def percentiles(df: DataFrame, value: str, by: str) -> DataFrame:
    """p50 and p95 at the floor of p(n - 1), q95 at the ceiling of pn, all counted from the smallest. From the counts of
    distinct values, so no task sorts a group."""
    v = order.value_offsets(df, [by], value)
    total = F.col("total")
    at = lambda place, name: F.max(F.when((F.col("first") <= place) & (place < F.col("first") + F.col("n")), F.col(value))).alias(name)
    return v.groupBy(by).agg(at(F.floor(0.5 * (total - 1)), "p50"), at(F.floor(0.95 * (total - 1)), "p95"), at(F.ceil(F.lit(0.95) * total) - 1, "q95"))


def variance_order(df: DataFrame, vector: str) -> DataFrame:
    """Dimensions by falling variance, ties to the smaller."""
    v = df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.round(F.var_pop(F.col("v").cast("double")), 12).alias("variance"))
    return v.withColumn("place", F.row_number().over(Window.orderBy(F.desc("variance"), "dim")))


def fraction_passes(hits: Column, denominator: Column, over: int, under: int) -> Column:
    """hits / denominator >= over / under in whole numbers; nothing passes without a denominator."""
    return (denominator > 0) & (hits * under >= denominator * over)


def close(actual: Column, expected: Column, tolerance: float = 0.002) -> Column:
    """Equal within the tolerance, relative to the larger or absolute."""
    return F.abs(actual - expected) <= F.greatest(tolerance * F.greatest(F.abs(actual), F.abs(expected)), F.lit(tolerance))


def predicted(df: DataFrame, cost: str, work: str, key: str, route: list[str], fitted_on: Column) -> DataFrame:
    """route, n, ape, rho: a line fitted by route on some rows (the family of all rows where a route has under two of them),
    held against the others: mean relative error, and the correlation of ranks. A prediction is 1 at least."""
    train = df.where(fitted_on)
    by = train.groupBy(*route).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.regr_slope(cost, work), F.lit(0.0)).alias("_s"), F.coalesce(F.regr_intercept(cost, work), F.avg(cost)).alias("_i"))
    slope, level = (train.agg(F.coalesce(f(cost, work), F.lit(0.0))).scalar() for f in (F.regr_slope, F.regr_intercept))
    enough = F.coalesce(F.col("_n"), F.lit(0)) >= 2
    fitted = df.where(~fitted_on).join(by, route, "left").withColumn("guess", F.greatest(F.lit(1.0), F.when(enough, F.col("_s")).otherwise(slope) * F.col(work) + F.when(enough, F.col("_i")).otherwise(level)))
    ranked = order.ordered_ranks(order.ordered_ranks(fitted.select(*route, cost, "guess", key), route, "guess", key, "at_x"), route, cost, key, "at_y")
    ape = F.abs(F.col("guess") - F.col(cost)) / F.col(cost)
    return ranked.groupBy(*route).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ape), 6).alias("ape"), F.round(F.corr(F.col("at_x").cast("double"), F.col("at_y").cast("double")), 6).alias("rho"))
