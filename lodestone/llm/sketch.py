"""Percentiles of very large numeric columns (problem 3): logarithmic buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float = ERROR) -> Column:
    """Bucket of a value; buckets are ordered as their values.

    Bucket i > 0 holds gamma^(i-1-OFFSET) < v <= gamma^(i-OFFSET), 0 only zero, -i the
    negated values of i. With gamma = (1 + error) / (1 - error) the bucket's middle is
    within ``error`` of any of its values. The offset keeps the index of the smallest
    double positive. Null, NaN and infinite values have no bucket.
    """
    v = value.cast("double")
    index = (F.ceil(F.log(F.abs(v)) / F.lit(math.log(_gamma(error)))) + F.lit(offset(error))).cast("int")
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(finite, F.when(v == 0, 0).when(v > 0, index).otherwise(-index))


def offset(error: float = ERROR) -> int:
    return math.ceil(745 / math.log(_gamma(error))) + 1


def middle(bucket: Column, error: float = ERROR) -> Column:
    """Value that stands for a bucket: 2 gamma^i / (gamma + 1)."""
    g = _gamma(error)
    size = F.exp((F.abs(bucket) - F.lit(offset(error))) * F.lit(math.log(g))) * F.lit(2 / (g + 1))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, by: list[str], value: str, error: float = ERROR) -> DataFrame:
    """Mergeable sketch: by, bucket, n. Its size depends on the spread of the values and
    not on their number; counts are combined map-side. Values without a bucket are left
    out, a null group is a group."""
    rows = df.select(*by, bucket_of(F.col(value), error).alias("bucket")).filter("bucket is not null")
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketch of the union, for fewer group columns: days into a month, parts into a whole."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentile_buckets(sketches: DataFrame, by: list[str], percents: list[float]) -> DataFrame:
    """by, percent, bucket, total, before: the bucket of the smallest value that at least
    ``percent`` % of a group's values don't exceed, and how many values lie in lower
    buckets. The window runs over buckets, of which a group has a bounded number."""
    order = Window.partitionBy(*by).orderBy("bucket")
    upto = sketches.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    asked = upto.select("*", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent"))
    rank = F.greatest(F.ceil(F.col("percent") * F.col("total") / 100 - F.lit(1e-9)), F.lit(1))
    hit = asked.withColumn("rank", rank).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return hit.select(*by, "percent", "bucket", "total", "rank", (F.col("upto") - F.col("n")).alias("before"))


def percentiles(sketches: DataFrame, by: list[str], percents: list[float], error: float = ERROR) -> DataFrame:
    """by, percent, total, value: each value within ``error`` (relative) of the exact one."""
    return percentile_buckets(sketches, by, percents).select(*by, "percent", "total", middle(F.col("bucket"), error).alias("value"))


def exact_percentiles(df: DataFrame, value: str, hits: DataFrame, by: list[str], error: float = ERROR) -> DataFrame:
    """by, percent, value: exact percentiles for the rows of :func:`percentile_buckets`.

    Only values in the asked buckets are counted, per distinct value; for whole numbers a
    bucket has few of them.
    """
    rows = df.select(*by, F.col(value).alias("value"), bucket_of(F.col(value), error).alias("bucket"))
    asked = hits.select(*by, "bucket").dropDuplicates()
    on = [*by, "bucket"]
    values = rows.join(asked, on, "left_semi").groupBy(*on, "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*on).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = values.withColumn("upto", F.sum("n").over(order))
    found = hits.join(upto, on).filter(F.col("before") + F.col("upto") >= F.col("rank"))
    return found.groupBy(*by, "percent").agg(F.min("value").alias("value"))


def heavy_tailed(df: DataFrame, key: str, value: str, times: float = 20, upper: float = 95, error: float = ERROR) -> DataFrame:
    """Keys whose ``upper`` percentile is at least ``times`` their median.

    The sketch decides wherever its error bound allows; keys in doubt get exact values.
    A null key is no key.
    """
    rows = df.filter(F.col(key).isNotNull())
    found = percentile_buckets(sketch(rows, [key], value, error), [key], [50.0, upper])
    g = _gamma(error)
    mid = middle(F.col("bucket"), error)
    low = F.when(mid >= 0, mid * (g + 1) / (2 * g)).otherwise(mid * (g + 1) / 2)  # the bucket's ends
    high = F.when(mid >= 0, mid * (g + 1) / 2).otherwise(mid * (g + 1) / (2 * g))
    of = lambda column, percent: F.max(F.when(F.col("percent") == percent, column))
    ends = found.groupBy(key).agg(of(low, 50.0).alias("l50"), of(high, 50.0).alias("h50"), of(low, upper).alias("lu"), of(high, upper).alias("hu"))
    slack = 1e-6
    sure = ends.filter(F.col("lu") >= times * F.col("h50") * (1 + slack)).select(key)
    doubt = ends.filter((F.col("lu") < times * F.col("h50") * (1 + slack)) & (F.col("hu") >= times * F.col("l50") * (1 - slack))).select(key)
    exact = exact_percentiles(rows, value, found.join(doubt, key, "left_semi"), [key], error)
    checked = exact.groupBy(key).agg(of(F.col("value"), 50.0).alias("median"), of(F.col("value"), upper).alias("top"))
    return sure.unionByName(checked.filter(F.col("top") >= times * F.col("median")).select(key))
