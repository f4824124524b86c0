"""Cosine similarity and exact nearest neighbours of given query vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for null, empty or differently long vectors, for a zero norm and for values that are no numbers."""
    length = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector; null for a null vector."""
    return F.when(vector.isNotNull(), cosine(vector, F.array(*[F.lit(float(x)) for x in query])))


def score_all(items: DataFrame, key: str, vector: str, queries: dict[str, list[float]]) -> DataFrame:
    """(list_id, key, score): cosine of every item that has a vector with every query vector."""
    query = lambda v: F.array(*[F.lit(float(x)) for x in v])
    scores = [F.struct(F.lit(q).alias("list_id"), cosine(F.col(vector), query(v)).alias("score")) for q, v in queries.items()]
    return items.filter(F.col(vector).isNotNull()).select(key, F.inline(F.array(*scores))).select("list_id", key, "score")


def top_per_list(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of every list, ties by key; partial top-k lists are cut before the shuffle."""
    order = Window.partitionBy("list_id").orderBy(F.desc("score"), key)
    return scored.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < k)
