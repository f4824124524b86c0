"""Ranked lists: positions, reciprocal rank fusion, normalization, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut, one_row

RRF_K = 60


def positions(scored: DataFrame, key: str) -> DataFrame:
    """``pos``: 0-based rank by falling score, ties by key, within each list_id.

    A global rank without a single-task sort: rows are range-partitioned by (list, score,
    key) and numbered within partitions; partitions' counts then give each its offset.
    """
    order = [F.col("list_id"), F.desc("score"), F.col(key)]
    ranged = scored.repartitionByRange(*order)
    part = cut(ranged.withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part", "list_id").orderBy(F.desc("score"), key)
    counts = part.groupBy("list_id", "_part").agg(F.count("*").alias("_n"))  # a row a list and partition
    before = Window.partitionBy("list_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("list_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = part.withColumn("_own", F.row_number().over(inner)).join(offsets, ["list_id", "_part"])
    return numbered.select("list_id", key, "score", (F.col("_own") + F.col("_offset") - 1).cast("int").alias("pos"))


def bonus(pos: Column) -> Column:
    """Extra credit of the first three places."""
    return F.when(pos == 0, 0.05).when(pos <= 2, 0.02).otherwise(0.0)


def rrf(ranked: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score): sum over the lists of 1 / (60 + pos + 1) plus the place's bonus, times the list's weight."""
    credit = F.lit(1.0) / (F.col("pos") + RRF_K + 1) + bonus(F.col("pos"))
    for name, w in (weights or {}).items():
        credit = F.when(F.col("list_id") == name, credit * w).otherwise(credit)
    return ranked.groupBy(key).agg(F.sum(credit).alias("score"))


class Ladder:
    """The candidates' scores of one list, best first: tells how many candidates come before any row."""

    def __init__(self, scores: np.ndarray, keys: np.ndarray):
        self.order = np.lexsort((keys, -scores))
        self.down, self.keys = -scores[self.order], keys[self.order]

    def before(self, scores: np.ndarray, keys: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.down, -scores, "left"), np.searchsorted(self.down, -scores, "right")
        for start in np.unique(low[low < high]):  # equal scores are in the order of their keys
            tied = np.flatnonzero((low == start) & (high > start))
            low[tied] = start + np.searchsorted(self.keys[start : high[tied[0]]], keys[tied], "left")
        return low


def depth_of(weights: list[float], k: int) -> int:
    """How many places of each list can hold one of the ``k`` best of the fusion.

    A list with k rows gives each of them at least least-weight / (60 + k). A row beyond
    place d of every list gets at most all-weights / (61 + d), which is less from here on;
    where no list has k rows, this many places hold all rows.
    """
    return int(sum(weights) / min(weights) * (RRF_K + k)) - RRF_K


def top_fused(wide: DataFrame, key: str, weights: dict[str, float], k: int) -> DataFrame:
    """(key, score) of the ``k`` best by :func:`rrf`, ties by key, without ranking the corpus.

    ``wide`` has a whole-numbered key and a column of scores per list, null for rows that
    aren't in the list. Only rows within :func:`depth_of` places of a list can be among
    the best, a number that doesn't depend on the corpus. Their exact places are found by
    counting, in one more pass, the rows between neighbouring candidates, so the result
    equals that of ranking every row. Three passes over narrow rows that are written once;
    each shuffles a bounded number of rows per task.
    """
    spark = wide.sparkSession
    names = list(weights)
    rows = cut(wide.select(F.col(key).cast("long").alias("_key"), *names))
    depth = depth_of(list(weights.values()), k)
    listed = rows.select("_key", F.inline(F.filter(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("score")) for n in names]), lambda x: x["score"].isNotNull())))
    order = Window.partitionBy("list").orderBy(F.desc("score"), "_key")
    chosen = listed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= depth).select("_key").dropDuplicates()
    found = rows.join(F.broadcast(chosen), "_key").toPandas()  # at most lists x depth rows
    kind = f"{key} {wide.schema[key].dataType.simpleString()}, score double"
    if found.empty:
        return spark.createDataFrame([], kind)
    ladders = [Ladder(found[n].dropna().to_numpy(), found["_key"][found[n].notna()].to_numpy()) for n in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = [np.zeros(len(ladder.keys) + 1, np.int64) for ladder in ladders]
        for b in batches:
            keys = b.column(0).to_numpy()
            for i, ladder in enumerate(ladders):
                there = b.column(i + 1).is_valid().to_numpy(zero_copy_only=False)
                scores = b.column(i + 1).to_numpy(zero_copy_only=False)
                gaps[i] += np.bincount(ladder.before(scores[there], keys[there]), minlength=len(gaps[i]))
        used = [np.flatnonzero(g) for g in gaps]
        lists = np.repeat(np.arange(len(gaps)), [len(u) for u in used])
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(np.concatenate(used), pa.int32()), pa.array(np.concatenate([g[u] for g, u in zip(gaps, used)]), pa.int64())], ["list", "gap", "n"])

    counted = rows.mapInArrow(count, "list int, gap int, n long").groupBy("list", "gap").agg(F.sum("n").alias("n")).collect()  # at most lists x candidates
    scores = dict.fromkeys(found["_key"].tolist(), 0.0)
    for i, (name, ladder) in enumerate(zip(names, ladders)):
        gaps = np.zeros(len(ladder.keys) + 1, np.int64)
        for r in counted:
            if r["list"] == i:
                gaps[r["gap"]] = r["n"]
        places = np.cumsum(gaps[:-1]) - 1  # a candidate is the last row of the gap that ends with it
        for at, owner in zip(places.tolist(), ladder.keys.tolist()):
            scores[owner] += weights[name] * (1 / (at + RRF_K + 1) + (0.05 if at == 0 else 0.02 if at <= 2 else 0.0))
    best = sorted(((x, round(score, 12)) for x, score in scores.items()), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame(best, kind)


def min_max(scored: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1]; all 1 where they hardly differ."""
    ends = scored.agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    span = F.col("_high") - F.col("_low")
    both = scored.withColumn("_e", one_row(ends)).select(*scored.columns, "_e.*")
    return both.withColumn("score", F.when(span < 1e-12, 1.0).otherwise((F.col("score") - F.col("_low")) / span)).drop("_low", "_high")


def best_per(scored: DataFrame, group: str, key: str) -> DataFrame:
    """The best row of every group, ties by key."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def within_budget(ranked: DataFrame, cost: str, order: list[Column], budget: int, least_cost: int, at_least: int = 0) -> DataFrame:
    """Longest prefix whose summed cost stays within ``budget``, but at least ``at_least`` rows.

    As each row costs ``least_cost`` or more, no more than budget / least_cost rows can
    fit; only so many are sorted and summed.
    """
    few = ranked.orderBy(*order).limit(max(budget, 0) // least_cost + 1 + at_least)
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = few.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("used", F.sum(cost).over(run))
    return summed.filter((F.col("used") <= budget) | (F.col("pos") < at_least))
