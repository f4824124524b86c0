"""Tables as sinks: upserts, first-wins inserts, refreshes, caches, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same key; of several new ones the last by ``order`` wins."""
    if order is not None:
        last = Window.partitionBy(*key).orderBy(order.desc())
        new = new.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by ``order``: an insert that ignores known keys."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def refresh(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups (files) in ``new`` are replaced."""
    return old.join(new.select(group).dropDuplicates(), group, "left_anti").unionByName(new)


def lookup(asked: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return asked.join(cache, key), asked.join(cache.select(*key), key, "left_anti")


def cache_key(*values: Column) -> Column:
    """Key over all parameters that a result depends on."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256)


def recent(rows: DataFrame, time: str, days: int, today: str) -> DataFrame:
    """Rows kept by a retention of ``days``."""
    return rows.filter(F.to_date(time) >= F.date_sub(F.lit(today).cast("date"), days))


def append(rows: DataFrame, path: str, partition: list[str] = []) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and a function from names to its paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a :func:`replace` that broke off: the table is never without one whole version.

    A missing table is the new version if that is complete, else the old one that was put
    aside; what else is left over is removed.
    """
    files, at = _files(spark, path)
    stem = path.rstrip("/")
    if not files.exists(at(path)):
        if files.exists(at(f"{stem}.next/_SUCCESS")):
            files.rename(at(f"{stem}.next"), at(path))
        elif files.exists(at(f"{stem}.old")):
            files.rename(at(f"{stem}.old"), at(path))
    if files.exists(at(path)):
        files.delete(at(f"{stem}.old"), True)
        files.delete(at(f"{stem}.next"), True)


def replace(rows: DataFrame, path: str) -> None:
    """Overwrite a table that ``rows`` may have been read from: written beside it, the old
    version put aside, the new one renamed, and only then the old one deleted. After a
    failure at any point :func:`recover`, which readers call, finds a whole version."""
    spark = rows.sparkSession
    stem = path.rstrip("/")
    files, at = _files(spark, path)
    rows.write.mode("overwrite").parquet(f"{stem}.next")
    if files.exists(at(path)):
        files.delete(at(f"{stem}.old"), True)
        files.rename(at(path), at(f"{stem}.old"))
    files.rename(at(f"{stem}.next"), at(path))
    files.delete(at(f"{stem}.old"), True)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, after :func:`recover`; without rows if there is none yet."""
    recover(spark, path)
    files, at = _files(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(at(path)) else spark.createDataFrame([], schema)


class Cache:
    """A table of results by the key of all parameters that they depend on: finished maps,
    a file's signatures by path and content hash, wordings and judgements of models."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, self.schema)

    def get(self, asked: DataFrame, compute: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
        """Rows of the cache for ``asked`` (key and whatever ``compute`` needs); what is missing is
        computed once, appended, and read back. A key with several rows keeps them all."""
        known = self.rows()
        misses = asked.join(known.select(*key).dropDuplicates(), key, "left_anti")
        append(compute(misses).select(*known.columns), self.path)
        return self.rows().join(asked.select(*key).dropDuplicates(), key, "left_semi")
