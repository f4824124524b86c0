"""Processing only new or changed records (problem 6).

A table is cut into buckets of its key, so many that each has about :data:`PER_BUCKET`
rows however large the table is. Each bucket has a fingerprint, the number of its rows and
additive hashes of them, which any engine can merge in any order. Buckets whose
fingerprint equals the recorded one are skipped; in the others rows are compared one by
one. :class:`Incremental` also keeps the state, in partitions of many buckets that are
replaced by dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.common import cut, fingerprint

KEY = ["collection", "path"]
PER_BUCKET = 64  #: rows of a bucket, about: where a part c of the rows has changed, (1 - c)^64 of the buckets are skipped
PARTS = 256  #: partitions of a state table


def plain_hash(c: Column | str) -> Column:
    """Content hash in one spelling: lower case, no blanks, no ``sha256:`` prefix."""
    return F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")


def bucket_count(documents: DataFrame, per_bucket: int = PER_BUCKET) -> Column:
    """Number of buckets for a table, as a scalar subquery; counting rows reads only the files' footers."""
    return documents.agg(F.greatest(F.ceil(F.count("*") / per_bucket), F.lit(1)).cast("long").alias("n")).scalar()


def bucket(buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets) if isinstance(buckets, int) else buckets)


def current_state(documents: DataFrame, buckets: int | Column) -> DataFrame:
    """Documents that can be indexed: their text is neither null nor empty. A null hash
    stands for the hash of the text, which is computed for such rows only."""
    digest = F.coalesce(plain_hash("content_hash"), F.sha2(F.encode("text", "UTF-8"), 256))
    return documents.filter(F.octet_length("text") > 0).select(bucket(buckets).alias("bucket"), *KEY, "doc_id", digest.alias("digest"))


def recorded_state(snapshots: DataFrame, runs: DataFrame, buckets: int | Column) -> DataFrame:
    """What the latest started successful run recorded for each collection and path.

    Repeated rows and ties fall to the larger (started_at, run_id, indexed_at, hash).
    Rows of unknown or unsuccessful runs don't count.
    """
    done = runs.filter(F.col("status") == "success").select("run_id", "started_at")
    rank = F.struct("started_at", "run_id", "indexed_at", plain_hash("content_hash").alias("digest"))
    latest = snapshots.join(done, "run_id").groupBy(*KEY).agg(F.max(rank).alias("_last"))
    return latest.select(bucket(buckets).alias("bucket"), *KEY, F.col("_last.digest").alias("digest"))


def fingerprints(state: DataFrame) -> DataFrame:
    """bucket, rows, two sums of 64-bit row hashes (in 32-bit halves, which can't overflow)."""
    sums = []
    for i, h in enumerate(fingerprint(*KEY, "digest")):
        sums += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"low{i}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"high{i}")]
    return state.groupBy("bucket").agg(F.count("*").alias("rows"), *sums)


def changed_buckets(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Buckets whose fingerprints differ or that one side lacks; a row a bucket."""
    a, b = fingerprints(current), fingerprints(recorded)
    parts = [c for c in a.columns if c != "bucket"]
    b = b.select("bucket", *[F.col(c).alias(f"_{c}") for c in parts])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts])
    return a.join(b, "bucket", "full_outer").filter(~same).select("bucket")


def changes(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """New, changed and deleted records, from changed buckets only.

    Result: collection, path, doc_id, digest, change (``new``, ``changed``, ``deleted``).
    Keys are compared null-safely. With no recorded state everything is new. Buckets are
    about equal in size, so joining by them has no hot key; whether their numbers are few
    enough to broadcast is left to the engine, which knows their size.
    """
    todo = changed_buckets(current, recorded)
    now = current.join(todo, "bucket", "left_semi").select(*[F.col(k).alias(f"_a_{k}") for k in KEY], "doc_id", "digest", F.lit(True).alias("_now"))
    was = recorded.join(todo, "bucket", "left_semi").select(*[F.col(k).alias(f"_b_{k}") for k in KEY], F.col("digest").alias("_digest"), F.lit(True).alias("_was"))
    both = now.join(was, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in KEY], "full_outer")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(~F.col("digest").eqNullSafe(F.col("_digest")), "changed")
    keys = [F.when(F.col("_now"), F.col(f"_a_{k}")).otherwise(F.col(f"_b_{k}")).alias(k) for k in KEY]
    return both.select(*keys, "doc_id", F.coalesce("digest", "_digest").alias("digest"), change.alias("change")).filter("change is not null")


class Incremental:
    """State table of an incremental job: a row per record, in partitions by a hash of the key.

    ``run`` processes the new and changed records and replaces the partitions that hold
    them, some at a time. What was done is told by the state rows themselves: whatever a
    run that failed didn't replace still differs and is taken up by the next one, whatever
    it did replace doesn't. A replacement deletes a partition before the new one is moved
    in; if a run dies between the two, that partition has no rows, and the next run takes
    its records as new. So none is skipped, and none is repeated that was recorded.
    Deleted records leave a row with ``live = false`` until their partition is next
    replaced, so that a partition that lost all its records is replaced as well.
    A path is taken to be unique within its collection.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, at_once: int = 64):
        self.spark, self.path, self.parts, self.at_once = spark, path, parts, at_once

    def part(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), *KEY), F.lit(self.parts)).cast("int")

    def state(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where) or not any(s.getPath().getName().startswith("part=") for s in files.listStatus(where)):
            return None
        return self.spark.read.parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows = rows.withColumn("part", self.part()).repartition("part")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def start(self, recorded: DataFrame) -> None:
        """Begin with a state that is known from elsewhere: collection, path, digest and any result columns."""
        self._write(recorded.drop("bucket").withColumn("live", F.lit(True)), "append")

    def changes(self, documents: DataFrame) -> DataFrame:
        """What a run would process now, and what it would mark as deleted."""
        buckets = bucket_count(documents)
        now, state = current_state(documents, buckets), self.state()
        recorded = now.limit(0).drop("doc_id") if state is None else state.filter("live").select(bucket(buckets).alias("bucket"), *KEY, "digest")
        return changes(now, recorded)

    def run(self, documents: DataFrame, process: Callable[[DataFrame], DataFrame]) -> None:
        """``process`` gets documents to handle and returns one row per doc_id with any further
        columns, which the state keeps. It is called once per ``at_once`` partitions to be
        replaced, at most parts / at_once times, so a failure loses no more than that."""
        todo = cut(self.changes(documents).withColumn("part", self.part()))
        dirty = sorted(r.part for r in todo.select("part").dropDuplicates().collect())  # at most ``parts`` integers
        for i in range(0, len(dirty), self.at_once):
            some = dirty[i : i + self.at_once]
            mine = todo.filter(F.col("part").isin(some))
            work = documents.join(mine.filter("change <> 'deleted'").select("doc_id"), "doc_id", "left_semi")
            result = mine.select("doc_id", *KEY, "digest").join(process(work), "doc_id").withColumn("live", F.lit(True))
            state = self.state()
            if state is not None:
                gone = mine.filter("change <> 'new'").select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("change").alias("_change"))
                kept = state.filter(F.col("part").isin(some) & F.col("live")).drop("live", "part")
                both = kept.join(gone, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], "left").filter("_change is null or _change = 'deleted'")
                result = result.unionByName(both.select(*kept.columns, F.col("_change").isNull().alias("live")), allowMissingColumns=True)
            self._write(result, "overwrite")
