"""Helpers shared by all operators: table access, row identity, lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``sf_dir``; pruning and pushdown stay with Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: what the session names in ``spark.checkpoint.dir``. Only a
    session on one machine may name none and gets a temporary folder; on a cluster every
    executor would write to a disk of its own, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than so many rows; no more than that are looked at."""
    return df.limit(rows + 1).count() <= rows


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that an expensive branch is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fingerprint(*columns: Column | str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the given columns.

    Spark's hash skips nulls, so ('a', null) and (null, 'a') would collide; the null
    pattern is therefore hashed along. Rows are taken as equal if both hashes agree.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return F.xxhash64(*cols, nulls), F.xxhash64(F.lit("second"), nulls, *cols)


def distinct_rows(df: DataFrame, ignore: tuple[str, ...], **keep: Column) -> DataFrame:
    """Rows of ``df`` that differ in any column but ``ignore``, once each, as ``keep``.

    Only two hashes and the kept expressions are shuffled, never the wide row; equal
    rows meet in map-side hash tables first, so a row stored millions of times costs
    one record per input partition. Nulls are equal to nulls.
    """
    one, two = fingerprint(*[F.col(f"`{c}`") for c in df.columns if c not in ignore])
    narrow = df.select(one.alias("_fp1"), two.alias("_fp2"), *[v.alias(k) for k, v in keep.items()])
    return narrow.dropDuplicates().drop("_fp1", "_fp2")


def one_row(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct Column for use in any other frame: a scalar
    subquery, evaluated once, instead of a join."""
    return df.select(F.struct(*df.columns)).scalar()


def blank_trim(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
