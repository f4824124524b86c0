"""Per-key results although a few keys hold most rows (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.common import one_row

SITE = ["caller_qualified", "callee_name", "file", "line"]


def call_sites(calls: DataFrame) -> DataFrame:
    """Distinct call sites; rows with a null or empty name in either field are left out.

    The shuffle key is the whole site, so no single name decides a partition, and a site
    that was stored again and again collapses in the map-side hash table. A null file or
    line is a value like any other.
    """
    named = calls.filter((F.col("caller_qualified") != "") & (F.col("callee_name") != ""))
    return named.select(*SITE).dropDuplicates()


FIELDS = ("callee_name", "caller_qualified")


def both_fields(sites: DataFrame, full: bool = True) -> DataFrame:
    """Figures per callee and per caller by map-side combining, with each key's share of all call sites.

    Distinct counterparts and files are counted in algebraic steps. Each site gives one
    record for its pair of names and, with ``full``, one for each name and its file;
    partial tables keyed by the pair spread a hot name over all reducers, and then only
    one small partial count per task and name goes to the name's own reducer. Without
    ``full`` sites are counted per name at once, combined in the same way. No task ever
    sees the raw rows of one name, hence no salt and no skew handling is needed.

    Result: key_field, key_value, call_sites, with ``full`` also counterparts and files
    (nulls don't count as a file), all_sites, share. Empty input gives an empty result.
    """
    callee, caller = (F.col(f) for f in FIELDS)
    total = one_row(sites.agg(F.count("*").alias("all_sites")))["all_sites"]
    with_share = lambda keys: keys.withColumn("all_sites", total).withColumn("share", F.col("call_sites") / F.col("all_sites"))
    if not full:
        names = F.array(*[F.struct(F.lit(f).alias("key_field"), c.alias("key_value")) for f, c in zip(FIELDS, (callee, caller))])
        return with_share(sites.select(F.inline(names)).groupBy("key_field", "key_value").agg(F.count("*").alias("call_sites")))
    record = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    records = [record(0, callee, caller), record(1, callee, F.col("file")), record(2, caller, F.col("file"))]
    pairs = sites.select(F.inline(F.array(*records))).groupBy("kind", "a", "b").agg(F.count("*").alias("n"))

    def part(field: str, key: Column, pair: bool) -> Column:
        in_files = F.when(F.col("b").isNotNull(), 1).otherwise(0)
        counts = {"sites": F.col("n"), "others": F.lit(1), "files": F.lit(0)} if pair else {"sites": F.lit(0), "others": F.lit(0), "files": in_files}
        return F.struct(F.lit(field).alias("key_field"), key.alias("key_value"), *[v.cast("long").alias(k) for k, v in counts.items()])

    names = F.when(F.col("kind") == 0, F.array(part(FIELDS[0], F.col("a"), True), part(FIELDS[1], F.col("b"), True)))
    names = names.when(F.col("kind") == 1, F.array(part(FIELDS[0], F.col("a"), False))).otherwise(F.array(part(FIELDS[1], F.col("a"), False)))
    keys = pairs.select(F.inline(names)).groupBy("key_field", "key_value")
    return with_share(keys.agg(F.sum("sites").alias("call_sites"), F.sum("others").alias("counterparts"), F.sum("files").alias("files")))


def dominant(keys: DataFrame, percent: int = 2) -> DataFrame:
    """Keys that hold at least ``percent`` % of the distinct call sites."""
    return keys.filter(F.col("call_sites") * 100 >= F.col("all_sites") * percent).select("key_field", "key_value")
