"""Call graphs: callers, callees, trace, impact, enclosing symbols, PageRank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.common import cut, one_row
from lodestone.functions.text import last_segment
from lodestone.operators.fusion import within_budget

#: What a node's score is multiplied by.
KIND_WEIGHT = {"function": 1.0, "method": 1.0, "class": 0.95, "struct": 0.95, "trait": 0.95, "interface": 0.95, "enum": 0.95}
OTHER_KIND = 0.85
LEAST_COST = 8  #: tokens; 32 bytes of frame a node


def node_score(sites: Column, kind: Column, name: Column, qualified: Column, terms: list[str] = []) -> Column:
    """(1 + log2(call sites) + 5 per query term in the name or else 2 in the qualified name) x the kind's weight."""
    base = F.lit(1.0) + F.greatest(F.log2(sites.cast("double")), F.lit(0.0))
    for t in terms:
        base = base + F.when(F.lower(name).contains(t), 5.0).when(F.lower(qualified).contains(t), 2.0).otherwise(0.0)
    weight = reduce(lambda w, kv: w.when(kind == kv[0], kv[1]), KIND_WEIGHT.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER_KIND)
    return base * weight


def groups(calls: DataFrame, by: str) -> DataFrame:
    """key, sites, site_bytes: call sites per caller or callee as counts, combined map-side.
    Sites themselves are collected only for nodes that are kept (:func:`with_sites`)."""
    site = F.concat_ws(":", "file", F.col("line").cast("string"))
    return calls.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("sites"), F.sum(F.octet_length(site)).alias("site_bytes"))


def resolve(nodes: DataFrame, symbols: DataFrame, by_simple_name: bool) -> DataFrame:
    """name, kind, file, line of each node's symbol.

    A caller's simple name is looked up and the symbol with the same qualified name
    preferred; a callee is looked up by name. Else the first by id, else a made-up
    symbol (kind function, line 0, language unknown).
    """
    name = last_segment(F.col("key")) if by_simple_name else F.col("key")
    asked = nodes.select("*", name.alias("_name"))
    names = asked.select("_name").dropDuplicates()
    known = symbols.join(names, symbols["name"] == names["_name"], "left_semi")
    fields = ["qualified", "kind", "file", "line", "language"]
    first = known.groupBy("name").agg(F.min_by(F.struct(*fields), "id").alias("_first"))
    own = known.groupBy(F.col("qualified").alias("_qualified"), "name").agg(F.min_by(F.struct(*fields), "id").alias("_own"))
    joined = asked.join(first.withColumnRenamed("name", "_n1"), F.col("_name") == F.col("_n1"), "left").join(own.withColumnRenamed("name", "_n2"), (F.col("key") == F.col("_qualified")) & (F.col("_name") == F.col("_n2")), "left")
    pick = F.coalesce("_own", "_first")
    out = [F.coalesce(pick[c], d).alias(c) for c, d in (("qualified", F.col("key")), ("kind", F.lit("function")), ("file", F.lit("")), ("line", F.lit(0)), ("language", F.lit("unknown")))]
    return joined.select(*nodes.columns, F.col("_name").alias("name"), *out)


def _ranked(nodes: DataFrame, symbols: DataFrame, by_simple_name: bool, terms: list[str], budget: int | None) -> DataFrame:
    rows = resolve(nodes, symbols, by_simple_name)
    score = node_score(F.col("sites"), F.col("kind"), F.col("name"), F.col("qualified"), terms)
    cost = F.floor((F.octet_length("qualified") + F.col("site_bytes") + 32) / 4)
    rows = rows.withColumn("score", score).withColumn("cost", cost)
    if budget:
        rows = within_budget(rows, "cost", [F.desc("score"), F.col("key")], budget, LEAST_COST).drop("pos", "used")
    return rows


def callers(calls: DataFrame, symbols: DataFrame, name: str, terms: list[str] = [], budget: int | None = None) -> DataFrame:
    """Who calls ``name``: a scored node per caller. No budget (or 0) keeps all."""
    return _ranked(groups(calls.filter((F.col("callee_name") == name) & F.col("caller_qualified").isNotNull()), "caller_qualified"), symbols, True, terms, budget)


def callees(calls: DataFrame, symbols: DataFrame, qualified: str, terms: list[str] = [], budget: int | None = None) -> DataFrame:
    """What ``qualified`` calls: a scored node per callee name."""
    return _ranked(groups(calls.filter((F.col("caller_qualified") == qualified) & F.col("callee_name").isNotNull()), "callee_name"), symbols, False, terms, budget)


def node(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name") == name)


def totals(calls: DataFrame, condition: Column, by: str, kept: DataFrame) -> DataFrame:
    """One row: total_found (call sites that meet ``condition``), nodes (of ``kept``), truncated.

    Nodes are compared with call sites, so a node with several sites alone makes a result
    truncated, as does a budget that left a node out.
    """
    found = calls.filter(condition & F.col(by).isNotNull()).agg(F.count("*").alias("total_found"))
    out = kept.agg(F.count("*").alias("nodes")).withColumn("total_found", one_row(found)["total_found"])
    return out.select("total_found", "nodes", (F.col("nodes") < F.col("total_found")).alias("truncated"))


def with_sites(nodes: DataFrame, calls: DataFrame, by: str) -> DataFrame:
    """``site_list`` (file:line, sorted) of nodes kept under a budget, which bounds its bytes."""
    keys = nodes.select(F.col("key").alias(by)).dropDuplicates()
    site = F.concat_ws(":", "file", F.col("line").cast("string"))
    lists = calls.join(keys, by, "left_semi").groupBy(F.col(by).alias("key")).agg(F.sort_array(F.collect_list(site)).alias("site_list"))
    return nodes.join(lists, "key", "left")


def trace(calls: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """level, target, key, sites, site_bytes: callers of callers, level by level.

    A simple name is expanded once, at the level that first reaches it; a caller may be a
    node of several levels and targets. Frontier and visited names are cut to tables, so
    lineage doesn't grow with depth and nothing is collected.
    """
    spark: SparkSession = calls.sparkSession
    frontier = spark.createDataFrame([(name,)], "target string")
    visited, out = frontier, []
    site = F.concat_ws(":", "file", F.col("line").cast("string"))
    named = calls.filter(F.col("caller_qualified").isNotNull())
    for level in range(1, depth + 1):
        rows = named.join(frontier, named["callee_name"] == frontier["target"])
        nodes = cut(rows.groupBy("target", F.col("caller_qualified").alias("key")).agg(F.count("*").alias("sites"), F.sum(F.octet_length(site)).alias("site_bytes")))
        out.append(nodes.select(F.lit(level).alias("level"), "*"))
        if level < depth:
            reached = nodes.select(last_segment(F.col("key")).alias("target")).dropDuplicates()
            frontier = cut(reached.join(visited, "target", "left_anti"))
            visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, out)


def impact(calls: DataFrame, name: str, depth: int = 2) -> DataFrame:
    return trace(calls, name, depth)


def enclosing(definitions: DataFrame, sites: DataFrame) -> DataFrame:
    """As-of join: for each site the definition of its file with the greatest line up to the
    site's, the last by order on ties; else file::<top>.

    ``definitions``: file, line, ord, qualified. ``sites``: file, line and an id; file and
    line are not null. The union of both is range-partitioned by (file, line, ...) and
    sorted, so a file with a third of all sites, even on one line, is spread over many
    tasks. Each task carries the last definition along in vectorised steps and tells what
    it ends with: a row per task, from which sites before the first definition of their
    task take theirs. One shuffle; the sorted sites are written once.
    """
    a = definitions.select("file", F.col("line").cast("int").alias("line"), F.lit(0).alias("_site"), F.col("ord").cast("long").alias("id"), "qualified")
    b = sites.select("file", F.col("line").cast("int").alias("line"), F.lit(1).alias("_site"), F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("qualified"))
    order = ["file", "line", "_site", "id"]
    ranged = a.unionByName(b).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    out = cut(ranged.select("_part", *order, "qualified").mapInArrow(_carry, "part int, id long, file string, line int, qualified string, ends boolean"))
    later = Window.partitionBy("file").orderBy("part")
    ends = out.filter("ends").select("file", "part", F.last("qualified", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, 0)).alias("_carried"), F.lead("part").over(later).alias("_until"))
    ends = F.broadcast(ends.filter("_carried is not null").select(F.col("file").alias("_file"), F.col("part").alias("_from"), "_carried", "_until"))  # at most a row a task
    here = out.filter("not ends")
    on = (here["file"] == ends["_file"]) & here["qualified"].isNull() & (here["part"] > ends["_from"]) & (ends["_until"].isNull() | (here["part"] <= ends["_until"]))
    return here.join(ends, on, "left").select("id", "file", "line", F.coalesce("qualified", "_carried", F.concat("file", F.lit("::<top>"))).alias("caller_qualified"))


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sites of a sorted partition with the last definition of their file so far, if any, and
    a row for what the partition ends with."""
    names = ["part", "id", "file", "line", "qualified", "ends"]
    file = last = part = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        files, found = b.column("file").dictionary_encode(), b.column("qualified")
        codes, at = files.indices.to_numpy(), np.arange(n)
        fresh = np.concatenate([[True], codes[1:] != codes[:-1]])
        begins = np.maximum.accumulate(np.where(fresh, at, 0))
        site = b.column("_site").to_numpy() == 1
        latest = np.maximum.accumulate(np.where(site, -1, at))
        own = latest >= begins
        same = files.dictionary[int(codes[0])].as_py() == file  # the file that the batch before ended with
        names_of = pc.take(found, pa.array(latest, mask=~own))
        if same and last is not None:
            names_of = pc.if_else(pa.array((begins == 0) & ~own), pa.scalar(last, pa.string()), names_of)
        if not (same and begins[-1] == 0):
            last = None
        file, part = files.dictionary[int(codes[-1])].as_py(), b.column("_part")[n - 1].as_py()
        last = names_of[n - 1].as_py() if own[-1] else last
        keep = pa.array(np.flatnonzero(site))
        yield pa.RecordBatch.from_arrays([b.column("_part").take(keep), b.column("id").take(keep), b.column("file").take(keep), b.column("line").take(keep), names_of.take(keep), pa.array(np.zeros(len(keep), bool))], names)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([file]), pa.array([None], pa.int32()), pa.array([last], pa.string()), pa.array([True])], names)


DAMPING = 0.85


def _iterate(nodes: DataFrame, spread: Callable[[DataFrame], DataFrame], iterations: int, every: int, tolerance: float | None) -> DataFrame:
    """x' = d * incoming + d * (rank of nodes without edges) * p + (1 - d) * p until the L1 error is
    below ``tolerance`` a node.

    ``nodes``: node, p, loose (whether it has no edges), own (the part of its rank that
    ``spread`` counts back to itself, which is taken off). ``spread`` gives (node, y) of
    ranks (node, x).
    """
    count = nodes.count()
    total = nodes.agg(F.sum("p").alias("_sum"))
    ranks = cut(nodes.withColumn("_sum", one_row(total)["_sum"]).select("node", (F.col("p") / F.col("_sum")).alias("p"), "loose", "own", F.lit(1.0 / max(count, 1)).alias("x")))
    for i in range(1, iterations + 1):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("x"))), F.lit(0.0)).alias("_loose"))
        rows = ranks.join(spread(ranks.select("node", "x")), "node", "left").withColumn("_loose", one_row(loose)["_loose"])
        value = DAMPING * (F.coalesce("y", F.lit(0.0)) - F.col("x") * F.col("own")) + DAMPING * F.col("_loose") * F.col("p") + (1 - DAMPING) * F.col("p")
        new = rows.select("node", "p", "loose", "own", value.alias("x"))
        if i % every == 0 or i == iterations:
            new = cut(new)
            if tolerance is not None:
                old = ranks.select("node", F.col("x").alias("_x"))
                error = new.join(old, "node").agg(F.sum(F.abs(F.col("x") - F.col("_x")))).first()[0] or 0.0
                if error < count * tolerance:
                    ranks = new
                    break
        ranks = new
    return ranks.select("node", F.col("x").alias("rank"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 200, every: int = 3, tolerance: float | None = 1e-6) -> DataFrame:
    """Personalized PageRank: nodes (node, p), edges (src, dst, weight); multi-edges are weights.

    Starts at 1 / n, damping 0.85; rank of nodes without edges goes to the personalization.
    """
    outgoing = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("out"))
    shares = cut(edges.join(outgoing, F.col("src") == F.col("node")).select("node", "dst", (F.col("weight") / F.col("out")).alias("w")))
    known = nodes.join(outgoing, "node", "left").select("node", "p", F.col("out").isNull().alias("loose"), F.lit(0.0).alias("own"))

    def spread(ranks: DataFrame) -> DataFrame:
        return shares.join(ranks, "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("y"))

    return _iterate(known, spread, iterations, every, tolerance)


def file_edges(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(src, dst, weight) of files that mention names which other files define: all pairs, for small corpora."""
    r = refs.groupBy(F.col("file").alias("src"), "name").agg(F.count("*").alias("_r"))
    d = definitions.groupBy(F.col("file").alias("dst"), "name").agg(F.count("*").alias("_d"))
    return r.join(d, "name").filter("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("_r") * F.col("_d")).alias("weight"))


def file_rank(nodes: DataFrame, refs: DataFrame, definitions: DataFrame, iterations: int = 200, every: int = 3, tolerance: float | None = 1e-6) -> DataFrame:
    """PageRank over :func:`file_edges` without building them.

    A name that a third of all files mention would join every mention with every
    definition. Rank instead flows in two hops, file to name and name to file, over tables
    as long as refs and definitions; what a file would send to itself is taken off again.
    """
    r = cut(refs.filter("name is not null").groupBy(F.col("file").alias("node"), "name").agg(F.count("*").alias("r")))
    d = cut(definitions.filter("name is not null").groupBy(F.col("file").alias("node"), "name").agg(F.count("*").alias("d")))
    names = d.groupBy("name").agg(F.sum("d").alias("all_d"))
    own = r.join(d, ["node", "name"]).groupBy("node").agg(F.sum(F.col("r") * F.col("d")).alias("own"))
    reach = r.join(names, "name").groupBy("node").agg(F.sum(F.col("r") * F.col("all_d")).alias("reach"))
    sent = reach.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    outgoing = cut(sent.select("node", "own", (F.col("reach") - F.col("own")).alias("out")).filter("out > 0"))
    shares = cut(r.join(outgoing, "node").select("node", "name", (F.col("r") / F.col("out")).alias("w")))
    known = nodes.join(outgoing, "node", "left").select("node", "p", F.col("out").isNull().alias("loose"), F.coalesce(F.col("own") / F.col("out"), F.lit(0.0)).alias("own"))

    def spread(ranks: DataFrame) -> DataFrame:
        through = shares.join(ranks, "node").groupBy("name").agg(F.sum(F.col("x") * F.col("w")).alias("_t"))
        return d.join(through, "name").groupBy("node").agg(F.sum(F.col("_t") * F.col("d")).alias("y"))

    return _iterate(known, spread, iterations, every, tolerance)


def personalization(files: DataFrame, path: str, best: list[str] = [], seeds: list[str] = []) -> DataFrame:
    """(node, p): 1, at least 10 for the first five by BM25, at least 50 below a seed folder."""
    p = F.lit(1.0)
    if best:
        p = F.when(F.col(path).isin(best[:5]), 10.0).otherwise(p)
    for s in seeds:
        folder = s.rstrip("/")
        p = F.when((F.col(path) == folder) | F.col(path).startswith(folder + "/"), F.greatest(p, F.lit(50.0))).otherwise(p)
    return files.select(F.col(path).alias("node"), p.alias("p"))
