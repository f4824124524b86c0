"""Most similar vectors for every vector (problem 1): sharded vantage-point trees.

Vectors are scaled to length one; equal ones form a class that is searched once. Every
node of a tree has several vantage points, and a vector belongs to the nearest of them. On
the unit sphere the cosine is a function of the Euclidean distance d, for which the
triangle inequality holds: a vector x that is nearer to vantage point p than to p' has
d(q, x) >= (d(q, p) - d(q, p')) / 2 for every query q. So a branch can hold something
within r of a query only if its vantage point is at most 2 r farther from the query than
the nearest one. Exact search must take these branches; here r is divided by ``factor``.
Factor one restores exact search; a larger one prunes more and loses few, as in many
dimensions the bound is rarely reached. (Nodes with one vantage point, which part inside
from outside at a median distance, prune next to nothing in 64 dimensions: at the recall
asked for they took as long as comparing all. With several, a tenth of the pairs is left.)

The top of the tree, fitted on a bounded sample, cuts the space into shards. A vector is
stored in its home shard and sent as a query to every shard within its bound; each shard
builds its own tree and compares leaves by matrix products. In a self-join a pair is
searched from both ends and lost only if both fail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut

SHARD = 32768  #: vectors of a shard, about
PER_SHARD = 16  #: vectors of the sample for each shard
SAMPLE = 1 << 20  #: vectors of the sample, at most; beyond SAMPLE / PER_SHARD shards these grow
FAN = 64  #: vantage points of a node, at most
LEAF = 1024  #: vectors of a leaf within a shard, about
NEAR = 256  #: vectors of the sample that give each query a first bound for its k-th neighbour
BLOCK = 4096  #: queries compared at once
HALF, FULL = np.float16, np.float32  #: precision of stored vectors; half moves a cosine by less than 3e-4


def _unit(batch: pa.RecordBatch, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the usable embeddings of a batch."""
    lists = batch.column(1)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((sizes == dim) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(flat).all(1) & (flat != 0).any(1)
    rows, flat = rows[good], flat[good]
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return rows, (flat / np.linalg.norm(flat, axis=1, keepdims=True) + 0.0).astype(kind) + kind(0)


def _binary(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * vectors.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors))]).cast(pa.binary())


def _floats(column: pa.ChunkedArray | pa.Array, dim: int, kind: type) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            data = np.frombuffer(c.buffers()[2], np.uint8)
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(data[offsets[0] : offsets[-1]].view(kind).astype(np.float32).reshape(-1, dim))
    return np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, kind: type = FULL) -> DataFrame:
    """(id, vec): usable rows only, that is ``dim`` finite values that aren't all zero."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, vectors = _unit(b, dim, kind)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _binary(vectors)], ["id", "vec"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("e")).mapInArrow(scale, "id long, vec binary")


def _distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (vectors @ points.T), 0))


class Tree:
    """Vantage points of the inner nodes, by depth-first number; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # points, and of each its node or, below 0, its leaf
        self.leaves = 0
        self.root = self._grow(sample, leaf, rng)

    def _grow(self, own: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(own) > leaf:
            count = min(FAN, -(-3 * len(own) // (2 * leaf)))
            points = own[np.sort(rng.choice(len(own), max(2, count), replace=False))]
            nearest = _distances(own, points).argmin(1)
            if np.bincount(nearest).max() < len(own):
                at = len(self.nodes)
                self.nodes.append((points, []))
                self.nodes[at][1].extend(self._grow(own[nearest == j], leaf, rng) for j in range(len(points)))
                return at
        self.leaves += 1
        return -self.leaves

    def route(self, vectors: np.ndarray, slack: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Leaf, rows that visit it, and whether it is each row's home. A row visits the leaves
        that can hold something within ``slack`` of it."""
        stack = [(self.root, np.arange(len(vectors)), np.ones(len(vectors), bool))]
        while stack:
            at, rows, home = stack.pop()
            if at < 0:
                yield -1 - at, rows, home
                continue
            points, children = self.nodes[at]
            parts: list[list] = [[] for _ in children]
            for i in range(0, len(rows), BLOCK):
                some, mine = rows[i : i + BLOCK], home[i : i + BLOCK]
                d = _distances(vectors[some], points)
                nearest = d.argmin(1)
                visited = d - d.min(1, keepdims=True) <= 2 * slack[some, None]
                for j in range(len(children)):
                    there = visited[:, j]
                    if there.any():
                        parts[j].append((some[there], (mine & (nearest == j))[there]))
            stack += [(child, *(np.concatenate(x) for x in zip(*part))) for child, part in zip(children, parts) if part]


def _leaves(data: np.ndarray, leaf: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree over ``data`` and the rows of each leaf."""
    tree = Tree(data, leaf, 11)
    own = [np.zeros(0, np.int64)] * tree.leaves
    for at, rows, home in tree.route(data, np.zeros(len(data), np.float32)):
        own[at] = rows[home]
    return tree, own


def range_pairs(data: np.ndarray, queries: np.ndarray, min_cos: float, factor: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, data row, cosine for all that the relaxed search finds at ``min_cos`` or more."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    tree, rows = _leaves(data, leaf)
    slack = np.full(len(queries), np.sqrt(2 - 2 * min_cos) / factor, np.float32)
    for at, ask, _ in tree.route(queries, slack):
        own = rows[at]
        for i in range(0, len(ask), BLOCK):
            for j in range(0, len(own), BLOCK):
                s = queries[ask[i : i + BLOCK]] @ data[own[j : j + BLOCK]].T
                a, b = np.nonzero(s >= min_cos)
                found.append((ask[i + a], own[j + b], s[a, b]))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(data: np.ndarray, queries: np.ndarray, k: int, slack: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and data rows of the k best of each query, best first; -1 where there are fewer.
    ``slack`` is a bound for the k-th distance of each query, divided by the factor."""
    best = np.full((len(queries), k), -2.0, np.float32)
    who = np.full((len(queries), k), -1, np.int64)
    tree, rows = _leaves(data, leaf)
    for at, ask, _ in tree.route(queries, slack):
        own = rows[at]
        for j in range(0, len(own), BLOCK):
            part = own[j : j + BLOCK]
            vectors = data[part]
            for i in range(0, len(ask), BLOCK):
                q = ask[i : i + BLOCK]
                s = queries[q] @ vectors.T
                better = np.flatnonzero(s.max(1) > best[q, k - 1])
                q, s = q[better], s[better]
                if s.shape[1] > k:
                    top = np.argpartition(s, -k, axis=1)[:, -k:]
                    s, names = np.take_along_axis(s, top, 1), part[top]
                else:
                    names = np.broadcast_to(part, s.shape)
                s, names = np.concatenate([best[q], s], 1), np.concatenate([who[q], names], 1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best[q], who[q] = np.take_along_axis(s, order, 1), np.take_along_axis(names, order, 1)
    return best, who


class Shards:
    """Classes of equal vectors, routed to shards; the frame that both searches work on."""

    def __init__(self, df: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int = 64, kind: type = FULL, shard: int = SHARD, per_shard: int = PER_SHARD, leaf: int = LEAF, asked: Column | None = None):
        self.dim, self.kind, self.leaf = dim, kind, leaf
        self.members = unit_vectors(df, id_col, vec_col, dim, kind)
        asked = F.lit(True) if asked is None else asked
        self.classes = self.members.groupBy("vec").agg(F.min("id").alias("rep"), F.bool_or(asked).alias("ask"))
        every = max(1, shard // per_shard, -(-df.count() // SAMPLE))  # rows are counted from the files' footers
        chosen = unit_vectors(df.filter(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0), id_col, vec_col, dim, HALF)
        fitted = [r.vec for r in chosen.select("vec").limit(2 * SAMPLE).collect()]
        sample = np.frombuffer(b"".join(bytes(x) for x in fitted), HALF).astype(np.float32).reshape(-1, dim)
        self.sample = np.unique(sample, axis=0)
        np.random.default_rng(5).shuffle(self.sample)
        self.tree = Tree(self.sample, per_shard)

    def visits(self, slack: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(shard, rep, vec, home, ask, slack): a class once at home, and as a query, if it is asked
        for, in every shard that can hold something within its slack."""
        dim, kind = self.dim, self.kind
        shipped = self.members.sparkSession.sparkContext.broadcast((self.tree, slack))  # a few points a shard

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, bound = shipped.value
            for b in batches:
                vectors, ask = _floats(b.column(1), dim, kind), b.column(2).to_numpy(zero_copy_only=False)
                within = np.where(ask, bound(vectors), np.float32(0))
                for shard, rows, home in tree.route(vectors, within):
                    rows, home = rows[home | ask[rows]], home[home | ask[rows]]
                    took = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), took.column(0), took.column(1), pa.array(home), took.column(2), pa.array(within[rows])], ["shard", "rep", "vec", "home", "ask", "slack"])

        return self.classes.select("rep", "vec", "ask").mapInArrow(assign, "shard int, rep long, vec binary, home boolean, ask boolean, slack float")

    def search(self, slack: Callable[[np.ndarray], np.ndarray], work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
        """Run ``work`` (home vectors, their ids, query vectors, their ids, slacks) in every shard."""
        dim, kind = self.dim, self.kind

        def shard(t: pa.Table) -> pa.Table:
            t = t.sort_by("rep")  # whatever order rows arrive in
            vectors, ids = _floats(t.column("vec"), dim, kind), t.column("rep").to_numpy()
            home, ask = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "ask"))
            return work(vectors[home], ids[home], vectors[ask], ids[ask], t.column("slack").to_numpy()[ask])

        return self.visits(slack).groupBy("shard").applyInArrow(shard, schema)

    def membership(self) -> DataFrame:
        """(id, rep, copies) of every usable row: its class, by two hashes of its vector."""
        one, two = F.xxhash64("vec").alias("_h1"), F.xxhash64(F.lit(1), F.col("vec")).alias("_h2")
        hashed = self.members.select("id", one, two)
        classes = hashed.groupBy("_h1", "_h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        return hashed.join(classes, ["_h1", "_h2"]).select("id", "rep", "copies")


class Within:
    """A fixed slack for every query."""

    def __init__(self, distance: float):
        self.distance = distance

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return np.full(len(vectors), self.distance, np.float32)


class Kth:
    """A bound for the distance to the k-th other vector, divided by the factor: the (k + 1)-th
    distance to some vectors of the collection, of which one may be the query itself."""

    def __init__(self, some: np.ndarray, k: int, factor: float):
        self.some, self.k, self.factor = some, k, factor

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        if len(self.some) <= self.k:
            return np.full(len(vectors), 2.0 / self.factor, np.float32)
        parts = [np.partition(_distances(vectors[i : i + BLOCK], self.some), self.k, axis=1)[:, self.k] for i in range(0, len(vectors), BLOCK)]
        return (np.concatenate(parts) if parts else np.zeros(0)).astype(np.float32) / np.float32(self.factor)


def similar_classes(df: DataFrame, min_cos: float, factor: float = 12.0, id_col: str = "id", vec_col: str = "embedding", dim: int = 64, kind: type = HALF, **shape: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal vectors (id, rep, copies: a row per usable row of ``df``) and the
    pairs of classes with a cosine of at least ``min_cos`` (rep_a < rep_b, cosine).

    ``rep`` is the smallest id of a class. Rows without a usable vector (null, another
    size, not finite, all zero) are in no class; an empty table has none. No class, however
    many copies it has, makes more than a row per copy. With ``kind`` HALF vectors and
    cosines are right to 3e-4, so ``min_cos`` should not lie so near to a cosine that
    matters; with FULL and factor one the result is exact.
    """
    shards = Shards(df, id_col, vec_col, dim, kind, **shape)
    leaf = shards.leaf

    def work(data, names, queries, ids, _):
        a, b, s = range_pairs(data, queries, min_cos, factor, leaf)
        x, y = ids[a], names[b]
        keep = x != y
        x, y, s = x[keep], y[keep], s[keep]
        return pa.table({"rep_a": np.minimum(x, y), "rep_b": np.maximum(x, y), "cosine": s.astype(np.float64)})

    slack = Within(float(np.sqrt(2 - 2 * min_cos)) / factor)
    links = shards.search(slack, work, "rep_a long, rep_b long, cosine double").groupBy("rep_a", "rep_b").agg(F.max("cosine").alias("cosine"))
    return shards.membership(), links


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of rows (id_a < id_b, cosine) of :func:`similar_classes`: every copy with every
    copy, and every copy of a class with every copy of each similar one.

    That is what a result per pair asks for, at any size; it is quadratic in the copies of
    one vector. Where a vector may be stored very often, use the classes instead.
    """
    several = members.filter("copies > 1")
    names = lambda rep, name: several.select(F.col("rep").alias(rep), F.col("id").alias(name))
    across = links.join(names("rep_a", "_a"), "rep_a", "left").join(names("rep_b", "_b"), "rep_b", "left")
    a, b = F.coalesce("_a", "rep_a"), F.coalesce("_b", "rep_b")
    across = across.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), "cosine")
    same = names("rep", "id_a").join(names("rep", "id_b"), "rep").filter("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("cosine"))
    return across.unionByName(same)


def similar_pairs(df: DataFrame, min_cos: float, **options) -> DataFrame:
    """:func:`similar_classes` expanded: all pairs of rows with a cosine of at least ``min_cos``."""
    members, links = similar_classes(df, min_cos, **options)
    return expand(cut(members.filter("copies > 1")), links)  # three numbers for every row that has a copy


def linked(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, rep, copies, links: a row per row, with its class and the number of similar classes."""
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def knn(df: DataFrame, k: int = 10, factor: float = 12.0, id_col: str = "id", vec_col: str = "embedding", dim: int = 64, kind: type = HALF, asked: Column | None = None, **shape: int) -> DataFrame:
    """The k most similar other rows of every usable row: id, rank, neighbour, cosine.

    ``asked`` (a condition on ``id``) restricts the rows that are searched for; those that
    are searched are always all.     Ties in cosine go to the smaller id. A class of copies is searched once; each copy's
    neighbours are first the other copies, then those of the nearest classes, so a class
    never needs more than k + 1 of its ids. Rows without a usable vector give and get
    nothing; fewer than k rows are given where there are fewer. With ``kind`` HALF cosines are
    right to 3e-4; with FULL and factor one the result is exact.
    """
    shards = Shards(df, id_col, vec_col, dim, kind, asked=asked, **shape)
    leaf = shards.leaf

    def work(data, names, queries, ids, slack):
        best, who = nearest(data, queries, k + 1, slack, leaf)
        own = np.concatenate([names, [-1]])[who] if len(names) else who
        size = (who >= 0).sum(1)
        keep = size > 0
        starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        valid = (who >= 0).ravel()
        hits = pa.StructArray.from_arrays([pa.array(own.ravel()[valid]), pa.array(best.ravel()[valid])], ["other", "cosine"])
        return pa.table({"rep": ids, "hits": pa.ListArray.from_arrays(pa.array(starts), hits)}).filter(pa.array(keep))

    hits = shards.search(Kth(shards.sample[:NEAR], k, factor), work, "rep long, hits array<struct<other: long, cosine: float>>")
    # a row a visited shard, of which a vector has a bounded number
    merged = hits.groupBy("rep").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    ranked = F.array_sort(F.transform(F.filter("hits", lambda h: h["other"] != F.col("rep")), lambda h: F.struct((-h["cosine"].cast("double")).alias("c"), h["other"].alias("other"))))
    classes = merged.select("rep", F.inline(F.slice(ranked, 1, k))).select("rep", "other", (-F.col("c")).alias("cosine"))
    members = cut(shards.membership())
    few = members.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("_r") <= k + 1).select(F.col("rep").alias("other"), F.col("id").alias("neighbour"))
    own = members.filter((F.col("id") == F.col("rep")) & (F.col("copies") > 1)).select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine"))
    offers = classes.unionByName(own).join(few, "other").groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), (F.col("rep") != F.col("other")).alias("away"), F.col("neighbour").alias("n")))), 1, k + 1).alias("offers"))
    each = (members if asked is None else members.filter(asked)).join(offers, "rep").select("id", F.slice(F.filter("offers", lambda o: o["n"] != F.col("id")), 1, k).alias("offers"))
    return each.select("id", F.posexplode("offers").alias("rank", "o")).select("id", (F.col("rank") + 1).alias("rank"), F.col("o.n").alias("neighbour"), F.round(-F.col("o.c"), 6).alias("cosine"))


def brute_force(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "embedding", dim: int = 64, block: int = BLOCK) -> DataFrame:
    """query, neighbour, cosine: the k most similar other rows of every row of ``queries``, by
    comparing it with all. One pass over ``df`` per ``block`` queries, which alone are
    held; each task gives its k best. For measuring the search."""
    spark = df.sparkSession
    asked = sorted((r.id, bytes(r.vec)) for r in unit_vectors(queries, id_col, vec_col, dim).toLocalIterator())
    out = None
    for i in range(0, max(len(asked), 1), block):
        names = np.array([x for x, _ in asked[i : i + block]], np.int64)
        vectors = np.frombuffer(b"".join(v for _, v in asked[i : i + block]), FULL).reshape(-1, dim)

        def compare(batches: Iterator[pa.RecordBatch], names=names, vectors=vectors) -> Iterator[pa.RecordBatch]:
            best = np.full((len(names), k), -2.0, np.float32)
            who = np.full((len(names), k), -1, np.int64)
            for b in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
                ids = b.column(0).to_numpy()
                s = vectors @ _floats(b.column(1), dim, FULL).T
                s[names[:, None] == ids[None, :]] = -3
                q = np.flatnonzero(s.max(1) > best.min(1))
                s, own = np.concatenate([best[q], s[q]], 1), np.concatenate([who[q], np.broadcast_to(ids, (len(q), len(ids)))], 1)
                order = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best[q], who[q] = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
            valid = (best > -2).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)[valid]), pa.array(who.ravel()[valid]), pa.array(best.ravel()[valid])], ["query", "neighbour", "cosine"])

        part = unit_vectors(df, id_col, vec_col, dim).mapInArrow(compare, "query long, neighbour long, cosine float")
        order = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
        part = part.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query long, neighbour long, cosine float")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, neighbours, hits, recall: what part of the exact neighbours was found. Ties at the
    last place may fall either way and then count as missed."""
    both = exact.join(found.select(F.col("id").alias("query"), "neighbour", F.lit(1).alias("_hit")), ["query", "neighbour"], "left")
    each = both.groupBy("query").agg(F.count("*").alias("_n"), F.count("_hit").alias("_hits"))
    totals = each.agg(F.count("*").alias("queries"), F.coalesce(F.sum("_n"), F.lit(0)).alias("neighbours"), F.coalesce(F.sum("_hits"), F.lit(0)).alias("hits"))
    return totals.withColumn("recall", F.when(F.col("neighbours") > 0, F.col("hits") / F.col("neighbours")))
