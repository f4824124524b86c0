"""Catalog of document collections: one object over scans, incremental indexing, embedding,
search, health and compaction, with its tables in one folder.

Documents and chunks are partitioned by collection; an index run replaces the partition of
its own collection by dynamic partition overwrite and leaves all others alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.functions.text import content_hash
from lodestone.operators import indexing
from lodestone.operators.search import Searcher
from lodestone.sources import scan, tables

COLLECTIONS = "name string, sources array<string>, include array<string>, exclude array<string>, last_indexed timestamp"
CONTEXTS = "collection string, path_prefix string, description string, priority long"
DOCUMENTS = "doc_id long, path string, content_hash string, indexed_at timestamp, collection string"
CHUNKS = "id long, doc_id long, content string, start_offset long, embedding array<float>, status string, collection string"


class Catalog:
    """Collections below ``root``, a folder that all executors share. Unknown names raise KeyError."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        return tables.read_or_empty(self.spark, f"{self.root}/{name}", schema)

    def _replace_partition(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(f"{self.root}/{name}")

    def add(self, name: str, sources: list[str], include: list[str] = scan.DOCUMENT_GLOBS, exclude: list[str] = [], contexts: list[tuple[str, str, int]] = []) -> None:
        """Register a collection or change it; its contexts (prefix, description, priority) replace earlier ones."""
        one = self.spark.createDataFrame([(name, sources, include, exclude, None)], COLLECTIONS)
        tables.replace(tables.upsert(self._read("collections", COLLECTIONS), one, ["name"]), f"{self.root}/collections")
        new = self.spark.createDataFrame([(name, *c) for c in contexts], CONTEXTS)
        tables.replace(self._read("contexts", CONTEXTS).filter(F.col("collection") != name).unionByName(new), f"{self.root}/contexts")

    def names(self) -> list[str]:
        return [r.name for r in self._read("collections", COLLECTIONS).orderBy("name").collect()]

    def get(self, name: str) -> Row:
        row = self._read("collections", COLLECTIONS).filter(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return row

    def documents(self, name: str) -> DataFrame:
        return self._read("documents", DOCUMENTS).filter(F.col("collection") == name)

    def chunks(self, name: str) -> DataFrame:
        return self._read("chunks", CHUNKS).filter(F.col("collection") == name)

    def index(self, name: str) -> Row:
        """Scan the sources and index what is new or changed; what is gone is removed with its
        chunks. Returns scanned, errors, skipped, indexed. Chunks of unchanged documents keep
        their embeddings."""
        own = self.get(name)
        found = [scan.read_documents(self.spark, s, own.include, own.exclude) for s in own.sources]
        texts = found[0]
        for more in found[1:]:
            texts = texts.unionByName(more)
        texts = texts.select(F.lit(name).alias("collection"), "path", F.col("content").alias("text")).dropDuplicates(["path"])
        now = cut(texts.withColumn("content_hash", content_hash(F.col("text"))).withColumn("doc_id", F.xxhash64("collection", "path")))
        old, chunks = self.documents(name), self.chunks(name)
        stats = indexing.stats(now, old).first()
        diff = indexing.diff(now, old)
        same = old.join(diff.filter("status = 'same'").select("path"), "path", "left_semi")
        todo = now.join(diff.filter("status in ('new', 'changed')").select("path"), "path", "left_semi")
        fresh = todo.select("doc_id", "path", "content_hash", F.current_timestamp().alias("indexed_at"), "collection")
        cuts = indexing.byte_chunks(todo).select(F.xxhash64("doc_id", "start_offset", "content").alias("id"), "doc_id", "content", "start_offset", F.lit(None).cast("array<float>").alias("embedding"), F.lit("pending").alias("status"), F.lit(name).alias("collection"))
        kept = chunks.join(same.select("doc_id"), "doc_id", "left_semi").select(cuts.columns)
        # chunks first: if the run dies between both, the documents still differ and are indexed again
        self._replace_partition(kept.unionByName(cuts), "chunks")
        self._replace_partition(cut(same.select(fresh.columns)).unionByName(fresh), "documents")
        stamp = self._read("collections", COLLECTIONS).withColumn("last_indexed", F.when(F.col("name") == name, F.current_timestamp()).otherwise(F.col("last_indexed")))
        tables.replace(stamp, f"{self.root}/collections")
        return stats

    def bootstrap(self, path: str, name: str | None = None) -> Row:
        """Register a folder under its own name, with the default patterns, and index it."""
        name = name or path.rstrip("/").rsplit("/", 1)[-1]
        self.add(name, [path])
        return self.index(name)

    def embed(self, name: str, batch: int, model: Callable[[list[str]], list[list[float]]]) -> int:
        """Embed the next ``batch`` pending chunks; returns how many there were."""
        self.get(name)
        chunks = self.chunks(name)
        done = cut(indexing.embed_pending(chunks, self.documents(name), name, batch, model))
        n = done.count()
        if n:
            new = chunks.drop("embedding", "status").join(F.broadcast(done), "id").select(chunks.columns)  # at most ``batch`` rows
            self._replace_partition(tables.upsert(chunks, new, ["id"]).select(chunks.columns), "chunks")
        return n

    def search(self, name: str, query: str, k: int = 10, **models: object) -> DataFrame:
        """Results of :class:`~lodestone.operators.search.Searcher`; ``models`` are its functions."""
        self.get(name)
        return Searcher(self.documents(name), self.chunks(name), contexts=self._read("contexts", CONTEXTS), **models).search(query, k)

    def health(self, name: str) -> Row | None:
        self.get(name)
        return indexing.health(self.documents(name), self.chunks(name)).first()

    def compact(self, name: str) -> None:
        """Rewrite a collection's chunks without those of missing documents, in few files."""
        self.get(name)
        self._replace_partition(indexing.without_orphans(self.chunks(name), self.documents(name)).select(F.expr("*")).coalesce(8), "chunks")
