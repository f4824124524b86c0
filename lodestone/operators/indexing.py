"""Indexing documents: what changed, orphans, byte chunks, health, path contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.common import at_most
from lodestone.functions.text import doc_title, embed_input

KEY = ["collection", "path"]
FEW_CONTEXTS = 10000  #: contexts that are broadcast, at most
SALTS = 16
SIZE, OVERLAP = 1000, 0.15


def diff(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    """collection, path, status (new, changed, same, deleted) of two tables with content_hash."""
    a = discovered.select(*KEY, F.col("content_hash").alias("_now"), F.lit(True).alias("_a"))
    b = indexed.select(*KEY, F.col("content_hash").alias("_was"), F.lit(True).alias("_b"))
    same = F.col("_now").eqNullSafe(F.col("_was"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(same, "same").otherwise("changed")
    return a.join(b, KEY, "full_outer").select(*KEY, status.alias("status"))


def stats(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row of an index run: scanned, errors (no text), skipped (hash unchanged), indexed."""
    rows = discovered.select(*KEY, F.col("text").isNull().alias("_bad"), "content_hash").join(indexed.select(*KEY, F.col("content_hash").alias("_was"), F.lit(True).alias("_known")), KEY, "left")
    same = F.col("_known").isNotNull() & F.col("content_hash").eqNullSafe(F.col("_was"))
    return rows.agg(F.count("*").alias("scanned"), F.count_if("_bad").alias("errors"), F.count_if(~F.col("_bad") & same).alias("skipped"), F.count_if(~F.col("_bad") & ~same).alias("indexed"))


def orphans(indexed: DataFrame, current_paths: DataFrame) -> DataFrame:
    """Indexed documents whose path is no longer there."""
    return indexed.join(current_paths.select(*KEY), KEY, "left_anti")


def without_orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document exists: the rewrite that stands for a cascading delete."""
    return chunks.join(documents.select("doc_id"), "doc_id", "left_semi")


def status(c: Column) -> Column:
    """done or pending; unknown values are pending."""
    return F.when(c == "done", "done").otherwise("pending")


def health(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """collection, total_documents, pending_embeddings, last_indexed, consistent."""
    per_document = chunks.groupBy("doc_id").agg(F.count_if(status(F.col("status")) == "pending").alias("_pending"))
    rows = documents.select("doc_id", "collection", "indexed_at").join(per_document, "doc_id", "left")
    out = rows.groupBy("collection").agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("_pending"), F.lit(0)).alias("pending_embeddings"), F.max("indexed_at").alias("last_indexed"))
    return out.withColumn("consistent", F.col("pending_embeddings") == 0)


def pending(chunks: DataFrame, documents: DataFrame, collection: str, batch: int) -> DataFrame:
    """The next ``batch`` chunks of a collection to embed, by id."""
    mine = documents.filter(F.col("collection") == collection).select("doc_id", "path")
    return chunks.filter(status(F.col("status")) == "pending").join(mine, "doc_id").orderBy("id").limit(batch)


def path_context(rows: DataFrame, contexts: DataFrame, few: int = FEW_CONTEXTS) -> DataFrame:
    """``context``: description of the longest prefix of ``path`` in its collection, ties by
    priority, then description; null where none fits.

    Prefixes join by equality: each path offers its own prefixes of the lengths that its
    collection's contexts have, so no row meets every context. Contexts are counted, up to
    ``few`` of them: that many are broadcast as a map per collection, and no row moves. More are
    joined by shuffles in which every context stands SALTS times, as one collection or prefix
    may hold most of the rows.
    """
    best = contexts.filter("collection is not null and path_prefix is not null").groupBy("collection", "path_prefix").agg(F.max(F.struct("priority", "description"))["description"].alias("context"))
    if at_most(best, few):
        known = best.groupBy("collection").agg(F.map_from_entries(F.collect_list(F.struct("path_prefix", "context"))).alias("_known"), F.reverse(F.array_sort(F.collect_set(F.length("path_prefix")))).alias("_lengths"))
        joined = rows.join(F.broadcast(known), "collection", "left")
        hits = F.filter(F.transform("_lengths", lambda n: F.col("path").substr(F.lit(1), n)), lambda p: F.map_contains_key("_known", p))
        longest = F.when(F.col("path").isNotNull(), F.get(hits, 0))
        return joined.withColumn("context", F.try_element_at("_known", longest)).select(*rows.columns, "context")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    lengths = best.groupBy("collection").agg(F.array_sort(F.collect_set(F.length("path_prefix"))).alias("_lengths")).select("*", salts)
    offered = rows.select(*KEY).dropDuplicates().withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    offered = offered.join(lengths, ["collection", "_salt"]).select(*KEY, "_salt", F.explode("_lengths").alias("_n")).filter(F.col("_n") <= F.length("path"))
    offered = offered.withColumn("path_prefix", F.col("path").substr(F.lit(1), F.col("_n")))
    found = offered.join(best.select("*", salts), ["collection", "path_prefix", "_salt"]).groupBy(*KEY).agg(F.max_by("context", "_n").alias("context"))
    return rows.join(found, KEY, "left")


def embed_pending(chunks: DataFrame, documents: DataFrame, collection: str, batch: int, embed: Callable[[list[str]], list[list[float]]], together: int = 32) -> DataFrame:
    """id, embedding, status of the next ``batch`` pending chunks of a collection, embedded.

    ``embed`` is the model: a function of the worker from some texts (the document's title,
    an empty line, the chunk) to their vectors; it is called with ``together`` texts at a
    time, so that a client lives as long as its partition's task. A null content is
    embedded by its title alone. Write the rows back by :func:`lodestone.sources.tables.upsert`.
    """
    todo = pending(chunks, documents, collection, batch)
    rows = todo.select("id", embed_input(doc_title(F.col("path")), F.coalesce("content", F.lit(""))).alias("input"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            vectors = [v for i in range(0, len(texts), together) for v in embed(texts[i : i + together])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(["done"] * len(texts))], ["id", "embedding", "status"])

    return rows.mapInArrow(work, "id long, embedding array<float>, status string")


def byte_pieces(data: bytes, size: int = SIZE, overlap: float = OVERLAP) -> list[tuple[int, bytes]]:
    """(start, trimmed content): plain slices at character boundaries, each ``overlap`` of the slice back."""
    out, at = [], 0
    while at < len(data):
        end = _floor(data, min(at + size, len(data)))
        content = data[at:end].decode("utf-8", "replace").strip().encode()
        if content:
            out.append((at, content))
        if end >= len(data):
            break
        back = _floor(data, end - int((end - at) * overlap))
        at = back if back > at else end
    return out


def _floor(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def byte_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: float = OVERLAP) -> DataFrame:
    """(key, start_offset, content) of every text, in Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [(i, s, c) for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()) if t for s, c in byte_pieces(t, size, overlap)]
            rows, starts, contents = zip(*flat) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(contents, pa.binary()).cast(pa.string())], [key, "start_offset", "content"])

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(work, f"`{key}` {kind}, start_offset long, content string")


def ascii_offsets(text: Column, size: int = SIZE, step: int = 850) -> Column:
    """Offsets of the pieces of an ASCII text in closed form."""
    n = F.octet_length(text)
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(float(step)))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * step).cast("long")))
