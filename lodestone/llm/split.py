"""Splitting oversized items at natural boundaries (problem 5).

Sizes and offsets are bytes of UTF-8. A span that is too large is cut after the coarsest
separator it contains (section, paragraph, line, sentence, word, at last character); spans
are then packed greedily into pieces, each of which starts with the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1000, 0.15
SPACE = " \t\r\n"
#: Ends of spans, from coarse to fine. Code fences and headings open a section.
SEPARATORS = [re.compile(p) for p in (rb"\n(?=#{1,6} |```)", rb"\n[ \t\r]*\n\s*", rb"\n", rb"[.!?;:]\s+|\xe3\x80\x82", rb"\s+")]


def _character_end(data: bytes, at: int) -> int:
    """The last character boundary up to ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _spans(data: bytes, size: int) -> Iterator[int]:
    """Ends of consecutive spans of at most ``size`` bytes that cover ``data``."""
    work = [(0, len(data), 0)]
    while work:
        start, end, level = work.pop()
        if end - start <= size:
            if end > start:
                yield end
            continue
        if level == len(SEPARATORS):
            while end - start > size:
                cut = _character_end(data, start + size)
                start = cut if cut > start else start + size
                yield start
            if end > start:
                yield end
            continue
        ends = [m.end() for m in SEPARATORS[level].finditer(data, start, end) if m.end() < end]
        bounds = [start, *ends, end]
        work += [(a, b, level + 1) for a, b in reversed(list(zip(bounds, bounds[1:])))]


def pieces(data: bytes, limit: int = LIMIT, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``data``: none longer than ``limit``, each but the
    first starting within the one before, about ``overlap`` of it back and at a word where
    there is one. Together they cover every byte. Empty data has no pieces.
    """
    if len(data) <= limit:
        return [(0, len(data))] if data else []
    size = max(4, limit - int(limit * overlap))
    out: list[tuple[int, int]] = []
    start = end = 0
    for to in _spans(data, size):
        if to - start > limit:
            out.append((start, end))
            back = max(start + 1, end - int((end - start) * overlap), to - limit)
            back = min(back, end)
            word = next((m.end() for m in re.finditer(rb"\s+", data[back:end])), None)
            if word is not None and back + word < end:
                start = back + word
            else:
                start = _character_end(data, back)
                if to - start > limit:
                    start = min(end, _next_character(data, back))
        end = to
    out.append((start, end))
    return out


def _next_character(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def split_texts(df: DataFrame, key: list[str], text: str, limit: int = LIMIT, overlap: float = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """Pieces of every text: key columns, piece (0, 1, ...), start_offset, content.

    Offsets are bytes into the text. Null and empty texts have no pieces; texts within the
    limit are one piece (or left out, with ``only_oversized``). No shuffle; each text is
    cut in time proportional to its length.
    """
    chosen = df.filter(F.octet_length(text) > (limit if only_oversized else 0)).select(*key, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", piece int, start_offset long, content string"

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, number, starts, contents = [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()):
                for k, (s, e) in enumerate(pieces(t, limit, overlap)):
                    rows.append(i)
                    number.append(k)
                    starts.append(s)
                    contents.append(t[s:e])
            keys = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(contents, pa.binary()).cast(pa.string())], [*b.schema.names[:-1], "piece", "start_offset", "content"])

    return chosen.mapInArrow(cut_all, schema)


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id of every chunk that :func:`split_texts` has to cut, white space at its end left aside."""
    kept = chunks.select(F.col("id").alias("chunk_id"), F.rtrim(F.col("content"), F.lit(SPACE)).alias("content"))
    return split_texts(kept, ["chunk_id"], "content", limit, only_oversized=True).filter("piece = 1").select("chunk_id")


def defects(chunks: DataFrame, documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id, defect of stored chunks that the splitter would never give.

    ``oversized``: it would be cut again. ``misplaced``: the document doesn't have the
    content at start_offset (also if the document, its text or the offset is missing or
    the offset negative). ``gap``: between the furthest end of all chunks that start
    before it and its own start the document has more than white space. A chunk with null
    content has no defect and no end. White space at the end of contents is ignored.

    The text of a document travels once, of a chunk only its length and two hashes.
    Repeated chunks collapse before they meet the text and before the running maximum.
    """
    content = F.rtrim(F.col("content"), F.lit(SPACE))
    one, two = F.xxhash64(F.encode(content, "UTF-8")), F.xxhash64(F.lit(1), F.encode(content, "UTF-8"))
    piece = ["doc_id", "start", "size", "hash_a", "hash_b"]
    small = chunks.filter("content is not null").select(F.col("id").alias("chunk_id"), "doc_id", F.col("start_offset").alias("start"), F.octet_length(content).cast("long").alias("size"), one.alias("hash_a"), two.alias("hash_b"))
    texts = documents.select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    distinct = small.dropDuplicates(piece).select(piece)
    starts = distinct.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = starts.select("doc_id", "start", F.greatest(F.max("end").over(before), F.lit(0)).alias("reached"))
    rows = distinct.join(reach, ["doc_id", "start"], "left").join(texts, "doc_id", "left")

    def part(at: Column, n: Column) -> Column:
        inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(2**31 - 2)).cast("int")
        return F.col("bytes").substr(inside(at) + 1, inside(n))

    start, size, reached = F.col("start"), F.col("size"), F.coalesce("reached", F.lit(0))
    between = F.rtrim(F.decode(part(reached, start - reached), "ISO-8859-1"), F.lit(SPACE))
    gap = F.coalesce((start > reached) & (between != ""), F.lit(False))
    own = part(start, size)
    there = F.coalesce((start >= 0) & (F.length("bytes") >= start + size) & (F.xxhash64(own) == F.col("hash_a")) & (F.xxhash64(F.lit(1), own) == F.col("hash_b")), F.lit(False))
    kinds = F.filter(F.array(F.when(~there, F.lit("misplaced")), F.when(gap, F.lit("gap"))), lambda d: d.isNotNull())
    wrong = rows.select(*[F.col(c).alias(f"_{c}") for c in piece], kinds.alias("kinds")).filter(F.size("kinds") > 0)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in piece]
    found = small.join(wrong, on).select("chunk_id", F.explode("kinds").alias("defect"))
    return found.unionByName(oversized(chunks, limit).select("chunk_id", F.lit("oversized").alias("defect")))
