"""Repository maps: ranked files with their signatures, within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.operators import extract, graph, lexical
from lodestone.operators.fusion import within_budget

FRAME = 23  #: bytes of the opening and closing lines
PER_FILE = 11  #: bytes a file has besides its path and signatures
LEAST = 2  #: tokens of the smallest file entry


#: Stories and tests get a part of their score.
AUXILIARY, AUXILIARY_WEIGHT = r"\.stories\.(tsx|ts|js|jsx)$|\.(spec|test)\.tsx?$", 0.3


def corpus(documents: DataFrame) -> DataFrame:
    """path, sigs, refs of the files that have signatures; parsed once."""
    return cut(extract.signatures(documents).filter(F.size("sigs") > 0))


def by_words(files: DataFrame, query: str) -> DataFrame:
    """path, sigs, score: every file by BM25 of its path and signatures; without a common word, 0."""
    rows = files.select(F.struct("path", "sigs").alias("file"), F.concat_ws(" ", "path", F.array_join("sigs", " ")).alias("text"))
    weight = F.when(F.col("file.path").rlike(AUXILIARY), AUXILIARY_WEIGHT).otherwise(1.0)
    return lexical.bm25(rows, "file", {"q": query}, weight=weight, include_zero=True).select("file.*", F.round("score", 9).alias("score"))


def symbol(signature: Column) -> Column:
    """The last word without what follows its last letter or digit."""
    return F.regexp_replace(F.element_at(F.split(F.trim(signature), r"\s+"), -1), r"[^\p{IsAlphabetic}\p{N}]+$", "")


def by_graph(files: DataFrame, query: str, seeds: list[str]) -> DataFrame:
    """path, sigs, score: every file by converged PageRank from those that refer to a symbol to
    those that define it, personalized by the five best by words and by the seed folders."""
    best = [r.path for r in by_words(files, query).orderBy(F.desc("score"), "path").limit(5).collect()]
    nodes = graph.personalization(files.select("path").dropDuplicates(), "path", best, seeds)
    refs = files.select(F.col("path").alias("file"), F.explode("refs").alias("name"))
    defs = files.select(F.col("path").alias("file"), F.explode("sigs").alias("sig")).select("file", symbol(F.col("sig")).alias("name")).filter("name <> ''")
    ranks = graph.file_rank(nodes, refs, defs).select(F.col("node").alias("path"), F.round("rank", 12).alias("score"))
    return files.join(ranks, "path").select("path", "sigs", "score")


def entry_bytes(path: Column, signatures: Column) -> Column:
    """Bytes of a file's entry in the text form."""
    return (F.octet_length(path) + PER_FILE + F.aggregate(signatures, F.lit(0), lambda s, x: s + F.octet_length(x) + 4)).cast("long")


def fit(files: DataFrame, max_tokens: int) -> DataFrame:
    """Best files (path, score, sigs) whose map has at most ``max_tokens`` quarter-bytes; at least one.

    ``pos`` and ``used`` (bytes of all entries so far) are added. Only as many files are
    sorted as could fit at all.
    """
    rows = files.withColumn("bytes", entry_bytes(F.col("path"), F.col("sigs")))
    return within_budget(rows, "bytes", [F.desc("score"), F.col("path")], 4 * max_tokens + 3 - FRAME, PER_FILE, at_least=1)


def _ordered(fitted: DataFrame, item: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("t")))), lambda x: x["t"])


def text_map(fitted: DataFrame) -> DataFrame:
    """One row: the map as text. The budget bounds what is gathered."""
    body = F.concat(F.lit("\n"), F.col("path"), F.lit(":\n⋮\n"), F.array_join(F.transform("sigs", lambda s: F.concat(F.lit("│"), s, F.lit("\n"))), ""), F.lit("⋮\n"))
    return fitted.agg(F.concat(F.lit("<repo_map>\n"), F.array_join(_ordered(fitted, body), ""), F.lit("\n</repo_map>")).alias("repo_map"))


def json_map(fitted: DataFrame) -> DataFrame:
    """One row: a JSON array of path, score (four digits), signatures."""
    entry = F.struct("path", F.round("score", 4).alias("score"), F.col("sigs").alias("signatures"))
    return fitted.agg(F.to_json(_ordered(fitted, entry), {"pretty": "true"}).alias("repo_map"))
