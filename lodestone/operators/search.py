"""Searches over chunks: lexical, by vector, and hybrid with re-ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import fusion, vectors
from lodestone.operators.lexical import bm25, bm25_wide, query_terms

MODES = ("exact", "conceptual", "expanded")
SCORE_DIGITS = 9  #: of lexical and vector scores, so that equal scores tie however they were summed


def parse(query: str) -> tuple[str, str]:
    """Mode and text of a query; behind a mode's prefix the text is lower case."""
    text = query.strip()
    mode, sep, rest = text.partition(":")
    if sep and mode.lower() in MODES:
        return mode.lower(), rest.strip().lower()
    return "auto", text


def lexical_judge(query: str) -> Column:
    """Stand-in for a model's judgement: the first 500 characters hold a term of the query."""
    terms = query_terms(query)
    head = F.lower(F.substring("content", 1, 500))
    return F.coalesce(F.arrays_overlap(F.split(head, "[^a-z0-9]+"), F.array(*[F.lit(t) for t in terms])), F.lit(False)) if terms else F.lit(False)


@dataclass
class Searcher:
    """Searches ``chunks`` (id, doc_id, content, embedding) of ``documents`` (doc_id, collection, path).

    ``embed`` gives a query's vector, ``variants`` up to three other wordings,
    ``hypothesis`` a paragraph that might answer it, ``judge`` a boolean Column over
    ``content``. All are replaceable; without them a search does without that step.
    Lexical search covers every chunk, embedded or not.
    """

    documents: DataFrame
    chunks: DataFrame
    embed: Callable[[str], list[float]] | None = None
    variants: Callable[[str], list[str]] = field(default=lambda q: [])
    hypothesis: Callable[[str], str] = field(default=lambda q: "")
    judge: Callable[[str], Column] | None = None
    contexts: DataFrame | None = None
    rerank_cap: int = 30

    def search(self, query: str, k: int = 10) -> DataFrame:
        mode, text = parse(query)
        if mode == "exact":
            return self.exact(text, k)
        if mode == "conceptual":
            return self.conceptual(text, k)
        if mode == "expanded":
            text = f"{text} {self.hypothesis(text)}".strip()
        return self.hybrid(text, k)

    def exact(self, text: str, k: int = 10) -> DataFrame:
        scored = bm25(self.chunks, "id", {"q": text}, "content", include_zero=True).select("id", "score")
        return self._results(fusion.top(scored, "id", 2 * k), k)

    def conceptual(self, text: str, k: int = 10) -> DataFrame:
        scored = vectors.score_all(self.chunks, "id", "embedding", {"q": self.embed(text)}).select("id", "score")
        return self._results(fusion.top(scored, "id", 2 * k), k)

    def hybrid(self, text: str, k: int = 10) -> DataFrame:
        """Lists of BM25 and cosine for the query (weight 2) and its variants, fused, cut to
        30, judged, normalized, best chunk per document, k best."""
        others = [v.strip() for v in self.variants(text)]
        wordings = {"q": text} | {f"v{i}": v for i, v in enumerate([v for v in others if v and v != text][:3])}
        near = {f"e_{n}": vectors.cosine_to(F.col("embedding"), self.embed(t)) for n, t in wordings.items()} if self.embed is not None else {}
        words = {f"b_{n}": t for n, t in wordings.items()}
        wide = bm25_wide(self.chunks, "id", words, "content", keep=near)
        weights = {n: 2.0 if n.endswith("_q") else 1.0 for n in (*words, *near)}
        wide = wide.select("id", *[F.round(n, SCORE_DIGITS).alias(n) for n in weights])
        fused = fusion.top_fused(wide, "id", weights, self.rerank_cap)
        if self.judge is not None:
            fused = rerank(fused, self.chunks, self.judge(text))
        return self._results(fusion.min_max(fused), k)

    def _results(self, scored: DataFrame, k: int) -> DataFrame:
        """doc_path, chunk_id, chunk_text, chunk_offset, score (and context), best first. ``scored`` holds at most a few rows."""
        rows = self.chunks.select("id", "doc_id", "content", "start_offset").join(F.broadcast(scored), "id").join(self.documents.select("doc_id", "collection", "path"), "doc_id")
        best = fusion.top(fusion.best_per(rows, "path", "id"), "id", k)
        if self.contexts is not None:
            from lodestone.operators.indexing import path_context

            best = path_context(best, self.contexts)
        else:
            best = best.withColumn("context", F.lit(None).cast("string"))
        return best.select(F.col("path").alias("doc_path"), F.col("id").alias("chunk_id"), F.col("content").alias("chunk_text"), F.col("start_offset").alias("chunk_offset"), "score", "context")


def rerank(candidates: DataFrame, chunks: DataFrame, relevant: Column, boost: float = 1.5) -> DataFrame:
    """Relevant candidates only, scores raised; candidates without a chunk are dropped."""
    rows = chunks.select("id", "content").join(F.broadcast(candidates), "id")  # at most the re-ranking cap
    return rows.filter(relevant).select("id", (F.col("score") * boost).alias("score"))


def preview(results: DataFrame, full: bool = False) -> DataFrame:
    """(n, text) of each result, best first: number, score and path, its context if there is one, and
    the first 200 characters without line ends, or with ``full`` the whole chunk, indented."""
    n = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # k rows
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.format_string("%.4f", "score"), F.lit(" — "), F.col("doc_path"))
    about = F.coalesce(F.concat(F.lit("\n    Contexto: "), F.col("context")), F.lit(""))
    if full:
        body = F.concat(F.lit("\n    Fragmento (offset "), F.col("chunk_offset").cast("string"), F.lit("):\n    "), F.replace("chunk_text", F.lit("\n"), F.lit("\n    ")))
    else:
        more = F.when(F.octet_length("chunk_text") > 200, "…").otherwise("")
        body = F.concat(F.lit("\n    "), F.translate(F.substring("chunk_text", 1, 200), "\n", " "), more)
    return results.select(n.alias("n"), F.concat(head, about, body).alias("text"))
