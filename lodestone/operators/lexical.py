"""Lexical ranking: corpus statistics and BM25 without a shuffle."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.common import one_row
from lodestone.functions.text import TOKEN, tokenize

K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, sorted."""
    return sorted({t.lower() for t in re.findall(TOKEN, query) if len(t) > 2})


def term_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(tokenize(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df); distinct terms are taken inside each row, so only partial counts move."""
    terms = docs.select(F.explode(F.array_distinct(tokenize(text))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n, avgdl): rows with a text, and their mean number of tokens."""
    return docs.filter(F.col(text).isNotNull()).select(F.size(tokenize(text)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_wide(docs: DataFrame, key: str, queries: dict[str, str], text: str = "text", weight: Column | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """key, the columns of ``keep``, and a column of BM25 scores (k1 1.5, b 0.75) for each query.

    The terms are known when the plan is made, so a first scan gives one row of counts
    and a second scores every row by itself: no shuffle but that one row, whatever the
    corpus. ``weight`` (from further columns of ``docs``) multiplies the score, as for
    test files. Documents without a text don't count and have null scores; a query
    without terms has null scores only.
    """
    terms = {q: query_terms(t) for q, t in queries.items()}
    every = sorted({t for own in terms.values() for t in own})
    keep = keep or {}
    none = [F.lit(None).cast("double").alias(q) for q in queries]
    if not every:
        return docs.select(key, *[v.alias(k) for k, v in keep.items()], *none)
    rows = docs.select(key, *[v.alias(k) for k, v in keep.items()], (weight if weight is not None else F.lit(1.0)).alias("_w"), F.col(text).isNotNull().alias("_there"), tokenize(text).alias("_tokens"))
    hits = rows.select(key, *keep, "_w", "_there", F.size("_tokens").alias("_dl"), F.filter("_tokens", lambda t: t.isin(every)).alias("_hits"))
    # filtered by the text alone: a condition on tokens would be pushed down and cut them again
    counts = hits.filter("_there").agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count_if(F.array_contains("_hits", t)).alias(f"_df_{i}") for i, t in enumerate(every)])
    both = hits.withColumn("_c", one_row(counts)).select("*", "_c.*")
    norm = K1 * (1 - B + B * F.col("_dl") / F.col("_avgdl"))

    def part(term: str) -> Column:
        tf = F.size(F.filter("_hits", lambda x: x == term)).cast("double")
        return idf(F.col("_n"), F.col(f"_df_{every.index(term)}")) * tf * (K1 + 1) / (tf + norm)

    any_hit = F.size("_hits") > 0
    score = lambda own: F.when(~F.col("_there"), None).when(any_hit, reduce(lambda a, b: a + b, [part(t) for t in own]) * F.col("_w")).otherwise(0.0)
    return both.select(key, *keep, *[(score(own) if own else F.lit(None).cast("double")).alias(q) for q, own in terms.items()])


def bm25(docs: DataFrame, key: str, queries: dict[str, str], text: str = "text", weight: Column | None = None, include_zero: bool = False) -> DataFrame:
    """(list_id, key, score): :func:`bm25_wide` as one row per query and document. Documents
    without a text and queries without terms have no rows; documents with a score of 0 are
    left out unless ``include_zero``."""
    own = [q for q, t in queries.items() if query_terms(t)]
    if not own:
        return docs.sparkSession.createDataFrame([], f"list_id string, {key} {docs.schema[key].dataType.simpleString()}, score double")
    wide = bm25_wide(docs, key, {q: queries[q] for q in own}, text, weight)
    scores = F.filter(F.array(*[F.struct(F.lit(q).alias("list_id"), F.col(q).alias("score")) for q in own]), lambda s: s["score"] >= 0 if include_zero else s["score"] > 0)
    return wide.select(key, F.inline(scores)).select("list_id", key, "score")


def boilerplate(scored: DataFrame, path: str, config: Column, top: int = 10) -> DataFrame:
    """share, boilerplate: the part of configuration files among the ``top`` best; more than 60 % is a hint."""
    best = scored.orderBy(F.desc("score"), path).limit(top)
    share = F.coalesce(F.avg(F.when(config, 1.0).otherwise(0.0)), F.lit(0.0))
    return best.agg(share.alias("share")).withColumn("boilerplate", F.col("share") > 0.60)


def low_variance(scored: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Whether at least three of the ``top`` scores hardly differ: best above 0.05, sample variance under 0.001."""
    best = scored.orderBy(F.desc("score"), key).limit(top)
    out = best.agg(F.count("*").alias("n"), F.max("score").alias("best"), F.var_samp("score").alias("variance"))
    hint = (F.col("n") >= 3) & (F.col("best") > 0.05) & (F.col("variance") < 0.001)
    return out.select("n", "best", "variance", F.coalesce(hint, F.lit(False)).alias("low_variance"))


