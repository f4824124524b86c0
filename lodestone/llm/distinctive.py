"""How distinctive a term is per record (problem 2): positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.functions.text import RUNS, sorted_tokens

ALPHA = 0.75
HOT = 5000  #: a term with at least one in so many tokens of its collection is hot; there are at most so many a collection


def postings(records: DataFrame) -> DataFrame:
    """(record_type, record_id, tokens, pos, term, tf): a row per record and distinct term.

    ``records`` has record_type, record_id, text; null and empty texts give no rows.
    Counting is done inside each row and within the JVM, nothing is shuffled: the sorted
    tokens are joined and cut into runs of equal words by a back-reference.
    """
    words = records.select("record_type", "record_id", sorted_tokens("text").alias("words"))
    lined = words.select("record_type", "record_id", F.size("words").alias("tokens"), F.array_join("words", " ").alias("line"))
    rows = lined.select("record_type", "record_id", "tokens", F.posexplode(F.regexp_extract_all("line", F.lit(RUNS), F.lit(0))).alias("pos", "run"))
    term = F.substring_index("run", " ", 1)
    tf = ((F.length("run") + 1) / (F.length(term) + 1)).cast("int")
    return rows.select("record_type", "record_id", "tokens", "pos", term.alias("term"), tf.alias("tf"))


def distinctiveness(
    records: DataFrame,
    alpha: float = ALPHA,
    min_tf: dict[str, int] | None = None,
    max_df: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Positive pointwise mutual information of term and record.

    With tf the joint count, N all tokens of the record type, c the term's count and n the
    record's length: log2((tf / N) / ((c / N) * (n^alpha / sum of n^alpha))), 0 if
    negative. Raising the context's count to ``alpha`` < 1 lifts short records' share and
    so damps the high values they would get by chance. Collections are told apart by
    record_type.

    ``min_tf`` (by record type), ``max_df`` and ``pattern`` choose the terms that are
    scored, before anything is shuffled; all counts cover every token of every record.
    Result: record_type, record_id, term, tf, df, term_count, ppmi. Records given twice
    (same id) are two records. Empty input gives an empty result.

    Counts meet by joins: those of hot terms by a broadcast of at most HOT terms a
    collection, since no more can reach one token in HOT each; those of all other terms
    by a shuffle, in which no term can hold a large part of the rows.
    """
    all_rows = postings(records)
    smoothed = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    once = F.when(F.col("pos") == 0, smoothed).otherwise(F.lit(0.0))  # a record's context count, with its first term
    terms = cut(all_rows.groupBy("record_type", "term").agg(F.sum("tf").alias("term_count"), F.count("*").alias("df"), F.sum(once).alias("smoothed")))  # the vocabulary
    sizes = F.broadcast(terms.groupBy("record_type").agg(F.sum("term_count").alias("all_tokens"), F.sum("smoothed").alias("all_smoothed")))  # a row a record type
    hot = terms.join(sizes, "record_type").filter(F.col("term_count") * HOT >= F.col("all_tokens")).select("record_type", "term", F.col("term_count").alias("_hot_count"), F.col("df").alias("_hot_df"))
    terms = terms.drop("smoothed")
    rows = all_rows
    if min_tf is not None:
        wanted = F.lit(1)
        for kind, least in min_tf.items():
            wanted = F.when(F.col("record_type") == kind, least).otherwise(wanted)
        rows = rows.filter(F.col("tf") >= wanted)
    if pattern is not None:
        rows = rows.filter(F.col("term").rlike(pattern))
        hot, terms = hot.filter(F.col("term").rlike(pattern)), terms.filter(F.col("term").rlike(pattern))
    rows = rows.join(F.broadcast(hot), ["record_type", "term"], "left")
    if max_df is not None:
        rows = rows.filter(F.coalesce("_hot_df", F.lit(0)) <= max_df)
        terms = terms.filter(F.col("df") <= max_df)
    # Rows of hot terms are done; in the shuffle they get keys that match nothing and spread evenly.
    key = F.when(F.col("_hot_df").isNull(), F.col("term")).otherwise(F.concat(F.lit(" "), F.pmod(F.xxhash64("record_id"), F.lit(4096)).cast("string")))
    cold = terms.select("record_type", F.col("term").alias("_key"), "term_count", "df")
    how = "left" if max_df is None else "inner"
    if max_df is not None:
        done = rows.filter("_hot_df is not null").select("record_type", "record_id", "tokens", "term", "tf", F.col("_hot_count").alias("term_count"), F.col("_hot_df").alias("df"))
    joined = rows.withColumn("_key", key).join(cold, ["record_type", "_key"], how).select("record_type", "record_id", "tokens", "term", "tf", F.coalesce("_hot_count", "term_count").alias("term_count"), F.coalesce("_hot_df", "df").alias("df"))
    if max_df is not None:
        joined = joined.unionByName(done)
    scored = joined.join(sizes, "record_type")
    ratio = F.col("tf") * F.col("all_smoothed") / (F.col("term_count") * smoothed)
    return scored.select("record_type", "record_id", "term", "tf", "df", "term_count", F.greatest(F.log2(ratio), F.lit(0.0)).alias("ppmi"))


def text_records(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunk contents and symbol names as records."""
    a = chunks.select(F.lit("chunk").alias("record_type"), F.col("id").alias("record_id"), F.col("content").alias("text"))
    return a.unionByName(symbols.select(F.lit("symbol").alias("record_type"), F.col("id").alias("record_id"), F.col("name").alias("text")))
