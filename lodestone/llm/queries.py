"""Named queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.common import distinct_rows, load
from lodestone.llm import distinctive, language, mixing, neighbours, packing, sketch, split

TEN = "^[a-z]{6,}$"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.similar_pairs(load(spark, d, "chunks"), 0.95)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every usable chunk with its class of equal vectors and the number of similar classes."""
    return neighbours.linked(*neighbours.similar_classes(load(spark, d, "chunks"), 0.95))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn(load(spark, d, "chunks"), 10)


ASKED = "id % 20 = 0"


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of all chunks for every chunk whose id is divisible by 20."""
    return neighbours.knn(load(spark, d, "chunks"), 10, asked=F.expr(ASKED))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """How much of the exact ten p1_search finds, by comparing its queries with all chunks."""
    chunks = load(spark, d, "chunks")
    row = neighbours.recall(p1_search(spark, d), neighbours.brute_force(chunks, chunks.filter(ASKED), 10))
    return row.select("queries", "neighbours", F.round("recall", 4).alias("recall"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.text_records(load(spark, d, "chunks"), load(spark, d, "symbols"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.distinctiveness(_records(spark, d), min_tf={"chunk": 3, "symbol": 1}, max_df=5, pattern=TEN)
    return scored.select("record_type", "record_id", "term")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctiveness(_records(spark, d)).withColumn("ppmi", F.round("ppmi", 4))


def _times(spark: SparkSession, d: str) -> DataFrame:
    rows = distinct_rows(
        load(spark, d, "execution_metrics"),
        ("id",),
        command_name=F.lower(F.trim("command_name")),
        day=F.to_date("timestamp"),
        ms=F.col("execution_time_ms"),
    )
    return rows.filter("ms >= 0 and command_name is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sketch.heavy_tailed(_times(spark, d), "command_name", "ms")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per command from merged sketches of single days."""
    daily = sketch.sketch(_times(spark, d), ["command_name", "day"], "ms")
    whole = sketch.merge(daily, ["command_name"])
    return sketch.percentiles(whole, ["command_name"], [50.0, 90.0, 95.0, 99.0]).withColumn("value", F.round("value", 3))


def p3_daily_sketch(spark: SparkSession, d: str) -> DataFrame:
    return sketch.sketch(_times(spark, d), ["command_name", "day"], "ms")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split.defects(load(spark, d, "chunks"), load(spark, d, "documents"))


def p5_document_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(load(spark, d, "documents"), ["doc_id"], "text")


def p5_chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of oversized chunks, with offsets into the document."""
    chunks = load(spark, d, "chunks").withColumnRenamed("start_offset", "chunk_start")
    cut = split.split_texts(chunks, ["id", "doc_id", "chunk_start"], "content", only_oversized=True)
    return cut.withColumn("document_offset", F.col("chunk_start") + F.col("start_offset"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    limits = load(spark, d, "pack_limits").filter("pack_id = 'window_2k'")
    packed = packing.pack(load(spark, d, "documents"), limits)
    return packed.filter("pieces > 1 and piece = 0").select("doc_id")  # a first piece that was placed, of several


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(spark, d, "documents"), load(spark, d, "pack_limits"))


TIGHT = {"loss_part": 0.9, "per_segment": 2048, "least_segments": 4}  #: limits under which each binds in some windows


def p8_tight_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows under limits that bind: nine tenths of the tokens may bear loss, four segments a window."""
    return packing.pack(load(spark, d, "documents"), load(spark, d, "pack_limits"), **TIGHT)


def p8_tight_binding(spark: SparkSession, d: str) -> DataFrame:
    return packing.binding(p8_tight_windows(spark, d), load(spark, d, "pack_limits"), **TIGHT)


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    limits = load(spark, d, "pack_limits")
    return packing.usage(packing.pack(load(spark, d, "documents"), limits), limits)


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the mixture takes everything as often as it may, and yet too little."""
    return _mix(spark, d).report().filter("capped and chosen_tokens = max_repeats * own_tokens").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen()


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, language.Profiles]:
    documents, names = load(spark, d, "documents"), load(spark, d, "lang_names")
    return documents, names, language.train(documents, names)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.unlabelled(*_languages(spark, d))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    documents, _, profiles = _languages(spark, d)
    return language.segments(documents, profiles).withColumn("confidence", F.round("confidence", 6))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    documents, _, profiles = _languages(spark, d)
    return language.by_language(language.segments(documents, profiles))


def p10_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Right labels among documents that no prototype was fitted on: a fifth, held out by a hash."""
    documents, names = load(spark, d, "documents"), load(spark, d, "lang_names")
    held = F.pmod(F.xxhash64(F.lit("held out"), F.col("doc_id")), F.lit(5)) == 0
    return language.accuracy(documents.filter(held), names, language.train(documents.filter(~held), names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


_TOKENS = r"""list_filter(list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[0-9]+|[A-Z]{{2,}}|[A-Z][a-z0-9]*|[a-z][a-z0-9]*'), lambda x: lower(x)), lambda x: strlen(x) > 2)"""

_POSTINGS = f"""
records AS (SELECT 'chunk' AS record_type, id AS record_id, {_TOKENS.format("content")} AS tokens FROM chunks
            UNION ALL SELECT 'symbol', id, {_TOKENS.format("name")} FROM symbols),
postings AS (SELECT record_type, record_id, term, count(*) AS tf FROM (SELECT record_type, record_id, unnest(tokens) AS term FROM records) GROUP BY ALL),
terms AS (SELECT record_type, term, sum(tf) AS term_count, count(*) AS df FROM postings GROUP BY ALL)"""

_TIMES = """
times AS (SELECT lower(trim(command_name)) AS command_name, CAST(timestamp AS DATE) AS day, execution_time_ms AS ms
          FROM (SELECT DISTINCT * EXCLUDE (id) FROM execution_metrics) WHERE execution_time_ms >= 0 AND command_name IS NOT NULL)"""

_BUCKETS = f"""
buckets AS (SELECT command_name, day, CASE WHEN ms = 0 THEN 0 ELSE CAST(ceil(ln(ms::DOUBLE) / ln(1.01 / 0.99)) AS INT) + {sketch.offset()} END AS bucket FROM times)"""


_UNIT = """
usable AS (SELECT id, embedding::DOUBLE[] AS e FROM chunks WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
unit AS (SELECT id, CAST(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS DOUBLE[64]) AS v FROM usable)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_UNIT}
            SELECT a.id AS chunk_id_a, b.id AS chunk_id_b FROM unit a JOIN unit b ON a.id < b.id WHERE array_inner_product(a.v, b.v) >= 0.95""",
        "p2_found": f"""WITH {_POSTINGS}
            SELECT record_type, record_id, term FROM postings JOIN terms USING (record_type, term)
            WHERE df <= 5 AND tf >= CASE record_type WHEN 'chunk' THEN 3 ELSE 1 END AND regexp_full_match(term, '[a-z]{{6,}}')""",
        "p2_scores": f"""WITH {_POSTINGS},
            sizes AS (SELECT record_type, record_id, len(tokens) AS n FROM records WHERE len(tokens) > 0),
            sums AS (SELECT record_type, sum(pow(n, 0.75)) AS all_smoothed FROM sizes GROUP BY 1)
            SELECT record_type, record_id, term, CAST(tf AS INT) AS tf, df, CAST(term_count AS BIGINT) AS term_count,
                   round(greatest(log2(tf * all_smoothed / (term_count * pow(n, 0.75))), 0.0), 4) AS ppmi
            FROM postings JOIN terms USING (record_type, term) JOIN sizes USING (record_type, record_id) JOIN sums USING (record_type)""",
        "p3_found": f"""WITH {_TIMES}
            SELECT command_name FROM times GROUP BY 1 HAVING quantile_disc(ms, 0.95) >= 20 * quantile_disc(ms, 0.5)""",
        "p3_percentiles": f"""WITH {_TIMES}, p(percent) AS (VALUES (50.0), (90.0), (95.0), (99.0)),
            sorted AS (SELECT command_name, count(*) AS total, list(ms ORDER BY ms) AS l FROM times GROUP BY 1),
            exact AS (SELECT command_name, percent, total, l[greatest(CAST(ceil(percent * total / 100 - 1e-9) AS BIGINT), 1)] AS v FROM sorted, p)
            SELECT command_name, CAST(percent AS DOUBLE) AS percent, total, round(CASE WHEN v = 0 THEN 0.0 ELSE exp(ceil(ln(v::DOUBLE) / ln(1.01 / 0.99)) * ln(1.01 / 0.99)) * 2 / (1.01 / 0.99 + 1) END, 3) AS value FROM exact""",
        "p5_found": r"""WITH c AS (SELECT id, doc_id, start_offset AS start, encode(rtrim(content, ' ' || chr(9) || chr(10) || chr(13))) AS own FROM chunks WHERE content IS NOT NULL),
            s AS (SELECT id, doc_id, start, own, octet_length(own) AS size, greatest(coalesce(max(start + octet_length(own)) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS reached FROM c WHERE doc_id IS NOT NULL AND start IS NOT NULL),
            j AS (SELECT s.*, encode(text) AS whole FROM s LEFT JOIN documents USING (doc_id))
            SELECT id AS chunk_id, 'oversized' AS defect FROM c WHERE octet_length(own) > 1000
            UNION ALL SELECT id, 'misplaced' FROM c WHERE doc_id IS NULL OR start IS NULL
            UNION ALL SELECT id, 'misplaced' FROM j WHERE whole IS NULL OR start < 0 OR octet_length(whole) < start + size OR (size > 0 AND whole[start + 1:start + size] <> own)
            UNION ALL SELECT id, 'gap' FROM j WHERE start > reached AND NOT regexp_full_match(hex(whole[reached + 1:start]), '(20|09|0A|0D)*')""",
        "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) / 4.0 > 2048",
        "p9_found": """WITH own AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS n FROM documents WHERE text <> '' AND lower(trim(source)) IN (SELECT source FROM mix_targets) GROUP BY 1)
            SELECT source FROM mix_targets LEFT JOIN own USING (source) WHERE target_share * (SELECT sum(n) FROM own) > max_repeats * coalesce(n, 0)""",
        "p3_daily_sketch": f"""WITH {_TIMES}, {_BUCKETS}
            SELECT command_name, day, bucket, count(*) AS n FROM buckets GROUP BY ALL""",
    }
