"""Named queries of rolling totals, incremental runs and hot keys (problems 4, 6, 7)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.common import ensure_checkpoint_dir, load
from lodestone.operators import hotkeys, incremental, rolling

FIRST, FULL, LAST = dt.date(2025, 3, 1), dt.date(2025, 3, 30), dt.date(2025, 5, 29)
MEASURES = ["input_tokens", "output_tokens", "saved_tokens"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    facts = rolling.project_usage(load(spark, d, "execution_metrics"))
    return rolling.quiet_after_burst(rolling.rolling_totals(facts, "project_path", "day", ["saved_tokens"], FULL, LAST))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    facts = rolling.project_usage(load(spark, d, "execution_metrics"))
    totals = rolling.rolling_totals(facts, "project_path", "day", MEASURES, FIRST, LAST)
    return totals.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in totals.dtypes])


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, d, "documents")
    buckets = incremental.bucket_count(documents)
    recorded = incremental.recorded_state(load(spark, d, "snapshots"), load(spark, d, "index_runs"), buckets)
    return incremental.current_state(documents, buckets), recorded


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes(*_states(spark, d)).filter("change <> 'deleted'").select("doc_id")


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes(*_states(spark, d))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, digest, times: the state after a run over documents that broke off half-way and
    one that went through, and how often each document was processed."""
    folder = f"{ensure_checkpoint_dir(spark)}/p6-{uuid.uuid4().hex}"
    documents = load(spark, d, "documents")
    job = incremental.Incremental(spark, f"{folder}/state", parts=8, at_once=4)
    job.start(_states(spark, d)[1])
    calls = []

    def process(work: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise InterruptedError
        work.select("doc_id").write.mode("append").parquet(f"{folder}/done")
        return work.select("doc_id", F.length("text").alias("characters"))

    for _ in range(2):
        try:
            job.run(documents, process)
        except InterruptedError:
            pass
    done = spark.read.parquet(f"{folder}/done").groupBy("doc_id").agg(F.count("*").alias("times"))
    live = job.state().filter("live").select(*incremental.KEY, "digest")
    named = incremental.current_state(documents, 1).select(*[F.col(k).alias(f"_{k}") for k in incremental.KEY], "doc_id")
    rows = live.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in incremental.KEY])
    return rows.join(done, "doc_id", "left").select("doc_id", "digest", F.coalesce("times", F.lit(0)).alias("times"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.dominant(hotkeys.both_fields(hotkeys.call_sites(load(spark, d, "calls")), full=False))


def p7_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = hotkeys.both_fields(hotkeys.call_sites(load(spark, d, "calls")))
    return keys.select("key_field", "key_value", "call_sites", "counterparts", "files", F.round("share", 6).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


_RUNS = """
runs AS (SELECT regexp_replace(project_path, '/+$', '') AS project_path, CAST(timestamp AS DATE) AS day, input_tokens, output_tokens,
                coalesce(greatest(input_tokens - output_tokens, 0), 0) AS saved_tokens
         FROM (SELECT DISTINCT * EXCLUDE (id) FROM execution_metrics) WHERE project_path IS NOT NULL),
daily AS (SELECT project_path, day, count(*) AS n, coalesce(sum(input_tokens), 0) AS input_tokens, coalesce(sum(output_tokens), 0) AS output_tokens,
                 sum(saved_tokens) AS saved_tokens FROM runs WHERE day IS NOT NULL GROUP BY ALL),
spine AS (SELECT project_path, CAST(unnest(generate_series(DATE '{0}', DATE '2025-05-29', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT project_path FROM daily))"""


def _span(m: str, w: int) -> str:
    return f"coalesce(sum(d.{m}) FILTER (d.day > s.day - {w}), 0)"


def _totals_sql() -> str:
    columns = ["CAST(coalesce(sum(d.n) FILTER (d.day = s.day), 0) AS BIGINT) AS rows_on_day"]
    for w in (7, 30):
        columns.append(f"CAST({_span('n', w)} AS BIGINT) AS rows_{w}d")
        for m in MEASURES:
            columns.append(f"CAST({_span(m, w)} AS BIGINT) AS total_{m}_{w}d")
            columns.append(f"round(CASE WHEN {_span('n', w)} > 0 THEN {_span(m, w)} / {_span('n', w)}::DOUBLE END, 6) AS avg_{m}_{w}d")
            columns.append(f"round({_span(m, w)} / {w}.0::DOUBLE, 6) AS per_day_{m}_{w}d")
    return f"""WITH {_RUNS.format("2025-03-01")}
        SELECT s.project_path, s.day, {", ".join(columns)}
        FROM spine s LEFT JOIN daily d ON d.project_path = s.project_path AND d.day <= s.day AND d.day > s.day - 30 GROUP BY 1, 2"""


_STATES = r"""
current_state AS (SELECT collection, path, doc_id, coalesce(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), sha256(text)) AS digest
                  FROM documents WHERE text IS NOT NULL AND text <> ''),
ranked AS (SELECT s.collection, s.path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS digest,
                  row_number() OVER (PARTITION BY s.collection, s.path ORDER BY started_at DESC, run_id DESC, indexed_at DESC NULLS LAST, digest DESC NULLS LAST) AS r
           FROM snapshots s JOIN (SELECT run_id, started_at FROM index_runs WHERE status = 'success') USING (run_id)),
recorded AS (SELECT collection, path, digest FROM ranked WHERE r = 1)"""

_SITES = """
sites AS (SELECT DISTINCT caller_qualified, callee_name, file, line FROM calls WHERE caller_qualified <> '' AND callee_name <> ''),
keys AS (SELECT 'callee_name' AS key_field, callee_name AS key_value, count(*) AS call_sites, count(DISTINCT caller_qualified) AS counterparts, count(DISTINCT file) AS files FROM sites GROUP BY ALL
         UNION ALL SELECT 'caller_qualified', caller_qualified, count(*), count(DISTINCT callee_name), count(DISTINCT file) FROM sites GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""WITH {_RUNS.format("2025-03-30")},
            sums AS (SELECT s.project_path, s.day, {_span("saved_tokens", 7)} AS week, {_span("saved_tokens", 30)} AS month, count(*) FILTER (d.day = s.day) AS here
                     FROM spine s LEFT JOIN daily d ON d.project_path = s.project_path AND d.day <= s.day AND d.day > s.day - 30 GROUP BY 1, 2)
            SELECT project_path, strftime(day, '%Y-%m-%d') AS day FROM sums WHERE here = 0 AND week > 0 AND week * 100 >= month * 70""",
        "p4_totals": _totals_sql(),
        "p6_found": f"""WITH {_STATES}
            SELECT doc_id FROM current_state c LEFT JOIN (SELECT *, true AS there FROM recorded) r
            ON c.collection IS NOT DISTINCT FROM r.collection AND c.path IS NOT DISTINCT FROM r.path
            WHERE r.there IS NULL OR c.digest IS DISTINCT FROM r.digest""",
        "p6_changes": f"""WITH {_STATES}
            SELECT coalesce(c.collection, r.collection) AS collection, coalesce(c.path, r.path) AS path, doc_id, coalesce(c.digest, r.digest) AS digest,
                   CASE WHEN r.there IS NULL THEN 'new' WHEN c.here IS NULL THEN 'deleted' ELSE 'changed' END AS change
            FROM (SELECT *, true AS here FROM current_state) c FULL JOIN (SELECT *, true AS there FROM recorded) r ON c.collection = r.collection AND c.path = r.path
            WHERE r.there IS NULL OR c.here IS NULL OR c.digest IS DISTINCT FROM r.digest""",
        "p6_runs": f"""WITH {_STATES}
            SELECT doc_id, c.digest AS digest, CASE WHEN r.there IS NULL OR c.digest IS DISTINCT FROM r.digest THEN 1 ELSE 0 END AS times
            FROM current_state c LEFT JOIN (SELECT *, true AS there FROM recorded) r
            ON c.collection IS NOT DISTINCT FROM r.collection AND c.path IS NOT DISTINCT FROM r.path""",
        "p7_found": f"""WITH {_SITES} SELECT key_field, key_value FROM keys WHERE call_sites * 100 >= 2 * (SELECT count(*) FROM sites)""",
        "p7_keys": f"""WITH {_SITES} SELECT key_field, key_value, call_sites, counterparts, files, round(call_sites / (SELECT count(*) FROM sites)::DOUBLE, 6) AS share FROM keys""",
    }
