import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import hotkeys, incremental, rolling

D = dt.date


def facts(spark, rows):
    return spark.createDataFrame(rows, "e string, day date, m long, entity string, own int")


def test_rolling_against_brute_force(spark):
    rows = [("a", D(2025, 1, 1), 5), ("a", D(2025, 1, 1), 2), ("a", D(2025, 1, 9), 10), ("a", D(2024, 12, 28), 4), ("a", D(2026, 1, 1), 99), ("b", D(1970, 1, 1), 7), ("b", D(2025, 1, 3), None), (None, D(2025, 1, 3), 1), ("c", None, 1)]
    df = facts(spark, [(*r, "x", 1) for r in rows])
    start, end = D(2025, 1, 1), D(2025, 1, 14)
    got = {(r.e, r.day): r for r in rolling.rolling_totals(df, "e", "day", ["m"], start, end, (3, 7)).collect()}
    assert len(got) == 2 * 14
    for (e, day), r in got.items():
        for w in (3, 7):
            inside = [m for x, at, m in rows if x == e and at and day - dt.timedelta(w) < at <= day]
            assert (r[f"rows_{w}d"], r[f"total_m_{w}d"]) == (len(inside), sum(m or 0 for m in inside))
            assert r[f"avg_m_{w}d"] == (sum(m or 0 for m in inside) / len(inside) if inside else None)
        assert r.rows_on_day == sum(1 for x, at, _ in rows if x == e and at == day)


def test_rolling_of_nothing(spark):
    assert rolling.rolling_totals(facts(spark, []), "e", "day", ["m"], D(2025, 1, 1), D(2025, 1, 3)).count() == 0


SITES = "id long, caller_qualified string, callee_name string, file string, line int, key_value string"


def test_hot_keys(spark):
    rows = [(i, "f::a", "get", "f", i % 50, "x") for i in range(500)] + [(1000, "f::b", "get", None, None, "x"), (1001, "f::b", "get", None, None, "x"), (1002, None, "get", "f", 1, "x"), (1003, "f::c", "", "f", 1, "x"), (1004, "g::d", "put", "g", 7, "x")]
    keys = {(r.key_field, r.key_value): r for r in hotkeys.both_fields(hotkeys.call_sites(spark.createDataFrame(rows, SITES))).collect()}
    get = keys["callee_name", "get"]
    assert (get.call_sites, get.counterparts, get.files, get.all_sites) == (51, 2, 1, 52)
    assert ("caller_qualified", "f::c") not in keys
    few = hotkeys.both_fields(hotkeys.call_sites(spark.createDataFrame(rows, SITES)), full=False)
    assert {tuple(r) for r in hotkeys.dominant(few, 50).collect()} == {("callee_name", "get"), ("caller_qualified", "f::a")}
    assert hotkeys.both_fields(hotkeys.call_sites(spark.createDataFrame([], SITES))).count() == 0


DOCS = "doc_id long, collection string, path string, text string, content_hash string, bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], DOCS)


def test_changes(spark):
    now = docs(spark, [(1, "c", "same", "x", "SHA256:AA "), (2, "c", "changed", "x", "bb"), (3, "c", "new", "x", None), (4, "c", "empty", "", "ee"), (5, "c", "null", None, "ff"), (6, None, None, "x", "gg"), (7, "c", "failed", "x", "hh")])
    stamp = dt.datetime(2025, 1, 1)
    runs = spark.createDataFrame([(1, stamp, "success"), (2, stamp + dt.timedelta(1), "success"), (3, stamp + dt.timedelta(2), "failed")], "run_id long, started_at timestamp, status string")
    rows = [("c", "same", "00", stamp, 1), ("c", "same", "aa", stamp, 2), ("c", "same", "aa", stamp, 2), ("c", "changed", "zz", None, 1), ("c", "changed", "bb", None, 3), ("c", "gone", "qq", None, 1), ("c", "failed", "hh", None, 3), (None, None, "gg", None, 1)]
    snapshots = spark.createDataFrame(rows, "collection string, path string, content_hash string, indexed_at timestamp, run_id long")
    for buckets in (1, 64):
        found = incremental.changes(incremental.current_state(now, buckets), incremental.recorded_state(snapshots, runs, buckets))
        assert {(r.path, r.doc_id, r.change) for r in found.collect()} == {("changed", 2, "changed"), ("new", 3, "new"), ("failed", 7, "new"), ("gone", None, "deleted")}
    same = incremental.current_state(now, 8)
    assert incremental.changed_buckets(same, same).count() == 0


def test_incremental_runs(spark, tmp_path):
    job = incremental.Incremental(spark, str(tmp_path / "state"), 8, 3)
    seen = []

    def process(work):
        seen.append(sorted(r.doc_id for r in work.select("doc_id").collect()))
        return work.select("doc_id", F.upper("text").alias("result"))

    first = [(i, "c", f"p{i}", f"t{i}", None) for i in range(1, 9)]
    job.run(docs(spark, first), process)
    seen[:] = [sorted(x for own in seen for x in own)]
    job.run(docs(spark, first), process)
    second = [*first[1:7], (8, "c", "p8", "other", None), (9, "c", "p9", "t9", None)]

    def fails(work):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        job.run(docs(spark, second), fails)
    assert sorted(r.doc_id for r in job.changes(docs(spark, second)).filter("change <> 'deleted'").collect()) == [8, 9]
    job.run(docs(spark, second), process)
    assert seen[0] == [1, 2, 3, 4, 5, 6, 7, 8] and sorted(x for own in seen[1:] for x in own) == [8, 9]
    assert job.changes(docs(spark, second)).count() == 0
    live = {r.doc_id: r.result for r in job.state().filter("live").collect()}
    assert live == {**{i: f"T{i}" for i in range(2, 8)}, 8: "OTHER", 9: "T9"}
