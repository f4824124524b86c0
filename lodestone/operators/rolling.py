"""Totals over trailing periods for every entity and every day (problem 4)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import distinct_rows


def rolling_totals(
    facts: DataFrame,
    entity: str,
    day: str,
    measures: list[str],
    start: dt.date,
    end: dt.date,
    windows: tuple[int, ...] = (7, 30),
) -> DataFrame:
    """Totals and averages of ``measures`` over the last ``windows`` days, per entity and day.

    Event-contribution deltas: an entity's amount of day d counts from d on and is taken
    back at d + w; the running sum of the deltas is the total of the trailing w days.
    No row is ever joined to the days it counts for, so the cost per entity is the number
    of its active days plus the length of the calendar, whatever the window lengths.

    Every entity that occurs in ``facts`` gets every day of [start, end], also without
    rows. Null entities and null days are left out; a null measure counts as 0. Rows
    before ``start`` count as far as a window reaches back to them; later ones than
    ``end`` don't count. Averages per row are null where a window has no rows. An empty
    table gives an empty result; further columns are ignored.

    Result: entity, day, rows_on_day, and for each window w rows_{w}d, and for each
    measure m total_{m}_{w}d, avg_{m}_{w}d (per row), per_day_{m}_{w}d.

    Per-day sums are combined map-side, so a hot entity reaches its reducer as one record
    per day and input partition. All later steps share one partitioning by entity.
    """
    daily = (
        facts.select(F.col(entity).alias("entity"), F.col(day).cast("date").alias("day"), *[F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(m) for m in measures])
        .filter(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(F.count("*").alias("_rows"), *[F.sum(m).alias(m) for m in measures])
    )
    amounts = ["_rows", *measures]
    first, last = F.lit(start), F.lit(end)
    never, nothing = F.lit(False), F.lit(0)

    def part(at, sign: int, on: dict[int, object], own: object):
        fields = [at.alias("day"), own.cast("long").alias("own")]
        for w in windows:
            fields += [F.when(on[w], sign * F.col(a)).otherwise(F.lit(0)).cast("long").alias(f"{a}_{w}") for a in amounts]
        return F.struct(*fields)

    # an entity's first row also brings its calendar, so facts are read once
    leads = F.row_number().over(Window.partitionBy("entity").orderBy("day")) == 1
    daily = daily.withColumn("_leads", leads)
    counts = F.col("day") <= last
    reach = {w: counts & (F.date_add("day", w) > first) for w in windows}
    adds = part(F.greatest(F.least(F.col("day"), last), first), 1, reach, F.when(counts & (F.col("day") >= first), F.col("_rows")).otherwise(nothing))
    takes = [part(F.greatest(F.date_add("day", w), first), -1, {v: reach[v] if v == w else never for v in windows}, nothing) for w in windows]
    blank = F.transform(F.sequence(first, last), lambda at: part(at, 1, dict.fromkeys(windows, never), nothing))
    calendar = F.when(F.col("_leads"), blank).otherwise(F.slice(blank, 1, 0))
    deltas = daily.select("entity", F.inline(F.concat(F.array(adds, *takes), calendar))).filter(F.col("day") <= last)
    changes = deltas.groupBy("entity", "day").agg(*[F.sum(c).alias(c) for c in deltas.columns[2:]])
    running = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    totals = changes.select("entity", "day", F.col("own").alias("rows_on_day"), *[F.sum(c).over(running).alias(c) for c in deltas.columns[3:]])
    out = [F.col("entity").alias(entity), F.col("day").alias(day), F.col("rows_on_day")]
    for w in windows:
        n = F.col(f"_rows_{w}")
        out.append(n.alias(f"rows_{w}d"))
        for m in measures:
            total = F.col(f"{m}_{w}")
            out += [total.alias(f"total_{m}_{w}d"), F.when(n > 0, total / n).alias(f"avg_{m}_{w}d"), (total / F.lit(float(w))).alias(f"per_day_{m}_{w}d")]
    return totals.select(*out)


def project_usage(metrics: DataFrame) -> DataFrame:
    """execution_metrics as facts: project without closing slash, day, tokens, saved tokens.

    Rows equal in all but ``id`` count once; saved tokens are 0 if negative or unknown.
    """
    saved = F.coalesce(F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)), F.lit(0))
    saved = F.when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), F.lit(0)).otherwise(saved)
    return distinct_rows(
        metrics.filter(F.col("project_path").isNotNull()),
        ("id",),
        project_path=F.regexp_replace("project_path", "/+$", ""),
        day=F.to_date("timestamp"),
        input_tokens=F.col("input_tokens"),
        output_tokens=F.col("output_tokens"),
        saved_tokens=saved,
    )


def quiet_after_burst(totals: DataFrame, percent: int = 70) -> DataFrame:
    """Days without rows on which the last 7 days hold at least ``percent`` % of the saved tokens of the last 30."""
    week, month = F.col("total_saved_tokens_7d"), F.col("total_saved_tokens_30d")
    conditions = [F.col("rows_on_day") == 0, week > 0, week * 100 >= month * percent]
    return totals.filter(reduce(lambda a, b: a & b, conditions)).select("project_path", F.date_format("day", "yyyy-MM-dd").alias("day"))
