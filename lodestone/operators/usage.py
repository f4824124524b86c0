"""Savings reports over execution metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import savings_percent



def _zero(name: str):
    return F.coalesce(F.col(name), F.lit(0))


def executions(metrics: DataFrame, project: str | None = None, days: int | None = None, today: str | None = None) -> DataFrame:
    """Rows of one project and of the last ``days`` days up to ``today`` (a date)."""
    if project is not None:
        metrics = metrics.filter(F.col("project_path") == project)
    if days is not None:
        metrics = metrics.filter(F.to_date("timestamp") >= F.date_sub(F.lit(today).cast("date"), days))
    return metrics


def record(raw: DataFrame) -> DataFrame:
    """Derived figures of one execution: tokens are a quarter of the bytes; saved ones never negative."""
    before, after = F.floor(F.col("raw_output_size") / 4), F.floor(F.col("filtered_output_size") / 4)
    out = raw.withColumn("input_tokens", before.cast("long")).withColumn("output_tokens", after.cast("long"))
    return out.withColumn("saved_tokens", F.when(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull(), F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)))).withColumn("savings_percent", savings_percent(F.col("input_tokens"), F.col("output_tokens")))


def summary(metrics: DataFrame) -> DataFrame:
    """One row: executions, tokens before, after and saved, percent, times."""
    out = metrics.agg(F.count("*").alias("executions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "execution_time_ms")])
    saved = F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0))
    average = F.when(F.col("executions") > 0, F.expr("execution_time_ms div executions")).otherwise(F.lit(0))
    return out.select("executions", "input_tokens", "output_tokens", saved.alias("saved_tokens"), savings_percent(F.col("input_tokens"), F.col("output_tokens")).alias("savings_percent"), "execution_time_ms", average.alias("avg_time_ms"))


def report(summary: DataFrame, commands: DataFrame) -> DataFrame:
    """(n, line): a text report of :func:`summary` and :func:`by_command`, a row a line: the
    totals, and each command by falling saved tokens, ties by name."""
    labels = [("executions", "Commands run: "), ("input_tokens", "Tokens before: "), ("output_tokens", "Tokens after: "), ("saved_tokens", "Tokens saved: ")]
    heads = [F.concat(F.lit(text), F.col(c).cast("string")) for c, text in labels]
    heads.append(F.format_string("Mean saving: %.1f%%", "savings_percent"))
    top = summary.select(F.posexplode(F.array(*heads)).alias("n", "line"))
    name = F.rpad(F.coalesce("command_name", F.lit("-")), 30, " ")
    text = F.concat(F.lit("  "), name, F.lit(" "), F.format_string("%5dx  -%d tokens (%.0f%%)", "executions", "saved_tokens", "avg_percent"))
    place = F.row_number().over(Window.orderBy(F.desc("saved_tokens"), "command_name"))  # commands are few
    return top.unionByName(commands.select((place + len(heads) - 1).alias("n"), text.alias("line")))


def by_command(metrics: DataFrame) -> DataFrame:
    """command_name, executions, saved_tokens, avg_percent (mean of the rows' percentages), execution_time_ms."""
    percent = F.when(_zero("input_tokens") > 0, (_zero("input_tokens") - _zero("output_tokens")) * 100.0 / F.col("input_tokens")).otherwise(0.0)
    return metrics.groupBy("command_name").agg(F.count("*").alias("executions"), F.sum(_zero("input_tokens") - _zero("output_tokens")).alias("saved_tokens"), F.avg(percent).alias("avg_percent"), F.coalesce(F.sum("execution_time_ms"), F.lit(0)).alias("execution_time_ms"))


def by_day(metrics: DataFrame) -> DataFrame:
    """day, executions, tokens before and saved."""
    rows = metrics.groupBy(F.to_date("timestamp").alias("day"))
    return rows.agg(F.count("*").alias("executions"), F.sum(_zero("input_tokens")).alias("input_tokens"), F.sum(_zero("input_tokens") - _zero("output_tokens")).alias("saved_tokens"))
