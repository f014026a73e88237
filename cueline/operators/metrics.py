"""Operational figures: counters, latencies over a bounded history, and comparisons of two modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.text import classify_error

HISTORY = 100


def counts(events: DataFrame, key: str, name: str = "n") -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias(name))


def last_samples(events: DataFrame, key: str, order: list[str], n: int = HISTORY) -> DataFrame:
    """The last ``n`` rows of each key.  The rank's limit is applied before the shuffle too."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def rank_percentile(sorted_values: Column, p: float) -> Column:
    """The value at place floor(n * p) of a sorted array, counted from 0, not interpolated."""
    return F.element_at(sorted_values, (F.floor(F.size(sorted_values) * p) + 1).cast("int"))


def latency_summary(events: DataFrame, key: str, value: str, order: list[str], n: int = HISTORY) -> DataFrame:
    """(key, count, min, max, avg, p50, p95, p99) over the last ``n`` samples of each key."""
    kept = last_samples(events.where(F.col(value).isNotNull()), key, order, n)
    v = F.array_sort(F.collect_list(value))
    return kept.groupBy(key).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), v.alias("__v")).select(
        key, "count", "min", "max", "avg", *[rank_percentile(F.col("__v"), p / 100).alias(f"p{p}") for p in (50, 95, 99)]
    )


def launch_summary(launches: DataFrame, value: str, order: list[str]) -> DataFrame:
    """One row over the last samples: count, min, max, avg and p95, null when there are none."""
    one = latency_summary(launches.withColumn("__all", F.lit(1)), "__all", value, order)
    empty = launches.sparkSession.range(1).select(F.lit(1).alias("__all"))
    return empty.join(one, "__all", "left").select(F.coalesce("count", F.lit(0)).alias("count"), "min", "max", "avg", "p95")


def trial_summary(trials: DataFrame) -> DataFrame:
    """For each mode of trials (mode, success, duration): totals, success rate in percent, and durations of successes (0 if none)."""
    ok = F.col("success")
    took = F.when(ok, F.col("duration"))
    return trials.groupBy("mode").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        (F.try_divide(F.count_if(ok), F.count("*")) * 100).alias("success_rate"),
        *[F.coalesce(f(took), F.lit(0)).cast("double").alias(f"{n}_duration") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
    )


def error_breakdown(trials: DataFrame) -> DataFrame:
    """(mode, error_type, n) over failures (mode, success, message)."""
    return trials.where(~F.col("success")).withColumn("error_type", classify_error(F.coalesce("message", F.lit("")))).groupBy("mode", "error_type").agg(F.count("*").alias("n"))


def error_map(trials: DataFrame) -> DataFrame:
    """(mode, errors): a map from error type to its count."""
    return error_breakdown(trials).groupBy("mode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("errors"))


def recommendation(stealth_rate: Column, raw_rate: Column, stealth_blocked: Column, raw_blocked: Column) -> Column:
    """Which mode to prefer: blocks of the raw mode first, then the difference in success rates."""
    diff = stealth_rate - raw_rate
    return (
        F.when((raw_blocked > stealth_blocked) & (raw_blocked > 5), "KEEP_MANDATORY")
        .when(diff < -10, "DISABLE").when(diff > 5, "KEEP_RECOMMENDED").otherwise("NO_CLEAR_WINNER")
    )


def task_gauges(tasks: DataFrame, status: str = "status") -> DataFrame:
    """One row: pending, active, completed, failed and total tasks."""
    return tasks.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("pending", "active", "completed", "failed")], F.count("*").alias("total"))


def settled(results: DataFrame, ok: str = "success") -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("fulfilled"), F.count_if(~F.col(ok)).alias("rejected"))


def daily(events: DataFrame, at: str, success: Column, value: str) -> DataFrame:
    """(day, total, successful, failed, avg_value) for each day."""
    return events.groupBy(F.to_date(at).alias("day")).agg(
        F.count("*").alias("total"), F.count_if(success).alias("successful"), F.count_if(~success).alias("failed"), F.avg(value).alias("avg_value")
    )


def percentiles(events: DataFrame, key: str, value: str, accuracy: int | None = None) -> DataFrame:
    """(key, p50, p95, p99) over all values: interpolated, or, with an ``accuracy``, within a share of 1 / accuracy of the ranks.

    Interpolation keeps the distinct values of a key in one task; a key with very many of them asks for an accuracy.
    """
    if accuracy:
        return events.groupBy(key).agg(*[F.percentile_approx(value, p / 100, accuracy).alias(f"p{p}") for p in (50, 95, 99)])
    return events.groupBy(key).agg(*[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)])


def daily_sketches(events: DataFrame, key: str, value: str, at: str, k: int = 200) -> DataFrame:
    """(day, key, sketch, n): a KLL sketch of each day's values, a few kilobytes however many there are.

    Sketches are begun where the events are and merged after the shuffle, so a key with most
    of the events is no task's whole work.  Null values are left out.
    """
    known = events.where(F.col(value).isNotNull())
    return known.groupBy(F.to_date(at).alias("day"), key).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count("*").alias("n"))


def merged_percentiles(sketches: DataFrame, key: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(key, n, p50, p95, ...) of any set of daily sketches; ranks are off by about 1.3 percent of the values at most."""
    merged = sketches.groupBy(key).agg(F.kll_merge_agg_double("sketch").alias("__s"), F.sum("n").alias("n"))
    return merged.select(key, "n", *[F.kll_sketch_get_quantile_double("__s", F.lit(p / 100)).alias(f"p{p}") for p in percents])


def running_tokens(deltas: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """The running estimate of tokens after each delta of a stream of text: a quarter of its characters, rounded up for each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("tokens", F.sum(F.ceil(F.length(text) / 4)).over(w))


def rotated(trials: DataFrame, ordinal: str, inputs: list, name: str = "input") -> DataFrame:
    """Trials with the input whose turn it is: the ordinal modulo the number of inputs, from the first."""
    return trials.withColumn(name, F.get(F.array(*map(F.lit, inputs)), F.pmod(F.col(ordinal), F.lit(len(inputs))).cast("int")))


def metric_records(events: DataFrame, operation: str, duration: str, context: list[str] | None = None) -> DataFrame:
    """Log records (level, message, operation, duration, metric, *context) of timed operations."""
    return events.select(
        F.lit("info").alias("level"), F.concat(F.lit("Performance: "), F.col(operation)).alias("message"), F.col(operation).alias("operation"),
        F.col(duration).alias("duration"), F.lit(True).alias("metric"), *(context or []),
    )


def request_records(requests: DataFrame, context: list[str] | None = None) -> DataFrame:
    """Log records of requests (method, path, status_code, duration)."""
    said = F.concat_ws(" ", F.lit("HTTP"), "method", "path", F.col("status_code").cast("string"))
    return requests.select(F.lit("info").alias("level"), said.alias("message"), "method", "path", "status_code", "duration", *(context or []))


def newer_than(source: DataFrame, target: DataFrame, mark: str) -> DataFrame:
    """Rows of the source past the target's high-water mark; all of them if the target is empty.

    The mark is read first, so that it stands in the source's filter and row groups before it are skipped.
    """
    top = target.agg(F.max(mark)).first()[0]
    return source if top is None else source.where(F.col(mark) > F.lit(top))
