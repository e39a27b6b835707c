"""Request-log analytics: summary, time series, taxonomies, top users, calibration, pages.

Everything is one filtered scan and one aggregation with partial sums.  Percentiles
are exact and discrete (the ceil rule), null on no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
LADDER = ((2 * 3600, 60), (24 * 3600, 300), (7 * 86400, 1800), (31 * 86400, 3600))
INTERVALS = (60, 300, 900, 1800, 3600, 21600, 86400)
MAX_BUCKETS, MAX_WINDOW_DAYS = 1000, 90


@dataclass(frozen=True)
class Filters:
    """What a monitoring query may ask for; start and end (half-open) are required."""

    start: str
    end: str
    gateway_id: int | None = None
    model_name: str | None = None
    status_class: str | None = None
    end_user_id: int | None = None
    streamed: bool | None = None
    min_latency_ms: int | None = None
    search: str | None = None
    uncited: bool | None = None
    template: str | None = None
    session: str | None = None

    def __post_init__(self):
        days = (datetime.fromisoformat(self.end) - datetime.fromisoformat(self.start)).total_seconds() / 86400
        if not 0 < days <= MAX_WINDOW_DAYS:
            raise ValueError(f"the window must end after it starts and span at most {MAX_WINDOW_DAYS} days")
        if self.status_class not in (None, "2xx", "3xx", "4xx", "5xx"):
            raise ValueError(f"unknown status class {self.status_class!r}")

    def column(self) -> Column:
        at = F.col("created_at")
        out = (at >= F.lit(self.start).cast("timestamp_ntz")) & (at < F.lit(self.end).cast("timestamp_ntz"))
        for name in ("gateway_id", "model_name", "end_user_id", "streamed", "template", "session"):
            if (v := getattr(self, name)) is not None:
                out &= F.col(name) == v
        if self.status_class:
            low = int(self.status_class[0]) * 100
            out &= F.col("status_code").between(low, low + 99)
        if self.min_latency_ms is not None:
            out &= F.col("latency_total_ms") >= self.min_latency_ms
        if self.search:
            wanted = F.lit(self.search.lower())
            out &= F.contains(F.lower(F.coalesce("error_code", F.lit(""))), wanted) | F.contains(F.lower(F.coalesce("error_message", F.lit(""))), wanted)
        if self.uncited is not None:
            out &= injected() & (F.col("n_cited") == 0 if self.uncited else F.col("n_cited") > 0)
        return out

    def sql(self) -> str:
        """The same condition for DuckDB."""
        out = [f"created_at >= timestamp '{self.start}'", f"created_at < timestamp '{self.end}'"]
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name in ("gateway_id", "model_name", "end_user_id", "streamed", "template", "session") and v is not None:
                out.append(f"{f.name} = {v!r}")
        if self.status_class:
            out.append(f"status_code // 100 = {self.status_class[0]}")
        if self.min_latency_ms is not None:
            out.append(f"latency_total_ms >= {self.min_latency_ms}")
        if self.search:
            wanted = self.search.lower().replace("'", "''")
            out.append(f"(contains(lower(coalesce(error_code, '')), '{wanted}') or contains(lower(coalesce(error_message, '')), '{wanted}'))")
        if self.uncited is not None:
            out.append(f"status_code < 400 and coalesce(n_retrieved, 0) > 0 and n_cited {'= 0' if self.uncited else '> 0'}")
        return " and ".join(out)


def injected() -> Column:
    """Retrieval put something into a prompt that was answered."""
    return (F.col("status_code") < 400) & (F.coalesce("n_retrieved", F.lit(0)) > 0)


def status_class(code: str = "status_code") -> Column:
    return F.concat(F.floor(F.col(code) / 100).cast("string"), F.lit("xx"))


def percentiles(col: str, prefix: str) -> list[Column]:
    """Exact discrete percentiles of what is known, as int."""
    return [F.expr(f"cast(percentile_disc({p}) within group (order by {col}) as int)").alias(f"{prefix}_{n}") for n, p in P]


def _rate(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def summary(log: DataFrame, filters: Filters) -> DataFrame:
    """One row: counts, sums, percentiles and rates."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    tried = F.col("latency_retrieval_ms").isNotNull()
    out = log.where(filters.column()).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        *percentiles("latency_total_ms", "total"),
        *percentiles("latency_ttft_ms", "ttft"),
        *percentiles("latency_retrieval_ms", "retrieval"),
        total("prompt_tokens"),
        total("completion_tokens"),
        F.count_if(tried).alias("retrieval_attempts"),
        F.count_if(tried & (F.col("n_retrieved") == 0)).alias("retrieval_empty"),
        F.count_if(injected()).alias("injected_requests"),
        F.count_if(injected() & (F.col("n_cited") == 0)).alias("uncited_requests"),
    )
    return out.withColumns(
        {
            "error_rate": _rate("errors", "requests"),
            "empty_retrieval_rate": _rate("retrieval_empty", "retrieval_attempts"),
            "uncited_rate": _rate("uncited_requests", "injected_requests"),
        }
    )


def choose_interval(seconds: int, requested: int | None = None) -> int:
    """Bucket width for a window: by its length or as asked for, coarsened until there are at most 1000 buckets."""
    want = requested or next((w for most, w in LADDER if seconds <= most), 86400)
    want = next((w for w in INTERVALS if w >= want), INTERVALS[-1])
    while seconds / want > MAX_BUCKETS and want < INTERVALS[-1]:
        want = INTERVALS[INTERVALS.index(want) + 1]
    return want


def _series(metric: str) -> dict[str, Column]:
    tried = F.col("latency_retrieval_ms").isNotNull()
    if metric == "requests":
        return {"requests": F.count("*"), "errors": F.count_if(F.col("status_code") >= 400)}
    if metric == "tokens":
        return {c: F.coalesce(F.sum(f"{c}_tokens"), F.lit(0)) for c in ("prompt", "completion")}
    if metric == "retrieval":
        return {
            "attempts": F.count_if(tried),
            "empty_rate": F.try_divide(F.count_if(tried & (F.col("n_retrieved") == 0)), F.count_if(tried)),
        }
    if metric == "latency":
        return {n: F.expr(f"percentile_disc({p}) within group (order by latency_total_ms)") for n, p in P}
    raise ValueError(f"unknown metric {metric!r}")


def grouping(group_by: str | None) -> Column:
    if group_by is None:
        return F.lit(None).cast("string")
    return {"status": status_class(), "model": F.coalesce("model_name", F.lit("(unknown)")), "gateway": F.col("gateway_id").cast("string")}[group_by]


def timeseries(log: DataFrame, filters: Filters, metric: str, interval_seconds: int, group_by: str | None = None) -> DataFrame:
    """bucket, grouping, series, value; buckets are anchored at the epoch, empty ones and null values are absent."""
    named = _series(metric)
    wide = (
        log.where(filters.column())
        .groupBy(F.window("created_at", f"{interval_seconds} seconds").alias("w"), grouping(group_by).alias("grouping"))
        .agg(*(c.cast("double").alias(n) for n, c in named.items()))
    )
    stack = ", ".join(f"'{n}', `{n}`" for n in named)
    return wide.select(F.col("w.start").alias("bucket"), "grouping", F.expr(f"stack({len(named)}, {stack}) as (series, value)")).where("value is not null")


def wide(series: DataFrame) -> DataFrame:
    """bucket and a map from `group.series` (the series alone, if ungrouped) to its value."""
    name = F.concat(F.coalesce(F.concat("grouping", F.lit(".")), F.lit("")), F.col("series"))
    return series.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct(name.alias("name"), "value"))).alias("values"))


def taxonomy(log: DataFrame, filters: Filters) -> DataFrame:
    """Requests by status class, error code and model."""
    keys = [status_class().alias("status_class"), F.coalesce("error_code", F.lit("")).alias("error_code"), grouping("model").alias("model_name")]
    return log.where(filters.column()).groupBy(*keys).agg(F.count("*").alias("requests"))


def throttled_end_users(log: DataFrame, users: DataFrame, filters: Filters, limit: int = 10) -> DataFrame:
    """Users with most rate-limited requests; counts come before the join, so only few rows meet the users."""
    counts = log.where(filters.column() & (F.col("error_code") == "rate_limited")).groupBy("end_user_id").agg(F.count("*").alias("throttled"))
    return counts.join(users, "end_user_id").orderBy(F.desc("throttled"), "end_user_id").limit(limit)


def template_fingerprints(log: DataFrame, filters: Filters) -> DataFrame:
    out = log.where(filters.column()).groupBy("template").agg(F.min("created_at").alias("first_seen"), F.count("*").alias("requests"))
    return out.orderBy("first_seen", "template")


def calibration(log: DataFrame, filters: Filters, chars_per_token: float = 4.0, drift: float = 0.15) -> DataFrame:
    """Reported against estimated prompt tokens by model and tokenizer, and the characters a token that would make them agree."""
    ok = (F.col("status_code") < 400) & F.col("prompt_tokens").isNotNull() & F.col("estimated_prompt_tokens").isNotNull() & F.col("model_name").isNotNull() & F.col("tokenizer").isNotNull()
    sums = log.where(filters.column() & ok).groupBy("model_name", "tokenizer").agg(
        F.sum("estimated_prompt_tokens").alias("estimated"), F.sum("prompt_tokens").alias("reported"), F.count("*").alias("samples")
    )
    ratio = F.try_divide(F.col("reported"), F.col("estimated"))
    return sums.withColumn("ratio", F.round(ratio, 6)).withColumns(
        {
            "drifts": F.coalesce(F.abs(ratio - 1) > drift, F.lit(False)),
            "proposed": F.round(F.greatest(F.lit(1.0), F.least(F.lit(20.0), F.try_divide(F.lit(chars_per_token), ratio))), 3),
        }
    )


def logs(log: DataFrame, filters: Filters, after: int | None = None, limit: int = 50) -> DataFrame:
    """A page of the newest rows: at most `limit` (up to 200) with ids below `after`. Spark keeps only the top rows of each task."""
    rows = log.where(filters.column())
    if after is not None:
        rows = rows.where(F.col("id") < after)
    return rows.orderBy(F.desc("id")).limit(min(limit, 200))


def drift_window(log: DataFrame, samples: int = 256) -> DataFrame:
    """Rolling ratio of sums over the last `samples` rows of each model."""
    from pyspark.sql import Window

    w = Window.partitionBy("model_name").orderBy("created_at", "id").rowsBetween(1 - samples, 0)
    rows = log.where("prompt_tokens is not null and estimated_prompt_tokens is not null and model_name is not null")
    ratio = F.try_divide(F.sum("prompt_tokens").over(w), F.sum("estimated_prompt_tokens").over(w))
    return rows.select("id", "model_name", F.round(ratio, 6).alias("ratio"))


# Metric-style queries: rates, ratios, quantiles of histograms, gauges over time, alerts with a duration.


def rate(log: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    return log.groupBy(F.window("created_at", f"{seconds} seconds").start.alias("bucket"), F.col(key).alias("key")).agg((F.count("*") / seconds).alias("per_second"))


def error_ratio(log: DataFrame, seconds: int = 3600) -> DataFrame:
    share = F.count_if(F.col("status_code") >= 500) / F.greatest(F.count("*").cast("double"), F.lit(0.001))
    return log.groupBy(F.window("created_at", f"{seconds} seconds").start.alias("bucket")).agg(share.alias("ratio"))


BOUNDS = (50, 100, 200, 400, 800, 1600, 3200)


def histogram_quantile(log: DataFrame, q: float, key: str = "gateway_id") -> DataFrame:
    """Linear interpolation within cumulative buckets; what lies over the last bound counts as that bound."""
    counts = [F.count_if(F.col("latency_total_ms") <= b).alias(f"b{b}") for b in BOUNDS]
    wide = log.groupBy(key).agg(F.count("latency_total_ms").alias("n"), *counts)
    out = F.lit(float(BOUNDS[-1]))
    for low, b in reversed(list(zip((0, *BOUNDS), BOUNDS, strict=False))):
        before = F.col(f"b{low}") if low else F.lit(0)
        inside = F.lit(float(low)) + (b - low) * (q * F.col("n") - before) / (F.col(f"b{b}") - before)
        out = F.when(F.col(f"b{b}") >= q * F.col("n"), inside).otherwise(out)
    return wide.select(key, F.round(out, 6).alias("quantile"))


def min_over_time(log: DataFrame, days: int = 1) -> DataFrame:
    """Smallest latency of each gateway's last `days`, at every full hour with requests."""
    from pyspark.sql import Window

    hours = log.groupBy("gateway_id", F.window("created_at", "1 hour").start.alias("bucket")).agg(F.min("latency_total_ms").alias("low"))
    at = F.unix_seconds(F.col("bucket").cast("timestamp"))
    w = Window.partitionBy("gateway_id").orderBy(at).rangeBetween(-86400 * days, 0)
    return hours.select("gateway_id", "bucket", F.min("low").over(w).alias("min_over_time"))


def alerts(ratios: DataFrame, above: float, seconds: int, least: int) -> DataFrame:
    """Stretches of `least` or more neighbouring buckets whose ratio is over `above`."""
    from pyspark.sql import Window

    hot = ratios.where(F.col("ratio") > above).withColumn("n", (F.unix_seconds(F.col("bucket").cast("timestamp")) / seconds).cast("bigint"))
    hot = hot.withColumn("island", F.col("n") - F.row_number().over(Window.orderBy("n")))
    out = hot.groupBy("island").agg(F.min("bucket").alias("since"), F.max("bucket").alias("until"), F.count("*").alias("buckets"))
    return out.where(F.col("buckets") >= least).drop("island")


def min_by_gauge(samples: DataFrame) -> DataFrame:
    """The least of each gauge's newest values (several sources may report at one time)."""
    newest = samples.groupBy("gauge", "ts").agg(F.min("value").alias("low"))
    return newest.groupBy("gauge").agg(F.max_by("low", "ts").alias("low"))
