"""Request counters, latency histograms and alert measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bucket bounds in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "path", "status").agg(F.count("*").alias("requests"))


def latency_histogram(requests: DataFrame, *keys: str) -> DataFrame:
    """keys, le, cumulative: a row for each bucket, the last with le '+Inf'. One pass, one row a key is shuffled."""
    counts = [F.count_if(F.col("seconds") <= b) for b in BOUNDS]
    rows = requests.groupBy(*keys).agg(F.array(*counts, F.count("*")).alias("n"))
    les = F.array(*[F.lit(str(b)) for b in BOUNDS], F.lit("+Inf"))
    return rows.select(*keys, F.explode(F.arrays_zip(les.alias("le"), F.col("n"))).alias("x")).select(*keys, F.col("x.le").alias("le"), F.col("x.n").alias("cumulative"))


def histogram_quantile(q: float, counts: Column) -> Column:
    """Quantile of cumulative counts (one for each bound, then all) by interpolation in its bucket; above the last
    bound, that bound."""
    bounds = F.array(*[F.lit(b) for b in BOUNDS])
    rank = F.element_at(counts, -1) * F.lit(q)
    at = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int")
    lower = F.when(at == 1, F.lit(0.0)).otherwise(F.element_at(bounds, F.greatest(at - 1, F.lit(1))))
    below = F.when(at == 1, F.lit(0)).otherwise(F.element_at(counts, F.greatest(at - 1, F.lit(1))))
    upper = F.element_at(bounds, F.least(at, F.lit(len(BOUNDS))))
    inside = lower + (upper - lower) * (rank - below) / (F.element_at(counts, at) - below)
    return F.when(at > len(BOUNDS), F.lit(BOUNDS[-1])).otherwise(inside)


def error_ratio(requests: DataFrame, span: str = "5 minutes") -> DataFrame:
    """window_start, requests, errors, ratio of statuses from 500 on, for each span of time."""
    rows = requests.groupBy(F.window("ts", span)["start"].alias("window_start")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors")
    )
    return rows.withColumn("ratio", F.col("errors") / F.col("requests"))


def exposition(requests: DataFrame) -> DataFrame:
    """Counters and histograms as lines of Prometheus' text format."""
    by = ["method", "path", "status"]
    slashes = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    label = lambda *more: F.concat(*[p for k in by for p in (F.lit(f'{k}="'), slashes(F.col(k).cast("string")), F.lit('",' if k != by[-1] or more else '"'))], *more)
    line = lambda name, labels, value: F.concat(F.lit(name + "{"), labels, F.lit("} "), value.cast("string")).alias("line")
    counts = request_counts(requests).select(line("http_requests_total", label(), F.col("requests")))
    buckets = latency_histogram(requests, *by).select(line("http_request_duration_seconds_bucket", label(F.lit('le="'), F.col("le"), F.lit('"')), F.col("cumulative")))
    sums = requests.groupBy(*by).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))
    name = "http_request_duration_seconds"
    totals = sums.select(F.explode(F.array(line(f"{name}_sum", label(), F.round("seconds", 6)), line(f"{name}_count", label(), F.col("n")))).alias("line"))
    return counts.unionByName(buckets).unionByName(totals)


#: Thresholds of the alerts.
ERROR_RATIO, P95_SECONDS, LAG, COMPACTION_SECONDS = 0.05, 3.0, 1000.0, 1800.0


def by_window(requests: DataFrame, span: str = "5 minutes") -> DataFrame:
    """window_start, ratio (of statuses from 500 on), p95: the measures of each span of time."""
    counts = F.array(*[F.count_if(F.col("seconds") <= b) for b in BOUNDS], F.count("*"))
    rows = requests.groupBy(F.window("ts", span)["start"].alias("window_start")).agg((F.count_if(F.col("status") >= 500) / F.count("*")).alias("ratio"), counts.alias("n"))
    return rows.select("window_start", "ratio", histogram_quantile(0.95, F.col("n")).alias("p95"))


def held_alerts(requests: DataFrame, span: str = "5 minutes", windows: int = 2) -> DataFrame:
    """window_start, alert, value, firing: errors and latency are over their thresholds in this window and in each of the
    windows before that make up the time that an alert is held for. Windows without requests end it."""
    value = F.explode(F.array(
        F.struct(F.lit("errors").alias("alert"), F.col("ratio").alias("value"), (F.col("ratio") > ERROR_RATIO).alias("over")),
        F.struct(F.lit("latency").alias("alert"), F.col("p95").alias("value"), (F.col("p95") > P95_SECONDS).alias("over")),
    ))
    rows = by_window(requests, span).select("window_start", value.alias("a")).select("window_start", "a.*")
    # A window adds itself to those after it, so that no task sorts all windows.
    held = rows.where("over").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.col("window_start") + k * F.expr(f"INTERVAL {span}"))).alias("window_start"), "alert")
    held = held.groupBy("window_start", "alert").agg(F.count("*").alias("n"))
    joined = rows.join(held, ["window_start", "alert"], "left")
    return joined.select("window_start", "alert", "value", (F.coalesce("n", F.lit(0)) == windows).alias("firing"))


def alerts(requests: DataFrame, lags: DataFrame, compacted_seconds_ago: float) -> DataFrame:
    """alert, value, firing: error ratio, 95th percentile, lag and time since the last compaction, over all that is given."""
    counts = F.array(*[F.count_if(F.col("seconds") <= b) for b in BOUNDS], F.count("*"))
    one = requests.agg((F.count_if(F.col("status") >= 500) / F.count("*")).alias("errors"), counts.alias("n")).select("errors", histogram_quantile(0.95, F.col("n")).alias("p95"))
    worst = lags.agg(F.max("lag").cast("double").alias("lag"))
    rows = one.select(F.explode(F.array(F.struct(F.lit("errors").alias("alert"), F.col("errors").alias("value"), F.lit(ERROR_RATIO).alias("over")), F.struct(F.lit("latency").alias("alert"), F.col("p95").alias("value"), F.lit(P95_SECONDS).alias("over")))).alias("a")).select("a.*")
    rows = rows.unionByName(worst.select(F.lit("lag").alias("alert"), F.col("lag").alias("value"), F.lit(LAG).alias("over")))
    rows = rows.unionByName(worst.select(F.lit("compaction").alias("alert"), F.lit(float(compacted_seconds_ago)).alias("value"), F.lit(COMPACTION_SECONDS).alias("over")))
    return rows.select("alert", "value", (F.col("value") > F.col("over")).alias("firing"))
