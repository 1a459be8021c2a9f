"""Latency and device telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import values as V
from cuelake.operators import scan

S = ["session_id"]


def nearest_p95(values: Column) -> Column:
    """``sorted[min(int(0.95 n), n - 1)]``: nearest rank, not interpolated."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(F.floor(n * 0.95), n - 1).cast("int"))


def latency_summary(samples: DataFrame, window: int = V.LATENCY_WINDOW) -> DataFrame:
    """Per session: total count, rate, and mean / p95 / max over the last ``window`` samples."""
    recent = scan.last_rows(samples, S, [F.col("ts").desc(), F.col("event_id").desc()], "event_id", window)
    stats = recent.groupBy("session_id").agg(
        F.avg("latency_ms").alias("mean_ms"), F.collect_list("latency_ms").alias("_x"),
        F.max("latency_ms").alias("max_ms"))
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    totals = samples.groupBy("session_id").agg(F.count("*").alias("n"), span.alias("_span"))
    rate = F.when(F.col("_span") > 0, F.col("n") / F.col("_span")).otherwise(0.0)
    return totals.join(stats, "session_id").select(
        "session_id", "n", "mean_ms", nearest_p95(F.col("_x")).alias("p95_ms"), "max_ms", rate.alias("rate"))


def fleet_metrics(summaries: DataFrame) -> DataFrame:
    """Fleet row; ``mean_ms`` is the unweighted mean of session means, ``weighted_mean_ms`` counts samples."""
    m = F.col("mean_ms")
    return summaries.agg(
        F.bround(F.sum(m) / F.count(F.when(F.col("n") > 0, 1)), 1).alias("mean_ms"),
        F.bround(F.sum(m * F.col("n")) / F.sum("n"), 1).alias("weighted_mean_ms"),
        F.bround(F.max("p95_ms"), 1).alias("p95_ms"), F.bround(F.max("max_ms"), 1).alias("max_ms"),
        F.bround(F.sum("rate"), 3).alias("rate"), F.sum("n").alias("total"))


def latency_breaches(samples: DataFrame, limit_ms: float = V.LATENCY_LIMIT_MS) -> DataFrame:
    return samples.filter(F.col("latency_ms") > limit_ms)


def rolling_latency(samples: DataFrame, window: int = V.LATENCY_WINDOW, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    order = ["ts", "event_id"]
    s = scan.number_rows(scan.range_blocks(samples, S, order), S, order, "_seq")
    x = F.col("latency_ms")
    out = scan.trailing(s, S, "_seq", window, {
        "mean_ms": F.avg(x), "max_ms": F.max(x), "_x": F.collect_list(x)}, rows)
    return out.withColumn("p95_ms", nearest_p95(F.col("_x"))).drop("_x", "_seq")


def rolling_gpu(samples: DataFrame, value: str, window: int = 20, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Mean of the last ``window`` known values per GPU, carried over unknown ones, one decimal (half to even).

    The mean is taken in decimals, so that the rounding does not depend on the order of additions.
    """
    keys, order = ["gpu"], ["ts", "event_id"]
    s = scan.range_blocks(samples, keys, order)
    s = scan.prefix(s, keys, order, {"_k": ("sum", F.col(value).isNotNull().cast("bigint"))}, keep=True)
    s = s.withColumnRenamed(scan.BLK, "_b")
    known = scan.trailing(s.filter(F.col(value).isNotNull()), keys, "_k", window, {"_avg": F.avg(F.col(value).cast("decimal(18,6)"))}, rows)
    unknown = s.filter(F.col(value).isNull()).withColumn("_avg", F.lit(None).cast("decimal(22,10)"))
    both = known.unionByName(unknown).withColumnRenamed("_b", scan.BLK)
    out = scan.prefix(both, keys, order, {f"{value}_avg": ("last", F.bround("_avg", 1).cast("double"))}, keep=True)
    return out.drop("_k", "_avg", scan.BLK)


def rolling_power(samples: DataFrame, window: int = 20, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Mean power of the last ``window`` known values per GPU, and its share of the limit where one is known."""
    s = rolling_gpu(samples, "power_w", window, rows)
    return s.withColumn("power_pct_avg", percent(F.col("power_w_avg"), F.col("power_limit_w")))


def percent(part: Column, whole: Column) -> Column:
    return F.bround(100 * part / F.nullif(whole, F.lit(0.0)), 1)


def gpu_percentages(samples: DataFrame) -> DataFrame:
    return (samples.withColumn("mem_pct", percent(F.col("mem_used_mb"), F.col("mem_total_mb")))
                   .withColumn("power_pct", percent(F.col("power_w"), F.col("power_limit_w"))))


def load_level(pct: Column) -> Column:
    return F.when(pct >= 85, "red").when(pct >= 65, "amber").otherwise("green")


def temperature_level(t: Column) -> Column:
    return F.when(t >= 80, "red").when(t >= 70, "amber").otherwise("green")


def temperature_gauge(t: Column) -> Column:
    return F.least(F.greatest((t - 30) / 0.6, F.lit(0.0)), F.lit(100.0))


def check_video_spec(inputs: DataFrame, max_w: int = 1920, max_h: int = 1080, max_fps: int = 60) -> DataFrame:
    """``ok`` and a reason for inputs above the limits; unknown values pass."""
    def over(c: str, lim: float) -> Column:
        return F.coalesce(F.col(c) > lim, F.lit(False))
    bad = over("width", max_w) | over("height", max_h) | over("fps", max_fps + 0.5)
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    rate = F.when(F.coalesce(F.col("fps"), F.lit(0)) > 0,
                  F.concat(F.lit("@"), F.bround("fps").cast("int").cast("string"), F.lit("fps"))).otherwise("")
    reason = F.concat(F.lit("Source has "), show("width"), F.lit("x"), show("height"), rate,
                      F.lit(f", over {max_w}x{max_h}@{max_fps}"))
    return inputs.withColumn("ok", ~bad).withColumn("reason", F.when(bad, reason))


def tail_rows(log: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """Last ``n`` rows (1..5000) in order; a top-k, not a full sort."""
    n = max(1, min(int(n), 5000))
    return log.orderBy(F.col(seq).desc()).limit(n).orderBy(seq)


class LatencyWindows:
    """Reports of a session at the end of each window that had samples: samples and rate so far, and mean, p95 and max over the last ones.

    State: the last ``recent`` values, how many there were, and the times of the first and newest.
    """

    columns = ("t_us", "latency_ms")
    output = ("window_end_ms bigint", "n bigint", "mean_ms double", "p95_ms double", "max_ms double", "rate double")

    def __init__(self, size_ms: int = 30_000, recent: int = V.LATENCY_WINDOW):
        self.size_us, self.recent = size_ms * 1000, recent

    def start(self):
        return {"recent": [], "n": 0, "first": None, "newest": None}

    def step(self, s, t_us, latency_ms):
        made = self.finish(s) if s["n"] and t_us // self.size_us != s["newest"] // self.size_us else []
        return {"recent": [*s["recent"], float(latency_ms)][-self.recent:], "n": s["n"] + 1, "first": int(t_us) if s["first"] is None else s["first"],
                "newest": int(t_us)}, made

    def finish(self, s):
        if not s["n"]:
            return []
        x, span = sorted(s["recent"]), (s["newest"] - s["first"]) / 1e6
        end = (s["newest"] // self.size_us + 1) * self.size_us // 1000
        return [(end, s["n"], sum(x) / len(x), x[min(int(len(x) * 0.95), len(x) - 1)], x[-1], s["n"] / span if span > 0 else 0.0)]


def latency_windows(samples: DataFrame, size_ms: int = 30_000, recent: int = V.LATENCY_WINDOW, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """The rows of ``LatencyWindows`` over a table, with windows instead of a fold."""
    order, x = ["ts", "event_id"], F.col("latency_ms")
    s = scan.range_blocks(samples.select("session_id", *order, "latency_ms"), S, order)
    s = scan.prefix(s, S, order, {"n": ("sum", F.lit(1).cast("bigint")), "_since": ("max", -F.unix_micros("ts"))}, keep=True)
    s = scan.trailing(s, S, "n", recent, {"mean_ms": F.avg(x), "max_ms": F.max(x), "_x": F.collect_list(x)}, rows)
    end = (F.expr(f"unix_micros(ts) div {size_ms * 1000}") + 1) * size_ms
    last = s.groupBy("session_id", end.alias("window_end_ms")).agg(F.max_by(F.struct("n", "mean_ms", "_x", "max_ms", "_since", "ts"), "n").alias("r"))
    span = (F.unix_micros("r.ts") + F.col("r._since")) / 1e6
    return last.select("session_id", "window_end_ms", "r.n", "r.mean_ms", nearest_p95(F.col("r._x")).alias("p95_ms"), "r.max_ms",
                       F.when(span > 0, F.col("r.n") / span).otherwise(0.0).alias("rate"))


def fleet_windows(reports: DataFrame) -> DataFrame:
    """One row per window over the sessions that report in it: the mean of their means, the worst p95 and max, and the sum of rates."""
    return reports.groupBy("window_end_ms").agg(
        F.count("*").alias("sessions"), F.avg("mean_ms").alias("mean_ms"), F.max("p95_ms").alias("p95_ms"), F.max("max_ms").alias("max_ms"),
        F.sum("rate").alias("rate"))


def windowed_latency(samples: DataFrame, size: str = "30 seconds", keys: tuple = ("session_id",)) -> DataFrame:
    """Tumbling metrics per session (or fleet with ``keys=()``), batch or stream."""
    return samples.groupBy(F.window("ts", size).alias("w"), *keys).agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"))
