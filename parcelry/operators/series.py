"""Operational series: logs, counts, rates, histograms, quantiles, lag.

Inputs are event-shaped logs (one row per request / outcome / cache lookup)
or sampled series (``series, ts, value``).  Everything is expressed with
aggregations that combine map-side, so a single hot label value (say one
status holding a third of all rows) is reduced before any shuffle.  Where a
computation needs row order (counter deltas, trailing counts) it is
partitioned by *(series, time bucket)*, never by the series alone, so one
hot series is spread over its time buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Histogram bucket upper bounds of the original metrics.
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
CACHE_BUCKETS = [0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25]
DB_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]

RANGE_SECONDS = 300        # the dashboards' [5m]
STEP_SECONDS = 60          # our evaluation step for sliding windows

# Route templating and gauge colour thresholds.
ORDER_PREFIX = "/orders/"
ORDER_ROUTE = "/orders/:id"
BAND_ORANGE, BAND_RED = 80.0, 90.0


# --------------------------------------------------------------------------
# paths
# --------------------------------------------------------------------------

def normalized_path(path: Column) -> Column:
    """``/orders/<anything>`` -> ``/orders/:id``; other paths unchanged."""
    return F.when(path.startswith(ORDER_PREFIX), F.lit(ORDER_ROUTE)).otherwise(path)


def path_order_uid(path: Column) -> Column:
    """The uid after ``/orders/``; null for other paths or an empty uid."""
    return F.when(path.startswith(ORDER_PREFIX),
                  F.nullif(F.substring(path, len(ORDER_PREFIX) + 1, 1 << 30), F.lit("")))


def url_path(url: Column) -> Column:
    """Path part of an absolute URL (before ``?`` / ``#``)."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


# --------------------------------------------------------------------------
# counts
# --------------------------------------------------------------------------

def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def requests_by_route(requests: DataFrame) -> DataFrame:
    """A4: requests by method, templated path and code."""
    r = requests.select("method", normalized_path(F.col("path")).alias("path"), "code")
    return counts_by(r, "method", "path", "code")


def hit_miss_counts(lookups: DataFrame) -> DataFrame:
    """Hits, misses and the hit ratio in one aggregate."""
    return lookups.agg(
        F.count_if(F.col("hit")).alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
    ).select("hits", "misses",
             F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 6).alias("hit_ratio"))


# --------------------------------------------------------------------------
# Histograms and histogram_quantile
# --------------------------------------------------------------------------

def histogram(df: DataFrame, value: str, keys: list[str], bounds: list[float] = DEFAULT_BUCKETS) -> DataFrame:
    """A5: cumulative bucket counts in ONE pass.

    Per group: ``cum`` (count with value <= le for every bound, plus +Inf),
    ``count`` and ``sum``.  One hash aggregate with partial aggregation.
    """
    v = F.col(value)
    aggs = [F.count_if(v <= b).alias(f"_le{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"))
    return g.select(*keys,
                    F.array(*[F.col(f"_le{i}") for i in range(len(bounds))], F.col("count")).alias("cum"),
                    "count", "sum")


def histogram_rows(hist: DataFrame, keys: list[str], bounds: list[float] = DEFAULT_BUCKETS) -> DataFrame:
    """One row per (group, le) with the cumulative count; le '+Inf' last."""
    les = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    z = hist.select(*keys, "count", "sum", F.posexplode(F.arrays_zip(les.alias("le"), F.col("cum").alias("n"))).alias("i", "b"))
    return z.select(*keys, F.col("b.le").alias("le"), F.col("b.n").alias("cum_count"),
                    F.col("count").alias("total_count"), F.round("sum", 6).alias("sum_value"))


def histogram_quantile(q: float, cum: Column, bounds: list[float] = DEFAULT_BUCKETS) -> Column:
    """Quantile from cumulative buckets, Prometheus style.

    rank = q * total; the first bucket whose cumulative count >= rank; linear
    interpolation inside it (lower bound 0 for the first bucket); a rank in
    the +Inf bucket returns the highest finite bound; empty -> NaN.
    """
    b = F.array(*[F.lit(float(x)) for x in bounds])
    n = len(bounds)
    total = F.element_at(cum, n + 1).cast("double")
    rank = F.lit(q) * total
    # 1-based index of the first cumulative count >= rank
    idx = F.array_position(F.transform(cum, lambda c: c.cast("double") >= rank), True)
    upper = F.element_at(b, F.least(idx, F.lit(n)).cast("int"))
    lower = F.when(idx <= 1, F.lit(0.0)).otherwise(F.element_at(b, F.greatest(idx - 1, F.lit(1)).cast("int")))
    c_hi = F.element_at(cum, idx.cast("int")).cast("double")
    c_lo = F.when(idx <= 1, F.lit(0.0)).otherwise(F.element_at(cum, F.greatest(idx - 1, F.lit(1)).cast("int")).cast("double"))
    interp = lower + (upper - lower) * (rank - c_lo) / (c_hi - c_lo)
    return (F.when(total <= 0, F.lit(float("nan")))
            .when(idx > n, F.element_at(b, n))
            .when(c_hi == c_lo, upper)
            .otherwise(interp))


# --------------------------------------------------------------------------
# Sliding-window rates
# --------------------------------------------------------------------------

def window_rate(df: DataFrame, ts: str, keys: list[str], range_s: int = RANGE_SECONDS,
                step_s: int = STEP_SECONDS) -> DataFrame:
    """Events per second over sliding windows ``[start, start + range)``
    every ``step``, for any range and step (the batch twin of
    ``window(ts, '5 minutes', '1 minute')``; with a step beyond the range,
    rows between two windows are in none).

    Plan: count per (bucket, keys) first (partial aggregation; a bucket is
    the greatest common divisor of range and step wide), then fan each
    bucket count out to the windows that contain it and sum.  The fan-out
    multiplies bucket counts, not raw rows.
    """
    grain = math.gcd(range_s, step_s)
    bucket = F.floor(F.unix_seconds(F.col(ts)) / grain) * grain
    per = df.groupBy(bucket.cast("long").alias("_b"), *keys).agg(F.count(F.lit(1)).alias("_n"))
    # windows start at multiples of the step; the last to hold the bucket
    # starts at or before it, the first ends with it
    last = F.floor(F.col("_b") / step_s) * step_s
    more = F.floor((last - (F.col("_b") + grain - range_s)) / step_s)
    fan = per.filter(more >= 0).select(*keys, "_n", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), more.cast("long")), lambda j: last - j * step_s)).alias("_start"))
    g = fan.groupBy(F.timestamp_seconds("_start").alias("window_start"), *keys).agg(F.sum("_n").alias("n"))
    return g.select("window_start", *keys, "n", F.round(F.col("n") / range_s, 6).alias("rate"))


# --------------------------------------------------------------------------
# Sampled counters, reset-aware
# --------------------------------------------------------------------------

def _range_start(ts: Column, range_s: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / range_s) * range_s)


def _sample_order(samples: DataFrame) -> list[Column]:
    """Time, then the sample's id (if it has one), then its value: the order of a series is total."""
    ids = [F.col("sample_id")] if "sample_id" in samples.columns else []
    return [F.col("ts"), *ids, F.col("value")]


def counter_deltas(samples: DataFrame, range_s: int = RANGE_SECONDS) -> DataFrame:
    """Per sample: ``window_start`` of its tumbling range and the reset-aware
    delta to the previous sample *in the same range* (null for the first).

    Range functions only pair samples inside one range, so the window is
    partitioned by (series, range start): a hot series is split by time.
    """
    s = samples.withColumn("window_start", _range_start(F.col("ts"), range_s))
    order = _sample_order(samples)
    w = Window.partitionBy("series", "window_start").orderBy(*order)
    prev = F.lag("value").over(w)
    prev_ts = F.lag("ts").over(w)
    return s.select("series", "window_start", "ts", "value", F.struct(*order).alias("place"),
                    F.when(prev.isNull(), F.lit(None)).when(F.col("value") < prev, F.col("value"))
                    .otherwise(F.col("value") - prev).alias("delta"),
                    (F.unix_micros(F.col("ts")) - F.unix_micros(prev_ts)).alias("dt_us"))


def counter_increase(samples: DataFrame, range_s: int = RANGE_SECONDS) -> DataFrame:
    """Increase per (series, range) with resets; rate = increase / range.
    Deviation: no extrapolation to the range edges."""
    d = counter_deltas(samples, range_s)
    g = d.groupBy("series", "window_start").agg(
        F.coalesce(F.sum("delta"), F.lit(0)).cast("double").alias("increase"),
        F.count(F.lit(1)).alias("n_samples"))
    return g.withColumn("rate", F.round(F.col("increase") / range_s, 6))


def counter_irate(samples: DataFrame, range_s: int = RANGE_SECONDS) -> DataFrame:
    """D1 (inner part): per (series, range) the rate between the last two
    samples of the range, reset-aware; ranges with one sample are absent."""
    d = counter_deltas(samples, range_s).filter(F.col("delta").isNotNull())
    last = d.groupBy("series", "window_start").agg(F.max_by(F.struct("delta", "dt_us"), "place").alias("l"))
    # two samples of one instant have no rate between them
    return last.select("series", "window_start", F.try_divide(F.col("l.delta"), F.col("l.dt_us") / 1e6).alias("irate"))


# --------------------------------------------------------------------------
# Gauges: D2, D16, D19
# --------------------------------------------------------------------------

def latest_non_null(samples: DataFrame) -> DataFrame:
    """Per series the latest non-null value (nulls filtered first;
    ``max_by`` alone would return a null value)."""
    order = F.struct(*_sample_order(samples))
    return samples.filter(F.col("value").isNotNull()).groupBy("series").agg(
        F.max_by("value", order).alias("value"), F.max("ts").alias("ts"))


def status_text(v: Column) -> Column:
    """D16 value mapping: 0 -> FAIL, 1 -> OK."""
    return F.when(v == 0, F.lit("FAIL")).when(v == 1, F.lit("OK"))


def gauge_band(pct: Column) -> Column:
    """Green, orange from 80, red from 90."""
    return (F.when(pct >= BAND_RED, F.lit("red")).when(pct >= BAND_ORANGE, F.lit("orange"))
            .when(pct.isNotNull(), F.lit("green")))


# --------------------------------------------------------------------------
# T4: consumer lag
# --------------------------------------------------------------------------

def consumer_lag(offsets: DataFrame) -> DataFrame:
    """high - committed; with no commit (offset < 0) high - low; floor 0."""
    lag = F.when(F.col("committed") < 0, F.col("high") - F.col("low")).otherwise(F.col("high") - F.col("committed"))
    return offsets.select("topic", "partition", F.greatest(F.lit(0), lag).cast("long").alias("lag"))


# --------------------------------------------------------------------------
# Recently used keys
# --------------------------------------------------------------------------

def recently_used(access: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` most recently touched distinct keys.

    ``groupBy(key).max(ts)`` combines map-side (a hot key costs one row per
    task), then a top-k (TakeOrderedAndProject keeps k rows per task)."""
    last = access.groupBy("key").agg(F.max("ts").alias("last_ts"))
    top = last.orderBy(F.col("last_ts").desc(), F.col("key")).limit(capacity)
    return top.select(F.row_number().over(Window.orderBy(F.col("last_ts").desc(), F.col("key"))).alias("rank"),
                      "key", "last_ts")


# --------------------------------------------------------------------------
# Trailing-range count per row, exact and skew-safe
# --------------------------------------------------------------------------

def trailing_count(df: DataFrame, key: str, ts: str, range_s: int = RANGE_SECONDS) -> DataFrame:
    """Per row: rows of the same key with time in ``(ts - range, ts]``.

    Rows are bucketed by ``range`` and each row is also copied ("ghost") into
    the next bucket.  A row's trailing range lies inside its own bucket and
    the previous one, so a range frame partitioned by (key, bucket) is exact,
    and a hot key is spread over its buckets instead of one task.
    """
    b = F.floor(F.unix_seconds(F.col(ts)) / range_s).cast("long")
    x = df.select("*", F.explode(F.array(F.struct(b.alias("bucket"), F.lit(False).alias("ghost")),
                                         F.struct((b + 1).alias("bucket"), F.lit(True).alias("ghost")))).alias("_c"))
    x = x.select("*", F.col("_c.bucket").alias("_bucket"), F.col("_c.ghost").alias("_ghost"),
                 F.unix_micros(F.col(ts)).alias("_us")).drop("_c")
    w = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-(range_s * 1_000_000 - 1), 0)
    out = x.select("*", F.count(F.lit(1)).over(w).alias("n_trailing")).filter(~F.col("_ghost"))
    return out.drop("_bucket", "_ghost", "_us")
