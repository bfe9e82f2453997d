"""Range evaluation of sampled counters (D1, D4, D5, D21): ``rate(x[5m])`` and kin.

At every step ``t`` the range is ``(t - range, t]``.  ``increase`` and ``rate``
are reset-aware and extrapolated to the edges of the range as Prometheus
does; ``irate`` is the slope of the last two samples.

Plan.  Resets need the previous sample, also across the edges of buckets: a
window finds it inside a bucket of one range, and the first sample of a
bucket takes the last one of the bucket before, read off a small table of
one row per series and bucket.  So a hot series is split by time.  Then
samples are folded to cells (greatest common divisor of range and step)
holding count, first sample, last sample and the sum of increases; that is
combined map-side.  A range is the union of whole cells: its raw increase is
the sum over its cells less the step into its first sample (a difference of
prefix sums), so cells, not samples, are fanned out to the steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelry.operators.series import RANGE_SECONDS, STEP_SECONDS

# Fixed value: gap, in mean sample distances, up to which a range is extrapolated to its edge.
EDGE_FACTOR = 1.1


def _steps(samples: DataFrame, range_us: int) -> DataFrame:
    """Samples with ``prev_us`` and the reset-aware ``delta`` to the previous sample of the series (null for the first)."""
    has_id = "sample_id" in samples.columns
    s = samples.filter(F.col("value").isNotNull() & F.col("ts").isNotNull()).select(
        "series", F.unix_micros("ts").alias("us"), (F.col("sample_id") if has_id else F.lit(None)).cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    s = s.withColumn("bucket", F.expr(f"(us - pmod(us, {range_us})) div {range_us}"))
    place = F.struct("us", "id", "value")
    ends = s.groupBy("series", "bucket").agg(F.max(place).alias("end"))
    before = ends.select(F.col("series").alias("_s"), F.col("bucket").alias("_b"),
                         F.lag("end").over(Window.partitionBy("series").orderBy("bucket")).alias("_end"))
    w = Window.partitionBy("series", "bucket").orderBy("us", "id", "value")
    s = s.withColumn("_prev", F.lag(place).over(w))
    j = s.join(before, F.col("series").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")), "left")
    prev = F.coalesce(F.col("_prev"), F.col("_end"))
    delta = F.when(F.col("value") < prev["value"], F.col("value")).otherwise(F.col("value") - prev["value"])
    return j.select("series", "us", "id", "value", prev["us"].alias("prev_us"), delta.alias("delta"))


def range_vectors(samples: DataFrame, range_s: int = RANGE_SECONDS, step_s: int = STEP_SECONDS) -> DataFrame:
    """One row per series and step whose range holds a sample.

    ``samples``: ``series``, ``ts``, ``value`` and optionally ``sample_id`` (orders samples
    of one instant).  Output: ``series``, ``at`` (the step), ``n_samples``, ``raw_increase``
    (inside the range, resets corrected) and ``increase``, ``rate``, ``irate``,
    null where the range holds fewer than two samples or these span no time.
    """
    grain = math.gcd(range_s, step_s)
    us = 1_000_000
    s = _steps(samples, range_s * us)
    first = F.struct("us", "id", "value", "delta")
    last = F.struct("us", "id", "value", "delta", "prev_us")
    cell = F.expr(f"(us - pmod(us, {grain * us})) div {grain * us}") + F.expr(f"if(pmod(us, {grain * us}) > 0, 1, 0)")
    cells = s.groupBy("series", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.max(last).alias("last"), F.sum(F.coalesce("delta", F.lit(0.0))).alias("up"))
    # steps t = k * step with (cell - 1) * grain >= t - range and cell * grain <= t
    end = F.col("cell") * grain
    low = F.ceil(end / step_s).cast("long")
    high = F.floor((end - grain + range_s) / step_s).cast("long")
    fan = cells.filter(low <= high).select("*", F.explode(F.sequence(low, high)).alias("k"))
    g = fan.groupBy("series", "k").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("up").alias("up"))
    g = g.select("series", (F.col("k") * step_s).alias("t"), "n", "first", "last",
                 (F.col("up") - F.coalesce(F.col("first.delta"), F.lit(0.0))).alias("raw"))
    increase = _extrapolated(F.col("raw"), F.col("first.value"), F.col("first.us"), F.col("last.us"), F.col("n"), F.col("t"), range_s)
    two = F.col("n") >= 2
    slope = F.try_divide(F.col("last.delta"), (F.col("last.us") - F.col("last.prev_us")) / 1e6)
    return g.select("series", F.timestamp_seconds("t").alias("at"), F.col("n").alias("n_samples"), F.col("raw").alias("raw_increase"),
                    F.when(two, increase).alias("increase"), F.when(two, increase / range_s).alias("rate"), F.when(two, slope).alias("irate"))


def _extrapolated(raw: Column, first_value: Column, first_us: Column, last_us: Column, n: Column, t: Column, range_s: int) -> Column:
    """The increase over the whole range from the one between its first and last sample.

    The range is prolonged to an edge if the nearest sample lies within
    ``EDGE_FACTOR`` mean distances of it, else by half a distance; never back
    beyond the point where the counter would have been zero.
    """
    span = (last_us - first_us) / 1e6
    mean = F.try_divide(span, (n - 1).cast("double"))
    near = mean * EDGE_FACTOR
    to_start = first_us / 1e6 - (t - range_s)
    to_end = t - last_us / 1e6
    to_start = F.when(to_start >= near, mean / 2).otherwise(to_start)
    to_zero = F.when((raw > 0) & (first_value >= 0), span * F.try_divide(first_value, raw)).otherwise(to_start)
    to_end = F.when(to_end >= near, mean / 2).otherwise(to_end)
    return raw * F.try_divide(span + F.least(to_start, to_zero) + to_end, span)
