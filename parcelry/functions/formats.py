"""Text renderings that must be stable across engines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def timestamp_text(ts: Column) -> Column:
    """RFC 3339 text in UTC as a relational store prints it in JSON.

    ``2022-06-19T05:05:05+00:00``; fractional seconds only when non-zero,
    trailing zeros removed (``...05.12+00:00``).  Null stays null.
    """
    micros = F.unix_micros(ts)
    frac = F.pmod(micros, F.lit(1_000_000))
    frac_txt = F.when(frac != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(frac.cast("string"), 6, "0"), "0+$", ""))).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac_txt, F.lit("+00:00"))
