"""Exact quantiles of a column by counting in ever finer bins, so that no task holds all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def order_statistics(d: DataFrame, col: str, places: list[int], low: float, high: float) -> dict[int, float]:
    """{place: value}: the values at these places (from 0) of d's values in order. d: a table, col not null; low, high: its ends.

    A job counts the values of BINS bins between low and high, with each bin's ends; the bins that hold the places are
    counted anew in BINS bins each, until a bin has one value. The driver gets at most BINS rows a place and job.
    """
    found: dict[int, float] = {}
    bins = {(low, high): (0, places)}  # ends of a bin -> values below it, places in it
    while bins:
        for (lo, hi), (_, wanted) in bins.items():
            if lo == hi:
                found |= dict.fromkeys(wanted, lo)
        bins = {ends: x for ends, x in bins.items() if ends[0] < ends[1]}
        if not bins:
            break
        finer = []
        for lo, hi in bins:
            # Halves, as the difference of two doubles can be more than a double holds.
            share = (F.col(col) / 2 - lo / 2) / (hi / 2 - lo / 2)
            finer.append(F.when((F.col(col) >= lo) & (F.col(col) <= hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))))
        counted = d.select(F.col(col).alias("x"), F.coalesce(*finer).alias("b")).filter("b IS NOT NULL").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        by_ends: dict[tuple[float, float], list] = {}
        for r in counted.collect():
            by_ends.setdefault((r["b"]["lo"], r["b"]["hi"]), []).append((r["b"]["bin"], r["n"], r["least"], r["most"]))
        following = {}
        for ends, (below, wanted) in bins.items():
            for _, n, least, most in sorted(by_ends[ends]):
                mine = [p for p in wanted if below <= p < below + n]
                if mine:
                    following[least, most] = (below, mine)
                below += n
        bins = following
    return found


def quantiles(d: DataFrame, col: str, shares: tuple[float, ...]) -> list[float | None]:
    """Interpolated quantiles of a table's column, nulls left out; Nones without values."""
    d = d.select(F.col(col).cast("double").alias("x")).filter("x IS NOT NULL")
    ends = d.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n = ends["n"]
    if not n:
        return [None] * len(shares)
    exact = [s * (n - 1) for s in shares]
    places = sorted({p for e in exact for p in (math.floor(e), math.ceil(e))})
    at = order_statistics(d, "x", places, ends["lo"], ends["hi"])
    return [at[math.floor(e)] + (at[math.ceil(e)] - at[math.floor(e)]) * (e - math.floor(e)) for e in exact]
