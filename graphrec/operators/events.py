"""Cleaning and weighting of events: column expressions, no shuffle but one global maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MICROS_PER_DAY = 8.64e10


def clean_events(d: DataFrame) -> DataFrame:
    """Types trimmed and lower-cased (a missing column means clicks), ids as text, times parsed or null, in UTC.

    Rows without a client or an item id go.
    """
    kind = F.lower(F.btrim(F.col("event_type").cast("string"))) if "event_type" in d.columns else F.lit("click")
    session = F.col("ds_search_id").cast("string") if "ds_search_id" in d.columns else F.lit(None).cast("string")
    time = F.col("timestamp") if d.schema["timestamp"].dataType.typeName() in ("timestamp", "timestamp_ntz") else F.try_to_timestamp("timestamp")
    rest = [c for c in d.columns if c not in ("event_type", "client_id", "item_id", "ds_search_id", "timestamp")]
    out = d.select(kind.alias("event_type"), *[F.btrim(F.col(c).cast("string")).alias(c) for c in ("client_id", "item_id")], session.alias("ds_search_id"), time.cast("timestamp").alias("timestamp"), *rest)
    return out.filter("client_id <> '' AND item_id <> ''")


def counted_drops(d: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """d, and what its next job counts in passing: `rows`, for each reason the rows of which it is the first that holds, and `kept`.

    The figures are there (Observation.get) once a job has read d to its end; no job of their own reads it again.
    """
    seen, before, figures = Observation(), F.lit(False), [F.count(F.lit(1)).alias("rows")]
    for name, holds in reasons.items():
        holds = F.coalesce(holds, F.lit(False))
        figures.append(F.count_if(holds & ~before).alias(name))
        before = before | holds
    return d.observe(seen, *figures, F.count_if(~before).alias("kept")), seen


def clean_events_counted(d: DataFrame) -> tuple[DataFrame, Observation]:
    """clean_events(d), and the count of rows that it drops by reason: no client, else no item."""
    blank = lambda c: F.col(c).isNull() | (F.btrim(F.col(c).cast("string")) == "")
    watched, seen = counted_drops(d, {"no_client": blank("client_id"), "no_item": blank("item_id")})
    return clean_events(watched), seen


def drop_incomplete_counted(d: DataFrame) -> tuple[DataFrame, Observation]:
    """drop_incomplete(d), and the count of rows that it drops by what they lack first."""
    watched, seen = counted_drops(d, {f"no_{c}": F.col(n).isNull() for c, n in (("client", "client_id"), ("item", "item_id"), ("time", "timestamp"))})
    return drop_incomplete(watched), seen


def drop_incomplete(d: DataFrame) -> DataFrame:
    return d.dropna(subset=["client_id", "item_id", "timestamp"])


def usable_session(session: Column) -> Column:
    bare = F.btrim(session)
    return F.coalesce((bare != "") & (F.lower(bare) != "nan"), F.lit(False))


def base_event_weight(kind: Column, click: float = 1.0, purchase: float = 3.0) -> Column:
    return F.when(kind == "purchase", F.lit(purchase)).otherwise(F.lit(click))


def session_boost(session: Column, boost: float = 1.1, boost_missing: bool = False) -> Column:
    """boost where a usable session id is given; with boost_missing in every row of a log that has the column."""
    return F.lit(boost) if boost_missing else F.when(usable_session(session), F.lit(boost)).otherwise(F.lit(1.0))


def time_decay(time: Column, reference: Column, half_life_days: float = 30.0) -> Column:
    """0.5 ** (age / half-life); 1 without a time, for times after the reference, and where the half-life isn't positive."""
    if half_life_days <= 0:
        return F.lit(1.0)
    days = (F.unix_micros(reference) - F.unix_micros(time)) / F.lit(MICROS_PER_DAY)
    return F.when(days > 0, F.pow(F.lit(0.5), days / F.lit(float(half_life_days)))).otherwise(F.lit(1.0))


def reference_time(events: DataFrame) -> DataFrame:
    """One row: the latest time of the log."""
    return events.agg(F.max("timestamp").alias("reference"))


def event_weights(events: DataFrame, *, click: float = 1.0, purchase: float = 3.0, boost: float = 1.1, half_life_days: float = 30.0, boost_missing: bool = False, reference: DataFrame | None = None) -> DataFrame:
    """events with weight: kind, session and age multiplied. The reference is one row, so it is broadcast."""
    ref = F.broadcast(reference_time(events) if reference is None else reference)
    weight = base_event_weight(F.col("event_type"), click, purchase) * session_boost(F.col("ds_search_id"), boost, boost_missing) * time_decay(F.col("timestamp"), F.col("reference"), half_life_days)
    return events.join(ref).withColumn("weight", weight).drop("reference")
