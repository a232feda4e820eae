"""Splitting a log, and ids as dense numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written


def leave_last_out(events: DataFrame, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Test rows: each client's latest event. Ties in time go to the later row by `order`, then the larger item id."""
    latest = F.max_by("item_id", F.struct("timestamp", *order, "item_id"))
    return events.groupBy("client_id").agg(latest.alias("item_id"))


def train_minus_last(events: DataFrame, order: tuple[str, ...] = ("event_id",), drop_exact_duplicates: str = "all") -> DataFrame:
    """The log without each client's last row; with "all", without any row that has an exact duplicate (order columns don't count), with "none" with them.

    Last is by time, order, item id, then the other columns. Rows are counted by content, and the last one is a maximum,
    so partial sums precede each shuffle; the last rows are a table, so a client of very many rows is a skewed key of a
    plain join, which adaptive execution splits. Columns must have an order (no maps).
    """
    keys = ["timestamp", *order, *([] if "item_id" in order else ["item_id"])]
    rest = [c for c in events.columns if c not in keys and c != "client_id"]
    last = written(events.groupBy("client_id").agg(F.max(F.struct(*keys, *rest)).alias("_last")), "last-rows")
    if drop_exact_duplicates == "all":
        content = [c for c in events.columns if c not in order]
        d = events.groupBy(*content).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in order if c in events.columns]).filter("_n = 1")
    else:
        d = events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(last.withColumnRenamed("client_id", "_client"), F.col("client_id").eqNullSafe(F.col("_client")))
    d = d.withColumn("_left", F.col("_n") - F.struct(*keys, *rest).eqNullSafe(F.col("_last")).cast("int")).filter("_left > 0")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left")))).select(*events.columns)


def drop_all_duplicates(d: DataFrame) -> DataFrame:
    """Rows that occur once."""
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")


def restrict_to_embedded(d: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return d.join(users.select("client_id"), "client_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")


def seen_items(train: DataFrame) -> DataFrame:
    return train.select("client_id", "item_id").distinct()


def mask_seen(scored: DataFrame, train: DataFrame) -> DataFrame:
    return scored.join(seen_items(train), ["client_id", "item_id"], "left_anti")


def id_index(nodes: DataFrame, id_col: str = "id", kind_col: str = "kind") -> DataFrame:
    """(kind, id, idx): dense numbers from 0 within a kind, in order of id.

    Ids are sorted by range and numbered within ranges; each range starts after the sizes of those before, so no task
    holds a kind. The ranges are a table: their bounds come from a sample, which must not be drawn twice.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = nodes.select(kind_col, id_col).distinct().repartitionByRange(n, kind_col, id_col).withColumn("_range", F.spark_partition_id())
    d = written(d, "id-ranges").withColumn("_at", F.row_number().over(Window.partitionBy("_range", kind_col).orderBy(id_col)) - 1)
    sizes = d.groupBy(kind_col, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first"))
    before = Window.partitionBy(kind_col).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(kind_col, "_range", "_start")
    return d.join(F.broadcast(starts), [kind_col, "_range"]).select(kind_col, id_col, (F.col("_start") + F.col("_at")).cast("long").alias("idx"))


def map_ids(interactions: DataFrame, index: DataFrame) -> DataFrame:
    """(u, i, weight): ids replaced by their numbers."""
    u = index.filter("kind = 'user'").select(F.col("id").alias("client_id"), F.col("idx").alias("u"))
    i = index.filter("kind = 'item'").select(F.col("id").alias("item_id"), F.col("idx").alias("i"))
    return interactions.join(u, "client_id").join(i, "item_id").select("u", "i", "weight")
