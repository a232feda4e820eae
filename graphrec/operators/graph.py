"""The weighted bipartite graph of clients and items, and its figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import dropped, written
from ..functions.quantiles import quantiles
from .events import usable_session


def build_edges(weighted: DataFrame, sequence: str = "event_id") -> DataFrame:
    """One row per (client_id, item_id): weight, count, click_count, purchase_count, and the first and last session and time.

    Last is by time, then sequence; first is by sequence. Partial sums precede the shuffle, so hot pairs cost nothing more.
    """
    session = F.when(usable_session(F.col("ds_search_id")), F.btrim("ds_search_id"))
    by_time = F.when(session.isNotNull(), F.struct("timestamp", sequence))
    by_order = F.when(session.isNotNull(), F.col(sequence))
    return weighted.groupBy("client_id", "item_id").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("count"), F.count_if(F.col("event_type") == "click").alias("click_count"), F.count_if(F.col("event_type") == "purchase").alias("purchase_count"),
        F.max_by(session, by_time).alias("last_ds_search_id"), F.max("timestamp").alias("last_timestamp"), F.min_by(session, by_order).alias("first_ds_search_id"), F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col(sequence))).alias("first_timestamp"),
    )


def interactions(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("client_id", "item_id").agg(F.sum("weight").alias("weight"))


def distinct_nodes(edges: DataFrame) -> DataFrame:
    """(kind, id): clients and items apart, even where their ids are equal."""
    return node_union(edges.select("client_id").distinct(), edges.select("item_id").distinct())


def node_union(users: DataFrame, items: DataFrame) -> DataFrame:
    return users.select(F.lit("user").alias("kind"), F.col("client_id").alias("id")).unionByName(items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id")))


def item_dedupe_first(items: DataFrame, order: list[str], id_col: str = "item_id") -> DataFrame:
    """The first row of each id in a stated order: minima before the shuffle, so an id of very many rows is no large group."""
    first = F.min_by(F.struct(*items.columns), F.struct(*order))
    return items.groupBy(F.col(id_col).alias("_id")).agg(first.alias("_row")).select("_row.*")


def attach_item_metadata(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Item nodes with title and length of description, clients with nulls."""
    meta = items.select(F.col("item_id").alias("id"), "title", F.length("description").alias("desc_len"), F.lit("item").alias("kind"))
    return nodes.join(meta, ["kind", "id"], "left")


def node_stats(edges: DataFrame, side: str) -> DataFrame:
    """(side, degree, strength): neighbors, and sum of edge weights."""
    return edges.groupBy(side).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Users, items, edges, average degrees (3 decimals), least, largest and mean weight (6); zeros for an empty graph."""
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), n)
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.avg("weight").alias("mean"))
    users, items = (edges.select(c).distinct().agg(F.count(F.lit(1)).alias(n)) for c, n in (("client_id", "users"), ("item_id", "items")))
    d = e.join(F.broadcast(users)).join(F.broadcast(items))
    ratio = lambda n: zero(F.when(F.col(n) > 0, F.col("edges") / F.col(n)), 3)
    return d.select("users", "items", "edges", ratio("users").alias("avg_user_degree"), ratio("items").alias("avg_item_degree"), zero(F.col("lo"), 6).alias("weight_min"), zero(F.col("hi"), 6).alias("weight_max"), zero(F.col("mean"), 6).alias("weight_mean"))


def degree_percentiles(edges: DataFrame, percents: tuple[int, ...] = (90, 99)) -> DataFrame:
    """(kind, median, p90, p99): interpolated median, nearest rank else (place round-half-even(p / 100 * (n - 1))).

    Degrees are counted into a histogram first; it has as many rows as there are different degrees.
    """
    degrees = node_stats(edges, "client_id").select(F.lit("user").alias("kind"), "degree").unionAll(node_stats(edges, "item_id").select(F.lit("item").alias("kind"), "degree"))
    histogram = degrees.groupBy("kind", "degree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind")
    h = histogram.withColumn("upto", F.sum("n").over(w.orderBy("degree"))).withColumn("total", F.sum("n").over(w))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("degree")))
    nearest = [at(F.bround(F.lit(p / 100) * (F.col("total") - 1), 0)).alias(f"p{p}") for p in percents]
    median = (at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2.0
    return h.groupBy("kind").agg(median.alias("median"), *nearest)


def weight_stats(edges: DataFrame) -> DataFrame:
    """One row: median, p90 and p99 (interpolated, exact) and sample deviation of weights; nulls without edges.

    Weights become a table of one column, in whose ever finer bins values are counted; no task holds all weights.
    """
    weights = written(edges.select("weight"), "weights")
    found = quantiles(weights, "weight", (0.5, 0.9, 0.99))
    std = weights.agg(F.stddev_samp("weight").alias("weight_std")).first()["weight_std"]
    dropped(weights)
    row = dict(zip(("weight_median", "weight_p90", "weight_p99", "weight_std"), [*found, std]))
    return edges.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in row.items()])


def weight_sketch(edges: DataFrame, error: float = 0.01) -> DataFrame:
    """(error, bin, n, mean, m2): weights by logarithmic bins, to be stored a run and merged over many; a row a bin, a thousand or so.

    Bin b (from 1, for weights below 0 its negative) has sizes in (g^(b - 1 - 2^20), g^(b - 2^20)] with g = (1 + error) /
    (1 - error); bin 0 has zeros. m2: sum of squares about the mean. Partial sums precede the one shuffle.
    """
    g = math.log((1 + error) / (1 - error))
    w = F.col("weight").cast("double")
    size = F.ceil(F.log(F.abs(w)) / F.lit(g)).cast("int") + (1 << 20)
    d = edges.select(w.alias("weight"), F.when(w == 0, F.lit(0)).when(w > 0, size).otherwise(-size).alias("bin")).filter("weight IS NOT NULL AND NOT isnan(weight)")
    d = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean"), F.coalesce(F.var_pop("weight"), F.lit(0.0)).alias("m2"))
    return d.select(F.lit(error).alias("error"), "bin", "n", "mean", (F.col("m2") * F.col("n")).alias("m2"))


def sketched_weight_stats(sketches: DataFrame) -> DataFrame:
    """One row as weight_stats() of all edges that the sketches (any number, united) were made of, without reading edges.

    A quantile is that of the places next to it, each off by at most `error` of its size; the deviation is exact but for
    rounding. Sketches of different errors do not merge: a ValueError.
    """
    if sketches.select("error").distinct().count() > 1:
        raise ValueError("sketches of different errors do not merge")
    d = sketches.groupBy("error", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("mean") * F.col("n")).alias("s"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    d = d.withColumn("mean", F.col("s") / F.col("n")).withColumn("m2", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["m2"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))))
    g = F.log((1 + F.col("error")) / (1 - F.col("error")))
    middle = F.exp(g * (F.abs("bin") - (1 << 20))) * (1 - F.col("error"))  # within error of both ends of its bin
    d = d.withColumn("value", F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(F.signum(F.col("bin").cast("double")) * middle))
    # A row a bin, so the windows are small whatever was sketched; bins of negative weights come in order of their values.
    w = Window.orderBy("value")
    d = d.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("whole", F.sum("s").over(Window.partitionBy()) / F.col("total"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))

    def quantile(share: float) -> Column:
        exact = F.lit(share) * (F.col("total") - 1)
        low, high = at(F.floor(exact)), at(F.ceil(exact))
        return low + (high - low) * (F.max(exact) - F.floor(F.max(exact)))

    spread = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("whole")) * (F.col("mean") - F.col("whole")))
    std = F.when(F.max("total") > 1, F.sqrt(spread / (F.max("total") - 1)))
    return d.agg(*[quantile(s).alias(f"weight_{n}") for s, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99"))], std.alias("weight_std"))


def top_items(edges: DataFrame, items: DataFrame | None, n: int = 20) -> DataFrame:
    """The n items of largest strength, then degree; titles join n rows only ('' where there is none)."""
    top = node_stats(edges, "item_id").orderBy(F.desc("strength"), F.desc("degree"), "item_id").limit(n)
    if items is None:
        return top.withColumn("title", F.lit(""))
    titles = items.select("item_id", "title").join(F.broadcast(top.select("item_id")), "item_id", "left_semi")
    return top.join(F.broadcast(titles), "item_id", "left").withColumn("title", F.coalesce("title", F.lit(""))).select("item_id", "degree", "strength", "title")


def top_users(edges: DataFrame, n: int = 20) -> DataFrame:
    return node_stats(edges, "client_id").orderBy(F.desc("strength"), F.desc("degree"), "client_id").limit(n)


def symmetric_adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): every edge both ways; a node is its kind's letter and its id."""
    u, i = F.concat(F.lit("u:"), "client_id"), F.concat(F.lit("i:"), "item_id")
    return edges.select(u.alias("src"), i.alias("dst"), F.col("weight").alias("w")).unionAll(edges.select(i.alias("src"), u.alias("dst"), F.col("weight").alias("w")))


def weighted_degree(adjacency: DataFrame) -> DataFrame:
    """(node, degree): row sums, 1 where they are 0."""
    d = adjacency.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))
    return d.withColumn("degree", F.when(F.col("degree") == 0, F.lit(1.0)).otherwise(F.col("degree")))


def normalized_adjacency(adjacency: DataFrame) -> DataFrame:
    """w / sqrt(degree of src * degree of dst). Degrees are a table, so a hub is a skewed key of plain joins, which adaptive execution splits."""
    d = written(weighted_degree(adjacency), "degrees")
    a = adjacency.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    return a.select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))
