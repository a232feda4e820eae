"""Vectors: arithmetic as expressions, late and two-stage fusion by exact search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import dropped, written
from .grid import block_topk

EPS = 1e-12


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    norm = F.greatest(vector_norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine: 1 - cos; l2: squared; ip: 1 - dot."""
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return 1.0 - (cosine(a, b) if metric == "cosine" else dot(a, b))


def fuse_scores(sim_graph: Column, sim_text: Column, alpha: float = 0.5) -> Column:
    return F.lit(alpha) * sim_graph + F.lit(1.0 - alpha) * sim_text


def round_scores(d: DataFrame, *cols: str) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c in cols})


def exclude_self(d: DataFrame) -> DataFrame:
    return d.filter("item_id <> query_item_id")


def id_intersection(a: DataFrame, b: DataFrame, id_col: str = "item_id") -> DataFrame:
    return a.select(id_col).intersect(b.select(id_col))


def one_vector_per_id(d: DataFrame, id_col: str = "item_id", vector_col: str = "embedding") -> DataFrame:
    """Of vectors repeated under an id the largest one: a rule that doesn't depend on order."""
    return d.groupBy(id_col).agg(F.max(vector_col).alias(vector_col))


def align_vectors(text: DataFrame, graph: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item_id, text_vec, graph_vec) of items with both."""
    t = one_vector_per_id(text, id_col).withColumnRenamed("embedding", "text_vec")
    return t.join(one_vector_per_id(graph, id_col).withColumnRenamed("embedding", "graph_vec"), id_col)


def require_rows(d: DataFrame, message: str) -> DataFrame:
    if d.isEmpty():
        raise ValueError(message)
    return d


def fusion_recommend(text: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """Exact late fusion: (query_item_id, rank, item_id, score, sim_text, sim_graph) for query ids in both sets."""
    both = align_vectors(text, graph).select("item_id", F.array(l2_normalize(F.col("graph_vec")), l2_normalize(F.col("text_vec"))).alias("vecs"))
    q = queries.select("item_id").distinct().join(both, "item_id").withColumnRenamed("item_id", "query_id")
    top = block_topk(q, both, k, (alpha, 1.0 - alpha), exclude_same_id=True)
    return top.select(F.col("query_id").alias("query_item_id"), "rank", "item_id", "score", F.col("part_1").alias("sim_text"), F.col("part_0").alias("sim_graph"))


def unknown_queries(queries: DataFrame, text: DataFrame, graph: DataFrame) -> DataFrame:
    """Query ids that aren't in both sets."""
    return queries.select("item_id").distinct().join(id_intersection(text, graph), "item_id", "left_anti")


def for_metric(v: Column, metric: str, query: bool) -> Column:
    """Vectors whose dot product orders by the metric: for l2, -|a - b|^2 = 2 ab - |b|^2 - |a|^2."""
    if metric == "cosine":
        return l2_normalize(v)
    d = F.transform(v, lambda x: x.cast("double"))
    if metric == "ip":
        return d
    square = F.pow(vector_norm(v), F.lit(2.0))
    return F.concat(F.transform(d, lambda x: x * 2), F.array(F.lit(-1.0), -square)) if query else F.concat(d, F.array(square, F.lit(1.0)))


def topm_candidates(queries: DataFrame, collection: DataFrame, m: int = 200, metric: str = "cosine", recall: float | None = None) -> DataFrame:
    """(query_item_id, rank, item_id, similarity): the m nearest of a collection; similarity is 1 - distance.

    Exact, or with `recall` by an index of inverted lists (see inverted.py), of which as many are looked into as find
    this share of the exact rows of a sample of queries.
    """
    if recall is not None:
        from . import inverted

        index = inverted.build_index(collection, metric)
        found = inverted.search(index, queries, m, inverted.probes_for(index, queries, collection, m, recall))
        index.drop()
        return found
    q = queries.select(F.col("item_id").alias("query_id"), F.array(for_metric(F.col("embedding"), metric, True)).alias("vecs"))
    c = collection.select("item_id", F.array(for_metric(F.col("embedding"), metric, False)).alias("vecs"))
    top = block_topk(q, c, m)
    return top.select(F.col("query_id").alias("query_item_id"), "rank", "item_id", (F.col("score") + (1.0 if metric == "l2" else 0.0)).alias("similarity"))


def candidate_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("query_item_id", "item_id").union(b.select("query_item_id", "item_id")).distinct()


def fuse_candidates(text: DataFrame, graph: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Both candidate lists together; a side that lacks an item counts -1.

    Rows are sent once, to their query's task: pairs meet there, and whoever ranks a query's rows need not send them again.
    """
    side = lambda d, is_text: d.select("query_item_id", "item_id", F.lit(is_text).alias("is_text"), "similarity")
    both = side(text, True).unionByName(side(graph, False)).repartition("query_item_id")
    of = lambda is_text: F.coalesce(F.max(F.when(F.col("is_text") == is_text, F.col("similarity"))), F.lit(-1.0))
    d = both.groupBy("query_item_id", "item_id").agg(of(True).alias("sim_text"), of(False).alias("sim_graph"))
    return d.withColumn("score", fuse_scores(F.col("sim_graph"), F.col("sim_text"), alpha))


def two_stage_topk(fused: DataFrame, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_item_id").orderBy(F.desc("score"), "item_id"))
    d = round_scores(exclude_self(fused), "score", "sim_text", "sim_graph").withColumn("rank", rank).filter(F.col("rank") <= k)
    return d.select("query_item_id", "rank", "item_id", "score", "sim_text", "sim_graph")


def resolve_query_ids(queries: DataFrame, text: DataFrame, graph: DataFrame) -> DataFrame:
    """(asked, item_id): a query that isn't in both collections is replaced by the smallest common id."""
    common = id_intersection(text, graph)
    asked = queries.select(F.col("item_id").alias("asked")).distinct()
    known = asked.join(common, F.col("asked") == F.col("item_id"), "left")
    return known.join(F.broadcast(common.agg(F.min("item_id").alias("least")))).select("asked", F.coalesce("item_id", "least").alias("item_id"))


def two_stage_recommend(text: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, top_m: int = 200, alpha: float = 0.5, metric: str | tuple[str, str] = "cosine", recall: float | None = None) -> DataFrame:
    """Top-m of each collection, united, -1 where one lacks an item, fused, first k. metric: of both, or one for each; recall: as for topm_candidates."""
    text, graph = (written(one_vector_per_id(c), "two-stage-vectors") for c in (text, graph))
    ids = written(resolve_query_ids(queries, text, graph).select("item_id").distinct(), "two-stage-ids")
    each = (metric, metric) if isinstance(metric, str) else metric
    t, g = (topm_candidates(ids.join(c, "item_id"), c, top_m, m, recall) for c, m in zip((text, graph), each))
    dropped(text, graph, ids)
    return two_stage_topk(fuse_candidates(t, g, alpha), k)
