"""Approximate search: an index of inverted lists, of which a query looks into the nearest ones. Scores are exact."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lineage import bucketed, dropped, read_here, unbucketed, written
from .grid import ITEM_BLOCK, QUERY_BLOCK, TILE, Best, best_of_files, first_k, norm_of
from .vectors import for_metric, l2_normalize

#: Vectors that the centers are fitted on at most, lists at most, rounds of fitting.
SAMPLE, LISTS, ROUNDS = 16384, 4096, 10
#: Lists that a query looks into first.
NEAR = 4


class Index(NamedTuple):
    """Centers of the lists, the items (at, item_id, vecs, norm) in buckets by `at`, the places and the size of each list, and the metric.

    A list of very many items has several places, by hash of the item, so that no task holds it whole.
    """

    centers: np.ndarray
    items: DataFrame
    places: list[list[int]]
    sizes: list[int]
    metric: str

    def drop(self) -> None:
        unbucketed(self.items)


def _key(v: Column, metric: str) -> Column:
    """What lists are told apart by: the direction for cosine, else the vector."""
    return l2_normalize(v) if metric == "cosine" else F.transform(v, lambda x: x.cast("double"))


def nearness(keys: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """[key, center], larger for nearer ones."""
    dots = keys @ centers.T
    return dots if metric == "ip" else 2 * dots - (centers * centers).sum(1)


def fitted_centers(sample: np.ndarray, lists: int, metric: str, seed: int = 1) -> np.ndarray:
    """Centers by Lloyd's rounds from a seeded choice of different vectors; a center that nothing is near stays. Lists are of near vectors whatever the metric."""
    distinct = np.unique(sample, axis=0)
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:lists]].copy()
    for _ in range(ROUNDS):
        own = nearness(sample, centers, "l2").argmax(1)
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, column, minlength=len(centers)) for column in sample.T], 1)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        if metric == "cosine":
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _with_lists(d: DataFrame, centers: np.ndarray, metric: str, n: int, sizes: list[int] | None = None, m: int = 0) -> DataFrame:
    """d with `lists`: the n lists nearest to its column key, nearest first; with sizes, as many more as hold m items together."""
    shared = d.sparkSession.sparkContext.broadcast(centers)
    names = d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                near = nearness(_rows(part.column(names.index("key"))), shared.value, metric)
                order = np.argsort(-near, axis=1, kind="stable").astype(np.int32)
                needed = np.full(len(order), n)
                if sizes is not None:
                    held = np.array(sizes)[order].cumsum(1) < m
                    needed = np.maximum(n, held.sum(1) + 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([o[:k] for o, k in zip(order, needed)], pa.list_(pa.int32()))], [*names, "lists"])

    return d.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", lists array<int>")


def build_index(collection: DataFrame, metric: str = "cosine", lists: int | None = None, sample: int = SAMPLE, seed: int = 1, list_block: int = ITEM_BLOCK) -> Index:
    """An index of a collection (item_id, embedding); lists: as many as the root of its items by default, LISTS at most.

    Centers are fitted on a sample of at most `sample` vectors, those with the smallest hashes of their id; every item is
    put into the list of its nearest center. Rows with a null id or vector, or with null or NaN entries, take no part.
    What reaches the driver is the sample and a count a list.
    """
    spark = collection.sparkSession
    v = F.col("embedding")
    d = collection.filter(F.col("item_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    vecs = F.array(for_metric(v, metric, False))
    d = written(d.select("item_id", _key(v, metric).alias("key"), vecs.alias("vecs"), norm_of(vecs, (1.0,)).alias("norm")), "index-items")
    n = d.count()
    some = [r["key"] for r in d.select("key", F.xxhash64("item_id", F.lit(seed)).alias("h")).orderBy("h").limit(sample).collect()]
    wanted = max(1, min(lists or round(math.sqrt(n)), LISTS, len(some) or 1))
    centers = fitted_centers(np.array(some, dtype=float), wanted, metric, seed) if some else np.zeros((1, 0))
    put = written(_with_lists(d, centers, "l2", 1).select(F.col("lists")[0].alias("list"), "item_id", "vecs", "norm"), "index-lists") if some else d.select(F.lit(0).alias("list"), "item_id", "vecs", "norm")
    sizes = {r["list"]: r["n"] for r in put.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, math.ceil(sizes.get(i, 0) / list_block)) for i in range(len(centers))]
    first = np.cumsum([0, *parts]).tolist()
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
    at = F.get(numbers(first), F.col("list")) + F.pmod(F.xxhash64("item_id"), F.get(numbers(parts), F.col("list")))
    items = bucketed(put.select(at.cast("int").alias("at"), "item_id", "vecs", "norm"), "at", "index", int(spark.conf.get("spark.sql.shuffle.partitions")))
    dropped(d, *([put] if some else []))
    return Index(centers, items, [list(range(a, z)) for a, z in zip(first, first[1:])], [sizes.get(i, 0) for i in range(len(centers))], metric)


def probes_for(index: Index, queries: DataFrame, collection: DataFrame, m: int, recall: float, sample: int = 256, seed: int = 1) -> int:
    """The least number of lists to look into with which a sample of at most `sample` queries finds `recall` of its exact m nearest.

    The sample's exact neighbors are found once; how far down a query's order of lists each one lies tells the recall of
    every number of lists.
    """
    from .vectors import topm_candidates

    some = written(queries.select("item_id", "embedding", F.xxhash64("item_id", F.lit(seed)).alias("h")).orderBy("h").limit(sample), "index-sample")
    exact = topm_candidates(some, collection, m, index.metric).select("query_item_id", "item_id")
    held = index.items.select("item_id", "at")
    found = exact.join(held, "item_id").groupBy("query_item_id", "at").agg(F.count(F.lit(1)).alias("n")).collect()
    asked = some.select("item_id", _key(F.col("embedding"), index.metric).alias("key")).collect()
    dropped(some)
    if not found:
        return 1
    near = nearness(np.array([r["key"] for r in asked], dtype=float), index.centers, index.metric)
    order = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    row = {r["item_id"]: i for i, r in enumerate(asked)}
    of_place = {p: i for i, places in enumerate(index.places) for p in places}
    at = np.bincount([order[row[r["query_item_id"]], of_place[r["at"]]] for r in found], [r["n"] for r in found], minlength=len(index.centers)).cumsum()
    return int(np.argmax(at >= recall * at[-1])) + 1


def search(index: Index, queries: DataFrame, m: int, probes: int) -> DataFrame:
    """(query_item_id, rank, item_id, similarity): the m best items of each query (item_id once each, embedding) in its `probes` nearest lists, or in as many as hold m items.

    A task reads the index file by file for its block of at most about QUERY_BLOCK queries, each of which meets the items of its lists;
    cells are those of the exact search, so scores and ties are the same. Neither queries nor items are sent a list each.
    """
    v = F.col("embedding")
    if not sum(index.sizes):
        kinds = (queries.schema["item_id"].dataType, index.items.schema["item_id"].dataType)
        return queries.sparkSession.createDataFrame([], f"query_item_id {kinds[0].simpleString()}, rank int, item_id {kinds[1].simpleString()}, similarity double")
    vecs = F.array(for_metric(v, index.metric, True))
    q = queries.filter(F.col("item_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    q = q.select(F.col("item_id").alias("query_id"), _key(v, index.metric).alias("key"), vecs.alias("vecs"), norm_of(vecs, (1.0,)).alias("norm"))
    q = written(_with_lists(q, index.centers, index.metric, probes, index.sizes, m), "index-queries")
    n, tasks = q.count(), int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n / QUERY_BLOCK), min(tasks, math.ceil(n / (4 * TILE))))
    kind = index.items.schema["item_id"].dataType
    files, places, id_type = tuple(sorted(index.items.inputFiles())), index.places, to_arrow_type(kind)

    def cells(left: pa.Table, best: Best) -> Iterator[tuple[np.ndarray, pa.Table]]:
        lists = left["lists"].combine_chunks()
        row = np.repeat(np.arange(len(left)), np.diff(lists.offsets.to_numpy()))
        listed = lists.flatten().to_numpy()
        order = np.argsort(listed, kind="stable")
        row, listed = row[order], listed[order]
        of_place = {p: i for i, some in enumerate(places) for p in some}
        for file in files:
            for t in read_here((file,), ["at", "item_id", "vecs", "norm"], ITEM_BLOCK):
                at = t["at"].to_numpy()
                starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                for x, y in zip(starts, starts[1:]):
                    if y > x:
                        a, z = np.searchsorted(listed, (of_place[int(at[x])], of_place[int(at[x])] + 1))
                        right = t.slice(x, y - x)
                        yield row[a:z], right.set_column(1, "item_id", right["item_id"].cast(id_type))

    run, schema = best_of_files(q, kind, m, (1.0,), cells)

    def met(asked: DataFrame, name: str) -> DataFrame:
        """What queries (their lists, and least, the score to beat) find in their lists: m rows at most each."""
        d = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "lists", "query_id", "vecs", "norm", "least")
        return written(d.repartitionByRange(blocks, "block").groupBy("block").applyInArrow(run, schema), name)

    # The m best of the nearest lists give each query a score to beat: other lists pass on what reaches it, not m rows each.
    lowest = F.lit(float("-inf"))
    best = met(q.withColumn("lists", F.slice("lists", 1, NEAR)).withColumn("least", lowest), "index-best")
    beat = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("ranked").alias("least")).filter(F.col("n") >= m).select("query_id", "least")
    rest = q.filter(F.size("lists") > NEAR).withColumn("lists", F.slice("lists", F.lit(NEAR + 1), F.size("lists") - NEAR))
    rest = written(rest.join(beat, "query_id", "left").withColumn("least", F.coalesce("least", lowest)), "index-asked")
    found = best.unionByName(met(rest, "index-rest"))
    dropped(q, rest)
    return first_k(found, m).select(F.col("query_id").alias("query_item_id"), "rank", "item_id", (F.col("score") + (1.0 if index.metric == "l2" else 0.0)).alias("similarity"))


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact search's rows that the approximate one has too; 1 without any."""
    pairs = exact.select("query_item_id", "item_id")
    n, hits = pairs.count(), pairs.join(found.select("query_item_id", "item_id"), ["query_item_id", "item_id"], "left_semi").count()
    return hits / n if n else 1.0
