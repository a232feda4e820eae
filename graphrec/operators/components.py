"""Connected components: edges contracted within partitions, then alternating large and small stars until a task can contract the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import dropped, written
from ..functions.memory import returning

#: Edges that a task contracts together: what they need, times the tasks of an executor, is its Python's memory.
TOGETHER = 1 << 18


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of n nodes' components under edges (a, b): larger roots hook onto smaller ones, paths are halved to nothing, until no edge joins two roots."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _stars(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    """(a, b): each node of some edges and the smallest node of its component among them, which has itself."""
    coded = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
    names = coded.dictionary
    # Strings in order of their bytes, as Spark has them.
    order = pc.sort_indices(names.cast(pa.binary()) if pa.types.is_string(names.type) else names).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    ends = place[coded.indices.to_numpy()]
    root = roots(ends[: len(a)], ends[len(a) :], len(order))
    return pa.RecordBatch.from_arrays([names.take(pa.array(order)), names.take(pa.array(order[root]))], ["a", "b"])


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) with the same components as those of batches: the components of each TOGETHER of them, a row a node of these."""
    held: list[pa.RecordBatch] = []
    join = lambda c: pa.chunked_array([x.column(c) for x in held]).combine_chunks()
    for x in batches:
        held.append(x)
        if sum(map(len, held)) >= TOGETHER:
            yield _stars(join(0), join(1))
            held.clear()
    if sum(map(len, held)):
        yield _stars(join(0), join(1))


def contracted(edges: DataFrame) -> DataFrame:
    """edges (a, b) with the same components, as stars: each partition's (each TOGETHER of its edges') components, a row a node of these.

    There is no shuffle; a partition gives no more rows than it has nodes, whatever its edges.
    """
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(returning(stars), f"a {kind}, b {kind}")


def _whole(edges: DataFrame) -> DataFrame | None:
    """contracted() of edges (a table) in one task: whole components, a row a node; None if they are more than a task contracts together."""
    return contracted(edges.coalesce(1)) if edges.count() <= TOGETHER else None


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbor of a node to the smallest node in its neighborhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-least")
    out = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "cc-large")
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbors to the smallest of them. edges have the larger end in a."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "cc-round")
    dropped(least)
    return out


def _unfinished(edges: DataFrame) -> DataFrame:
    """(b): the centers of stars that are no whole component: those that are a larger end themselves, share one with another center, or have one that is a center."""
    ends = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    shared = edges.join(ends.filter("n > 1").select("a"), "a", "left_semi").select("b")
    inner = edges.select("b").join(ends.select(F.col("a").alias("b")), "b", "left_semi")
    outer = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("b")
    return shared.unionAll(inner).unionAll(outer).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100, as_stars: bool = False) -> DataFrame:
    """(node, component) for every end of an edge; component is its smallest node.

    Edges are contracted twice: within the partitions they are read in, before anything is shuffled, and by their larger
    end; what is left is a forest of about a row a node and partition. Then rounds of large and small stars make stars
    around the smallest nodes, in a number of rounds that grows with the logarithm of the longest path; stars that are
    whole components are laid aside after each round, so a round works on what is unfinished. As soon as no more than
    TOGETHER edges are left, which is what any task contracts together, a task contracts them and no round follows, so
    few edges in many partitions cost no rounds. A RuntimeError tells if max_rounds did not do. Minima are tables, so a hub is a skewed key of a plain join, which adaptive execution splits.
    Rounds are written to the shared folder, so the lineage stays short, and removed when the next one stands. Edges
    with a null end, and loops to other nodes' names, count for nothing but their own node. `as_stars`: edges are contracted
    within their partitions as they come.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    local = written(e if as_stars else contracted(e), "cc-local")
    if (whole := _whole(local)) is not None:
        whole = written(whole, "cc-stars")
        dropped(local)
        return whole.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # A node's own row keeps it where no edge does.
    forest = written(contracted(local.repartition("a")).distinct(), "cc-stars")
    dropped(local)
    given, finished = written(forest.filter("a <> b"), "cc-edges"), []
    for done in range(max_rounds + 1):
        open_ = written(_unfinished(given), "cc-open")
        if open_.isEmpty():
            finished.append(given)
            break
        if done == max_rounds:
            raise RuntimeError(f"components are not found after {max_rounds} rounds")
        finished.append(written(given.join(open_, "b", "left_anti").select("a", "b"), "cc-finished"))
        rest = written(given.join(open_, "b", "left_semi").select("a", "b"), "cc-rest")
        if (whole := _whole(rest)) is not None:
            finished.append(written(whole.filter("a <> b"), "cc-finished"))
            dropped(given, open_, rest)
            break
        large = _large_star(rest)
        after = _small_star(large)
        dropped(given, open_, rest, large)
        given = after
    found = finished[0]
    for d in finished[1:]:
        found = found.unionByName(d)
    nodes = forest.select(F.col("a").alias("node")).distinct()
    return nodes.join(found.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
