"""Exact search by inner products as a grid: blocks of queries by blocks of items, each pair of blocks a cell.

Items lie in blocks by falling norm. No item of a block scores more than the query's norm times the block's largest one
(Cauchy-Schwarz), so a query is sent only to the blocks that may still matter to it, and in a cell it is scored only
against the items before the place where its bound falls too low. Whatever the numbers of queries and items, a search is
a fixed number of jobs, a cell holds QUERY_BLOCK queries and ITEM_BLOCK items, and the driver gets a number a block.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lineage import dropped, read_here, written

#: Rows of a cell's sides; items and queries scored together.
QUERY_BLOCK, ITEM_BLOCK, CHUNK, TILE = 16384, 131072, 2048, 256
#: Decimals by which scores rank, so that equal vectors tie wherever they lie, and what a bound is raised by for rounding.
DECIMALS, SLACK = 9, 1e-8


class Sides(NamedTuple):
    """Queries (block, query_id, vecs, norm, more), items (at, item_id, vecs, norm), pairs that take no part (block, at, item_id, query_id), the number of blocks of queries, a bound of the norms in each block of items and in those after it, and the tables made."""

    queries: DataFrame
    items: DataFrame
    masked: DataFrame | None
    blocks: int
    norms: list[float]
    made: list[DataFrame]


def norm_of(vecs: Column, weights: tuple[float, ...]) -> Column:
    square = lambda p: F.aggregate(F.element_at(vecs, p + 1), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(sum((F.lit(float(w) ** 2) * square(p) for p, w in enumerate(weights)), F.lit(0.0)))


def laid_out(queries: DataFrame, items: DataFrame, weights: tuple[float, ...], masked: DataFrame | None = None, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK, least_block: int = TILE) -> Sides:
    """Both sides as tables in blocks. queries: query_id, vecs (an array of one vector a weight) and more columns; items: item_id, vecs; masked: (query_id, item_id).

    Rows with a null id or vector, or with NaN in one, take no part. Few queries are dealt to as many blocks as there
    are shuffle partitions, of least_block at least. Blocks of items are ranges of (norm, hash of the id), so equal norms are no large block.
    """
    spark = queries.sparkSession
    whole = lambda d, c: d.filter(F.col(c).isNotNull() & F.coalesce(F.forall("vecs", lambda v: v.isNotNull()), F.lit(False)) & ~F.isnan("norm"))
    q = written(whole(queries.withColumn("norm", norm_of(F.col("vecs"), weights)), "query_id"), "grid-queries")
    i = written(whole(items.select("item_id", "vecs", norm_of(F.col("vecs"), (1.0,) * len(weights)).alias("norm")), "item_id"), "grid-items")
    n_queries, n_items = q.count(), i.count()
    blocks = max(1, math.ceil(n_queries / query_block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_queries / least_block)))
    of_query = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    n = math.ceil(n_items / item_block)
    if n > 1:
        # A table, as the bounds of ranges come from a sample, which must not be drawn twice.
        ranges = written(i.repartitionByRange(n, F.desc("norm"), F.xxhash64("item_id")).withColumn("at", F.spark_partition_id()), "grid-ranges")
        dropped(i)
        i, table = ranges, ranges
    else:
        i, table = i.withColumn("at", F.lit(0)), i
    largest = {r["at"]: r["norm"] for r in i.groupBy("at").agg(F.max("norm").alias("norm")).collect()}
    norms = np.maximum.accumulate([largest.get(k, 0.0) for k in range(max(n, 1))][::-1])[::-1].tolist()
    hidden = None
    if masked is not None:
        # The pairs are a plain side of the join: whoever has met very many items is a skewed key, which is split.
        pairs = masked.select("query_id", "item_id").distinct()
        hidden = pairs.join(i.select("item_id", "at").distinct(), "item_id").select(of_query.alias("block"), "at", "item_id", "query_id")
    return Sides(q.withColumn("block", of_query), i, hidden, blocks, norms, [q, table])


def _cells(sides: Sides, queries: DataFrame, reach: Callable[[Column], Column], first: int, run: Callable, schema: str) -> DataFrame:
    """run(left, right) on each cell of queries and of the blocks of items from `first` to below reach(norm), the number of blocks that a query needs."""
    q = queries.withColumn("reach", reach(F.col("norm")))
    furthest = {r["block"]: r["reach"] for r in q.groupBy("block").agg(F.max("reach").alias("reach")).collect()}
    q = q.filter(F.col("reach") > first).withColumn("at", F.explode(F.sequence(F.lit(first), F.col("reach") - 1)))
    # Which blocks of queries a block of items is sent to: a number a block of queries.
    wanted = F.split(F.lit(",".join(str(furthest.get(b, 0)) for b in range(sides.blocks))), ",").cast("array<int>")
    copies = F.filter(F.sequence(F.lit(0), F.lit(sides.blocks - 1)), lambda b: F.get(wanted, b) > F.col("at"))
    i = sides.items.filter(F.col("at") >= first).select(F.explode(copies).alias("block"), "at", "item_id", "vecs", "norm")
    kind = sides.queries.schema["query_id"].dataType
    if sides.masked is None:
        i = i.withColumn("query_id", F.lit(None).cast(kind))
    else:
        needed = (F.col("at") >= first) & (F.get(wanted, F.col("block")) > F.col("at"))
        i = i.withColumn("query_id", F.lit(None).cast(kind)).unionByName(sides.masked.filter(needed), allowMissingColumns=True)
    return q.drop("reach").groupBy("block", "at").cogroup(i.groupBy("block", "at")).applyInArrow(run, schema)


def matrix(vecs: pa.ChunkedArray) -> tuple[np.ndarray, list[int]]:
    """Rows of all parts of each vector together, and the lengths of the parts."""
    rows = vecs.combine_chunks()
    parts = rows.flatten()
    flat = np.asarray(parts.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.diff(parts.offsets.to_numpy()).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), dtype=int)
    if len(rows) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(rows), -1), sizes[0].tolist() if len(rows) else []


class Cell:
    """One cell's items by falling norm, its queries with weights in them, and the masked pairs by item."""

    def __init__(self, left: pa.Table, right: pa.Table, weights: tuple[float, ...], exclude_same_id: bool):
        masks = right.filter(pc.is_null(right["vecs"]))
        right = right.filter(pc.is_valid(right["vecs"]))
        right = right.take(pc.sort_indices(right, sort_keys=[("norm", "descending")])) if len(right) else right
        self.left, self.right, self.ids = left, right, right["item_id"].to_pylist()
        self.raw, self.parts = matrix(left["vecs"])
        self.items, parts = matrix(right["vecs"])
        if len(left) and len(right) and parts != self.parts:
            raise ValueError(f"vectors of {self.parts} entries meet some of {parts}")
        self.q = self.raw * np.repeat(weights, self.parts) if len(left) else self.raw
        self.short = self.items.astype(np.float32)
        self.norm, self.q_norm = right["norm"].to_numpy(), left["norm"].to_numpy()
        # Ids in order, as numbers: ties go to the smaller one.
        self.order = sorted(range(len(self.ids)), key=self.ids.__getitem__)
        self.place = np.empty(len(self.ids), dtype=np.int64)
        self.place[self.order] = np.arange(len(self.ids))
        queries = left["query_id"].combine_chunks()
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        own = right["item_id"].combine_chunks()
        if exclude_same_id and len(own) and own.type == queries.type:
            at = pc.index_in(own, value_set=queries).to_pandas().to_numpy(dtype=float, na_value=np.nan)
            hit = np.flatnonzero(~np.isnan(at))
            pairs.append(np.stack([hit, at[hit].astype(np.int64)], axis=1))
        if len(masks) and len(own) and len(left):
            of: dict = {}
            for n, x in enumerate(self.ids):
                of.setdefault(x, []).append(n)
            number = {x: n for n, x in enumerate(queries.to_pylist())}
            found = [(n, number[who]) for x, who in zip(masks["item_id"].to_pylist(), masks["query_id"].to_pylist()) if who in number for n in of.get(x, ())]
            pairs.append(np.array(found, dtype=np.int64).reshape(-1, 2))
        self.hidden = np.concatenate(pairs)
        self.hidden = self.hidden[np.argsort(self.hidden[:, 0], kind="stable")]

    def chunks(self, needed: Callable[[np.ndarray], np.ndarray]):
        """(tile of query numbers, first item, scores) until no query needs the items that are left.

        needed(bounds) tells which queries need items of which none scores more than these bounds. Masked pairs and
        scores that are no number are -inf.
        """
        for a in range(0, len(self.items), CHUNK):
            here = np.flatnonzero(needed(self.q_norm * self.norm[a] * (1 + 1e-12) + SLACK))
            if not len(here):
                return
            v = self.items[a : a + CHUNK].T
            x, z = np.searchsorted(self.hidden[:, 0], (a, a + CHUNK))
            hidden = self.hidden[x:z]
            at = np.full(len(self.q), -1)
            for t in range(0, len(here), TILE):
                tile = here[t : t + TILE]
                score = np.round(self.q[tile] @ v, DECIMALS)
                score[np.isnan(score)] = -np.inf
                if len(hidden):
                    at[tile] = np.arange(len(tile))
                    row = at[hidden[:, 1]]
                    score[row[row >= 0], hidden[row >= 0, 0] - a] = -np.inf
                    at[tile] = -1
                yield tile, a, score

    def best_of_tile(self, tile: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in tile, item, score) of each query's k best items, none below `least`; ties by smaller id.

        Single precision tells which pairs may reach the score that their query has to beat: those that come within its
        largest error of it. These alone are scored exactly, and are put in order when there are many of them.
        """
        q, norm, n = self.q[tile], self.q_norm[tile], len(tile)
        short = q.astype(np.float32)
        beat = least.copy()
        kept = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        waiting, at = 0, np.full(len(self.q), -1)
        at[tile] = np.arange(n)

        def in_order() -> None:
            i, j, score = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((self.place[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            kth = rank == k - 1
            beat[i[kth]] = np.maximum(beat[i[kth]], score[kth])
            kept[:] = [(i[rank < k], j[rank < k], score[rank < k])]

        for a in range(0, len(self.items), CHUNK):
            z = min(a + CHUNK, len(self.items))
            here = norm * self.norm[a] * (1 + 1e-12) + SLACK >= beat
            if not here.any():
                break
            error = (q.shape[1] + 8) * 2.0**-23 * norm * self.norm[a] + SLACK
            # Without a score to beat, or with numbers that single precision does not hold, all are scored exactly.
            plain = here & (np.isneginf(beat) | ~(norm * self.norm[a] < 1e30) | ~(norm < 1e30) | (self.norm[a] >= 1e30))
            near = np.flatnonzero(here & ~plain)
            x, y = np.searchsorted(self.hidden[:, 0], (a, z))
            hidden = self.hidden[x:y][at[self.hidden[x:y, 1]] >= 0]
            codes = at[hidden[:, 1]] * CHUNK + hidden[:, 0] - a
            if len(near):
                i, j = np.divmod(np.flatnonzero((short[near] @ self.short[a:z].T >= (beat - error)[near, None].astype(np.float32)).ravel()), z - a)
                i = near[i]
                score = np.round(np.einsum("ij,ij->i", q[i], self.items[a + j]), DECIMALS)
                good = score >= beat[i]
                if len(codes):
                    good &= ~np.isin(i * CHUNK + j, codes)
                kept.append((i[good], a + j[good], score[good]))
                waiting += int(good.sum())
            if plain.any():
                rows = np.flatnonzero(plain)
                score = np.full((n, z - a), -np.inf)
                score[rows] = np.round(q[rows] @ self.items[a:z].T, DECIMALS)
                score[np.isnan(score)] = -np.inf
                score[codes // CHUNK, codes % CHUNK] = -np.inf
                score[score < beat[:, None]] = -np.inf
                best = _first(score, np.broadcast_to(self.place[a:z], score.shape), k)
                i, r = np.nonzero(best >= 0)
                kept.append((i, a + best[i, r], score[i, best[i, r]]))
                waiting += len(i)
            if waiting >= n * min(k, 64) or (plain.any() and waiting >= n):
                in_order()
                waiting = 0
        in_order()
        return kept[0]


def _first(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties by smaller place; -1 where there are fewer finite ones."""
    m = score.shape[1]
    if m > k:
        least = np.partition(score, m - k, axis=1)[:, m - k, None]
        i, j = np.nonzero((score >= least) & (score > -np.inf))
    else:
        i, j = np.nonzero(score > -np.inf)
    order = np.lexsort((place[i, j], -score[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    out = np.full((len(score), k), -1)
    out[i[rank < k], rank[rank < k]] = j[rank < k]
    return out


def _blocks_to(least: str, norms: list[float]) -> Callable[[Column], Column]:
    """How many of the first blocks a query needs whose items must score `least` (a column): those whose bound reaches it."""
    bounds = F.split(F.lit(",".join(map(repr, norms))), ",").cast("array<double>")
    return lambda norm: F.size(F.filter(bounds, lambda m: m * norm * (1 + 1e-12) + SLACK >= F.col(least)))


def best_of_cell(queries: DataFrame, items: DataFrame, k: int, parts: tuple[float, ...], exclude_same_id: bool = False) -> tuple[Callable, str]:
    """What finds a cell's k best items for each of its queries (columns query_id, vecs, norm, least), none below `least`, and the schema of (query_id, item_id, ranked, score, part_0...)."""
    kinds = [d.schema[c].dataType for d, c in ((queries, "query_id"), (items, "item_id"))]
    names = ["query_id", "item_id", "ranked", "score", *[f"part_{p}" for p in range(len(parts))]]
    schema = ", ".join(f"{n} {kinds[i].simpleString() if i < 2 else 'double'}" for i, n in enumerate(names))
    types = [*map(to_arrow_type, kinds), *[pa.float64()] * (2 + len(parts))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        cell = Cell(left, right, parts, exclude_same_id)
        cuts = np.cumsum([0, *cell.parts])
        found = []
        for t in range(0, len(left), TILE):
            tile = np.arange(t, min(t + TILE, len(left)))
            i, j, score = cell.best_of_tile(tile, left["least"].to_numpy()[tile], k)
            dots = [np.einsum("ij,ij->i", cell.raw[tile[i], a:z], cell.items[j, a:z]) for a, z in zip(cuts, cuts[1:])]
            found.append((tile[i], j, score, sum(w * d for w, d in zip(parts, dots)), *dots))
        i, j, *numbers = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays([left["query_id"].take(pa.array(i)), cell.right["item_id"].take(pa.array(j)), *map(pa.array, numbers)], names)

    return run, schema


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, of what cells found."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ranked"), "item_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("ranked")


class Best:
    """The k best rows (query, item, ranked, score, part...) of each of n queries so far; least: what a row must not fall below."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.n, self.k, self.least = n, k, least.copy()
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, *row: np.ndarray) -> None:
        self.rows.append(row)
        self.waiting += len(row[0])
        if self.waiting >= self.n * self.k:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """The rows in order, of each query the best first; ties by smaller id."""
        if len(self.rows) > 1 or self.waiting:
            i, ids, ranked, *rest = (np.concatenate(c) for c in zip(*self.rows))
            order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], -ranked, i))
            rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            order, rank = order[rank < self.k], rank[rank < self.k]
            self.rows, self.waiting = [tuple(c[order] for c in (i, ids, ranked, *rest))], 0
            i, _, ranked = self.rows[0][:3]
            kth = rank == self.k - 1
            self.least[i[kth]] = np.maximum(self.least[i[kth]], ranked[kth])
        return self.rows[0] if self.rows else ()


def _numbers(ids: pa.ChunkedArray) -> np.ndarray:
    return ids.to_numpy() if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=object)


def best_of_files(queries: DataFrame, item_kind, k: int, weights: tuple[float, ...], cells: Callable[[pa.Table, Best], Iterator[tuple[np.ndarray, pa.Table]]], *, exclude_same_id: bool = False, whole: bool = False) -> tuple[Callable, str]:
    """What finds the k best items of each query of a block, and the schema of (query_id, item_id, ranked, score, part_0...), or where whole of (query_id, rank, item_id, score, part_0...).

    cells(block, best so far) gives the items that some of the block's queries (their numbers) meet, table by table: these
    are read from the shared folder by the task, so they are sent nowhere, and a block passes on k rows a query, whatever
    the number of items. A single part of weight 1 is the score, and no column.
    """
    kinds = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(item_kind)]
    n_parts = len(weights) if weights != (1.0,) else 0
    names = ["query_id", *(["rank", "item_id"] if whole else ["item_id", "ranked"]), "score", *[f"part_{p}" for p in range(n_parts)]]
    given = {"query_id": queries.schema["query_id"].dataType.simpleString(), "item_id": item_kind.simpleString(), "rank": "int"}
    schema = ", ".join(f"{n} {given.get(n, 'double')}" for n in names)
    types = pa.schema([(n, {"query_id": kinds[0], "item_id": kinds[1], "rank": pa.int32()}.get(n, pa.float64())) for n in names])

    def run(left: pa.Table) -> pa.Table:
        best = Best(len(left), k, left["least"].to_numpy())
        for some, right in cells(left, best):
            if not len(some) or not len(right):
                continue
            cell = Cell(left.take(pa.array(some)), right, weights, exclude_same_id)
            cuts, ids = np.cumsum([0, *cell.parts]), _numbers(cell.right["item_id"])
            for t in range(0, len(some), TILE):
                tile = np.arange(t, min(t + TILE, len(some)))
                i, j, ranked = cell.best_of_tile(tile, best.least[some[tile]], k)
                dots = [np.einsum("ij,ij->i", cell.raw[tile[i], a:z], cell.items[j, a:z]) for a, z in zip(cuts, cuts[1:])]
                best.add(some[tile[i]].astype(np.int32), ids[j], ranked, sum(w * d for w, d in zip(weights, dots)), *dots[:n_parts])
        rows = best.settle()
        if not rows:
            return types.empty_table()
        i, ids, ranked, *numbers = rows
        middle = [np.arange(len(i)) - np.searchsorted(i, i) + 1, ids] if whole else [ids, ranked]
        out = [left["query_id"].combine_chunks().take(pa.array(i)), *middle, *numbers]
        # In pieces, as the whole would be one batch.
        whole_table = pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, types)], schema=types)
        return pa.Table.from_batches(whole_table.to_batches(max_chunksize=1 << 16), types)

    return run, schema


def _item_files(sides: Sides, n: int) -> list[tuple[tuple[str, ...], float]]:
    """Files of items that are read together, and a bound of the norms in them and in those after them; of falling norm."""
    files = tuple(sorted(sides.items.inputFiles()))
    if n <= 1:
        return [(files, sides.norms[0])] if files else []
    largest = sides.items.groupBy(F.input_file_name().alias("file")).agg(F.max("norm").alias("norm")).collect()
    return [((r["file"],), r["norm"]) for r in sorted(largest, key=lambda r: -r["norm"])]


def block_topk(queries: DataFrame, items: DataFrame, k: int, parts: tuple[float, ...] = (1.0,), *, exclude_same_id: bool = False, masked: DataFrame | None = None, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(query_id, rank, item_id, score, part_0, part_1...): exact top-k by weighted sums of dot products.

    queries: query_id (once each), vecs (an array of one vector a part); items: item_id, vecs; masked: (query_id,
    item_id) pairs that take no part. Rows with a null id or vector take none either. Scores rank by their first 9
    decimals; ties go to the smaller id.

    Without masked pairs a task reads the items block by block, of falling norm, for its block of queries, and ends where
    no bound reaches what its queries have: one job, no item is sent and k rows a query are passed on. Where there are
    fewer blocks of queries than shuffle partitions, the items after the first block are dealt to several tasks each.

    With them it is two jobs, whatever the sizes: all queries meet the block of largest norms, which gives each a score to
    beat; then each meets the blocks whose bound is not below that, and passes on what beats it.
    """
    # A task that reads the items makes ready all of them, so its block of queries is not too small.
    sides = laid_out(queries.select("query_id", "vecs"), items, parts, masked, query_block, item_block, TILE if masked is not None else 2 * TILE)
    lowest = F.lit(float("-inf"))
    if masked is None:
        return _by_files(sides, k, parts, exclude_same_id)
    run, schema = best_of_cell(sides.queries, sides.items, k, parts, exclude_same_id)
    made = sides.made
    found = written(_cells(sides, sides.queries.withColumn("least", lowest), lambda norm: F.lit(1), 0, run, schema), "grid-first")
    if len(sides.norms) > 1:
        q = _with_least(sides.queries, found, k)
        beaten = written(_cells(sides, q, _blocks_to("least", sides.norms), 1, run, schema), "grid-rest")
        found, made = found.unionByName(beaten), [*made, q]
    dropped(*made)
    return first_k(found, k)


def _with_least(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """queries with the score to beat: that of the k-th row found, if there are so many."""
    kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("ranked").alias("least")).filter(F.col("n") >= k).select("query_id", "least")
    return written(queries.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "grid-least")


def _by_files(sides: Sides, k: int, weights: tuple[float, ...], exclude_same_id: bool) -> DataFrame:
    files, kind = _item_files(sides, len(sides.norms)), sides.items.schema["item_id"].dataType
    id_type = to_arrow_type(kind)
    lanes = min(len(files) - 1, -(-int(sides.items.sparkSession.conf.get("spark.sql.shuffle.partitions")) // sides.blocks)) if len(files) > 1 else 1

    def search(queries: DataFrame, some: list[tuple[tuple[str, ...], float]], lanes: int, whole: bool) -> DataFrame:
        def cells(left: pa.Table, best: Best) -> Iterator[tuple[np.ndarray, pa.Table]]:
            norm, lane = left["norm"].to_numpy(), left["lane"][0].as_py()
            for names, bound in some[lane::lanes]:
                best.settle()
                here = np.flatnonzero(norm * bound * (1 + 1e-12) + SLACK >= best.least)
                if not len(here):
                    return
                tables = list(read_here(names, ["item_id", "vecs", "norm"]))
                if tables:
                    t = pa.concat_tables(tables)
                    yield here, t.set_column(0, "item_id", t["item_id"].cast(id_type))

        run, schema = best_of_files(queries, kind, k, weights, cells, exclude_same_id=exclude_same_id, whole=whole)
        dealt = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        # By range, as blocks by hash would meet in some tasks and leave others none.
        return dealt.repartitionByRange(sides.blocks * lanes, "block", "lane").groupBy("block", "lane").applyInArrow(run, schema)

    q = sides.queries.withColumn("least", F.lit(float("-inf")))
    if lanes == 1:
        found = written(search(q, files, 1, True), "grid-found")
        dropped(*sides.made)
    else:
        first = written(search(q, files[:1], 1, False), "grid-first")
        q = _with_least(sides.queries, first, k)
        rest = written(search(q, files[1:], lanes, False), "grid-rest")
        dropped(*sides.made, q)
        found = first_k(first.unionByName(rest), k)
    return found.withColumn("part_0", F.col("score")) if weights == (1.0,) else found


def ranks_by_counting(queries: DataFrame, items: DataFrame, *, masked: DataFrame | None = None, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(query_id, rank) of each query's own target among all items: 1 and the number of items that come before it.

    queries: query_id (once each), vecs (an array of one vector), target (an item's id) and goal (its score). An item
    comes before the target if it scores more by the first 9 decimals, or as much and has the smaller id; masked pairs
    take no part. One job: no list of items is made, only a sum a cell and query; a query meets only the blocks whose
    bound reaches its goal.
    """
    q = queries.select("query_id", "vecs", "target", F.round("goal", DECIMALS).alias("goal"))
    sides = laid_out(q, items, (1.0,), masked, query_block, item_block)
    kind = sides.queries.schema["query_id"].dataType.simpleString()
    id_type = to_arrow_type(sides.queries.schema["query_id"].dataType)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], id_type), pa.array([], pa.int64())], ["query_id", "before"])
        cell = Cell(left, right, (1.0,), False)
        goal, before = left["goal"].to_numpy(), np.zeros(len(left), dtype=np.int64)
        ids, targets = [cell.ids[i] for i in cell.order], left["target"].to_pylist()
        smaller = np.array([bisect_left(ids, t) for t in targets], dtype=np.int64)
        own = np.array([n if n < len(ids) and ids[n] == t else -1 for n, t in zip(smaller.tolist(), targets)])
        for tile, a, score in cell.chunks(lambda bound: bound >= goal):
            g, place = goal[tile, None], cell.place[None, a : a + score.shape[1]]
            # The target itself is left out, as its goal may be rounded elsewhere.
            before[tile] += (((score > g) | ((score == g) & (place < smaller[tile, None]))) & (place != own[tile, None])).sum(1)
        return pa.Table.from_arrays([left["query_id"], pa.array(before)], ["query_id", "before"])

    counted = written(_cells(sides, sides.queries, _blocks_to("goal", sides.norms), 0, run, f"query_id {kind}, before long"), "grid-counts")
    asked = written(sides.queries.select("query_id"), "grid-asked")
    dropped(*sides.made)
    # A query that no block can beat is in no cell.
    return asked.select("query_id", F.lit(0).cast("long").alias("before")).unionAll(counted).groupBy("query_id").agg((F.sum("before") + 1).alias("rank"))
