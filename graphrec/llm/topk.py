"""Exact top-k inner products by exhaustive term-at-a-time accumulation, blocks of queries by blocks of rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.memory import give_back
from .shared import dropped, written

#: Rows and queries of a cell, and queries scored against its rows at a time.
BLOCK_ROWS, CELL_QUERIES, BLOCK_QUERIES = 16_384, 16_384, 64


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as longs; null where the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def matrix(vectors: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of longs as rows of `width` entries (of the longest list, if None): filled up with zeros, cut where longer."""
    lists = vectors.combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[:1], sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    here = at < width
    out[row[here], at[here]] = flat[here]
    return out


def best_of_block(ids: np.ndarray, rows: np.ndarray, block: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each query, as (query's place, row id, score).

    rows, q_rows: the number of each row and query; a query's own row is the one with its number.

    For each term (dimension) the queries that have it scatter their weight times the term's postings into dense score
    rows. float32 and float64 are used where they hold every sum exactly, else longs (which wrap round beyond 2**63).
    Rows are in order of id, so one partition over (score, place) breaks ties by the smaller id.
    """
    bound = float(np.abs(block).astype(float).sum(1).max(initial=0)) * float(np.abs(queries).astype(float).max(initial=0))
    kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64
    order = np.argsort(ids, kind="stable")
    ids, rows, block = ids[order], rows[order], np.ascontiguousarray(block[order].T.astype(kind))
    n, out = len(ids), []
    postings = [(np.flatnonzero(term), term) for term in block]
    for a in range(0, len(q_rows), BLOCK_QUERIES):
        q = queries[a : a + BLOCK_QUERIES].astype(kind)
        scores = np.zeros((len(q), n), dtype=kind)
        for d, (having, term) in enumerate(postings):
            have = np.flatnonzero(q[:, d])
            if not len(having) or not len(have):
                continue
            if 2 * len(having) > n and 2 * len(have) > len(q):  # few zeros: adding them is cheaper than passing over them
                scores += q[:, d, None] * term
            else:
                scores[np.ix_(have, having)] += q[have, d, None] * term[having]
        own = q_rows[a : a + len(q), None] == rows[None, :]
        exact = scores.astype(np.int64)
        for i in range(len(q)):
            here = np.flatnonzero(~own[i]) if own[i].any() else np.arange(n)
            s = exact[i, here]
            if len(here) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                sure, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
                best = np.concatenate([sure, ties[: k - len(sure)]])
            else:
                best = np.arange(len(here))
            out.append((np.full(len(best), a + i), ids[here[best]], s[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, rank, id_col, score): for each row whose id is divisible by `every`, its k highest-scoring others.

    The stated query set is scored against all rows in cells: a block of at most about cell_queries queries by one of
    about block_rows rows, each cell in one task. One job, whatever the sizes: a row is sent to each block of queries, a
    query to each block of rows, and what leaves a cell is k rows a query at most, which meet by query.
    Ties go to the smaller id. Vectors with null or non-finite components, null vectors and null ids take no part.
    Vectors of another length count as if filled up with zeros. Of rows repeated under one id each is a query of its own
    (their answers stand under the one query_id, ranked each) and a candidate for all others, its equals among them.
    """
    spark, asks = vectors.sparkSession, F.pmod("id", F.lit(every)) == 0
    d = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    # Numbers of rows are written, so they are the same wherever a row is read again; blocks by number are even, whatever ids repeat.
    rows = written(d.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(asks).alias("asked")).first()
    # Few rows are dealt to as many blocks as there are partitions of a shuffle.
    some = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n["all"] / 1024))
    row_blocks, query_blocks = max(1, math.ceil(n["all"] / block_rows), some), max(1, math.ceil(n["asked"] / cell_queries))
    own = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.filter(asks).select("row", "id", "v", own(query_blocks).alias("q"), each(row_blocks).alias("r"))
    sent = rows.select("row", "id", "v", each(query_blocks).alias("q"), own(row_blocks).alias("r"))

    names = ["query", "query_id", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        queries = matrix(left["v"])
        q_rows, q_ids = left["row"].to_numpy(), left["id"].to_numpy()
        i, found, score = best_of_block(right["id"].to_numpy(), right["row"].to_numpy(), matrix(right["v"], queries.shape[1]), q_rows, queries, k)
        give_back()
        return pa.table([q_rows[i], q_ids[i], found, score.astype(np.int64)], names)

    cells = asked.groupBy("q", "r").cogroup(sent.groupBy("q", "r")).applyInArrow(run, ", ".join(f"{c} long" for c in names))
    candidates = written(cells, "topk-candidates")
    dropped(rows)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
