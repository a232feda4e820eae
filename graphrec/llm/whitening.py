"""Embedding whitening by one-sided Jacobi SVD of a blockwise TSQR."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: An entry's steps a unit, and what is added to each.
STEPS, SHIFT = 64, 1_000_000
#: Blocks that meet in a task when they are reduced to one.
FAN = 64


def shifted(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry as longs; null where the vector or an entry is null or not finite.

    An entry whose step does not fit in a long is an error, as it would otherwise stand for another one.
    """
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: F.when(F.abs(c.cast("double")) < 2.0**56, F.floor(c.cast("double") * STEPS) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large for whole steps")).cast("long"))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, step))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of dim longs; shorter vectors are filled up with the step of 0."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    if len(flat) == len(vectors) * dim and (np.diff(ends) == dim).all():
        return flat.reshape(len(vectors), dim)
    out = np.full((len(vectors), dim), SHIFT, dtype=np.int64)
    row = np.repeat(np.arange(len(vectors)), np.diff(ends))
    out[row, np.arange(len(flat)) - ends[:-1][row]] = flat
    return out


class Centre:
    """Whole and broken part of the mean S / n of each dimension, so that x - S / n is rounded once, however large the shift."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole, self.rest = (np.array(v, dtype=np.int64) for v in zip(*(divmod(s, n) for s in sums)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exactly: n^2 d.d - 2 n d.r + r.r with d = x - whole, r = rest."""
        d, n = x - self.whole, self.n
        most = int(np.abs(d).max(initial=0))
        if most * max(most, n) * len(self.rest) < 2**62:
            square, cross = (d * d).sum(1).tolist(), (d @ self.rest).tolist()
        else:
            exact = d.astype(object)
            square, cross = (exact * exact).sum(1).tolist(), exact.dot(self.rest.astype(object)).tolist()
        own = sum(int(r) ** 2 for r in self.rest)
        return [n * n * a - 2 * n * b + own for a, b in zip(square, cross)]


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """R of the blocks' rows together."""
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def moments(a: list[np.ndarray]) -> np.ndarray:
    """Of blocks (number of rows, sums, centred products) those of all rows together: [n, sum, products] in rows of one matrix."""
    total = a[0]
    for b in a[1:]:
        n, m = total[0, 0], b[0, 0]
        if not n or not m:
            total = b if not n else total
            continue
        delta = b[1] / m - total[1] / n
        total = np.concatenate([[total[0] + b[0], total[1] + b[1]], total[2:] + b[2:] + np.outer(delta, delta) * (n * m / (n + m))])
    return total


def reduced(d: DataFrame, block: Callable[[Iterator[np.ndarray]], np.ndarray], join: Callable[[list[np.ndarray]], np.ndarray], width: int, dim: int) -> np.ndarray:
    """One matrix of `width` columns for all vectors x of d (a table): each task makes one of its rows, FAN of them meet in a task until one is left."""
    schema = "block int, m binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = block(matrix(b.column(0), dim) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([made.tobytes()], pa.binary())], ["block", "m"])

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        together = join([np.frombuffer(m).reshape(-1, width) for m in part.sort_values("block")["m"]])
        return pd.DataFrame({"block": [key[0]], "m": [together.tobytes()]})

    # Each level is a table, so a lost executor costs no more than a level, and blocks do not change when read again.
    level = written(d.select("x").mapInArrow(first, schema), "white-blocks")
    while level.count() > 1:
        above = written(level.groupBy(F.floor(F.col("block") / FAN).cast("int").alias("above")).applyInPandas(meet, schema), "white-blocks")
        dropped(level)
        level = above
    found = np.frombuffer(bytes(level.first()["m"])).reshape(-1, width)
    dropped(level)
    return found


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of r, largest first: plane rotations make its columns orthogonal.

    A sweep takes every pair of columns once, in rounds of pairs without a common column, which are rotated together.
    Rotations are accumulated in the vectors; the lengths of the columns are the singular values, small ones with no
    larger relative error than large ones. Sweeps end when no pair is further from orthogonal than rounding.
    """
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((max(r.shape[0], 1), even)), np.eye(even)
    a[: r.shape[0], :d] = r
    seats = np.arange(even)
    tiny = np.finfo(float).tiny
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            p, q = seats[: even // 2], seats[even // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(xy) / np.maximum(np.sqrt(xx) * np.sqrt(yy), tiny)
            worst = max(worst, off.max(initial=0))
            turn = off > 1e-16
            safe = np.where(turn, xy, 1.0)
            with np.errstate(over="ignore"):
                zeta = (yy - xx) / (2 * safe)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst < 1e-15 * max(d, 8):
            break
    size = np.sqrt((a * a).sum(0))[:d]
    order = np.argsort(-size, kind="stable")
    return size[order], v[:d, :d][:, order]


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every row whose vector is whole.

    Returns id_col, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error. Rows
    with a null vector, or null or non-finite entries, are dropped. x = floor(64 c) + 1000000; the model is fitted on
    each distinct x once (n of them): its mean from exact sums, its R by TSQR of centred rows, tasks first, then 64
    blocks at a time, its components and deviations by one-sided Jacobi on R, the only matrix that reaches the driver
    (dimensions squared). Repeated rows and rows under one id are whitened each, null ids too; ids of whatever type pass
    as they are; other columns are ignored whatever their names. Vectors shorter than the longest count as filled up
    with zeros. Components without variance (beyond the rank of the fit list: one vector has none) cannot be whitened
    and are left out; an empty table gives no rows. A deviation that does not fit in a long, and an entry of 2**56 or
    more, are errors.
    """
    kind = vectors.schema[id_col].dataType
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col(id_col).alias("id"), shifted(F.col(vector_col)).alias("x")).filter("x IS NOT NULL"), "white-rows")
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = lambda d: d.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
    if not dim:
        return named(spark.createDataFrame([], schema))
    filled = rows.select(F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dim) - F.size("x"))).alias("x"))
    fit = written(filled.distinct(), "white-fit")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, dtype=np.int64), np.zeros(dim, dtype=np.int64)
        for b in batches:
            x = matrix(b.column(0), dim)
            n += len(x)
            high += (x >> 20).sum(0)
            low += (x & (1 << 20) - 1).sum(0)
        sums = pa.array([(int(h) << 20) + int(a) for h, a in zip(high, low)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), sums], ["k", "n", "s"])

    sums = fit.mapInArrow(add, "k int, n long, s decimal(38,0)").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()
    n = sums[0]["n"]
    centre = Centre(n, [int(r["s"]) for r in sums])

    def rest(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, dim))
        for x in blocks:
            r = triangle([r, centre.centred(x)])
        return r

    size, turned = jacobi(reduced(fit, rest, triangle, dim, dim))
    sound = min(components, int((size > size[0] * dim * np.finfo(float).eps).sum()) if size[0] > 0 else 0)
    if not sound:
        dropped(rows, fit)
        return named(spark.createDataFrame([], schema))
    explained = (size**2 / (size**2).sum())[:sound]
    project = turned[:, :sound] / (size[:sound] / math.sqrt(n))

    def spread(blocks: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((sound + 2, sound))
        for x in blocks:
            w = centre.centred(x) @ project
            own = w - w.mean(0)
            total = moments([total, np.concatenate([[np.full(sound, float(len(w))), w.sum(0)], own.T @ own])])
        return total

    error = float(np.abs(reduced(fit, spread, moments, sound, dim)[2:] / n - np.eye(sound)).max())
    dropped(fit)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            m = len(x)
            w, each = centre.centred(x) @ project, np.repeat(np.arange(m), sound)
            again = lambda v, t: pa.array(v, t).take(pa.array(each))
            constant = lambda v, t: pa.array(np.full(m * sound, v), t)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, sound + 1), m), pa.int32()), constant(n, pa.int64()), again(centre.deviations(x), pa.int64()),
                pa.array(w.ravel()), pa.array(np.tile(explained, m)), constant(error, pa.float64()),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return named(rows.mapInArrow(whitened, schema))
