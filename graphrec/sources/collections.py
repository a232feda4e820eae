"""Named vector collections as tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import create, dropped, exists, folders, remove, written

STORED = "collection string, item_id long, embedding array<float>, source string"
RECORD = "bucket int, written_in int, buckets int, metric string"
METRICS = ("cosine", "l2", "ip")


def vector_upsert(collection: DataFrame | None, batches: DataFrame, order: str = "batch", reset: bool = False) -> DataFrame:
    """(collection, item_id, embedding, source) after `batches` (with an order column) were put in; the last write of an id wins.

    Ties within a batch go to the larger source, then vector. `reset` empties the collection first.
    """
    new = batches.select("collection", "item_id", "embedding", "source", F.col(order).cast("long").alias("_at"))
    if collection is not None and not reset:
        new = collection.select("collection", "item_id", "embedding", "source", F.lit(None).cast("long").alias("_at")).unionAll(new)
    last = F.max_by(F.struct("embedding", "source"), F.struct(F.coalesce("_at", F.lit(-(2**62))), "source", "embedding"))
    return new.groupBy("collection", "item_id").agg(last.alias("v")).select("collection", "item_id", "v.embedding", "v.source")


def collection_coverage(text: DataFrame, graph: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(in_text, in_graph, n): how many ids lie in which collections."""
    t, g = (d.select(id_col).distinct().withColumn(c, F.lit(True)) for d, c in ((text, "in_text"), (graph, "in_graph")))
    both = t.join(g, id_col, "full_outer")
    return both.groupBy(F.coalesce("in_text", F.lit(False)).alias("in_text"), F.coalesce("in_graph", F.lit(False)).alias("in_graph")).agg(F.count(F.lit(1)).alias("n"))


class Stored(NamedTuple):
    """What a stored collection's record says: its version, number of buckets, metric, and the version that each bucket was last written in."""

    version: int
    buckets: int
    metric: str
    written_in: dict[int, int]


def _records(spark: SparkSession, path: str) -> dict[int, bool]:
    """The records under path, and which are complete: those with the marker that Spark writes last."""
    found = {int(n.split("=")[1]): f"{path}/records/{n}" for n in folders(spark, f"{path}/records") if re.fullmatch(r"version=\d+", n)}
    return {v: exists(spark, f"{found[v]}/_SUCCESS") for v in sorted(found)}


def stored(spark: SparkSession, path: str) -> Stored | None:
    """The newest complete record of a collection, None where there is none. The driver gets a row a bucket."""
    complete = [v for v, whole in _records(spark, path).items() if whole]
    if not complete:
        return None
    rows = spark.read.schema(RECORD).parquet(f"{path}/records/version={complete[-1]:08d}").collect()
    return Stored(complete[-1], rows[0]["buckets"], rows[0]["metric"], {r["bucket"]: r["written_in"] for r in rows if r["written_in"]})


def _read(spark: SparkSession, path: str, at: Stored, buckets: Iterable[int]) -> DataFrame:
    files = [f"{path}/vectors/version={at.written_in[b]:08d}/bucket={b}" for b in sorted(buckets) if b in at.written_in]
    return spark.read.schema(STORED).parquet(*files) if files else spark.createDataFrame([], STORED)


def read_collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a stored collection, None where there is none."""
    at = stored(spark, path)
    return None if at is None else _read(spark, path, at, at.written_in)


def collection_metric(spark: SparkSession, path: str) -> str | None:
    """The metric that a stored collection was made with."""
    at = stored(spark, path)
    return None if at is None else at.metric


def upsert_collection(path: str, batches: DataFrame, reset: bool = False, keep: int = 2, buckets: int = 16, metric: str | None = None, break_lock: bool = False) -> DataFrame:
    """Puts batches into the collection stored under path, which the first call makes; returns it as it is then.

    Ids lie in buckets by hash; a call reads and writes only the buckets that its ids fall in, in a folder of its own,
    and then a record that says for each bucket in which version it was last written. The marker that Spark adds to the
    record last is the only thing that makes the version count, so readers see the collection before or after, never half
    of it, and a job that fails leaves it as it was. buckets and metric (cosine, l2 or ip) are the collection's for good;
    a call that states another metric is an error, unless it resets. Records before the last `keep` are removed, with
    the buckets that none of those left names; whoever reads them has finished.

    A collection is locked while it is written: a second writer finds the lock and is refused with a RuntimeError.
    break_lock passes over the lock of a writer that died. buckets: so that one has some hundred megabytes.
    """
    spark = batches.sparkSession
    at = stored(spark, path)
    if metric is not None and metric not in METRICS:
        raise ValueError(f"{metric} is none of {', '.join(METRICS)}")
    if at is not None and not reset and metric not in (None, at.metric):
        raise ValueError(f"{path} has the metric {at.metric}, not {metric}")
    made = Stored(0, buckets, metric or "cosine", {}) if at is None or reset else at
    lock = f"{path}/lock"
    if not create(spark, lock) and not break_lock:
        raise RuntimeError(f"{path} is being written by another writer; {lock} stands until it is done (break_lock if it died)")
    try:
        at = stored(spark, path)  # as it is under the lock
        made = made if at is None or reset else at
        new = max([*_records(spark, path), *(int(n.split("=")[1]) for n in folders(spark, f"{path}/vectors"))], default=0) + 1
        place = F.pmod(F.xxhash64("item_id"), F.lit(made.buckets)).cast("int")
        batches = written(batches, "upsert-batches")
        touched = [r["bucket"] for r in batches.select(place.alias("bucket")).distinct().collect()]
        merged = vector_upsert(_read(spark, path, made, touched), batches).withColumn("bucket", place)
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/vectors/version={new:08d}")
        record = [(b, new if b in touched else made.written_in.get(b, 0), made.buckets, made.metric) for b in range(made.buckets)]
        spark.createDataFrame(record, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/records/version={new:08d}")
        dropped(batches)
        _forget(spark, path, keep)
    finally:
        remove(spark, lock)
    return read_collection(spark, path)


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """Removes records before the last `keep` complete ones, and versions of vectors that no record left names."""
    records = _records(spark, path)
    kept = [v for v, whole in records.items() if whole][-keep:]
    for v in records:
        if v < kept[0]:
            remove(spark, f"{path}/records/version={v:08d}")
    rows = spark.read.schema(RECORD).parquet(*[f"{path}/records/version={v:08d}" for v in kept]).select("bucket", "written_in").distinct().collect()
    named = {(r["written_in"], r["bucket"]) for r in rows}
    for folder in folders(spark, f"{path}/vectors"):
        v = int(folder.split("=")[1])
        if v > kept[-1]:
            continue
        mine = [b for b in folders(spark, f"{path}/vectors/{folder}") if b.startswith("bucket=")]
        gone = [b for b in mine if (v, int(b.split("=")[1])) not in named]
        for at in [folder] if len(gone) == len(mine) else [f"{folder}/{b}" for b in gone]:
            remove(spark, f"{path}/vectors/{at}")
