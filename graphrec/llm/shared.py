"""What several operators of this subpackage need: tables, the shared work folder, numbering without large groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import dropped, work_dir, written  # noqa: F401  for this subpackage's modules

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets_for(df: DataFrame, rows_per_bucket: int) -> int:
    """Number of buckets so that each holds about rows_per_bucket rows, however large df is."""
    return max(1, math.ceil(df.count() / rows_per_bucket))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_bucket: int = 5_000) -> DataFrame:
    """Adds `out`: 0, 1, 2... within each combination of keys, without gathering a combination in one task.

    Rows are dealt to (keys, hash bucket); numbers within a bucket start after the sizes of the buckets before it.
    The same rows always get the same numbers; rows equal in `order` get theirs in any order. df is read three
    times, so pass a table. Keys must not be null.
    """
    n = buckets_for(df, rows_per_bucket)
    d = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    d = d.withColumn("_row", F.row_number().over(within) - 1)
    return d.join(starts, [*keys, "_bucket"]).withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_start").select(*df.columns, out)
