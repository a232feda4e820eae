"""Sinks: every run's artifacts carry its run id and lie under a path by it."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_ID = "yyyyMMdd'T'HHmmss'Z'"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_summary(summary: DataFrame, path: str, run_id: str) -> None:
    """A one-row summary as JSON, CSV and `key: value` lines."""
    d = summary.withColumn("run_id", F.lit(run_id)).coalesce(1)
    d.write.mode("overwrite").json(f"{path}/json")
    d.write.mode("overwrite").csv(f"{path}/csv", header=True)
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in d.columns])
    d.select(F.explode(lines).alias("value")).write.mode("overwrite").text(f"{path}/text")


def write_params(spark: SparkSession, params: object, path: str, run_id: str) -> None:
    d = spark.range(1).select(F.lit(run_id).alias("run_id"), *[F.lit(v).alias(k) for k, v in asdict(params).items()])
    d.write.mode("overwrite").json(path)


def write_top_tables(items: DataFrame, users: DataFrame, path: str) -> None:
    """Top-N tables: as few rows as asked for, so one file each."""
    items.coalesce(1).write.mode("overwrite").csv(f"{path}/items", header=True)
    users.coalesce(1).write.mode("overwrite").csv(f"{path}/users", header=True)


def write_clean_text(texts: DataFrame, path: str) -> None:
    d = texts.select("item_id", "text_raw", "text_clean", "wc")
    d.write.mode("overwrite").parquet(f"{path}/parquet")
    d.write.mode("overwrite").csv(f"{path}/csv", header=True, quote='"', escape='"')


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def write_eval(metrics: DataFrame, path: str, run_id: str, **provenance: str) -> None:
    d = metrics.withColumn("run_id", F.lit(run_id)).withColumn("provenance", F.struct(*[F.lit(v).alias(k) for k, v in {"job": "evaluate", **provenance}.items()]))
    d.write.mode("overwrite").json(path)


def write_grid(results: DataFrame, best: DataFrame, path: str, k: int) -> None:
    """One document: {K, best, all[]}; a row a configuration."""
    every = results.agg(F.sort_array(F.collect_list(F.struct(*results.columns))).alias("all"))
    d = every.join(F.broadcast(best.select(F.struct(*best.columns).alias("best")))).select(F.lit(k).alias("K"), "best", "all")
    d.write.mode("overwrite").json(path)


def write_recs(recs: DataFrame, path: str) -> None:
    recs.write.mode("overwrite").csv(path, header=True)
