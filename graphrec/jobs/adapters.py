"""The driver's tables as logs, catalogues, texts and vectors of the shapes the jobs take; whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import clean_events, event_weights
from ..operators.graph import build_edges

DIM = 32


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as an interaction log; a third of the session ids are missing."""
    session = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("s"), F.expr("CAST(event_id div 10 AS STRING)")))
    return table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("client_id"), F.get_json_object("props", "$.k").alias("item_id"), session.alias("ds_search_id"), F.col("ts").cast("timestamp").alias("timestamp"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return clean_events(raw_events(spark, sf))


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return event_weights(events(spark, sf))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return build_edges(weighted(spark, sf))


def large_events(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as interactions of customers with parts: the log for benchmarks. event_id numbers lines by their place."""
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"), F.when(F.col("l_returnflag") == "R", "purchase").otherwise("click").alias("event_type"), F.col("o_custkey").cast("string").alias("client_id"),
        F.col("l_partkey").cast("string").alias("item_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey").cast("string")).alias("ds_search_id"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )


def large_edges(spark: SparkSession, sf: str) -> DataFrame:
    return build_edges(event_weights(clean_events(large_events(spark, sf))))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("description"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("title"), F.col("text").alias("description"))


def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice("embedding", 1, DIM).alias("embedding"), F.lit("text").alias("source"))


def graph_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered 50 further on than the text vectors, so each set has ids that the other lacks."""
    return table(spark, sf, "embeddings").select((F.col("vec_id") + 50).alias("item_id"), F.slice("embedding", DIM + 1, DIM).alias("embedding"), F.lit("graph").alias("source"))


def user_vectors(spark: SparkSession, sf: str) -> DataFrame:
    users = events(spark, sf).select("client_id").distinct()
    return users.join(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("client_id"), "embedding"), "client_id")


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    shown = events(spark, sf).select("item_id").distinct()
    return shown.join(table(spark, sf, "embeddings").select((F.col("vec_id") - 300).cast("string").alias("item_id"), "embedding"), "item_id")
