"""Readers of logs, catalogues, texts and embeddings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import exists, folders
from .schemas import EVENT_ALIASES, ITEM_NAMES


def _read(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """line_breaks: quoted values may hold line breaks; a CSV file is then read by one task, whatever its size."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, multiLine=line_breaks, quote='"', escape='"', inferSchema=False)


def read_events(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """An event log with trimmed lower-case headers, all text but the time, ds_search_id null where the log has none.

    CSV files are split among tasks; with line_breaks quoted values may hold line breaks, and a file is one task's.
    """
    d = _read(spark, path, line_breaks)
    d = d.toDF(*[c.strip().lower() for c in d.columns])
    if "ds_search_id" not in d.columns:
        d = d.withColumn("ds_search_id", F.lit(None).cast("string"))
    return d.select("event_type", "client_id", "item_id", "ds_search_id", "timestamp", *[c for c in ("event_id",) if c in d.columns])


def read_items(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame | None:
    """The catalogue (item_id, title, description), or None where there is no file or no item_id in it.

    Descriptions may hold line breaks, so a CSV file is one task's unless line_breaks is off; a large catalogue is given
    in several files, or as Parquet.
    """
    if not exists(spark, path):
        return None
    return standardize_items(_read(spark, path, line_breaks))


def standardize_items(d: DataFrame) -> DataFrame | None:
    d = d.toDF(*[c.strip().lower() for c in d.columns])
    if "item_id" not in d.columns:
        return None
    d = d.withColumnsRenamed(ITEM_NAMES)
    return d.select(F.col("item_id").cast("string").alias("item_id"), *[(F.col(c).cast("string") if c in d.columns else F.lit(None).cast("string")).alias(c) for c in ("title", "description")])


def standardize_event_columns(d: DataFrame) -> DataFrame:
    """d with client_id, item_id and timestamp under those names, found by alias; a ValueError tells which lack."""
    bare = {c: re.sub(r"[\s\-﻿_]", "", c).lower() for c in d.columns}
    found, missing = {}, []
    for name, aliases in EVENT_ALIASES.items():
        hit = next((c for a in aliases for c in d.columns if bare[c] == a.replace("_", "")), None)
        if hit is None:
            missing.append(f"{name} (any of {', '.join(aliases)})")
        else:
            found[hit] = name
    if missing:
        raise ValueError(f"missing: {'; '.join(missing)}; the log has {', '.join(d.columns)}")
    rest = {c: c.strip().lower() for c in d.columns if c not in found and c.strip().lower() not in found.values()}
    return d.select(*[F.col(f"`{c}`").alias(n) for c, n in {**found, **rest}.items()])


def read_text_input(spark: SparkSession, parquet: str, csv: str, required: tuple[str, ...]) -> DataFrame:
    """Texts from Parquet if there is any, else CSV; a ValueError where both or a required column lack."""
    path = next((p for p in (parquet, csv) if p and exists(spark, p)), None)
    if path is None:
        raise ValueError(f"neither {parquet} nor {csv} exists")
    d = spark.read.parquet(path) if path == parquet else _read(spark, path, line_breaks=True)
    lacking = [c for c in required if c not in d.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return d


def pack_vectors(wide: DataFrame, id_col: str) -> DataFrame:
    """id, 0, 1, ... D-1 -> (item_id, embedding)."""
    dims = sorted((c for c in wide.columns if c.isdigit()), key=int)
    return wide.select(F.col(id_col).cast("long").alias("item_id"), F.array(*[F.col(f"`{c}`").cast("float") for c in dims]).alias("embedding"))


def unpack_vectors(vectors: DataFrame, dims: int, id_col: str = "item_id", vector_col: str = "embedding") -> DataFrame:
    return vectors.select(id_col, *[F.get(vector_col, F.lit(k)).alias(str(k)) for k in range(dims)])


def ids_with_vectors(ids: DataFrame, vectors: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Ids and vectors kept apart, put together by position; the longer one is cut."""
    return ids.join(vectors, ordinal)


def latest_run(runs: DataFrame, sources: tuple[str, ...] = (), run_col: str = "run_id", source_col: str = "source") -> DataFrame:
    """The rows of the newest run; with `sources`, of the first of these that has any run."""
    if sources:
        place = F.array_position(F.array(*map(F.lit, sources)), F.col(source_col))
        runs = runs.withColumn("_place", place).filter("_place > 0")
        best = runs.agg(F.min_by(F.struct("_place", run_col), F.struct(F.col("_place"), -F.unix_timestamp(F.to_timestamp(run_col, "yyyyMMdd'T'HHmmss'Z'")))).alias("b")).select("b.*")
        return runs.join(F.broadcast(best), ["_place", run_col], "left_semi").drop("_place")
    newest = runs.agg(F.max(run_col).alias(run_col))
    return runs.join(F.broadcast(newest), run_col, "left_semi")


def newest_run(spark: SparkSession, path: str) -> str:
    """path, or where it holds folders named by run ids the newest of these; a ValueError where there is neither."""
    runs = [n for n in folders(spark, path) if re.fullmatch(r"\d{8}T\d{6}Z", n)]
    if runs:
        return f"{path.rstrip('/')}/{runs[-1]}"
    if not exists(spark, path):
        raise ValueError(f"{path} does not exist")
    return path
