"""The workloads as commands: python -m graphrec.jobs.run graph|train|grid|items|collections|recommend --help."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import components, events, graph, lightgcn, ranking, split, text, vectors
from ..sources import collections, readers, writers
from .params import Params


def _weighted(spark: SparkSession, path: str, p: Params):
    log, dropped = events.clean_events_counted(readers.standardize_event_columns(readers.read_events(spark, path)))
    if "event_id" not in log.columns:
        log = log.withColumn("event_id", F.xxhash64(*log.columns))  # a stated order for ties where the log has none
    log = written(log, "log")
    return dropped.get, log, events.event_weights(log, click=p.weight_click, purchase=p.weight_purchase, boost=p.session_boost, half_life_days=p.half_life_days, boost_missing=p.boost_missing_session)


def graph_job(spark: SparkSession, log: str, items: str | None, out: str, p: Params, run_id: str) -> None:
    """Graph, summary (with the events dropped by reason, and a sketch of the weights beside it), percentiles, components and top tables of a log."""
    counts, _, weighted = _weighted(spark, log, p)
    edges = written(graph.build_edges(weighted), "edges")
    catalogue = readers.read_items(spark, items) if items else None
    if catalogue is not None:
        catalogue = graph.item_dedupe_first(catalogue, ["title", "description"])
    nodes = graph.distinct_nodes(edges)
    writers.write_graph(nodes if catalogue is None else graph.attach_item_metadata(nodes, catalogue), edges, f"{out}/graph/{run_id}")
    pairs = edges.select(F.concat(F.lit("u:"), "client_id").alias("u"), F.concat(F.lit("i:"), "item_id").alias("i"))
    parts = components.connected_components(pairs, "u", "i").agg(F.countDistinct("component").alias("components"))
    summary = graph.graph_summary(edges).join(F.broadcast(graph.weight_stats(edges))).join(F.broadcast(parts))
    summary = summary.withColumns({f"events_{k}": F.lit(v) for k, v in counts.items()})
    writers.write_summary(summary, f"{out}/summary/{run_id}", run_id)
    graph.weight_sketch(edges).write.mode("overwrite").parquet(f"{out}/weight_sketch/{run_id}")
    graph.degree_percentiles(edges).write.mode("overwrite").json(f"{out}/percentiles/{run_id}")
    writers.write_top_tables(graph.top_items(edges, catalogue, p.top_n), graph.top_users(edges, p.top_n), f"{out}/top/{run_id}")
    writers.write_params(spark, p, f"{out}/params/{run_id}", run_id)


def train_job(spark: SparkSession, log: str, out: str, p: Params, run_id: str, train_on: str = "all") -> None:
    """Embeddings of a log, the loss of each step, and metrics on each client's last event.

    train_on: "all" trains on these events too, so that metrics tell how well they are remembered; "train" leaves them out.
    """
    _, raw, weighted = _weighted(spark, log, p)
    if train_on == "train":
        rest = split.train_minus_last(events.drop_incomplete(raw))
        weighted = events.event_weights(rest, click=p.weight_click, purchase=p.weight_purchase, boost=p.session_boost, half_life_days=p.half_life_days, boost_missing=p.boost_missing_session, reference=events.reference_time(raw))
    elif train_on != "all":
        raise ValueError(f"train_on is all or train, not {train_on}")
    trained = lightgcn.lightgcn_train(graph.interactions(weighted), dim=p.dim, layers=p.layers, epochs=p.epochs, batch_users=p.batch_users, neg_per_pos=p.neg_per_pos, lr=p.lr, seed=p.seed)
    writers.write_embeddings(trained.users, f"{out}/users/{run_id}")
    writers.write_embeddings(trained.items, f"{out}/items/{run_id}")
    trained.losses.coalesce(1).write.mode("overwrite").json(f"{out}/losses/{run_id}")
    users, items = (spark.read.parquet(f"{out}/{x}/{run_id}") for x in ("users", "items"))
    writers.write_eval(ranking.evaluate(users, items, events.drop_incomplete(raw)), f"{out}/eval/{run_id}", run_id, train_on=train_on)


def trained_grid(log: DataFrame, p: Params, dims: tuple[int, ...], layers: tuple[int, ...], negatives: tuple[int, ...], k: int, halving: tuple[int, ...] = ()) -> DataFrame:
    """Metrics of every configuration, all trained in the same jobs on the log (cleaned events) without each client's last event.

    halving: after so many epochs each, only the better half of the configurations (by recall + ndcg) goes on; the others
    are evaluated as they are then.
    """
    log = written(events.drop_incomplete(log), "grid-log")
    train = split.train_minus_last(log)
    weighted = events.event_weights(train, click=p.weight_click, purchase=p.weight_purchase, boost=p.session_boost, half_life_days=p.half_life_days, boost_missing=p.boost_missing_session)
    edges = written(graph.interactions(weighted), "grid-edges")
    grid = [lightgcn.Config(*c) for c in product(dims, layers, negatives)]

    def better_half(epoch: int, found: dict[int, lightgcn.Trained]) -> set[int]:
        if epoch + 1 not in halving:
            return set(found)
        scores = {}
        for i, t in found.items():
            m = ranking.evaluate(t.users, t.items, log, (k,)).first()
            scores[i] = m["recall"] + m["ndcg"]
        return set(sorted(scores, key=lambda i: (-scores[i], i))[: max(1, len(scores) // 2)])

    trained = lightgcn.lightgcn_train_many(edges, grid, epochs=p.epochs, batch_users=p.batch_users, lr=p.lr, seed=p.seed, survivors=better_half if halving else None)
    return ranking.grid_search(lambda *c: trained[grid.index(lightgcn.Config(*c))][:2], log, dims, layers, negatives, k)


def grid_job(spark: SparkSession, log: str, out: str, p: Params, run_id: str, dims: tuple[int, ...] = (32, 64, 128), layers: tuple[int, ...] = (2, 3), negatives: tuple[int, ...] = (1, 2), halving: tuple[int, ...] = ()) -> None:
    """A grid of trainings, and the best of them."""
    results = trained_grid(_weighted(spark, log, p)[1], p, dims, layers, negatives, p.k, halving)
    writers.write_grid(results, ranking.grid_best(results), f"{out}/grid/{run_id}", p.k)


def _named_encoder(name: str) -> Callable[[list[str]], np.ndarray]:
    """The function module:function, or an object of module:Class."""
    module, _, what = name.partition(":")
    found = getattr(importlib.import_module(module), what)
    return found() if isinstance(found, type) else found


def items_job(spark: SparkSession, items: str, graph_vectors: str, out: str, p: Params, run_id: str, encoder: str | None = None) -> None:
    """Cleaned texts, their vectors, and fused recommendations for every item that has both kinds of vectors.

    encoder: module:function that takes a list of texts and gives an array, a row a text, or module:Class of which a
    worker makes one and calls it so; hashed n-grams by default.
    graph_vectors: a table of vectors, or the folder of its runs, of which the newest counts.
    """
    d = readers.read_items(spark, items).withColumn("text_raw", text.build_text(F.col("title"), F.col("description")))
    d = d.withColumn("text_clean", text.clean_text(F.col("text_raw"), lower=True))
    d = text.min_word_filter(d.withColumn("wc", text.word_count(F.col("text_clean"))), p.min_words)
    writers.write_clean_text(d, f"{out}/texts/{run_id}")
    given = partial(_named_encoder, encoder) if encoder else partial(text.hashed_ngrams, p.dim)
    encoded = text.encode_text(text.encode_input(d, ["text_clean"]), given, batch=p.encode_batch, normalize=not p.raw_vectors)
    writers.write_embeddings(encoded.withColumn("item_id", F.col("item_id").cast("long")), f"{out}/text_vectors/{run_id}")
    t, g = spark.read.parquet(f"{out}/text_vectors/{run_id}"), _vectors(spark, graph_vectors)
    common = vectors.require_rows(vectors.id_intersection(t, g), "no item has both a text and a graph vector")
    writers.write_recs(vectors.fusion_recommend(t, g, common, p.k, p.alpha), f"{out}/fusion/{run_id}")
    writers.write_recs(vectors.two_stage_recommend(t, g, common, p.k, p.top_m, p.alpha), f"{out}/two_stage/{run_id}")


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, embedding) of a table or of the newest run in a folder; ids as numbers, what is none goes."""
    d = spark.read.parquet(readers.newest_run(spark, path))
    return d.select(F.expr("try_cast(item_id AS LONG)").alias("item_id"), "embedding").filter("item_id IS NOT NULL")


def collections_job(spark: SparkSession, text_vectors: str, graph_vectors: str, out: str, reset: bool = False, metric: str | None = None) -> None:
    """Puts the vectors of items that have both kinds into the stored collections `text` and `graph`, which keep the metric they are made with (cosine where none is given)."""
    t, g = _vectors(spark, text_vectors), _vectors(spark, graph_vectors)
    common = written(vectors.require_rows(vectors.id_intersection(t, g), "no item has both a text and a graph vector"), "common")
    for name, d in (("text", t), ("graph", g)):
        rows = d.join(common, "item_id", "left_semi").select(F.lit(name).alias("collection"), "item_id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(name).alias("source"), F.lit(0).alias("batch"))
        collections.upsert_collection(f"{out}/{name}", rows, reset=reset, metric=metric)


def recommend_job(spark: SparkSession, stored: str, item_id: int | None, p: Params, two_stage: bool = True) -> DataFrame:
    """The k items next to one item of the stored collections; without an item_id to the smallest that has both vectors."""
    t, g = (collections.read_collection(spark, f"{stored}/{name}") for name in ("text", "graph"))
    if t is None or g is None:
        raise ValueError(f"{stored} lacks the collections text and graph")
    common = vectors.require_rows(vectors.id_intersection(t, g), "no item has both a text and a graph vector")
    asked = common.agg(F.min("item_id").alias("item_id")) if item_id is None else spark.createDataFrame([(item_id,)], "item_id long")
    if item_id is not None and not vectors.unknown_queries(asked, t, g).isEmpty():
        raise ValueError(f"item {item_id} does not have both a text and a graph vector")
    if two_stage:
        metrics = tuple(collections.collection_metric(spark, f"{stored}/{name}") for name in ("text", "graph"))
        return vectors.two_stage_recommend(t, g, asked, p.k, p.top_m, p.alpha, metrics)
    return vectors.round_scores(vectors.fusion_recommend(t, g, asked, p.k, p.alpha), "score", "sim_text", "sim_graph")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=("graph", "train", "grid", "items", "collections", "recommend"))
    parser.add_argument("--events")
    parser.add_argument("--items")
    parser.add_argument("--text-vectors")
    parser.add_argument("--graph-vectors")
    parser.add_argument("--encoder", help="module:function from a list of texts to an array")
    parser.add_argument("--collections", help="folder of the stored collections to recommend from")
    parser.add_argument("--item-id", type=int)
    parser.add_argument("--fusion", action="store_true", help="exact late fusion instead of two stages")
    parser.add_argument("--metric", choices=collections.METRICS, help="of collections that are made or reset")
    parser.add_argument("--reset", action="store_true", help="empty the collections first")
    parser.add_argument("--train-on", choices=("all", "train"), default="all", help="train: without each client's last event")
    numbers = lambda s: tuple(map(int, s.split(",")))
    parser.add_argument("--grid-dims", type=numbers, default=(32, 64, 128))
    parser.add_argument("--grid-layers", type=numbers, default=(2, 3))
    parser.add_argument("--grid-negatives", type=numbers, default=(1, 2))
    parser.add_argument("--halving", type=numbers, default=(), help="epochs after which the better half goes on")
    parser.add_argument("--out", required=True)
    for name, value in vars(Params()).items():
        if isinstance(value, bool):
            parser.add_argument(f"--{name.replace('_', '-')}", action="store_true")
        else:
            parser.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    a = vars(parser.parse_args(argv))
    p = Params(**{k: a[k] for k in vars(Params())})
    spark = SparkSession.builder.appName(f"graphrec-{a['job']}").getOrCreate()
    run_id = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    if a["job"] == "graph":
        graph_job(spark, a["events"], a["items"], a["out"], p, run_id)
    elif a["job"] == "train":
        train_job(spark, a["events"], a["out"], p, run_id, a["train_on"])
    elif a["job"] == "grid":
        grid_job(spark, a["events"], a["out"], p, run_id, a["grid_dims"], a["grid_layers"], a["grid_negatives"], a["halving"])
    elif a["job"] == "items":
        items_job(spark, a["items"], a["graph_vectors"], a["out"], p, run_id, a["encoder"])
    elif a["job"] == "collections":
        collections_job(spark, a["text_vectors"], a["graph_vectors"], a["out"], a["reset"], a["metric"])
    else:
        writers.write_recs(recommend_job(spark, a["collections"], a["item_id"], p, not a["fusion"]), f"{a['out']}/recommend/{run_id}")


if __name__ == "__main__":
    main()
