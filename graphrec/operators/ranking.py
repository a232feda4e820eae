"""Ranking items for users, metrics, grid search."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import dropped, written
from .split import leave_last_out, restrict_to_embedded, seen_items, train_minus_last
from .grid import block_topk, ranks_by_counting
from .vectors import dot


def topk_items_per_user(users: DataFrame, items: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(client_id, rank, item_id, score): the k unseen items of highest dot product; seen ones are masked where they are scored."""
    double = lambda: F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("vecs")
    masked = seen_items(seen).withColumnRenamed("client_id", "query_id")
    top = block_topk(users.select(F.col("client_id").alias("query_id"), double()), items.select("item_id", double()), k, masked=masked)
    return top.select(F.col("query_id").alias("client_id"), "rank", "item_id", "score")


def score_user_item(users: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(client_id, item_id, score): dot products of stated pairs that have vectors on both sides; all pairs are never listed.

    Both vector tables are plain sides of joins, so a client or an item of very many pairs is split by adaptive execution.
    """
    u, i = users.select("client_id", F.col("embedding").alias("_u")), items.select("item_id", F.col("embedding").alias("_i"))
    return pairs.select("client_id", "item_id").join(u, "client_id").join(i, "item_id").select("client_id", "item_id", dot(F.col("_u"), F.col("_i")).alias("score"))


def target_rank(ranked: DataFrame, test: DataFrame) -> DataFrame:
    """(client_id, item_id, rank): the test item's place, null where it isn't in the list."""
    return test.join(ranked.select("client_id", "item_id", "rank"), ["client_id", "item_id"], "left")


def target_ranks(users: DataFrame, items: DataFrame, test: DataFrame, seen: DataFrame) -> DataFrame:
    """(client_id, item_id, rank): each test item's exact place among the items that the client has not seen, by counting those before it.

    test: one row a client. Null where the client or the item has no vector, and for a test item that the client has seen.
    """
    met = written(seen_items(seen), "seen-items")
    goals = score_user_item(users, items, test.join(met, ["client_id", "item_id"], "left_anti"))
    double = lambda c: F.array(F.transform(c, lambda x: x.cast("double"))).alias("vecs")
    q = users.join(goals, "client_id").select(F.col("client_id").alias("query_id"), double("embedding"), F.col("item_id").alias("target"), F.col("score").alias("goal"))
    ranks = ranks_by_counting(q, items.select("item_id", double("embedding")), masked=met.withColumnRenamed("client_id", "query_id"))
    dropped(met)
    return test.join(ranks.withColumnRenamed("query_id", "client_id"), "client_id", "left").select("client_id", "item_id", "rank")


def ranking_metrics(ranks: DataFrame, ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(k, recall, ndcg, mrr, targets): means over targets; a missing rank is a miss that counts."""
    r, k = F.col("rank"), F.col("k")
    hit = r.isNotNull() & (r <= k)
    d = ranks.select("rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    mean = lambda c: F.coalesce(F.avg(F.when(hit, c).otherwise(0.0)), F.lit(0.0))
    return d.groupBy("k").agg(mean(F.lit(1.0)).alias("recall"), mean(1.0 / F.log2(r + 1.0)).alias("ndcg"), mean(1.0 / r).alias("mrr"), F.count(F.lit(1)).alias("targets"))


def evaluate(users: DataFrame, items: DataFrame, events: DataFrame, ks: tuple[int, ...] = (10, 20, 50), order: tuple[str, ...] = ("event_id",), rows: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Metrics of embeddings on each client's last event, items of the others masked: exact ranks by counting, no lists.

    rows: the test rows and the other rows of events, where these are at hand already. Vectors, ids and test rows are read often, so they are tables, made once.
    """
    users, items = written(users.select("client_id", "embedding"), "evaluate-user-vectors"), written(items.select("item_id", "embedding"), "evaluate-item-vectors")
    known, shown = written(users.select("client_id"), "evaluate-users"), written(items.select("item_id"), "evaluate-items")
    last, others = rows or (leave_last_out(events, order), train_minus_last(events, order))
    test = written(restrict_to_embedded(last, known, shown), "evaluate-test")
    train = restrict_to_embedded(others, known, shown).join(test.select("client_id"), "client_id", "left_semi")
    ranks = written(target_ranks(users, items, test, train), "evaluate-ranks")
    dropped(users, items, known, shown, test)
    return ranking_metrics(ranks, ks)


def grid_best(results: DataFrame) -> DataFrame:
    """The configuration with the largest recall + ndcg, the first on ties."""
    return results.orderBy(F.desc(F.col("recall") + F.col("ndcg")), "grid_order").limit(1)


def grid_search(train: Callable[[int, int, int], tuple[DataFrame, DataFrame]], events: DataFrame, dims: tuple[int, ...] = (32, 64, 128), layers: tuple[int, ...] = (2, 3), negatives: tuple[int, ...] = (1, 2), k: int = 10) -> DataFrame:
    """(grid_order, dim, layers, neg, recall, ndcg, mrr): each configuration evaluated; the log is split once for all.

    train(dim, layers, neg) returns user and item embeddings, of events without the rows that evaluate() asks for.
    """
    rows = written(leave_last_out(events), "grid-test"), written(seen_items(train_minus_last(events)), "grid-train")

    def one(at: int, d: int, n_layers: int, neg: int) -> DataFrame:
        m = evaluate(*train(d, n_layers, neg), events, (k,), rows=rows).select(F.lit(at).alias("grid_order"), F.lit(d).alias("dim"), F.lit(n_layers).alias("layers"), F.lit(neg).alias("neg"), "recall", "ndcg", "mrr")
        return written(m, "grid-row")

    # An evaluation is a row of short jobs, so some go on at a time.
    with ThreadPoolExecutor(4) as some:
        found = list(some.map(lambda c: one(c[0], *c[1]), enumerate(product(dims, layers, negatives))))
    dropped(*rows)
    return reduce(DataFrame.unionByName, found)
