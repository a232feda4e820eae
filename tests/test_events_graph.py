"""Weights, edges and figures on hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphrec.operators import components, events, graph, split
from graphrec.sources import readers

T0 = datetime(2024, 1, 31)
LOG = "event_id long, event_type string, client_id string, item_id string, ds_search_id string, timestamp timestamp"


def log(spark, rows):
    return events.clean_events(spark.createDataFrame(rows, LOG))


def values(d, *order):
    return [tuple(r) for r in (d.orderBy(*order) if order else d).collect()]


def test_session_boost_by_intent_and_as_observed(spark):
    d = log(spark, [(i, "click", "c", str(i), s, T0) for i, s in enumerate([None, "", "nan", "abc"])])
    assert [r["weight"] for r in events.event_weights(d).orderBy("event_id").collect()] == [1.0, 1.0, 1.0, pytest.approx(1.1)]
    assert {round(r["weight"], 9) for r in events.event_weights(d, boost_missing=True).collect()} == {1.1}
    without = events.clean_events(spark.createDataFrame([(1, "click", "c", "i", T0)], "event_id long, event_type string, client_id string, item_id string, timestamp timestamp"))
    assert events.event_weights(without).first()["weight"] == 1.0


def test_kinds_and_missing_kind(spark):
    d = log(spark, [(i, k, "c", "x", None, T0) for i, k in enumerate([" Purchase ", "click", "view", None])])
    assert [r["weight"] for r in events.event_weights(d).orderBy("event_id").collect()] == [3.0, 1.0, 1.0, 1.0]
    e = graph.build_edges(events.event_weights(d)).first()
    assert (e["count"], e["click_count"], e["purchase_count"], e["weight"]) == (4, 1, 1, 6.0)
    assert events.clean_events(spark.createDataFrame([("c", "i", T0)], "client_id string, item_id string, timestamp timestamp")).first()["event_type"] == "click"


def test_decay(spark):
    d = log(spark, [(0, "click", "c", "a", None, T0), (1, "click", "c", "b", None, T0 - timedelta(days=30)), (2, "click", "c", "d", None, T0 - timedelta(days=60)), (3, "click", "c", "e", None, None)])
    assert [r["weight"] for r in events.event_weights(d).orderBy("event_id").collect()] == pytest.approx([1.0, 0.5, 0.25, 1.0])
    assert {r["weight"] for r in events.event_weights(d, half_life_days=0).collect()} == {1.0}
    ref = spark.createDataFrame([(T0 - timedelta(days=90),)], "reference timestamp")
    assert {r["weight"] for r in events.event_weights(d, reference=ref).collect()} == {1.0}


def test_ids_stay_text_and_missing_ones_go(spark):
    d = log(spark, [(0, "click", "1453578787.1701330000", "i", None, T0), (1, "click", None, "i", None, T0), (2, "click", "", "i", None, T0), (3, "click", "c", None, None, T0)])
    assert [r["client_id"] for r in d.collect()] == ["1453578787.1701330000"]


def test_first_and_last_of_an_edge(spark):
    rows = [(0, "click", "c", "i", "b", T0 - timedelta(days=1)), (1, "click", "c", "i", None, T0), (2, "click", "c", "i", "a", T0 - timedelta(days=2))]
    e = graph.build_edges(events.event_weights(log(spark, rows))).first()
    assert (e["last_ds_search_id"], e["last_timestamp"], e["first_ds_search_id"], e["first_timestamp"]) == ("b", T0, "b", T0 - timedelta(days=1))


def test_equal_ids_are_two_nodes(spark):
    e = graph.build_edges(events.event_weights(log(spark, [(0, "click", "7", "7", None, T0)])))
    assert values(graph.distinct_nodes(e), "kind") == [("item", "7"), ("user", "7")]


@pytest.mark.parametrize(("degrees", "p50", "p90", "median"), [([1, 2, 3, 4, 5, 6], 3, 5, 3.5), ([1, 2, 3, 4], 3, 4, 2.5), ([1, 2], 1, 2, 1.5)])
def test_nearest_rank_is_half_even(spark, degrees, p50, p90, median):
    rows = [(f"u{n}", f"i{n}-{k}", 1.0) for n, d in enumerate(degrees) for k in range(d)]
    e = spark.createDataFrame(rows, "client_id string, item_id string, weight double")
    r = graph.degree_percentiles(e, (50, 90)).filter("kind = 'user'").first()
    assert (r["p50"], r["p90"], r["median"]) == (p50, p90, median)


def test_one_edge_and_no_edge(spark):
    e = spark.createDataFrame([("a", "b", 2.0)], "client_id string, item_id string, weight double")
    assert graph.weight_stats(e).first()["weight_std"] is None
    empty = e.filter("weight < 0")
    assert tuple(graph.graph_summary(empty).first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert graph.top_items(empty, None).count() == 0


def test_exact_quantiles_in_ever_finer_bins(spark, monkeypatch):
    import numpy as np

    from graphrec.functions import quantiles

    r = np.random.default_rng(4)
    for bins in (2, 5, 4096):
        monkeypatch.setattr(quantiles, "BINS", bins)
        for x in ([3.0], [1.0, 2.0], [5.0] * 50 + [7.0], list(r.lognormal(0, 3, 400)), [-1e308, 1e308, 0.0, 1e-300, -2.0]):
            d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "w double").repartition(3)
            assert quantiles.quantiles(d, "w", (0.0, 0.5, 0.9, 0.99, 1.0)) == pytest.approx(np.quantile(np.array(x) / 4, [0, 0.5, 0.9, 0.99, 1]) * 4)
    assert quantiles.quantiles(d.filter("w IS NULL"), "w", (0.5,)) == [None]


def test_first_rows_of_ids(spark):
    d = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("a", 1, "x"), (None, 3, None), ("b", None, "w"), ("b", 0, "v")], "item_id string, n int, t string")
    assert sorted(values(graph.item_dedupe_first(d, ["n", "t"])), key=repr) == sorted([("a", 1, "x"), (None, 3, None), ("b", None, "w")], key=repr)


def test_a_bot_in_the_split(spark):
    """A client with most rows, repeated rows and rows without a time, against sorting in memory."""
    rows = [(i % 300, "click", "bot" if i % 3 else f"c{i % 4}", f"k{i % 50}", "s", None if i % 17 == 0 else T0 + timedelta(hours=i % 200)) for i in range(900)]
    rows += rows[100:120]
    d = log(spark, rows).repartition(5)
    key = lambda x: (x["timestamp"] is not None, x["timestamp"] or T0, x["event_id"], x["item_id"])
    by, content = {}, {}
    for x in d.collect():
        by.setdefault(x["client_id"], []).append(x)
        c = tuple(v for k, v in x.asDict().items() if k != "event_id")
        content[c] = content.get(c, 0) + 1
    left = [x for some in by.values() for x in sorted(some, key=key)[:-1]]
    assert sorted(map(tuple, split.train_minus_last(d, drop_exact_duplicates="none").collect()), key=repr) == sorted(map(tuple, left), key=repr)
    once = [x for x in left if content[tuple(v for k, v in x.asDict().items() if k != "event_id")] == 1]
    assert sorted(map(tuple, split.train_minus_last(d).collect()), key=repr) == sorted(map(tuple, once), key=repr)
    assert split.train_minus_last(d).columns == d.columns


def test_split_quirks(spark):
    t1, t2 = T0, T0 + timedelta(days=1)
    rows = [(0, "click", "a", "1", None, t1), (1, "click", "a", "1", None, t1), (2, "click", "a", "2", None, t2), (3, "click", "b", "3", None, t1), (4, "click", "b", "3", None, t1)]
    d = log(spark, rows)
    assert values(split.leave_last_out(d), "client_id") == [("a", "2"), ("b", "3")]
    assert split.train_minus_last(d).count() == 0
    kept = split.train_minus_last(d, drop_exact_duplicates="none")
    assert sorted(r["client_id"] for r in kept.collect()) == ["a", "a", "b"]
    tie = log(spark, [(0, "click", "a", "x", None, t1), (1, "click", "a", "y", None, t1)])
    assert values(split.leave_last_out(tie), "client_id") == [("a", "y")]


def test_id_index_is_dense_in_order(spark):
    nodes = spark.createDataFrame([("user", f"u{i:03}") for i in range(57)] + [("item", f"i{i:03}") for i in range(11)], "kind string, id string").repartition(7)
    for kind, n in (("user", 57), ("item", 11)):
        rows = values(split.id_index(nodes).filter(F.col("kind") == kind), "idx")
        assert [r[2] for r in rows] == list(range(n)) and [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_components_of_chain_star_and_loop(spark):
    pairs = [(i, i + 1) for i in range(1, 20)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300)]
    got = dict(values(components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b"), "node"))
    assert {got[i] for i in range(1, 21)} == {1} and {got[i] for i in range(100, 160)} == {100} and got[200] == 200 and got[301] == got[300] == 300
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    got = dict(values(components.connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(5), "a", "b"), "node"))
    assert got == {x: find(x) for x in root}


def test_graph_sums(spark):
    rows = [(i, "click", f"c{i % 5}", f"i{i % 3}", None, T0) for i in range(30)]
    e = graph.build_edges(events.event_weights(log(spark, rows)))
    assert e.agg(F.sum("count")).first()[0] == 30
    sides = [graph.node_stats(e, c).agg(F.sum("degree")).first()[0] for c in ("client_id", "item_id")]
    assert sides == [e.count()] * 2
    a = graph.normalized_adjacency(graph.symmetric_adjacency(e))
    assert a.join(a.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v")), ["src", "dst"]).filter("abs(w - v) < 1e-12").count() == a.count()


def test_standard_columns(spark):
    d = spark.createDataFrame([("u", "i", "2024-01-01T00:00:00Z")], ["﻿User ID", "Ad-Id", "Event Time"])
    out = readers.standardize_event_columns(d)
    assert out.columns == ["client_id", "item_id", "timestamp"]
    with pytest.raises(ValueError, match="item_id"):
        readers.standardize_event_columns(d.select("`﻿User ID`", "`Event Time`"))


def test_bad_times_are_null(spark):
    d = events.clean_events(spark.createDataFrame([("click", "a", "b", "2024-01-01T00:00:00.5Z"), ("click", "a", "c", "soon")], "event_type string, client_id string, item_id string, timestamp string"))
    assert [r["timestamp"] is None for r in d.orderBy("item_id").collect()] == [False, True]
    assert events.drop_incomplete(d).count() == 1


def plain_components(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_contraction_keeps_components(spark, monkeypatch):
    import random

    r = random.Random(5)
    for kind, name in (("long", lambda i: i * 3), ("string", lambda i: f"n{i}é" if i % 3 else f"Z{i}")):
        pairs = [(name(r.randint(0, 400)), name(r.randint(0, 400))) for _ in range(260)] + [(name(900), name(900))]
        d = spark.createDataFrame(pairs, f"a {kind}, b {kind}").repartition(4)
        stars = [tuple(x) for x in components.contracted(d).collect()]
        nodes = {x for p in pairs for x in p}
        assert {a for a, _ in stars} == nodes and plain_components(stars) == plain_components(pairs) and len(stars) < 2 * len(pairs)
        one = dict(map(tuple, components.contracted(d.coalesce(1)).collect()))
        assert one == plain_components(pairs)


def test_stars_that_hang_together_are_not_finished(spark):
    """Stars whose center is another's leaf, or that share a leaf, are open; whole ones are not."""
    edges = [(11, 10), (12, 10), (10, 1), (2, 1), (30, 20), (30, 21), (41, 40), (42, 40), (52, 51)]
    assert {r["b"] for r in components._unfinished(spark.createDataFrame(edges, "a long, b long")).collect()} == {10, 1, 20, 21}


def test_components_of_long_paths_and_many_parts(spark):
    import random

    chain = list(range(300))
    random.Random(1).shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(1000 + 2 * i, 1001 + 2 * i) for i in range(200)] + [(2000, 2000 + i) for i in range(150)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(6), "a", "b").collect()))
    assert got == plain_components(pairs)


@pytest.mark.parametrize("together", (1 << 18, 600, 20))
def test_few_edges_in_many_parts_take_no_rounds(spark, monkeypatch, together):
    """Edges that a task may contract together are contracted by one, at once or as soon as rounds have left no more."""
    import random

    r = random.Random(8)
    chain = list(range(400))
    r.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(1000 + 2 * i, 1001 + 2 * i) for i in range(50)] + [(2000, 2000 + i) for i in range(60)]
    names, real = [], components.written
    monkeypatch.setattr(components, "TOGETHER", together)
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or real(df, name))
    settings = {"spark.sql.shuffle.partitions": "25", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = list(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(60), "a", "b").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert dict(got) == plain_components(pairs) and len(got) == len(dict(got))
    assert (names == ["cc-local", "cc-stars"]) == (together == 1 << 18) and ("cc-rest" in names) == (together < 1 << 18) and ("cc-round" in names) == (together == 20)


def test_edges_contracted_together_fit_a_worker(monkeypatch):
    """What a task contracts at once is bounded, and by little: a worker's memory is some 600 bytes an edge."""
    import pyarrow as pa

    class Frame:
        schema = {"a": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "long"})()})()}
        select = lambda self, *cols: self
        mapInArrow = lambda self, run, schema: run

    seen, real = [], components._stars
    monkeypatch.setattr(components, "_stars", lambda a, b: seen.append(len(a)) or real(a, b))
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(range(at, at + 10_000)), pa.array(range(at + 1, at + 10_001))], ["a", "b"])
    rows = sum(len(x) for x in components.contracted(Frame())(batch(at) for at in range(0, 600_000, 10_000)))
    assert sum(seen) == 600_000 and max(seen) <= (1 << 18) + 10_000 and rows == 600_000 + len(seen)
