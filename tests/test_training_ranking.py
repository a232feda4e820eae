"""Samplers, propagation, gradient and ranking."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphrec.operators import graph, grid, lightgcn, ranking, sampling, split, vectors

PAIRS = [("a", "x", 1.0), ("a", "y", 3.0), ("b", "y", 2.0), ("c", "x", 1.0), ("c", "z", 1.0)]


@pytest.fixture
def inter(spark):
    return spark.createDataFrame(PAIRS, "client_id string, item_id string, weight double")


def test_propagation_against_numpy(spark, inter):
    adj = graph.normalized_adjacency(graph.symmetric_adjacency(inter))
    nodes = sorted({r["src"] for r in adj.collect()})
    m = np.zeros((len(nodes),) * 2)
    for r in adj.collect():
        m[nodes.index(r["dst"]), nodes.index(r["src"])] = r["w"]
    x = sampling.init_embeddings(spark.createDataFrame([(n,) for n in nodes], "node string"), 4)
    x0 = np.array([r["x"] for r in x.orderBy("node").collect()])
    want = (x0 + m @ x0 + m @ m @ x0) / 3
    got = np.array([r["x"] for r in lightgcn.lightgcn_propagate(adj, x, 4, 2).orderBy("node").collect()])
    assert np.allclose(got, want)


def test_gradient_by_differences(spark):
    rng = np.random.default_rng(1)
    names, e0 = ["i:x", "i:y", "u:a", "u:b"], rng.normal(size=(4, 3))
    batch = spark.createDataFrame([("u:a", "i:x", "i:y"), ("u:b", "i:y", "i:x")], "u string, p string, n string")
    frame = lambda e: spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, e)], "node string, x array<double>")
    scored = lambda e: lightgcn.triples(batch, frame(e))
    loss = lambda e: lightgcn.bpr_loss(scored(e)).first()["loss"]
    got = {r["node"]: r["x"] for r in lightgcn.bpr_gradient(scored(e0), 3, 2).collect()}
    for i, k in ((0, 1), (2, 0), (3, 2)):
        up, down = e0.copy(), e0.copy()
        up[i, k] += 1e-5
        down[i, k] -= 1e-5
        assert got[names[i]][k] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-4)


def even(*key):
    return (int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def trained_in_memory(pairs, dim, layers, epochs, lr, seed=42):
    """(embeddings by node, losses): the training by dense matrices, whole batches, the same draws."""
    users, items = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    nodes = [f"i:{i}" for i in items] + [f"u:{u}" for u in users]
    m = np.zeros((len(nodes),) * 2)
    for u, i, w in pairs:
        a, b = nodes.index(f"u:{u}"), nodes.index(f"i:{i}")
        m[a, b] = m[b, a] = w
    d = m.sum(1)
    m = m / np.sqrt(d[:, None] * d[None, :])
    p = sum(np.linalg.matrix_power(m, k) for k in range(layers + 1)) / (layers + 1)
    x = np.array([[0.01 * math.sqrt(-2 * math.log(even(seed, n, k, "u"))) * math.cos(2 * math.pi * even(seed, n, k, "v")) for k in range(dim)] for n in nodes])
    first, second, losses = np.zeros_like(x), np.zeros_like(x), []
    for epoch in range(epochs):
        e, g, loss, batch = p @ x, np.zeros_like(x), [], []
        for u in users:
            met = {i: w for a, i, w in pairs if a == u}
            at, upto = even(seed, epoch, 0, u, "pos") * sum(met.values()), 0.0
            for pos in sorted(met):
                upto += met[pos]
                if upto > at:
                    break
            draws = (items[int(even(seed, epoch, 0, "neg", u, k) * len(items))] for k in range(512))
            batch.append([nodes.index(n) for n in (f"u:{u}", f"i:{pos}", f"i:{next(i for i in draws if i not in met)}")])
        for a, b, c in batch:
            s = 1 / (1 + math.exp(-(e[a] @ (e[b] - e[c]))))
            loss.append(-math.log(s + 1e-10))
            k = -s * (1 - s) / (s + 1e-10) / len(batch)
            g[a] += k * (e[b] - e[c])
            g[b] += k * e[a]
            g[c] -= k * e[a]
        losses.append(np.mean(loss))
        g = p @ g
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x - lr * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return dict(zip(nodes, p @ x)), losses


def test_training_against_matrices_and_its_loss_falls(spark):
    r = np.random.default_rng(3)
    pairs = [(f"c{u}", f"k{i}", float(r.integers(1, 4))) for u in range(6) for i in sorted(r.choice(9, 3, replace=False))]
    inter = spark.createDataFrame(pairs, "client_id string, item_id string, weight double")
    t = lightgcn.lightgcn_train(inter, dim=4, layers=2, epochs=4, lr=0.05)
    want, losses = trained_in_memory(pairs, 4, 2, 4, 0.05)
    got = {f"u:{x['client_id']}": x["embedding"] for x in t.users.collect()} | {f"i:{x['item_id']}": x["embedding"] for x in t.items.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[n], want[n], atol=1e-6) for n in want)
    seen = t.losses.orderBy("step").collect()
    assert [x["epoch"] for x in seen] == [0, 1, 2, 3] and np.allclose([x["loss"] for x in seen], losses, atol=1e-9)
    assert seen[0]["loss"] > seen[-1]["loss"] + 0.01


def test_configurations_together_are_those_alone(spark, monkeypatch):
    monkeypatch.setattr(lightgcn, "PART", 3)
    r = np.random.default_rng(3)
    pairs = [(f"c{u}", f"k{i}", float(r.integers(1, 4))) for u in range(7) for i in sorted(r.choice(9, 3, replace=False))]
    inter = spark.createDataFrame(pairs, "client_id string, item_id string, weight double")
    configs = [lightgcn.Config(2, 1, 1), lightgcn.Config(4, 2, 2), lightgcn.Config(4, 1, 1)]
    many = lightgcn.lightgcn_train_many(inter, configs, epochs=2, lr=0.05)
    for i, c in enumerate(configs):
        one = lightgcn.lightgcn_train(inter, dim=c.dim, layers=c.layers, neg_per_pos=c.neg, epochs=2, lr=0.05)
        for a, b, name in ((many[i].users, one.users, "client_id"), (many[i].items, one.items, "item_id")):
            x, y = ({r[name]: r["embedding"] for r in d.collect()} for d in (a, b))
            assert x.keys() == y.keys() and all(len(v) == c.dim and np.allclose(v, y[k], atol=1e-6) for k, v in x.items())
        assert [tuple(r) for r in many[i].losses.orderBy("step").collect()] == [pytest.approx(tuple(r)) for r in one.losses.orderBy("step").collect()]
    asked = []
    half = lightgcn.lightgcn_train_many(inter, configs, epochs=3, lr=0.05, survivors=lambda epoch, found: asked.append((epoch, sorted(found))) or {0: {0, 2}, 1: {2}}[epoch])
    assert asked == [(0, [0, 1, 2]), (1, [0, 2])] and {i: t.losses.count() for i, t in half.items()} == {0: 2, 1: 1, 2: 3}


def test_hubs_are_kept_apart(spark, inter):
    adj = graph.normalized_adjacency(graph.symmetric_adjacency(inter))
    x = sampling.init_embeddings(adj.select(F.col("src").alias("node")).distinct(), 3)
    want = {r["node"]: r["x"] for r in lightgcn.lightgcn_propagate(adj, x, 3, 2).collect()}
    for most in (1, 100):
        stored = lightgcn.stored_adjacency(adj, hub_edges=most)
        assert (stored.hubs is None) == (most == 100)
        got = {r["node"]: r["x"] for r in lightgcn.lightgcn_propagate(stored, x, 3, 2).collect()}
        assert got.keys() == want.keys() and all(np.allclose(v, want[k]) for k, v in got.items())
        stored.drop()


def test_a_layer_moves_vectors_only(spark, inter):
    """Edges are joined where they lie: no exchange stands above the bucketed scan."""
    adj = graph.normalized_adjacency(graph.symmetric_adjacency(inter))
    stored = lightgcn.stored_adjacency(adj)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = sampling.init_embeddings(adj.select(F.col("src").alias("node")).distinct(), 2)
        plan = lightgcn.propagate_once(stored, x, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "adjacency_buckets" in line and "Scan" in line)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:scan]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            above.append(line)
            depth = d
    joined = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in above[:joined])
    stored.drop()


def test_drawn_positives_follow_weights(spark):
    inter = spark.createDataFrame([(f"c{i}", item, w) for i in range(1500) for item, w in (("w", 0.0), ("x", 1.0), ("y", 3.0))], "client_id string, item_id string, weight double")
    users = inter.select("client_id").distinct()
    for per_bucket in (4096, 1):
        table = sampling.positive_table(inter, per_bucket)
        one = Counter(r["pos"] for r in sampling.draw_positive(users, table, 42, 0, 0).collect())
        assert sum(one.values()) == 1500 and set(one) == {"x", "y"} and 0.70 < one["y"] / 1500 < 0.80
    many = users.crossJoin(spark.createDataFrame([(0, 0), (3, 1)], "epoch int, step int"))
    got = sorted(tuple(r) for r in sampling.draw_positive(many, table, 42).select("epoch", "step", "client_id", "pos").collect())
    assert got == sorted((*m, r["client_id"], r["pos"]) for m in ((0, 0), (3, 1)) for r in sampling.draw_positive(users, table, 42, *m).collect())


def test_training_in_batches_and_on_nothing(spark, inter):
    t = lightgcn.lightgcn_train(inter, dim=2, layers=1, epochs=1, batch_users=1)
    assert t.losses.count() == 3 and t.users.count() == 3 and t.items.count() == 3
    t = lightgcn.lightgcn_train(inter.limit(0), dim=2, layers=1, epochs=1)
    assert (t.users.count(), t.items.count(), t.losses.count()) == (0, 0, 0)


def test_a_grid_trains_without_the_last_events(spark, monkeypatch):
    from datetime import datetime, timedelta

    from graphrec.jobs import run
    from graphrec.jobs.params import Params

    rows = [(i, "click", f"c{i % 5}", f"k{i * 7 % 11}", "s", datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(60)]
    log = spark.createDataFrame(rows, "event_id long, event_type string, client_id string, item_id string, ds_search_id string, timestamp timestamp")
    given, real = [], lightgcn.lightgcn_train_many
    monkeypatch.setattr(run.lightgcn, "lightgcn_train_many", lambda edges, configs, **o: given.append((edges.count(), *configs)) or real(edges, configs, **o))
    got = run.trained_grid(log, Params(epochs=1), (2, 4), (1,), (1,), 3).orderBy("grid_order").collect()
    n = split.seen_items(split.train_minus_last(log)).count()
    assert given == [(n, (2, 1, 1), (4, 1, 1))] and [(r["dim"], r["layers"], r["neg"]) for r in got] == [(2, 1, 1), (4, 1, 1)] and all(0 <= r["recall"] <= 1 for r in got)
    users, items, _ = lightgcn.lightgcn_train(run.graph.interactions(run.events.event_weights(split.train_minus_last(log))), dim=4, layers=1, epochs=1)
    m = ranking.evaluate(users, items, log, (3,)).first()
    assert (got[1]["recall"], got[1]["ndcg"], got[1]["mrr"]) == pytest.approx((m["recall"], m["ndcg"], m["mrr"]))
    assert run.trained_grid(log, Params(epochs=2), (2, 4), (1,), (1,), 3, halving=(1,)).count() == 2


def scored_rows(r, n, m, dim=5):
    """Vectors of very different norms, some equal, some none, and pairs that take no part."""
    q, v = r.normal(size=(n, dim)) * r.lognormal(0, 2, size=(n, 1)), r.normal(size=(m, dim)) * r.lognormal(0, 2, size=(m, 1))
    v[m // 2], v[m // 3], q[1] = v[0], 0.0, 0.0
    return q, v, {(int(a), int(b)) for a, b in zip(r.integers(0, n, 400), r.integers(0, m, 400))} | {(2, b) for b in range(m)}


def grid_frames(spark, q, v, masks):
    rows = lambda x: [(i, [row.tolist()]) for i, row in enumerate(x)]
    extra = [(None, [[1.0] * q.shape[1]]), (9000, None), (9001, [None]), (9002, [[float("nan")] * q.shape[1]])]
    a = spark.createDataFrame(rows(q) + extra, "query_id long, vecs array<array<double>>")
    b = spark.createDataFrame(rows(v) + extra, "item_id long, vecs array<array<double>>").repartition(3)
    return a, b, spark.createDataFrame(sorted(masks) + [(None, 1), (77_777, 1), (1, 77_777)], "query_id long, item_id long")


@pytest.mark.parametrize(("query_block", "item_block"), [(10_000, 10_000), (7, 16), (50, 40)])
def test_grid_finds_what_a_loop_finds(spark, monkeypatch, query_block, item_block):
    q, v, masks = scored_rows(np.random.default_rng(4), 60, 130)
    a, b, hidden = grid_frames(spark, q, v, masks)
    got = grid.block_topk(a, b, 7, masked=hidden, query_block=query_block, item_block=item_block).collect()
    score = np.round(q @ v.T, 9)
    for i, j in masks:
        score[i, j] = -np.inf
    want = {(i, r + 1, int(j)) for i in range(60) for r, j in enumerate([j for j in np.lexsort((np.arange(130), -score[i])) if score[i, j] > -np.inf][:7])}
    assert {(x["query_id"], x["rank"], x["item_id"]) for x in got} == want and len(got) == len(want) == 59 * 7
    assert all(x["score"] == pytest.approx(q[x["query_id"]] @ v[x["item_id"]]) == pytest.approx(x["part_0"]) for x in got)
    own = grid.block_topk(a, b, 3, exclude_same_id=True, query_block=query_block, item_block=item_block).collect()
    assert len(own) == 180 and all(x["query_id"] != x["item_id"] for x in own)
    target = np.random.default_rng(1).integers(0, 130, 60)
    asked = spark.createDataFrame([(i, [q[i].tolist()], int(t), float(q[i] @ v[t])) for i, t in enumerate(target)], "query_id long, vecs array<array<double>>, target long, goal double")
    ranks = {x["query_id"]: x["rank"] for x in grid.ranks_by_counting(asked, b, masked=hidden, query_block=query_block, item_block=item_block).collect()}
    goal = np.round((q * v[target]).sum(1), 9)
    assert ranks == {i: 1 + int(((score[i] > goal[i]) | ((score[i] == goal[i]) & (np.arange(130) < target[i]))).sum()) - int(score[i, target[i]] > goal[i]) for i in range(60)}


def test_a_query_meets_only_blocks_that_matter(spark):
    """Items of one block of large norms and many of small ones: after the first block no cell is left."""
    v = [(i, [[100.0 - i, 1.0]]) for i in range(20)] + [(i, [[0.001, 0.0]]) for i in range(20, 400)]
    b = spark.createDataFrame(v, "item_id long, vecs array<array<double>>")
    a = spark.createDataFrame([(i, [[1.0, float(i)]]) for i in range(5)], "query_id long, vecs array<array<double>>")
    sides = grid.laid_out(a.withColumn("least", F.lit(50.0)), b, (1.0,), item_block=20)
    assert len(sides.norms) == 20 and sides.norms == sorted(sides.norms, reverse=True)
    reach = {r["reach"] for r in sides.queries.select(grid._blocks_to("least", sides.norms)(F.col("norm")).alias("reach")).collect()}
    assert max(reach) < 4
    assert {(r["query_id"], r["item_id"]) for r in grid.block_topk(a, b, 2, item_block=20).collect()} == {(i, j) for i in range(5) for j in (0, 1)}


def test_searches_without_rows(spark):
    a = spark.createDataFrame([("a", [[1.0]])], "query_id string, vecs array<array<double>>")
    b = spark.createDataFrame([(1, [[1.0]])], "item_id long, vecs array<array<double>>")
    assert [tuple(r)[:3] for r in grid.block_topk(a, b, 2).select("query_id", "rank", "item_id").collect()] == [("a", 1, 1)]
    assert grid.block_topk(a.limit(0), b, 2).count() == 0 and grid.block_topk(a, b.limit(0), 2).count() == 0
    q = a.withColumns({"target": F.lit(1).cast("long"), "goal": F.lit(1.0)})
    assert grid.ranks_by_counting(q, b).first()["rank"] == 1 and grid.ranks_by_counting(q, b.limit(0)).first()["rank"] == 1 and grid.ranks_by_counting(q.limit(0), b).count() == 0
    with pytest.raises(Exception, match="entries meet"):
        grid.block_topk(a, spark.createDataFrame([(1, [[1.0, 2.0]])], b.schema), 2).count()


def test_positive_samples_follow_weights(spark):
    inter = spark.createDataFrame([(f"c{i}", item, w) for i in range(1500) for item, w in (("x", 1.0), ("y", 3.0))], "client_id string, item_id string, weight double")
    users = inter.select("client_id").distinct()
    one = Counter(r["pos"] for r in sampling.sample_positive(users, inter, 42, 0, 0).collect())
    assert sum(one.values()) == 1500 and 0.70 < one["y"] / 1500 < 0.80
    same = lambda n: sorted(map(tuple, sampling.sample_positive(users.repartition(n), inter.repartition(n), 42, 0, 0).collect()))
    assert same(1) == same(5)


def test_negatives(spark, inter):
    items = split.id_index(graph.distinct_nodes(inter)).filter("kind = 'item'").select(F.col("id").alias("item_id"), "idx")
    everything = inter.unionByName(spark.createDataFrame([("a", "z", 1.0)], inter.schema))
    got = sampling.sample_negatives(everything.select("client_id").distinct(), items, everything, 1, 42, 0, 0)
    rows = [tuple(r) for r in got.collect()]
    assert {r[0] for r in rows} == {"b", "c"} and not {(r[0], r[2]) for r in rows} & {(a, b) for a, b, _ in PAIRS}


def test_every_user_with_an_unmet_item_gets_a_negative(spark):
    items = spark.range(5000).select(F.format_string("i%04d", "id").alias("item_id"), F.col("id").alias("idx"))
    met = spark.range(5000).filter("id <> 4321").selectExpr("'hot' AS client_id", "format_string('i%04d', id) AS item_id", "1D AS weight")
    met = met.unionByName(spark.createDataFrame([("cold", "i0000", 1.0)], met.schema)).unionByName(items.selectExpr("'all' AS client_id", "item_id", "1D AS weight"))
    users = met.select("client_id").distinct()
    for per_user in (1, 2):
        rows = [tuple(r) for r in sampling.sample_negatives(users, items, met, per_user, 42, 0, 0).collect()]
        assert [r for r in rows if r[0] == "hot"] == [("hot", 1, "i4321")]
        assert sorted(r[:2] for r in rows if r[0] != "hot") == [("cold", k + 1) for k in range(per_user)] and ("cold", "i0000") not in {(r[0], r[2]) for r in rows}


def test_draws_of_many_steps_at_once_are_those_of_each(spark):
    items = spark.range(30).select(F.format_string("i%02d", "id").alias("item_id"), F.col("id").alias("idx"))
    met = spark.createDataFrame([(f"c{u}", f"i{i:02d}", 1.0 + i % 3) for u in range(6) for i in range(30) if (u * i) % 5 < 2 or u == 3 and i], "client_id string, item_id string, weight double")
    users = met.select("client_id").distinct()
    moments = [(0, 0), (0, 1), (3, 0)]
    many = users.crossJoin(spark.createDataFrame(moments, "epoch int, step int")).select("epoch", "step", "client_id")
    for one in (lambda u, *m: sampling.sample_positive(u, met, 42, *m), lambda u, *m: sampling.sample_negatives(u, items, met, 2, 42, *m, draws=1, tries=1)):
        got = sorted(tuple(r) for r in one(many).collect())
        assert got == sorted((*m, *r) for m in moments for r in one(users, *m).collect()) and len({r[3:] for r in got}) > 3


def test_loss_of_every_user_with_an_unmet_item(spark, tmp_path, monkeypatch):
    from graphrec.jobs import queries

    met = [(u, k) for u in range(6) for k in range(39)] + [(6, 39), (7, 0)] + [(8, k) for k in range(40)]
    rows = [(i, u, "purchase", f'{{"k": {k}}}') for i, (u, k) in enumerate(met)]
    d = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    d.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries.lightgcn, "bpr_loss", lambda scored: scored.agg(F.countDistinct("u").cast("double").alias("loss")))
    assert queries.QUERIES["bpr_loss"](spark, str(tmp_path)).first()["loss"] == 8.0


def test_draws_by_rank_are_even_and_unmet(spark):
    left = {2, 3, 11, 19}
    items = spark.range(20).select(F.concat(F.lit("i"), "id").alias("item_id"), F.col("id").alias("idx"))
    short = spark.range(800).select(F.col("id").cast("string").alias("client_id"), F.lit(1).alias("have"), F.lit(2).alias("need"))
    taken = short.select("client_id").crossJoin(items.select("idx").filter(~F.col("idx").isin(*left)))
    for width in (4, 7, 4096):
        rows = sampling.unmet_negatives(short, items, taken, 42, 0, 0, 20, width).collect()
        assert len({(r["client_id"], r["neg"]) for r in rows}) == len({(r["client_id"], r["n"]) for r in rows}) == len(rows) == 1600
        assert {r["n"] for r in rows} == {2, 3}
        share = Counter(r["neg"] for r in rows)
        assert set(share) == {f"i{k}" for k in left} and all(330 < v < 470 for v in share.values())


def test_sample_users(spark):
    users = spark.createDataFrame([(str(i),) for i in range(40)], "client_id string")
    a, b = (sorted(r[0] for r in sampling.sample_users(users.repartition(n), 10, 1, 0, 0).collect()) for n in (1, 7))
    assert a == b and len(set(a)) == 10
    assert sampling.sample_users(users, None, 1, 0, 0).count() == 40
    assert sampling.steps_per_epoch(42085, 1024) == 41 and sampling.steps_per_epoch(5, 1024) == 1


def test_metrics(spark):
    d = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "client_id string, rank int")
    r = ranking.ranking_metrics(d, (10,)).first()
    assert (r["recall"], r["ndcg"], r["mrr"], r["targets"]) == (pytest.approx(2 / 3), pytest.approx((1 + 1 / math.log2(4)) / 3), pytest.approx((1 + 1 / 3) / 3), 3)


def test_a_seen_target_is_a_miss(spark):
    u = spark.createDataFrame([("a", [1.0])], "client_id string, embedding array<float>")
    i = spark.createDataFrame([("x", [3.0]), ("y", [2.0]), ("z", [1.0])], "item_id string, embedding array<float>")
    pair = "client_id string, item_id string"
    seen, test = spark.createDataFrame([("a", "x")], pair), spark.createDataFrame([("a", "x")], pair)
    top = ranking.topk_items_per_user(u, i, seen, 2)
    assert [r["item_id"] for r in top.orderBy("rank").collect()] == ["y", "z"]
    m = ranking.ranking_metrics(ranking.target_rank(top, test), (10,)).first()
    assert (m["recall"], m["targets"]) == (0.0, 1)


def test_best_of_a_stored_grid(spark):
    # Recall, NDCG and MRR at 10 of a published run, by dimension, layers, negatives.
    rows = [
        (32, 2, 1, 0.6691, 0.4665, 0.4027), (32, 2, 2, 0.6955, 0.4867, 0.4209), (32, 3, 1, 0.5776, 0.3766, 0.3140), (32, 3, 2, 0.5917, 0.3870, 0.3234), (64, 2, 1, 0.7948, 0.6126, 0.5541), (64, 2, 2, 0.8034, 0.6244, 0.5669),
        (64, 3, 1, 0.7098, 0.4908, 0.4217), (64, 3, 2, 0.7228, 0.5134, 0.4472), (128, 2, 1, 0.8402, 0.6778, 0.6251), (128, 2, 2, 0.8514, 0.7067, 0.6597), (128, 3, 1, 0.7749, 0.5691, 0.5034), (128, 3, 2, 0.7911, 0.5916, 0.5278),
    ]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_order int, dim int, layers int, neg int, recall double, ndcg double, mrr double")
    assert tuple(ranking.grid_best(d).first())[1:4] == (128, 2, 2)


def test_start_vectors_are_made_once_a_node_in_all_tasks(spark):
    from graphrec.jobs import queries

    d = queries.QUERIES["init_embeddings"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and not any("md5" in line for line in plan.split("\n") if "Filter" in line)
    few = spark.range(40).select(F.col("id").cast("string").alias("node")).coalesce(1)
    made = sampling.init_embeddings(few, 2)
    assert made.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == 4


@pytest.mark.parametrize("size", [1.0, 1e-20, 1e20])
def test_single_precision_loses_no_item(size):
    """Scores closer than single precision tells, ties, and sizes that it does not hold; rows that a cell scores exactly are few."""
    import pyarrow as pa

    r = np.random.default_rng(7)
    v = np.repeat(r.normal(size=(600, 5)), 10, axis=0) * (1 + r.integers(-3, 4, size=(6000, 1)) * 1e-8)
    q = r.normal(size=(300, 5))
    q, v = q / np.linalg.norm(q, axis=1)[:, None], v / np.linalg.norm(v, axis=1).max()
    q[0], v[17] = 0.0, v[4]
    q, v = q * size, v / (size if size < 1 else 1.0)
    vecs = lambda x: pa.array([[row.tolist()] for row in x])
    norm = lambda x: np.sqrt((x * x).sum(1))
    left, right = pa.table({"query_id": list(range(300)), "vecs": vecs(q), "norm": norm(q)}), pa.table({"item_id": list(range(6000)), "vecs": vecs(v), "norm": norm(v), "query_id": pa.nulls(6000, pa.int64())})
    cell = grid.Cell(left, right, (1.0,), True)
    ids = np.array(cell.ids)
    for t in (0, 256):
        tile = np.arange(t, min(t + 256, 300))
        i, j, score = cell.best_of_tile(tile, np.full(len(tile), -np.inf), 7)
        for n, x in enumerate(tile):
            want = np.round(cell.items @ cell.q[x], grid.DECIMALS)
            want[ids == x] = -np.inf
            order = np.lexsort((ids, -want))[:7]
            assert ids[j[i == n]].tolist() == ids[order].tolist() or np.allclose(score[i == n], want[order], rtol=1e-12, atol=2e-9)


def test_a_vector_is_sent_with_its_edges_in_a_row(spark, inter):
    adj = graph.normalized_adjacency(graph.symmetric_adjacency(inter))
    nodes = adj.select(F.col("src").alias("node")).distinct()
    stored = lightgcn.stored_adjacency(adj)
    assert stored.edges.count() == nodes.count() < adj.count()
    stored.drop()


def test_an_evaluation_makes_its_vectors_once(spark, monkeypatch):
    made, real = [], ranking.written
    monkeypatch.setattr(ranking, "written", lambda d, name: made.append((name, tuple(d.columns))) or real(d, name))
    e = spark.createDataFrame([(0, "c", "i", "2024-01-01"), (1, "c", "j", "2024-01-02")], "event_id long, client_id string, item_id string, timestamp string")
    users, items = spark.createDataFrame([("c", [1.0])], "client_id string, embedding array<double>"), spark.createDataFrame([("i", [1.0]), ("j", [2.0])], "item_id string, embedding array<double>")
    assert ranking.evaluate(users, items, e, (1,)).first()["recall"] == 1.0
    assert made[:2] == [("evaluate-user-vectors", ("client_id", "embedding")), ("evaluate-item-vectors", ("item_id", "embedding"))]


def test_lists_pass_on_what_reaches_the_score_to_beat(spark, monkeypatch):
    from graphrec.operators import inverted, vectors

    r = np.random.default_rng(5)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(800, 3)))], "item_id long, embedding array<double>")
    made, real = [], inverted.written

    def noted(d, name):
        out = real(d, name)
        made.append((name, out.count()))
        return out

    index = inverted.build_index(d, lists=20)
    monkeypatch.setattr(inverted, "written", noted)
    found = inverted.search(index, d, 10, 20).select("query_item_id", "rank", "item_id").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, vectors.topm_candidates(d, d, 10).select("query_item_id", "rank", "item_id").collect()))
    passed = dict(made)
    assert passed["index-best"] == 8000 and passed["index-rest"] < 8000  # 16 lists of 10 rows for each of 800 queries before
    index.drop()


def test_parts_train_as_joins_do(spark, monkeypatch):
    """A graph that a task can hold is trained without a join of edges, to the same embeddings and losses; others by joins."""
    r = np.random.default_rng(4)
    pairs = [(f"c{u}", f"k{i}", float(r.integers(1, 4))) for u in range(12) for i in sorted(r.choice(9, 3, replace=False))]
    inter = spark.createDataFrame(pairs, "client_id string, item_id string, weight double")
    configs, got = [lightgcn.Config(3, 1, 1), lightgcn.Config(5, 2, 2)], []
    monkeypatch.setattr(lightgcn.parts, "NARROW", 2)
    for most in (lightgcn.parts.PAIRS, 0):
        monkeypatch.setattr(lightgcn.parts, "PAIRS", most)
        joins, real = [], lightgcn.stored_adjacency
        with monkeypatch.context() as m:
            m.setattr(lightgcn, "stored_adjacency", lambda d: joins.append(d) or real(d))
            many = lightgcn.lightgcn_train_many(inter, configs, epochs=2, batch_users=5, lr=0.05, sampled_rows=20, survivors=lambda epoch, found: {1})
        assert len(joins) == (most == 0)
        got.append([({x[0]: x[1] for x in (*t.users.collect(), *t.items.collect())}, [tuple(x) for x in t.losses.orderBy("step").collect()]) for t in (many[0], many[1])])
    for (x, a), (y, b) in zip(*got):
        assert x.keys() == y.keys() and all(np.allclose(v, y[k], atol=1e-6) for k, v in x.items())
        assert a == [pytest.approx(t) for t in b]
    assert [len(losses) for _, losses in got[0]] == [2, 4]


def test_a_graph_by_matrix_and_lists():
    r = np.random.default_rng(6)
    n = 40
    u, v = np.nonzero(np.triu(r.random((n, n)) < 0.08, 1))
    u, v = np.concatenate([u, np.zeros(20, dtype=int)]), np.concatenate([v, np.arange(20, 40)])
    w = r.random(len(u))
    dense = np.zeros((n, n))
    np.add.at(dense, (u, v), w)
    g, x = lightgcn.parts.Graph(n, u, v, w), r.normal(size=(3, n))
    assert 0 < len(g.hubs) < n and len(g.w) and np.allclose(g.once(x), x @ (dense + dense.T))
    assert np.allclose(g.mean(x, 2), (x + g.once(x) + g.once(g.once(x))) / 3)


def test_a_search_passes_on_k_rows_a_query(spark, monkeypatch):
    """Whatever the blocks of items: a task reads them one after the other, and none is sent to it."""
    r = np.random.default_rng(8)
    v = r.normal(size=(600, 3))
    d = spark.createDataFrame([(i, [x.tolist()]) for i, x in enumerate(v)], "query_id long, vecs array<array<double>>")
    made, real = {}, grid.written

    def noted(d, name):
        made[name] = d._jdf.queryExecution().executedPlan().toString()
        out = real(d, name)
        made[name] = (out.count(), made[name])
        return out

    monkeypatch.setattr(grid, "written", noted)
    got = grid.block_topk(d, d.withColumnRenamed("query_id", "item_id"), 5, query_block=150, item_block=100)
    order = np.lexsort((np.broadcast_to(np.arange(600), (600, 600)), -np.round(v @ v.T, 9)), axis=1)[:, :5]
    assert {(x["query_id"], x["rank"], x["item_id"]) for x in got.collect()} == {(i, n + 1, int(j)) for i in range(600) for n, j in enumerate(order[i])}
    rows, plan = made["grid-found"]
    assert rows == 3000 and "CoGroup" not in plan and plan.count("Exchange") == 1
