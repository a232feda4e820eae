"""One query for each operator over the driver's tables, most with the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import work_dir, written
from ..operators import components, events, graph, lightgcn, ranking, sampling, split, text, vectors
from ..sources import collections, readers, writers
from . import adapters as a
from .params import Params
from .run import trained_grid

RUN = "20240101T000000Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LATER: dict[str, Callable[[], str]] = {}

# Pieces of SQL that many oracles share.
EV = """ev AS (SELECT event_id, lower(trim(event_type)) AS event_type, CAST(user_id AS VARCHAR) AS client_id, json_extract_string(props, '$.k') AS item_id,
    CASE WHEN event_id % 3 <> 0 THEN 's' || CAST(event_id // 10 AS VARCHAR) END AS ds_search_id, ts AS "timestamp" FROM events)"""
WT = EV + """, aged AS (SELECT *, (epoch_us(max("timestamp") OVER ()) - epoch_us("timestamp")) / CAST(8.64e10 AS DOUBLE) AS age FROM ev),
    w AS (SELECT *, CASE WHEN event_type = 'purchase' THEN CAST(3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS base, CASE WHEN ds_search_id IS NOT NULL THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS boost,
          CASE WHEN age > 0 THEN pow(CAST(0.5 AS DOUBLE), age / CAST(30 AS DOUBLE)) ELSE CAST(1 AS DOUBLE) END AS decay FROM aged),
    wt AS (SELECT *, base * boost * decay AS weight FROM w)"""
ED = WT + """, ed AS (SELECT client_id, item_id, sum(weight) AS weight, count(*) AS n FROM wt GROUP BY ALL)"""
NODES = ED + """, st AS (SELECT 'user' AS kind, client_id AS id, count(*) AS degree, sum(weight) AS strength FROM ed GROUP BY client_id
    UNION ALL SELECT 'item', item_id, count(*), sum(weight) FROM ed GROUP BY item_id)"""
ADJ = ED + """, adj AS (SELECT 'u:' || client_id AS src, 'i:' || item_id AS dst, weight AS w FROM ed UNION ALL SELECT 'i:' || item_id, 'u:' || client_id, weight FROM ed)"""
NORM = ADJ + """, deg AS (SELECT src AS node, CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END AS degree FROM adj GROUP BY src),
    nadj AS (SELECT src, dst, w / sqrt(s.degree * d.degree) AS w FROM adj JOIN deg AS s ON src = s.node JOIN deg AS d ON dst = d.node)"""
VEC = """tv AS (SELECT vec_id AS item_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    gv AS (SELECT vec_id + 50 AS item_id, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    tn AS (SELECT item_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM tv),
    gn AS (SELECT item_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM gv)"""
SPLIT = EV + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY "timestamp" DESC, event_id DESC, item_id DESC) AS rn,
    count(*) OVER (PARTITION BY client_id, event_type, item_id, ds_search_id, "timestamp") AS same FROM ev),
    test AS (SELECT client_id, item_id FROM ranked WHERE rn = 1), train AS (SELECT * FROM ranked WHERE rn > 1 AND same = 1)"""
UI = """uv AS (SELECT client_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM (SELECT DISTINCT client_id FROM ev) JOIN embeddings ON client_id = CAST(vec_id AS VARCHAR)),
    iv AS (SELECT item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM (SELECT DISTINCT item_id FROM ev) JOIN embeddings ON item_id = CAST(vec_id - 300 AS VARCHAR)),
    scored AS (SELECT client_id, item_id, list_inner_product(uv.v, iv.v) AS score FROM uv CROSS JOIN iv)"""
RANKED = SPLIT + ", " + UI + """, top AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM scored
    WHERE (client_id, item_id) NOT IN (SELECT (client_id, item_id) FROM train))"""
DOCS = "d AS (SELECT doc_id AS item_id, source AS title, text AS description FROM documents)"
U = lambda key: f"((CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"
USERS_LAST = "(SELECT DISTINCT client_id FROM ev)"


def query(sql: str | Callable[[], str] | None = None):
    """Registers a query with its SQL, which may be a function where pieces of it stand further down."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            LATER[f.__name__] = sql if callable(sql) else (lambda: sql)
        return f

    return put


def r6(d: DataFrame, *cols: str) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c in cols})


def components_of(d: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """A row (keys, k, x) for each component of d's vectors, rounded."""
    d = d.select(*keys, F.posexplode(vector).alias("k", "x"))
    return d.select(*keys, F.col("k").cast("long").alias("k"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _as_csv(d: DataFrame, name: str) -> str:
    path = work_dir(d.sparkSession, name)
    d.write.csv(path, header=True, quote='"', escape='"')
    return path


# --- Sources and sinks


@query(f"""WITH {EV} SELECT event_type, client_id, item_id, ds_search_id, epoch_us("timestamp") AS micros FROM ev""")
def read_events(s, sf):
    raw = a.raw_events(s, sf).select(F.col("event_type").alias(" Event_Type"), F.col("client_id").alias("CLIENT_ID"), "item_id", "ds_search_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp "))
    d = events.clean_events(readers.read_events(s, _as_csv(raw, "events-csv")))
    return d.select("event_type", "client_id", "item_id", "ds_search_id", F.unix_micros("timestamp").alias("micros"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, p_type || ' ' || p_brand AS description FROM part")
def read_items(s, sf):
    raw = a.items(s, sf).select(F.col("item_id").alias("Item_ID"), F.col("title").alias("pozisyon_adi"), F.col("description").alias("item_id_aciklama"))
    return readers.read_items(s, _as_csv(raw, "items-csv"))


@query(f"""WITH {EV} SELECT client_id, item_id, epoch_us("timestamp") AS micros, event_type FROM ev""")
def standardize_event_columns(s, sf):
    raw = a.raw_events(s, sf).select(F.col("client_id").alias("﻿User ID"), F.col("item_id").alias("Ad-Id"), F.col("timestamp").alias("Event Time"), "event_type")
    d = readers.standardize_event_columns(raw)
    return d.select("client_id", "item_id", F.unix_micros("timestamp").alias("micros"), F.lower(F.btrim("event_type")).alias("event_type"))


@query("SELECT doc_id AS item_id, text FROM documents")
def read_text_input(s, sf):
    path = work_dir(s, "texts")
    a.texts(s, sf).select("item_id", F.col("description").alias("text")).write.parquet(f"{path}.parquet")
    return readers.read_text_input(s, f"{path}.parquet", f"{path}.csv", ("item_id", "text")).select("item_id", "text")


@query("SELECT vec_id AS item_id, unnest(range(64)) AS k, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM embeddings")
def pack_vectors(s, sf):
    wide = readers.unpack_vectors(a.table(s, sf, "embeddings"), 64, "vec_id")
    return components_of(readers.pack_vectors(wide, "vec_id"), "item_id")


@query("SELECT vec_id AS item_id, " + ", ".join(f'round(CAST(embedding[{k + 1}] AS DOUBLE), 6) AS "{k}"' for k in range(a.DIM)) + " FROM embeddings")
def unpack_vectors(s, sf):
    d = readers.unpack_vectors(a.text_vectors(s, sf), a.DIM)
    return d.select("item_id", *[F.round(F.col(str(k)).cast("double"), 6).alias(str(k)) for k in range(a.DIM)])


@query("SELECT doc_id AS item_id, unnest(range(64)) AS k, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM documents JOIN embeddings ON vec_id = doc_id")
def ids_with_vectors(s, sf):
    ids = a.table(s, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ordinal"))
    vecs = a.table(s, sf, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")
    return components_of(readers.ids_with_vectors(ids, vecs), "item_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS run_id FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderpriority = '1-URGENT') AND o_orderpriority = '1-URGENT'")
def latest_run(s, sf):
    runs = a.table(s, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", writers.RUN_ID).alias("run_id"), F.col("o_orderpriority").alias("source"))
    return readers.latest_run(runs, ("0-NONE", "1-URGENT", "2-HIGH")).select("o_orderkey", "run_id")


@query(f"WITH {NODES} SELECT kind AS a, id AS b, NULL AS weight, NULL AS n FROM st UNION ALL SELECT client_id, item_id, round(weight, 6), n FROM ed")
def write_graph(s, sf):
    """All nodes and edges of the stored graph, read back."""
    e, path = a.edges(s, sf), work_dir(s, "graph")
    writers.write_graph(graph.distinct_nodes(e), e, path)
    nodes = s.read.parquet(f"{path}/nodes").select(F.col("kind").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("n"))
    return nodes.unionAll(s.read.parquet(f"{path}/edges").select("client_id", "item_id", F.round("weight", 6), "count"))


SUMMARY = f"""WITH {ED} SELECT count(DISTINCT client_id) AS users, count(DISTINCT item_id) AS items, count(*) AS edges, round(count(*) / count(DISTINCT client_id), 3) AS avg_user_degree,
    round(count(*) / count(DISTINCT item_id), 3) AS avg_item_degree, round(min(weight), 6) AS weight_min, round(max(weight), 6) AS weight_max, round(avg(weight), 6) AS weight_mean FROM ed"""


@query(f"SELECT *, '{RUN}' AS run_id FROM ({SUMMARY})")
def write_summary(s, sf):
    path = work_dir(s, "summary")
    writers.write_summary(graph.graph_summary(a.edges(s, sf)), path, RUN)
    return s.read.json(f"{path}/json")


@query(f"WITH {NODES} SELECT id, degree, round(strength, 6) AS strength, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(strength, 9) DESC, degree DESC, id) AS rn FROM st) WHERE rn <= 20")
def write_top_tables(s, sf):
    e, path = written(a.edges(s, sf), "edges"), work_dir(s, "top")
    writers.write_top_tables(graph.top_items(e, None), graph.top_users(e), path)
    one = lambda name, c, kind: s.read.csv(f"{path}/{name}", header=True).select(F.col(c).alias("id"), F.col("degree").cast("long").alias("degree"), F.round(F.col("strength").cast("double"), 6).alias("strength"), F.lit(kind).alias("kind"))
    return one("items", "item_id", "item").unionAll(one("users", "client_id", "user"))


def _clean_sql() -> str:
    return f"{COUNTED}, r AS (SELECT item_id, title || ' . ' || description AS text_raw FROM d) SELECT item_id, text_raw, t AS text_clean, CAST(wc AS INTEGER) AS wc FROM r JOIN c USING (item_id) JOIN n USING (item_id)"


@query(_clean_sql)
def write_clean_text(s, sf):
    path = work_dir(s, "clean")
    writers.write_clean_text(_cleaned(s, sf), path)
    return s.read.parquet(f"{path}/parquet")


@query("SELECT vec_id AS item_id, unnest(range(32)) AS k, round(CAST(unnest(embedding[1:32]) AS DOUBLE), 6) AS x FROM embeddings")
def write_embeddings(s, sf):
    path = work_dir(s, "vectors")
    writers.write_embeddings(a.text_vectors(s, sf), path)
    return components_of(s.read.parquet(path), "item_id")


@query(f"WITH {WT} SELECT event_id, '{RUN}' AS run_id, round(weight, 9) AS weight FROM wt")
def write_params(s, sf):
    """Weights of the log by the parameters of a run, as its record has them."""
    path = work_dir(s, "params")
    writers.write_params(s, Params(), path, RUN)
    stored = s.read.json(path).first().asDict()
    p = Params(**{k: stored[k] for k in vars(Params())})
    w = events.event_weights(a.events(s, sf), click=p.weight_click, purchase=p.weight_purchase, boost=p.session_boost, half_life_days=p.half_life_days, boost_missing=p.boost_missing_session)
    return w.select("event_id", F.lit(stored["run_id"]).alias("run_id"), F.round("weight", 9).alias("weight"))


METRICS = f"""WITH {RANKED}, ranks AS (SELECT t.client_id, rank FROM test AS t SEMI JOIN uv ON t.client_id = uv.client_id SEMI JOIN iv ON t.item_id = iv.item_id LEFT JOIN top USING (client_id, item_id))
    SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(CASE WHEN rank <= k THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, count(*) AS targets
    FROM ranks CROSS JOIN (SELECT unnest([10, 20, 50]) AS k) GROUP BY k"""


@query(METRICS)
def write_eval(s, sf):
    path = work_dir(s, "eval")
    writers.write_eval(QUERIES["evaluate"](s, sf), path, RUN, embeddings="table")
    return s.read.json(path).select(F.col("k").cast("int").alias("k"), "recall", "ndcg", "mrr", "targets")


# --- Collections


@query("""WITH b AS (SELECT 'text' AS collection, vec_id AS item_id, 'first' AS source, 0 AS batch, embedding[1:32] AS v FROM embeddings UNION ALL SELECT 'text', vec_id + 50, 'second', 1, embedding[33:64] FROM embeddings),
    l AS (SELECT collection, item_id, max_by(struct_pack(source := source, v := v), batch) AS r FROM b GROUP BY ALL)
    SELECT collection, item_id, r.source AS source, unnest(range(32)) AS k, round(CAST(unnest(r.v) AS DOUBLE), 6) AS x FROM l""")
def vector_upsert(s, sf):
    """A stored collection, made by one upsert and changed by a second one, read back."""
    row = lambda d, src, b: d.select(F.lit("text").alias("collection"), "item_id", "embedding", F.lit(src).alias("source"), F.lit(b).alias("batch"))
    path = work_dir(s, "collection")
    collections.upsert_collection(path, row(a.text_vectors(s, sf), "first", 0))
    collections.upsert_collection(path, row(a.graph_vectors(s, sf), "second", 1))
    return components_of(collections.read_collection(s, path), "collection", "item_id", "source")


@query("""SELECT t.vec_id IS NOT NULL AS in_text, g.id IS NOT NULL AS in_graph, count(*) AS n FROM embeddings AS t FULL JOIN (SELECT vec_id + 50 AS id FROM embeddings) AS g ON t.vec_id = g.id GROUP BY ALL""")
def collection_coverage(s, sf):
    return collections.collection_coverage(a.text_vectors(s, sf), a.graph_vectors(s, sf))


# --- Events


@query(f"""WITH {EV} SELECT event_id, event_type, client_id, item_id, ds_search_id, epoch_us("timestamp") AS micros FROM ev""")
def clean_events(s, sf):
    return a.events(s, sf).select("event_id", "event_type", "client_id", "item_id", "ds_search_id", F.unix_micros("timestamp").alias("micros"))


@query(f"""WITH {EV}, gaps AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN client_id END AS client_id, CASE WHEN event_id % 11 <> 0 THEN item_id END AS item_id, CASE WHEN event_id % 13 <> 0 THEN "timestamp" END AS t FROM ev)
    SELECT event_id, client_id, item_id, epoch_us(t) AS micros FROM gaps WHERE client_id IS NOT NULL AND item_id IS NOT NULL AND t IS NOT NULL""")
def drop_incomplete(s, sf):
    """The log with gaps by number of the event, without the rows that have one."""
    gaps = a.events(s, sf).withColumns({c: F.when(F.col("event_id") % n != 0, F.col(c)) for c, n in (("client_id", 7), ("item_id", 11), ("timestamp", 13))})
    return events.drop_incomplete(gaps).select("event_id", "client_id", "item_id", F.unix_micros("timestamp").alias("micros"))


@query(f"""WITH {EV}, gaps AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN client_id WHEN event_id % 2 = 0 THEN '  ' END AS c, CASE WHEN event_id % 11 <> 0 THEN item_id END AS i, CASE WHEN event_id % 13 <> 0 THEN "timestamp" END AS t FROM ev),
    f AS (SELECT event_id, trim(coalesce(c, '')) = '' AS nc, i IS NULL AS ni, t IS NULL AS nt FROM gaps)
    SELECT 'clean_events' AS step, count(*) AS "rows", count(*) FILTER (nc) AS no_client, count(*) FILTER (ni AND NOT nc) AS no_item, 0 AS no_time, count(*) FILTER (NOT nc AND NOT ni) AS kept FROM f
    UNION ALL SELECT 'drop_incomplete', count(*), 0, 0, count(*) FILTER (nt), count(*) FILTER (NOT nt) FROM f WHERE NOT nc AND NOT ni""")
def dropped_counts(s, sf):
    """What cleaning a log with gaps drops by reason, observed while it is written."""
    raw = a.raw_events(s, sf)
    client = F.when(F.col("event_id") % 7 != 0, F.col("client_id")).when(F.col("event_id") % 2 == 0, F.lit("  "))
    gaps = raw.withColumns({"client_id": client, "item_id": F.when(F.col("event_id") % 11 != 0, F.col("item_id")), "timestamp": F.when(F.col("event_id") % 13 != 0, F.col("timestamp"))})
    cleaned, first = events.clean_events_counted(gaps)
    whole, second = events.drop_incomplete_counted(cleaned)
    written(whole, "whole-events")
    rows = [(name, *(int(seen.get.get(c, 0)) for c in ("rows", "no_client", "no_item", "no_time", "kept"))) for name, seen in (("clean_events", first), ("drop_incomplete", second))]
    return s.createDataFrame(rows, "step string, rows long, no_client long, no_item long, no_time long, kept long")


@query(f"WITH {EV} SELECT event_id, ds_search_id IS NOT NULL AND trim(ds_search_id) <> '' AND lower(trim(ds_search_id)) <> 'nan' AS usable FROM ev")
def usable_session(s, sf):
    return a.events(s, sf).select("event_id", events.usable_session(F.col("ds_search_id")).alias("usable"))


@query(f"WITH {WT} SELECT event_id, base AS weight FROM wt")
def base_event_weight(s, sf):
    return a.events(s, sf).select("event_id", events.base_event_weight(F.col("event_type")).alias("weight"))


@query(f"WITH {WT} SELECT event_id, boost, CAST(1.1 AS DOUBLE) AS boost_missing FROM wt")
def session_boost(s, sf):
    c = F.col("ds_search_id")
    return a.events(s, sf).select("event_id", events.session_boost(c).alias("boost"), events.session_boost(c, boost_missing=True).alias("boost_missing"))


@query(f"WITH {WT} SELECT event_id, round(decay, 9) AS decay FROM wt")
def time_decay(s, sf):
    e = a.events(s, sf)
    return e.join(F.broadcast(events.reference_time(e))).select("event_id", F.round(events.time_decay(F.col("timestamp"), F.col("reference")), 9).alias("decay"))


@query(f"""WITH {EV} SELECT epoch_us(max("timestamp")) AS micros FROM ev""")
def reference_time(s, sf):
    return events.reference_time(a.events(s, sf)).select(F.unix_micros("reference").alias("micros"))


@query(f"WITH {WT} SELECT event_id, round(weight, 9) AS weight FROM wt")
def event_weights(s, sf):
    return a.weighted(s, sf).select("event_id", F.round("weight", 9).alias("weight"))


# --- Graph


@query(f"""WITH {WT} SELECT client_id, item_id, round(sum(weight), 6) AS weight, count(*) AS "count", count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'purchase') AS purchase_count,
    max_by(ds_search_id, struct_pack(t := epoch_us("timestamp"), e := event_id)) FILTER (ds_search_id IS NOT NULL) AS last_ds_search_id, epoch_us(max("timestamp")) AS last_micros,
    min_by(ds_search_id, event_id) FILTER (ds_search_id IS NOT NULL) AS first_ds_search_id, epoch_us(min_by("timestamp", event_id)) AS first_micros FROM wt GROUP BY client_id, item_id""")
def build_edges(s, sf):
    d = a.edges(s, sf).withColumn("last_micros", F.unix_micros("last_timestamp")).withColumn("first_micros", F.unix_micros("first_timestamp"))
    return r6(d.drop("last_timestamp", "first_timestamp"), "weight")


LARGE_ED = """le AS (SELECT CASE WHEN l_returnflag = 'R' THEN CAST(3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * CASE WHEN l_linenumber % 2 = 0 THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS m,
    CAST(o_custkey AS VARCHAR) AS client_id, CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_shipdate AS TIMESTAMP) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    la AS (SELECT *, (epoch_us(max(t) OVER ()) - epoch_us(t)) / CAST(8.64e10 AS DOUBLE) AS age FROM le),
    led AS (SELECT client_id, item_id, sum(m * CASE WHEN age > 0 THEN pow(CAST(0.5 AS DOUBLE), age / CAST(30 AS DOUBLE)) ELSE 1 END) AS weight, count(*) AS n FROM la GROUP BY ALL)"""


@query(f'WITH {LARGE_ED} SELECT client_id, item_id, round(weight, 6) AS weight, n AS "count" FROM led')
def build_edges_large(s, sf):
    return r6(a.large_edges(s, sf).select("client_id", "item_id", "weight", "count"), "weight")


@query(f"WITH {ED} SELECT client_id, item_id, round(weight, 6) AS weight FROM ed")
def interactions(s, sf):
    return r6(graph.interactions(a.weighted(s, sf)), "weight")


@query(f"WITH {NODES} SELECT kind, id FROM st")
def distinct_nodes(s, sf):
    return graph.distinct_nodes(a.edges(s, sf))


@query("SELECT 'user' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT 'item', CAST(p_partkey AS VARCHAR) FROM part")
def node_union(s, sf):
    return graph.node_union(a.table(s, sf, "customer").select(F.col("c_custkey").cast("string").alias("client_id")), a.items(s, sf))


@query(f"WITH {NODES} SELECT kind, id, degree FROM st")
def node_degree(s, sf):
    e = a.edges(s, sf)
    one = lambda c, kind: graph.node_stats(e, c).select(F.lit(kind).alias("kind"), F.col(c).alias("id"), "degree")
    return one("client_id", "user").unionAll(one("item_id", "item"))


@query(f"WITH {NODES} SELECT kind, id, round(strength, 6) AS strength FROM st")
def node_strength(s, sf):
    e = a.edges(s, sf)
    one = lambda c, kind: graph.node_stats(e, c).select(F.lit(kind).alias("kind"), F.col(c).alias("id"), "strength")
    return r6(one("client_id", "user").unionAll(one("item_id", "item")), "strength")


@query(SUMMARY)
def graph_summary(s, sf):
    return graph.graph_summary(a.edges(s, sf))


@query(f"""WITH {NODES}, o AS (SELECT kind, degree, row_number() OVER (PARTITION BY kind ORDER BY degree) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM st)
    SELECT kind, quantile_cont(degree, 0.5) AS median, max(degree) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90, max(degree) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99 FROM o GROUP BY kind""")
def degree_percentiles(s, sf):
    return graph.degree_percentiles(a.edges(s, sf))


@query(f"WITH {ED} SELECT round(quantile_cont(weight, 0.5), 6) AS weight_median, round(quantile_cont(weight, 0.9), 6) AS weight_p90, round(quantile_cont(weight, 0.99), 6) AS weight_p99, round(stddev_samp(weight), 6) AS weight_std FROM ed")
def weight_stats(s, sf):
    return r6(graph.weight_stats(a.edges(s, sf)), "weight_median", "weight_p90", "weight_p99", "weight_std")


@query(f"""WITH {ED}, b AS (SELECT weight, hash_part AS run, CAST(ceil(ln(weight) / {math.log(1.01 / 0.99)!r}::DOUBLE) AS INTEGER) AS bin FROM (SELECT *, CAST(client_id AS BIGINT) % 3 AS hash_part FROM ed)),
    v AS (SELECT exp({math.log(1.01 / 0.99)!r}::DOUBLE * bin) * 0.99::DOUBLE AS x, count(*) AS n FROM b GROUP BY bin), u AS (SELECT x, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total FROM v)
    SELECT {", ".join(f"round(min(x) FILTER (upto > floor({q}::DOUBLE * (total - 1))) + (min(x) FILTER (upto > ceil({q}::DOUBLE * (total - 1))) - min(x) FILTER (upto > floor({q}::DOUBLE * (total - 1)))) * (max({q}::DOUBLE * (total - 1)) - floor(max({q}::DOUBLE * (total - 1)))), 6) AS weight_{n}" for q, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99")))},
           (SELECT round(stddev_samp(weight), 6) FROM ed) AS weight_std FROM u""")
def sketched_weight_stats(s, sf):
    """Figures of all weights from three runs' stored sketches, which were made of a third of the clients each."""
    e, path = a.edges(s, sf), work_dir(s, "sketches")
    for run in range(3):
        graph.weight_sketch(e.filter(F.col("client_id").cast("long") % 3 == run)).write.parquet(f"{path}/{run}")
    d = graph.sketched_weight_stats(s.read.parquet(*[f"{path}/{run}" for run in range(3)]))
    return r6(d, "weight_median", "weight_p90", "weight_p99", "weight_std")


@query(f"WITH {NODES} SELECT st.kind, st.id, p_name AS title, length(p_type || ' ' || p_brand) AS desc_len FROM st LEFT JOIN part ON st.kind = 'item' AND st.id = CAST(p_partkey AS VARCHAR)")
def attach_item_metadata(s, sf):
    return graph.attach_item_metadata(graph.distinct_nodes(a.edges(s, sf)), a.items(s, sf)).withColumn("desc_len", F.col("desc_len").cast("long"))


@query(f"WITH {NODES} SELECT id AS item_id, degree, round(strength, 6) AS strength, coalesce(p_name, '') AS title FROM (SELECT * FROM st WHERE kind = 'item' ORDER BY round(strength, 9) DESC, degree DESC, id LIMIT 20) LEFT JOIN part ON id = CAST(p_partkey AS VARCHAR)")
def top_items(s, sf):
    return r6(graph.top_items(a.edges(s, sf), a.items(s, sf)), "strength")


@query(f"WITH {NODES} SELECT id AS client_id, degree, round(strength, 6) AS strength FROM st WHERE kind = 'user' ORDER BY round(strength, 9) DESC, degree DESC, id LIMIT 20")
def top_users(s, sf):
    return r6(graph.top_users(a.edges(s, sf)), "strength")


@query("SELECT source AS item_id, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY source")
def item_dedupe_first(s, sf):
    return graph.item_dedupe_first(a.table(s, sf, "documents").select(F.col("source").alias("item_id"), "doc_id", "text"), ["doc_id"])


@query(f"WITH {ADJ} SELECT src, dst, round(w, 6) AS w FROM adj")
def symmetric_adjacency(s, sf):
    return r6(graph.symmetric_adjacency(a.edges(s, sf)), "w")


@query(f"WITH {NORM} SELECT node, round(degree, 6) AS degree FROM deg")
def weighted_degree(s, sf):
    return r6(graph.weighted_degree(graph.symmetric_adjacency(a.edges(s, sf))), "degree")


@query(f"WITH {NORM} SELECT src, dst, round(w, 6) AS w FROM nadj")
def normalized_adjacency(s, sf):
    return r6(graph.normalized_adjacency(graph.symmetric_adjacency(a.edges(s, sf))), "w")


@query(f"""WITH RECURSIVE {LARGE_ED}, e AS (SELECT 'u:' || client_id AS a, 'i:' || item_id AS b FROM led UNION ALL SELECT 'i:' || item_id, 'u:' || client_id FROM led),
    cc(node, component) USING KEY (node) AS (SELECT a, min(a) FROM e GROUP BY a
        UNION SELECT e.b, min(cc.component) FROM cc JOIN e ON e.a = cc.node JOIN recurring.cc AS r ON r.node = e.b WHERE cc.component < r.component GROUP BY e.b)
    SELECT node, component FROM cc""")
def connected_components(s, sf):
    adj = graph.symmetric_adjacency(a.large_edges(s, sf))
    return components.connected_components(adj.filter(F.col("src").startswith("u:")), "src", "dst")


# --- Splits and ids


@query(f"WITH {SPLIT} SELECT client_id, item_id FROM test")
def leave_last_out(s, sf):
    return split.leave_last_out(a.events(s, sf))


@query(f"WITH {SPLIT} SELECT event_id, client_id, item_id FROM train")
def train_minus_last(s, sf):
    return split.train_minus_last(a.events(s, sf)).select("event_id", "client_id", "item_id")


@query(f"WITH {EV} SELECT client_id, item_id, event_type FROM ev GROUP BY ALL HAVING count(*) = 1")
def drop_all_duplicates(s, sf):
    return split.drop_all_duplicates(a.events(s, sf).select("client_id", "item_id", "event_type"))


@query(f"WITH {EV}, {UI} SELECT event_id, client_id, item_id FROM ev SEMI JOIN (SELECT * FROM uv WHERE CAST(client_id AS BIGINT) % 3 <> 0) AS u ON ev.client_id = u.client_id SEMI JOIN (SELECT * FROM iv WHERE CAST(item_id AS BIGINT) % 4 <> 0) AS i ON ev.item_id = i.item_id")
def restrict_to_embedded(s, sf):
    """The log's rows of clients and items with vectors, of which each third client and each fourth item has none."""
    u, i = a.user_vectors(s, sf).filter(F.col("client_id").cast("long") % 3 != 0), a.item_vectors(s, sf).filter(F.col("item_id").cast("long") % 4 != 0)
    return split.restrict_to_embedded(a.events(s, sf), u, i).select("event_id", "client_id", "item_id")


@query(f"WITH {SPLIT} SELECT DISTINCT client_id, item_id FROM train")
def seen_items(s, sf):
    return split.seen_items(split.train_minus_last(a.events(s, sf)))


INDEX = "ix AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS idx FROM st)"


@query(f"WITH {NODES}, {INDEX} SELECT kind, id, idx FROM ix")
def id_index(s, sf):
    return split.id_index(graph.distinct_nodes(a.edges(s, sf)))


@query(f"WITH {NODES}, {INDEX} SELECT u.idx AS u, i.idx AS i, round(weight, 6) AS weight FROM ed JOIN ix AS u ON u.kind = 'user' AND u.id = client_id JOIN ix AS i ON i.kind = 'item' AND i.id = item_id")
def map_ids(s, sf):
    e = written(a.edges(s, sf), "edges")
    return r6(split.map_ids(e, split.id_index(graph.distinct_nodes(e))), "weight")


# --- Texts


def _raw(s: SparkSession, sf: str) -> DataFrame:
    return a.texts(s, sf).select("item_id", text.build_text(F.col("title"), F.col("description")).alias("text_raw"))


def _cleaned(s: SparkSession, sf: str) -> DataFrame:
    d = _raw(s, sf).withColumn("text_clean", text.clean_text(F.col("text_raw"), html=False, lower=True))
    return d.withColumn("wc", text.word_count(F.col("text_clean")))


def _each_text(step: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, sf: a.texts(s, sf).select("item_id", step(F.col("description")).alias("text"))


@query(f"WITH {DOCS} SELECT item_id, CASE WHEN title <> '' AND description <> '' THEN title || ' . ' || description ELSE coalesce(title, '') || coalesce(description, '') END AS text_raw FROM d")
def build_text(s, sf):
    return _raw(s, sf)


@query()
def strip_html(s, sf):
    return a.table(s, sf, "pages").select("page_id", text.strip_html(F.coalesce("html", F.lit(""))).alias("text"))


SPACE_SQL = r"trim(regexp_replace(replace(description, chr(160), ' '), '[\s\x0B\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
PUNCT_SQL = r"""'["''`^~_|<>\[\]{}()=+*#@:;.,!?–—-]'"""


@query(f"WITH {DOCS} SELECT item_id, {SPACE_SQL} AS text FROM d")
def normalize_space(s, sf):
    return _each_text(text.normalize_space)(s, sf)


@query(rf"WITH {DOCS} SELECT item_id, regexp_replace(description, '(?i)\b((?:https?://|www\.)\S+)\b', '<URL>', 'g') AS text FROM d")
def mask_url(s, sf):
    return _each_text(text.mask_url)(s, sf)


@query(rf"WITH {DOCS} SELECT item_id, regexp_replace(description, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}\b', '<EMAIL>', 'g') AS text FROM d")
def mask_email(s, sf):
    return _each_text(text.mask_email)(s, sf)


@query(rf"WITH {DOCS} SELECT item_id, regexp_replace(description, '(?:\+?\d{{1,3}}[\s\-.]?)?(?:\(?\d{{3}}\)?[\s\-.]?)?\d{{3}}[\s\-.]?\d{{2,4}}', '<PHONE>', 'g') AS text FROM d")
def mask_phone(s, sf):
    return _each_text(text.mask_phone)(s, sf)


MASKED = "description"
for _ in range(2):  # a boundary between two numbers is used up by the first one's match
    MASKED = rf"regexp_replace({MASKED}, '(^|[^\pL\pN_])\d{{3,}}($|[^\pL\pN_])', '\1<NUM>\2', 'g')"


@query(f"WITH {DOCS} SELECT item_id, {MASKED} AS text FROM d")
def mask_numbers(s, sf):
    return _each_text(text.mask_numbers)(s, sf)


@query(f"WITH {DOCS} SELECT item_id, regexp_replace(description, {PUNCT_SQL}, ' ', 'g') AS text FROM d")
def strip_punct(s, sf):
    return _each_text(text.strip_punct)(s, sf)


@query(f"WITH {DOCS} SELECT item_id, lower(description) AS text FROM d")
def lowercase(s, sf):
    return _each_text(text.lowercase)(s, sf)


@query(f"WITH {DOCS} SELECT item_id, array_to_string(list_filter(string_split(description, ' '), lambda x: NOT list_contains({text.STOPWORDS!r}, x)), ' ') AS text FROM d")
def remove_stopwords(s, sf):
    return _each_text(text.remove_stopwords)(s, sf)


@query()
def clean_text(s, sf):
    return _raw(s, sf).select("item_id", text.clean_text(F.col("text_raw"), lower=True, stopwords=True).alias("text"))


@query(rf"WITH {DOCS} SELECT item_id, CASE WHEN coalesce(description, '') = '' THEN 0 ELSE len(regexp_split_to_array(description, '[\s\x0B]+')) END AS wc FROM d")
def word_count(s, sf):
    return a.texts(s, sf).select("item_id", text.word_count(F.col("description")).cast("long").alias("wc"))


CLEANED = "replace(title || ' . ' || description, chr(160), ' ')"
CLEANED = rf"regexp_replace({CLEANED}, '(?i)\b((?:https?://|www\.)\S+)\b', '<URL>', 'g')"
CLEANED = rf"regexp_replace({CLEANED}, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}\b', '<EMAIL>', 'g')"
CLEANED = rf"regexp_replace({CLEANED}, '(?:\+?\d{{1,3}}[\s\-.]?)?(?:\(?\d{{3}}\)?[\s\-.]?)?\d{{3}}[\s\-.]?\d{{2,4}}', '<PHONE>', 'g')"
for _ in range(2):
    CLEANED = rf"regexp_replace({CLEANED}, '(^|[^\pL\pN_])\d{{3,}}($|[^\pL\pN_])', '\1<NUM>\2', 'g')"
CLEANED = f"lower(trim(regexp_replace(regexp_replace({CLEANED}, {PUNCT_SQL}, ' ', 'g'), '\\s+', ' ', 'g')))"
COUNTED = f"WITH {DOCS}, c AS (SELECT item_id, {CLEANED} AS t FROM d), n AS (SELECT item_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS wc FROM c)"


@query(f"{COUNTED} SELECT item_id, CAST(wc AS INTEGER) AS wc FROM n WHERE wc >= 5")
def min_word_filter(s, sf):
    return text.min_word_filter(_cleaned(s, sf)).select("item_id", "wc")


@query(f"{COUNTED} SELECT count(*) AS rows_before, count(*) FILTER (wc >= 5) AS rows_after FROM n")
def length_filter_report(s, sf):
    return text.length_filter_report(_cleaned(s, sf))


@query(f"WITH {DOCS}, b AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '  ' WHEN item_id % 7 = 0 THEN NULL ELSE description END AS text FROM d) SELECT item_id, text FROM b WHERE trim(coalesce(text, '')) <> ''")
def nonblank_text(s, sf):
    """Texts of which each fifth is blank and each seventh missing, without these."""
    blank = F.when(F.col("item_id") % 5 == 0, F.lit("  ")).when(F.col("item_id") % 7 != 0, F.col("description"))
    return text.nonblank_text(a.texts(s, sf).select("item_id", blank.alias("text")), "text")


@query("SELECT source AS item_id, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text_clean FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY source")
def encode_input(s, sf):
    d = a.table(s, sf, "documents").select(F.col("source").alias("item_id"), "doc_id", F.col("text").alias("text_clean"))
    return text.encode_input(d, ["doc_id"]).select("item_id", "doc_id", "text_clean")


@query()
def encode_text(s, sf):
    return text.encode_text(text.nonblank_text(_cleaned(s, sf), "text_clean"), text.hashed_ngrams).select("item_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, length(p_type || ' ' || p_brand) AS desc_len FROM part")
def desc_len(s, sf):
    return a.items(s, sf).select("item_id", F.length("description").cast("long").alias("desc_len"))


# --- Vectors


@query(f"WITH {VEC} SELECT item_id, unnest(range(32)) AS k, round(unnest(v), 6) AS x FROM tn")
def l2_normalize(s, sf):
    d = a.text_vectors(s, sf).select("item_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("k", "x"))
    return d.select("item_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query(f"WITH {VEC} SELECT item_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM tv")
def vector_norm(s, sf):
    return a.text_vectors(s, sf).select("item_id", F.round(vectors.vector_norm(F.col("embedding")), 6).alias("norm"))


def _aligned(s: SparkSession, sf: str) -> DataFrame:
    return vectors.align_vectors(a.text_vectors(s, sf), a.graph_vectors(s, sf))


@query(f"WITH {VEC} SELECT item_id, unnest(range(32)) AS k, round(unnest(tv.v), 6) AS t, round(unnest(gv.v), 6) AS g FROM tv JOIN gv USING (item_id)")
def align_vectors(s, sf):
    d = _aligned(s, sf).select("item_id", F.posexplode(F.arrays_zip("text_vec", "graph_vec")).alias("k", "v"))
    return d.select("item_id", F.col("k").cast("long").alias("k"), *[F.round(F.col(f"v.{c}").cast("double"), 6).alias(n) for c, n in (("text_vec", "t"), ("graph_vec", "g"))])


@query(f"WITH {VEC} SELECT item_id, round(list_inner_product(tv.v, gv.v), 6) AS dot FROM tv JOIN gv USING (item_id)")
def dot(s, sf):
    return _aligned(s, sf).select("item_id", F.round(vectors.dot(F.col("text_vec"), F.col("graph_vec")), 6).alias("dot"))


@query(f"WITH {VEC} SELECT item_id, round(list_inner_product(tn.v, gn.v), 6) AS cosine FROM tn JOIN gn USING (item_id)")
def cosine(s, sf):
    return _aligned(s, sf).select("item_id", F.round(vectors.cosine(F.col("text_vec"), F.col("graph_vec")), 6).alias("cosine"))


@query(f"""WITH {VEC} SELECT item_id, round(1 - list_inner_product(tn.v, gn.v), 6) AS cosine, round(list_inner_product(tv.v, tv.v) + list_inner_product(gv.v, gv.v) - 2 * list_inner_product(tv.v, gv.v), 6) AS l2,
    round(1 - list_inner_product(tv.v, gv.v), 6) AS ip FROM tv JOIN gv USING (item_id) JOIN tn USING (item_id) JOIN gn USING (item_id)""")
def distance(s, sf):
    return _aligned(s, sf).select("item_id", *[F.round(vectors.distance(F.col("text_vec"), F.col("graph_vec"), m), 6).alias(m) for m in ("cosine", "l2", "ip")])


@query("SELECT item_id FROM (SELECT vec_id AS item_id FROM embeddings) INTERSECT SELECT vec_id + 50 FROM embeddings")
def id_intersection(s, sf):
    return vectors.id_intersection(a.text_vectors(s, sf), a.graph_vectors(s, sf))


FUSION = VEC + """, pairs AS (SELECT q.item_id AS query_item_id, c.item_id, list_inner_product(q.t, c.t) AS sim_text, list_inner_product(q.g, c.g) AS sim_graph
    FROM (SELECT item_id, tn.v AS t, gn.v AS g FROM tn JOIN gn USING (item_id)) AS q JOIN (SELECT item_id, tn.v AS t, gn.v AS g FROM tn JOIN gn USING (item_id)) AS c ON q.item_id <> c.item_id),
    fused AS (SELECT *, 0.5 * sim_graph + 0.5 * sim_text AS score FROM pairs), fr AS (SELECT *, row_number() OVER (PARTITION BY query_item_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fused)"""
FUSED_TOP = f"WITH {FUSION} SELECT query_item_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score, round(sim_text, 6) AS sim_text, round(sim_graph, 6) AS sim_graph FROM fr WHERE rank <= 10"


def _all_fused(s: SparkSession, sf: str) -> DataFrame:
    t, g = a.text_vectors(s, sf), a.graph_vectors(s, sf)
    return vectors.fusion_recommend(t, g, vectors.id_intersection(t, g))


@query(FUSED_TOP)
def fusion_recommend(s, sf):
    return vectors.round_scores(_all_fused(s, sf), "score", "sim_text", "sim_graph")


@query(FUSED_TOP.replace("0.5 * sim_graph + 0.5 * sim_text", "0.25 * sim_graph + 0.75 * sim_text"))
def fusion_topk(s, sf):
    """As fusion_recommend, with texts three times as important as the graph."""
    t, g = a.text_vectors(s, sf), a.graph_vectors(s, sf)
    return vectors.round_scores(vectors.fusion_recommend(t, g, vectors.id_intersection(t, g), alpha=0.25), "score", "sim_text", "sim_graph")


@query(lambda: f"WITH {BOTH_T} SELECT query_item_id, item_id, CAST(rank AS INTEGER) AS rank FROM ({_top_sql('cosine')}) WHERE rank <= 20 AND query_item_id <> item_id")
def exclude_self(s, sf):
    """The nearest of each item without itself, which is among them."""
    t = a.text_vectors(s, sf)
    return vectors.exclude_self(vectors.topm_candidates(t, t, 20)).select("query_item_id", "item_id", "rank")


@query(f"WITH {VEC} SELECT item_id, round(0.25 * list_inner_product(tn.v, gn.v) + 0.75 * list_inner_product(tv.v, gv.v), 6) AS score FROM tv JOIN gv USING (item_id) JOIN tn USING (item_id) JOIN gn USING (item_id)")
def fuse_scores(s, sf):
    d = _aligned(s, sf).select("item_id", vectors.cosine(F.col("text_vec"), F.col("graph_vec")).alias("c"), vectors.dot(F.col("text_vec"), F.col("graph_vec")).alias("d"))
    return d.select("item_id", F.round(vectors.fuse_scores(F.col("c"), F.col("d"), 0.25), 6).alias("score"))


@query(f"WITH {VEC} SELECT item_id, round(v[1], 6) AS x FROM tv")
def round_scores(s, sf):
    return vectors.round_scores(a.text_vectors(s, sf).select("item_id", F.col("embedding")[0].cast("double").alias("x")), "x")


def _top_sql(metric: str) -> str:
    sim = {"cosine": "list_inner_product(q.n, c.n)", "ip": "list_inner_product(q.v, c.v)", "l2": "1 - (list_inner_product(q.v, q.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(q.v, c.v))"}[metric]
    return f"SELECT *, row_number() OVER (PARTITION BY query_item_id ORDER BY round(similarity, 9) DESC, item_id) AS rank FROM (SELECT q.item_id AS query_item_id, c.item_id, {sim} AS similarity FROM both_t AS q CROSS JOIN both_t AS c)"


BOTH_T = VEC + ", both_t AS (SELECT item_id, tv.v AS v, tn.v AS n FROM tv JOIN tn USING (item_id))"


@query(" UNION ALL ".join(f"(WITH {BOTH_T} SELECT '{m}' AS metric, query_item_id, item_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM ({_top_sql(m)}) WHERE rank <= 200)" for m in ("cosine", "ip", "l2")))
def topm_candidates(s, sf):
    t, out = a.text_vectors(s, sf), None
    for m in ("cosine", "ip", "l2"):
        d = vectors.topm_candidates(t, t, metric=m).select(F.lit(m).alias("metric"), "query_item_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))
        out = d if out is None else out.unionByName(d)
    return out


@query()
def topm_approximate(s, sf):
    """The nearest by cosine with an index of inverted lists, for a recall of 0.95 on a sample of the queries."""
    t = a.text_vectors(s, sf)
    return vectors.topm_candidates(t, t, recall=0.95).select("query_item_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


TWO = VEC + """, ids AS (SELECT item_id FROM tn INTERSECT SELECT item_id FROM gn),
    tt AS (SELECT *, row_number() OVER (PARTITION BY query_item_id ORDER BY round(s, 9) DESC, item_id) AS r FROM (SELECT q.item_id AS query_item_id, c.item_id, list_inner_product(q.v, c.v) AS s FROM (SELECT * FROM tn SEMI JOIN ids USING (item_id)) AS q CROSS JOIN tn AS c)),
    gt AS (SELECT *, row_number() OVER (PARTITION BY query_item_id ORDER BY round(s, 9) DESC, item_id) AS r FROM (SELECT q.item_id AS query_item_id, c.item_id, list_inner_product(q.v, c.v) AS s FROM (SELECT * FROM gn SEMI JOIN ids USING (item_id)) AS q CROSS JOIN gn AS c)),
    fc AS (SELECT query_item_id, item_id, coalesce(t.s, -1) AS sim_text, coalesce(g.s, -1) AS sim_graph, 0.5 * coalesce(g.s, -1) + 0.5 * coalesce(t.s, -1) AS score
           FROM (SELECT * FROM tt WHERE r <= 200) AS t FULL JOIN (SELECT * FROM gt WHERE r <= 200) AS g USING (query_item_id, item_id))"""


def _two_lists(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t, g = a.text_vectors(s, sf), a.graph_vectors(s, sf)
    ids = vectors.id_intersection(t, g)
    return tuple(vectors.topm_candidates(ids.join(c, "item_id"), c) for c in (t, g))


@query(f"WITH {TWO} SELECT query_item_id, item_id, round(sim_text, 6) AS sim_text, round(sim_graph, 6) AS sim_graph, round(score, 6) AS score FROM fc")
def fuse_candidates(s, sf):
    return vectors.round_scores(vectors.fuse_candidates(*_two_lists(s, sf)), "sim_text", "sim_graph", "score")


@query(f"WITH {TWO} SELECT query_item_id, item_id FROM fc")
def candidate_union(s, sf):
    return vectors.candidate_union(*_two_lists(s, sf))


TWO_TOP = f"""WITH {TWO} SELECT query_item_id, CAST(rank AS INTEGER) AS rank, item_id, score, sim_text, sim_graph FROM (SELECT query_item_id, item_id, round(score, 6) AS score, round(sim_text, 6) AS sim_text, round(sim_graph, 6) AS sim_graph,
    row_number() OVER (PARTITION BY query_item_id ORDER BY round(score, 6) DESC, item_id) AS rank FROM fc WHERE query_item_id <> item_id) WHERE rank <= 10"""


@query(TWO_TOP)
def two_stage_topk(s, sf):
    return vectors.two_stage_topk(vectors.fuse_candidates(*_two_lists(s, sf)))


@query(TWO_TOP)
def two_stage_recommend(s, sf):
    t, g = a.text_vectors(s, sf), a.graph_vectors(s, sf)
    return vectors.two_stage_recommend(t, g, vectors.id_intersection(t, g))


@query("""WITH c AS (SELECT vec_id AS item_id FROM embeddings INTERSECT SELECT vec_id + 50 FROM embeddings)
    SELECT vec_id AS asked, CASE WHEN vec_id IN (SELECT item_id FROM c) THEN vec_id ELSE (SELECT min(item_id) FROM c) END AS item_id FROM embeddings""")
def resolve_query_ids(s, sf):
    t = a.text_vectors(s, sf)
    return vectors.resolve_query_ids(t, t, a.graph_vectors(s, sf))


# --- Samplers and training


PROPAGATED = NORM + """, x0 AS (SELECT node, k, 0.01 * sqrt(-2 * ln({u})) * cos(2 * pi() * {v}) AS x FROM (SELECT DISTINCT src AS node FROM nadj) CROSS JOIN (SELECT unnest(range(64)) AS k)),
    x1 AS (SELECT dst AS node, k, sum(w * x) AS x FROM nadj JOIN x0 ON src = node GROUP BY ALL), x2 AS (SELECT dst AS node, k, sum(w * x) AS x FROM nadj JOIN x1 ON src = node GROUP BY ALL),
    x3 AS (SELECT dst AS node, k, sum(w * x) AS x FROM nadj JOIN x2 ON src = node GROUP BY ALL)""".format(u=U("'42|' || node || '|' || k || '|u'"), v=U("'42|' || node || '|' || k || '|v'"))


def _nadj(s: SparkSession, sf: str) -> DataFrame:
    return written(graph.normalized_adjacency(graph.symmetric_adjacency(a.edges(s, sf))), "adjacency")


@query(f"WITH {PROPAGATED} SELECT node, k, round(x, 9) AS x FROM x0")
def init_embeddings(s, sf):
    d = sampling.init_embeddings(_nadj(s, sf).select(F.col("src").alias("node")).distinct(), Params().dim)
    # Outer, as Spark else asks first whether arrays are empty: it would make each once for every edge, before nodes are distinct.
    return d.select("node", F.posexplode_outer("x").alias("k", "x")).select("node", F.col("k").cast("long").alias("k"), F.round("x", 9).alias("x"))


@query(f"WITH {PROPAGATED} SELECT node, k, round(x, 8) AS x FROM x1")
def propagate(s, sf):
    adj = _nadj(s, sf)
    x = sampling.init_embeddings(adj.select(F.col("src").alias("node")).distinct(), Params().dim)
    d = lightgcn.propagate_once(adj, x, Params().dim)
    return d.select("node", F.posexplode("x").alias("k", "x")).select("node", F.col("k").cast("long").alias("k"), F.round("x", 8).alias("x"))


@query(f"WITH {PROPAGATED} SELECT node, k, round(sum(x) / 4, 8) AS x FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3) GROUP BY ALL")
def lightgcn_propagate(s, sf):
    p, adj = Params(), _nadj(s, sf)
    x = written(sampling.init_embeddings(adj.select(F.col("src").alias("node")).distinct(), p.dim), "start")
    d = lightgcn.lightgcn_propagate(lightgcn.stored_adjacency(adj), x, p.dim, p.layers)
    return d.select("node", F.posexplode("x").alias("k", "x")).select("node", F.col("k").cast("long").alias("k"), F.round("x", 8).alias("x"))


@query(f"WITH {EV} SELECT client_id FROM {USERS_LAST} ORDER BY {U("'42|0|1|' || client_id")}, client_id LIMIT 64")
def sample_users(s, sf):
    return sampling.sample_users(a.events(s, sf).select("client_id").distinct(), 64, 42, 0, 1)


POS = f"pos AS (SELECT client_id, min_by(item_id, struct_pack(r := -ln({U("'42|0|0|' || client_id || '|' || item_id")}) / weight, i := item_id)) AS pos FROM ed GROUP BY client_id)"
NEG = f"""items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ed)),
    draws AS (SELECT client_id, draw, CAST(floor({U("'42|0|0|neg|' || client_id || '|' || draw")} * (SELECT count(*) FROM items)) AS BIGINT) AS idx FROM (SELECT DISTINCT client_id FROM ed) CROSS JOIN (SELECT unnest(range(8)) AS draw)),
    neg AS (SELECT client_id, draw, item_id AS neg FROM draws JOIN items USING (idx) WHERE (client_id, item_id) NOT IN (SELECT (client_id, item_id) FROM ed))"""


def _sampled(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = written(graph.interactions(a.weighted(s, sf)), "interactions")
    items = split.id_index(graph.distinct_nodes(e)).filter("kind = 'item'").select(F.col("id").alias("item_id"), "idx")
    return e, e.select("client_id").distinct(), written(items, "items")


@query(f"WITH {ED}, {POS} SELECT client_id, pos FROM pos")
def sample_positive(s, sf):
    e, users, _ = _sampled(s, sf)
    return sampling.sample_positive(users, e, 42, 0, 0)


@query(f"""WITH {ED}, steps AS (SELECT *, sum(weight) OVER (PARTITION BY client_id ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS upto FROM ed),
    drawn AS (SELECT client_id, max(upto) * {U("'42|0|0|' || client_id || '|pos'")} AS place FROM steps GROUP BY client_id)
    SELECT client_id, min_by(item_id, upto) AS pos FROM steps JOIN drawn USING (client_id) WHERE upto > place GROUP BY client_id""")
def draw_positive(s, sf):
    """Draws by running sums, made once for all steps of a training."""
    e, users, _ = _sampled(s, sf)
    return sampling.draw_positive(users, written(sampling.positive_table(e), "positives"), 42, 0, 0)


@query(f"WITH {ED}, {NEG} SELECT client_id, draw, neg FROM neg")
def negative_candidates(s, sf):
    e, users, items = _sampled(s, sf)
    return sampling.negative_candidates(users, items, e, 8, 42, 0, 0).withColumn("draw", F.col("draw").cast("long"))


@query(f"WITH {ED}, {NEG.replace('range(8)', 'range(512)')} SELECT client_id, CAST(1 AS INTEGER) AS n, min_by(neg, draw) AS neg FROM neg GROUP BY client_id")
def sample_negatives(s, sf):
    e, users, items = _sampled(s, sf)
    return sampling.sample_negatives(users, items, e, 1, 42, 0, 0)


@query(f"""WITH {PROPAGATED.replace(ED, ED + ', ' + POS, 1)}, {NEG.replace('range(8)', 'range(512)')}, first_neg AS (SELECT client_id, min_by(neg, draw) AS neg FROM neg GROUP BY client_id),
    b AS (SELECT 'u:' || client_id AS u, 'i:' || pos AS p, 'i:' || neg AS n FROM pos JOIN first_neg USING (client_id)),
    m AS (SELECT u, sum(xu.x * (xp.x - xn.x)) AS d FROM b JOIN x0 AS xu ON u = xu.node JOIN x0 AS xp ON p = xp.node AND xp.k = xu.k JOIN x0 AS xn ON n = xn.node AND xn.k = xu.k GROUP BY u)
    SELECT round(avg(-ln(1 / (1 + exp(-d)) + 1e-10)), 6) AS loss FROM m""")
def bpr_loss(s, sf):
    e, users, items = _sampled(s, sf)
    p = sampling.sample_positive(users, e, 42, 0, 0)
    n = sampling.sample_negatives(users, items, e, 1, 42, 0, 0)
    batch = p.join(n, "client_id").select(F.concat(F.lit("u:"), "client_id").alias("u"), F.concat(F.lit("i:"), "pos").alias("p"), F.concat(F.lit("i:"), "neg").alias("n"))
    nodes = graph.symmetric_adjacency(e).select(F.col("src").alias("node")).distinct()
    return r6(lightgcn.bpr_loss(lightgcn.triples(batch, sampling.init_embeddings(nodes, Params().dim))).select("loss"), "loss")


@query()
def lightgcn_train(s, sf):
    """A whole training by the defaults: the loss of each step, each embedding's norm and first component."""
    p = Params()
    t = lightgcn.lightgcn_train(graph.interactions(a.weighted(s, sf)), dim=p.dim, layers=p.layers, epochs=p.epochs, batch_users=p.batch_users, neg_per_pos=p.neg_per_pos, lr=p.lr, seed=p.seed)
    one = lambda d, c, kind: d.select(F.lit(kind).alias("kind"), F.col(c).alias("id"), F.round(vectors.vector_norm(F.col("embedding")), 4).alias("value"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))
    losses = t.losses.select(F.lit("loss").alias("kind"), F.col("step").cast("string").alias("id"), F.round("loss", 4).alias("value"), F.lit(None).cast("double").alias("first"))
    return losses.unionAll(one(t.users, "client_id", "user")).unionAll(one(t.items, "item_id", "item"))


# --- Ranking


LOGGED = f"WITH {SPLIT}, {UI}, logged AS (SELECT client_id, item_id, score FROM scored SEMI JOIN ev USING (client_id, item_id))"


@query(f"{LOGGED} SELECT client_id, item_id, round(score, 6) AS score FROM logged")
def score_user_item(s, sf):
    """Scores of the pairs that the log has."""
    return r6(_logged(s, sf), "score")


@query(f"{LOGGED} SELECT client_id, item_id, round(score, 6) AS score FROM logged ANTI JOIN train USING (client_id, item_id)")
def mask_seen(s, sf):
    """Of these the pairs that are only in the test rows, or in rows left out of training."""
    return r6(split.mask_seen(_logged(s, sf), split.train_minus_last(a.events(s, sf))), "score")


def _logged(s: SparkSession, sf: str) -> DataFrame:
    return ranking.score_user_item(a.user_vectors(s, sf), a.item_vectors(s, sf), a.events(s, sf).select("client_id", "item_id").distinct())


def _top50(s: SparkSession, sf: str) -> DataFrame:
    return ranking.topk_items_per_user(a.user_vectors(s, sf), a.item_vectors(s, sf), split.train_minus_last(a.events(s, sf)), 50)


@query(f"WITH {RANKED} SELECT client_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM top WHERE rank <= 50")
def topk_items_per_user(s, sf):
    return r6(_top50(s, sf), "score")


@query(f"WITH {RANKED} SELECT t.client_id, t.item_id, CAST(rank AS INTEGER) AS rank FROM test AS t LEFT JOIN (SELECT * FROM top WHERE rank <= 50) USING (client_id, item_id)")
def target_rank(s, sf):
    return ranking.target_rank(_top50(s, sf), split.leave_last_out(a.events(s, sf)))


@query(f"WITH {RANKED} SELECT t.client_id, t.item_id, rank FROM test AS t LEFT JOIN top USING (client_id, item_id)")
def target_ranks(s, sf):
    """Exact places beyond any list's end."""
    e = a.events(s, sf)
    return ranking.target_ranks(a.user_vectors(s, sf), a.item_vectors(s, sf), split.leave_last_out(e), split.train_minus_last(e))


@query(f"WITH {RANKED} SELECT client_id, item_id, round(1 / log2(rank + 1), 6) AS gain FROM top WHERE rank <= 50")
def ndcg_gain(s, sf):
    return _top50(s, sf).select("client_id", "item_id", F.round(1.0 / F.log2(F.col("rank") + 1.0), 6).alias("gain"))


@query(f"WITH {RANKED} SELECT client_id, item_id, round(1.0::DOUBLE / rank, 6) AS reciprocal FROM top WHERE rank <= 50")
def reciprocal_rank(s, sf):
    return _top50(s, sf).select("client_id", "item_id", F.round(1.0 / F.col("rank"), 6).alias("reciprocal"))


def _metrics(s: SparkSession, sf: str) -> DataFrame:
    return ranking.evaluate(a.user_vectors(s, sf), a.item_vectors(s, sf), a.events(s, sf))


@query(METRICS)
def evaluate(s, sf):
    return r6(_metrics(s, sf), "recall", "ndcg", "mrr")


@query(METRICS.replace("SEMI JOIN uv ON t.client_id = uv.client_id SEMI JOIN iv ON t.item_id = iv.item_id", ""))
def ranking_metrics(s, sf):
    ranks = ranking.target_rank(_top50(s, sf), split.leave_last_out(a.events(s, sf)))
    return r6(ranking.ranking_metrics(ranks), "recall", "ndcg", "mrr")


@query()
def grid_search(s, sf):
    """The whole grid of twelve configurations, trained together by the defaults, and their metrics."""
    p = Params()
    return r6(trained_grid(a.events(s, sf), p, (32, 64, 128), (2, 3), (1, 2), p.k), "recall", "ndcg", "mrr")


def _grid(s: SparkSession, sf: str) -> DataFrame:
    """Results to choose from that SQL can give too: embeddings of two sizes cut from given vectors, evaluated."""
    u, i = written(a.user_vectors(s, sf), "grid-users"), written(a.item_vectors(s, sf), "grid-items")
    cut = lambda d, dim: d.withColumn("embedding", F.slice("embedding", 1, dim))
    return ranking.grid_search(lambda dim, layers, neg: (cut(u, dim), cut(i, dim)), a.events(s, sf), dims=(16, 64), layers=(2,), negatives=(1,))


GRID = [(0, 16, 2, 1), (1, 64, 2, 1)]
GRID_SQL = " UNION ALL ".join(f"(SELECT {i} AS grid_order, {d} AS dim, {n} AS layers, {g} AS neg, recall, ndcg, mrr FROM ({METRICS.replace('list_transform(embedding,', f'list_transform(embedding[1:{d}],').replace('[10, 20, 50]', '[10]')}))" for i, d, n, g in GRID)


@query(f"SELECT * FROM ({GRID_SQL}) ORDER BY recall + ndcg DESC, grid_order LIMIT 1")
def grid_best(s, sf):
    return r6(ranking.grid_best(written(_grid(s, sf), "grid")), "recall", "ndcg", "mrr")


@query(f"WITH g AS ({GRID_SQL}) SELECT 10 AS k, (SELECT grid_order FROM g ORDER BY recall + ndcg DESC, grid_order LIMIT 1) AS best, * FROM g")
def write_grid(s, sf):
    """The stored document, a row a configuration with the best one's number."""
    results, path = written(_grid(s, sf), "grid"), work_dir(s, "grid-json")
    writers.write_grid(r6(results, "recall", "ndcg", "mrr"), ranking.grid_best(results), path, 10)
    d = s.read.json(path).select(F.col("K").cast("int").alias("k"), F.col("best.grid_order").cast("int").alias("best"), F.explode("all").alias("r")).select("k", "best", "r.*")
    return d.withColumns({c: F.col(c).cast("int") for c in ("grid_order", "dim", "layers", "neg")})


@query(FUSED_TOP)
def write_recs(s, sf):
    path = work_dir(s, "recs")
    writers.write_recs(vectors.round_scores(_all_fused(s, sf), "score", "sim_text", "sim_graph"), path)
    return s.read.schema("query_item_id long, rank int, item_id long, score double, sim_text double, sim_graph double").csv(path, header=True)


# --- Stamps


@query(f"""WITH {ED} SELECT client_id, item_id, strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%S') AS last_iso FROM wt GROUP BY ALL""")
def iso_timestamp(s, sf):
    return a.edges(s, sf).select("client_id", "item_id", F.date_format("last_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("last_iso"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS run_id FROM orders")
def run_id(s, sf):
    return a.table(s, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", writers.RUN_ID).alias("run_id"))


SQL |= {name: sql() for name, sql in LATER.items()}
