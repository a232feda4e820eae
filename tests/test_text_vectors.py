"""Text masks, vectors, fusion, upserts on hand-made rows and stored goldens."""

import html
import os

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from graphrec.operators import inverted, text, vectors
from graphrec.sources import collections, readers

SF = "/root/testdata/sf0.01"
CASES = [
    ("Ara: 0532 123 45 67", "Ara PHONE 67"), ("+90 (212) 555 44 33", "PHONE 33"), ("2024 yılında 12 kişi, 123 ilan", "NUM yılında 12 kişi NUM ilan"), ("12345 adet", "PHONE adet"), ("Bkz. https://ex.com/a?b=1.", "Bkz URL"),
    ("ALI.V@Ex.com.tr yaz", "EMAIL yaz"), ("a b  c\t\nd", "a b c d"), ("%50 prim & SGK/yemek", "%50 prim & SGK/yemek"), ("x123 1234x", "x PHONE x"), ("Satış – Uzmanı (İstanbul)!", "Satış Uzmanı İstanbul"), (None, ""),
]


def test_cleaning_cases(spark):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").select("i", text.clean_text(F.col("t"), html=False).alias("c"))
    d = d.withColumn("wc", text.word_count(F.col("c")))
    rows = d.orderBy("i").collect()
    assert [r["c"] for r in rows] == [c[1] for c in CASES]
    assert rows[-1]["wc"] == 0 and rows[0]["wc"] == 3


def test_lower_and_stopwords(spark):
    d = spark.createDataFrame([("Satış – Uzmanı (İstanbul)! ve bir İş",)], "t string")
    assert d.select(text.clean_text(F.col("t"), html=False, lower=True, stopwords=True)).first()[0] == "satış uzmanı i̇stanbul i̇ş"


def test_html(spark):
    d = spark.createDataFrame([("<p>a</p><script>x</script><b>b &amp; c</b><!-- d -->",), ("",), ("plain & simple",)], "t string")
    assert [r[0] for r in d.select(text.strip_html(F.col("t"))).collect()] == ["a b & c", "", "plain & simple"]
    plain = [" \x1c\u2003\n a  b \x85\u3000\x1f", "a\u200b", "\t" * 30_000 + "a" + " " * 30_000 + "b" + " " * 30_000, " \n ", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i int, t string").orderBy("i")
    assert [r[0] for r in d.select(text.strip_html(F.col("t"))).collect()] == [(t or "").strip() for t in plain]


def plain_visible(t):
    """Visible text of well-formed pages by patterns, not by a parser."""
    t = regex.sub(r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "\0", t)
    parts = [html.unescape(x).strip() for x in regex.split(r"(?s)<[/!]?[a-zA-Z][^>]*>|\0", t)]
    return " ".join(x for x in parts if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_html_of_whole_tables(spark):
    d = spark.read.parquet(f"{SF}/pages.parquet")
    rows = d.select("html", text.strip_html(F.col("html")).alias("t")).collect()
    assert len(rows) >= 200 and all(r["t"] == plain_visible(r["html"]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_cleaning_of_whole_tables(spark):
    """Every step on every document by another regular-expression library."""
    steps = [(regex.compile(p.split(")", 1)[1], regex.I if "i" in p.split(")", 1)[0] else 0), to) for p, to in ((text.URL, "<URL>"), (text.EMAIL, "<EMAIL>"), (text.PHONE, "<PHONE>"), (text.NUMBER, "<NUM>"))]

    def clean(t):
        t = (plain_visible(t) if "<" in t or "&" in t else t.strip()).replace("\u00a0", " ")
        for pattern, to in steps:
            t = pattern.sub(to, t)
        t = " ".join(regex.sub(text.PUNCTUATION, " ", t).split()).lower()
        return " ".join(w for w in t.split(" ") if w and w not in text.STOPWORDS)

    d = spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL")
    rows = d.select("text", text.clean_text(F.col("text"), lower=True, stopwords=True).alias("t")).collect()
    assert len(rows) >= 900
    for r in rows:
        assert r["t"] == clean(r["text"])


def test_build_text(spark):
    d = spark.createDataFrame([("A", "B"), ("A", ""), (None, "B"), (None, None)], "t string, d string")
    assert [r[0] for r in d.select(text.build_text(F.col("t"), F.col("d"))).collect()] == ["A . B", "A", "B", ""]


def test_encoder_gives_unit_vectors(spark):
    d = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(50)], "item_id long, text_clean string")
    out = text.encode_text(d, lambda: text.hashed_ngrams(16), batch=7)
    norms = [r[0] for r in out.select(vectors.vector_norm(F.col("embedding"))).collect()]
    assert len(norms) == 50 and np.allclose(norms, 1, atol=1e-5)


def test_encoding_keeps_ids_and_texts_together(spark):
    big = 2**53 + 1
    rows = [(big, "aa"), (None, "b"), (big + 2, "cccc"), (7, None)]
    lengths = lambda: lambda texts: np.array([[len(t), 1] for t in texts])
    d = spark.createDataFrame(rows, "item_id long, text_clean string").coalesce(1)
    got = text.encode_text(d, lengths, batch=2, normalize=False).collect()
    assert {r["item_id"]: r["embedding"][0] for r in got} == {big: 2, None: 1, big + 2: 4, 7: 0} and len(got) == 4


def test_encoder_counts_the_whole_text():
    import zlib

    def want(t, dim=16, n=3):
        row, raw = np.zeros(dim), t.encode()
        for i in range(max(1, len(raw) - n + 1)):
            h = zlib.crc32(raw[i : i + n])
            row[h % dim] += 1 if h >> 16 & 1 else -1
        return row

    opening = "Ortak giriş. " * 300
    texts = ["", "a", "ab", "abc", "ğü", opening + "one end", opening + "another end", "x" * 7000 + "çş" * 20]
    assert np.array_equal(text.hashed_ngrams(16)(texts), [want(t) for t in texts])
    for size in (1, 100):
        assert np.array_equal(text.hashed_ngrams(16, slice_bytes=size)(texts), [want(t) for t in texts])


def vecs(spark, rows):
    return spark.createDataFrame(rows, "item_id long, embedding array<float>")


def test_topk_matches_numpy_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(120, 8)).astype(np.float32)
    a[7] = a[9]
    d = vecs(spark, [(i, a[i].tolist()) for i in range(120)])
    for metric in ("cosine", "ip", "l2"):
        x = a.astype(float)
        if metric == "cosine":
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = -((x[:, None] - x[None]) ** 2).sum(2) if metric == "l2" else x @ x.T
        want = {i: list(np.lexsort((np.arange(120), -np.round(s[i], 9)))[:5]) for i in range(120)}
        for n in (1, 6):
            got = vectors.topm_candidates(d.repartition(n), d.repartition(n), 5, metric).orderBy("query_item_id", "rank").collect()
            assert {i: [r["item_id"] for r in got if r["query_item_id"] == i] for i in range(120)} == want
    few = vectors.block_topk(d.select(F.col("item_id").alias("query_id"), F.array("embedding").alias("vecs")), d.select("item_id", F.array("embedding").alias("vecs")), 3, query_block=10, item_block=16)
    assert few.count() == 360


def test_fusion_leaves_itself_out_and_dedupes(spark):
    t = vecs(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (9, [1.0, 0.0])])
    g = vecs(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (8, [1.0, 0.0])])
    got = vectors.fusion_recommend(t, g, vectors.id_intersection(t, g), k=10)
    assert got.count() == 6 and got.filter("item_id = query_item_id").count() == 0
    assert [r[0] for r in vectors.unknown_queries(t, t, g).collect()] == [9]
    assert dict(map(tuple, vectors.resolve_query_ids(t, t, g).collect()))[9] == 1


def test_two_stage_fills_the_missing_side(spark):
    row = "query_item_id long, rank int, item_id long, similarity double"
    t, g = spark.createDataFrame([(1, 1, 2, 0.5)], row), spark.createDataFrame([(1, 1, 2, 0.7), (1, 2, 3, 0.9), (1, 3, 1, 1.0)], row)
    fused = vectors.fuse_candidates(t, g)
    assert fused.filter("item_id = 3").first()["sim_text"] == -1.0
    top = vectors.two_stage_topk(fused, 5).orderBy("rank").collect()
    assert [r["item_id"] for r in top] == [2, 3]


def test_fused_scores_of_a_stored_run(spark):
    d = spark.createDataFrame([(0.5, 0.25)], "g double, t double")
    assert d.select(vectors.fuse_scores(F.col("g"), F.col("t"), 0.5)).first()[0] == 0.375


def test_pack_and_unpack(spark):
    d = spark.createDataFrame([(5, 0.5, 1.5, 2.5)], "item_id long, `0` float, `1` float, `2` float")
    packed = readers.pack_vectors(d.select("2", "0", "item_id", "1"), "item_id")
    assert packed.first()["embedding"] == [0.5, 1.5, 2.5]
    assert readers.unpack_vectors(packed, 3).columns == ["item_id", "0", "1", "2"]


def test_upsert_last_write_wins_and_reset(spark):
    row = "collection string, item_id long, embedding array<float>, source string, batch long"
    first = collections.vector_upsert(None, spark.createDataFrame([("t", 1, [1.0], "a", 0), ("t", 2, [1.0], "a", 0), ("t", 1, [2.0], "b", 1)], row))
    assert {(r["item_id"], r["source"]) for r in first.collect()} == {(1, "b"), (2, "a")}
    new = spark.createDataFrame([("t", 2, [9.0], "c", 0)], row)
    assert {(r["item_id"], r["source"]) for r in collections.vector_upsert(first, new).collect()} == {(1, "b"), (2, "c")}
    assert collections.vector_upsert(first, new, reset=True).count() == 1


def test_stored_collections(spark, tmp_path):
    import os

    path, row = f"{tmp_path}/text", "collection string, item_id long, embedding array<float>, source string, batch long"
    put = lambda rows, **o: {(r["item_id"], r["embedding"][0], r["source"]) for r in collections.upsert_collection(path, spark.createDataFrame(rows, row), **o).collect()}
    assert collections.read_collection(spark, path) is None
    assert put([("t", 1, [1.0], "a", 0), ("t", 2, [1.0], "a", 0)]) == {(1, 1.0, "a"), (2, 1.0, "a")}
    assert put([("t", 2, [9.0], "b", 0), ("t", 3, [3.0], "b", 0)]) == {(1, 1.0, "a"), (2, 9.0, "b"), (3, 3.0, "b")}
    os.makedirs(f"{path}/vectors/version=00000003/_temporary")  # a job that died half way, under its lock
    open(f"{path}/lock", "w").close()
    assert collections.read_collection(spark, path).count() == 3
    with pytest.raises(RuntimeError, match="another writer"):
        put([("t", 1, [4.0], "c", 0)])
    assert put([("t", 1, [4.0], "c", 0)], break_lock=True) == {(1, 4.0, "c"), (2, 9.0, "b"), (3, 3.0, "b")}
    assert not os.path.exists(f"{path}/lock") and "version=00000003" not in os.listdir(f"{path}/vectors")
    assert put([("t", 7, [7.0], "d", 0)], reset=True) == {(7, 7.0, "d")}
    assert sorted(os.listdir(f"{path}/records")) == ["version=00000004", "version=00000005"]
    assert put([], reset=False) == {(7, 7.0, "d")} and put([], reset=True) == set() and put([("t", 1, [1.0], "a", 0)]) == {(1, 1.0, "a")}


def test_an_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    import os

    path, row = f"{tmp_path}/text", "collection string, item_id long, embedding array<float>, source string, batch long"
    frame = lambda ids, x: spark.createDataFrame([("t", i, [x], "s", 0) for i in ids], row)
    collections.upsert_collection(path, frame(range(500), 1.0), buckets=16)
    collections.upsert_collection(path, frame([3], 2.0))
    assert [len([b for b in os.listdir(f"{path}/vectors/version={v:08d}") if b.startswith("bucket=")]) for v in (1, 2)] == [16, 1]
    collections.upsert_collection(path, frame([3], 3.0))
    assert len([b for b in os.listdir(f"{path}/vectors/version=00000001") if b.startswith("bucket=")]) == 15  # that bucket is named no more
    got = {r["item_id"]: r["embedding"][0] for r in collections.read_collection(spark, path).collect()}
    assert got == {i: 3.0 if i == 3 else 1.0 for i in range(500)} and collections.stored(spark, path).buckets == 16


def test_a_collection_keeps_its_metric(spark, tmp_path):
    path, row = f"{tmp_path}/text", "collection string, item_id long, embedding array<float>, source string, batch long"
    d = spark.createDataFrame([("t", 1, [1.0], "a", 0)], row)
    collections.upsert_collection(path, d, metric="l2")
    assert collections.collection_metric(spark, path) == "l2"
    collections.upsert_collection(path, d)
    with pytest.raises(ValueError, match="l2"):
        collections.upsert_collection(path, d, metric="ip")
    collections.upsert_collection(path, d, metric="ip", reset=True)
    assert collections.collection_metric(spark, path) == "ip"
    with pytest.raises(ValueError, match="none of"):
        collections.upsert_collection(path, d, metric="angle")


def test_no_common_items(spark):
    t = vecs(spark, [(1, [1.0])])
    with pytest.raises(ValueError, match="common"):
        vectors.require_rows(vectors.align_vectors(t, vecs(spark, [(2, [1.0])])), "no common items")


def test_latest_run(spark):
    d = spark.createDataFrame([("20240101T000000Z", "a", 1), ("20240301T000000Z", "b", 2), ("20240201T000000Z", "a", 3)], "run_id string, source string, v int")
    assert readers.latest_run(d).first()["v"] == 2
    assert [r["v"] for r in readers.latest_run(d, ("x", "a")).collect()] == [3]


def clustered(n, dim=8, groups=20, seed=3):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dim)) * 3
    return centers[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * r.lognormal(-0.5, 0.5, size=(n, 1))


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_inverted_lists_find_most_of_the_nearest(spark, metric):
    x = clustered(900)
    d = vecs(spark, [(i, row.astype(np.float32).tolist()) for i, row in enumerate(x)] + [(None, [1.0] * 8), (5000, None), (5001, [float("nan")] * 8)]).repartition(3)
    q = d.filter("item_id < 120")
    exact = vectors.topm_candidates(q, d, 10, metric)
    index = inverted.build_index(d, metric, list_block=40)
    assert index.items.count() == 900 and len(index.centers) == 30 and sum(map(len, index.places)) > 30
    probes = inverted.probes_for(index, q, d, 10, 0.95)
    found = inverted.search(index, q, 10, probes)
    assert probes < 30 and inverted.recall_of(found, exact) >= 0.9
    whole = inverted.search(index, q, 10, 30)  # all lists: the exact answer
    rows = lambda f: sorted((r["query_item_id"], r["rank"], r["item_id"], round(r["similarity"], 9)) for r in f.collect())
    assert rows(whole) == rows(exact) and inverted.recall_of(whole, exact) == 1.0
    scores = {(r["query_item_id"], r["item_id"]): r["similarity"] for r in exact.collect()}
    assert all(abs(r["similarity"] - scores[r["query_item_id"], r["item_id"]]) < 1e-9 for r in found.collect() if (r["query_item_id"], r["item_id"]) in scores)
    index.drop()


def test_approximate_candidates_as_an_option(spark):
    d = vecs(spark, [(i, row.astype(np.float32).tolist()) for i, row in enumerate(clustered(400))])
    found, exact = vectors.topm_candidates(d, d, 5, recall=0.95), vectors.topm_candidates(d, d, 5)
    assert inverted.recall_of(found, exact) >= 0.9 and found.count() == 2000
    same = vecs(spark, [(i, [1.0, 2.0]) for i in range(50)])  # one list holds all
    assert vectors.topm_candidates(same, same, 3, recall=1.0).count() == 150
    assert vectors.topm_candidates(d, d.limit(0), 3, recall=0.9).count() == 0 and vectors.topm_candidates(d.limit(0), d, 3, recall=0.9).count() == 0


def test_fused_lists_are_sent_once(spark):
    """One exchange for pairs to meet and be ranked by query: a join on pairs sends both lists, and ranking sends them again."""
    rows = lambda shift: spark.createDataFrame([(q, (q * 7 + i + shift) % 50, i / 10) for q in range(20) for i in range(8)], "query_item_id long, item_id long, similarity double")
    t, g = rows(0), rows(4)
    fused = vectors.fuse_candidates(t, g)
    want = {(r["query_item_id"], r["item_id"]): [r["similarity"], -1.0] for r in t.collect()}
    for r in g.collect():
        want.setdefault((r["query_item_id"], r["item_id"]), [-1.0, -1.0])[1] = r["similarity"]
    assert {(r["query_item_id"], r["item_id"]): [r["sim_text"], r["sim_graph"]] for r in fused.collect()} == want
    plan = vectors.two_stage_topk(fused)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
