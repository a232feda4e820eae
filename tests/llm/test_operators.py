"""Each operator on odd rows, against brute force, a round trip, or held-out accuracy."""

import os
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphrec.llm import boosting, dom, html_main, jaccard, langid, line_dedup, mixing, packing, repetition, sharding, topk, warc
from graphrec.llm.queries import vocabulary_path
from graphrec.llm.shared import numbered, work_dir
from graphrec.operators import components

#: Column names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars int, size string, bucket string, shard string, digest string, site string, taken string, rank string, score string, node string, part string"
rng = random.Random(7)
WORDS = {k: ["".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(300)] for k, s in {"xa": ["the", "ing", "er", "th"], "xb": ["ung", "sch", "ä", "ie"], "xc": ["eau", "é", "oi", "que"]}.items()}


def prose(lang, n, r=rng):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@cache
def odd_rows():
    """Nulls in every column, empty and blank texts, one long text, repeated rows, copies and near copies."""
    rows = []
    for i in range(60):
        lang = ("xa", "xb", "xc")[i % 3]
        rows.append((i, f"common line\n{prose(lang, 30 + i)}\nnot common {i}", lang if i % 4 else None, f"s{i % 4}", 5))
    base = prose("xa", 120)
    rows += [(100 + i, base, "xa", "s0", 5) for i in range(6)]
    for i in range(6):
        w = base.split()
        w[i * 11] = f"edit{i}"
        rows.append((110 + i, " ".join(w), "xa", "s1", 5))
    rows += [(200, None, None, None, None), (201, "", "xa", None, 0), (202, " \t\n ", "xb", "s2", 3), (203, "... 123 !!", "xb", "s2", 3), (204, "one two", "xa", "s9", 7), (205, "one two", "xa", "s9", 7), (None, prose("xb", 40), "xb", "s2", 1), (None, None, None, None, None), (206, "word " * 30_000, "xa", "s3", 1), (207, "end <|endoftext|> of text", "xa", "s3", 1), (300, "twice " + base, "xa", "s0", 1), (300, "twice " + base, "xa", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ("x",) * 10 for r in odd_rows()], DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().split()


# --- 1


def test_archives_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://www.b.org/x?q=1", big), (2, "http://a.b.org/", big), (5, None, big), (5, None, big), (3, "http://www.b.org/x?q=1", "short"), (4, "http://www.b.org/x?q=1", "short"), (None, "http://z.org/", big), (6, "ht tp://[bad", None), (7, "", ""), (2**60 + 1, "https://b.org:8443/p", "x" * 5000)]
    pages = spark.createDataFrame([r + (0, "y") for r in rows], "page_id long, url string, html string, digest int, surt string").repartition(3)
    folder = work_dir(spark, "test-warc")
    captures = warc.write_archives(pages, folder)
    shards = warc.write_index(captures, f"{folder}/index", block_lines=2)
    found = warc.lookup(pages, shards)
    got = sorted(map(tuple, warc.read_records(found, with_payload=True).collect()), key=repr)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for page, size, digest, kind, refers, payload in got:
        by[page].append((size, kind, refers))
        if kind == "response":
            assert len(payload) == size and zlib.crc32(payload) in {zlib.crc32((r[2] or "").encode()) for r in rows}
    assert by[1] == [(1400, "revisit", 5)] and by[5] == [(1400, "response", None)] * 2 and by[None] == [(1400, "revisit", 5)]
    assert by[3] == by[4] == [(5, "response", None)] and by[6] == by[7] == [(0, "response", None)] and by[2**60 + 1] == [(5000, "response", None)]
    one = warc.lookup(spark.createDataFrame([("http://www.b.org/x?q=1#part",), ("http://nowhere.org/",)], "url string"), shards)
    assert sorted(r["page_id"] for r in one.collect()) == [1, 3, 4]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_keys_reverse_hosts():
    assert warc.surt("https://Blog.Example.com:8443/A?b=1#c") == "com,example,blog:8443)/A?b=1"
    assert warc.surt(None) == "" and warc.surt("http://[x") == "!http://[x"


def test_a_broken_record_is_told():
    raw = warc.record(1, "http://a.b/", b"payload", "d", "response", None)
    assert warc.parse(raw)[1] == b"payload"
    with pytest.raises(ValueError, match="cut short"):
        warc.parse(raw[:-8])


# --- 2


def brute_targets(sizes, weights=(1, 2, 3)):
    left, out, total = dict(enumerate(sizes)), {}, sum(sizes)
    while left:
        share = {i: weights[i % 3] * (total - sum(out.values())) / sum(weights[j % 3] for j in left) for i in left}
        over = [i for i in left if share[i] > 3 * sizes[i]]
        if not over:
            return {**out, **share}
        for i in over:
            out[i] = 3 * sizes[i]
            del left[i]
    return out


def test_mix(docs, empty):
    got = mixing.mix(docs, block_words=4, rows_per_bucket=16).collect()
    rows = odd_rows()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = brute_targets([sizes[s] for s in names])
    source = {}
    for r in rows:
        source[r[0], len(words(r[1]))] = r[3]
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[names.index(s)])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[names.index(s)]) <= 4 * len(names)
    again = mixing.mix(docs.repartition(5), block_words=4, rows_per_bucket=7).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(empty).count() == 0


def test_seats_are_sainte_lague(spark):
    sizes = [100, 5, 1000, 37, 0, 412]
    t = mixing.targets(spark.createDataFrame([(False, f"s{i}", n) for i, n in enumerate(sizes)], "src_null boolean, src_key string, source_size long"))
    rows = mixing.quotas(t, 3, 5).orderBy("place").collect()
    seats, votes = [0] * 6, [r["target"] for r in rows]
    house = int(sum(votes) / 3 + 0.5)
    for _ in range(house):
        best = max((i for i in range(6) if seats[i] < sizes[i] * 3 // 3), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    assert [r["seats"][-1] for r in rows] == seats
    assert all(a <= b for r in rows for a, b in zip(r["seats"], r["seats"][1:]))


def test_mix_of_null_ids_spreads_and_repeats(spark):
    rows = [(None, f"nr{i} " + "wort " * 4, "xa", "s0") for i in range(400)] + [(7, f"gleich{i} " + "wort " * 4, "xa", "s0") for i in range(40)] + [(i, "wort " * 9, "xa", "s1") for i in range(100, 160)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    runs = [sorted(map(tuple, mixing.mixed_documents(d.repartition(n), block_words=4, rows_per_bucket=b).collect()), key=repr) for n, b in ((1, 50), (7, 13))]
    assert runs[0] == runs[1]
    assert any(len(words(r[1])) and r[0] is None for r in runs[0])


def test_mixed_texts_hold_the_words_taken(docs):
    got = mixing.mix(docs, block_words=4, rows_per_bucket=16).groupBy("doc_id").agg(F.sum("taken")).collect()
    made = defaultdict(int)
    out = mixing.mixed_documents(docs, block_words=4, rows_per_bucket=16)
    assert out.columns == docs.columns
    for r in out.collect():
        made[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {r[0]: r[1] for r in got if r[1]} == dict(made)


# --- 3


def test_language_of_held_out_and_mixed_texts(spark, docs, empty):
    rows = [(i, prose(("xa", "xb", "xc")[i % 3], 40), ("xa", "xb", "xc")[i % 3]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    model = langid.learn(d)
    mixed = spark.createDataFrame([(1, prose("xa", 300) + " " + prose("xb", 100)), (2, prose("xc", 50)), (3, "12 !!"), (4, None), (5, "")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in langid.identify(mixed, model).collect()}
    assert r[1]["lang_pred"] == "xa" and 0.65 < r[1]["score"] < 0.85 and {x.split(":")[0] for x in r[1]["languages"].split()} == {"xa", "xb"}
    assert r[2]["languages"] == "xc:1.000" and [r[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3
    out = langid.language_id(docs).collect()
    assert len(out) == len(odd_rows()) and all(0 <= x["score"] <= 1 for x in out)
    assert langid.language_id(empty).count() == 0
    unlabelled = langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [x[0] for x in unlabelled] == ["und"]
    kept = langid.confident(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (200, 201, 202, 203)").count() == 0 and kept.filter("doc_id < 120").count() >= 70


def plain_em(like, rounds, share):
    for _ in range(rounds):
        got = [0.0] * len(share)
        for w in like:
            p = [np.exp(x - max(w)) * s for x, s in zip(w, share)]
            got = [g + x / sum(p) for g, x in zip(got, p)]
        share = [g / len(like) for g in got]
    return share, sum(np.log(sum(np.exp(x - max(w)) * s for x, s in zip(w, share))) for w in like)


def plain_mixture(like, penalty=0.5):
    """One text's proportions, by loops over words and over sets."""
    k = len(like[0])
    share, _ = plain_em(like, langid.ROUNDS, [1 / k] * k)
    order = sorted(range(k), key=lambda i: -share[i])
    found = []
    for size in range(1, k + 1):
        if size > 1 and share[order[size - 1]] * len(like) < 0.5:
            break
        start = [max(share[i], 1e-6) if i in order[:size] else 0.0 for i in range(k)]
        s, fit = plain_em(like, langid.SET_ROUNDS if size > 1 else 0, [x / sum(start) for x in start])
        found.append((fit - penalty * size * np.log(len(like) + 1.0), -size, s))
    return max(found)[2]


def test_mixtures_against_plain_em():
    g = np.random.default_rng(5)
    texts = []
    for n, langs in ((1, 1), (3, 2), (40, 1), (90, 3), (300, 6), (200, 7)):
        like = g.normal(-6, 1.5, size=(n, 7))
        like[np.arange(n), g.integers(0, langs, n)] += 6
        texts.append(like.astype(np.float32))
    got = langid.mixtures(np.concatenate(texts), np.array([len(t) for t in texts]))
    for t, m in zip(texts, got):
        assert np.allclose(m, plain_mixture(t.astype(float)), atol=2e-3)
    assert [(m > 0).sum() for m in got[-2:]] == [6, 7]
    assert [(m > 0).sum() for m in langid.mixtures(np.concatenate(texts), np.array([len(t) for t in texts]), max_languages=2)][-2:] == [2, 2]


# --- 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="ad">Buy this now</div><article><h1>%s</h1><p><b>%s &amp; more<br><p>%s</p></article><div class="comments"><p>nice one</p></div><footer>&copy; Somebody</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h/{i}", PAGE % (prose("xa", 5), prose("xa", 60), prose("xa", 40))) for i in range(60)]
    odd = [(100, None, None), (101, "u", ""), (None, "u", "<<<p>broken <b attr='x>"), (102, "u", "just words"), (103, "u", "<article>" + "<div>" * 2000 + "deep" + "</div>" * 2000), (0, rows[0][1], rows[0][2])]
    d = spark.createDataFrame([r + ("t", 1) for r in rows + odd], "page_id long, url string, html string, text string, n_chars int")
    got = html_main.main_text(d).collect()
    assert len(got) == len(rows + odd) and all(len(r["text"]) == r["n_chars"] for r in got)
    hits = 0
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 60:
            page = rows[r["page_id"]][2]
            h, a, b = page.split("<h1>")[1].split("</h1>")[0], page.split("<p><b>")[1].split(" &amp;")[0], page.split("<br><p>")[1].split("</p>")[0]
            hits += r["text"] == f"{h}\n\n{a} & more\n\n{b}"
    assert hits == 61
    assert {r["page_id"]: r["text"] for r in got}[100] == "" and html_main.main_text(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source, want",
    [
        ('<p>a</p><svg class="i" /><p>b</p><svg><title>t</title></svg><p>c</p>', ["a", "b", "c"]),
        ("<p>a</p><math/><p>b</p>", ["a", "b"]),
        ("<p>a <object data=x><b>b</b></object> c</p><noscript><p>d</p></noscript>", ["a b c", "d"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", ["let x=1 be"]),
        ("<p>a</p><video src=x><p>b</p>", ["a", "b"]),
        ("<svg><p>a</p><svg><text>t</text></svg><p>b</p>", ["a", "b"]),
        ("<p>a</p><svg><svg>t</svg>t</svg><p>b</p>", ["a", "b"]),
        ('<svg><p>a</p><script>"</svg>"</script><!-- </svg> --><p>b</p>', ["a", "b"]),
        ("<p>a</p><svg href=/x/>t</svg><canvas>t</canvas><p>b</p><script>c", ["a", "b"]),
        ("<title>t</title><p>a</p><style>t</style><textarea>t</textarea><iframe>t</iframe>", ["a"]),
    ],
)
def test_hidden_elements_take_no_other_text(source, want):
    assert [t for _, t, _ in dom.Page(source).blocks] == want


def test_siblings_and_depth_have_no_limit():
    page = dom.Page("<div>" + "".join(f"<p>{'a' * (k + 1)}</p>" for k in range(120)) + "</div>")
    rows = [f[-12:] for v, f in enumerate(page.features()) if page.tag[v] == "p"]
    assert [round(r[1] * 120) for r in rows] == list(range(120))
    total = sum(range(1, 121))
    assert [round(r[3] * total) if r[3] >= 0 else -1 for r in rows] == [-1, *range(1, 120)]
    deep = dom.Page("<section>" + "<div>" * 700 + "a" + "</div>" * 700 + "<p>b</p></section><p>c</p>")
    at = {t: deep.tag[deep.parent[v]] for v, t, _ in deep.blocks}
    assert (at["b"], at["c"], len(deep.tag)) == ("section", "#root", 704)


def test_decoding_never_contradicts():
    """Against every labelling of a small tree that obeys the rules: below dropped all is dropped, below content all is content but for dropped subtrees."""
    page = dom.Page("<body><div><p>one</p><p>two</p></div><div><p>three</p><div>four</div></div></body>")
    n, kids = len(page.tag), defaultdict(list)
    for v in range(1, n):
        kids[page.parent[v]].append(v)
    text = {v for v, _, _ in page.blocks}
    holds = lambda v: v in text or any(map(holds, kids[v]))

    def labellings(v, above):
        for mine in {"wrapper": ("content", "dropped", "wrapper"), "content": ("content", "dropped"), "dropped": ("dropped",)}[above]:
            if mine == "wrapper" and not kids[v] or page.tag[v] == "body" and mine != "wrapper":
                continue
            below = [{}]
            for c in kids[v]:
                below = [a | b for a in below for b in labellings(c, mine)]
            yield from ({v: mine} | b for b in below)

    r = random.Random(1)
    for _ in range(200):
        odds = [r.uniform(-9, 9) for _ in page.tag]
        own = [max(-6.0, min(6.0, o)) if holds(v) else 0.0 for v, o in enumerate(odds)]

        def score(label):
            total = 0.0
            for v, x in label.items():
                total += {"content": own[v], "dropped": -own[v], "wrapper": -0.5 * (page.tag[v] != "body")}[x]  # noqa: B023
                total -= 6.0 * (x == "dropped" and label.get(page.parent[v]) == "content")
            return total

        best = max(labellings(kids[0][0], "wrapper"), key=score)
        assert dom.decode(page, odds) == [t for v, t, _ in page.blocks if best[v] == "content"]
    assert dom.decode(page, [5.0] * n) == ["one", "two", "three", "four"] and dom.decode(page, [-5.0] * n) == []


def test_sampled_pages_have_a_hard_bound(spark):
    copies = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("<p>one page copied</p>").alias("html"))
    others = spark.range(1000).select(F.lit(7).cast("long").alias("page_id"), F.concat(F.lit("<p>"), "id").alias("html"))
    again = spark.range(5000).select(F.lit(9).cast("long").alias("page_id"), F.lit("<p>the same row").alias("html"))
    d = copies.unionAll(others).unionAll(again).unionAll(spark.createDataFrame([(None, None), (1, None)], "page_id long, html string"))
    got = html_main.sampled(d, sample_pages=40).collect()
    assert len(got) == len({r["place"] for r in got}) == 40 and {r["place"] for r in got} == {r["place"] for r in html_main.sampled(d.repartition(7), sample_pages=40).collect()}
    assert sum(r["html"] == "<p>one page copied</p>" for r in got) > 15
    for n in (10**9, 10**13):  # the share of so many pages leaves some of these, or all are ranked
        assert {r["place"] for r in html_main.sampled(d, sample_pages=40, n=n).collect()} == {r["place"] for r in got}
    assert html_main.sampled(d, sample_pages=10_000).count() == 4001 and html_main.sampled(d.limit(0)).count() == 0


def test_very_long_pages(spark):
    article = "".join(f"<p>{prose('xa', 30)}</p>" for _ in range(200))
    long = "<nav>" + "<a href=/>x</a>" * 50 + f"</nav><article>{article}</article><footer>end</footer>"
    deep = "<nav><ul><li><a href=/>Home</a></li></ul></nav><article>" + "<div>" * 600 + f"<p>{prose('xb', 60)}</p>" + "</div>" * 600 + f"<p>{prose('xb', 50)}</p></article><footer>end</footer>"
    rows = [(i, "u", PAGE % (prose("xa", 5), prose("xa", 60), prose("xa", 40))) for i in range(60)] + [(100, "u", long), (101, "u", deep)]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    inside = lambda h: "\n\n".join(x.split("</p>")[0] for x in h.split("<article>")[1].split("</article>")[0].split("<p>")[1:])
    assert got[100] == inside(long) and got[101] == inside(deep)


def test_main_text_without_landmarks(spark):
    """Trees of 150 pages on 200 others, as they are and with neither telling elements nor names."""
    import html
    import re

    path = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    pages = spark.read.parquet(path)
    model = html_main.train(pages.filter("page_id < 150"))
    rows = pages.filter("page_id >= 1000 AND page_id < 1200").collect()
    want = {}
    for r in rows:
        blocks = re.split(r"<(?:/?(?:p|h1|h2|ul|li|div|blockquote))[^>]*>", r["html"].split("<article>")[1].split("</article>")[0])
        texts = (" ".join(html.unescape(re.sub(r"<br>", " ", b)).split()) for b in blocks)
        want[r["page_id"]] = "\n\n".join(t for t in (re.sub(r"</?b>", "", t) for t in texts) if t)
    plain = lambda h: re.sub(r' (?:class|id)="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer|header|aside|main|section)\b", r"<\1div", h))
    bare = spark.createDataFrame([(r["page_id"], r["url"], plain(r["html"])) for r in rows], "page_id long, url string, html string")
    for d, least in ((pages.filter("page_id >= 1000 AND page_id < 1200"), 200), (bare, 196)):
        got = {r["page_id"]: r["text"] for r in html_main.extract(d, model).collect()}
        assert sum(got[i] == want[i] for i in want) >= least


def test_trees_learn_a_rule():
    g = np.random.default_rng(0)
    x = g.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = boosting.fit(x[:2000], y[:2000])
    assert ((m.log_odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


# --- 5


def test_lines_by_share_of_site(docs, empty):
    got = line_dedup.drop_boilerplate(docs, max_ratio=0.3, min_pages=4, report=True)
    rows = odd_rows()
    pages, on = Counter(), Counter()
    for r in rows:
        pages[r[3]] += 1
        for line in {x.strip() for x in (r[1] or "").split("\n")} - {""}:
            on[r[3], line] += 1
    bad = {k for k, n in on.items() if n >= 4 and n > 0.3 * pages[k[0]]}
    want = Counter((r[0], r[3], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip()) not in bad)) for r in rows)
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect()) == want
    assert bad and got.columns[: len(docs.columns)] == docs.columns and line_dedup.drop_boilerplate(empty).count() == 0


def test_lines_by_host(spark):
    urls = ["https://Blog.example.org/a", "http://blog.example.org:80/b?x", "//u:p@blog.example.org", "http://other.example.org/", "blog.example.org", None]
    d = spark.createDataFrame([(i, f"menu\nonly {i}", u, 1, "x") for i, u in enumerate(urls)] + [(9, "menu\nelse", "http://other.example.org/c", 1, "x")], "page_id long, text string, url string, site int, drop string")
    assert [r[0] for r in d.orderBy("page_id").limit(6).select(line_dedup.host_of(F.col("url"))).collect()] == ["blog.example.org"] * 3 + ["other.example.org", "blog.example.org", None]
    got = {r["page_id"]: r["text"] for r in line_dedup.drop_boilerplate(d, "page_id", site_col="url").collect()}
    assert got == {0: "only 0", 1: "only 1", 2: "only 2", 3: "only 3", 4: "only 4", 5: "menu\nonly 5", 9: "else"}
    alone = d.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id"), F.lit(".org/")))
    assert line_dedup.drop_boilerplate(alone, "page_id", site_col="url").filter("text NOT LIKE 'menu%'").count() == 0


# --- 6


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in group.items()}
    return Counter((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def test_jaccard_components(docs, empty):
    got = jaccard.near_duplicates(docs)
    assert Counter(map(tuple, got.collect())) == brute_components(odd_rows())
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r[0] for r in kept.select("doc_id").collect())
    assert ids[None] == 2 and ids[100] == 1 and ids[300] <= 1 and not any(ids[i] for i in range(101, 106)) and all(ids[i] == 1 for i in range(60)) and ids[200] == ids[201] == ids[202] == 1


def test_jaccard_of_chains_around_many_leaders(spark, monkeypatch):
    """Near copies that link to others but not to the text they come from, common passages, small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_ASKING", 3)
    monkeypatch.setattr(jaccard, "COMMON", 4)
    r, rows = random.Random(11), []
    passage = prose("xb", 60, r)
    for g in range(5):
        base = [f"{w}{g}" for w in prose("xa", 150, r).split()]
        for _ in range(30):
            w = base[:]
            for k in r.sample(range(150), r.choice((0, 1, 2, 3, 5, 7))):
                w[k] = f"n{r.randrange(10**6)}"
            if r.random() < 0.4:
                base = w
            rows.append((len(rows), " ".join(w) + (" " + passage if r.random() < 0.3 else "")))
    r.shuffle(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert Counter(map(tuple, got.collect())) == brute_components(rows)


def test_jaccard_of_chains_in_many_parts_takes_few_tables(spark, monkeypatch):
    """Chains of near copies, dealt over many parts, with copies that link with nothing and without ids: no rounds, which are many small jobs."""
    r, rows = random.Random(12), []
    for g in range(6):
        w = [f"{x}{g}" for x in prose("xa", 120, r).split()]
        for _ in range(14):
            w = w[:]
            for k in r.sample(range(120), 3):
                w[k] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    alone = prose("xb", 80, r)
    rows += [(None, alone), (905, alone), (903, alone), (None, prose("xc", 40, r)), (907, ""), (908, None), (None, "")]
    r.shuffle(rows)
    names = []
    for module in (jaccard, components):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: names.append(name) or real(df, name))
    settings = {"spark.sql.shuffle.partitions": "25", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(30))
        assert Counter(map(tuple, got.collect())) == brute_components(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(names) <= 10 and not {"cc-large", "cc-round"} & set(names)


def test_jaccard_cells_and_parts(spark, docs, monkeypatch):
    """The same answer from many cells, in parts of their own and several to a part, as from one."""
    parts, inside = jaccard.cells_for(10**14)
    assert jaccard.cells_for(0) == (1, 1) and 0.9 * jaccard.MAX_PARTS < parts <= jaccard.MAX_PARTS and 0.9 * jaccard.CELL_BYTES < 10**14 / (parts * inside) <= jaccard.CELL_BYTES
    monkeypatch.setattr(jaccard, "CELL_BYTES", 9_000)
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "GATHER", 2_000)
    want = brute_components(odd_rows())
    for most in (100, 3):
        monkeypatch.setattr(jaccard, "MAX_PARTS", most)
        assert (jaccard.cells_for(sum(len(r[1] or "") for r in odd_rows()))[1] > 1) == (most == 3)
        assert Counter(map(tuple, jaccard.near_duplicates(docs).collect())) == want


def test_words_with_one_crc32_are_two(spark):
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    rows = [(1, "plumless one two three four"), (2, "buckeroo one two three four")]
    assert {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(1, 1, 1), (2, 1, 2)}


# --- 7


def test_shards(docs, empty):
    rows = odd_rows()[:-3] + [(400 + i, prose("xa", 30 + i % 50), "xa", f"s{i % 5}", 1) for i in range(800)]
    rows = [r for r in rows if r[0] != 206]
    d = docs.sparkSession.createDataFrame([r + ("x",) * 10 for r in rows], DOCS)
    got = sharding.shard(d, rows_per_bucket=100).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 8
    assert set(total) == set(range(8)) and max(abs(v - mean) for v in total.values()) < 0.03 * mean
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    where = defaultdict(set)
    for r in got:
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values()) and {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    again = sharding.shard(d.repartition(5), rows_per_bucket=33).select("doc_id", "size", "shard").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["size"], r["shard"]) for r in got)
    assert sharding.shard(empty).count() == 0 and sharding.shard(docs.filter("doc_id = 1")).count() == 1


def brute_tree(groups, dims, leaves):
    """({digest: shard}, bytes placed by a leaf of their own): the k-d tree by sorting in memory."""
    shards, alone = {}, 0
    whole = {d: max(max(g[d] for g in groups) - min(g[d] for g in groups), 1e-12) for d in dims}

    def grow(some, n, first):
        nonlocal alone
        if n < 2 or not some:
            shards.update({g["digest"]: first for g in some})
            return
        total, top = sum(g["weight"] for g in some), max(some, key=lambda g: (g["weight"], g["digest"]))
        if top["weight"] * n >= total:
            alone += top["weight"]
            shards[top["digest"]] = first
            return grow([g for g in some if g is not top], n - 1, first + 1)
        goal, best = total * (n // 2) / n, None
        for d in sorted(dims, key=lambda d: (-(max(g[d] for g in some) - min(g[d] for g in some)) / whole[d], d)):
            lo, hi = min(g[d] for g in some), max(g[d] for g in some)
            at = lambda g: (int((g[d] - lo) / max(hi - lo, 1e-12) * 65535) << 20) + g["tie"]  # noqa: B023, E731
            below, before, cut = 0, 0, None
            for p in sorted({at(g) for g in some}):
                before, below = below, below + sum(g["weight"] for g in some if at(g) == p)
                if below >= goal:
                    cut, miss = (p + 1, abs(below - goal)) if abs(below - goal) < abs(before - goal) else (p, abs(before - goal))
                    break
            if best is None or miss < best[0]:
                best = miss, [g for g in some if at(g) < cut], [g for g in some if at(g) >= cut]
            if miss <= sharding.SLACK * total:
                best = miss, [g for g in some if at(g) < cut], [g for g in some if at(g) >= cut]
                break
        grow(best[1], n // 2, first)
        grow(best[2], n - n // 2, first + n // 2)

    grow(groups, leaves, 0)
    return shards, alone


@pytest.mark.parametrize("heavy", [False, True])
def test_shards_against_a_tree_in_memory(spark, heavy):
    if heavy:
        d = spark.createDataFrame([(i, prose("xa", 20 + i % 9), "xa", f"s{i % 3}") for i in range(90)] + [(200, "much " * 4000, "xa", "s0"), (201, "half " * 3000, "xb", None)] + [(300 + i, "copy " * 30, "xc", "s1") for i in range(20)], "doc_id long, text string, lang string, source string")
    else:
        sf = "/root/testdata/sf0.001/documents.parquet"
        if not os.path.exists(sf):
            pytest.skip("needs the driver's tables")
        d = spark.read.parquet(sf)
    rows = d.select(F.col("doc_id").alias("id"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "lang", "source")
    groups, dims = sharding.text_groups(rows)
    want, alone = brute_tree([g.asDict() for g in groups.collect()], dims, 8)
    digest = {r["id"]: r["digest"] for r in rows.collect()}
    got = sharding.shard(d).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == {i: want[x] for i, x in digest.items()}
    assert (alone > 0) == heavy
    assert {s["rank"] for s in sharding.tree(groups, dims, 8, slack=1) if s["own"] is None} == {0}


def test_numbered(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = numbered(d, ["k"], ["id"], "n", rows_per_bucket=20).collect()
    for k in range(3):
        assert sorted(r["n"] for r in got if r["k"] == k) == list(range(sum(r["k"] == k for r in got)))


# --- 8


def brute_repeats(w):
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(i):
            k = 0
            while i + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def test_repetition(spark, docs, empty):
    r, rows = random.Random(5), []
    for i in range(40):
        t = [r.choice("a b c dd eé".split()) for _ in range(r.choice((0, 1, 3, 60, 90)))]
        rows.append((i, " ".join(t) + ("\n#x|\n#x|\n\n \n" if i % 2 else "")))
    rows += [(50, prose("xa", 200)), (51, (prose("xa", 40) + " ") * 4), (52, None)]
    got = {x["doc_id"]: x for x in repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, t in rows:
        w, x, t = words(t), got[doc], t or ""
        best = brute_repeats(w)
        inside = {i + k for i, n in enumerate(best) if n >= 3 for k in range(3)}
        spans = {i + k for i, n in enumerate(best) if n >= 6 for k in range(n)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if line.split():
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(len(y.decode()) for y in w), sum(c in "#*$%&|<>" for c in t), dup, len(inside))
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and x["covered_fraction"] == pytest.approx(len(spans) / max(1, len(w)))
        assert x["longest_repeat"] == max([n for n in best if n >= 2], default=0) and not (x["kept"] and x["base_failed"])
    assert got[50]["kept"] and not got[51]["kept"]
    out = repetition.repetition(docs).collect()
    assert len(out) == len(odd_rows()) and max(x["n_words"] for x in out) == 30_000
    assert repetition.repetition(empty).count() == 0


def test_a_very_long_repetition(spark):
    text = "again and " * 400_000
    r = repetition.repetition(spark.createDataFrame([(1, text), (2, text + prose("xa", 300))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0]["n_words"], r[0]["n_repeat_words"], r[0]["longest_repeat"]) == (800_000, 800_000, 799_998) and r[1]["longest_repeat"] == 799_998 and r[0]["base_failed"]


# --- 9


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    got = packing.packed_documents(docs, vocabulary_path(), rows_per_bucket=10).collect()
    want = Counter()
    for doc, text, *_ in odd_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first, at, piece = (len(ids) - 1) % 1024 + 1, 0, 0
        while at < len(ids):
            n = first if not at else 1024
            want[doc, piece, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())] += 1
            at, piece = at + n, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) + 2 and packing.packed_documents(empty, vocabulary_path()).count() == 0


def test_fast_and_slow_ids_agree():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    e, r = packing.Encoder(vocabulary_path()), random.Random(2)
    wide = [chr(c) for c in r.sample(range(0x20000), 6000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(r.choice(" \n\t\rab'sreÉé12,.! \x1c\x85　日🙂ǅ") if r.random() < 0.9 else r.choice(wide) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext", "x" * 5000, " " * 3000 + "é", "aé" * 2000]
    assert e.fast is not None and [list(x) for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(["a<|endoftext|>b"])[0][1] == 50256 and not e.is_fast("a<|endoftext|>b") and e.is_fast("plain é 日")
    assert sum(map(e.is_fast, texts)) > 2000


def test_characters_of_two_classes_take_the_slow_way():
    e = packing.Encoder(vocabulary_path())
    assert e.is_fast("café")
    e.alike[ord("é")] = False
    assert not e.is_fast("café") and e.is_fast("cafe") and e.encode(["café"])[0] == e.slow.encode("café", add_special_tokens=False).ids


def test_fullest_bins():
    r = random.Random(4)
    for _ in range(100):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(6)}
        uses = dict(packing.fullest(counts, 30))
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(max(counts))
        sums = {max(counts)}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 30}
        assert sum(k * n for k, n in uses.items()) == max(sums) and all(n <= counts[k] for k, n in uses.items())


# --- 10


def test_top_k(spark):
    g = np.random.default_rng(3)
    v = g.normal(size=(300, 6)).astype(np.float32)
    v[40:60] = v[40]
    v[:, 2] *= g.random(300) < 0.5
    rows = [(i, [float(x) for x in v[i]], "x", 1) for i in range(300)]
    rows += [(400, None, "x", 1), (450, [1.0, None], "x", 1), (500, [1.0, float("nan")], "x", 1), (550, [float("inf")], "x", 1), (None, [1.0] * 6, "x", 1), (600, [], "x", 1), (601, [0.5, 0.5], "x", 1)]
    # Rows under one query's id, equal ones too: each asks, and is an answer to the others.
    rows += [(100, [float(x) for x in v[100]], "x", 1), (100, [float(x) for x in v[101]], "x", 1), (7, [float(x) for x in v[7]], "x", 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int").repartition(4)
    ok = [(i, np.floor(np.array(x, dtype=np.float32).astype(float) * 256).astype(int)) for i, x, *_ in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    pad = [(i, np.pad(x, (0, 6 - len(x)))) for i, x in ok]
    want = Counter()
    for at, (q, v) in enumerate(pad):
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for i, (c, w) in enumerate(pad) if i != at)[:5]
            want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(best))
    assert Counter(map(tuple, topk.top_k(d).collect())) == want
    assert Counter(map(tuple, topk.top_k(d.repartition(1), block_rows=3, cell_queries=2).collect())) == want
    assert topk.top_k(d.limit(0)).count() == 0 and topk.top_k(d.filter("vec_id = 50")).count() == 0


def test_large_components_stay_exact(spark):
    d = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 1.0])], "vec_id long, embedding array<double>")
    x = 3_000_000 * 256
    assert [r["score"] for r in topk.top_k(d).orderBy("rank").collect()] == [x * x + 256 * 512, x * x + 256 * 256]


def test_rows_of_lists_as_a_matrix():
    lists = pa.chunked_array([pa.array([[9], [1, 2, 3], [], [4]], pa.list_(pa.int64())).slice(1), pa.array([[5, 6]], pa.list_(pa.int64()))])
    assert topk.matrix(lists).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0], [5, 6, 0]]
    assert topk.matrix(lists, 2).tolist() == [[1, 2], [0, 0], [4, 0], [5, 6]] and topk.matrix(lists, 0).shape == (4, 0)
    assert topk.matrix(pa.chunked_array([], pa.list_(pa.int64()))).shape == (0, 0)


def test_tasks_of_near_copies_have_one_worker(spark, docs, monkeypatch):
    """Two steps in Python in one task would take two workers a core, which stay with the executor: of what is written no part has them."""
    plans, out = [], Counter(map(tuple, jaccard.near_duplicates(docs).collect()))
    for module in (jaccard, components):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    assert Counter(map(tuple, jaccard.near_duplicates(docs).collect())) == out
    found = 0
    for plan in plans:
        above = []  # depths of the Python steps over a line, of the task it is in
        for line in plan.splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [d for d in above if d < depth]
            if "MapInPandas" in line or "MapInArrow" in line:
                assert not above, plan
                above.append(depth)
                found += 1
            elif "Repartition" in line or "Join" in line or "Aggregate" in line:
                above = []
    assert found >= 5


def test_tasks_of_near_copies_hold_little():
    """A task's texts are strings a few at a time, and what it held is free when memory is given back."""
    import tracemalloc
    import weakref

    from graphrec.functions import memory

    class Frame:
        mapInPandas = mapInArrow = lambda self, run, schema: run

    text = [f"{i} " + "x" * 5_000 for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(10_000))), pa.array(text)], ["id", "text"])
    del text
    tracemalloc.start()
    rows = sum(len(x) for x in jaccard.scatter(Frame(), 4, 1, 5)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 0 and most < 20_000_000

    class Held:
        pass

    def run(batches):
        for b in batches:
            yield id(b)

    given, real = [], memory.give_back
    refs = []

    def batches():
        b = Held()
        refs.append(weakref.ref(b))
        yield b

    memory.give_back = lambda: given.append(refs[0]() is None)
    try:
        assert len(list(memory.returning(run)(batches()))) == 1 and given == [True]
    finally:
        memory.give_back = real
