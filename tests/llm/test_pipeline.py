"""The pipeline against what its stages should leave, worked out by brute force."""

import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from graphrec.llm import langid
from graphrec.llm.queries import ORACLE_SQL, QUERIES
from test_operators import DOCS, odd_rows, plain_mixture, prose

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def words(t):
    return (t or "").encode().split()


def shingles(t):
    w = words(t.lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def least_of_each(ids, linked):
    """The smallest id of each group of ids that links connect, by visiting all pairs."""
    open_, found = set(ids), []
    for i in sorted(ids):
        if i in open_:
            found.append(i)
            todo = [i]
            while todo:
                x = todo.pop()
                open_.discard(x)
                todo += [y for y in open_ if y not in todo and linked(x, y)]
    return found


def plain_share(text, table):
    """The largest share of a language in a text, by loops over bytes, words and sets; 0 without letters."""
    raw = b" " + langid.plain(text) + b" "
    like, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        codes = [((raw[k - 1] << 16 | raw[k] << 8 | raw[k + 1]) * 2654435761 % 2**32) >> 15 for k in range(at, at + len(w))]
        like.append([float(sum(table[c][lang] for c in codes)) for lang in range(table.shape[1])])
        at += len(w)
    return max(plain_mixture(like)) if any(c.isalpha() for c in text) else 0.0


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    before = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_frequency", "near_duplicates", "source_mix", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    a = stage["language_id"](spark, docs, SF).persist()
    assert a.columns == docs.columns
    certain = {i: plain_share(r["text"], langid.learn(docs)[1]) for i, r in before.items() if len(words(r["text"])) < 500}
    left = {r["doc_id"] for r in a.collect()}
    assert len(certain) > 100 and all((i in left) == (x >= 0.5) for i, x in certain.items() if abs(x - 0.5) > 0.01)
    b = stage["line_frequency"](spark, a, SF).persist()
    pages, on = Counter(), Counter()
    kept = [before[r["doc_id"]] for r in a.collect()]
    for r in kept:
        pages[r["source"]] += 1
        for line in {x.strip() for x in r["text"].split("\n")} - {""}:
            on[r["source"], line] += 1
    bad = {k for k, n in on.items() if n >= 2 and n > 0.05 * pages[k[0]]}
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip()) not in bad) for r in kept}
    assert {r["doc_id"]: r["text"] for r in b.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in b.collect())
    c = stage["near_duplicates"](spark, b, SF).persist()
    ids = sorted(r["doc_id"] for r in c.collect())
    sets = {i: shingles(t) for i, t in want.items()}
    linked = lambda x, y: sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    assert ids == sorted(least_of_each(want, linked))
    d = stage["source_mix"](spark, c, SF).persist()
    taken = defaultdict(int)
    sizes = {r["doc_id"]: len(r["text"].encode().split()) for r in c.collect()}
    for r in d.collect():
        taken[r["doc_id"]] += len(r["text"].encode().split())
    assert d.columns == docs.columns and all(n <= 3 * sizes[i] for i, n in taken.items()) and abs(sum(taken.values()) - sum(sizes.values())) < 400
    e = stage["packing"](spark, d, SF)
    assert e.agg({"length": "sum"}).first()[0] > 0 and e.filter("piece = 0").count() == d.count()
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == Counter(map(tuple, e.select("doc_id", "piece", "ids_crc32").collect()))


def test_a_query_an_operator_and_sql():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_two_documents_in_one_source(spark, tmp_path):
    text = prose("xa", 90)
    rows = [(1, f"{text} one", "xa", "s", 3), (2, prose("xa", 40), "xa", "s", 3), (3, f"{text} uno", "xa", "s", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and len({r["sequence_id"] for r in got}) == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0


def test_odd_rows_through_all_stages(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, names that operators use themselves."""
    d = spark.createDataFrame([r + ("x",) * 10 for r in odd_rows()], DOCS).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    a = stage["language_id"](spark, d, SF).persist()
    assert a.columns == d.columns and a.filter("text IS NULL OR doc_id IN (201, 202, 203)").count() == 0
    assert {r["doc_id"] for r in a.collect()} >= set(range(60)) | set(range(100, 106)) | {None, 204, 205}
    b = stage["line_frequency"](spark, a, SF).persist()
    assert b.columns == d.columns and b.count() == a.count() and b.filter("text LIKE 'common line%'").count() == 0 and b.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    c = stage["near_duplicates"](spark, a, SF).persist()  # of texts with all their lines: those of copies are frequent ones
    left = Counter(r["doc_id"] for r in c.collect())
    assert c.columns == d.columns and left[None] == 1 and all(left[i] == 1 for i in [*range(60), 100, 204])
    assert not any(left[i] for i in [*range(101, 106), *range(110, 116), 205])
    e = stage["source_mix"](spark, c, SF).persist()
    assert e.columns == d.columns and e.filter("doc_id IS NULL").count() > 0
    f = stage["packing"](spark, e, SF).collect()
    ends = Counter()
    for r in f:
        ends[r["sequence_id"]] += r["length"]
    assert sum(r["piece"] == 0 for r in f) == e.count() and max(ends.values()) <= 1024
