"""Collocations, whitening and token counts against brute force, another decomposition, and the tokenizers library."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphrec.llm import phrases, token_counts, whitening
from graphrec.llm.queries import vocabulary_path
from test_operators import DOCS, odd_rows

SF = "/root/testdata/sf0.001"
BIG = 2**53 + 1
VECS = "vec_id long, embedding array<double>, x string, n string, component string, id string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ("x",) * 10 for r in odd_rows()], DOCS).repartition(3).persist()


# --- 11


def plain_collocations(rows, least, longest, top, percent=80):
    """By dictionaries over (lang, tuple of words)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\v\f\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        longer = [c for (other, q), c in f.items() if other == lang and len(q) > len(p) and c >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * c >= percent * a for c in longer):
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    rank, found = Counter(), []
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return found


def small_texts():
    r = random.Random(3)
    words = ["new", "york", "city", "hall", "of", "the", "É", "x😀", "#1"]
    rows = []
    for i in range(150):
        w = [r.choice(words) for _ in range(r.randint(0, 12))]
        if i % 3 == 0:
            w += "New  York\tCity Hall".split(" ")
        rows.append((r.choice([" ", ", ", ". ", "  ", "\t", "\n"]).join(w), r.choice(["en", "fr", None])))
    return rows + [(None, "en"), ("", "en"), (" \t.,", None), ("a a a a a a", "en"), ("of the " * 3000, "fr")] + [("same old text here", "de")] * 7


def test_collocations_as_by_dictionaries(spark):
    rows = small_texts()
    d = spark.createDataFrame([(i if i % 5 else None, *r, "a", "b", "c", "d") for i, r in enumerate(rows)], "doc_id long, text string, lang string, piece string, copies string, phrase string, f string").repartition(4)
    for least, top in ((3, 9), (7, 2000)):
        want = plain_collocations(rows, least, 4, top)
        assert len(want) > 5 and Counter(map(tuple, phrases.collocations(d, least, top=top).collect())) == Counter(want)
    assert phrases.collocations(d.limit(0)).count() == 0 and phrases.collocations(d, least=10**9).count() == 0


def test_first_rows_come_from_buckets_as_from_all(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PER_CHOICE", 8)
    r = random.Random(1)
    rows = [(r.choice("ab"), f"p{i}", r.randint(0, 30), r.randint(0, 9)) for i in range(3000)]
    got = phrases.first_of_each(spark.createDataFrame(rows, "lang string, phrase string, score long, a long"), 5, len(rows)).collect()
    want = {lang: sorted(((-s, -a, p) for x, p, s, a in rows if x == lang))[:5] for lang in "ab"}
    assert {lang: [(-x["score"], -x["a"], x["phrase"]) for x in sorted(got, key=lambda x: x["rank"]) if x["lang"] == lang] for lang in "ab"} == want


def test_a_map_leaves_out_no_frequent_phrase(spark):
    langs, texts, copies = zip(*[(lang or "und", " ".join((t or "").lower().split()) or "x", i % 3 + 1) for i, (t, lang) in enumerate(small_texts())])
    arrays = (pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(copies, pa.int64()))
    count = lambda sizes, m: {(r["lang"], r["phrase"]): r["f"] for b in phrases._grams(*arrays, sizes, m) for r in b.to_pylist()}
    for sizes in ((2,), (3,), (4,), (3, 4)):
        whole, shorter = count(sizes, None), count((sizes[0] - 1,), None)
        bits = np.zeros(phrases.MAP_BITS // 8, dtype=np.uint8)
        often = [k for k, f in shorter.items() if f >= 5]
        for at in phrases.places(*(pa.array(c, pa.string()) for c in zip(*often))):
            bits[at >> 3] |= 1 << (at & 7)
        some = count(sizes, bits)
        assert some.items() <= whole.items() and {k for k, f in whole.items() if f >= 5} <= set(some)
        assert len(some) < len(whole) and count(sizes, np.full_like(bits, 255)) == whole


def test_a_bucket_is_summed_out_of_core(spark, tmp_path):
    rows = spark.range(200_000).select(F.lit("en").alias("lang"), F.concat(F.lit("a phrase "), F.col("id") % 1000).alias("phrase"), F.lit(2**40).cast("long").alias("f"))
    got = phrases.counted(rows, 200 * 2**40, 2, str(tmp_path)).select("phrase", "f").collect()
    assert len(got) == 1000 and {r["f"] for r in got} == {200 * 2**40} and not os.listdir(tmp_path)


def test_products_beyond_64_bits(spark):
    big = 2**61
    d = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 5)], "lang string, phrase string, words int, f long")
    r = phrases.scored(d).first()
    assert (r["a"], r["l"], r["r"], r["score"]) == (big, big + 1, big + 5, 2000000 * big // (2 * big + 6))
    around = spark.createDataFrame([("en", "a b c", 3, big)], "lang string, phrase string, words int, f long")
    assert phrases.without_contained(phrases.scored(d), around).count() == 0


# --- 12


def check_whitened(spark, rows, got, components=16):
    """Against eigenvectors of the covariance, and exact sums in Python's integers."""
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s // n - (s % n) / n for c, s in zip(v, sums)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > e[0] * 1e-20).sum()))
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1)) and len(got) == k * len(rows)
    assert all(abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-8 for r in got) and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    by, want_by = {}, {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    signs = {}
    for (i, _), v in zip(rows, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for j in range(k):
            want = float(np.array([c - s // n - (s % n) / n for c, s in zip(v, sums)]) @ u[:, j] / math.sqrt(e[j]))
            want_by.setdefault((i, deviation), {}).setdefault(j + 1, []).append(want)
    assert set(by) == set(want_by)
    for key, each in want_by.items():
        for j, want in each.items():
            have = by[key][j]
            if len(want) == 1 and abs(want[0]) > 1e-3:
                signs.setdefault(j, set()).add(bool((have[0] > 0) == (want[0] > 0)))
            assert np.allclose(sorted(map(abs, have)), sorted(map(abs, want)), atol=1e-7)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_odd_rows(spark):
    r = random.Random(5)
    good = [(i, [r.gauss(0, 1) * (j + 1) + (1e6 if j == 2 else 0) for j in range(6)]) for i in range(300)]
    good += [(1000 + i, good[7][1]) for i in range(150)] + [(BIG, good[3][1]), (None, good[4][1]), (5, good[5][1]), (5, good[6][1])]
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [1.0, float("inf")] + [0.0] * 4)]
    d = spark.createDataFrame([x + ("a",) * 5 for x in good + bad], VECS).repartition(5)
    got = whitening.whiten(d, 4).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in good}
    check_whitened(spark, good, got, 4)


def test_whitening_of_few_and_short_vectors(spark):
    frame = lambda rows: spark.createDataFrame([x + ("a",) * 5 for x in rows], VECS)
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, [1.0, 2.0])] * 3)).count() == 0 and whitening.whiten(frame([(1, []), (2, None)])).count() == 0
    rows = [(i, [float(i), float(i * i), 3.0, -float(i)]) for i in range(3)]
    check_whitened(spark, rows, whitening.whiten(frame(rows)).collect())  # of rank 2
    short = [(1, [1.0]), (2, [2.0, 5.0]), (3, []), (4, [0.5, 0.25])]
    got = whitening.whiten(frame(short)).collect()
    check_whitened(spark, [(i, v + [0.0] * (2 - len(v))) for i, v in short], got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whitening_of_the_given_table(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in d.collect()]
    check_whitened(spark, rows, whitening.whiten(d).collect())


def test_deviations_beyond_64_bits_on_the_way():
    c = whitening.Centre(3, [5, 10**17])
    x = np.array([[10**6, 2**40], [1, -(2**40)]])
    assert c.deviations(x) == [sum((3 * int(v) - s) ** 2 for v, s in zip(row, [5, 10**17])) for row in x]


def test_blocks_reduce_to_one_over_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    d = spark.range(90).select(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) for k in range(3)]).alias("x")).repartition(7)
    rows = np.array([r["x"] for r in d.collect()], dtype=float)

    def block(parts):
        out = np.zeros((0, 3))
        for x in parts:
            out = whitening.triangle([out, x.astype(float)])
        return out

    r = whitening.reduced(d, block, whitening.triangle, 3, 3)
    assert r.shape == (3, 3) and np.allclose(r.T @ r, rows.T @ rows)


def test_jacobi_keeps_small_values_accurate():
    r = np.random.default_rng(1)
    a = r.normal(size=(20, 9)) @ np.diag(10.0 ** -np.arange(9))
    size, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(v.T @ v, np.eye(9), atol=1e-14) and np.allclose((a @ v).T @ (a @ v), np.diag(size**2), atol=1e-15)
    assert np.abs(size / np.linalg.svd(a, compute_uv=False) - 1).max() < 1e-9


# --- 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def strange_texts():
    r = random.Random(1)
    pools = ["abcde fgh'strevmld ", "ABCdéÉßİıſKǺ̧́ 　 \u0085‍", "0123½Ⅷ中文日本語 한글각", "\x00\x01\x1c\x1d\x1e\x1f\t\n\r\v\f !.,#'|<>", "😀👍🏽ﷺﬁΣς"]
    out = []
    for _ in range(3000):
        s = "".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 2)):
            i = r.randint(0, len(s))
            s = s[:i] + r.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "<|EndOfText|>", "'ll", "'S"]) + s[i:]
        out.append(s)
    return out


def test_counts_are_the_library_s(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 200)  # so that pieces are forgotten and met again
    texts = strange_texts() + ["x" * 20_000, "ab" * 5_000 + "é", " ".join("word%d" % (i % 400) for i in range(3000))]
    counter = token_counts.Counter(vocabulary_path("word_bpe_49k.json"))
    assert counter.plain is not None
    assert counter.texts(pa.array(texts)).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.texts(pa.array([None, "a b"]).slice(1)).tolist() == [2]


def test_token_counts_of_odd_rows(spark, docs, library):
    rows = odd_rows() + [(BIG, "one big id", "xa", "s", 1), (BIG + 2, None, None, None, None)]
    d = spark.createDataFrame([r + ("x",) * 10 for r in rows], DOCS).coalesce(1)
    got = token_counts.token_counts(d, vocabulary_path("word_bpe_49k.json"), limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter()
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(d.limit(0), vocabulary_path("word_bpe_49k.json")).count() == 0


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="white space"):
        token_counts.Counter(vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_token_counts_of_the_given_table(spark, library):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in d.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(d, vocabulary_path("word_bpe_49k.json")).collect()} == want
