"""Language of mixed texts: expectation-maximisation over n-gram likelihoods, the set of languages by penalised likelihood."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memory import returning
from .token_counts import slices as slices_of

#: Buckets of hashed byte trigrams, added to each count, and what a trigram's log-likelihood is divided by: a byte
#: stands in three trigrams.
BUCKETS, SMOOTHING, OVERLAP = 1 << 17, 0.05, 3.0
#: Bytes looked at together; rounds of EM over all languages and over a smaller set.
SLICE, ROUNDS, SET_ROUNDS = 1 << 20, 10, 5
ALPHANUMERIC = re.compile(r"[^\W\d_]+")
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-case UTF-8 in composed form, ASCII that isn't a letter as spaces."""
    return unicodedata.normalize("NFC", text.lower()).encode("utf-8", "replace").translate(_TO_SPACE)


def has_letter(text: str) -> bool:
    """Whether a character of the letter category is in it; numerals such as a half or a Roman eight are none."""
    return any(any(map(str.isalpha, m[0])) for m in ALPHANUMERIC.finditer(text))


def slices(raw: bytes) -> Iterator[bytes]:
    """raw in parts of about SLICE bytes, cut at spaces where there are any."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = raw.rfind(b" ", at + 1, end) + 1 or end
        yield raw[at:end]
        at = end


def trigrams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts set apart by spaces: each letter byte's hashed trigram, where each word's bytes begin, the word's part."""
    buf = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    inside = np.flatnonzero(buf[1:-1] != 32) + 1
    code = buf[inside - 1].astype(np.uint32) << 16 | buf[inside].astype(np.uint32) << 8 | buf[inside + 1]
    code = ((code * np.uint32(2654435761)) >> np.uint32(32 - 17)).astype(np.int32)
    starts = np.flatnonzero(buf[inside - 1] == 32)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return code, starts, np.searchsorted(ends, inside[starts], side="right")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods by [bucket, language]) from labelled documents that are not held out.

    Fitted on a sample: by a hash of id and text, about per_language documents of each language, at any number of
    documents. Counts are summed by Spark;
    one row a language and BUCKETS numbers a language reach the driver, whatever the size of docs (so `lang` is meant to
    be a code, of which there are hundreds at most).
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("out")).filter("NOT out AND lang IS NOT NULL AND text IS NOT NULL")
    known = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(known)
    if not languages:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    share = F.create_map(*[F.lit(x) for k, n in known.items() for x in (k, per_language / n)])
    place = F.xxhash64("id", "text", F.lit("langid")) / F.lit(2.0**64) + 0.5  # even in [0, 1)
    sample = d.filter(place < share[F.col("lang")]).select("text", "lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                for part in slices(plain(text)):
                    total[languages.index(lang)] += np.bincount(trigrams([part])[0], minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pd.DataFrame({"language": row.astype("int32"), "bucket": bucket.astype("int32"), "n": total[row, bucket]})

    counted = sample.mapInPandas(returning(run), "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((BUCKETS, len(languages)))
    n[counted["bucket"], counted["language"]] = counted["n"]
    return languages, (np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * BUCKETS)) / OVERLAP).astype(np.float32)


def mixtures(like: np.ndarray, counts: np.ndarray, max_languages: int | None = None, penalty: float = 0.5) -> np.ndarray:
    """Proportions of languages by [text, language], of words with log-likelihoods `like`, counts[i] > 0 words to text i.

    EM over all languages ranks them; then for sets of the 1, 2... most likely ones EM runs anew on the set, and the set
    with the largest log-likelihood less penalty * size * log(words + 1) stands. Sets grow up to all languages of which
    EM expects half a word at least, or up to max_languages where that is given.
    """
    p = np.exp(like - like.max(1, keepdims=True))
    k = like.shape[1]

    def em(p: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        starts, n = np.append(0, np.cumsum(counts)[:-1]), counts[:, None].astype(np.float32)
        for _ in range(rounds):
            weighted = p * np.repeat(share, counts, axis=0)
            all_ = weighted.sum(1, keepdims=True)
            share = np.add.reduceat(weighted / np.maximum(all_, 1e-30), starts, axis=0) / n
        all_ = (p * np.repeat(share, counts, axis=0)).sum(1)
        return share, np.add.reduceat(np.log(np.maximum(all_, 1e-30)).astype(np.float64), starts)

    share, _ = em(p, counts, np.full((len(counts), k), 1 / k, dtype=np.float32), ROUNDS)
    place = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    largest = np.clip((share * counts[:, None] >= 0.5).sum(1), 1, max_languages or k)
    best, best_score = np.zeros_like(share), np.full(len(counts), -np.inf)
    for size in range(1, int(largest.max()) + 1):
        these = np.flatnonzero(largest >= size)
        inside = np.where(place[these] < size, np.maximum(share[these], 1e-6), 0).astype(np.float32)
        own = p if len(these) == len(counts) else p[np.repeat(largest >= size, counts)]
        s, fit = em(own, counts[these], inside / inside.sum(1, keepdims=True), SET_ROUNDS if size > 1 else 0)
        score = fit - penalty * size * np.log(counts[these] + 1.0)
        better = score > best_score[these]
        best[these[better]], best_score[these[better]] = s[better], score[better]
    return best


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: bool = False, max_languages: int | None = None) -> DataFrame:
    """Adds lang_pred, score and languages (those of the chosen set with their shares) to id_col, or to all of docs with `keep`.

    The whole text counts, however long, in slices; all words of it meet in EM, so memory follows the longest text. A set
    may hold all languages, or max_languages of them. score is the share of lang_pred in the mixture. `und` with score 0 where the text is null, has
    no letters, or nothing was learned. Null ids, repeated rows, empty tables and other columns are allowed.
    """
    languages, table = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)
    own = docs.columns if keep else [id_col]
    names = [f"own_{i}" for i in range(len(own))]
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, own)) + ", lang_pred string, score double, languages string"
    at = own.index(text_col) if text_col in own else None
    # A word has a likelihood a language, so the more languages the fewer words at a time.
    together = SLICE * 4 // max(4, len(languages))

    def predict(texts: list) -> tuple[list, list, list]:
        table, parts, owner = shared.value, [], []
        for i, t in enumerate(texts):
            if t and languages and has_letter(t):
                for part in slices(plain(t)):
                    parts.append(part)
                    owner.append(i)
        likes, words, at, size = [], np.zeros(len(texts), dtype=np.int64), 0, 0
        for j, part in enumerate(parts):
            size += len(part)
            if size >= together or j == len(parts) - 1:
                code, starts, of = trigrams(parts[at : j + 1])
                if len(starts):
                    likes.append(np.add.reduceat(table[code], starts, axis=0))
                    words += np.bincount(np.array(owner[at : j + 1])[of], minlength=len(texts))
                at, size = j + 1, 0
        pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
        have = np.flatnonzero(words)
        if len(have):
            for i, s in zip(have, mixtures(np.concatenate(likes), words[have], max_languages)):
                best = int(s.argmax())
                pred[i], score[i] = languages[best], min(1.0, float(s[best]))
                sets[i] = " ".join(f"{languages[k]}:{s[k]:.3f}" for k in np.argsort(-s) if s[k] > 0)
        return pred, score, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text" if at is None else names[at])
            for a, z in slices_of(texts, together):
                pred, score, sets = predict(texts.slice(a, z - a).to_pylist())
                # Columns pass as they came: pandas would round long ids beside a null.
                own = [b.column(n).slice(a, z - a) for n in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], [*names, "lang_pred", "score", "languages"])

    source = docs.toDF(*names) if keep else docs.select(F.col(id_col).alias(names[0]), F.col(text_col).alias("text"))
    out = source.mapInArrow(returning(run), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, own)], "lang_pred", "score", "languages")


def confident(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int | None = None) -> DataFrame:
    """docs whose language is certain: those without letters, and those of which no language has min_score, go.

    Null texts go; null ids and repeated rows are documents each; an empty table, or one without labels, gives no rows;
    other columns keep their names and values, whatever they are called.
    """
    own = [f"own_{i}" for i in range(len(docs.columns))]
    found = identify(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col, keep=True, max_languages=max_languages)
    found = found.toDF(*own, "lang_pred", "score", "languages").filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.select(*[F.col(n).alias(c) for n, c in zip(own, docs.columns)])


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int | None = None) -> DataFrame:
    """(id_col, held_out, lang_pred, score, languages) of every document; learned from docs' labelled ones not held out.

    Null ids are not held out, null and empty texts are `und`, repeated rows are predicted each, an empty table gives no
    rows, without labels all is `und`; columns but those named are ignored.
    """
    found = identify(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col, max_languages=max_languages)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "languages")
