"""Collocations: phrases that stand together more often than their parts lead one to expect."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, work_dir, written
from .token_counts import slices

#: Words that a task counts together before anything is shuffled; occurrences that are dealt to one hash bucket.
TOGETHER, PER_BUCKET = 1 << 20, 1 << 21
#: Bits of the map of frequent phrases that tasks get (16 MB, whatever the input), and of one row of it.
MAP_BITS, ROW_BITS = 1 << 27, 1 << 15
#: Candidates in a bucket when the first ones of a language are chosen.
PER_CHOICE = 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNDEFINED = "und"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, copies): the different pieces of a language's texts, words set apart by single spaces, and how often each occurs."""
    piece = F.explode(F.split(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), r"[.,;:!?\x0A-\x0D]"))
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDEFINED)).alias("lang"), piece.alias("piece"))
    bare = F.btrim(F.when(F.col("piece").contains("  ") | F.col("piece").contains("\t"), F.regexp_replace("piece", r"[\x20\x09]+", " ")).otherwise(F.col("piece")), F.lit(" "))
    return d.select("lang", bare.alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("copies"))


def _hashes(names: pa.Array) -> np.ndarray:
    """A number of 64 bits for each string, the same in every process."""
    return pd.util.hash_array(np.array(names.to_pylist(), dtype=object), categorize=False) if len(names) else np.zeros(0, dtype=np.uint64)


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of the phrases without their last word, and of that word."""
    h = h * np.uint64(0x9E3779B97F4A7C15) + word
    return h ^ h >> np.uint64(29)


def _bit(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - MAP_BITS.bit_length() + 1)


def places(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The number under which each phrase is looked up in the map of frequent ones. Others may have it too."""
    words = pc.split_pattern(phrases.cast(pa.large_string()), " ")
    ends = words.offsets.to_numpy()
    size, word, h = np.diff(ends), _hashes(words.flatten()), _hashes(langs)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        h[here] = _joined(h[here], word[ends[:-1][here] + k])
    return _bit(h).astype(np.int64)


def _grams(langs: pa.Array, texts: pa.Array, copies: pa.Array, sizes: tuple[int, ...], frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f): phrases of some numbers of words of some pieces, each once, with the copies they occur in summed.

    frequent: the map of frequent phrases of so many words as the shortest has, less one. A phrase with a part of these
    that is infrequent is infrequent as well, and left out; parts that only share a frequent one's place stay.
    """
    of_lang = langs.dictionary_encode()
    words = pc.split_pattern(texts.cast(pa.large_string()), " ")
    ends = words.offsets.to_numpy()
    coded = words.flatten().dictionary_encode()
    size = np.diff(ends)
    piece = np.repeat(np.arange(len(size)), size)
    word = coded.indices.to_numpy()
    # A word of a language: numbers of both in one, then numbers without gaps.
    lang_of = of_lang.indices.to_numpy()[piece].astype(np.int64)
    both = pa.array(lang_of * len(coded.dictionary) + word).dictionary_encode()
    number, kinds = both.indices.to_numpy().astype(np.int64), both.dictionary.to_numpy()
    left = ends[1:][piece] - np.arange(len(piece))  # words from here to the piece's end
    copies = copies.to_numpy()
    part = sizes[0] - 1
    if frequent is not None and len(kinds):
        lang, spelled = np.divmod(kinds, len(coded.dictionary))
        one, start = _hashes(coded.dictionary)[spelled][number], _hashes(of_lang.dictionary)[lang][number]
        h = start
        for k in range(part):
            h = _joined(h[: len(one) - k], one[k:])
        bit = _bit(h)
        known = (frequent[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    for n in sizes:
        at = np.flatnonzero(left >= n)
        if frequent is not None and len(at):
            for k in range(n - part + 1):
                at = at[known[at + k]]
        key = number[at]
        for k in range(1, n):
            dense = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64) if k > 1 else key
            key = dense * len(kinds) + number[at + k]
        summed = pa.table({"key": key, "f": copies[piece[at]], "at": at}).group_by("key", use_threads=False).aggregate([("f", "sum"), ("at", "min")])
        first = summed["at_min"].to_numpy()
        spelled = [coded.dictionary.take(pa.array(word[first + k])) for k in range(n)]
        phrase = spelled[0] if n == 1 else pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string()))
        lang = of_lang.dictionary.take(pa.array(lang_of[first]))
        yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), summed["f_sum"].combine_chunks().cast(pa.int64())], ["lang", "phrase", "f"])


def occurrences(found: DataFrame, sizes: tuple[int, ...], frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f) of phrases of these numbers of words, counted within each about TOGETHER words of a task: a phrase has a row for each of these."""
    shared = None if frequent is None else found.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if shared is None else shared.value
        held: list[pa.RecordBatch] = []
        grams = lambda: _grams(*(pa.concat_arrays([b.column(c) for b in held]) for c in range(3)), sizes, frequent)
        for b in batches:
            for a, z in slices(b.column(1), 6 * TOGETHER):
                held.append(b.slice(a, z - a))
                if sum(x.column(1).nbytes for x in held) > 6 * TOGETHER:
                    yield from grams()
                    held.clear()
        if held:
            yield from grams()

    return found.select("lang", "piece", "copies").mapInArrow(run, "lang string, phrase string, f long")


def counted(rows: DataFrame, least: int, buckets: int, spill: str) -> DataFrame:
    """(lang, phrase, f, place) of phrases that occur least times: rows dealt to hash buckets, each summed by duckdb.

    duckdb reads a bucket as it arrives and keeps a row a phrase, out of core in the folder `spill` (of the shared file
    system; None: in memory) where these do not fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import shutil
        import uuid

        import duckdb

        own = spill and f"{spill}/{uuid.uuid4().hex}"
        db = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False} | ({"memory_limit": "400MB", "temp_directory": own} if own else {}))
        try:
            schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
            bucket = pa.RecordBatchReader.from_batches(schema, (pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches))  # noqa: F841  read by name
            found = db.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM bucket GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
            for b in found.to_arrow_reader(1 << 16):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2), pa.array(places(b.column(0), b.column(1)))], ["lang", "phrase", "f", "place"])
        finally:
            db.close()
            if own and os.path.isdir(own):
                shutil.rmtree(own, ignore_errors=True)

    return rows.repartition(buckets, "lang", "phrase").mapInArrow(run, "lang string, phrase string, f long, place long")


def frequent_map(found: DataFrame) -> np.ndarray:
    """The MAP_BITS bits of frequent phrases' places, made by Spark in rows of ROW_BITS bits."""
    low = F.col("place") % ROW_BITS
    rows = found.groupBy(F.floor(F.col("place") / ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(low).alias("bits")).collect()
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in rows:
        out[r["row"] * (ROW_BITS // 8) : (r["row"] + 1) * (ROW_BITS // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def frequent_phrases(found: DataFrame, least: int, longest: int, n_words: int) -> DataFrame:
    """(lang, phrase, words, f): all phrases of up to `longest` words that occur `least` times in `found`, a table of pieces.

    Words are counted first, then pairs of frequent words, then all longer phrases whose pairs are frequent, as every
    part of a frequent phrase is. What may be frequent is told by a map of fixed size: where the frequent phrases outgrow
    it, more phrases are counted, and the result is the same.
    """
    spark = found.sparkSession
    folder = work_dir(spark, "phrases-spill")
    spill = re.sub("^file:(//)?", "", folder) if folder.startswith(("file:", "/")) else None
    buckets = max(math.ceil(n_words / PER_BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out, frequent = None, None
    for sizes in filter(None, ((1,), (2,)[: longest - 1], tuple(range(3, longest + 1)))):
        level = written(counted(occurrences(found, sizes, frequent), least, buckets, spill), f"phrases-{sizes[0]}")
        if sizes[-1] < longest:
            frequent = frequent_map(level)
        level = level.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")
        out = level if out is None else out.unionByName(level)
    return out


def _part(phrase: str, a: str, n: str) -> str:
    """SQL of n words of a phrase from word a (from 1) on."""
    return f"array_join(slice(split({phrase}, ' '), {a}, {n}), ' ')"


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words and more; phrases: (lang, phrase, words, f), a table with all their parts.

    Each cut asks for the counts of its two parts: requests are shuffled to where the part's count lies, and the
    answers to the phrase. Products are decimals of 38 places.
    """
    long = phrases.filter("words > 1")
    cut = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    asked = cut.select("lang", "phrase", "words", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.expr(_part("phrase", "1", "k")).alias("part")), F.struct(F.lit(False).alias("first"), F.expr(_part("phrase", "k + 1", "words - k")).alias("part")),
    )).alias("q")).select("lang", "phrase", "words", "a", "k", "q.first", "q.part")
    counts = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("count"))
    answered = asked.join(counts, (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_part")))
    cuts = answered.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("first"), F.col("count"))).alias("l"), F.max(F.when(~F.col("first"), F.col("count"))).alias("r"))
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best.alias("b")).select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def without_contained(candidates: DataFrame, phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates that stand in no longer phrase which occurs percent times as often or more; phrases may be dropped ones."""
    long = phrases.filter("words > 2").select("lang", "words", "phrase", "f", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    inner = long.select("lang", "words", "phrase", "f", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("at"))
    around = inner.select("lang", F.expr(_part("phrase", "at", "n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    d = candidates.join(around, ["lang", "phrase"], "left")
    return d.filter(F.col("around").isNull() | (F.expr("CAST(100 AS DECIMAL(38,0)) * around") < F.expr(f"CAST({int(percent)} AS DECIMAL(38,0)) * a"))).drop("around")


def first_of_each(d: DataFrame, top: int, n_rows: int) -> DataFrame:
    """The first `top` rows of each language with their rank. Buckets of PER_CHOICE rows or `top` keep their first ones, then sixteen buckets theirs, until one is left."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    buckets = max(1, math.ceil(n_rows / max(PER_CHOICE, 2 * top)))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    while buckets > 1:
        d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank")
        d, buckets = d.withColumn("bucket", F.floor(F.col("bucket") / 16)), math.ceil(buckets / 16)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return d.filter(F.col("rank") <= top).drop("bucket")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, percent: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score, then a, then phrase.

    Texts are lower-cased (A-Z), cut at .,;:!? and line ends, and in words at spaces and tabs. Phrases have 2 to
    `longest` words and occur a >= `least` times in a language (null: und), within pieces and with overlaps; n: the
    language's words. Cutting a phrase after k words gives l and r, the counts of its parts, and the score
    floor(2000000 a / (l + r)); the lowest-scoring cut counts, the first on ties. Phrases within a longer one that
    occurs percent times as often or more, dropped or not, are dropped. Null, empty and wordless texts count for
    nothing; repeated rows are texts each; an empty table gives no rows; other columns are ignored, and no id is asked
    for. Pieces that are equal are counted once with their number, so copies cost no more than their reading; a piece is
    looked at whole, so memory follows the longest one.
    """
    found = written(pieces(docs, text_col, lang_col), "phrase-pieces")
    totals = written(found.groupBy("lang").agg(F.sum((F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1) * F.col("copies")).alias("n"), F.sum(F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).alias("words")), "phrase-totals")
    phrases = frequent_phrases(found, least, longest, totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    kept = written(without_contained(scored(phrases), phrases, percent), "phrase-scores")
    dropped(found, phrases)
    ranked = first_of_each(kept, top, kept.count())
    return ranked.join(totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
