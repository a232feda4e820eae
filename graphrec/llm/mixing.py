"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, buckets_for, n_words, written

MAX_REPEATS = 3


def _first_bits(h: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a long; keeps the digests' order."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(src_null, src_key, source_size) plus weight and target.

    Sources in code-point order, null last, weigh `weights` in turn and share the sum of all sizes. A target stops at
    MAX_REPEATS times its source's size and the rest is shared again: with sources in order of limit per weight, the
    stopped ones come first, so one pass over running sums gives the level that all others reach. The table has one
    row per source.
    """
    by_name = Window.orderBy("src_null", "src_key")
    d = sources.withColumn("place", F.row_number().over(by_name) - 1)
    d = d.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    d = d.withColumn("limit", F.col("source_size") * MAX_REPEATS)
    order = Window.orderBy((F.col("limit") / F.col("weight")), "place")
    below, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    d = d.withColumn("all_words", F.sum("source_size").over(everything))
    d = d.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("limit").over(below), F.lit(0))) / F.sum("weight").over(onward))
    d = d.withColumn("level", F.min(F.when(F.col("limit") >= F.col("weight") * F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("place"), F.col("level").alias("level")))).over(everything)["level"])
    return d.withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level"))).select("src_null", "src_key", "source_size", "place", "weight", "target")


def quotas(with_targets: DataFrame, block_words: int, shards: int) -> DataFrame:
    """Adds `seats`: by shard, how many blocks of block_words words each source has in that shard and those before.

    The house has round(all words / block_words) seats, of which shard s ends at a share of s + 1 in `shards`. Each
    seat goes to the highest quotient target / (2 k + 1). A divisor method never takes seats away as the house grows,
    so the differences between shards are quotas of each shard. Only quotients near the last seat are ranked: seats lie
    between floor(target / d + 1/2) for a d that gives too few and one that gives too many, which leaves about two
    quotients a source. No source gets more seats than fit into MAX_REPEATS times its size.
    """
    everything = Window.partitionBy(F.lit(0))
    d = with_targets.withColumn("votes", F.sum("target").over(everything)).withColumn("n", F.sum(F.when(F.col("target") > 0, 1).otherwise(0)).over(everything))
    d = d.withColumn("most", F.floor(F.col("source_size") * MAX_REPEATS / F.lit(block_words)).cast("long"))
    d = d.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    d = d.withColumn("house", F.floor(F.floor(F.col("votes") / block_words + 0.5) * (F.col("shard") + 1) / shards))
    few = F.when((F.col("house") > F.col("n") / 2) & (F.col("votes") > 0), F.floor(F.col("target") * (F.col("house") - F.col("n") / 2) / F.greatest(F.col("votes"), F.lit(1e-9)) + 0.5) - 1).otherwise(0)
    many = F.when(F.col("votes") > 0, F.floor(F.col("target") * (F.col("house") + F.col("n") / 2) / F.greatest(F.col("votes"), F.lit(1e-9)) + 0.5) + 1).otherwise(0)
    d = d.withColumn("few", F.least(F.greatest(few, F.lit(0)), F.col("most")).cast("long")).withColumn("many", F.least(many, F.col("most")).cast("long"))
    open_seats = F.col("house") - F.sum("few").over(Window.partitionBy("shard"))
    d = d.withColumn("open", open_seats)
    k = d.filter("many > few AND target > 0").select("shard", "place", "open", "target", F.explode(F.sequence(F.col("few"), F.col("many") - 1)).alias("k"))
    rank = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "place")
    won = k.withColumn("rank", F.row_number().over(rank)).filter("rank <= open").groupBy("shard", "place").agg(F.count(F.lit(1)).alias("won"))
    d = d.join(won, ["shard", "place"], "left").withColumn("total", F.col("few") + F.coalesce("won", F.lit(0)))
    seats = d.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "total"))), lambda x: x["total"]).alias("seats"))
    return with_targets.join(seats, "place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = (1, 2, 3), block_words: int = 16, shards: int = 8, seed: str = "mix-1", rows_per_bucket: int = 5_000, keep_text: bool = False) -> DataFrame:
    """How much of each document the mix takes.

    A source's documents lie in the order of a seeded digest of their ids (of null ids: their texts), end to end, as a
    ring of words; rows of one id by size, then by a hash of the text, so that reruns take the same texts. The source's
    blocks are the consecutive runs of block_words words from a seeded start, round the ring as often as its quota asks
    for. So the words taken of a document are the overlap of two intervals plus whole rounds; no block is ever listed.
    Positions are running sums within (source, range of digests) plus the sums of the ranges before, so a source that
    holds most rows is spread over many tasks.

    Returns per document id_col, size, source_size, target, taken, shard (where its first taken word goes, null if none),
    and whole (rounds), head, tail_from, tail (words taken besides: the first `head` ones and `tail` ones after
    `tail_from`); with keep_text all of docs' own columns too. Null ids and null texts are allowed (size 0), null is a
    source of its own, repeated rows count each; an empty table gives an empty result. Columns of docs are read by name
    before any is added, so clashing names do no harm.
    """
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)] if keep_text else []
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("|"), F.col(text_col)), F.lit(""))).cast("binary"))
    n = buckets_for(docs, rows_per_bucket)
    d = docs.select(
        *own, F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("size"), F.col(source_col).isNull().alias("src_null"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src_key"), digest.alias("digest"), F.xxhash64(text_col).alias("tie")
    ).withColumn("bucket", F.floor(_first_bits(F.col("digest")) * n / F.lit(2**32)).cast("int"))
    if not keep_text:  # without texts the rows are thin: one pass over docs makes them
        d = written(d, "mix-rows")
    sums = d.groupBy("src_null", "src_key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src_null", "src_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sources = sums.groupBy("src_null", "src_key").agg(F.sum("words").alias("source_size"))
    plan = quotas(targets(sources, weights), block_words, shards)
    plan = plan.withColumn("words_taken", F.element_at("seats", -1) * block_words)
    start = _first_bits(F.md5(F.concat(F.lit(f"{seed}|start|"), F.col("src_key")).cast("binary")))
    plan = plan.withColumn("start", F.when(F.col("source_size") > 0, start % F.greatest(F.col("source_size"), F.lit(1))).otherwise(0))
    starts = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(plan, ["src_null", "src_key"])
    within = Window.partitionBy("src_null", "src_key", "bucket").orderBy("digest", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(within)).join(starts, ["src_null", "src_key", "bucket"])
    z, whole_ring = F.col("source_size"), F.greatest(F.col("source_size"), F.lit(1))
    at = F.pmod(F.col("base") + F.col("upto") - F.col("size") - F.col("start"), whole_ring)
    d = d.withColumn("at", at).withColumn("whole", F.expr("words_taken div greatest(source_size, 1)")).withColumn("rest", F.col("words_taken") % whole_ring)
    zero = F.lit(0).cast("long")
    d = d.withColumn("head", F.greatest(zero, F.least(F.col("size"), F.col("rest") - F.col("at"))))
    d = d.withColumn("tail_from", F.least(F.col("size"), z - F.col("at"))).withColumn("tail", F.greatest(zero, F.least(F.col("size") - F.col("tail_from"), F.col("rest"))))
    d = d.withColumn("taken", F.when(F.col("size") > 0, F.col("whole") * F.col("size") + F.col("head") + F.col("tail")).otherwise(0).cast("long"))
    first = F.when((F.col("tail") > 0) | ((F.col("tail_from") < F.col("size")) & (F.col("whole") > 0)), zero).otherwise(F.expr(f"at div {block_words}"))
    d = d.withColumn("first", first).withColumn("shard", F.when(F.col("taken") > 0, F.size(F.filter("seats", lambda s: s <= F.col("first")))))
    names = [F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)] if keep_text else [F.col("id").alias(id_col)]
    return d.select(*names, *[F.col(c).alias(f"mix_{c}" if keep_text else c) for c in ("size", "source_size", "target", "taken", "shard", "whole", "head", "tail_from", "tail")])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars", **options: object) -> DataFrame:
    """The mix itself: docs' columns, one row for each time that a document, or a part of one, is taken.

    Whole documents keep their text as it is; a part is its words with a space between. count_col, where docs has it,
    is counted anew. Documents of which nothing is taken go: null, empty and wordless ones always. Null ids and repeated
    rows are documents each, an empty table gives no rows, other columns keep their names and values.
    """
    names = [f"doc_{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    d = mix(docs.toDF(*names), of[id_col], of[text_col], of[source_col], keep_text=True, **options)
    text = of[text_col]
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    part = lambda since, n: F.when(n > 0, F.when(n == F.col("mix_size"), F.col(text)).otherwise(F.array_join(F.slice(words, (since + 1).cast("int"), n.cast("int")), " ")))
    copies = F.concat(F.when(F.col("mix_whole") > 0, F.array_repeat(text, F.col("mix_whole").cast("int"))).otherwise(F.array().cast("array<string>")), F.array(part(F.lit(0), F.col("mix_head")), part(F.col("mix_tail_from"), F.col("mix_tail"))))
    d = d.filter("mix_taken > 0").withColumn("mix_text", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    new = {text_col: F.col("mix_text")}
    if count_col in docs.columns:
        new[count_col] = F.length("mix_text").cast(docs.schema[count_col].dataType)
    return d.select(*[new.get(c, F.col(n)).alias(c) for c, n in of.items()])
