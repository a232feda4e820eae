"""Site-relative line frequency: lines on too large a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BLANK = " \t\r\v\f"


def host_of(site: Column) -> Column:
    """The lower-case host of a URL, without user and port; other names of sites as they are."""
    named = F.regexp_extract(site, r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(named != "", F.lower(named)).otherwise(site)


def _hash(line: Column) -> Column:
    """A line's key: without white space at its ends; null if nothing is left."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate_lines(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(site, line): lines on more than max_ratio of their site's pages and on min_pages of them at least.

    pages has site and lines (the keys of its different lines). Counts are partial sums before the shuffle, so a site
    or a line of most pages costs a task no more than any other.
    """
    totals = written(pages.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")), "line-sites")
    on = pages.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("on_pages"))
    return on.filter(F.col("on_pages") >= min_pages).join(totals, "site").filter(F.col("on_pages") > F.col("site_pages") * max_ratio).select("site", "line")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, max_ratio: float = 0.05, min_pages: int = 2, report: bool = False) -> DataFrame:
    """docs without the lines that exceed max_ratio of their site's pages; with `report` n_lines and n_dropped too.

    A page's site is the host where site_col has URLs, else what it holds; null is a site, every row is a page of its
    site. A line on one page only is no repetition: min_pages asks for two. Lines are compared without white space at
    their ends; blank lines are never dropped; what stays is joined by line feeds as before.

    Texts are split twice, once for line keys, which alone are shuffled, and once to drop lines. The lines to drop are a
    list a site, which holds at most 1 / max_ratio times as many as the site's pages have on average; texts meet it by
    broadcast where Spark finds the table small, else in a plain join on the site, of which adaptive execution splits
    large ones. Null texts stay null; null ids, repeated rows and empty tables are allowed; columns of docs keep their
    names and values, whatever they are called.
    """
    names = [f"own_{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    d = docs.toDF(*names)
    text = F.col(of[text_col])
    where = F.xxhash64(F.coalesce(F.concat(F.lit("s"), host_of(F.col(of[site_col]).cast("string"))), F.lit("")))
    split = F.split(text, "\n")
    thin = written(d.select(where.alias("site"), F.array_compact(F.array_distinct(F.transform(F.coalesce(split, F.array().cast("array<string>")), _hash))).alias("lines")), "line-keys")
    drop = written(boilerplate_lines(thin, max_ratio, min_pages).groupBy("site").agg(F.collect_list("line").alias("drop")), "line-drop")
    out = d.withColumn("site", where).join(drop, "site", "left")
    keep = F.filter(split, lambda x: ~F.coalesce(F.array_contains(F.col("drop"), _hash(x)), F.lit(False)))
    out = out.withColumn("kept", F.when(F.col("drop").isNull(), split).otherwise(keep))
    cleaned = F.when(F.col("drop").isNull(), text).otherwise(F.array_join("kept", "\n"))
    extra = [F.when(text.isNull(), 0).otherwise(x).cast("long").alias(n) for x, n in ((F.size(split), "n_lines"), (F.size(split) - F.size("kept"), "n_dropped"))] if report else []
    return out.select(*[(cleaned if c == text_col else F.col(of[c])).alias(c) for c in docs.columns], *extra)


def recounted(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with count_col, where there is one, counted anew from the text (null for a null text)."""
    if count_col not in docs.columns:
        return docs
    return docs.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
