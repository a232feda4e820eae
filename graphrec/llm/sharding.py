"""K-d tree sharding: recursive splits at distributed weighted medians. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, numbered, written

#: Coordinates are integers below 2 ** BITS; a median is found by reading STEP bits in each pass.
BITS, STEP = 36, 12
#: Default of `slack`: a median may miss its goal by this share of its node's weight before the next widest dimension is preferred.
SLACK = 0.002


def coordinates() -> dict[str, Column]:
    """Metadata dimensions of a text group (columns bytes, first_id, digest, lang, source), each in [0, 1)."""
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20)
    return {
        "length": F.least(F.log2(F.col("bytes") + 1.0) / 40.0, F.lit(1 - 1e-9)),
        "id": F.pmod(F.coalesce("first_id", F.lit(0)), F.lit(1 << 40)) / float(1 << 40),
        "source": spread(F.col("source")),
        "lang": spread(F.col("lang")),
    }


def _medians(here: DataFrame, splits: list[dict]) -> None:
    """Sets at (the cut), below (weight under it) and miss of each split: BITS / STEP jobs over all of them.

    Each job sums weights in at most 2 ** STEP bins a split; Spark finds the bin that holds the goal, so what reaches the
    driver is one row a split.
    """
    for shift in range(BITS - STEP, -1, -STEP):
        bins = []
        for i, s in enumerate(splits):
            c = place(s) - F.lit(s["at"])
            inside = (F.col("node") == s["node"]) & (c >= 0) & (c < (1 << (shift + STEP)))
            bins.append(F.when(inside, F.struct(F.lit(i).alias("split"), F.shiftright(c, shift).alias("bin"), F.lit(float(s["goal"] - s["below"])).alias("need"))))
        cells = here.select("weight", F.explode(F.array_compact(F.array(*bins))).alias("c")).select("weight", "c.*")
        sums = cells.groupBy("split", "bin", "need").agg(F.sum("weight").alias("w"))
        sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("split").orderBy("bin")))
        found = sums.groupBy("split").agg(F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "w"))).alias("hit"), F.max(F.struct("bin", "upto", "w")).alias("last")).collect()
        for r in found:
            s, hit = splits[r["split"]], r["hit"] or r["last"]  # last: rounding
            need, under = s["goal"] - s["below"], hit["upto"] - hit["w"]
            # In the last pass whichever side of the bin is nearer.
            over = shift == 0 and abs(hit["upto"] - need) < abs(under - need)
            s["at"] += hit["bin"] + 1 if over else hit["bin"] << shift
            s["below"] += hit["upto"] if over else under
    for s in splits:
        s["miss"] = abs(s["below"] - s["goal"])


def tree(groups: DataFrame, dims: list[str], leaves: int, target_bytes: float | None = None, slack: float = SLACK) -> list[dict]:
    """Splits of a k-d tree over groups (columns digest, dims, tie, weight) into leaves of near equal weight.

    Each node splits along its widest dimension (by the range of its groups, as a share of the whole range) at the
    weighted median that leaves each side its share of the leaves. Where a heavy group lies across that median, so that it
    misses its goal by more than `slack` of the node's weight, the next widest dimension whose median does not is taken, or
    the one that misses least; with slack=1 it is always the widest. `rank` of a split tells which was taken (0: the widest). Equal coordinates are parted by `tie`, an even hash. A group of at least a leaf's weight,
    which no cut can divide, is a leaf of its own, split off by its digest. A level takes one job for ranges, one for such
    groups (fewer than leaves) and BITS / STEP for the medians of all dimensions. A node stops at one leaf, or at
    target_bytes or less if given.
    """
    made: list[dict] = []
    nodes = {1: leaves}
    low = groups.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    if low is None or low[f"lo_{dims[0]}"] is None:
        return made
    whole = {d: max(low[f"hi_{d}"] - low[f"lo_{d}"], 1e-12) for d in dims}
    while nodes:
        here = groups.withColumn("node", locate(made)).filter(F.col("node").isin(list(nodes)))
        figures = [F.sum("weight").alias("weight"), F.max(F.struct("weight", "digest")).alias("top"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]]
        new, asked = [], []
        for r in here.groupBy("node").agg(*figures).collect():
            n = nodes[r["node"]]
            if n < 2 or (target_bytes and r["weight"] <= target_bytes):
                continue
            if r["top"]["weight"] * n >= r["weight"]:
                new.append({"node": r["node"], "own": r["top"]["digest"], "own_weight": r["top"]["weight"], "left": 1, "right": n - 1})
                continue
            wide = sorted(dims, key=lambda d: (-(r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d], d))
            asked += [{"node": r["node"], "own": None, "dim": d, "lo": r[f"lo_{d}"], "hi": r[f"hi_{d}"], "left": n // 2, "right": n - n // 2, "weight": r["weight"], "goal": r["weight"] * (n // 2) / n, "at": 0, "below": 0, "rank": i} for i, d in enumerate(wide)]
        if asked:
            _medians(here, asked)
        for node in dict.fromkeys(s["node"] for s in asked):
            mine = [s for s in asked if s["node"] == node]
            new.append(next((s for s in mine if s["miss"] <= slack * s["weight"]), None) or min(mine, key=lambda s: s["miss"]))
        made += new
        nodes = {child: s[side] for s in new for child, side in ((2 * s["node"], "left"), (2 * s["node"] + 1, "right"))}
    return made


def place(s: dict) -> Column:
    """Where a group lies between its node's ends along the split's dimension, ties parted: an integer below 2 ** BITS."""
    coarse = F.floor((F.col(s["dim"]) - F.lit(s["lo"])) / F.lit(max(s["hi"] - s["lo"], 1e-12)) * ((1 << 16) - 1))
    return F.shiftleft(F.least(F.greatest(coarse, F.lit(0)), F.lit((1 << 16) - 1)).cast("long"), BITS - 16) + F.col("tie")


def locate(splits: list[dict]) -> Column:
    """The node of each group after these splits: a nested CASE over the tree."""
    by = {s["node"]: s for s in splits}

    def under(node: int) -> Column:
        s = by.get(node)
        if s is None:
            return F.lit(node)
        left = F.col("digest") == s["own"] if s["own"] is not None else place(s) < s["at"]
        return F.when(left, under(2 * node)).otherwise(under(2 * node + 1))

    return under(1)


def leaf_numbers(splits: list[dict], leaves: int) -> dict[int, int]:
    """Leaf node -> shard number, from left to right."""
    by, out = {s["node"]: s for s in splits}, {}

    def walk(node: int, first: int, n: int) -> None:
        if node in by:
            walk(2 * node, first, by[node]["left"])
            walk(2 * node + 1, first + by[node]["left"], by[node]["right"])
        else:
            out[node] = first

    walk(1, 0, leaves)
    return out


def text_groups(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """(digest, weight, tie, a column a dimension) of the distinct texts of rows (id, size, digest, lang, source), and the dimensions."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.max("size").alias("bytes"), F.min("id").alias("first_id"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    dims = coordinates()
    tie = F.conv(F.substring("digest", 1, (BITS - 16) // 4), 16, 10).cast("long")
    return groups.select("digest", "weight", tie.alias("tie"), *[c.alias(f"x_{k}") for k, c in dims.items()]), [f"x_{k}" for k in dims]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 5_000, slack: float = SLACK) -> DataFrame:
    """Puts every document into one of `shards` leaves of a k-d tree of near equal bytes; equal texts share a leaf.

    Points are the distinct texts, weighted by the bytes of all their copies, so copies stay together (a text that
    alone outweighs a leaf makes that leaf larger). slack: see tree. Returns id_col, size (UTF-8 bytes and 1), text_crc32, law ('bytes'),
    shard, slot (0, 1... within the shard), grown_shard (null). A null text has no bytes: size 1, crc32 0, a group with
    the empty one. Texts are read once, whole, by built-in functions. Null ids, repeated rows (each its own slot) and
    empty tables are allowed; lang and source count if docs has them, all other columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    meta = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    d = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("digest"), *meta)
    d = written(d, "shard-rows")
    groups, dims = text_groups(d)
    groups = written(groups, "shard-groups")
    splits = tree(groups, dims, shards, slack=slack)
    which = F.lit(0)
    for node, n in leaf_numbers(splits, shards).items():
        which = F.when(F.col("node") == node, n).otherwise(which)
    placed = written(groups.withColumn("node", locate(splits)).select("digest", which.cast("int").alias("shard")), "shard-of")
    rows = written(d.join(placed, "digest").select("id", "size", "text_crc32", "shard"), "shard-placed")
    dropped(d, groups, placed)
    rows = numbered(rows, ["shard"], ["id", "size", "text_crc32"], "slot", rows_per_bucket)
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
