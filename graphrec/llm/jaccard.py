"""Jaccard join of shingle sets, by relations between sets.

Only sets that can have a partner, and of these only differences from a similar set, meet in joins:

1. Equal sets are one node. Shingles are counted over all nodes; a set links only if nearly all its shingles have a
   second owner, so most sets end here.
2. The rest order their shingles by frequency and list themselves under their rarest ones (two linked sets always
   share one of these). Each list has a leader: the set with the shingle at the earliest position. Sets are compared
   with the leaders of their lists only, so lists of thousands of near copies give thousands of pairs.
3. Answers of other pairs in a list follow from the leader's: with both sets' differences from the leader, their overlap
   is a sum of known sizes and the overlap of the differences. Only sets not linked with their leader ask, in blocks, and
   index lists are skipped by position: entries are in order of set size, those outside the possible sizes are passed over.

Words, shingles and sets are told by 64-bit hashes; but for coincidences of these the answer is exact.

Counting goes by cells of the hash space, whose number follows from the bytes of all texts, so a cell's shingles fit in a
task at any size. Up to MAX_PARTS cells each is a part of the shuffle; beyond, a part holds several cells, which its task
tells apart and Spark sorts on disk before they are counted one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import returning
from ..operators.components import connected_components, contracted, stars
from .shared import dropped, written

SHINGLE_WORDS = 5
#: Bytes of text whose shingles make a cell; parts of a shuffle.
CELL_BYTES, MAX_PARTS = 6_000_000, 16_384
#: Shingles gathered before a task passes them on; owners in one such gathering from which a shingle counts as common.
GATHER, COMMON = 1_000_000, 16
#: Texts of a batch that are strings of Python at a time.
TEXTS = 64
#: Frequencies are kept in a byte; the highest stands for common shingles.
MOST, COMMON_CLASS = 254, 255
BLOCK_MEMBERS, BLOCK_ASKING = 1024, 512
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit hashes of a text's different shingles, sorted. A text with fewer words is one shingle, without any none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    c = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ c[i : len(c) - k + 1 + i]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return np.unique(h ^ h >> np.uint64(32))


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def cells_for(text_bytes: int) -> tuple[int, int]:
    """(parts, cells in a part) for so many bytes of text."""
    cells = max(1, math.ceil(text_bytes / CELL_BYTES))
    inside = math.ceil(cells / MAX_PARTS)
    return math.ceil(cells / inside), inside


#: Rows between the first steps, of one cell of a part each: kind 0 has shingles of nodes, 1 documents, 2 common shingles, 3 nodes' common shingles.
_PACKED = "part int, cell int, kind int, nodes binary, sizes binary, counts binary, hashes binary, classes binary"
_COLUMNS = [c.split()[0] for c in _PACKED.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _split(where: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, indexes in order) of each place that occurs in where, numbers below n."""
    order = np.argsort(where.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    edges = np.append(0, np.cumsum(np.bincount(where, minlength=n)))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def _entries(place: tuple[int, int], kind: int, nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, classes: np.ndarray | None) -> tuple:
    """A row of entries (nodes[i] has hashes[i]), those of a node side by side."""
    first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])[: len(nodes)])
    counts = np.diff(np.append(first, len(nodes)))
    return *place, kind, nodes[first].astype("<i8").tobytes(), sizes[first].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), hashes.astype("<u8").tobytes(), b"" if classes is None else classes.astype("u1").tobytes()


def _opened(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes, hashes, classes) by entry of rows of entries."""
    joined = lambda c, kind: np.frombuffer(b"".join(b[c]), kind)
    counts = joined("counts", "<u4")
    return np.repeat(joined("nodes", "<i8"), counts), np.repeat(joined("sizes", "<u4"), counts).astype(np.int64), joined("hashes", "<u8"), joined("classes", np.uint8)


def _of_shingle(h: np.ndarray, modulus: int) -> np.ndarray:
    x = h >> np.uint64(31)
    x ^= h
    x %= np.uint64(modulus)
    return x.view(np.int64)


def _of_node(nodes: np.ndarray, modulus: int) -> np.ndarray:
    return _of_shingle(nodes.astype(np.int64).view(np.uint64), modulus)


def scatter(docs: DataFrame, parts: int, inside: int, words: int) -> DataFrame:
    """Documents' sets as packed rows by the shingles' part (cell 0 where parts have several). docs: id (text), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        sets: list[np.ndarray] = []
        ids, docs_nodes, docs_sizes, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = []
            for null in (False, True):
                at = [i for i, x in enumerate(ids) if (x is None) == null]
                if at:
                    numbers = np.array([0 if null else int(ids[i]) for i in at], dtype="<i8")
                    rows.append((int(abs(int(numbers[0])) % parts), 0, 1, numbers.tobytes(), np.array([docs_sizes[i] for i in at], dtype="<u4").tobytes(), b"", np.array([docs_nodes[i] for i in at], dtype="<i8").tobytes(), b"null" if null else b""))
            if sets:
                nodes, sizes = np.fromiter(seen, dtype=np.int64), np.array([len(s) for s in sets])
                h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
                sets.clear()
                # A shingle of COMMON sets here: its owners need not meet to know that it has others.
                low = (h >> np.uint64(28)).astype(np.int32) & 0xFFFFF
                maybe = np.flatnonzero(np.bincount(low, minlength=1 << 20)[low] >= COMMON)
                if len(maybe):
                    u, n = np.unique(h[maybe], return_counts=True)
                    u = u[n >= COMMON]
                    common = maybe[np.isin(h[maybe], u)]
                    if len(u):
                        rows += [(p, 0, 2, b"", b"", b"", u[at].astype("<u8").tobytes(), b"") for p, at in _split(_of_shingle(u, parts * inside) // inside, parts)]
                        to = _of_node(nodes, parts * inside) // inside
                        for p, at in _split(to[owner[common]], parts):
                            e = common[at]
                            rows.append(_entries((p, 0), 3, nodes[owner[e]], sizes[owner[e]], h[e], np.full(len(e), COMMON_CLASS)))
                        rest = np.ones(len(h), dtype=bool)
                        rest[common] = False
                        h, owner = h[rest], owner[rest]
                for p, e in _split(_of_shingle(h, parts * inside) // inside, parts):
                    rows.append(_entries((p, 0), 0, nodes[owner[e]], sizes[owner[e]], h[e], None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] * 3 + [pa.binary()] * 5)], _COLUMNS)

        for b in batches:
            for at in range(0, len(b), TEXTS):
                for doc, text in zip(*(b.column(c).slice(at, TEXTS).to_pylist() for c in ("id", "text"))):
                    h = shingles(text, words)
                    node = node_of(h) if len(h) else 0
                    ids.append(doc)
                    docs_nodes.append(node)
                    docs_sizes.append(len(h))
                    if len(h) and node not in seen:
                        seen[node] = len(h)
                        sets.append(h)
                        total += len(h)
                    if total >= GATHER or len(ids) >= 100_000:
                        yield flush()
                        seen, sets, ids, docs_nodes, docs_sizes, total = {}, [], [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(returning(run), _PACKED)


def _cells_apart(whole: int, inside: int, by_node: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of a part's entries packed anew by cell, GATHER entries at a time; `whole`: cells of all parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[tuple]] = {}
        size = 0

        def flush() -> pd.DataFrame:
            rows = []
            for (part, kind), some in held.items():
                b = _frame(some)
                if kind == 2:
                    h = np.frombuffer(b"".join(b["hashes"]), "<u8")
                    rows += [(part, c, 2, b"", b"", b"", h[at].tobytes(), b"") for c, at in _split(_of_shingle(h, whole) % inside, inside)]
                else:
                    nodes, sizes, h, classes = _opened(b)
                    for c, at in _split((_of_node(nodes, whole) if by_node else _of_shingle(h, whole)) % inside, inside):
                        rows.append(_entries((part, c), kind, nodes[at], sizes[at], h[at], classes[at] if len(classes) else None))
            return _frame(rows)

        for b in batches:
            for r in b.itertuples(index=False, name=None):
                if r[2] == 1 or (r[2] == 3 and not by_node):
                    yield _frame([r])
                    continue
                held.setdefault((r[0], r[2]), []).append(r)
                size += len(r[6]) // 8
                if size >= GATHER:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


def by_cell(packed: DataFrame, parts: int, inside: int, by_node: bool, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f on the rows of each cell, one after the other in the task of its part."""
    d = packed.repartitionById(parts, F.col("part"))
    if inside > 1:
        d = d.mapInPandas(returning(_cells_apart(parts * inside, inside, by_node)), _PACKED).sortWithinPartitions("part", "cell")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None
        for b in batches:
            keys = b[["part", "cell"]].to_numpy()
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for s, e in zip([0, *ends], [*ends, len(b)]):
                if s == e:
                    continue
                if held and tuple(keys[s]) != now:
                    yield f(pd.concat(held))
                    held = []
                now = tuple(keys[s])
                held.append(b.iloc[s:e])
        if held:
            yield f(pd.concat(held))

    return d.mapInPandas(returning(run), schema)


def count_owners(parts: int, inside: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a cell's shingles: those with two owners or more, with their frequency, packed anew by the owners' part."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = list(b[b["kind"].isin([1, 3])].itertuples(index=False, name=None))
        entries = b[b["kind"] == 0]
        if len(entries):
            node, size, h, _ = _opened(entries)
            common = np.unique(np.frombuffer(b"".join(b.loc[b["kind"] == 2, "hashes"]), "<u8"))
            order = np.argsort(h, kind="stable")
            h, node, size = h[order], node[order], size[order]
            known = np.isin(h, common) if len(common) else np.zeros(len(h), dtype=bool)
            pair = h[1:] == h[:-1]
            keep = np.append(False, pair) | np.append(pair, False) | known
            h, node, size, known = h[keep], node[keep], size[keep], known[keep]
            order = np.lexsort((node, h))
            h, node, size, known = h[order], node[order], size[order], known[order]
            once = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))[: len(h)]
            h, node, size, known = h[once], node[once], size[once], known[once]
            if len(h):
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                n = np.diff(np.append(first, len(h)))
                owners = np.repeat(n, n)
                keep = (owners > 1) | known
                kind = np.where(known, COMMON_CLASS, np.minimum(owners, MOST))[keep]
                h, node, size = h[keep], node[keep], size[keep]
                order = np.argsort(node, kind="stable")
                h, node, size, kind = h[order], node[order], size[order], kind[order]
                rows += [_entries((p, 0), 0, node[at], size[at], h[at], kind[at]) for p, at in _split(_of_node(node, parts * inside) // inside, parts)]
        return _frame(rows)

    return run


def survivors(b: pd.DataFrame) -> pd.DataFrame:
    """Of a cell's nodes: those that may have a partner, with their shingles from the rarest on, and the rarest ones."""
    node, size, h, kind = _opened(b)
    order = np.lexsort((h, kind, node))
    h, node, size = h[order], node[order], size[order]
    once = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))[: len(h)]
    h, node, size = h[once], node[once], size[once]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    rows = []
    for a, z in zip(first, np.append(first[1:], len(node))):
        n = int(size[a])
        rare, prefix = n - (z - a), n - (4 * n + 4) // 5 + 1
        if rare < prefix:
            mine = h[a:z].view(np.int64)
            rows.append((int(node[a]), n, int(rare), mine, mine[: prefix - rare]))
    return pd.DataFrame(rows, columns=["node", "n", "rare", "shared", "rarest"])


def compare_with_leader(pairs: DataFrame) -> DataFrame:
    """pairs: leader, l_n, l_shared, node, n, shared -> leader, l_size, node, n, linked, less, diff.

    less: how many of the leader's shingles node lacks; diff: these and those that only node has.
    """
    both = (F.col("l_size") - F.col("less")).cast("long")
    d = pairs.select("leader", "l_n", F.size("l_shared").alias("l_size"), "node", "n", F.array_except("l_shared", "shared").alias("lacks"), F.array_except("shared", "l_shared").alias("adds"))
    d = d.select("*", F.size("lacks").alias("less"), F.concat("lacks", "adds").alias("diff"))
    return d.select("leader", "l_size", "node", "n", (100 * both >= 80 * (F.col("l_n").cast("long") + F.col("n") - both)).alias("linked"), "less", "diff")


def links_by_difference(asking: pd.DataFrame, members: pd.DataFrame) -> list[tuple[int, int]]:
    """Linked pairs of asking rows with members of one leader, from their differences to it."""
    members = members.sort_values("n", kind="stable")
    n, less, nodes = (members[c].to_numpy(dtype=np.int64) for c in ("n", "less", "node"))
    diffs = [np.asarray(x, dtype=np.int64) for x in members["diff"]]
    sizes = np.array([len(x) for x in diffs])
    bits = max(1, int(len(members)).bit_length())
    # An index entry is its shingle's number and its owner's place in the order of size: the entries of a shingle whose
    # owners' sizes are possible for a set are a range.
    known, number = np.unique(np.concatenate(diffs or [np.zeros(0, np.int64)]), return_inverse=True)
    entries = np.sort(number.astype(np.int64) << bits | np.repeat(np.arange(len(members)), sizes))
    l_size, out = int(members["l_size"].iloc[0]), []
    for node, size, short, diff in zip(asking["node"], asking["n"].astype(int), asking["less"].astype(int), asking["diff"]):
        low, high = np.searchsorted(n, -(-4 * size // 5)), np.searchsorted(n, 5 * size // 4, side="right")
        if low >= high:
            continue
        mine = np.asarray(diff, dtype=np.int64)
        at = np.searchsorted(known, mine)
        mine = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == mine)] << bits if len(known) else at[:0]
        a, z = np.searchsorted(entries, mine | low), np.searchsorted(entries, mine + high)
        length = z - a
        at = np.repeat(a - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        shared = np.bincount((entries[at] & ((1 << bits) - 1)) - low, minlength=high - low)[: high - low]
        both = l_size - short - less[low:high] + shared
        hit = np.flatnonzero((100 * both >= 80 * (size + n[low:high] - both)) & (nodes[low:high] != node))
        out += [(int(node), int(x)) for x in nodes[low:high][hit]]
    return out


def links_beside_leaders(compared: DataFrame, parts: int) -> DataFrame:
    """(a, b): links between members of a leader of which one at least isn't linked with it, contracted in the task that finds them.

    A leader's members meet in blocks of bounded size: every asking member with every member. The leaders' counts are a
    table, so a leader of many members is a skewed key of a plain join, which adaptive execution splits.
    """
    sizes = compared.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("linked")).alias("asking")).filter("asking > 0 AND members > 1")
    blocks = written(sizes.select("leader", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("mb"), F.ceil(F.col("asking") / BLOCK_ASKING).cast("int").alias("ab")), "jaccard-blocks")
    d = compared.join(blocks, "leader")
    own = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["leader", "l_size", "node", "n", "less", "diff"]
    members = d.select(*cols, F.lit(False).alias("asks"), F.pmod(own, F.col("mb")).cast("int").alias("m"), every("ab").alias("a"))
    asking = d.filter("NOT linked").select(*cols, F.lit(True).alias("asks"), every("mb").alias("m"), F.pmod(own, F.col("ab")).cast("int").alias("a"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            g = pd.concat(held)
            asks = g["asks"].to_numpy()
            ends = np.array(links_by_difference(g[asks], g[~asks]) if asks.any() and not asks.all() else [], dtype=np.int64).reshape(-1, 2)
            for at in range(0, len(ends), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in ends[at : at + 10_000].T], ["a", "b"])

        for b in map(pa.RecordBatch.to_pandas, batches):
            ends = np.flatnonzero((b[["leader", "m", "a"]].to_numpy()[1:] != b[["leader", "m", "a"]].to_numpy()[:-1]).any(1)) + 1
            for s, e in zip([0, *ends], [*ends, len(b)]):
                if s == e:
                    continue
                now = tuple(b[["leader", "m", "a"]].iloc[s])
                if held and now != key:
                    yield from done()
                    held = []
                key = now
                held.append(b.iloc[s:e])
        if held:
            yield from done()

    met = members.unionByName(asking)
    n = max(parts, int(compared.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(n, "leader", "m", "a").sortWithinPartitions("leader", "m", "a").mapInArrow(returning(lambda batches: stars(found(batches))), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, n_shingles, component_id) of every document.

    Documents link when 100 * intersection >= 80 * union of their sets of `words`-word shingles (ASCII-lowered words
    between ASCII white space); component_id is the smallest id reachable. Null, empty and wordless texts have an
    empty set and are components of themselves. Null ids take part, but name no component (null if no other id is in
    it). Repeated rows are copies; an empty table gives no rows; other columns are ignored.

    Words, shingles and sets are told by 64-bit hashes. A text is one row of its task, so memory follows the longest
    text; a shingle owned by COMMON documents of those gathered at once is passed on by its owners, one that keeps below
    that everywhere has at most a share of COMMON in those documents.
    """
    text_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts, inside = cells_for(text_bytes)
    d = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    first = written(by_cell(scatter(d, parts, inside, words), parts, inside, False, count_owners(parts, inside), _PACKED), "jaccard-owners")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, sizes, nodes, null in zip(b["nodes"], b["sizes"], b["hashes"], b["classes"]):
                ids = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"id": pd.array(ids if null != b"null" else [None] * len(ids), dtype="Int64"), "n": np.frombuffer(sizes, "<u4").astype(np.int64), "node": np.frombuffer(nodes, "<i8")})

    all_docs = written(first.filter("kind = 1").mapInPandas(documents, "id long, n long, node long"), "jaccard-documents")
    sets = written(by_cell(first.filter("kind <> 1"), parts, inside, True, survivors, "node long, n int, rare int, shared array<long>, rarest array<long>"), "jaccard-sets")
    listed = sets.select("node", "n", F.posexplode("rarest").alias("place", "shingle"), "rare")
    position = F.struct((F.col("rare") + F.col("place")).alias("at"), (-F.col("n")).alias("less"), F.col("node"))
    leaders = listed.groupBy("shingle").agg(F.min(position)["node"].alias("leader"), F.count(F.lit(1)).alias("owners")).filter("owners > 1").drop("owners")
    # Tables on the side that has a key once leave the joins with nothing but a shuffle below them, so hot keys are split.
    leaders = written(leaders, "jaccard-leaders")
    pairs = listed.select("shingle", "node").join(leaders, "shingle").filter("leader <> node").select("leader", "node").distinct()
    mine, theirs = sets.select("node", "n", "shared"), sets.select(F.col("node").alias("leader"), F.col("n").alias("l_n"), F.col("shared").alias("l_shared"))
    compared = written(compare_with_leader(pairs.join(mine, "node").join(theirs, "leader")), "jaccard-compared")
    with_leaders = contracted(compared.filter("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    # Both are contracted as they are made: two steps in Python one after the other in a task take two workers a core,
    # which then stay with the executor.
    links = with_leaders.unionAll(links_beside_leaders(compared, parts))
    labels = written(connected_components(links, "a", "b", as_stars=True), "jaccard-labels")
    dropped(first, sets, leaders, compared)
    # A group is a component of linked sets, or the copies of a set without links; those of one document need no row.
    group = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    d = all_docs.join(labels, "node", "left").select("id", "n", group.alias("group"))
    least = written(d.filter("n > 0").groupBy("group").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("docs")).filter("docs > 1").drop("docs"), "jaccard-least")
    return d.join(least, "group", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id; of rows repeated under that id, one.

    Documents without an id or a word are kept as they are.
    """
    found = near_duplicates(docs, id_col, text_col).filter(f"`{id_col}` = component_id").select(F.col(id_col).alias("_kept_id")).distinct()
    names = [f"own_{i}" for i in range(len(docs.columns))]
    key = names[docs.columns.index(id_col)]
    d = docs.toDF(*names)
    kept = d.join(found, F.col(key) == F.col("_kept_id"), "left_semi").dropDuplicates([key])
    without = d.filter(F.col(key).isNull())
    return kept.unionAll(without).toDF(*docs.columns)
