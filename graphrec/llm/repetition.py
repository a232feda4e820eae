"""Quality rules on repetition: suffix arrays of whole texts and the intervals of their common prefixes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
#: Words of the windows that count as repeated, and words of texts looked at together.
WINDOW, BATCH_WORDS = 3, 1_000_000


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place, the place where its group of equals began."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def longest_repeats(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each position, how many words from there on stand elsewhere in its text too (0 below two).

    words: numbers of words, texts one after the other; sizes: words of each text. Suffixes are sorted by prefix
    doubling: at level j a position's rank is the first place of those that share its next 2**j words, and only
    positions not yet alone with theirs are sorted again. Going down the levels gives the longest common prefix of
    neighbours in the suffix array; the larger of a position's two is its longest repeat. The union of these spans is
    the union of the occurrences of all maximal repeated substrings, which are the intervals of common prefixes.
    """
    n, out = len(words), np.zeros(len(words), dtype=np.int64)
    if not n:
        return out
    end = np.repeat(np.cumsum(sizes), sizes)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max()) + 1) + words
    active = np.argsort(key, kind="stable")
    key = key[active]
    new = np.append(True, key[1:] != key[:-1])
    small = np.int32 if n < 2**31 - 1 else np.int64  # a rank array a level is what takes the memory
    rank = np.zeros(n + 1, dtype=small)
    rank[active] = _starts(new) + 1
    levels, size = [rank], 1
    active = active[~(new & np.append(new[1:], True))]
    while len(active):
        further = active + size
        key = rank[active].astype(np.int64) * (n + 1) + np.where(further < end[active], rank[np.minimum(further, n)], 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        new = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[active] = old + _starts(new) - _starts(np.append(True, old[1:] != old[:-1]))
        levels.append(rank)
        size *= 2
        active = active[~(new & np.append(new[1:], True))]
    if len(levels) == 1:
        return out
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank[:n] - 1] = np.arange(n)
    pair = np.flatnonzero(levels[1][suffixes[:-1]] == levels[1][suffixes[1:]])
    first, second = suffixes[pair], suffixes[pair + 1]
    a, b, common = first.copy(), second.copy(), np.zeros(len(pair), dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same = (levels[j][a] == levels[j][b]) & (a < end[first]) & (b < end[second])
        common[same] += 1 << j
        a[same] += 1 << j
        b[same] += 1 << j
    np.maximum.at(out, first, common)
    np.maximum.at(out, second, common)
    return out


def covered(length: np.ndarray, at_least: int) -> np.ndarray:
    """Which positions lie in a span [i, i + length[i]) of at_least words or more."""
    n = len(length)
    edge = np.zeros(n + 1, dtype=np.int64)
    i = np.flatnonzero(length >= at_least)
    np.add.at(edge, i, 1)
    np.add.at(edge, np.minimum(i + length[i], n), -1)
    return np.cumsum(edge[:n]) > 0


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50, min_repeat: int = 6, max_covered: float = 0.3, max_longest: int = 60, max_window_percent: int = 50) -> DataFrame:
    """Repetition figures of every whole text, and the verdict.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the method's
    own covered_fraction (words within repeats of min_repeat words or more, by all words) and longest_repeat (words).
    kept: not base_failed, covered_fraction at most max_covered, longest_repeat at most max_longest. Null and empty
    texts have zeros and fail the base rule. Texts are looked at whole, about BATCH_WORDS words together; one longer
    than that alone, in 4 bytes a word for each doubling of its longest repeat (a text of 20 million words that repeats
    itself throughout takes about 2.5 GB). Rows are independent: null ids, repeated rows and other columns do no
    harm, an empty table gives no rows.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"

    def figures(texts: list[str]) -> dict[str, np.ndarray]:
        number: defaultdict = defaultdict(count().__next__)
        rows, words, sizes = [], [], []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            w = raw.split()
            words += map(number.__getitem__, w)
            sizes.append(len(w))
            lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
            rows.append((len(w), len(t) - (len(raw) - len(raw.translate(None, SPACE))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
        sizes = np.array(sizes, dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        length = longest_repeats(np.array(words, dtype=np.int64), sizes)
        total = lambda x: np.bincount(text, x, minlength=len(texts)).astype(np.int64)
        in_windows, in_repeats = total(covered(np.minimum(length, WINDOW), WINDOW)), total(covered(length, min_repeat))
        longest = np.zeros(len(texts), dtype=np.int64)
        np.maximum.at(longest, text, length)
        base = np.array(rows, dtype=np.int64).reshape(-1, 4)
        failed = (base[:, 0] < min_words) | (100 * in_windows > max_window_percent * base[:, 0])
        share = in_repeats / np.maximum(sizes, 1)
        kept = ~failed & (share <= max_covered) & (longest <= max_longest)
        return dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines"), base.T)) | {"n_repeat_words": in_windows, "base_failed": failed, "kept": kept, "covered_fraction": share, "longest_repeat": longest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars, at = [], 0, 0
            every = b.column("text").to_pylist()
            for i, t in enumerate(every):
                texts.append(t or "")
                chars += len(texts[-1])
                if chars > 6 * BATCH_WORDS or i == len(every) - 1:
                    found = figures(texts)
                    # Ids pass as they came: pandas would round long ones beside a null.
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(texts)), *[pa.array(np.ascontiguousarray(found[c])) for c in names[1:]]], names)
                    at, texts, chars = i + 1, [], 0

    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
