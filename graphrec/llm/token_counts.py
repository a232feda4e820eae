"""Token counts by heap-and-linked-list byte-pair merging, without ids."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text cut into words at a time; counts of pieces kept in a worker (twice as many for a while), and the characters of the longest one kept.
SLICE, KEPT_PIECES, KEPT_CHARS = 1 << 24, 1 << 18, 64
#: Steps of a normalizer that do nothing across ASCII white space, so that words can be normalized one by one.
LOCAL_STEPS = {"NFC", "NFD", "Lowercase"}


class Counter:
    """Counts a tokenizer file's tokens, as many as Tokenizer.from_file(path).encode(text, add_special_tokens=False) has; one per worker process.

    The file must be a plain BPE whose normalizer and splitter take ASCII white space as nothing but a border (a
    ValueError tells of others). A text is cut there; its words are normalized and split by the file's own steps, and
    each piece's symbols are merged here. Strings of the file's added tokens are a token each, as the library has it.
    """

    loaded: dict[str, "Counter"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, library = data["model"], Tokenizer.from_file(path)
        steps = data.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
        local = all(s["type"] in LOCAL_STEPS or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")):
            raise ValueError(f"{path} is not a plain BPE")
        if not local or not self.splitter or [p for p, _ in self.splitter.pre_tokenize_str("a b\tc \n\v\f\r d")] != ["a", "b", "c", "d"]:
            raise ValueError(f"{path} does not drop white space between words")
        added = data.get("added_tokens") or []
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError(f"{path} has added tokens that depend on their surroundings")
        # The library takes the longest added token that begins first.
        self.added = re.compile("|".join(re.escape(t) for t in sorted((t["content"] for t in added), key=len, reverse=True))) if added else None
        self.ids = {t: i for t, i in model["vocab"].items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.plain = self._plain(data)

    def _plain(self, data: dict):
        """A pattern that splits lower-cased words of printable ASCII as the file's splitter does; None where that is not shown.

        Such words no normalizer step but the lower case changes, and their bytes are symbols as they are. The pattern is
        the file's own in another library, so both must put each of these characters into the same classes.
        """
        import regex

        steps = data["pre_tokenizer"].get("pretokenizers") or [data["pre_tokenizer"]]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0].get("behavior") != "Removed" or not steps[0].get("invert") or "Regex" not in steps[0]["pattern"] or steps[1].get("use_regex") or steps[1].get("add_prefix_space"):
            return None
        found, chars = regex.compile(steps[0]["pattern"]["Regex"]), [chr(c) for c in range(33, 127)]
        probes = [*chars, *(a + b for a in chars for b in chars), *("a" + c for c in chars), *("'" + a + b for a in "abdelmrstv1." for b in "abdelmrstv1.")]
        if any(found.findall(p) != [x for x, _ in self.splitter.pre_tokenize_str(p)] for p in probes) or (self.normalizer and any(self.normalizer.normalize_str(p) != p.lower() for p in chars)):
            return None
        return found if self.normalizer and self.normalizer.normalize_str("A") == "a" else None

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def merged(self, symbols: list[int]) -> int:
        """How many symbols are left: the pair of lowest rank, the first on ties, is popped and merged until none is left.

        Symbols are a doubly linked list; a popped pair that a merge has changed meanwhile is passed over. A merge of n
        symbols takes n log n steps, so a word without an end costs little more than many short ones.
        """
        merges, n = self.merges, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, found[1], symbols[i + 1]) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, made, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] < 0 or symbols[j] != right or merges.get((symbols[i], right), (-1,))[0] != rank:
                continue
            symbols[i], symbols[j] = made, -1
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1], symbols[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, found[1], made))
        return left

    def piece(self, piece: str) -> int:
        """Tokens of one piece of the splitter; characters that the file has no symbol for are no token."""
        if (n := self.seen(piece)) is not None:
            return n
        units = [*piece[:-1], piece[-1] + self.end]
        symbols = [i for u in units if (i := self.ids.get(u)) is not None]
        n = self.merged(symbols) if len(symbols) > 1 else len(symbols)
        if len(piece) <= KEPT_CHARS:
            self.keep(piece, n)
        return n

    def seen(self, piece: str) -> int | None:
        """The tokens of a piece met lately."""
        n = self.known.get(piece)
        if n is None and (n := self.older.get(piece)) is not None:
            self.keep(piece, n)
        return n

    def keep(self, piece: str, n: int) -> None:
        """When the newer half of what is kept is full, the older one goes."""
        if len(self.known) >= KEPT_PIECES:
            self.known, self.older = {}, self.known
        self.known[piece] = n

    def word(self, word: str) -> int:
        """Tokens of a text without white space at which it could be cut."""
        # A piece in ASCII is the bytes it stands for, and the splitter gives it back whole.
        if self.plain is not None and word.isascii() and (n := self.seen(word)) is not None:
            return n
        n, rest = 0, [word]
        if self.added is not None and self.added.search(word):
            rest = self.added.split(word)
            n = len(rest) - 1
        for p in filter(None, rest):
            if self.plain is not None and p.isascii() and p.isprintable():
                n += sum(map(self.piece, self.plain.findall(p.lower())))
            else:
                n += sum(self.piece(x) for x, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(p) if self.normalizer else p) if x)
        return n

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, nulls as 0. Equal words of the texts are looked at once."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        distinct = words.flatten().dictionary_encode()
        counts = np.array([self.word(w) for w in distinct.dictionary.to_pylist()] + [0], dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(counts[distinct.indices.to_numpy(zero_copy_only=False)])])
        ends = words.offsets.to_numpy()
        return upto[ends[1:] - ends[0]] - upto[ends[:-1] - ends[0]]


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about size bytes together, one longer than that alone."""
    weight = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < len(texts):
        before = weight[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(weight, before + size, side="right")))
        yield at, end
        at = end


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of every whole text, and whether these are over limit.

    vocabulary: path of a tokenizers file (see Counter). A null text is an empty one: no bytes, no tokens. Texts are cut
    into words a few megabytes at a time, so memory follows the longest text. Rows are independent and there is no
    shuffle: null ids and repeated rows are counted each, ids of whatever type pass as they are, an empty table gives no
    rows, other columns are ignored whatever their names.
    """
    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary)
        for b in batches:
            texts, ids = b.column("text"), b.column("id")
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = np.concatenate([np.zeros(0, np.int64), *[counter.texts(texts.slice(a, z - a)) for a, z in slices(texts, SLICE)]])
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "over_limit")
