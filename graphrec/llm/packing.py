"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import returning
from .shared import numbered, written

END_ID = 2
#: How a GPT-2 style byte-level BPE splits text before it merges, and the classes of characters that this rests on.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


class Encoder:
    """Ids of a byte-level BPE file, the same as Tokenizer.from_file(path).encode(text, add_special_tokens=False), one per worker process.

    tiktoken takes the file's merges and is about four times as fast. It gives the same ids where these hold, and the
    tokenizers library does the work for the file or the text of which one does not:

    - the file has no more than a byte-level splitter, merges in the order of their tokens' ids, and every token's bytes
      merge to that token (so of two tokens side by side only the pair that the file lists can make a third);
    - the text has no string of an added token in it, which tokenizers takes as that token;
    - both libraries' Unicode tables put each of its characters into the same classes, which is looked up when a
      character is first met.
    """

    loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.added = [t["content"] for t in data.get("added_tokens", [])]
        self.fast = self._ranked(data)
        self.met, self.alike = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
        self._meet(np.arange(128))

    def _ranked(self, data: dict):
        import tiktoken

        model, splitter = data["model"], data.get("pre_tokenizer") or {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
        vocabulary = {t: i for t, i in model.get("vocab", {}).items() if t not in self.added}
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        plain_file = model.get("type", "BPE") == "BPE" and not data.get("normalizer") and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        if not plain_file or made != sorted(set(made)) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        if any([x.id for x in self.slow.model.tokenize(t)] != [i] for t, i in vocabulary.items()):
            return None
        # Such files write each byte as a character: printable ones as they are, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.classes = [tiktoken.Encoding(f"class-{i}", pat_str=c, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}) for i, c in enumerate(CLASSES)]
        return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocabulary.items()}, special_tokens={})

    def _meet(self, codes: np.ndarray) -> None:
        """Looks characters up in both libraries: the matches of each class among them."""
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.met[codes] = True
        if self.fast is None:
            return
        chars = "".join(map(chr, codes))
        self.alike[codes] = True
        for pattern, encoding in zip(CLASSES, self.classes):
            there = set(bytes(encoding.encode_ordinary(chars)).decode())
            here = set("".join(x for x, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(chars)))
            self.alike[[ord(c) for c in there ^ here]] = False

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def is_fast(self, text: str) -> bool:
        if self.fast is None or any(t in text for t in self.added):
            return False
        if text.isascii():
            return bool(self.alike[:128].all())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if not self.met[codes].all():
            new = np.unique(codes[~self.met[codes]])
            self._meet(new[(new < 0xD800) | (new > 0xDFFF)])
        return bool(self.alike[codes].all())

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if not self.is_fast(t)]
        found = dict(zip(slow, (e.ids for e in self.slow.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)))) if slow else {}
        return [found[i] if i in found else self.fast.encode_ordinary(t) for i, t in enumerate(texts)]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): every document's ids and end_id, cut where longer than capacity.

    All pieces but the first are full; the first takes what is left over. A null text is an empty one: end_id alone.
    Whole texts are encoded, a few at a time, so memory follows the longest text.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(vocabulary)
        names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for b in batches:
            rows, out = [], [[] for _ in names[1:]]
            for at in range(0, len(b), 64):
                texts = b.column("text").slice(at, 64).to_pylist()
                for i, ids in enumerate(encoder.encode([t or "" for t in texts])):
                    ids = np.array([*ids, end_id], dtype="<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for piece, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(at + i)
                        for c, v in zip(out, (piece, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z].astype("int32"))):
                            c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            # Ids pass as they came: pandas would round long ones beside a null.
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(out, kinds)]], names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(returning(run), schema)


def fullest(counts: dict[int, int], capacity: int, slack: int = 0) -> list[tuple[int, int]]:
    """[(length, uses)] of the fullest bin that holds the longest length available.

    With `slack`, of a bin that is so full but for slack: lengths enter from the longest on, and once they reach that
    sum, shorter ones are saved for other bins.

    Bit s of `reach` says that some choice of lengths so far sums to s. Counts are split into powers of two, so a
    length enters by a few shifts; the trail of bitsets gives the choice back.
    """
    lengths = sorted(counts, reverse=True)
    top = lengths[0]
    room = capacity - top
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left = min(counts[length] - (length == top), room // length)
        if left > 0 and reach.bit_length() - 1 < room - slack:
            step = 1
            while left > 0:
                n = min(step, left)
                trail.append((length, n, reach))
                reach |= reach << (length * n) & mask
                left, step = left - n, step * 2
    at, uses = reach.bit_length() - 1, {top: 1}
    for length, n, before in reversed(trail):
        if not before >> at & 1:
            at -= length * n
            uses[length] = uses.get(length, 0) + n
    return sorted(uses.items(), reverse=True)


def slack_plan(counts: dict[int, int], capacity: int, slack: int = 0) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, uses)])]: bins filled one kind at a time, each the fullest there is (but for slack), until no length is left.

    A choice is repeated while the counts allow it, so the work depends on the number of different lengths (capacity
    at most), not on the number of pieces.
    """
    counts, plan = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        uses = fullest(counts, capacity, slack)
        bins = min(counts[k] // n for k, n in uses)
        for k, n in uses:
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
        plan.append((bins, uses))
    return plan


def minimum_slack_plan(counts: dict[int, int], capacity: int, slacks: tuple[int, ...] = (0, 1, 2, 4, 6, 8, 12, 16, 24)) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan of fewest bins over these slacks. Short lengths used up early are missed by the last bins, which a
    little slack in the first ones avoids."""
    return min((slack_plan(counts, capacity, s) for s in slacks), key=lambda plan: sum(n for n, _ in plan))


def pack(pieces: DataFrame, capacity: int = 1024, rows_per_bucket: int = 5_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table with id column first, piece, length).

    The driver sees one count a length (capacity rows at most) and plans on these. Pieces of a length are numbered
    without gathering them in a task; number k of a length goes to the bin and place that the plan has for it.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for bins, uses in minimum_slack_plan(counts, capacity):
        offset = 0
        for length, n in uses:
            by.setdefault(length, []).append((taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * bins
            offset += n * length
        sequence += bins
    tables = {k: np.array(v, dtype=np.int64) for k, v in by.items()}
    own = pieces.columns
    rows = numbered(pieces, ["length"], [pieces.columns[0], "piece", "ids_crc32"], "_k", rows_per_bucket)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, length = b.column("_k").to_numpy(), b.column("length").to_numpy()
            sequence_id, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                t = tables[int(one)]
                s = t[np.searchsorted(t[:, 0], k[at], side="right") - 1]
                since = k[at] - s[:, 0]
                sequence_id[at], offset[at] = s[:, 2] + since // s[:, 1], s[:, 3] + since % s[:, 1] * one
            yield pa.RecordBatch.from_arrays([*map(b.column, own), pa.array(sequence_id), pa.array(offset)], [*own, "sequence_id", "offset"])

    return rows.mapInArrow(returning(run), schema)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 5_000) -> DataFrame:
    """Documents as pieces in sequences of at most capacity tokens.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset. Null ids are kept, rows repeated under one
    id are documents each, null and empty texts are a piece of one token, an empty table gives no rows; other columns
    of docs are ignored.
    """
    pieces = written(token_pieces(docs, vocabulary, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity, rows_per_bucket)
