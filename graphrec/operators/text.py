"""Cleaning of item texts: built-in expressions, but for the HTML step."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns of the masks, the punctuation that goes, the Turkish stop words.
URL = r"(?iU)\b((?:https?://|www\.)\S+)\b"
EMAIL = r"(?iU)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
PHONE = r"(?U)(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)?\d{3}[\s\-.]?\d{2,4}"
NUMBER = r"(?U)\b\d{3,}\b"
DIGITS = r"(?U)\d{3}"  # in every phone number
PUNCTUATION = r"""["'`^~_|<>\[\]{}()=+*#@:;.,!?–—-]"""
STOPWORDS = "ve veya ile ama fakat ancak ise de da ki mi mu mü bu şu o bir her çok az daha en gibi için üzere diye yada ya hem çünkü eğer şayet".split()


def build_text(title: Column, description: Column) -> Column:
    """`title . description`, or whichever isn't empty."""
    t, d = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    return F.when((t != "") & (d != ""), F.concat(t, F.lit(" . "), d)).otherwise(F.concat(t, d))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.found.append(data.strip())


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    p = _Visible()
    p.feed(html)
    p.close()
    return " ".join(p.found)


def _visible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else visible_text(t))


#: White space, the characters that Python's strip() takes.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip_html(c: Column) -> Column:
    """Visible text of HTML: text nodes trimmed and joined by spaces, without scripts, styles, templates and comments.

    Texts with neither `<` nor `&` in them have no markup: these never leave the JVM.
    """
    marked = F.coalesce(F.contains(c, F.lit("<")) | F.contains(c, F.lit("&")), F.lit(False))
    seen = F.pandas_udf(_visible, StringType())(F.when(marked, c))
    return F.when(marked, seen).otherwise(F.coalesce(F.btrim(c, F.lit(WHITE)), F.lit("")))


def _no_break(c: Column) -> Column:
    return F.replace(c, F.lit("\u00a0"), F.lit(" "))


def normalize_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; single spaces, nearly all there are, are not matched."""
    return F.btrim(F.regexp_replace(_no_break(c), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def _where(c: Column, may: Column, step: Column) -> Column:
    """step on texts that may match, which a cheaper search tells; other texts as they are."""
    return F.when(may, step).otherwise(c)


def mask_url(c: Column) -> Column:
    return _where(c, F.contains(c, F.lit("://")) | F.contains(F.lower(c), F.lit("www.")), F.regexp_replace(c, URL, "<URL>"))


def mask_email(c: Column) -> Column:
    return _where(c, F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, "<EMAIL>"))


def mask_phone(c: Column) -> Column:
    return _where(c, F.rlike(c, F.lit(DIGITS)), F.regexp_replace(c, PHONE, "<PHONE>"))


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, "<NUM>")


def strip_punct(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " ")


def lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_stopwords(c: Column, words: list[str] = STOPWORDS) -> Column:
    return F.array_join(F.filter(F.split(c, " "), lambda x: ~x.isin(*words)), " ")


def clean_text(c: Column, *, html: bool = True, urls: bool = True, emails: bool = True, phones: bool = True, numbers: bool = True, punctuation: bool = True, lower: bool = False, stopwords: bool = False) -> Column:
    """All steps in their fixed order; null becomes ''."""
    c = F.coalesce(c, F.lit(""))
    c = _no_break(strip_html(c) if html else c)
    for on, step in ((urls, mask_url), (emails, mask_email), (phones, mask_phone), (numbers, mask_numbers), (punctuation, strip_punct)):
        c = step(c) if on else c
    c = normalize_space(c) if punctuation else c
    c = lowercase(c) if lower else c
    return normalize_space(remove_stopwords(c)) if stopwords else c


def word_count(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(c, r"\s+")))


def min_word_filter(d: DataFrame, min_words: int = 5, col: str = "wc") -> DataFrame:
    return d.filter(F.col(col) >= min_words)


def length_filter_report(d: DataFrame, min_words: int = 5, col: str = "wc") -> DataFrame:
    return d.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(F.col(col) >= min_words).alias("rows_after"))


def nonblank_text(d: DataFrame, col: str) -> DataFrame:
    return d.filter(F.btrim(F.coalesce(col, F.lit(""))) != "")


def encode_input(d: DataFrame, order: list[str], id_col: str = "item_id", col: str = "text_clean") -> DataFrame:
    """Rows with text, one an id: the first in a stated order."""
    from .graph import item_dedupe_first

    return item_dedupe_first(nonblank_text(d, col), order, id_col)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


def hashed_ngrams(dim: int = 64, n: int = 3, slice_bytes: int = 1 << 18) -> Callable[[list[str]], np.ndarray]:
    """An encoder that needs no model: counts of hashed n-grams of the whole text's bytes.

    An n-gram's hash is its CRC-32, taken over slices of slice_bytes, so memory beside the text is bounded.
    """
    table = _crc_table()

    def counts(raw: np.ndarray) -> np.ndarray:
        total, size = np.zeros(dim, dtype=np.int64), min(n, len(raw))
        for at in range(0, max(1, len(raw) - size + 1), slice_bytes):
            part = raw[at : at + slice_bytes + size - 1]
            h = np.full(len(part) - size + 1, 0xFFFFFFFF, dtype=np.uint32)
            for k in range(size):
                h = table[(h ^ part[k : k + len(h)]) & 0xFF] ^ h >> 8
            h = ~h
            place, up = h % dim, (h >> 16 & 1).astype(bool)
            total += np.bincount(place[up], minlength=dim) - np.bincount(place[~up], minlength=dim)
        return total

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, t in zip(out, texts):
            row[:] = counts(np.frombuffer(t.encode(), dtype=np.uint8))
        return out

    return encode


_ENCODERS: dict[bytes, Callable[[list[str]], np.ndarray]] = {}


def encode_text(d: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "item_id", col: str = "text_clean", batch: int = 256, normalize: bool = True) -> DataFrame:
    """(item_id, embedding) by a pluggable encoder of lists of texts; texts of like length meet in a batch.

    encoder: makes the encoder, in each worker process once, so that a large model is neither sent with every task nor
    loaded anew. Ids of whatever type pass as they are; a null text is an empty one.
    """
    kind = d.schema[id_col].dataType.simpleString()
    key = uuid.uuid4().bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = encoder()
        encode = _ENCODERS[key]
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                v = np.asarray(encode([texts[i] or "" for i in some]), dtype=np.float32)
                if normalize:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                # Ids pass as they came: pandas would round long ones beside a null.
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some, pa.int64())), pa.array(list(v), pa.list_(pa.float32()))], [id_col, "embedding"])

    return d.select(id_col, col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")
