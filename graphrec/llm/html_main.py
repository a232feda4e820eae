"""Main text of web pages: boosted trees over the figures of DOM nodes, decoded over the tree."""

from __future__ import annotations

import pickle
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .dom import FEATURES, Page, compose, decode

COMPOSED = 6


def _examples(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels of nodes with text: of the page by its own landmarks, the same without names, and of pages composed from its texts."""
    page = Page(source)
    labels = page.weak_labels()
    pages = [(page, labels, False), (page, labels, True)]
    prose = [t for v, t, _ in page.blocks if labels[v] == 1]
    scraps = [t for v, t, _ in page.blocks if labels[v] == 0 and len(t) < 80]
    rng = random.Random(zlib.crc32(source.encode("utf-8", "surrogatepass")))
    if prose:
        for i in range(COMPOSED):
            made = Page(compose(rng, prose, scraps))
            pages.append((made, made.true_labels(), i % 4 == 3))
    x, y = [], []
    for p, label, blank in pages:
        for v, f in enumerate(p.features(blank)):
            if label[v] is not None and f[len(f) - 25] > 0:
                x.append(f)
                y.append(label[v])
    return np.array(x, dtype=np.float32).reshape(len(x), FEATURES), np.array(y, dtype=np.int8)


def sampled(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_pages: int = 400, n: int | None = None) -> DataFrame:
    """(place, html) of sample_pages pages with text, or all if there are fewer: those with the smallest hashes of id and text.

    Rows equal in both count once. Hashes are ranked alone, among a share of them that has eight times as many as needed
    (all of them where repeated rows leave too few); the driver gets sample_pages of them, so the bound is hard and the
    sample never empty, whatever the number of pages. n: the number of pages, counted if not given.
    """
    n = pages.count() if n is None else n
    source = F.col(html_col).cast("string")
    own = F.col(id_col) if id_col in pages.columns else F.lit(None).cast("string")
    d = pages.select(F.xxhash64(own, source, F.lit("main-text")).alias("place"), source.alias("html")).filter("html IS NOT NULL")
    share = min(1.0, 8.0 * sample_pages / max(n, 1))
    for below in [int(share * 2**64) - 2**63] * (share < 1) + [2**63]:
        few = d if below == 2**63 else d.filter(F.col("place") < below)
        chosen = [r[0] for r in few.select("place").distinct().orderBy("place").limit(sample_pages).collect()]
        if len(chosen) == sample_pages:
            break
    return d.filter(F.col("place") <= max(chosen, default=-(2**63))).dropDuplicates(["place"])


def by_landmarks(page: Page) -> list[str]:
    """The blocks that landmarks tell to be content, or where none is told so those that are not told to be something else."""
    label = page.weak_labels()
    told = any(label[v] == 1 for v, _, _ in page.blocks)
    return [t for v, t, _ in page.blocks if (label[v] == 1 if told else label[v] != 0)]


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_pages: int = 400, page_nodes: int = 1000) -> Trees | None:
    """Trees fitted on a sample of sample_pages pages (see sampled); None where nodes have no label, or too few for any split.

    Labels come from landmarks (article, nav, footer, names such as `sidebar`), and from pages composed of the sample's
    texts with other layouts and names, of which each part is known. Figures are made by tasks; what reaches the driver
    is at most page_nodes seeded rows of figures for each page of the sample, which the fit holds in about 200 MB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for place, source in zip(b["place"], b["html"]):
                x, y = _examples(source)
                if len(y) > page_nodes:
                    some = np.sort(np.random.default_rng(place & 0xFFFFFFFF).permutation(len(y))[:page_nodes])
                    x, y = x[some], y[some]
                if len(y):
                    yield pd.DataFrame({"key": [place], "x": [x.tobytes()], "y": [y.tobytes()]})

    rows = sorted((tuple(r) for r in sampled(pages, html_col, id_col, sample_pages).mapInPandas(run, "key long, x binary, y binary").collect()), key=lambda r: r[0])
    if not rows:
        return None
    x = np.concatenate([np.frombuffer(r[1], dtype=np.float32).reshape(-1, FEATURES) for r in rows])
    y = np.concatenate([np.frombuffer(r[2], dtype=np.int8) for r in rows]).astype(np.float64)
    model = fit(x, y)
    return model if np.isfinite(model.cut).any() else None


def extract(pages: DataFrame, model: Trees | None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text, n_chars): the content blocks of each whole page, joined by two line feeds.

    Null and empty pages give an empty text; null ids, repeated rows and empty tables are allowed; columns but those
    named are ignored. Without a model blocks are told by their landmarks alone (see by_landmarks).
    """
    cols = [id_col, *keep]
    names = [f"own_{i}" for i in range(len(cols))]
    schema = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, cols)) + ", text string, n_chars long"
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def texts(sources: list) -> list[str]:
        model = pickle.loads(shared.value)
        found = [Page(s or "") for s in sources]
        if model is None:
            return ["\n\n".join(by_landmarks(p)) for p in found]
        figures = [p.features() for p in found]
        odds = model.log_odds(np.array([f for page in figures for f in page], dtype=np.float32).astype(np.float64)).tolist()
        out, at = [], 0
        for p, f in zip(found, figures):
            out.append("\n\n".join(decode(p, odds[at : at + len(f)])))
            at += len(f)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 128):
                part = b.slice(at, 128)
                text = texts(part.column("html").to_pylist())
                # Columns pass as they came: pandas would round long ids beside a null.
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*names, "text", "n_chars"])

    out = pages.select(*[F.col(c).alias(n) for n, c in zip(names, cols)], F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, cols)], "text", "n_chars")


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text, n_chars) of every page, by trees fitted on a bounded sample of the same pages.

    Null and empty pages have an empty text, pages without markup are one block; null ids are pages, repeated rows are
    predicted each, an empty table gives no rows; columns but those named are ignored. Where the pages have too few
    labelled nodes for any split (a table of a page or two), landmarks alone tell the text. Pages are read whole, a node for
    each element whatever the depth and the number of siblings, so memory follows the longest page.
    """
    return extract(pages, train(pages, html_col, id_col), id_col, html_col, keep)
