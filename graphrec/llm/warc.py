"""WARC archives with revisit records, and a two-level capture index over them.

Archives: one gzip member a record. Index: captures sorted by reversed-host URL key in shards of compressed blocks,
each shard with a sparse directory of its blocks; the shards' first keys are the level above. A lookup finds shard and
blocks by binary search, then reads only those byte ranges of index and archives. Files are written by the tasks to a
folder that driver and executors share; which of them count is kept in a table that Spark commits, so files of tasks
that were lost or ran twice are never read.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import work_dir, written

#: Payloads of so many bytes are stored once; captures in a block of the index.
MIN_REVISIT_BYTES, BLOCK_LINES = 1000, 512
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "surt string, page_id long, digest string, payload_bytes long, record_type string, refers_to long, path string, offset long, length long"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme and fragment do not count."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), (f":{u.port}" if u.port else "")
    except ValueError:
        return "!" + re.sub(r"[\x00-\x20]", "", url)
    key = ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")
    return re.sub(r"[\x00-\x20]", "", key)


def _opened(path: str, mode: str):
    """A file by URL, through whichever file system the URL names."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_output_stream(name, compression=None) if mode == "w" else system.open_input_file(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; the payload's length stands in a header of its own, as a revisit has no payload."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, content) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if len(body) < int(fields["content-length"]):
        raise ValueError("record cut short")
    return fields, body


def decide(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to): which records carry their payload.

    The largest id of equal payloads (digest and length, MIN_REVISIT_BYTES at least) is found by a map-side maximum over
    thin rows; only digests seen twice or more are kept, as a table. Where Spark finds that small it is broadcast and
    payloads stay where they are; else they meet it in a plain join, in which adaptive execution splits a digest that
    very many pages share.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    d = d.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = d.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    shared = written(shared, "warc-shared")
    d = d.join(shared, ["digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return d.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", max_bytes: int = 1 << 30) -> DataFrame:
    """Writes a record for each row into *.warc.gz files under folder; returns the table of captures (CAPTURE).

    A task starts a new file after max_bytes. A null payload is an empty one, a null URL leaves out the target header; of
    rows repeated under the largest id all are responses, a row without id revisits the largest one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, digest, kind, refers_to in b.itertuples(index=False):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                    if out is None or at > max_bytes:
                        if out is not None:
                            out.close()
                        path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = _opened(path, "w")
                    member = gzip.compress(record(page_id, url, payload, digest, kind, refers_to), 6, mtime=0)
                    out.write(member)
                    rows.append((surt(url), page_id, digest, len(payload), kind, refers_to, path, at, len(member)))
                    at += len(member)
                if rows:
                    f = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")], dtype=object)
                    yield f
        finally:
            if out is not None:
                out.close()

    _made(folder)
    # Numbers go to Python as text: pandas would make floats of those with nulls.
    decided = decide(pages, id_col, url_col, payload_col)
    captures = decided.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(run, CAPTURE)
    captures.write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(CAPTURE).parquet(f"{folder}/captures")


def _made(folder: str) -> None:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(folder)
    system.create_dir(name, recursive=True)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Two-level index of captures under folder: a table of shards (first, last, path, directory_at, directory_size).

    Captures are dealt to shards by range of (key, id, place), so a key with a third of all captures fills several shards.
    A shard file holds zlib blocks of block_lines sorted lines and, after them, its directory: each block's first and
    last key, offset and length. The table of shards has one row a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, at, first, last, held, directory = None, "", 0, None, None, [], []

        def flush() -> None:
            nonlocal at, held
            block = zlib.compress("\n".join("\t".join(x) for x in held).encode("utf-8", "surrogatepass"), 6)
            directory.append(f"{held[0][0]}\t{held[-1][0]}\t{at}\t{len(block)}")
            out.write(block)
            at, held = at + len(block), []

        for b in batches:
            for row in b.itertuples(index=False):
                if out is None:
                    path, first = f"{folder}/{uuid.uuid4().hex}.cdx", row[0]
                    out = _opened(path, "w")
                held.append(["" if x is None else x for x in row])
                last = row[0]
                if len(held) >= block_lines:
                    flush()
        if out is not None:
            if held:
                flush()
            tail = zlib.compress("\n".join(directory).encode("utf-8", "surrogatepass"), 6)
            out.write(tail)
            out.close()
            yield pd.DataFrame({"first": [first], "last": [last], "path": [path], "directory_at": [at], "directory_size": [len(tail)]})

    _made(folder)
    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["surt", "page_id", "path", "offset"]
    ranged = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.select(*[F.col(c).cast("string") for c in ranged.columns])
    schema = "first string, last string, path string, directory_at long, directory_size long"
    ranged.mapInPandas(run, schema).write.parquet(f"{folder}/shards")
    return spark.read.schema(schema).parquet(f"{folder}/shards")


def lookup(urls: DataFrame, shards: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures (CAPTURE) of each different key of urls.

    Shard by binary search over the shards' keys (the driver holds one row a shard, sorted by byte order of the key);
    then a task per shard reads the shard's directory, finds the keys' blocks by binary search, and reads these.
    """
    spark = urls.sparkSession
    known = sorted((r["first"].encode("utf-8", "surrogatepass"), r["last"].encode("utf-8", "surrogatepass"), r["path"], r["directory_at"], r["directory_size"]) for r in shards.collect())
    firsts, lasts = [x[0] for x in known], [x[1] for x in known]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, where = [], []
            for url in b["url"]:
                key = surt(url)
                raw = key.encode("utf-8", "surrogatepass")
                for i in range(bisect_left(lasts, raw), bisect_right(firsts, raw)):
                    keys.append(key)
                    where.append(i)
            yield pd.DataFrame({"shard": pd.array(where, dtype="int32"), "key": keys})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, file, directory, block, lines = None, None, None, None, []
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        for b in batches:
            rows = []
            for i, key in b.itertuples(index=False):
                key = key.encode("utf-8", "surrogatepass")
                if i != shard:
                    shard, block, file = i, None, _opened(known[i][2], "r")
                    file.seek(known[i][3])
                    directory = [x.split(b"\t") for x in zlib.decompress(file.read(known[i][4])).split(b"\n")]
                    block_firsts, block_lasts = [x[0] for x in directory], [x[1] for x in directory]
                for j in range(bisect_left(block_lasts, key), bisect_right(block_firsts, key)):
                    if j != block:
                        block = j
                        file.seek(int(directory[j][2]))
                        lines = [x.split(b"\t") for x in zlib.decompress(file.read(int(directory[j][3]))).split(b"\n")]
                        line_keys = [x[0] for x in lines]
                    for x in lines[bisect_left(line_keys, key) : bisect_right(line_keys, key)]:
                        v = [y.decode("utf-8", "surrogatepass") for y in x]
                        rows.append([int(y) if k in (1, 3, 5, 7, 8) and y else None if k in (1, 5) and not y else y for k, y in enumerate(v)])
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    dealt = urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInPandas(deal, "shard int, key string").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(max(1, min(n, len(known))), "shard").sortWithinPartitions("shard", "key").mapInPandas(read, CAPTURE)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that captures point at, by range reads: page_id, payload_bytes, payload_digest, record_type, refers_to[, payload].

    A response's payload is hashed again and must agree with its header; a revisit has no payload of its own (null), its
    length and digest stand in its headers. A record that is cut short or does not agree raises.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def number(urn: str) -> int | None:
        n = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(n) if n else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        files: dict = {}
        for b in batches:
            rows = []
            for path, offset, length in b.itertuples(index=False):
                if path not in files:
                    if len(files) > 64:
                        files.pop(next(iter(files))).close()
                    files[path] = _opened(path, "r")
                files[path].seek(offset)
                fields, body = parse(gzip.decompress(files[path].read(length)))
                digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["payload-length"])):
                    raise ValueError(f"payload does not agree with its header: {path} at {offset}")
                row = [number(fields["warc-record-id"]), int(fields["payload-length"]), digest, kind, number(fields["warc-refers-to"]) if kind == "revisit" else None]
                rows.append(row + [body if kind == "response" else None] * with_payload)
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return captures.select("path", "offset", "length").mapInPandas(run, schema)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives all pages, indexes them, looks up every URL and reads each capture back.

    Empty tables give no rows; null ids, URLs and payloads, repeated rows and further columns are allowed.
    """
    folder = work_dir(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, id_col, url_col, payload_col)
    shards = write_index(captures, f"{folder}/index")
    found = lookup(pages, shards, url_col)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return read_records(found.repartition(n, "path").sortWithinPartitions("path", "offset"))
