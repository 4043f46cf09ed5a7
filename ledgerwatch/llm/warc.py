"""WARC archives with a two-level capture index.

Writing. Every task writes its rows as compressed records into files of its own in a folder that all executors share,
under a name no other attempt uses, and returns one capture line per record: only lines of attempts that Spark accepts
enter the index, so a lost or repeated task leaves at most files that nothing refers to.

Index. Capture lines are sorted by reversed-host URL key and cut into compressed blocks, file by file over ranges of keys.
Each index file ends in a sparse directory with the first key and the place of each block; a table with the first key of each
file leads to it. A lookup finds its file, binary-searches the directory, reads one block (or the few that equal keys
span), and binary-searches the lines. Record places are then read in the order of their offsets, neighbours in one range read.

Of records with equal payloads the one with the smallest page_id is a response, the others are revisits that refer to it.
Equal payloads are found by SHA-256 in a narrow table of ids; a payload shared by a third of the rows is reduced before
it is shuffled, and the html itself is shuffled once, by page_id.

Defined results: a null html is an empty payload. A null url is the key ''. A row without
page_id is always a response, as nothing names it; rows with one id and one payload get one record each, of one type.
Line ends in a url are written as %0D and %0A. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .tables import column, shuffle_width

BLOCK = 512  # capture lines in an index block
GAP = 64 << 10  # ranges no further apart are one read
FILE_BYTES = 256 << 20
CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"
INDEX = "first string, last string, file string, directory bigint, size bigint"
RECORD = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload_bytes bigint, payload binary"


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: com,example,www:8080)/path?query, the host in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = ",".join(reversed(host.split(".")))
    known = {"http": 80, "https": 443}.get(parts.scheme)
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{f':{port}' if port and port != known else ''}){parts.path or '/'}{query}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escaped(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed record, a gzip member of its own."""
    name = f"urn:page:{'' if page_id is None else page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>",
            f"WARC-Target-URI: {escaped(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if url is None:
        head.remove("WARC-Target-URI: ")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parsed(raw: bytes) -> dict[str, object]:
    """Fields of one decompressed record; its digest is checked against its payload."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(head["Content-Length"])
    payload = raw[end + 4 : end + 4 + size]
    number = lambda field: int(x) if (x := head[field].rpartition(":")[2].rstrip(">")) else None
    digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
    if len(payload) != size or not revisit and digest_of(payload) != digest:
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {
        "page_id": number("WARC-Record-ID"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "payload_digest": digest,
        "refers_to": number("WARC-Refers-To") if revisit else None,
        "payload_bytes": int(head["X-Payload-Length"]) if revisit else size, "payload": None if revisit else payload,
    }


def planned(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, and for revisits the id of the response (_refers, null for responses) and _revisit."""
    narrow = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    narrow = cut_lineage(narrow)
    known = narrow.where(F.col("bytes") >= least)
    # One row per payload and then per id; nothing gathers the copies of a payload.
    first = known.groupBy("sha").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("sha", "low")
    revisits = known.join(first, "sha").where("page_id > low").select("page_id", "sha", "low")
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), F.col("low").alias("_refers")).distinct()
    sha = F.sha2(F.coalesce("html", F.lit("")), 256)
    return pages.select("page_id", "url", "html", sha.alias("_own")).join(
        revisits, (F.col("page_id") == F.col("_page")) & (F.col("_own") == F.col("_sha")), "left"
    ).select("page_id", "url", "html", "_refers", F.col("_page").isNotNull().alias("_revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` into WARC files in ``folder``; returns the capture lines, still unsorted.

    Records with equal payloads of at least ``least`` bytes become one response and revisits."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = {k: [] for k in ("key", "page_id", "file", "offset", "length")}
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "_refers", "_revisit")]):
                page, url, html, refers, revisit = row
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page, url, (html or "").encode(), refers, revisit)
                out.write(data)
                for k, v in zip(rows, (url_key(url), page, name, at, len(data))):
                    rows[k].append(v)
                at += len(data)
            kinds = {"page_id": pa.int64(), "offset": pa.int64(), "length": pa.int64()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()})
        if out is not None:
            out.close()

    return planned(pages, least).mapInArrow(written, CAPTURE)


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Writes capture lines, sorted by key, into index files; returns one row per file: first and last key, and the
    place of its directory. Keys may repeat without limit: the sort goes on by page and place."""
    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(shuffle_width(captures.sparkSession), *order).sortWithinPartitions(*order)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name, out, at, directory, lines, last = f"{uuid.uuid4().hex}.cdx", None, 0, [], [], ""

        def flush() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(data)
            directory.append([lines[0][0], at, len(data)])
            at += len(data)
            lines = []

        for batch in batches:
            for line in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")]):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(line)
                last = line[0]
                if len(lines) == block:
                    flush()
        if out is not None:
            if lines:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pa.record_batch({"first": [directory[0][0]], "last": [last], "file": [name], "directory": pa.array([at], pa.int64()), "size": pa.array([len(data)], pa.int64())})

    return ranged.mapInArrow(written, INDEX)


def lookup(keys: list[str], store: fs.FileSystem, path: str, directory: int, size: int) -> Iterator[list]:
    """Capture lines of sorted distinct keys in one index file."""
    with store.open_input_file(path) as file:
        file.seek(directory)
        blocks = json.loads(zlib.decompress(file.read(size)))
        firsts = [b[0] for b in blocks]
        held, lines = -1, []
        for key in keys:
            k = max(0, bisect.bisect_left(firsts, key) - 1)  # equal keys may begin in the block before
            while k < len(blocks) and firsts[k] <= key:
                if held != k:
                    file.seek(blocks[k][1])
                    lines, held = [json.loads(x) for x in zlib.decompress(file.read(blocks[k][2])).split(b"\n")], k
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while i < len(lines) and lines[i][0] == key:
                    yield lines[i]
                    i += 1
                if i < len(lines):
                    break
                k += 1


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = 8 << 20) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads that cover (offset, length) rows in order of offset: from, to, and their rows."""
    held: list[tuple[int, int]] = []
    start = stop = 0
    for offset, length in rows:
        if held and (offset > stop + gap or offset + length - start > most):
            yield start, stop, held
            held = []
        if not held:
            start = stop = offset
        held.append((offset, length))
        stop = max(stop, offset + length)
    if held:
        yield start, stop, held


def fetch(spark: SparkSession, urls: DataFrame, index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """All captures of the addresses in ``urls`` (url string; a null stands for captures without one), through the index."""
    index = cut_lineage(index)
    keyed = urls.select("url").distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())})

    asked = keyed.mapInArrow(keys, "key string").distinct()
    # Index files are as many as tasks wrote them: a bounded number of short rows, independent of the captures.
    files = sorted(tuple(r) for r in index.collect())
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, i) for k in batch.column("key").to_pylist()
                   for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.record_batch({"key": pa.array([k for k, _ in out], pa.string()), "at": pa.array([i for _, i in out], pa.int32())})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        rows = ((i, k) for b in batches for i, k in zip(b.column("at").to_pylist(), b.column("key").to_pylist()))
        for i, group in groupby(rows, key=lambda r: r[0]):
            _, _, name, directory, size = files[i]
            lines: list[list] = []
            for line in lookup([k for _, k in group], store, f"{root}/{name}", directory, size):
                lines.append(line[2:])
                if len(lines) == 10_000:
                    yield places(lines)
                    lines = []
            if lines:
                yield places(lines)

    def places(lines: list[list]) -> pa.RecordBatch:
        return pa.record_batch({k: [x[j] for x in lines] for j, k in enumerate(("file", "offset", "length"))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("file", "offset", "length")]))
        for name, group in groupby(rows, key=lambda r: r[0]):
            with store.open_input_file(f"{root}/{name}") as file:
                for start, stop, held in ranges([r[1:] for r in group]):
                    file.seek(start)
                    data = file.read(stop - start)
                    out = [parsed(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in held]
                    yield records(out)

    def records(out: list[dict[str, object]]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
        return pa.record_batch({c: pa.array([r[c] if payload or c != "payload" else None for r in out], kinds.get(c, pa.string())) for c in names})

    width = shuffle_width(spark)
    by_file = asked.mapInArrow(routed, "key string, at int").repartition(width, "at").sortWithinPartitions("at", "key")
    places_found = by_file.mapInArrow(found, "file string, offset bigint, length bigint")
    return places_found.repartition(width, "file", F.expr("offset div 16777216")).sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def archive(pages: DataFrame, least: int = 0, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC files and index, and reads all records back by their addresses."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    captures = cut_lineage(write_archives(pages, folder, least))
    index = cut_lineage(write_index(captures, folder))
    return fetch(spark, pages.select("url"), index, folder, payload)
