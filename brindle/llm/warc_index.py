"""WARC archives with a two-level capture index.

Records are written where the rows lie, one gzip member each.  Their index
entries are dealt out by ranges of the reversed-host URL key and sorted; each
range becomes an index file of compressed blocks of entries, with a sparse
directory (first key, place and size of each block) at its end.  A lookup
searches the first keys of the index files, then the directory of one file,
then one block, and last range-reads the record.

Tasks name files by attempt and only files in a committed manifest are read, so
an attempt that was lost or ran twice does no harm.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import arrowfs
from brindle.llm.scratch import new_path, save, shuffle_partitions

LEAST_BYTES, BLOCK_LINES, SENT_DIGESTS = 1000, 1024, 200_000
GAP, MOST_READ = 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, id string, file string, at bigint, size bigint"


def url_key(url: Column) -> Column:
    """Reversed-host key: ``com,example,www)/path?query``; empty for a null."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    name, port = F.regexp_replace(host, r"(^.*@)|(:\d*$)", ""), F.regexp_extract(host, r":\d+$", 0)
    tail = F.regexp_replace(F.substr(rest, F.length(host) + 1), "#.*$", "")
    return F.when(url == "", "").otherwise(F.concat(F.concat_ws(",", F.reverse(F.split(name, r"\."))), port, F.lit(")"), F.when(tail == "", "/").otherwise(tail)))


def _header(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page: str | None, url: str | None, payload: bytes, refers: str | None, revisit: bool, date: str) -> bytes:
    """A WARC record as a gzip member; a revisit keeps the HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(head + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def info(date: str) -> bytes:
    """The record at the head of a file, which says what the file is."""
    block = b"software: brindle\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(raw: bytes) -> dict:
    """The fields of one record: page, url, kind, refers, digest (hex), payload_bytes, payload (None for a revisit)."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    inner = lambda x: x[len("<urn:page:") : -1] if x else None
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError("a payload doesn't fit its digest")
    return {"page": inner(fields["WARC-Record-ID"]) or None, "url": fields.get("WARC-Target-URI"), "kind": kind, "refers": inner(fields.get("WARC-Refers-To")), "digest": digest, "payload_bytes": length, "payload": payload if kind == "response" else None}


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row under path; its index entries (key, id, file, at, size), not yet dealt out.

    Of rows with equal payloads of ``least_bytes`` or more those with the largest
    id are responses and the others revisit it; a null id is the least.  A null
    payload is empty.  Repeated rows with the largest id are all responses.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("same", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    groups = base.where("same is not null").groupBy("same").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    groups = save(groups.where("n > 1 and keeper is not null").drop("n"), "copies")
    few = groups.count() <= SENT_DIGESTS
    joined = base.join(F.broadcast(groups) if few else groups, "same", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    rows = joined.select(url_key(F.col("url")).alias("key"), F.col("id").cast("string").alias("id"), "url", "html", revisit.alias("revisit"), F.col("keeper").cast("string").alias("keeper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{path}/{uuid.uuid4().hex}.warc.gz"
        where, name = arrowfs.at(uri)
        out, place = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                where.create_dir(name.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(name, compression=None)
                out.write(head := info(date))
                place = len(head)
            at, size = [], []
            columns = [batch.column(c) for c in ("id", "url", "html", "revisit", "keeper")]
            for row in zip(*columns, strict=True):
                page, u, body, again, keeper = (x.as_py() for x in row)
                raw = record(page, u, body.encode(), keeper, again, date)
                out.write(raw)
                at.append(place)
                size.append(len(raw))
                place += len(raw)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array([uri] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], ["key", "id", "file", "at", "size"])
        if out:
            out.close()

    return save(rows.mapInArrow(run, ENTRY), "entries")


def _block(lines: list[tuple]) -> bytes:
    return zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 3)


def build_index(entries: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index files; their manifest (first_key, first_id, file, at, size, n), one row a file: where its directory lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{path}/{uuid.uuid4().hex}.idx"
        where, name = arrowfs.at(uri)
        out, place, held, directory, n = None, 0, [], [], 0

        def flush() -> None:
            nonlocal place, held, n
            raw = _block(held)
            out.write(raw)
            directory.append((held[0][0], held[0][1], place, len(raw)))
            place, n, held = place + len(raw), n + len(held), []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "file", "at", "size")), strict=True):
                if out is None:
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(name, compression=None)
                held.append((row[0], row[1] or "", *row[2:]))
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if out:
            raw = _block(directory)
            out.write(raw)
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first[0], first[1], uri, place, len(raw), n)], ["first_key", "first_id", "file", "at", "size", "n"])

    parts = shuffle_partitions(entries.sparkSession)
    order = [F.col("key"), F.coalesce("id", F.lit(""))]
    dealt = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return save(dealt.mapInArrow(run, "first_key string, first_id string, file string, at bigint, size bigint, n bigint"), "index")


class Index:
    """Lookups by two binary searches; ``files``: manifest rows in ascending order of the first key."""

    def __init__(self, files: list[tuple]):
        self.files, self.firsts = files, [(f[0], f[1]) for f in files]
        self.reader, self.directories, self.blocks = arrowfs.Reader(), {}, {}

    def _lines(self, file: str, at: int, size: int) -> list[tuple]:
        return [tuple(json.loads(x)) for x in zlib.decompress(self.reader.read(file, at, size)).decode().split("\n")]

    def _directory(self, k: int) -> list[tuple]:
        if k not in self.directories:
            if len(self.directories) >= 4:
                self.directories.pop(next(iter(self.directories)))
            self.directories[k] = self._lines(*self.files[k][2:5])
        return self.directories[k]

    def _entries(self, k: int, block: tuple) -> list[tuple]:
        at = (k, block[2])
        if at not in self.blocks:
            if len(self.blocks) >= 4:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[at] = self._lines(self.files[k][2], block[2], block[3])
        return self.blocks[at]

    def find(self, key: str, page: str | None = None) -> Iterator[tuple]:
        """Entries of a key, in order of the id; of one id if given."""
        low = (key, "" if page is None else page)
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while k < len(self.files) and self.firsts[k] <= (key, page if page is not None else "\U0010ffff"):
            directory = self._directory(k)
            b = max(0, bisect.bisect_left(directory, low, key=lambda x: (x[0], x[1])) - 1)
            for block in directory[b:]:
                if (block[0], block[1]) > (key, page if page is not None else "\U0010ffff"):
                    return
                lines = self._entries(k, block)
                for x in lines[bisect.bisect_left(lines, low, key=lambda x: (x[0], x[1])) :]:
                    if x[0] != key or (page is not None and x[1] != page):
                        return
                    yield x
            k += 1


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of the asked (key, id): a null id asks for all captures of the key.  Repeated questions count once.

    The driver gets one row for each index file: as many as there are partitions.
    """
    files = [tuple(r) for r in index.orderBy("first_key", "first_id").select("first_key", "first_id", "file", "at", "size").collect()]
    kept = keys.select("key", F.col("id").cast("string").alias("id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(files)
        for batch in batches:
            hits = [x for key, page in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), strict=True) for x in found.find(key, page)]
            columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "file", "at", "size"])
        found.reader.close()

    order = [F.col("key"), F.coalesce("id", F.lit(""))]
    return kept.repartitionByRange(shuffle_partitions(keys.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, ENTRY)


def fetch(entries: DataFrame) -> DataFrame:
    """The records behind entries, read in the order in which they lie, near ones by one range read; payloads are checked, not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = arrowfs.Reader()
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True))
            out, k = [], 0
            while k < len(rows):
                file, start, size = rows[k]
                to, stop = k + 1, start + size
                while to < len(rows) and rows[to][0] == file and rows[to][1] - stop <= GAP and rows[to][1] + rows[to][2] - start <= MOST_READ:
                    stop, to = max(stop, rows[to][1] + rows[to][2]), to + 1
                raw = reader.read(file, start, stop - start)
                out += [parse(raw[a - start : a - start + n]) for _, a, n in rows[k:to]]
                k = to
            names = ("page", "url", "kind", "refers", "digest")
            yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in out], pa.string()) for c in names), pa.array([x["payload_bytes"] for x in out], pa.int64())], [*names, "payload_bytes"])
        reader.close()

    n = shuffle_partitions(entries.sparkSession)
    return entries.select("file", "at", "size").repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at").mapInArrow(run, "page string, url string, kind string, refers string, digest string, payload_bytes bigint")


def roundtrip(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row, from the archives by way of the index.

    All cases of nulls and repeats are those of ``write``; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    kind = pages.schema[id_col].dataType
    entries = write(pages, new_path(spark, "warc"), id_col=id_col, url=url, html=html, **options)
    index = build_index(entries, new_path(spark, "index"))
    asked = pages.select(url_key(F.col(f"`{url}`").cast("string")).alias("key"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"))
    found = fetch(save(lookup(index, asked), "found"))
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))
