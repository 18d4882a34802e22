"""WARC archives with an external-merge capture index.

Writing: every task turns its rows into WARC/1.1 records, each a gzip member of its own, in archive files of about
``segment_bytes`` in the shared folder. A record's block is an HTTP response head and the payload. Of captures with equal
payloads (SHA-256), the one with the smallest id is a response, the others are revisits that name its target and date
(identical-payload-digest profile) and hold no payload. Record ids are made of archive and offset, so none occurs twice.

Reading: archives are read back record by record. Each archive gives a capture run, sorted locally by URL key, time and id.

Index: a sample of keys cuts the order into ranges of about ``range_rows`` captures, and so a host or URL with a third of all
captures into many. Runs are cut at the ranges' ends into sorted chunks, which travel whole, in Arrow's format; no capture is sorted
again. A k-way loser tree merges the chunks of a range. The ranges in order are one globally ordered index: places and the
numbers of a URL's captures go on from range to range.

A failed or repeated task writes files of other names, and only files that finished tasks report are read, so lost executors
leave at most unused files. URIs are opened with pyarrow's file systems.

Edge cases: a null payload is empty; a null URL has the empty key; equal rows are captures of their own; ties in key and time go
to the smaller id, then to archive and offset; null ids sort first, are named "null" in records and are no one's
response; a very long payload is one record; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.shipping import scratch_path, ship_package, then_released, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no capture times; a page's time is this many seconds after its table's first one: its id.
FIRST_TIME = 1_577_836_800
CAPTURE = (
    "url_key string, capture_time string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, archive string, offset bigint, length bigint"
)
CAPTURE_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64()}
CAPTURE_ARROW = pa.schema([(n, _TYPES[x.split()[1]]) for n, x in zip(CAPTURE_NAMES, CAPTURE.split(", "))])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """A sort-friendly key: host labels reversed, then port, path and query, in lower case, without a fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    path = unquote(parts.path or "/", errors="replace").lower()
    path = path.rstrip("/") or "/"
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path + query


def capture_time(page_id: int | None) -> str:
    at = FIRST_TIME + (page_id or 0) % 3_000_000_000
    return datetime.datetime.fromtimestamp(at, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _header_value(text: str | None) -> str:
    """A header value is one line."""
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c) & 255) for c in text or "")


class Original(NamedTuple):
    """The response that a revisit repeats."""

    page_id: int
    url: str | None


def warc_record(record_id: str, page_id: int | None, url: str | None, payload: bytes, original: Original | None = None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id)}>",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Target-URI: {_header_value(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Capture-ID: {'null' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if original:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To-Target-URI: {_header_value(original.url)}",
            f"WARC-Refers-To-Date: {capture_time(original.page_id)}",
            f"X-Refers-To-Capture: {original.page_id}",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    return block.partition(b"\r\n\r\n")[2]


def read_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, compressed length, headers, block) of each gzip member, in order; memory holds one record and a buffer."""
    buffer, start, out, engine = b"", 0, [], zlib.decompressobj(31)
    while True:
        if not buffer and not (buffer := stream.read(1 << 20)):
            if out or engine.unconsumed_tail:
                raise ValueError("the archive ends inside a record")
            return
        size = len(buffer)
        out.append(engine.decompress(buffer))
        if engine.eof:
            buffer = engine.unused_data
            at = stream.tell() - len(buffer)
            record = b"".join(out)
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {start}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            if rest[n:] != b"\r\n\r\n":
                raise ValueError(f"the record at {start} has another length than it says")
            yield start, at - start, fields, rest[:n]
            start, out, engine = at, [], zlib.decompressobj(31)
        elif size:
            buffer = b""


class LoserTree:
    """Merges k sorted runs with one comparison per level: inner nodes keep the losers of their matches."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and ((x, a) < (y, b))

    def _play(self, i: int, first: bool) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0 and first:
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[i := self.tree[0]] is not None:
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i, False)


#: Tables of so many rows are broadcast, larger ones joined by shuffle.
BROADCAST_ROWS = 200_000


def _bounded(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _payload_key(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")).cast("binary"), 256)


def originals(rows: DataFrame, minimum_revisit_size: int = 0) -> DataFrame:
    """payload (its key), original_id and original_url of the payloads that several rows have; a stored table."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    long = rows.filter((F.octet_length(payload) >= minimum_revisit_size) & F.col("page_id").isNotNull())
    first = long.groupBy(_payload_key(F.col("html")).alias("payload")).agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    return written(first.filter("copies > 1").select("payload", F.col("first.page_id").alias("original_id"), F.col("first.url").alias("original_url")), "originals")


def write_archives(
    pages: DataFrame,
    folder: str,
    minimum_revisit_size: int = 0,
    segment_bytes: int = 32 << 20,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Writes every row as a record; returns the archives: archive, records, bytes (a stored table)."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    known = _bounded(originals(rows, minimum_revisit_size))
    repeats = F.col("page_id") != F.col("original_id")
    joined = rows.withColumn("payload", _payload_key(F.col("html"))).join(known, "payload", "left")
    joined = joined.select("page_id", "url", "html", F.when(repeats, F.col("original_id")).alias("original_id"), "original_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out, records, done = "", None, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                done.append((name, records, size))
                out = None

        for batch in batches:
            for i, u, value, original_id, original_url in zip(*batch.columns):
                i, u, value, original_id = i.as_py(), u.as_py(), value.as_py(), original_id.as_py()
                if out is None:
                    name, records = f"capture-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                original = None if original_id is None else Original(original_id, original_url.as_py())
                record = warc_record(f"{name}/{out.tell()}", i, u, (value or "").encode("utf-8", "surrogatepass"), original)
                out.write(gzip.compress(record, compresslevel=1, mtime=0))
                records += 1
                if out.tell() >= segment_bytes:
                    close()
        close()
        columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["archive", "records", "bytes"])

    return written(joined.mapInArrow(then_released(run), "archive string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame, folder: str, verify: bool = True) -> DataFrame:
    """The captures of all archives, each archive a run sorted by URL key, time and id, in which run_place counts.

    verify: payloads must have their digests.
    """
    ship_package(archives.sparkSession)
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with system.open_input_file(f"{root}/{name}") as stream:
                    for offset, length, fields, block in read_records(stream):
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if verify and kind == "response" and base32_sha1(payload_of(block)) != digest:
                            raise ValueError(f"{name} at {offset}: the payload doesn't have its digest")
                        page = fields["X-Capture-ID"]
                        refers = fields.get("X-Refers-To-Capture")
                        target = fields["WARC-Target-URI"]
                        page, refers = None if page == "null" else int(page), int(refers) if refers else None
                        size = int(fields["X-Payload-Length"])
                        rows.append((url_key(target), fields["WARC-Date"], page, target, kind, size, digest, refers, name, offset, length))
                if len(rows) != records:
                    raise ValueError(f"{name}: {len(rows)} records of {records}")
                rows.sort(key=_order)
                for at in range(0, len(rows), CHUNK_ROWS):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + CHUNK_ROWS]), CAPTURE_ARROW)]
                    places = pa.array(range(at, at + len(columns[0])), pa.int64())
                    yield pa.RecordBatch.from_arrays([*columns, places], names=[*CAPTURE_NAMES, "run_place"])

    return archives.select("archive", "records").repartition(min(n, 4096)).mapInArrow(then_released(run), CAPTURE + ", run_place bigint")


#: Captures of a chunk at most, and of a range about.
CHUNK_ROWS, RANGE_ROWS = 8_192, 100_000


def _order(row: tuple) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9])


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(k).to_pylist() for k in range(len(CAPTURE_NAMES))))


def range_ends(runs: DataFrame, n: int, ranges: int) -> list[tuple]:
    """Captures that cut the order into ranges of about equal size, from a sample of about 50 of each; a bounded sample decides
    only how even they are."""
    if ranges < 2:
        return []
    share = min(1.0, 50 * ranges / n)
    chosen = F.pmod(F.xxhash64("archive", "offset"), F.lit(1_000_000)) < int(1_000_000 * share) + 1
    sample = sorted(_order(tuple(r)) for r in runs.filter(chosen).select(*CAPTURE_NAMES).collect())
    return [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []


def _chunks(runs: DataFrame, ends: list[tuple]) -> DataFrame:
    """range, archive, run_place, chunk: captures of one run and range, in order, in Arrow's format."""
    shared = runs.sparkSession.sparkContext.broadcast(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = shared.value
        for batch in batches:
            places = batch.column(len(CAPTURE_NAMES)).to_pylist()
            captures = batch.select(CAPTURE_NAMES)
            found = [(row[8], bisect_right(ends, _order(row))) for row in _rows_of(captures)]
            edges = [i for i in range(len(found)) if i == 0 or found[i] != found[i - 1]] + [len(found)]
            out = []
            for a, b in zip(edges, edges[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, captures.schema) as stream:
                    stream.write_batch(captures.slice(a, b - a))
                out.append((found[a][1], found[a][0], places[a], sink.getvalue().to_pybytes()))
            types = (pa.int32(), pa.string(), pa.int64(), pa.binary())
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "archive", "run_place", "chunk"])

    return runs.mapInArrow(then_released(run), "range int, archive string, run_place bigint, chunk binary")


def _merged(chunks: DataFrame) -> DataFrame:
    """The captures of each range in order, with range, place (within it) and history_no (within its captures of a URL key)."""

    def rows_of(parts: list[bytes]) -> Iterator[tuple]:
        for part in parts:
            for batch in pa.ipc.open_stream(part):
                for row in _rows_of(batch):
                    yield (_order(row), row)

    schema = pa.schema([*CAPTURE_ARROW, ("range", pa.int32()), ("place", pa.int64()), ("history_no", pa.int64())])

    def merge(number: int, found: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        held, last, no = [], None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for place, (_, row) in enumerate(LoserTree([rows_of(found[k]) for k in sorted(found)])):
            no = no + 1 if row[0] == last else 0
            last = row[0]
            held.append((*row, number, place, no))
            if len(held) == CHUNK_ROWS:
                yield out()
                held.clear()
        if held:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = None, {}
        for batch in batches:
            for r, archive, _, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if r != number:
                    if found:
                        yield from merge(number, found)
                    number, found = r, {}
                found.setdefault(archive, []).append(chunk)
        if found:
            yield from merge(number, found)

    return chunks.mapInArrow(then_released(run), f"{CAPTURE}, range int, place bigint, history_no bigint")


def merge_runs(captures: DataFrame, ranges: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The globally ordered index of sorted runs (archive, run_place): range, place and history_no are added.

    place counts all captures in order, history_no those of a URL key; both from 0.
    """
    spark = captures.sparkSession
    runs = written(captures, "runs")
    n = runs.count()
    ranges = ranges or max(1, -(-n // range_rows), min(spark.sparkContext.defaultParallelism, n // 1_000))
    chunks = _chunks(runs, range_ends(runs, n, ranges))
    # chunks, not captures, are put in order here: by run, and within it as the run has them
    chunks = chunks.repartition(ranges, "range").sortWithinPartitions("range", "archive", "run_place")
    merged = written(_merged(chunks), "merged")
    # one row for each range: what the ranges before it have, and of them the captures of its first URL key
    ends = F.max(F.struct("place", "url_key", (F.col("history_no") + 1).alias("n")))
    starts = F.min(F.struct("place", "url_key"))
    each = merged.groupBy("range").agg(F.count("*").alias("n"), starts["url_key"].alias("first"), ends["url_key"].alias("last"), ends["n"].alias("n_last"))
    in_order, of_key = Window.orderBy("range"), Window.partitionBy("last").orderBy("range")
    each = each.withColumn("so_far", F.sum("n_last").over(of_key))
    goes_on = F.lag("last").over(in_order) == F.col("first")
    each = each.select(
        "range",
        (F.sum("n").over(in_order) - F.col("n")).alias("before"),
        F.col("first"),
        F.when(goes_on, F.lag("so_far").over(in_order)).otherwise(0).alias("earlier"),
    )
    each = _bounded(written(each, "ranges"))
    named = merged.join(each, "range").withColumn("place", F.col("place") + F.col("before"))
    no = F.col("history_no") + F.when(F.col("url_key") == F.col("first"), F.col("earlier")).otherwise(0)
    return named.select(*CAPTURE_NAMES, "range", "place", no.alias("history_no"))


def capture_index(
    pages: DataFrame,
    minimum_revisit_size: int = 0,
    folder: str | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    ranges: int | None = None,
) -> DataFrame:
    """Writes the archives, reads them back and returns their merged index."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, minimum_revisit_size, page_id=page_id, url=url, html=html)
    return merge_runs(read_archives(archives, folder), ranges)
