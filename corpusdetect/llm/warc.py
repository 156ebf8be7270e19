"""Web archives: records written, read back, and their captures merged into one order.

A page whose payload was seen with a smaller id is written as a revisit of that page's response.
Tasks write archives of gzip members, one per record, into the shared folder and report them; only
reported archives count, so retried and doubled tasks do no harm. Reading an archive gives a run of
captures sorted by URL key and time. Runs are cut at common borders, and the slices of each range are merged
by a tree of losers, which makes the captures of every URL one history.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import fits_broadcast, materialize, scratch_path
from .losertree import merge

# Payloads of fewer bytes are always written in full.
LEAST_BYTES = 0
MAX_FILE = 256 * 1024 * 1024
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
# Captures of a range that one task merges, the most ranges, and keys sampled to find the border of one.
RANGE_ROWS = 200_000
MAX_RANGES = 10_000
SAMPLE = 64
# Digests of repeated payloads sent to every executor.
BROADCAST_DIGESTS = 1_000_000


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1: forty bits of the hexadecimal form make eight signs."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query; scheme, www and fragment do not count."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")"
    return key + (parts.path.rstrip("/") or "/") + (f"?{parts.query}" if parts.query else "")


def captured_at(page_id: int | None) -> datetime:
    """The tables hold no times: one second per id, within thirty years."""
    return _EPOCH + timedelta(seconds=(page_id or 0) % 1_000_000_000)


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit without the payload."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    name = f"page:{page_id}" if page_id is not None else f"uuid:{uuid.uuid4()}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:{name}>",
        f"WARC-Date: {captured_at(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """(path, records): archives of the rows (page_id, url, payload, digest, refers_to)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, out = [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                page_id, url, payload, digest, refers_to = row
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out, size, records = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id, url, (payload or "").encode(), digest, refers_to)) + pack.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= MAX_FILE:
                    out.close()
                    done, out = [*done, (f"{folder}/{name}", records)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records))
        yield pa.record_batch(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            names=["path", "records"],
        )

    return pages.mapInArrow(write, "path string, records bigint")


def records_of(path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of every record of an archive, one in memory at a time."""
    system, name = _open(path)
    with system.open_input_stream(name, compression=None) as source:
        data, start, offset = b"", 0, 0
        while True:
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                if not data:
                    data = source.read(_CHUNK)
                    if not data:
                        break
                parts.append(unpack.decompress(data))
                offset += len(data) - len(unpack.unused_data)
                data = unpack.unused_data
            if not parts:
                return
            if not unpack.eof:
                raise ValueError(f"{path} ends within a record")
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            header = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            length = int(header["Content-Length"])
            if lines[0] != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
                raise ValueError(f"{path}: broken record at {start}")
            yield start, header, rest[:length]
            start = offset


def _page_of(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


_CAPTURE = (
    "url_key string, captured string, page_id bigint, path string, at bigint, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint"
)
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


_SLICE = "range int, path string, run bigint, place bigint, block binary"
_SLICE_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
_SLICE_NAMES = [x.split()[0] for x in _SLICE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def read_archives(archives: DataFrame) -> DataFrame:
    """A sorted run of captures per archive. Lengths and digests of responses are those of the payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                run = []
                for at, header, block in records_of(path):
                    size, digest = int(header["X-Payload-Length"]), header["WARC-Payload-Digest"].removeprefix("sha1:")
                    if header["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest:
                            raise ValueError(f"{path}: payload at {at} does not match its digest")
                    run.append(
                        (
                            url_key(header["WARC-Target-URI"]),
                            header["WARC-Date"],
                            _page_of(header["WARC-Record-ID"]),
                            path,
                            at,
                            header["WARC-Type"],
                            size,
                            digest,
                            _page_of(header.get("WARC-Refers-To")),
                        )
                    )
                if len(run) != told:
                    raise ValueError(f"{path}: {len(run)} records, {told} were written")
                run.sort(key=_order)
                for first in range(0, len(run), 4096):
                    yield _batch(run[first : first + 4096])

    return archives.select("path", "records").mapInArrow(read, _CAPTURE)


def _order(row: tuple) -> tuple:
    """URL key, time, id (null last), archive and offset of the record, which are unique."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[3], row[4]


def _borders(captures: DataFrame, ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 places in the order of captures, about as far apart, from a sample of bounded size."""
    total = captures.count()
    step = max(1, total // (ranges * SAMPLE))
    sample = captures.where(F.pmod(F.xxhash64("path", "at"), F.lit(step)) == 0).select("url_key", "captured", "page_id", "path", "at")
    found = sorted(_order(tuple(r)) for r in sample.collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def merge_runs(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in one order over all partitions: URL key, time, id.

    ``captures`` are written runs. Each run is cut at common borders into slices of packed blocks, and the
    slices of a range meet in one task, where a tree of losers merges them, reading a block of each
    run at a time. Nothing is sorted again. Ranges are of the whole order, not of URLs: a URL with a third
    of the captures spans many of them.
    """
    ranges = min(MAX_RANGES, captures.count() // range_rows + 1)
    borders = _borders(captures, ranges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run is what is in order of one archive, as far as this task reads it; blocks of a run are numbered.
        run, place, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            keys = [_order(r) for r in rows]
            packed: list[tuple[int, str, int, int, bytes]] = []
            begin = 0
            while begin < len(rows):
                if last is None or rows[begin][3] != last[0] or keys[begin] < last[1]:
                    run += 1
                to = bisect_right(borders, keys[begin])
                end = begin + 1
                while end < len(rows) and rows[end][3] == rows[begin][3] and keys[end] > keys[end - 1] and (
                    to == len(borders) or keys[end] < borders[to]
                ):
                    end += 1
                last = (rows[end - 1][3], keys[end - 1])
                block = pa.BufferOutputStream()
                with pa.ipc.new_stream(block, batch.schema) as out:
                    out.write_batch(batch.slice(begin, end - begin))
                packed.append((to, rows[begin][3], run, place, block.getvalue().to_pybytes()))
                place += 1
                begin = end
            if packed:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*packed), _SLICE_TYPES)], names=_SLICE_NAMES)

    def merged(table: pa.Table) -> pa.Table:
        blocks: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        for path, run, place, block in zip(*(table.column(c).to_pylist() for c in ("path", "run", "place", "block"))):
            blocks.setdefault((path, run), []).append((place, block))

        def rows(own: list[tuple[int, bytes]]) -> Iterator[tuple]:
            for _, block in sorted(own):
                for batch in pa.ipc.open_stream(block):
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        yield _order(row), row

        out = [row for _, row in merge([rows(blocks[key]) for key in sorted(blocks)])]
        return pa.Table.from_batches([_batch(out)])

    sliced = captures.mapInArrow(cut, _SLICE)
    return sliced.repartitionByRange(ranges, "range").groupBy("range").applyInArrow(merged, _CAPTURE)


def with_originals(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES
) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): the smallest id with an equal payload, if not its own.

    Only digests that occur twice are looked up, so payloads are not shuffled where these are few.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("digest", payload_digest(F.col("payload").cast("binary")))
    counted = rows.where(F.octet_length("payload") >= least).groupBy("digest")
    known = counted.agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    known = materialize(known, "repeated-digests")
    if fits_broadcast(known, BROADCAST_DIGESTS):
        known = F.broadcast(known)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(known, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def capture_histories(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES
) -> DataFrame:
    """One row per page, in the merged order of the archives' captures.

    Columns: url_key, captured, page_id, path and at (archive and offset), record_type,
    payload_bytes, payload_digest, refers_to. Null payloads are empty ones; null URLs are empty; a
    row without an id can be a revisit but is never the original; rows that repeat id and payload are
    all responses or all revisits; an empty table gives no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    written = materialize(
        write_archives(with_originals(pages, id_col, url_col, payload_col, least), folder), "archives"
    )
    # The archives are the unit of reading; the order of the list does not matter.
    runs = materialize(read_archives(written.repartition("path")), "captures")
    return merge_runs(runs)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
      substr(bits, i * 5 + j + 1, 1)::BIGINT * (16 >> j)))::BIGINT, 1)), '') AS payload_digest
  FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
