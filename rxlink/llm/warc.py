"""WARC archives: a deduplicating writer and a salvaging reader.

Writing: each task writes archives of gzip members, one record a member, into
a folder that all executors share, under a temporary name that is renamed when
the archive is whole, so a repeated task overwrites its own file. Among equal
payloads the one with the largest id is the ``response``, the others are
``revisit`` records that name it.

A payload that very many rows share travels with its response alone: its
revisits drop the body before any shuffle.

Reading: archives are streamed, a few members in memory at a time. What a
record may hold is bounded by its own header: a plain record must end in its
closing line breaks where its length says (looked up there before anything is
buffered), and a gzip member must not inflate beyond its record. A member
that fails its checks (gzip header, CRC, record header, length, digests) is
not the end of the archive: the reader goes on to the next place where a gzip
member or, in plain archives, a version line starts and parses, recovers the
records after it, and reports the bytes between as a quarantined gap.

Defined results
    null html: an empty payload. Null url: no target URI. Equal payloads with
    tied (repeated) ids: one row, the least in the order of its url, is the
    response, the others revisit it. Null ids sort below all and are written
    without an id. Empty table: no archive, an empty result. Other columns are
    not written; internal names start with ``__wa_``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxlink.llm.common import require, scratch_path, text_of, written

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 64_000_000
MAX_READERS = 10_000
#: A payload of this many copies is frequent, or of so many that at most FREQUENT payloads are: their keys are broadcast.
COPIES, FREQUENT = 10_000, 50_000
_STEP = 1 << 20
_PIECE = 1 << 14

RECORDS = "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_start long, gap_end long, reason string"
_SCHEMA = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string()),
])


class Damaged(ValueError):
    """A record that fails a check."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, known: tuple[str, int] | None = None) -> bytes:
    """One record, not compressed; known: the payload's digest and length, where it is a revisit whose payload is not at hand."""
    digest, whole = known or (sha1_base32(payload), len(payload))
    body = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest if not revisit else sha1_base32(b'')}"),
        ("X-Payload-Length", str(whole)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    if url is not None:
        head.insert(1, ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """A whole record's fields; raises ``Damaged`` when a check fails."""
    end = record.find(b"\r\n\r\n")
    if not re.match(rb"WARC/\d+\.\d+\r\n", record) or end < 0:
        raise Damaged("no record header")
    head = {}
    for line in record[:end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise Damaged("a header line without a colon")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    body = record[end + 4 : end + 4 + length]
    if len(body) != length or record[end + 4 + length :] != b"\r\n\r\n":
        raise Damaged("content length does not fit")
    block = head.get("warc-block-digest", "").removeprefix("sha1:")
    if block and block != sha1_base32(body):
        raise Damaged("block digest does not fit")
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != sha1_base32(body):
        raise Damaged("payload digest does not fit")

    def page(field: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", head.get(field, ""))
        return int(m[1]) if m else None

    whole = head.get("x-payload-length", "")
    return {
        "page_id": page("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": page("warc-refers-to"),
        "payload_bytes": int(whole) if kind == "revisit" and whole.isdigit() else length, "payload_digest": digest or sha1_base32(body), "payload": None if kind == "revisit" else body,
    }


class _Window:
    """A sliding view of a stream: ``data`` from ``at`` on is not yet consumed."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.data, self.at, self.start, self.ended = read, bytearray(), 0, 0, False

    def __len__(self) -> int:
        return len(self.data) - self.at

    def more(self) -> bool:
        got = b"" if self.ended else self.read(_STEP)
        self.ended = self.ended or not got
        self.data += got
        return bool(got)

    def find(self, what: bytes, begin: int = 0) -> int:
        found = self.data.find(what, self.at + begin)
        return found - self.at if found >= 0 else -1

    def part(self, begin: int, end: int) -> bytes:
        return bytes(self.data[self.at + begin : self.at + end])

    def drop(self, n: int) -> None:
        self.at, self.start = self.at + n, self.start + n
        if self.at > 4 * _STEP and 2 * self.at > len(self.data):  # seldom, so that dropping takes linear time
            del self.data[: self.at]
            self.at = 0


def _gzip_member(w: _Window) -> tuple[bytes, int]:
    """The member at the window's start and its compressed length."""
    z, out, used, limit = zlib.decompressobj(31), bytearray(), 0, -1
    while not z.eof:
        piece = z.unconsumed_tail
        if not piece:
            if used == len(w) and not w.more():
                raise Damaged("the member is cut off")
            piece = w.part(used, used + _PIECE)
            used += len(piece)
        try:
            out += z.decompress(piece, _STEP)
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        if limit < 0 and (end := out.find(b"\r\n\r\n")) >= 0:
            limit = end + 8 + _length(bytes(out[:end]))
        if 0 <= limit < len(out):
            raise Damaged("content length does not fit")
    return bytes(out), used - len(z.unused_data)


def _length(head: bytes) -> int:
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", head)
    if not m:
        raise Damaged("no content length")
    return int(m[1])


def _plain_record(w: _Window, ends: Callable[[int], bool] | None) -> tuple[bytes, int]:
    line = 0
    while True:  # a header's lines, up to an empty one
        while (end := w.find(b"\r\n", line)) < 0:
            if not w.more():
                raise Damaged("no record header")
        if end == line:
            break
        text = w.part(line, end)
        if not re.fullmatch(rb"WARC/\d+\.\d+", text) if line == 0 else b":" not in text:
            raise Damaged("no version line" if line == 0 else "a header line without a colon")
        line = end + 2
    size = line + 2 + _length(w.part(0, line)) + 4
    if ends is not None and not ends(w.start + size):
        raise Damaged("content length does not fit")
    while len(w) < size:
        if not w.more():
            raise Damaged("the record is cut off")
    return w.part(0, size), size


def salvage(read: Callable[[int], bytes], ends: Callable[[int], bool] | None = None) -> Iterator[dict]:
    """Records and gaps of an archive, in order; ``read(n)`` gives its next bytes.

    ends: whether a record's closing line breaks stand before that offset;
    without it a damaged length is noticed only after reading as far as it says.
    """
    w = _Window(read)
    gap, reason = None, ""
    while len(w) or w.more():
        while len(w) < 10 and w.more():
            pass
        start = w.part(0, 5)
        zipped = start[:3] == b"\x1f\x8b\x08"
        try:
            if not zipped and start != b"WARC/":
                raise Damaged("neither a gzip member nor a version line")
            raw, size = _gzip_member(w) if zipped else _plain_record(w, ends)
            row = parse(raw)
        except Damaged as e:
            if gap is None:
                gap, reason = w.start, str(e)
            w.drop(1)
            while True:  # on to the next place where a record can start
                at = min((x for x in (w.find(b"\x1f\x8b\x08"), w.find(b"WARC/")) if x >= 0), default=-1)
                if at >= 0:
                    w.drop(at)
                    break
                w.drop(max(0, len(w) - 4))
                if not w.more():
                    w.drop(len(w))
                    break
            continue
        if gap is not None:
            yield {"gap_start": gap, "gap_end": w.start, "reason": reason}
            gap = None
        yield {"offset": w.start, **row}
        w.drop(size)
    if gap is not None:
        yield {"gap_start": gap, "gap_end": w.start, "reason": reason}


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (fs.LocalFileSystem(), folder)


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _filesystem(folder)
        task = TaskContext.get()
        out, part, size, count, temporary = None, 0, 0, 0, ""
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, part, size, count
            if out is not None:
                out.close()
                name = f"{at}/part-{task.partitionId():06d}-{part:04d}.warc.gz"
                files.move(temporary, name)
                done.append((name, count, size))
                out, part, size, count = None, part + 1, 0, 0

        for batch in batches:
            htmls = batch.column(2)
            small = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)))
            for i, (page, url, refers, revisit, digest, length) in enumerate(small):
                known = (base64.b32encode(bytes.fromhex(digest)).decode(), length)
                record = render(page, url, b"" if revisit else htmls[i].as_py().encode(), refers, revisit, known)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(record) + z.flush()
                if out is None:
                    temporary = f"{at}/.tmp-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}"
                    out = files.open_output_stream(temporary)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id, url, html) into ``folder``.

    Payloads of at least ``min_revisit_bytes`` that are equal (SHA-256 and
    length) become one response and revisits. Returns the written manifest
    ``archive, records, bytes``.
    """
    require(pages, "page_id", "url", "html")
    files, at = _filesystem(folder)
    files.create_dir(at, recursive=True)
    html = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"__wa_key": F.sha2("html", 256), "__wa_sha1": F.sha1("html"), "__wa_size": F.octet_length("html").cast("long")})
    id_or_least = F.coalesce("page_id", F.lit(-(1 << 63)))
    largest = rows.groupBy("__wa_key").agg(F.max(id_or_least).alias("top"), F.count("*").alias("n")).filter("n > 1")
    largest = written(largest.select(F.col("__wa_key").alias("k"), "top", "n"), "warc-copies")
    many = max(COPIES, -(-(largest.agg(F.sum("n")).first()[0] or 0) // FREQUENT))
    hot = F.broadcast(largest.filter(F.col("n") >= many).select(F.col("k").alias("__wa_hot"), F.col("top").alias("__wa_top")))  # FREQUENT rows at most
    rows = rows.join(hot, F.col("__wa_key") == F.col("__wa_hot"), "left")
    known = F.col("__wa_hot").isNotNull()
    rows = rows.withColumn("html", F.when(~(known & (F.col("__wa_size") >= min_revisit_bytes) & (id_or_least != F.col("__wa_top"))), F.col("html")))
    # frequent payloads need no second look: their rows are spread by a key that matches none
    spread = F.when(known, F.concat_ws("~", F.lit(""), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("__wa_key"))
    both = rows.withColumn("__wa_spread", spread).join(largest.filter(F.col("n") < many).drop("n").hint("shuffle_hash"), F.col("__wa_spread") == F.col("k"), "left")
    both = both.withColumns({"k": F.coalesce("__wa_hot", "k"), "top": F.coalesce("__wa_top", "top")})
    # where ids repeat, the response is one row: of those with the top id, the first by url
    top = id_or_least == F.col("top")
    copy = F.col("k").isNotNull() & (F.col("__wa_size") >= min_revisit_bytes)
    ids = rows.groupBy("page_id").count().filter("count > 1").limit(1)
    if ids.isEmpty():
        revisit = copy & ~top
    else:
        w = Window.partitionBy("k", "page_id").orderBy(F.col("url").asc_nulls_first())
        both = both.withColumn("__wa_rank", F.row_number().over(w))
        revisit = copy & ~(top & (F.col("__wa_rank") == 1))
    refers = F.when(revisit & (F.col("top") != -(1 << 63)), F.col("top"))
    ready = both.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), refers.alias("refers_to"), revisit.alias("revisit"), F.col("__wa_sha1").alias("sha1"), F.col("__wa_size").alias("size"))
    return written(ready.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "warc-manifest")


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, at = _filesystem(name) if re.match(r"\w+:/", name) else (_filesystem(folder)[0], name)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as stream, files.open_input_file(at) as whole:
                    total = whole.size()

                    def ends(offset: int) -> bool:
                        return offset <= total and whole.read_at(4, offset - 4) == b"\r\n\r\n"  # noqa: B023

                    for row in salvage(lambda n: stream.read(n), ends):  # noqa: B023
                        size += len(row.get("payload") or b"")
                        if not with_payload:
                            row["payload"] = None
                        rows.append({"archive": name, **row})
                        if len(rows) >= 1024 or size >= 16_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def read_archives(archives: DataFrame, folder: str = "/", with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``gap_start`` set) of the archives named in
    the first column, an archive a task at a time."""
    name = archives.columns[0]
    tasks = max(1, min(archives.count(), MAX_READERS))  # stated, so that small manifests are not read by one task
    return archives.select(F.col(name).cast("string").alias("archive")).repartition(tasks, "archive").mapInArrow(_reader(folder, with_payload), RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` and reads the archives back."""
    folder = folder or scratch_path(spark, "warc")
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder, with_payload=False)
