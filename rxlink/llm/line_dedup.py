"""Line dedup: one keeper document per frequent line, decided by streaming.

Every whole text is cut at ``\\n``; the key of a line is the line without ASCII
white space at either end and with A-Z in lower case, hashed to 128 bits. The
(hash, document, positions) rows are range-partitioned on hash *and* document,
so that one line in a third of all documents is spread over many tasks, and
sorted by hash, then document from the largest down, then position. Each task
streams its rows once: the first document of a run keeps the line, a second
one is held back until a third turns up, all others lose it. Runs that cross a
task's border are decided with the two border summaries of each task (two rows
a task, however large the input). What is returned for each document is a
zlib-compressed bitmap of the lines that stay; texts are touched once, when the
bitmaps are applied.

Defined results
    null or empty text: one empty line, kept. Null ``doc_id``: counts as one
    document, smaller than any other. Rows that repeat a ``doc_id`` count as
    one document; each row has its own bitmap, told apart by its text. Ties
    cannot occur, as the keeper is a document, not a row. Empty table: empty
    result. Other columns pass through untouched; internal names start with
    ``__ld_``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import ASCII_WS, ddl, require, shared_dir, text_of

MIN_CHARS = 20
MIN_DOCS = 3

_OCC = "__ld_h binary, __ld_doc long, __ld_row long, __ld_n int, __ld_pos array<int>"
_OUT_ROWS = 4096
_OUT_TEXTS = 256


def line_key(line: str) -> bytes:
    """Comparison form of a line (UTF-8)."""
    return line.strip(ASCII_WS).encode("utf-8", "surrogatepass").lower()


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("__ld_h", pa.binary()), ("__ld_doc", pa.int64()), ("__ld_row", pa.int64()), ("__ld_n", pa.int32()), ("__ld_pos", pa.list_(pa.int32()))])
        rows: list[tuple] = []
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, key, text in zip(docs, keys, batch.column(2)):
                lines = text.as_py().split("\n")
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and len(line.strip(ASCII_WS)) >= min_chars:
                        found.setdefault(hashlib.blake2b(line_key(line), digest_size=16).digest(), []).append(i)
                rows += [(h, doc, key, len(lines), at) for h, at in found.items()]
                if len(rows) >= _OUT_ROWS:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's first and last hash: in how many documents, and the largest."""
    schema = pa.schema([("h", pa.binary()), ("n", pa.int64()), ("doc", pa.int64())])
    first, run, seen = None, None, None
    for batch in batches:
        for h, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if run is None or h != run[0]:
                if first is None and run is not None:
                    first = run
                run, seen = [h, 1, doc], doc
            elif doc != seen:
                run[1], run[2], seen = run[1] + 1, _larger(run[2], doc), doc
    rows = [tuple(r) for r in (first, run) if r is not None]
    if rows:
        yield _batch(rows, schema)


def _losers(crossing: dict[bytes, tuple[int, int | None]], min_docs: int):
    """crossing: document count and keeper of the hashes that more than one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("__ld_doc", pa.int64()), ("__ld_row", pa.int64()), ("__ld_n", pa.int32()), ("__ld_pos", pa.list_(pa.int32()))])
        out: list[tuple] = []
        h, keeper, last, docs, known = None, None, None, 0, None
        held: list[tuple] = []  # rows of the documents after the keeper, fewer than min_docs - 1 of them
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for got, doc, *rest in zip(*columns):
                if got != h:
                    h, keeper, last, docs, held, known = got, doc, doc, 1, [], crossing.get(got)
                elif doc != last:
                    last, docs = doc, docs + 1
                if known is not None:
                    if known[0] >= min_docs and doc != known[1]:
                        out.append((doc, *rest))
                elif doc != keeper:
                    held.append((doc, *rest))
                    if docs >= min_docs:
                        out += held
                        held = []
                if len(out) >= _OUT_ROWS:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("__ld_doc", pa.int64()), ("__ld_row", pa.int64()), ("__ld_n", pa.int32()), ("__ld_bitmap", pa.binary())])
    for batch in batches:
        maps = []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3)):
            keep = np.ones(n, dtype=np.uint8)
            keep[np.concatenate([np.asarray(x, dtype=np.int64) for x in at.as_py()])] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(maps, pa.binary())], schema=schema)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The bitmaps of the documents that lose a line.

    Returns ``__ld_doc, __ld_row`` (hash of the row's text), ``__ld_n`` (lines)
    and ``__ld_bitmap`` (zlib of the packed bits, 1 = stays).
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    shared_dir(spark)
    occ = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of("text")), text_of("text")).mapInArrow(_occurrences(min_chars), _OCC)
    # checkpoint() keeps the dealt and sorted partitions, which a table would not
    occ = occ.repartitionByRange("__ld_h", F.desc("__ld_doc")).sortWithinPartitions("__ld_h", F.desc_nulls_last("__ld_doc"), "__ld_row").checkpoint()
    crossing: dict[bytes, tuple[int, int | None]] = {}
    tasks: dict[bytes, int] = {}
    for r in occ.select("__ld_h", "__ld_doc").mapInArrow(_borders, "h binary, n long, doc long").collect():  # one job; two rows a task
        h = bytes(r.h)
        n, doc = crossing.get(h, (0, None))
        crossing[h], tasks[h] = (n + r.n, _larger(doc, r.doc)), tasks.get(h, 0) + 1
    crossing = {h: v for h, v in crossing.items() if tasks[h] > 1}
    lost = occ.mapInArrow(_losers(crossing, min_docs), "__ld_doc long, __ld_row long, __ld_n int, __ld_pos array<int>")
    by_doc = lost.groupBy("__ld_doc", "__ld_row").agg(F.first("__ld_n").alias("__ld_n"), F.collect_list("__ld_pos").alias("__ld_pos"))
    return by_doc.mapInArrow(_bitmaps, "__ld_doc long, __ld_row long, __ld_n int, __ld_bitmap binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ending in (text, bitmap) get the kept text and the counts instead, a few at a time."""
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    for whole in batches:
        for lo in range(0, whole.num_rows, _OUT_TEXTS):
            batch = whole.slice(lo, _OUT_TEXTS)
            own = batch.num_columns - 2
            out = []
            for text, bitmap in zip(batch.column(own), batch.column(own + 1)):
                t, packed = text.as_py(), bitmap.as_py()
                if packed is None:
                    out.append({"text": t, "n_lines": t.count("\n") + 1, "n_dropped": 0})
                    continue
                lines = t.split("\n")
                keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=len(lines))
                kept = [x for x, k in zip(lines, keep) if k]
                out.append({"text": "\n".join(kept), "n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(out, kind)], names=[*batch.schema.names[:own], "__ld_kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``__ld_kept`` = (text, n_lines, n_dropped) in place of its text."""
    left = docs.withColumns({"__ld_key": F.col("doc_id").cast("long"), "__ld_hash": F.xxhash64(text_of("text")), "__ld_text": text_of("text")}).drop("text")
    on = left["__ld_key"].eqNullSafe(bitmaps["__ld_doc"]) & (left["__ld_hash"] == bitmaps["__ld_row"])
    joined = left.join(bitmaps.hint("shuffle_hash"), on, "left")  # the texts are streamed, not sorted
    rest = [c for c in docs.columns if c != "text"]
    joined = joined.select(*[left[c] for c in rest], "__ld_text", "__ld_bitmap")
    return joined.mapInArrow(_applied, f"{ddl(joined.select(*rest))}, __ld_kept struct<text:string,n_lines:long,n_dropped:long>")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drops the lines of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold, except in the largest ``doc_id`` holding them.

    Returns all columns of ``docs`` with ``text`` cut (``n_chars``, if there,
    recounted) and ``n_lines``, ``n_dropped`` added (replacing any of that name).
    """
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    new = {"text": F.col("__ld_kept.text"), "n_lines": F.col("__ld_kept.n_lines"), "n_dropped": F.col("__ld_kept.n_dropped")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__ld_kept.text").cast("long")
    names = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in names])
