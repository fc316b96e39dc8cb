"""Token counts through a digest cache.

The content digest of a text (SHA-256 of its UTF-8 bytes, null as empty) and
the tokenizer-version digest (SHA-256 of the model file) are the key of a
stored count. Each task first drops texts whose digest it has seen, the rest
are dealt by digest, what the cache already has is joined away, the distinct
misses are encoded, and the new counts are appended to the cache table. The
documents then join the cache on the digests alone: texts move at most once,
compressed, and one text repeated in a third of all rows moves once a task.
Digests that hold more than one in ``SHARE`` of all rows, fewer than ``SHARE``
therefore, are counted exactly and broadcast; their rows are dealt to ``SALTS``
keys for that join, to each of which their stored count is copied.

Defined results
    null or empty text: zero bytes and the library's count for the empty
    string. Repeated rows and ids: every row is counted. Null ``doc_id``
    stays null. Empty table: empty result, nothing appended. Other columns
    pass through; internal names start with ``__tc_``. Running twice over one
    cache encodes nothing the second time; rows that two concurrent runs both
    append are equal and count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import require, scratch_path, text_of

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
_FLUSH_BYTES = 1_000_000
#: A digest of more than one in so many rows is dealt to ``SALTS`` keys.
SHARE, SALTS = 4096, 64


def tokenizer_digest(model: str) -> str:
    return hashlib.sha256(Path(model).read_bytes()).hexdigest()


def load_counter(model: str):
    """texts -> counts by the library for the file: sentencepiece or tokenizers."""
    if model.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        return lambda texts: [len(x) for x in encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


_counters: dict[str, object] = {}


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct texts, compressed."""
    seen: set[bytes] = set()
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        digests, texts = [], []
        for text in batch.column(0):
            raw = text.as_py().encode()
            digest = hashlib.sha256(raw).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(pack.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["__tc_digest", "__tc_text"])


def _encoder(model: str, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = load_counter(model)
        count, seen, unpack = _counters[model], set(), zstandard.ZstdDecompressor()

        def counted(keys: list[bytes], texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([digest] * len(keys)), pa.array(keys, pa.binary()), pa.array(count(texts), pa.int64())], names=["tokenizer", "content", "n_tokens"])

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                seen.add(key)
                raw = unpack.decompress(packed.as_py())
                keys.append(key)
                texts.append(raw.decode())
                size += len(raw)
                if size >= _FLUSH_BYTES:
                    yield counted(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield counted(keys, texts)

    return run


def count_tokens(docs: DataFrame, model: str, cache: str | None = None) -> DataFrame:
    """``docs`` with ``__tc_bytes`` and ``__tc_tokens``.

    model: a file that every executor has at this path. cache: a folder that
    all executors share; with None a new one, dropped with the application.
    """
    require(docs, "text")
    spark = docs.sparkSession
    version = tokenizer_digest(model)
    distinct = docs.select(text_of("text")).mapInArrow(_first_seen, "__tc_digest binary, __tc_text binary").repartition("__tc_digest")
    if cache is None:
        cache = scratch_path(spark, "token-counts")
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    misses = distinct.join(stored.select("content").hint("shuffle_hash"), F.col("__tc_digest") == F.col("content"), "left_anti")
    misses.mapInArrow(_encoder(model, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    spark.catalog.refreshByPath(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    counts = counts.groupBy(F.col("content").alias("__tc_content")).agg(F.max("n_tokens").alias("__tc_tokens"))
    digest = F.unhex(F.sha2(text_of("text"), 256))
    hot = docs.select(digest.alias("__tc_hot")).groupBy("__tc_hot").agg(F.count("*").alias("__tc_rows")).filter(F.col("__tc_rows") * SHARE > docs.count())
    hot = F.broadcast(hot.select("__tc_hot"))
    is_hot = F.col("__tc_hot").isNotNull()
    copies = F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0)))
    counts = counts.join(hot, F.col("__tc_content") == F.col("__tc_hot"), "left").withColumn("__tc_copy", copies).drop("__tc_hot")
    keyed = docs.withColumns({"__tc_bytes": F.octet_length(text_of("text")).cast("long"), "__tc_digest": digest})
    keyed = keyed.join(hot, F.col("__tc_digest") == F.col("__tc_hot"), "left")
    keyed = keyed.withColumn("__tc_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")).drop("__tc_hot")
    on = (F.col("__tc_digest") == F.col("__tc_content")) & (F.col("__tc_salt") == F.col("__tc_copy"))
    return keyed.join(counts, on, "left").drop("__tc_digest", "__tc_content", "__tc_salt", "__tc_copy")
