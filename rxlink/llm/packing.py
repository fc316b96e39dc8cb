"""Packing by the sum-of-squares rule.

Each task tokenizes its documents and packs them online. A document's tokens
are cut into full windows and a tail; the tail goes to that fill level of the
partially filled windows (or an empty one) that leaves the sum of the squared
counts of windows per level least, the counts being tracked in one array of
levels. When a task ends, the windows still open are closed: pieces are cut from
the emptiest to fill the fullest exactly, and the one left over is cut into
lengths that are powers of two, which need no padding. Nothing is shuffled. A
task holds only its open windows' tokens, and of those ``OPEN`` windows at most:
one more, and the fullest alone is closed, filled from the emptiest.

Defined results
    null or empty text: the end token alone. Rows that repeat a ``doc_id`` are
    packed each by itself. Null ``doc_id`` stays null. Very long texts: cut
    into full windows as they come. Empty table: empty result. Other columns
    are not part of the result. ``sequence_id`` is the task's number times
    2**32 plus the window's number there; rereading the same files gives the
    same result.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import require, text_of

WINDOW = 2048
END_ID = 1
OPEN = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


class Packer:
    """Sum-of-squares packing of one task's documents into windows of ``size``."""

    def __init__(self, size: int = WINDOW, first_id: int = 0, max_open: int = OPEN):
        self.size, self.next_id, self.max_open = size, first_id, max_open
        self.counts = np.zeros(size + 1, dtype=np.int64)  # open windows by fill level
        self.levels: list[list[list]] = [[] for _ in range(size + 1)]  # windows: lists of (doc, start, ids, doc_tokens)
        self.open = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def level_for(self, n: int) -> int:
        """The level whose windows take a piece of n tokens at the least sum of squares."""
        c, b = self.counts, self.size
        # a window that goes from h to h + n changes the sum by 2 c[h+n] - 2 c[h] + 2, a new one by 2 c[n] + 1, one that gets full by 1 - 2 c[h]
        change = 2 * c[n:] - 2 * c[: b + 1 - n] + 2
        change[-1] -= 1
        change[c[: b + 1 - n] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * c[n] + 1
        return int(np.argmin(change))

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self._close([(doc, at, ids[at : at + self.size], total)])
            at += self.size
        n = total - at
        if n == 0:
            return
        h = self.level_for(n)
        window = self._take(h) if h else []
        window.append((doc, at, ids[at:].copy(), total))
        if h + n == self.size:
            self._close(window)
            return
        self.levels[h + n].append(window)
        self.counts[h + n] += 1
        self.open += 1
        while self.open > self.max_open:
            self._close_fullest()

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def _close_fullest(self) -> None:
        """Fills the fullest window with pieces of the emptiest ones."""
        levels = np.flatnonzero(self.counts)
        fill = int(levels[-1])
        full = self._take(fill)
        while fill < self.size and self.open:
            low = int(np.flatnonzero(self.counts)[0])
            other = self._take(low)
            fill += self._pour(other, full, self.size - fill)
            left = sum(len(p[2]) for p in other)
            if left:
                self.levels[left].append(other)
                self.counts[left] += 1
                self.open += 1
        if fill == self.size:
            self._close(full)
        else:  # the emptier ones together did not fill it
            self.levels[fill].append(full)
            self.counts[fill] += 1
            self.open += 1

    @staticmethod
    def _pour(source: list, window: list, room: int) -> int:
        """Moves up to ``room`` tokens from the end of ``source`` to ``window``; how many."""
        moved = 0
        while source and moved < room:
            doc, start, ids, total = source.pop()
            cut = max(0, len(ids) - (room - moved))
            if cut:
                source.append((doc, start, ids[:cut], total))
            window.append((doc, start + cut, ids[cut:], total))
            moved += len(ids) - cut
        return moved

    def finish(self) -> None:
        """Closes what is open without padding."""
        rest = [w for level in reversed(self.levels) for w in level]  # fullest first
        self.levels = [[] for _ in range(self.size + 1)]
        self.counts[:] = 0
        self.open = 0
        low = len(rest) - 1
        for k, window in enumerate(rest):
            if k > low:
                break
            room = self.size - sum(len(p[2]) for p in window)
            while room and low > k:
                room -= self._pour(rest[low], window, room)
                if not rest[low]:
                    low -= 1
            if not room:
                self._close(window)
                continue
            self._close_in_powers(window)

    def _close_in_powers(self, window: list) -> None:
        left, queue = sum(len(p[2]) for p in window), window[::-1]
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part = []
            while want:
                doc, start, ids, total = queue.pop()
                if len(ids) > want:
                    queue.append((doc, start + want, ids[want:], total))
                    ids = ids[:want]
                part.append((doc, start, ids, total))
                want -= len(ids)
            self._close(part)


class ByteBpe:
    """The ids that the tokenizers library gives for a byte-level BPE file.

    The file's own vocabulary, read by tokenizers, is handed to tiktoken's
    merger, which finds the same ids about three times as fast; the two are
    compared on random texts and on every character of the basic plane when the
    file is loaded, and where they differ, or the
    file is of another kind, tokenizers encodes everything. Texts with one of
    the tokenizer's special strings, or with characters on whose classes the
    two libraries' patterns may differ, go to tokenizers too.
    """

    #: Fixed value: the pattern by which this kind of file cuts words.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    SAMPLE = "The cat's 12 hats,\n\n  they'll  sit -- été où Ñandú, 3.14!\n über\t123abc ''s x"
    SAMPLES = 400

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([*special, "[\x1c-\x1f\x85\u180e\u200b\u2028\u2029]", "[^\x00-\uffff]"])).search
        model = json.loads(tokenizer.to_str())
        pre = model.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer")
        self.fast = self._merger({t.content for t in tokenizer.get_added_tokens_decoder().values()}) if plain else None

    def _merger(self, added: set[str]):
        import tiktoken

        # byte-level vocabularies write the bytes that do not print as the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in added}
        encode = tiktoken.Encoding("byte-level", pat_str=self.WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        same = all(encode(t) == self.tokenizer.encode(t, add_special_tokens=False).ids for t in self._samples())
        return encode if same else None

    def _samples(self) -> Iterator[str]:
        """The sample, random mixtures of it, and every character of the basic plane that ``odd`` lets through."""
        yield self.SAMPLE
        rng = random.Random(1)
        for _ in range(self.SAMPLES):
            yield "".join(rng.choice(self.SAMPLE) for _ in range(rng.randrange(1, 80)))
        plane = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]) if not self.odd(c)]
        for lo in range(0, len(plane), 512):
            part = plane[lo : lo + 512]
            yield "".join(part)
            yield " a".join(part)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast(text), dtype=np.uint32)


_encoders: dict[str, ByteBpe] = {}


def _packing(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = ByteBpe(path)
        encoder, packer = _encoders[path], Packer(size, TaskContext.get().partitionId() << 32)

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.append(encoder.encode(text.as_py()), np.uint32(end_id)))
                if len(packer.out) >= 4096:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents in sequences of at most ``size`` tokens.

    tokenizer: a ``tokenizers`` file that every executor has at this path.
    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    require(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(_packing(tokenizer, size, end_id), PIECES)
