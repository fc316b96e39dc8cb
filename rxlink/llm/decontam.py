"""Benchmark decontamination with an Aho-Corasick automaton.

The benchmark's items are cut into windows of ten normalised words (an item of
fewer words is one window) and all windows go into one automaton. Each text is
normalised, scanned once, and every hit is mapped back through the words'
offsets to the original text.

The automaton is built once a Python worker from the broadcast item texts, over
words, not letters: each word of the items is a symbol of two characters (any
other word of a text is one that no window holds), so a window of ten words
takes at most twenty nodes. Its size is checked: items beyond
``MAX_AUTOMATON_CHARS`` go to further automata, each with its own scan, whose
hits are united by document, so a benchmark of any size is matched whole within
bounded memory (a million characters of items take 126 MB in a worker).

Defined results
    null or empty text: no words, no hits. Null item text: no window. Items
    with equal windows are all reported. Null ``item_id``: reported as the
    string ``null``. Rows that repeat a ``doc_id`` are judged each by itself;
    an ``item_id`` repeated with other texts counts once. Empty tables: no
    hits, or an empty result. Other columns pass through; internal names start
    with ``__bd_``.
"""

from __future__ import annotations

import array
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import ddl, require, text_of

WINDOW = 10
MAX_AUTOMATON_CHARS = 2_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HITS = "__bd_words long, __bd_hit long, __bd_items array<string>, __bd_spans array<struct<start:int,end:int>>, __bd_runs array<struct<start:int,end:int>>"
_NEW = ["__bd_words", "__bd_hit", "__bd_items", "__bd_spans", "__bd_runs"]


def normal_words(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


def windows(words: list[str], size: int = WINDOW) -> list[list[str]]:
    """All runs of ``size`` words; the whole item if it is shorter; none if empty."""
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


class Codes(dict):
    """Words to symbols of two characters, the first and the second from sets apart."""

    FIRST, SECOND, NONE = 0x1000, 0x20000, "\x01\x02"

    def __init__(self, words: list[str]):
        side = max(1, math.isqrt(len(words)) + 1)
        super().__init__((w, chr(self.FIRST + i // side) + chr(self.SECOND + i % side)) for i, w in enumerate(words))

    def __missing__(self, word: str) -> str:
        return self.NONE

    def spell(self, words: list[str]) -> str:
        return "".join(map(self.__getitem__, words))


class Machine:
    """The automaton over the windows of items, and by window its words and items."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        texts = [(item, normal_words(text or "")) for item, text in items]
        self.codes = Codes(sorted({w for _, words in texts for w in words}))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.sizes, self.items = array.array("i"), []
        for item, words in texts:
            own = (item,)
            for w in windows(words, size):
                at = self.automaton.get(key := self.codes.spell(w), -1)
                if at < 0:
                    self.automaton.add_word(key, len(self.items))
                    self.sizes.append(len(w))
                    self.items.append(own)
                elif item not in self.items[at]:
                    self.items[at] += own
        if self.items:
            self.automaton.make_automaton()


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs (both ends inclusive) without overlaps, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(machine: Machine, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
    """How many words, the hit runs of words, the items."""
    words = normal_words(text)
    if not machine.items or not words:
        return len(words), [], set()
    found = [(end // 2, at) for end, at in machine.automaton.iter(machine.codes.spell(words))]
    items = {i for at in {at for _, at in found} for i in machine.items[at]}
    return len(words), merged([(last - machine.sizes[at] + 1, last) for last, at in found]), items


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The runs as code points of the original text, end exclusive."""
    if not runs:
        return []
    where = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [{"start": where[a][0], "end": where[b][1]} for a, b in runs]


_machines: dict[tuple, Machine] = {}


def _scanner(shared, digest: str, size: int, again: bool):
    """again: earlier scans' columns stand before the text and are united with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (digest, size) not in _machines:
            _machines.clear()
            _machines[digest, size] = Machine(shared.value, size)
        machine = _machines[digest, size]
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            own = batch.num_columns - 1 - (5 if again else 0)
            words, hit, who, spans, flat = [], [], [], [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                text = t.as_py()
                n, runs, items = scan(machine, text)
                if again:
                    runs = merged([*runs, *((r["start"], r["end"]) for r in batch.column(own + 4)[i].as_py())])
                    items |= set(batch.column(own + 2)[i].as_py())
                words.append(n)
                hit.append(sum(b - a + 1 for a, b in runs))
                who.append(sorted(items))
                spans.append(spans_of(text, runs))
                flat.append([{"start": a, "end": b} for a, b in runs])
            columns = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(who, pa.list_(pa.string())), pa.array(spans, pairs), pa.array(flat, pairs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *columns], names=[*batch.schema.names[:own], *_NEW])

    return run


def item_parts(benchmark: DataFrame, max_chars: int = MAX_AUTOMATON_CHARS) -> list[list[tuple[str, str]]]:
    """The items, dealt to lists of at most ``max_chars`` (one item at least)."""
    require(benchmark, "item_id", "text")
    parts: list[list[tuple[str, str]]] = []
    room = 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), text_of("text").alias("t")).toLocalIterator():
        if not parts or room < len(r.t):
            parts.append([])
            room = max_chars
        parts[-1].append((r.i, r.t))
        room -= len(r.t)
    return parts or [[]]


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_chars: int = MAX_AUTOMATON_CHARS) -> DataFrame:
    """``docs`` with ``__bd_words, __bd_hit, __bd_items`` (sorted) and ``__bd_spans``
    (hit passages as code points of the original text)."""
    require(docs, "doc_id", "text")
    sc = docs.sparkSession.sparkContext
    kinds = f"{ddl(docs)}, {_HITS}"
    out = docs
    for k, part in enumerate(item_parts(benchmark, max_chars)):
        digest = hashlib.sha256(repr(part).encode("utf-8", "surrogatepass")).hexdigest()
        out = out.withColumn("__bd_text", text_of("text")).mapInArrow(_scanner(sc.broadcast(part), digest, size, k > 0), kinds)
    return out.drop("__bd_runs")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, columns as they were."""
    return scan_benchmark(docs, benchmark, size).filter(F.col("__bd_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
