"""Near-dedup of texts by set similarity: SetSketch, likelihood, exact check.

A document's set is its distinct five-word shingles. Documents with one set
are one class from the start (aggregated before anything is joined). For each
class a SetSketch is made: 384 registers, each the exponentially spaced,
truncated value of the least of Exp(1) points that the shingles put there;
such registers are mergeable by maximum, and equal with a probability close to
the Jaccard similarity. The registers are cut into bands, the keys, as long as
a pair at the threshold misses all of them once in a million at most
(``layout``): at 0.85 eight registers make a band, and 48 bands miss one pair in
four million; at 0.80 six do, and 64 bands miss one in 280 million.

Of each band, every class is first compared with the least one (a star, never
all pairs): the similarity is estimated jointly from the registers that are
larger, smaller and equal by maximum likelihood, with the set sizes known, and
what is not far below the threshold is verified on the full sets. A hub of many
partners is copied to chunks of them. The links found are contracted, and a
band whose other members are then all connected is done, so that a large group
of near copies costs work in proportion to its size. In the other bands pairs
that are not yet connected are compared, the band cut into blocks of ``BLOCK``
and each pair of blocks being a task of its own; registers (768 bytes) go
there, and texts only of documents with a likely partner. A pair is compared in
the first band it shares alone, and only links of a spanning forest leave the
task.

Defined results
    no words (null, empty or blank text): an empty set, linked with nothing.
    Fewer than five words: the whole sequence is the one shingle. Rows that
    repeat a ``doc_id``: each row has its own set and component (classes are
    named by numbers of their own, not by documents), and is kept or not by itself. Null
    ``doc_id``: its set links nothing else and its component is null, kept
    true. Exact copies are linked. Empty table: empty result. Other columns
    pass through; internal names start with ``__nd_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import require, text_of, written
from rxlink.llm.graph import components

WORDS = 5
PER_CENT = 85
REGISTERS = 384
#: The share of pairs at the threshold that may share no band.
MISS = 1e-6
BASE, RATE, TOP = 1.001, 20.0, 65534
#: An estimate's standard error is 0.018 at 0.85 and 0.020 at 0.80; pairs this far below are seven of them or more away.
SLACK = 0.15
BLOCK = 512
#: Partners of a hub that one task takes.
STAR_CHUNK = 4096
#: Tasks that the rows of one band are dealt to when they learn the band's facts.
SALTS = 16

_MASK = (1 << 64) - 1
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & _MASK | 1) for i in range(64)]
_CACHE_WORDS = 150_000
_CACHE_TEXTS = 20_000


def layout(per_cent: int) -> tuple[int, int]:
    """Registers a band and bands: the longest bands that meet ``MISS`` at the threshold."""
    for rows in (n for n in range(REGISTERS, 1, -1) if REGISTERS % n == 0):
        if (1 - (per_cent / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return rows, REGISTERS // rows
    return 1, REGISTERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hashes = _WordHashes()


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_word_hashes) > _CACHE_WORDS:
        _word_hashes.clear()
    h = np.fromiter(map(_word_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = mix(out * _ODD[i] + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of several sets.

    Each element is a Poisson process of rate ``REGISTERS`` whose points fall on
    registers at random, so each register sees a process of rate one and keeps
    its earliest point; an element stops once it is past all registers kept.
    """
    n, m = len(sets), REGISTERS
    first = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    seed = np.concatenate(sets) if n else np.empty(0, dtype=np.uint64)
    at = np.zeros(len(seed))
    step = 0
    while len(seed):
        r = mix(seed + np.uint64((0xD1342543DE82EF95 * (step + 1)) & _MASK))
        at = at - np.log1p((r >> np.uint64(24)).astype(np.float64) * -(2.0**-40)) / m  # 40 bits say when, 24 where
        where = ((r & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
        np.minimum.at(first, owner * m + where.view(np.int64), at)
        step += 1
        if step < 8 or step % 8 == 0:
            keep = at < first.reshape(n, m).max(axis=1)[owner]
            seed, at, owner = seed[keep], at[keep], owner[keep]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(first / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16).reshape(n, m)


def batches_of(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Runs of sets to be sketched at once: few enough for their temporary arrays."""
    part, size = [], 0
    for s in sets:
        part.append(s)
        size += len(s)
        if len(part) == 128 or size >= 100_000:
            yield part
            part, size = [], 0
    if part:
        yield part


def band_keys(registers: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """64-bit keys of the bands, by row of ``registers``."""
    rows, bands = layout(per_cent)
    parts = registers.astype(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * _ODD[i] + parts[:, :, i])
    return key.view(np.int64)


_GRID = np.linspace(0.005, 0.995, 100)


def likely_similarity(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of one sketch with others, sizes known."""
    more = (one > others).sum(axis=1)[:, None]
    less = (one < others).sum(axis=1)[:, None]
    u = (size / (size + sizes))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)  # what the sizes allow
    j = _GRID * top

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    score = more * np.log(a) + less * np.log(b) + (REGISTERS - more - less) * np.log(np.clip(1 - a - b, 1e-12, 1))
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _facts(texts: list[str]) -> list[tuple[int, int, int, bytes | None]]:
    """Each text's set: its 128-bit digest as two integers, its size, its registers."""
    sets = [shingles(t) for t in texts]
    registers = [r for part in batches_of(sets) for r in sketches(part)]
    return [(int(mix(s).sum(dtype=np.uint64)), int(mix(s * _ODD[7]).sum(dtype=np.uint64)), len(s), r.tobytes()) if len(s) else (0, 0, 0, None) for s, r in zip(sets, registers)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: the set's 128-bit digest as two longs, its size, its registers; a text is worked on once a task."""
    import xxhash

    known: dict[bytes, tuple] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            texts = batch.column(2)[lo : lo + 128].to_pylist()
            keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            fresh = {k: t for k, t in zip(keys, texts) if k not in known}
            found = dict(zip(fresh, _facts(list(fresh.values()))))
            one, two, n, packed = zip(*(found.get(k) or known[k] for k in keys))
            if len(known) > _CACHE_TEXTS:
                known.clear()
            known |= found
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i)[lo : lo + 128] for i in range(2)), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                names=["__nd_doc", "__nd_text", "__nd_a", "__nd_b", "__nd_n", "__nd_sketch"],
            )


def _stacked(sketch: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint16).reshape(len(sketch), REGISTERS)


def _band_rows(per_cent: int):
    """(cid, sketch) to a row (key, cid) a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_stacked(batch.column(1)), per_cent)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), keys.shape[1]))], names=["key", "cid"])

    return run


def _likely(per_cent: int):
    """Of pairs (cid, hub, n, sketch, hub's n and sketch), those that the likelihood does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, m = np.asarray(part.column(2)), np.asarray(part.column(4))
                good = 100 * np.minimum(n, m) >= per_cent * np.maximum(n, m)
                good &= likely_similarity(_stacked(part.column(5)), m, _stacked(part.column(3)), n) >= per_cent / 100 - SLACK
                yield part.select([0, 1]).filter(pa.array(good))

    return run


def similar(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """The exact check, on full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _verified(per_cent: int):
    """Of pairs (cid, hub, text, hub's text), the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub_set = None, None
        for batch in batches:
            good = []
            for hub, text, hub_text in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if hub != last:
                    last, hub_set = hub, shingles(hub_text.as_py())
                good.append(similar(shingles(text.as_py()), hub_set, per_cent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_())).rename_columns(["u", "v"])

    return run


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class _Block:
    """The pairs of one pair of blocks of a band, in the order of ids: those of
    left x right, first met in this band, that labels do not connect yet."""

    def __init__(self, group: pd.DataFrame, per_cent: int):
        group = group.drop_duplicates("cid").sort_values("cid")
        self.one, self.two, self.key = int(group["one"].iloc[0]), int(group["two"].iloc[0]), int(group["key"].iloc[0])
        self.ids, self.sizes, self.labels = (group[c].to_numpy() for c in ("cid", "n", "label"))
        self.left, self.right = (group["block"].to_numpy() == x for x in (self.one, self.two))
        self.registers = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint16).reshape(len(group), REGISTERS)
        self.keys, self.per_cent, self.group = band_keys(self.registers, per_cent), per_cent, group

    def partners(self, i: int, labels: np.ndarray) -> np.ndarray:
        js = np.arange(i + 1, len(self.ids))
        js = js[((self.left[i] & self.right[js]) | (self.right[i] & self.left[js])) & (labels[js] != labels[i])]
        js = js[100 * np.minimum(self.sizes[i], self.sizes[js]) >= self.per_cent * np.maximum(self.sizes[i], self.sizes[js])]
        if len(js):
            shared = self.keys[js] == self.keys[i]
            js = js[shared.any(axis=1) & (self.keys[i][shared.argmax(axis=1)] == self.key)]
        if len(js):
            js = js[likely_similarity(self.registers[i], self.sizes[i], self.registers[js], self.sizes[js]) >= self.per_cent / 100 - SLACK]
        return js


def _needed(per_cent: int):
    """Which documents of a pair of blocks have a likely partner there."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block = _Block(group, per_cent)
        needed = np.zeros(len(block.ids), dtype=bool)
        for i in range(len(block.ids)):
            js = block.partners(i, block.labels)
            needed[js] = True
            needed[i] |= len(js) > 0
        return block.group[needed][["key", "one", "two", "block", "cid", "n", "label", "sketch"]]

    return run


def _verify_blocks(per_cent: int):
    """Links of a spanning forest over the labels of a pair of blocks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block, out = _Block(group, per_cent), []
        names, labels = np.unique(block.labels, return_inverse=True)
        known = _Union(len(names))
        sets = [shingles(t) for t in block.group["text"]]
        for i in range(len(sets)):
            for j in block.partners(i, known.roots()[labels]).tolist():
                if known.root(labels[i]) != known.root(labels[j]) and similar(sets[i], sets[j], per_cent):
                    known.join(labels[i], labels[j])
                    out.append((int(block.ids[j]), int(block.ids[i])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def document_sets(docs: DataFrame) -> DataFrame:
    """Written table ``__nd_doc, __nd_text`` (hash of the text) ``, __nd_a, __nd_b, __nd_n, __nd_sketch`` of all rows."""
    require(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of("text")), text_of("text"))
    return written(rows.mapInArrow(_sets, "__nd_doc long, __nd_text long, __nd_a long, __nd_b long, __nd_n long, __nd_sketch binary"), "near-sets")


def classes_of(sets: DataFrame) -> DataFrame:
    """Written table of the distinct sets: ``cid`` (a number of its own for each
    digest), ``a, b, n, sketch``, the least document ``rep`` and its text's hash."""
    real = sets.filter((F.col("__nd_n") > 0) & F.col("__nd_doc").isNotNull())
    least = F.min(F.struct("__nd_doc", "__nd_text")).alias("least")
    classes = real.groupBy(F.col("__nd_a").alias("a"), F.col("__nd_b").alias("b")).agg(F.first("__nd_n").alias("n"), F.first("__nd_sketch").alias("sketch"), least)
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "a", "b", "n", "sketch", F.col("least.__nd_doc").alias("rep"), F.col("least.__nd_text").alias("hash"))
    return written(classes, "near-classes")


def _copied(rows: DataFrame, by: str, chunks: str) -> DataFrame:
    """``rows`` once for each of the chunks that column counts, as ``chunk``."""
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))).drop(chunks)


def star_links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, per_cent: int) -> DataFrame:
    """Verified links of the pairs (cid, hub).

    A hub with many partners is copied to chunks of them, so neither its
    registers nor its text draw all partners into one task.
    """
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(STAR_CHUNK)).cast("int").alias("chunks"))
    pairs = pairs.join(many, "hub").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).drop("chunks")
    own = classes.select("cid", "n", "sketch")
    hubs = _copied(many.join(own.withColumnRenamed("cid", "hub"), "hub"), "hub", "chunks").withColumnsRenamed({"n": "hub_n", "sketch": "hub_sketch"})
    both = pairs.join(own, "cid").join(hubs, ["hub", "chunk"]).select("cid", "hub", "n", "sketch", "hub_n", "hub_sketch")
    likely = written(both.mapInArrow(_likely(per_cent), "cid long, hub long"), "near-likely")
    many = likely.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(STAR_CHUNK)).cast("int").alias("chunks"))
    pairs = likely.join(many, "hub").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).drop("chunks")
    mine = pairs.join(classes.select("cid", "rep", "hash"), "cid")
    mine = texts.join(mine.hint("shuffle_hash"), (F.col("__nd_doc") == F.col("rep")) & (F.col("__nd_hash") == F.col("hash"))).select("cid", "hub", "chunk", F.col("__nd_whole").alias("text"))
    hubs = many.join(classes.select(F.col("cid").alias("hub"), "rep", "hash"), "hub")
    hubs = texts.join(hubs.hint("shuffle_hash"), (F.col("__nd_doc") == F.col("rep")) & (F.col("__nd_hash") == F.col("hash"))).select("hub", "chunks", F.col("__nd_whole").alias("hub_text"))
    both = mine.join(_copied(hubs, "hub", "chunks").hint("merge"), ["hub", "chunk"]).select("cid", "hub", "text", "hub_text")
    return both.mapInArrow(_verified(per_cent), "u long, v long")


def block_links(rest: DataFrame, classes: DataFrame, texts: DataFrame, per_cent: int) -> DataFrame:
    """Verified links inside bands (key, cid, label), pair of blocks by pair of blocks.

    Registers alone go to the pairs of blocks; texts follow for the documents
    that have a likely, not yet connected partner there.
    """
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = _by_key(rest, sizes).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # a document of block k takes part in every pair of blocks that holds k
    mates = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("one"), F.greatest(x, F.col("block")).alias("two")))
    placed = placed.join(classes.select("cid", "n", "sketch"), "cid").select("key", "block", "cid", "label", "n", "sketch", F.explode(mates).alias("p"))
    placed = placed.select("key", "p.one", "p.two", "block", "cid", "n", "label", "sketch")
    pair = ["key", "one", "two"]
    needed = written(placed.groupBy(*pair).applyInPandas(_needed(per_cent), placed.schema), "near-needed").join(classes.select("cid", "rep", "hash"), "cid")
    loads = texts.join(needed.hint("shuffle_hash"), (F.col("__nd_doc") == F.col("rep")) & (F.col("__nd_hash") == F.col("hash")))
    loads = loads.select(*pair, "block", "cid", "n", "label", "sketch", F.col("__nd_whole").alias("text"))
    return loads.groupBy(*pair).applyInPandas(_verify_blocks(per_cent), "u long, v long")


def _by_key(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` (key, cid) with their band's facts; a band that very many share is dealt to ``SALTS`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
    return salted.join(facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"]).drop("salt")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their ``cid``: its component, or itself."""
    return rows.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("component", "cid")).drop("component")


def class_labels(docs: DataFrame, classes: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """``id, component`` of the classes that are linked with others."""
    texts = docs.select(F.col("doc_id").cast("long").alias("__nd_doc"), F.xxhash64(text_of("text")).alias("__nd_hash"), text_of("text").alias("__nd_whole"))
    keys = classes.select("cid", "sketch").mapInArrow(_band_rows(per_cent), "key long, cid long")
    hubs = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).filter("hub < last").drop("last")
    bands = written(_by_key(keys, hubs).filter("cid > hub"), "near-bands")
    links = written(star_links(bands.select("cid", "hub").distinct(), classes, texts, per_cent), "near-stars")
    labels = components(links, "near-groups")
    # bands whose other members are not all connected yet
    rest = labelled(bands.select("key", "cid"), labels)
    split = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rest = written(_by_key(rest, split).select("key", "cid", "label"), "near-rest")
    if rest.isEmpty():
        return labels
    more = written(block_links(rest, classes, texts, per_cent), "near-links")
    if more.isEmpty():
        return labels
    return components(links.unionByName(more), "near-components")


def _judged(docs: DataFrame, per_cent: int) -> DataFrame:
    """A row for each of ``docs``: ``__nd_doc, __nd_text, __nd_n, component_id, kept``."""
    sets = document_sets(docs)
    classes = classes_of(sets)
    named = labelled(classes.select("cid", "a", "b", "rep"), class_labels(docs, classes, per_cent))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("a", "b", "component_id")
    rows = sets.drop("__nd_sketch")
    found = rows.join(named, (F.col("__nd_a") == F.col("a")) & (F.col("__nd_b") == F.col("b")) & (F.col("__nd_n") > 0), "left")
    found = found.withColumn("component_id", F.when(F.col("__nd_doc").isNotNull(), F.coalesce("component_id", "__nd_doc")))
    return found.withColumn("kept", F.coalesce(F.col("__nd_doc") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    return _judged(docs, per_cent).select(F.col("__nd_doc").alias("doc_id"), F.col("__nd_n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """``docs`` without the rows whose component has a smaller ``doc_id``; of rows
    that repeat a ``doc_id``, each is judged by its own text."""
    gone = _judged(docs, per_cent).filter(~F.col("kept")).select("__nd_doc", "__nd_text").distinct()
    return docs.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("__nd_doc")) & (F.xxhash64(text_of("text")) == F.col("__nd_text")), "left_anti")
