"""Near-dedup of embeddings: an exact subspace pigeonhole join.

Vectors are scaled to length one and turned by a fixed random rotation, so
that cosine >= c means a squared distance of at most 2 - 2c, spread evenly over
the dimensions. The dimensions are cut into blocks of sixteen; each block gets
the part of the squared distance that is proportional to its dimensions, and a
pair within the whole budget is within at least one block's.

Each block is range-joined over cells that use all its coordinates: pivots are
taken from the vectors (one for ``CELL`` of them, in the order of their
digests, ``MAX_PIVOTS`` at most), a vector's home is the cell of its nearest
pivot, and it goes as a probe to its home and to those later cells that its
radius reaches (it is no further than the radius beyond the plane halfway
between that cell's pivot and each of the nearest to it). So the part of the
table that a cell sees falls as the table, and with it the pivots, grow. Homes
and probes of a cell are both cut into chunks, each pair of chunks being a task
of bounded size. Only ids and the block's coordinates are shipped; they say
which vectors have a candidate in which pair of chunks, and whole vectors
follow for these alone.

There a pair counts in the first block whose budget it meets, so no pair is
counted twice and none is written out: the union of the candidates is verified
exactly by the cosine in double precision, and only each vector's number of
links and the links of a spanning forest leave the task.

Equal vectors are one class from the start, with its size as its weight.

Defined results
    null or zero vectors, and vectors with null or non-finite components: no
    links, a component of their own. Vectors of other lengths are linked only
    among themselves. Rows that repeat a ``vec_id``: each has its own row and
    counts as another vector. Null ``vec_id``: takes part as a vector, but
    names no component unless nothing else does. Empty table: empty result.
    Other columns pass by; internal names start with ``__ed_``.

The join never drops a pair. Where vectors fill all dimensions evenly, what a
cell sees falls slowly (with 20,000 even vectors to 53 % of the table at 20
pivots, 35 % at 80, 21 % at 320, 12 % at 1280), so the work still grows faster
than the table; links themselves cost work for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import require, written
from rxlink.llm.graph import components

COSINE = 0.95
BLOCK_DIMS = 16
CELL, MAX_PIVOTS = 4096, 4096
#: Numbers in a chunk of homes; a chunk of probes has four times as many.
CHUNK_VALUES = 262_144
#: Nearest pivots whose halfway planes bound what a probe reaches.
PLANES = 4
#: Cells up to which their counts are broadcast.
SMALL = 200_000
SEED = 20260
_EPS = 1e-9


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    return [slice(lo, min(lo + BLOCK_DIMS, dims)) for lo in range(0, dims, BLOCK_DIMS)]


def budgets(dims: int, cosine: float) -> np.ndarray:
    """Each block's squared distance, in proportion to its dimensions."""
    whole = max(0.0, 2 - 2 * cosine)
    return np.array([whole * (b.stop - b.start) / dims for b in blocks_of(dims)]) + _EPS


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by block, rows of a against the same rows of b."""
    d = (a - b) ** 2
    return np.stack([d[:, s].sum(axis=1) for s in blocks_of(a.shape[1])], axis=1)


def turned(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ rotation(vectors.shape[1])


def reached(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home cell, and a mask (row, cell) of its home and the later cells that hold all within ``radius`` of it."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    order = np.argsort(square, axis=1, kind="stable")[:, : min(PLANES, len(pivots))]
    between = np.sqrt(np.maximum((pivots**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * pivots @ pivots.T, 0))
    home, rows = order[:, 0], np.arange(len(x))
    mask = np.ones(square.shape, dtype=bool)
    for j in range(order.shape[1]):
        near = order[:, j]
        mask &= square - square[rows, near][:, None] <= 2 * between[near] * (radius + 1e-6) + _EPS
    mask &= np.arange(len(pivots)) > home[:, None]
    mask[rows, home] = True
    return home, mask


def _placed(batches: Iterator[pa.RecordBatch], cosine: float, shared) -> Iterator[tuple]:
    """(dims, block, ids, float32 coordinates, home cell, mask of the cells probed) of up to 512 vectors at a time."""
    pivots = shared.value
    for batch in batches:
        ids, lists = np.asarray(batch.column(0)), batch.column(1)
        for lo in range(0, len(ids), 512):
            by_dims: dict[int, list[int]] = {}
            for i, n in enumerate(np.asarray(pa.compute.list_value_length(lists[lo : lo + 512])).tolist()):
                by_dims.setdefault(n, []).append(lo + i)
            for dims, at in by_dims.items():
                q = turned(np.asarray(lists.take(pa.array(at)).flatten()).reshape(len(at), dims).astype(np.float64))
                centres = pivots.get(dims, np.zeros((1, dims)))
                for k, s in enumerate(blocks_of(dims)):
                    radius = float(np.sqrt(budgets(dims, cosine)[k]))
                    yield (dims, k, ids[at], q[:, s].astype(np.float32), *reached(q[:, s], centres[:, s], radius))


_CELL = "dims int, block int, cell int"


def _cell_counts(cosine: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for dims, block, _, _, home, mask in _placed(batches, cosine, shared):
            counts = np.stack([np.bincount(home, minlength=mask.shape[1]), mask.sum(axis=0)])
            total[dims, block] = total.get((dims, block), 0) + counts
        for (dims, block), (homes, probes) in total.items():
            cells = np.flatnonzero(homes + probes)
            fixed = [pa.array(np.full(len(cells), x, dtype=np.int32)) for x in (dims, block)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(cells.astype(np.int32)), pa.array(homes[cells]), pa.array(probes[cells])], names=["dims", "block", "cell", "homes", "probes"])

    return run


def _cells(cosine: float, shared):
    """A row for each vector's home (probe 0), its probe at home (1) and elsewhere (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, block, ids, x, home, mask in _placed(batches, cosine, shared):
            who, cell = np.nonzero(mask)
            kind = np.where(home[who] == cell, 1, 2)
            who, cell, kind = (np.concatenate(p) for p in ((np.arange(len(ids)), who), (home, cell), (np.zeros(len(ids), dtype=int), kind)))
            packed = [r.tobytes() for r in x]
            fixed = [pa.array(np.full(len(who), n, dtype=np.int32)) for n in (dims, block)]
            yield pa.RecordBatch.from_arrays(
                [*fixed, pa.array(cell.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(ids[who]), pa.array([packed[i] for i in who.tolist()], pa.binary())],
                names=["dims", "block", "cell", "kind", "id", "x"],
            )

    return run


def _candidates(cosine: float):
    """Which rows of a pair of chunks have a candidate there, by the block's coordinates alone."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dims, block = int(group["dims"].iloc[0]), int(group["block"].iloc[0])
        limit = np.float32(budgets(dims, cosine)[block] + 1e-4)
        kind, ids = group["kind"].to_numpy(), group["id"].to_numpy()
        x = np.frombuffer(b"".join(group["x"]), dtype=np.float32).reshape(len(group), -1)
        homes, probes = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
        found = np.zeros(len(group), dtype=bool)
        if len(homes) and len(probes):
            y = x[probes]
            right = np.column_stack([y, (y**2).sum(axis=1), np.ones(len(y), dtype=np.float32)]).T.copy()
            for lo in range(0, len(homes), 256):
                h = homes[lo : lo + 256]
                left = np.column_stack([-2 * x[h], np.ones(len(h), dtype=np.float32), (x[h] ** 2).sum(axis=1)])
                i, j = np.nonzero(left @ right <= limit)
                good = (kind[probes[j]] == 2) | (ids[probes[j]] < ids[h[i]])
                found[h[i[good]]] = True
                found[probes[j[good]]] = True
        return group.loc[found, ["dims", "block", "cell", "kind", "id", "one", "two"]]

    return run


def match(home: tuple[np.ndarray, ...], probe: tuple[np.ndarray, ...], block: int, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """home: ids, vectors, weights; probe: these and whether it is at home here (then
    only homes with larger ids are its partners). Links first met in ``block``.

    Returns each vector's weighted number of links and the links of a forest."""
    ids, raw, own_weights = home
    others, other_raw, weights, inner = probe
    q, p = turned(raw), turned(other_raw)
    dims = raw.shape[1]
    limit, own = budgets(dims, cosine), blocks_of(dims)[block]
    norms, other_norms = np.linalg.norm(raw, axis=1), np.linalg.norm(other_raw, axis=1)
    radius = float(np.sqrt(limit[block])) + 1e-6
    if own.stop - own.start > 2:  # both in the order of the third coordinate
        a, b = np.argsort(q[:, own.start + 2], kind="stable"), np.argsort(p[:, own.start + 2], kind="stable")
        ids, raw, own_weights, q, norms = ids[a], raw[a], own_weights[a], q[a], norms[a]
        others, other_raw, p, other_norms, weights, inner = others[b], other_raw[b], p[b], other_norms[b], weights[b], inner[b]
    third = min(own.start + 2, own.stop - 1)
    pk = p[:, own].astype(np.float32)
    right = np.column_stack([pk, (pk**2).sum(axis=1), np.ones(len(pk), dtype=np.float32)]).T.copy()
    counts: dict[int, int] = {}
    forest: list[tuple[int, int]] = []
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for lo in range(0, len(ids), 256):
        qk = q[lo : lo + 256, own].astype(np.float32)
        left = np.column_stack([-2 * qk, np.ones(len(qk), dtype=np.float32), (qk**2).sum(axis=1)])
        first, last = 0, len(p)
        if own.stop - own.start > 2:
            first = np.searchsorted(p[:, third], q[lo, third] - radius, "left")
            last = np.searchsorted(p[:, third], q[min(lo + 256, len(q)) - 1, third] + radius, "right")
        i, j = np.nonzero(left @ right[:, first:last] <= np.float32(limit[block] + 1e-4))
        i, j = i + lo, j + first
        for a in range(0, len(i), 65536):
            x, y = i[a : a + 65536], j[a : a + 65536]
            other = ~inner[y] | (others[y] < ids[x])
            x, y = x[other], y[other]
            inside = block_distances(q[x], p[y]) <= limit
            here = inside.any(axis=1) & (inside.argmax(axis=1) == block)
            x, y = x[here], y[here]
            cos = np.einsum("ij,ij->i", raw[x], other_raw[y]) / (norms[x] * other_norms[y])
            x, y = x[cos >= cosine], y[cos >= cosine]
            for who, weight in ((ids[x], weights[y]), (others[y], own_weights[x])):
                names, at = np.unique(who, return_inverse=True)
                for n, w in zip(names.tolist(), np.bincount(at, weight, len(names)).astype(np.int64).tolist()):
                    counts[n] = counts.get(n, 0) + w
            for n, m in zip(ids[x].tolist(), others[y].tolist()):
                r, s = root(n), root(m)
                if r != s:
                    up[max(r, s)] = min(r, s)
                    forest.append((max(n, m), min(n, m)))
    return counts, forest


def _joined(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        kind = group["kind"].to_numpy()
        home, other = group[kind == 0], group[kind > 0]
        if home.empty or other.empty:
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        sides = lambda x: (x["id"].to_numpy(), np.stack(x["v"].to_list()).astype(np.float64), x["weight"].to_numpy())
        counts, forest = match(sides(home), (*sides(other), other["kind"].to_numpy() == 1), int(group["block"].iloc[0]), cosine)
        rows = [(n, n, c) for n, c in counts.items()] + [(a, b, 0) for a, b in forest]
        return pd.DataFrame(rows, columns=["u", "v", "links"]).astype("int64")

    return run


def pivots_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """By length: pivots, turned. At most ``MAX_PIVOTS`` vectors, those with the least digests."""
    n = min(MAX_PIVOTS, -(-classes.count() // CELL))
    out: dict[int, list[np.ndarray]] = {}
    for r in classes.orderBy("__ed_key").limit(n).select("v").collect():
        out.setdefault(len(r.v), []).append(np.array(r.v, dtype=np.float64))
    return {dims: turned(np.stack(vs)) for dims, vs in out.items()}


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``."""
    require(vectors, "vec_id", "embedding")
    e = F.col("embedding")
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":  # floats stay as they are, half as large
        e = e.cast("array<double>")
    sound = (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x).cast("double") == F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    whole = F.transform(e, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # -0.0 becomes 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, whole).alias("v"))
    rows = written(rows.withColumn("__ed_key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v"), 256))), "vectors")
    classes = rows.filter(F.col("v").isNotNull()).groupBy("__ed_key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    shared = classes.sparkSession.sparkContext.broadcast(pivots_of(classes))
    cell, pair = ["dims", "block", "cell"], ["dims", "block", "cell", "one", "two"]
    source = classes.select("id", "v")
    counts = source.mapInArrow(_cell_counts(cosine, shared), f"{_CELL}, homes long, probes long").groupBy(*cell).agg(F.sum("homes").alias("homes"), F.sum("probes").alias("probes"))
    size = F.greatest(F.lit(64), F.lit(CHUNK_VALUES) / F.col("dims"))
    counts = written(counts.select(*cell, F.ceil(F.col("homes") / size).cast("int").alias("ones"), F.ceil(F.col("probes") / (4 * size)).cast("int").alias("twos")), "vector-cells")
    counts = F.broadcast(counts) if counts.count() <= SMALL else counts
    rows_of = source.mapInArrow(_cells(cosine, shared), f"{_CELL}, kind int, id long, x binary").join(counts, cell)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    chunks = F.when(F.col("kind") == 0, F.transform(every("twos"), lambda t: F.struct(mine("ones").alias("one"), t.alias("two")))).otherwise(F.transform(every("ones"), lambda o: F.struct(o.alias("one"), mine("twos").alias("two"))))
    dealt = rows_of.filter("ones > 0").withColumn("c", F.explode(chunks)).select(*cell, "kind", "id", "x", "c.one", "c.two")
    needed = dealt.groupBy(*pair).applyInPandas(_candidates(cosine), f"{_CELL}, kind int, id long, one int, two int")
    needed = written(needed, "vector-candidates").join(classes.select("id", "weight", "v"), "id")
    found = written(needed.groupBy(*pair).applyInPandas(_joined(cosine), "u long, v long, links long"), "vector-links")
    links = found.filter("u = v").groupBy("u").agg(F.sum("links").alias("far"))
    labels = components(found.filter("u <> v"), "vector-components")
    least = classes.select("id", "least").join(labels.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(names, "component").join(links, F.col("id") == F.col("u"), "left").select("id", "component_id", F.coalesce("far", F.lit(0)).alias("far"))
    named = classes.select("id", "weight", F.col("__ed_key").alias("k")).join(named, "id").select("k", "component_id", (F.col("far") + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", "__ed_key").join(named, F.col("__ed_key") == F.col("k"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
