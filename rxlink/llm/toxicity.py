"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a whole text: densities of a fixed insult lexicon and of one learnt
from labelled rows (whole words and word stems, picked by greedy covering of
the toxic rows), how near hits stand to second-person words, capitals,
punctuation, and obfuscation (letters mixed with digits or symbols, drawn-out
letters, hits only seen after undoing both). Trees are fitted to the logistic
loss on histogram bins. Isotonic regression calibrates their output: for each
of the four learning folds a lexicon and trees are learnt from the other three,
and their outputs on the fold, pooled over the folds, are what it is fitted to;
the scores come from a lexicon and trees learnt from all four.

The model is fitted on at most ``MAX_ROWS`` labelled rows, the first in the
order of a hash of their id; the words that these rows hold bound the lexicon.
Scoring reads every whole text once, without a shuffle.

Defined results
    null or empty text: scored from all-zero features. Labels that are null
    or of documents that are not there are ignored; a document with several
    labels is toxic if one says so. Without any toxic or any other label the
    score is the share of toxic labels (0 without labels). Rows that repeat a
    ``doc_id`` are scored each by itself; a null ``doc_id`` is never a label
    and not held out. Empty table: empty result. Other columns pass through;
    internal names start with ``__tx_``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import ddl, require, text_of, written

MAX_ROWS = 20_000
FOLDS = 5
LEARNING = (1, 2, 3, 4)
THRESHOLD = 0.5

INSULTS = frozenset(
    """idiot idiots stupid moron morons dumb dumbass fool fools loser losers scum trash garbage worthless pathetic disgusting clown clowns
    jerk jerks creep freak ugly filthy vermin liar coward cowards imbecile retard bastard bitch shit crap
    damn fuck fucking asshole whore slut lunatic psycho nasty vile sick useless ignorant braindead parasite idiotic moronic
    blöd idiotin arschloch dreck abschaum versager trottel hässlich connard salaud merde imbécile débile ordure crétin
    idiota estúpido estúpida imbécil basura asqueroso mierda cabrón puta inútil""".split()
)
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros".split())
FEATURES = (
    "fixed_density", "fixed_count", "learnt_density", "learnt_count", "hit_density", "obfuscated_hits", "second_density", "second_nearness", "second_share",
    "capital_rate", "capital_words", "exclamation_rate", "question_rate", "punctuation_rate", "digit_rate", "mixed_rate", "drawn_out_rate", "log_tokens", "token_length",
)

_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "“”‘’«»¿¡…–—"
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_FIXED, _LEARNT, _OBFUSCATED, _SECOND, _CAPITALS, _MIXED, _DRAWN = (1 << i for i in range(7))
_NEAR = 5
_CACHE_TOKENS = 120_000


def plain(token: str) -> str:
    return token.strip(_EDGE).lower()


def entries_of(word: str) -> list[str]:
    """What a word may be known by: itself (``=word``) and its stems (``word*``)."""
    return [f"={word}", *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)] if len(word) >= 3 else []


def _known(word: str, learnt: frozenset[str]) -> int:
    return (_FIXED if word in INSULTS else 0) | (_LEARNT if any(e in learnt for e in entries_of(word)) else 0)


class Flags(dict):
    """What is to be known of a raw token, as bits."""

    def __init__(self, learnt: frozenset[str]):
        super().__init__()
        self.learnt = learnt

    def __missing__(self, token: str) -> int:
        word = plain(token)
        bits = _known(word, self.learnt)
        core = token.strip(_EDGE)
        mixed = bool(re.search(r"[^\W\d_]", core)) and bool(re.search(r"[\d@$!*#%_|+]", core))
        drawn = bool(re.search(r"(\w)\1\1", core))
        if not bits and (mixed or drawn):
            undone = re.sub(r"(\w)\1\1+", r"\1", re.sub(r"[^\w]|_", "", token.lower().translate(_LEET)))
            found = _known(undone, self.learnt)
            bits |= found | (_OBFUSCATED if found else 0)
        bits |= (_SECOND if word in SECOND else 0) | (_CAPITALS if len(core) > 1 and core.isupper() else 0) | (_MIXED if mixed else 0) | (_DRAWN if drawn else 0)
        if len(self) > _CACHE_TOKENS:
            self.clear()
        self[token] = bits
        return bits


def features(text: str, flags: Flags) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    tokens = text.split()
    if not tokens:
        return out
    n = len(tokens)
    f = np.fromiter(map(flags.__getitem__, tokens), dtype=np.uint8, count=n)
    fixed, learnt = int(((f & _FIXED) > 0).sum()), int(((f & _LEARNT) > 0).sum())
    hits = np.flatnonzero(f & (_FIXED | _LEARNT))
    second = np.flatnonzero(f & _SECOND)
    chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    upper, lower, digits = int(chars[65:91].sum()), int(chars[97:123].sum()), int(chars[48:58].sum())
    marks = int(chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum())
    total = max(1, len(text))
    out[:6] = fixed / n, math.log1p(fixed), learnt / n, math.log1p(learnt), len(hits) / n, int(((f & _OBFUSCATED) > 0).sum())
    out[6] = len(second) / n
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(hits - second[np.clip(at, 0, len(second) - 1)]), np.abs(hits - second[np.clip(at - 1, 0, len(second) - 1)]))
        out[7], out[8] = 1 / (1 + gap.min()), (gap <= _NEAR).mean()
    out[9:15] = upper / max(1, upper + lower), ((f & _CAPITALS) > 0).sum() / n, chars[33] / total, chars[63] / total, marks / total, digits / total
    out[15:] = ((f & _MIXED) > 0).sum() / n, ((f & _DRAWN) > 0).sum() / n, math.log1p(n), total / n
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth on quantile bins, logistic loss."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    bins: int = 48
    l2: float = 1.0
    least: int = 5
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Without both classes in ``y`` there are no trees, only the base."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(share / (1 - share))
        if len(set(y.tolist())) < 2:
            return self
        self.cuts = [np.unique(np.quantile(c[c != c.min()], np.linspace(0, 1, self.bins - 1))) if (c != c.min()).any() else np.array([np.inf]) for c in x.T]
        b = self.binned(x)
        raw = np.full(len(y), self.base)
        width = self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            nodes = (1 << self.depth) - 1
            feature, cut, leaf = np.zeros(nodes, dtype=int), np.full(nodes, width), np.zeros(nodes + 1)
            at = np.zeros(len(y), dtype=int)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                best = np.full(many, 1e-9)
                for i in range(x.shape[1]):
                    slot = (at - first) * width + b[:, i]
                    gs, hs, ns = (np.bincount(slot, w, many * width).reshape(many, width) for w in (g, h, None))
                    gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
                    gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(nl < self.least) | (nt - nl < self.least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(many), top] > best
                    best[better] = gain[np.arange(many), top][better]
                    feature[first : first + many][better], cut[first : first + many][better] = i, top[better]
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            at -= nodes
            gs, hs = np.bincount(at, g, nodes + 1), np.bincount(at, h, nodes + 1)
            leaf = -self.rate * gs / (hs + self.l2)
            raw += leaf[at]
            self.trees.append((feature, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.trees:
            return out
        b, rows = self.binned(x), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x, value); values between are interpolated."""
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        blocks.append([1.0, b, a])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


@dataclass
class Model:
    learnt: frozenset[str]
    share: float
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.trees is None else np.interp(self.trees.raw(x), *self.knots)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def entries_in(text: str) -> set[str]:
    return {e for w in {plain(x) for x in text.split()} for e in entries_of(w)}


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for fold, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = entries_in(text.as_py())
            out[0].extend(found)
            out[1].extend([fold] * len(found))
            out[2].extend([toxic] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["entry", "fold", "toxic"])


def _covered(candidates: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(entries_in(t.as_py()) & candidates) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=["fold", "entries"])

    return run


def cover(rows: list[list[str]], harm: dict[str, int]) -> frozenset[str]:
    """Entries that greedily cover the rows (each a list of entries), three rows
    being worth one of another label that the entry is in (``harm``)."""
    least = max(3, round(0.004 * len(rows)))
    held: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        for e in row:
            if e in harm:
                held.setdefault(e, []).append(i)
    gain = {e: len(x) for e, x in held.items()}
    left, picked = set(range(len(rows))), []
    while gain:
        best = max(gain, key=lambda e: (gain[e] - 3 * harm[e], -len(e), e))
        if gain[best] - 3 * harm[best] < least:
            break
        picked.append(best)
        for i in left.intersection(held[best]):
            left.remove(i)
            for e in rows[i]:
                if e in gain:
                    gain[e] -= 1
    return frozenset(picked)


def learn_entries(rows: DataFrame, sets: list[tuple[int, ...]]) -> list[frozenset[str]]:
    """rows: fold, toxic (long), text. The lexicon of each set of folds."""
    sums = [F.sum(F.when(F.col("fold") == f, value).otherwise(0)).alias(f"{name}{f}") for f in LEARNING for name, value in (("bad", F.col("toxic")), ("all", F.lit(1)))]
    counts = rows.select("fold", "toxic", "text").mapInArrow(_entry_rows, "entry string, fold long, toxic long").groupBy("entry").agg(*sums)
    total = lambda name, folds: sum((F.col(f"{name}{f}") for f in folds), F.lit(0))
    fits = [(total("bad", s) >= 3) & (total("bad", s) >= 0.8 * total("all", s)) for s in sets]
    wanted = counts.select("entry", *(F.when(ok, total("all", s) - total("bad", s)).alias(f"harm{i}") for i, (s, ok) in enumerate(zip(sets, fits))))
    found = wanted.filter(F.coalesce(*(F.col(f"harm{i}") for i in range(len(sets)))).isNotNull()).collect()  # words of at most MAX_ROWS rows
    harms = [{r.entry: r[f"harm{i}"] for r in found if r[f"harm{i}"] is not None} for i in range(len(sets))]
    toxic = rows.filter("toxic = 1").select("fold", "text").mapInArrow(_covered(frozenset(r.entry for r in found)), "fold long, entries array<string>").collect()
    return [cover([r.entries for r in toxic if r.fold in s], harm) for s, harm in zip(sets, harms)]


_flags: dict[frozenset[str], Flags] = {}


def _flags_of(learnt: frozenset[str]) -> Flags:
    if learnt not in _flags:
        if len(_flags) > len(LEARNING):
            _flags.clear()
        _flags[learnt] = Flags(learnt)
    return _flags[learnt]


def _feature_rows(lexicons: list[frozenset[str]]):
    """The features by each lexicon, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.concatenate([features(t.as_py(), _flags_of(x)) for x in lexicons]).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["fold", "toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on the labelled rows that are not held out."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    known = labels.select(F.col("doc_id").cast("long").alias("__tx_id"), (F.col("toxic") > 0).cast("long").alias("toxic")).dropna()
    known = known.groupBy("__tx_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("__tx_id")))
    known = known.orderBy(F.xxhash64("__tx_id"), "__tx_id").limit(max_rows)  # so the broadcast is at most max_rows rows
    fold = F.crc32(F.col("__tx_id").cast("string").cast("binary")) % FOLDS
    texts = docs.select(F.col("doc_id").cast("long").alias("__tx_doc"), text_of("text").alias("text"))
    rows = texts.join(F.broadcast(known), F.col("__tx_doc") == F.col("__tx_id")).select(fold.alias("fold"), "toxic", "text")
    rows = written(rows, "labelled")
    sets = [tuple(g for g in LEARNING if g != f) for f in LEARNING] + [LEARNING]
    lexicons = learn_entries(rows, sets)
    got = rows.mapInArrow(_feature_rows(lexicons), "fold long, toxic long, x binary").collect()
    x, y, folds = np.frombuffer(b"".join(r.x for r in got)).reshape(-1, len(sets), len(FEATURES)), np.array([r.toxic for r in got], dtype=float), np.array([r.fold for r in got])
    order = np.lexsort([*x[:, -1].T, y, folds])  # the same model whatever order the rows come in
    x, y, folds = x[order], y[order], folds[order]
    model = Model(lexicons[-1], float(y.mean()) if len(y) else 0.0)
    if len(set(y.tolist())) < 2:
        return model
    apart = np.zeros(len(y))
    for i, f in enumerate(LEARNING):
        apart[folds == f] = Trees().fit(x[folds != f, i], y[folds != f]).raw(x[folds == f, i])
    model.trees, model.knots = Trees().fit(x[:, -1], y), isotonic(apart, y)
    return model


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        flags = _flags_of(model.learnt)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            x = np.stack([features(t.as_py(), flags) for t in texts]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(x), pa.float64())], names=[*batch.schema.names[:-1], "__tx_score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__tx_score`` beside its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB whatever the input
    return docs.withColumn("__tx_text", text_of("text")).mapInArrow(_scorer(shared), f"{ddl(docs)}, __tx_score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents scored below the threshold, columns as they were."""
    return score(docs, fit(docs, labels, max_rows)).filter(F.col("__tx_score") < THRESHOLD).drop("__tx_score")
