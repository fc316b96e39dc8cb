"""Secret scans with DataFrame functions only.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a credential
name, a sign and a value of at least 12 characters), ``access`` (``AKIA`` and
capitals or digits, at least 18 characters) and ``hex`` (at least 16 lower-case
hex digits). Matches that are too short are dropped after matching.

The method adds ``entropy`` spans: candidate strings of at least
``MIN_CANDIDATE`` token characters are judged by the Shannon entropy of a
window of ``WINDOW`` characters that slides over them. The window's character
counts and the sum of ``c log2 c`` are updated for the character that enters
and the one that leaves, so a candidate costs time in proportion to its length.
The threshold depends on the character class (hex digits, letters and digits of
one case, mixed). Allow-listed candidates (plain words, paths, digits alone,
one repeated unit, documentation placeholders at an end or as a part) and candidates that overlap a
base span are suppressed.

Defined results
    null or empty text: no spans. Rows that repeat a ``doc_id`` are scanned
    each by itself; other columns and ids pass through untouched. Spans are
    code points of the whole text, end exclusive, in the order of start, then
    kind as listed. Empty table: empty result. Internal names start with
    ``__ss_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import let, require, text_of

#: The base patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "entropy")

MIN_CANDIDATE = 20
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A candidate's class and the least entropy (bits a character) of its best window.
THRESHOLDS = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("one_case", r"^(?:[a-z0-9_-]+|[A-Z0-9_-]+)$", 3.4), ("mixed", r".", 3.7))
#: Parts that look like words: runs of one case, capitalised or in camel case, or single letters.
#: Possessive and with one way to match only, so long candidates take linear time and no stack.
_WORDS = r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}(?=[A-Z][a-z]|[^A-Za-z]|$)|(?<![A-Za-z])[A-Za-z](?![A-Za-z])|[_-])"
#: No word has as many consonants of one case in a row.
_SPOKEN = r"(?!.*(?:[bcdfghjklmnpqrstvwxz]{6}|[BCDFGHJKLMNPQRSTVWXZ]{6}))"
_NAMED = r"(?:example|sample|placeholder|changeme|x{4,}|dummy)"
#: Candidates that are no secrets, whatever their entropy.
ALLOW = (
    rf"^{_SPOKEN}{_WORDS}++$",  # words and identifiers without a digit
    r"^[0-9_+/=-]+$",  # numbers, rules
    r"^(.{1,8}?)\1+.?$",  # one unit repeated
    rf"(?i)^{_NAMED}|{_NAMED}(?:key)?$|[+/_=-]{_NAMED}(?:key)?[0-9]*[+/_=-]",  # placeholders at an end or as a part
    rf"^{_SPOKEN}/?(?:{_WORDS}++[0-9]{{0,4}}/)++(?:{_WORDS}++[0-9]{{0,4}})?$",  # paths
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,kind:int,end:int,c:string>>"
#: Long lists are folded in parts of this many entries: appending to an array copies it.
PART = 256
#: Long candidates are judged in pieces of this many windows, which overlap by all but one character of one.
PIECE = 4096
#: A count of at most WINDOW takes five bits, so a long holds twelve characters' counts.
_BITS, _PACK = 5, 12


def _parts(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PART).cast("int")), lambda k: F.slice(rows, k * PART + 1, PART))


def _located(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans (with the matched text) of a pattern's matches whose group has at least ``least`` characters.

    The pieces between matches and the matches alternate, so a running sum of
    their lengths places every match; it is taken inside parts first, then over
    the parts, so that a text with many matches takes time in proportion.
    """
    p = F.lit(pattern)
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.length(x) >= least)
    rows = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(matches)), F.length).alias("gap"), matches.alias("own"), kept.alias("ok"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["own"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["own"].alias("c"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(inside: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(inside, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = F.zip_with(inside, before, lambda x, at: F.transform(x["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"], (s["end"] + at).alias("end"), s["c"])))
        return F.flatten(moved).cast(_FOUND)

    inside = let(rows, lambda r: F.transform(_parts(r), lambda part: F.aggregate(part, start, step)))
    return F.when(text.rlike(pattern if least == 0 else _fast(pattern, least)), let(inside, placed)).otherwise(F.array().cast(_FOUND))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(_SPAN)


def _fast(pattern: str, least: int) -> str:
    """A cheaper pattern without which no match can be long enough."""
    return {HEX: rf"[0-9a-f]{{{least}}}", ACCESS: rf"AKIA[A-Z0-9]{{{least - 4}}}"}.get(pattern, pattern)


def _best_in_piece(piece: Column) -> Column:
    """The largest entropy of a full window of a short text, by incremental counts.

    The counts stand packed in a few longs; a step adds one to the entering
    character's, takes one from the leaving character's, and changes the sum of
    ``c log2 c`` by their terms alone.
    """
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)])
    at = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    at = F.transform(at, lambda i: F.struct(F.floor(i / _PACK).cast("int").alias("k"), (i % _PACK * _BITS).alias("shift")))
    none = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("shift"))
    pairs = F.arrays_zip(at.alias("in"), F.concat(F.array_repeat(none, WINDOW), F.slice(at, 1, F.greatest(F.lit(0), F.size(at) - WINDOW))).alias("out"))
    longs = -(-len(_ALPHABET) // _PACK)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))
    term = lambda c: F.get(table, c)
    count = lambda n, x: F.call_function("shiftright", F.get(n, x["k"]), x["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["in"], x["out"]
        change = lambda n: F.transform(n, lambda c, k: c + F.when(k == enters["k"], one(enters)).otherwise(0) - F.when(k == leaves["k"], one(leaves)).otherwise(0))
        was_in, was_out = count(acc["n"], enters), count(acc["n"], leaves)
        s = acc["s"] + term(was_in + 1) - term(was_in) + F.when(leaves["k"] >= 0, term(was_out - 1) - term(was_out)).otherwise(0.0)
        best = F.when(acc["i"] + 1 >= WINDOW, F.greatest(acc["best"], F.lit(math.log2(WINDOW)) - s / WINDOW)).otherwise(acc["best"])
        moved = F.struct(change(acc["n"]).alias("n"), s.alias("s"), best.alias("best"), (acc["i"] + 1).alias("i"))
        return F.when(enters == leaves, acc).otherwise(moved)

    return F.aggregate(pairs, zero, step, lambda acc: acc["best"])


def best_entropy(candidate: Column) -> Column:
    """The largest entropy of a full window; long candidates are taken in overlapping pieces."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(candidate) - WINDOW, F.lit(0)) / PIECE).cast("int"))
    return F.array_max(F.transform(starts, lambda k: _best_in_piece(candidate.substr(k * PIECE + 1, F.lit(PIECE + WINDOW - 1)))))


def _suspicious(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    limit = F.lit(None).cast("double")
    for _, pattern, bits in reversed(THRESHOLDS):
        limit = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(limit)
    return F.when(allowed, F.lit(False)).otherwise(best_entropy(candidate) >= limit)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__ss_base`` and ``__ss_spans``: arrays of (start, kind index, end)."""
    require(docs, "text")
    text = F.col("__ss_text")
    out = docs.withColumn("__ss_text", text_of("text"))
    base = F.concat(*(_bare(x) for x in (_located(text, ASSIGN, 0, MIN_ASSIGN, 2), _located(text, ACCESS, 1, MIN_ACCESS), _located(text, HEX, 2, MIN_HEX))))
    out = out.withColumn("__ss_base", F.array_sort(base))
    found = F.when(text.rlike(CANDIDATE), _located(text, CANDIDATE, 3, 0)).otherwise(F.array().cast(_FOUND))
    meets = lambda b, start, end: (b["start"] < end) & (start < b["end"])

    def clear(part: Column) -> Column:
        """The part's candidates that overlap no base span; those near the part are sought once."""
        near = F.filter(F.col("__ss_base"), lambda b: meets(b, F.get(part, F.lit(0))["start"], F.element_at(part, -1)["end"]))
        return let(near, lambda n: F.filter(part, lambda s: ~F.exists(n, lambda b: meets(b, s["start"], s["end"]))))

    alone = let(found, lambda f: F.when((F.size("__ss_base") > 0) & (F.size(f) > 0), F.flatten(F.transform(_parts(f), clear))).otherwise(f))
    added = _bare(F.filter(alone, lambda s: _suspicious(s["c"])))
    return out.withColumn("__ss_spans", F.array_sort(F.concat(F.col("__ss_base"), added))).drop("__ss_text")


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
