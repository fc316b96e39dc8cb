"""Field extractors as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxlink.functions import labels as L
from rxlink.functions import text as T
from rxlink.sources.lookups import Lookups

#: What counts as a count, a number, and a line that names no medicine.
COUNT = r"[0-9OoIl|]"
NUMBER = r"\d+(?:\.\d+)?"
BLOCKED = ("clinic", "doctor", "patient", "date", "phone", "email", "diagnosis", "advice", "review", "signature", "valid for medical", "self-medication", "age/sex", "uhid", "weight", "reg. no", "provisional")
TAIL_INSTRUCTIONS = ("AC", "PC", "AF", "BF", "BBF", "HS", "SOS", "PRN")

STRENGTH = rf"(?i)\b{NUMBER}\s*{L.any_of(*L.STRENGTHS)}\b"
PATTERN = r"\b" + r"\s*[-]\s*".join([rf"({COUNT}{{1,2}})"] * 3) + r"\b"
QUANTITY = rf"(?i)\bDose\s*:\s*({COUNT}+(?:\.\d+)?\s*{L.any_of(*L.QUANTITIES)})\b"
DURATION = rf"(?i)(?:\b(?:x|for)\s*)?({NUMBER})\s*({L.any_of(*L.TIMES)})\b"
STRICT_DURATION = rf"(?i)\b(\d{{1,3}})\s*({L.any_of(*L.WHOLE_TIMES)})\b"


def _any(terms: list[str]) -> str:
    return "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", t) for t in terms)


def bounded_any(terms: list[str]) -> str:
    return rf"(?i)(?<![A-Za-z0-9])(?:{_any(terms)})(?![A-Za-z0-9])"


def form_pattern(lk: Lookups) -> str:
    return rf"(?i)\b({_any(lk.longest(lk.forms))})\b"


def dosage_form(x: Column, lk: Lookups) -> tuple[Column, Column]:
    """The first form in the text and its meaning."""
    raw = F.regexp_extract(x, form_pattern(lk), 1)
    table = F.create_map(*[F.lit(v) for kv in lk.forms.items() for v in kv])
    return raw, F.coalesce(F.try_element_at(table, F.upper(raw)), F.lit(""))


def without_form(x: Column, lk: Lookups) -> Column:
    return F.regexp_replace(x, form_pattern(lk), " ")


def strength(x: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(STRENGTH), F.lit(0)), lambda s: F.trim(s))), " + ")


def without_strength(x: Column) -> Column:
    return F.regexp_replace(x, STRENGTH, " ")


def dose_pattern(x: Column) -> Column:
    parts = [T.count_token(F.regexp_extract(x, PATTERN, i)) for i in (1, 2, 3)]

    def quantity(q: Column) -> Column:
        first = F.regexp_extract(q, r"^(\S+)", 1)
        return F.regexp_replace(F.concat(T.count_token(first), F.substring(q, F.length(first) + 1, F.length(q))), r"\s+", " ")

    return F.when(x.rlike(PATTERN), F.concat_ws("-", *parts)).otherwise(T.let(F.trim(F.regexp_extract(x, QUANTITY, 1)), quantity))


def _parts(pattern: Column) -> Column:
    return F.filter(F.transform(F.split(pattern, r"\s*-\s*", -1), T.count_token), lambda p: p != "")


def _numeric(parts: Column) -> Column:
    return (F.size(parts) >= 3) & F.forall(F.slice(parts, 1, 3), lambda p: p.rlike(r"^\d+$"))


def readable_dose(pattern: Column) -> Column:
    when = F.array(*[F.lit(x) for x in ("morning", "afternoon", "night")])

    def body(parts: Column) -> Column:
        rows = F.arrays_zip(F.slice(parts, 1, 3).alias("n"), when.alias("w"))
        said = F.array_join(F.transform(F.filter(rows, lambda r: r["n"].cast("int") > 0), lambda r: F.concat(r["n"], F.lit(" in the "), r["w"])), ", ")
        return F.when(_numeric(parts), F.coalesce(F.when(said != "", said), F.lit("No dose indicated"))).otherwise(pattern)

    return T.let(_parts(pattern), body)


def times_per_day(pattern: Column) -> Column:
    return T.let(_parts(pattern), lambda parts: F.when(_numeric(parts), F.aggregate(F.slice(parts, 1, 3), F.lit(0), lambda a, p: a + p.cast("int"))))


def _found(x: Column, terms: list[str]) -> Column:
    """The longest of the terms (longest first) at each place where one stands by itself, in order: one scan of the text."""
    return F.regexp_extract_all(x, F.lit(rf"(?i)(?<![A-Za-z0-9])(?=({_any(terms)})(?![A-Za-z0-9]))"), F.lit(1))


def _rank(found: Column, terms: list[str]) -> Column:
    table = F.create_map(*[F.lit(v) for n, t in reversed(list(enumerate(terms))) for v in (t.lower(), n)]) if len({t.lower() for t in terms}) == len(terms) else None
    if table is None:  # terms that differ in case alone: the first one counts
        return _rank(found, list({t.lower(): t for t in reversed(terms)}.values())[::-1])
    return F.try_element_at(table, F.lower(found))


def frequency(x: Column, lk: Lookups) -> Column:
    """Struct of abbreviation, meaning, latin, safe_check of the longest term there; empty if none."""
    names = ("abbreviation", "meaning", "latin", "safe_check")
    make = lambda info: F.struct(*[F.lit(v).alias(k) for k, v in zip(names, info)])
    terms = lk.longest(lk.frequencies)
    best = F.array_min(F.transform(_found(x, terms), lambda f: _rank(f, terms)))
    return F.coalesce(F.get(F.array(*[make(lk.frequencies[t]) for t in terms]), best), make(("", "", "", "")))


def duration(x: Column) -> tuple[Column, Column]:
    """Normalised text and days (a week is 7, a month 30)."""

    def body(m: Column) -> Column:
        number, unit = m["n"].try_cast("double"), m["u"]
        name = F.when(unit.startswith("d"), "day").when(unit.startswith("w"), "week").otherwise("month")
        days = number * F.when(unit.startswith("d"), 1.0).when(unit.startswith("w"), 7.0).otherwise(30.0)
        shown = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
        said = F.concat(shown, F.lit(" "), name, F.when(number == 1, "").otherwise("s"))
        return F.struct(F.when(unit == "", "").otherwise(said).alias("said"), F.when(unit != "", days).alias("days"))

    found = T.let(F.struct(F.regexp_extract(x, DURATION, 1).alias("n"), F.lower(F.regexp_extract(x, DURATION, 2)).alias("u")), body)
    return found["said"], found["days"]


def strict_duration(x: Column) -> Column:
    t = F.regexp_replace(T.squeeze(T.cell(x)), rf"(?i)^\s*DURATION{L.SIGNS}", "")
    n, unit = F.regexp_extract(t, STRICT_DURATION, 1), F.regexp_replace(F.lower(F.regexp_extract(t, STRICT_DURATION, 2)), "s$", "")
    return F.when(n == "", "").otherwise(F.concat(n, F.lit(" "), unit, F.when(n == "1", "").otherwise("s")))


def _hits(x: Column, terms: list[str], alone: bool) -> Column:
    """Ranks of the terms (longest first) that stand in the text, by themselves or anywhere, in one scan.

    A term is found where no longer one begins; the shorter ones that begin
    there with it are added from a table.
    """
    if not terms:
        return F.array().cast("array<int>")
    low = [t.lower() for t in terms]
    inside = lambda s, t: t.startswith(s) and (not alone or len(s) == len(t) or not t[len(s)].isalnum())
    table = F.create_map(*[v for t in dict.fromkeys(low) for v in (F.lit(t), F.array(*[F.lit(n) for n, s in enumerate(low) if inside(s, t)]))])
    found = _found(x, terms) if alone else F.regexp_extract_all(x, F.lit(rf"(?i)(?=[{''.join(sorted({re.escape(t[0]) for t in low}))}])(?=({_any(terms)}))"), F.lit(1))
    return F.flatten(F.transform(F.array_distinct(F.transform(found, F.lower)), lambda f: F.try_element_at(table, f)))


def instructions(x: Column, lk: Lookups) -> tuple[Column, Column]:
    """Explicit and dictionary instructions, longest terms first: raw and meanings."""
    label = rf"(?is){L.fields('instructions')}\s*:\s*(.+?)(?=\b{L.fields('medicine')}\s*:|\bAdvice\s*:|$)"
    explicit = F.array(T.squeeze(F.regexp_extract(x, label, 1)))
    terms = lk.longest(lk.instructions)
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(lk.instructions[t]).alias("m")) for t in terms])
    ranks = []
    for alone in (True, False):
        own = [n for n, t in enumerate(terms) if bool(re.fullmatch("[A-Za-z0-9]+", t)) == alone]
        numbers = F.array(*[F.lit(n) for n in own])
        ranks.append(F.transform(_hits(x, [terms[n] for n in own], alone), lambda i: F.get(numbers, i)))  # noqa: B023
    hits = F.transform(F.array_sort(F.array_distinct(F.concat(*ranks))), lambda n: F.get(table, n))
    start = F.filter(explicit, lambda e: e != "")
    raw = F.aggregate(hits, start, lambda a, h: F.when(F.exists(a, lambda e: F.contains(F.lower(e), F.lower(h["t"]))), a).otherwise(F.concat(a, F.array(h["t"]))))
    return F.array_join(F.array_distinct(raw), "; "), F.array_join(F.array_distinct(F.transform(hits, lambda h: h["m"])), "; ")


def trailing_instruction(x: Column) -> Column:
    return T.let(T.strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), " .,;:-"), _trailing)


def _trailing(flat: Column) -> Column:
    """What follows a duration, up to a footer; else an instruction at the very end."""
    ends = L.footer("Doctor", without=("Investigations", "Do not use"))
    tail = F.regexp_extract(flat, rf"(?i)(?:x|for)?\s*{NUMBER}\s*{L.any_of(*L.TIMES)}\b\s*[,;\-]?\s*(.+)$", 1)
    tail = T.strip(F.regexp_replace(T.strip(tail, " .,;:-"), rf"(?i)\b{ends}.*$", ""), " .,;:-")
    end = F.trim(F.regexp_extract(flat, rf"(?i)\b{L.any_of(*TAIL_INSTRUCTIONS)}\b(?:\s*[-:]\s*[^,;]+)?$", 0))
    bare = rf"(?i)^{L.fields('dose', 'duration', 'schedule', 'instructions')}$"
    return T.let(tail, lambda t: F.when((t != "") & ~t.rlike(bare), t).otherwise(end))


def medicine_match(x: Column, lk: Lookups) -> Column:
    """Struct normalized, abbreviation, category, ambiguity, notes of the longest key there."""
    return T.let(T.squeeze(F.regexp_replace(x, r"[^A-Za-z0-9+\-/ ]+", " ")), lambda cleaned: _matched(cleaned, lk))


def _matched(cleaned: Column, lk: Lookups) -> Column:
    names = ("normalized", "abbreviation", "category", "ambiguity", "notes")
    none = F.struct(cleaned.alias("normalized"), *[F.lit("").alias(n) for n in names[1:]])
    terms = lk.longest(lk.medicines)
    infos = F.array(*[F.struct(*[F.lit(v) for v in lk.medicines[t]]) for t in terms])

    def best(found: Column) -> Column:
        def chosen(rank: Column) -> Column:
            info = F.get(infos, rank)
            first = F.get(F.filter(found, lambda f: _rank(f, terms) == rank), F.lit(0))
            parts = (info["col1"], first, info["col2"], info["col4"], info["col3"])  # a row is names, category, notes, ambiguity
            return F.when(rank.isNotNull(), F.struct(*[c.alias(n) for c, n in zip(parts, names)])).otherwise(none)

        return T.let(F.array_min(F.transform(found, lambda f: _rank(f, terms))), chosen)

    return T.let(_found(cleaned, terms), best)


def has_known_medicine(x: Column, lk: Lookups) -> Column:
    return x.rlike(bounded_any(lk.medicine_terms()))


def from_medicine_start(x: Column, lk: Lookups) -> Column:
    """Cut before the first form or medicine, unless that is at the very start."""
    anchor = F.lit(bounded_any(lk.longest([*lk.forms, *lk.medicine_terms()])))
    return T.let(T.squeeze(x), lambda t: T.let(F.regexp_instr(t, anchor), lambda first: F.when(first > 3, T.strip(F.substring(t, first, F.length(t)))).otherwise(t)))


#: What is cut from the start of a line, in any place but for the number: number, heading, label.
_LEADS = (rf"^\s*{L.ITEM}", rf"(?i)\b{L.any_of(*L.LEADS)}\b\s*[:\-]?", rf"(?i)\b{L.fields('medicine')}\s*:\s*")


def split_parts(x: Column, lk: Lookups) -> Column:
    """Struct of the medicine part ``head`` and the ``rest``, cut at the first dose,
    frequency, duration or label."""
    t = F.trim(x)
    for lead in _LEADS:
        t = F.trim(F.regexp_replace(t, lead, ""))
    starts = [PATTERN, *["(?i)" + T.bounded(k) for k in lk.frequencies], r"(?i)\b(?:x|for)\s*\d+", r"(?i)\b(?:Dose\s*(?:and)?\s*Duration|Instructions)\s*:\s*"]
    edge = " -:;|"

    def cut(t: Column, c: Column) -> Column:
        head = F.when(c.isNull(), t).otherwise(T.strip(F.substring(t, F.lit(1), c - 1), edge))
        return F.struct(head.alias("head"), F.when(c.isNull(), "").otherwise(T.strip(F.substring(t, c, F.length(t)), edge)).alias("rest"))

    def body(t: Column) -> Column:
        at = F.array(*[F.regexp_instr(t, F.lit(p)) for p in starts])
        first = T.let(at, lambda a: F.coalesce(F.array_min(F.filter(a, lambda i: i > 1)), F.array_min(F.filter(a, lambda i: i > 0))))
        return T.let(first, lambda c: cut(t, c))

    return T.let(t, body)


def looks_like_medicine(x: Column, lk: Lookups) -> Column:
    return T.let(x, lambda line: _looks(line, lk))


def _looks(x: Column, lk: Lookups) -> Column:
    low = F.lower(F.trim(x))
    blocked = low.rlike("|".join(re.escape(b) for b in BLOCKED))
    detail = x.rlike(STRENGTH) | (dose_pattern(x) != "") | x.rlike(bounded_any(list(lk.frequencies)))
    return (F.length(low) >= 4) & ~blocked & (x.rlike(form_pattern(lk)) | (has_known_medicine(x, lk) & detail))


def without_label_tail(x: Column) -> Column:
    """Cut at the first label."""
    return F.trim(F.regexp_replace(x, rf"(?i){L.labelled('form', 'strength', 'dose', 'schedule', 'duration', 'instructions')}.*$", ""))


def medicine_line(x: Column, lk: Lookups) -> Column:
    number, heading, _ = _LEADS
    for lead in (number, rf"(?i)\b{L.any_of('Medicine', 'Medicine Name')}\s*:\s*", heading):
        x = F.regexp_replace(x, lead, "")
    return without_label_tail(from_medicine_start(T.strip(T.squeeze(x), " -:;|"), lk))


#: A remark in brackets, and all from the first label or remark on.
_BRACKETS = rf"(?i)\([^)]*{L.any_of(*L.REMARK_WORDS)}[^)]*\)"
_REST = rf"(?i)(?:{L.labelled('dose', 'schedule', 'duration')}|\b{L.fields('both')}\b|\bDose\s*(?:and|&)\b|\b{L.fields('instructions')}\b|\b{L.any_of(*L.REMARKS)}(?:\s*/\s*if\s+fever)?\b).*"


def medicine_name(line: Column, lk: Lookups) -> Column:
    """Name left of a cleaned line once form, strength and remarks are gone."""
    t = F.regexp_replace(without_strength(without_form(line, lk)), _BRACKETS, " ")
    t = F.regexp_replace(F.regexp_replace(t, _REST, ""), r"^[_=\-<\s]+", "")
    return T.strip(F.regexp_replace(F.regexp_replace(t, r"^a\s+(?=[A-Z])", ""), r"\s+", " "), " -:;|,()_")
