"""The engine against golden rows, brute force and its own properties."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rxlink.functions import extract as E
from rxlink.functions import similarity as S
from rxlink.functions import text as T
from rxlink.operators import layout, mapping, merge, records, resolve
from rxlink.plans import pipelines
from rxlink.plans.queries import QUERIES
from rxlink.sources import io
from rxlink.sources.lookups import merge_lookups

LK = merge_lookups(medicines=[("Mnt-Lv", "Montelukast + Levocetirizine", "combination", "", "low")])


def one(spark, value, column):
    """What a column function makes of one text."""
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


# --- text


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.match_text, "Amoxy-Clav 625/Tab + X", "amoxy clav 625 tab plus x"),
        (T.match_text, None, ""),
        (T.count_token, "OoIl|", "00111"),
        (T.query_text, "  Foo \t BAR ", "foo bar"),
        (T.salt_components, "Amoxycillin + Clavulanic Acid", ["Amoxycillin", "Clavulanic Acid"]),
        (T.salt_components, "a and b, c/d & e;", ["a", "b", "c", "d", "e"]),
        (T.salt_components, "Vitamin A + Vitamin B1", ["Vitamin A", "Vitamin B1"]),
        (T.scanned_text, "Para S00 mg, 65O wg XS days 5ml", "Para 500 mg, 650 mg x 5 days 5 ml"),
        (T.scanned_text, "Dosage: 1\n\n\n\n  Food Instruction: x", "Dose: 1\nInstructions: x"),
        (T.prescription_part, "Clinic 5\nRx: a\nAdvice: b", "a"),
        (T.instruction_value, "After food. 2", "After food"),
        (T.medicine_label_text, "NAME: Rx Dolo - ", "Dolo"),
        (T.instruction_text, "INSTRUCTIONS: IF  FEVER.", "if fever"),
        (lambda x: T.value_after(x, r"\bDOSE\b"), "x DOSE: 1-0-1 ", "1-0-1"),
        (T.distinct_lines, "A b\n\na  B\nc", ["A b", "c"]),
        (T.natural_key, "Format_10", "format_" + "10".rjust(20, "0")),
        (T.safe_filename, "a b$.PNG", "a_b.png"),
        (T.display_value, "NaN", ""),
        (lambda x: T.unique_key(x, F.lit(3)), " - ", "blank_medicine_row_3"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_blank_and_odd(spark):
    got = [one(spark, x, T.is_blank) for x in (None, "", " nan ", "N/A", "x")]
    assert got == [True, True, True, True, False]
    assert [spark.range(1).select(T.odd(F.lit(v), 3, 31)).first()[0] for v in (1, 4, 31.6, 30)] == [3, 5, 31, 31]


# --- extractors


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (E.strength, "500 mg 1% x 5 ml", "500 mg + 5 ml"),
        (E.strength, "Cream 1%", ""),
        (E.dose_pattern, "take I-O-l now", "1-0-1"),
        (E.dose_pattern, "12-05-24", "12-05-24"),
        (E.dose_pattern, "Dose: l0  ml", "10 ml"),
        (E.readable_dose, "1-0-1", "1 in the morning, 1 in the night"),
        (E.readable_dose, "0-0-0", "No dose indicated"),
        (E.readable_dose, "1 cap", "1 cap"),
        (E.readable_dose, "", ""),
        (E.times_per_day, "1-0-1", 2),
        (E.times_per_day, "1 cap", None),
        (lambda x: F.concat_ws("|", *E.duration(x)), "x 5D", "5 days|5.0"),
        (lambda x: F.concat_ws("|", *E.duration(x)), "for 2 weeks", "2 weeks|14.0"),
        (lambda x: F.concat_ws("|", *E.duration(x)), "1.5 weeks", "1.5 weeks|10.5"),
        (lambda x: F.concat_ws("|", *E.duration(x)), "1 month", "1 month|30.0"),
        (E.strict_duration, "DURATION: 1 DAYS", "1 day"),
        (lambda x: E.frequency(x, LK)["abbreviation"], "take twice daily", "BD"),
        (lambda x: E.frequency(x, LK)["abbreviation"], "good", ""),
        (lambda x: E.instructions(x, LK)[1], "PC - Empty stomach", "Take on an empty stomach; Take post-meal"),
        (E.trailing_instruction, "Tab x 3 days, After food.", "After food"),
        (E.trailing_instruction, "OD PC - Empty stomach", "PC - Empty stomach"),
        (lambda x: E.medicine_match(x, LK)["normalized"], "Mnt-Lv kid", "Montelukast + Levocetirizine"),
        (lambda x: E.medicine_match(x, LK)["normalized"], "xyz (1)", "xyz 1"),
        (lambda x: E.from_medicine_start(x, LK), "Park Avenue 9 Cap Amoxicillin 500 mg", "Cap Amoxicillin 500 mg"),
        (lambda x: E.split_parts(x, LK)["rest"], "1. Tab Azithromycin 500 mg, 1-0-0 for 3 days", "1-0-0 for 3 days"),
        (lambda x: E.looks_like_medicine(x, LK), "Doctor Tab", False),
        (lambda x: E.looks_like_medicine(x, LK), "paracetamol 500 mg", True),
    ],
)
def test_extractors(spark, f, given, want):
    assert one(spark, given, f) == want


def test_known_terms():
    terms = LK.medicine_terms()
    assert "Montelukast" in terms and "Montelukast Levocetirizine" in terms and all(len(t) >= 3 for t in terms)
    own = merge_lookups(forms=[("tab", "Pill")], medicines=[("Zz", "Zed | Zee", "c", "n", "low")])
    assert own.forms["TAB"] == own.forms["PILL"] == "Pill" and own.medicines["zz"][0] == "Zed | Zee" and "Zee" in own.medicine_terms()


# --- records

GOLDEN = {
    "1. Tab Azithromycin 500 mg, 1-0-0 for 3 days, After food.": ("Azithromycin", "Tablet", "500 mg", "1-0-0", 1, "", "3 days", 3.0, "Take post-meal"),
    "1 Tab Azithromycin 500 mg 1-0-0 3 days After food": ("Azithromycin", "Tablet", "500 mg", "1-0-0", 1, "", "3 days", 3.0, "Take post-meal"),
    "1. Azithromycin 500 mg Tab OD (1 tablet) 3 DAYS PC - Empty stomach.": ("Azithromycin", "Tablet", "500 mg", "", None, "OD", "3 days", 3.0, "Take on an empty stomach; Take post-meal"),
}


@pytest.mark.parametrize("parts", [1, 7])
def test_golden_records(spark, parts):
    blocks = "Rx\nMedicine: Tab Ibuprofen 400 mg\nDose: 1 tab, Schedule: Twice daily, Duration: 5 days\nInstruction: After food\nMedicine: Cap Amoxicillin 500 mg\nDose: 1 cap\nDuration: 1 week\nAdvice: rest"
    texts = spark.createDataFrame([*((k, k) for k in GOLDEN), ("blocks", blocks), ("none", None), ("noise", "Clinic\nDate 5")], "source_image string, text string").repartition(parts)
    rows = records.extract_records(texts, LK).collect()
    by = {(r.source_image, r.record_number_in_image): r for r in rows}
    for k, want in GOLDEN.items():
        r = by[(k, 1)]
        assert (r.medicine_name, r.dosage_form_meaning, r.strength, r.dose_pattern, r.times_per_day_from_pattern, r.dose_frequency_abbreviation, r.duration, r.duration_days_estimate, r.instruction_meaning) == want
    assert [by[("blocks", i)].medicine_name for i in (1, 2)] == ["Ibuprofen", "Amoxicillin"] and by[("blocks", 1)].dose_frequency_abbreviation == "BD"
    assert {r.source_image for r in rows} == {*GOLDEN, "blocks"}


@pytest.fixture
def built(monkeypatch):
    """What is given to the builder of records."""
    given, plain = [], records.build_records
    monkeypatch.setattr(records, "build_records", lambda parts, lk: given.append(parts) or plain(parts, lk))
    return given


def test_repeated_texts_are_built_once(spark, built):
    texts = spark.createDataFrame([(f"i{n}", "1. Tab Azithromycin 500 mg, 1-0-0 for 3 days, After food.\nTab Zinc 5 mg OD") for n in range(40)], "source_image string, text string").repartition(3)
    rows = records.extract_records(texts, LK).collect()
    assert len({r.source_image for r in rows}) == 40 and len({tuple(r)[1:] for r in rows}) * 40 == len(rows)
    assert built[0].count() <= len(records.PARSERS) * 2


def fold(rows):
    """The survivorship rule, one record after the other."""
    best = {}
    for r in rows:
        score = sum(w for c, w in records.WEIGHTS.items() if r[c])
        if r["medicine_name"] not in best:
            best[r["medicine_name"]] = (score, r)
        elif score > best[r["medicine_name"]][0]:
            best[r["medicine_name"]] = (score, best[r["medicine_name"]][1] | {k: v for k, v in r.items() if v})
    return [v[1] for v in best.values()]


def test_survivorship(spark):
    rng = random.Random(1)
    rows = []
    for pos in range(60):
        r = dict.fromkeys(records.FIELDS, "") | {"times_per_day_from_pattern": None, "duration_days_estimate": None}
        r |= {"medicine_name": rng.choice(["paracetamol", "ibuprofen", "zinc x"]), "strength": rng.choice(["", "5 mg"]), "duration": rng.choice(["", f"{pos} days"]), "instructions": rng.choice(["", f"i{pos}"]), "dose_frequency_abbreviation": rng.choice(["OD", "BD"]), "raw_dose_text": rng.choice(["", f"d{pos}"])}
        rows.append(r)
    kinds = ", ".join(f"{c} {'int' if c.startswith('times') else 'double' if c.endswith('estimate') else 'string'}" for c in records.FIELDS)
    df = spark.createDataFrame([("a", 0, i, *(r[c] for c in records.FIELDS)) for i, r in enumerate(rows)], f"source_image string, parser int, pos int, {kinds}").repartition(5)
    got = [tuple(r[c] for c in records.FIELDS) for r in records.dedupe_records(df).orderBy("record_number_in_image").collect()]
    assert got == [tuple(r[c] for c in records.FIELDS) for r in fold(rows)]


# --- layout


def words(lines):
    """Lines (image, line, left, top, text) as word boxes."""
    return [(i, n, float(left + 60 * k), float(top), 50.0, 10.0, w) for i, n, left, top, t in lines for k, w in enumerate(t.split())]


def test_layout_records(spark):
    lines = [
        ("p", 1, 50, 100, "NAME: TAB Paracetamol 500 mg"), ("p", 2, 700, 90, "DOSE: 1-0-1"), ("p", 3, 1000, 95, "DURATION: 5 DAYS"), ("p", 4, 700, 120, "INSTRUCTIONS: AFTER FOOD"),
        ("p", 5, 50, 200, "NAME: CAP Amoxicillin 250 mg"), ("p", 6, 700, 195, "DOSE: 1-1-1"), ("p", 7, 1000, 205, "DURATION: 1 WEEK"), ("p", 8, 50, 400, "ADVICE rest"), ("q", 1, 50, 100, "NAME: TAB Zinc 5 mg"),
    ]
    df = spark.createDataFrame(words(lines), "image string, line_num int, left double, top double, width double, height double, text string")
    rows = layout.layout_records(df, LK).orderBy("record_number_in_image").collect()
    assert [(r.source_image, r.medicine_name, r.strength, r.dose_pattern, r.duration) for r in rows] == [("p", "Paracetamol", "500 mg", "1-0-1", "5 days"), ("p", "Amoxicillin", "250 mg", "1-1-1", "1 week")]
    assert rows[0].instruction_meaning == "Take post-meal"
    spans = {(r.image, r.row): r.duration for r in layout.visual_durations(df).collect()}
    assert spans == {("p", 1): "5 days", ("p", 2): "1 week", ("q", 1): ""}
    bare = spark.createDataFrame([("p", 1, "a", ""), ("p", 2, "b", "9 days")], "source_image string, record_number_in_image int, medicine_name string, duration string")
    assert [r.duration for r in layout.fill_durations(bare, layout.visual_durations(df)).orderBy("record_number_in_image").collect()] == ["5 days", "9 days"]


def test_repeated_bands_are_built_once(spark, built):
    lines = [(f"p{n}", k, 50, 100 * k + n, f"NAME: TAB {name} 500 mg DOSE: 1-0-1 DURATION: 5 DAYS") for n in range(30) for k, name in ((1, "Paracetamol"), (2, "Zinc"))]
    df = spark.createDataFrame(words(lines), "image string, line_num int, left double, top double, width double, height double, text string")
    rows = layout.layout_records(df, LK).collect()
    assert {(r.record_number_in_image, r.medicine_name, r.duration) for r in rows} == {(1, "Paracetamol", "5 days"), (2, "Zinc", "5 days")} and len(rows) == 60
    assert built[0].count() == 2


def test_chain_dedupe(spark):
    rng = random.Random(2)
    rows = [(f"i{i}", float(rng.randrange(200)), float(k), "x" * rng.randrange(1, 6)) for i in range(20) for k in range(12)]
    got = {}
    for r in layout.chain_dedupe(spark.createDataFrame(rows, "image string, cy double, left double, text string")).orderBy("image", "row").collect():
        got.setdefault(r.image, []).append((r.cy, r.left, r.text))
    for image in {r[0] for r in rows}:
        kept = []
        for r in sorted(x[1:] for x in rows if x[0] == image):
            if kept and abs(r[0] - kept[-1][0]) < 16:
                if len(r[2]) > len(kept[-1][2]):
                    kept[-1] = r
            else:
                kept.append(r)
        assert got[image] == kept


def test_boxes(spark):
    df = spark.createDataFrame([("a", 0, 0, 100, 40, 0.9), ("a", 0, 50, 100, 70, 0.9), ("a", 0, 80, 3, 90, 0.9), ("a", 0, 0, 100, 50, 0.1)], "image string, x1 int, y1 int, x2 int, y2 int, confidence double")
    ok = layout.valid_boxes(df, 0.5)
    assert ok.count() == 2 and layout.horizontal_boxes(ok).count() == 1
    assert spark.range(1).select(*layout.expanded_box(F.lit(3), F.lit(95), 10, F.lit(100))).first()[:] == (0, 100)


# --- merging


def test_merge(spark):
    schema = "source_image string, record_number_in_image int, medicine_name string, strength string"
    a = spark.createDataFrame([("x", 1, "a", ""), ("x", 2, "b", "1"), ("y", 1, "c", ""), ("z", 1, "", "")], schema)
    b = spark.createDataFrame([("x", 1, "q", "9"), ("x", 2, "r", "9"), ("y", 1, "s", "2"), ("y", 2, "t", "3"), ("w", 1, "u", "")], schema)
    got = {tuple(r) for r in merge.merge_extractions(a, b).select("source_image", "record_number_in_image", "medicine_name", "strength").collect()}
    assert got == {("x", 1, "a", "9"), ("x", 2, "b", "1"), ("y", 1, "s", "2"), ("y", 2, "t", "3"), ("z", 1, "", ""), ("w", 1, "u", "")}
    assert merge.merge_extractions(a, b.limit(0)) is a and merge.merge_extractions(a.limit(0), b) is b


# --- similarity


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        old = row[:]
        for j, d in enumerate(b):
            row[j + 1] = old[j] + 1 if c == d else max(old[j + 1], row[j])
    return row[-1]


def test_ratios():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randrange(n)))
    for _ in range(400):
        a, b = text(12), text(20)
        assert S.common(a, b) == slow_common(a, b)
        assert S.ratio(a, b) == S.ratio(b, a) and (S.ratio(a, b) == 100) == (a == b)
        if a and b:
            s, w = sorted((a, b), key=len)
            windows = [w[max(0, i) : i + len(s)] for i in range(1 - len(s), len(w))]
            if len(a) == len(b):
                windows_back = [s[max(0, i) : i + len(w)] for i in range(1 - len(w), len(s))]
                assert S.partial_ratio(a, b) == max(*(S.ratio(s, x) for x in windows), *(S.ratio(w, x) for x in windows_back))
            else:
                assert S.partial_ratio(a, b) == max(S.ratio(s, x) for x in windows)
    assert S.scores("", "x") == (0.0,) * 6
    assert S.token_set_ratio("new york mets", "new york mets vs braves") == 100 and S.token_sort_ratio("b a", "a b") == 100
    assert round(S.ratio("kitten", "sitting"), 2) == 61.54
    assert S.wratio("dolo", "dolo 650 extra") >= 85.5


def test_native_ratio(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("", "a"), ("abc", "abc"), ("aébc", "bcd é")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.native_ratio(F.col("a"), F.col("b"))).collect()
    assert all(abs(r[2] - S.ratio(r.a, r.b)) < 1e-9 for r in got)


# --- mapping


def test_hungarian():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (3, 3), (4, 6), (5, 5), (2, 7)]:
        for _ in range(20):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            cols = mapping.hungarian(cost)
            assert len(set(cols.tolist())) == n
            assert cost[range(n), cols].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def scored_rows(scores):
    return [(1, f"i{i}", f"k{k}", float(v), float(v), i, k) for i, row in enumerate(scores) for k, v in enumerate(row) if v is not None]


KIND = "problem int, image_name string, medicine_unique_key string, assignment_score double, final_match_score double, strip_row int, record_row int"


def test_assignments(spark):
    df = spark.createDataFrame(scored_rows([[90, 80], [85, 10]]), KIND)
    pairs = lambda x: {(r.image_name, r.medicine_unique_key) for r in x.collect()}
    assert pairs(mapping.greedy(df, "problem")) == {("i0", "k0"), ("i1", "k1")}
    assert pairs(mapping.optimal(df)) == {("i0", "k1"), ("i1", "k0")}
    rng = random.Random(6)
    rows = scored_rows([[rng.randrange(9) for _ in range(5)] for _ in range(7)])
    free_i, free_k, want = set(), set(), set()
    for r in sorted(rows, key=lambda r: (-r[3], -r[4], r[5], r[6])):
        if r[1] not in free_i and r[2] not in free_k:
            free_i.add(r[1])
            free_k.add(r[2])
            want.add((r[1], r[2]))
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert pairs(mapping.greedy(df, "problem")) == want and len(pairs(mapping.optimal(df))) == 5
    empty = df.limit(0)
    assert pairs(mapping.greedy(empty, "problem")) == set() == pairs(mapping.optimal(empty))


def test_final_mapping(spark):
    strips = spark.createDataFrame([("a.png", "DOLO 650 tablet", 1), ("b.png", "amoxy clav", 2), ("c.png", None, 3)], "image_name string, extracted_text string, strip_row int")
    recs = spark.createDataFrame([("Amoxy-Clav", "Amoxicillin", 1), ("Dolo", "Paracetamol", 2)], "medicine_name string, salt_name string, record_row int")
    rows = mapping.final_mapping(strips, recs).collect()
    assert [(r.image_name, r.prescription_medicine_name, r.match_confidence) for r in rows] == [("a.png", "Dolo", "High confidence"), ("b.png", "Amoxy-Clav", "High confidence"), ("c.png", None, mapping.UNMATCHED)]
    assert tuple(rows[0].asDict()) == mapping.FINAL_COLUMNS
    none = mapping.final_mapping(strips, recs.limit(0)).collect()
    assert [r.match_confidence for r in none] == [mapping.UNMATCHED] * 3
    with pytest.raises(ValueError, match="image_name"):
        mapping.final_mapping(strips.union(strips.filter("strip_row = 3")), recs)
    with pytest.raises(ValueError, match="salt_name"):
        mapping.candidates(strips, recs.drop("salt_name"))


def test_basis_and_labels(spark):
    f = lambda *x: [spark.range(1).select(c).first()[0] for c in mapping.best_basis(*map(F.lit, x))]
    assert f(90.0, 90.0, 80.0)[0] == "medicine_name" and f(10.0, 20.0, 20.0)[0] == "salt_name"
    labels = [spark.range(1).select(mapping.confidence(F.lit(v))).first()[0].split(" conf")[0] for v in (85.0, 84.99, 70.0, 50.0, 49.99)]
    assert labels == ["High", "Medium", "Medium", "Low", "Very low"]


# --- resolving


def test_resolve(spark):
    rows = spark.createDataFrame([("Allegra", ["Fexofenadine"]), ("Allegra-M", ["Fexofenadine", "Montelukast"]), ("Paracetamol 500", ["Paracetamol"])], "medicine string, salts array<string>")
    medicine, salt = resolve.build_catalog(rows)
    asked = spark.createDataFrame([("allegra",), ("",), ("Paracetamol + Montelukast",), ("paracetmol 500",), ("qqqq",), (None,)], "input string")
    got = {r.input: r for r in resolve.resolve(asked, medicine, salt).collect()}
    assert got["allegra"].output_salts == ["Fexofenadine"] and got["allegra"].matched_medicines[0].match_type == "exact" and got["allegra"].matched_medicines[0].score == 1.0
    assert got[""].input_type == "empty" and got["qqqq"].input_type == "unknown" and got["qqqq"].output_salts == []
    assert set(got["Paracetamol + Montelukast"].output_salts) >= {"Paracetamol", "Montelukast"}
    assert got["paracetmol 500"].matched_medicines[0].medicine == "Paracetamol 500"
    recs = spark.createDataFrame([("Allegra", 1), (None, 2)], "medicine_name string, record_number_in_image int")
    out = pipelines.attach_salts(recs, medicine, salt).orderBy("record_number_in_image").collect()
    assert [r.salt_name for r in out] == ["Fexofenadine", ""] and out[1].salt_lookup_input_type == "empty"
    flat = resolve.predictions(asked, resolve.resolve(asked, medicine, salt), "input")
    assert flat.count() == 6 and "output_salts_json" in flat.columns


def test_merge_tiers(spark):
    m = spark.createDataFrame([("q", "A", "a", 0.95, "fuzzy"), ("q", "a", "a", 0.99, "tfidf"), ("q", "B", "b", 1.0, "exact")], "q string, name string, name_norm string, score double, match_type string")
    assert [(r.name, r.score) for r in resolve.merge_tiers(m).orderBy("rank").collect()] == [("B", 1.0), ("A", 0.95)]


# --- sources, plans


def test_io(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("Format_10.png", "Format_2.PNG", "x.txt"):
        (tmp_path / "img" / n).write_bytes(b"1")
    rows = io.images(spark, str(tmp_path / "img")).orderBy("ord").collect()
    assert [r.image_name for r in rows] == ["Format_2.PNG", "Format_10.png"]
    with pytest.raises(ValueError):
        io.images(spark, "a.zip")

    class Upper(io.OcrBackend):
        def lines(self, content):
            return content.decode() + "!"

    assert {r.text for r in io.recognise(io.images(spark, str(tmp_path / "img")), Upper).collect()} == {"1!"}
    assert all("NotImplementedError" in r.error for r in io.recognise(io.images(spark, str(tmp_path / "img")), io.OcrBackend).collect())
    assert io.csv_or_empty(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    pd.DataFrame({"image_name": ["a", "b"], "extracted_text": ["dolo", "n/a"]}).to_csv(tmp_path / "s.csv", index=False)
    pd.DataFrame({"medicine_name": ["Dolo"], "salt_name": ["Paracetamol"]}).to_csv(tmp_path / "p.csv", index=False)
    out = pipelines.map_files(spark, str(tmp_path / "s.csv"), str(tmp_path / "p.csv"), str(tmp_path / "out")).collect()
    assert [(r.image_name, r.prescription_medicine_name) for r in out] == [("a", "Dolo"), ("b", None)]
    with pytest.raises(ValueError):
        io.csv(spark, str(tmp_path / "s.csv"), required=("zz",))


def test_prescription_plan(spark):
    texts = spark.createDataFrame([("a", "1. Tab Azithromycin 500 mg, 1-0-0 for 3 days"), ("b", "nothing")], "source_image string, text string")
    out = pipelines.prescription_records(texts, None, LK)
    rows = {r.source_image: r for r in pipelines.final_prescription(out).collect()}
    assert rows["a"].medicine_name == "Azithromycin" and rows["a"].record_number == "1" and tuple(rows["a"].asDict()) == pipelines.PRESCRIPTION_COLUMNS
    assert rows["b"].medicine_name is None or rows["b"].medicine_name == ""


def test_stream(spark, tmp_path):
    from rxlink.streaming import texts as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"source_image": "a", "text": "1. Tab Azithromycin 500 mg, 1-0-0 for 3 days"}\n')
    q = stream.write_records(stream.text_stream(spark, str(tmp_path / "in")), LK, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["medicine_name"] == "Azithromycin"


def test_queries_match_their_sql(spark):
    """A sample of the registered queries against DuckDB on the smallest tables."""
    import duckdb

    from rxlink.plans.queries import ORACLE_SQL

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        cols = sorted(QUERIES[name](spark, d).columns)
        plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float | int | np.number) else v
        key = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[cols].itertuples(index=False, name=None))  # noqa: B023, E731
        assert key(QUERIES[name](spark, d).toPandas()) == key(con.sql(sql).df()), name
