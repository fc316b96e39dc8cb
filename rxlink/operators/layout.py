"""Coordinate layouts: words to lines, bands, nearest values, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxlink.functions import extract as E
from rxlink.functions import labels as L
from rxlink.functions import text as T
from rxlink.operators.records import settled, surviving_records
from rxlink.sources.lookups import Lookups

#: Pixel thresholds of the layout rules.
LEFT, SHORT_LEFT, GAP, BUCKET, ABOVE, BELOW, LOOK_UP, DURATION_LEFT, SLACK = 650.0, 260.0, 16.0, 8.0, 45.0, 95.0, 35.0, 500.0, 20.0
#: Headings of a page that are no medicine, and the forms that lines of medicines show.
BLOCKED = ("CLINIC NAME", "DOCTOR NAME", "PATIENT NAME", "QUALIFICATION", "REGISTRATION", "PRESCRIPTION DATE", "DIAGNOSIS")
SHOWN_FORMS = ("TAB", "TABLET", "CAP", "CAPSULE", "SYP", "SYRUP", "INJ", "OINT", "CREAM", "GEL", "DROP", "DROPS")


_ADVICE = r"(?i)^\s*ADVICE\b"


def word_lines(words: DataFrame, image: str = "image") -> DataFrame:
    """Words of one block, paragraph and line joined from left to right."""
    df = words.withColumn("word", T.cell("text")).filter("word <> ''")
    keys = [image, *(c for c in ("psm", "block_num", "par_num", "line_num") if c in words.columns)]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word"))), lambda s: s["word"]), " ")
    out = df.groupBy(*keys).agg(
        joined.alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"), F.avg(F.col("top") + F.col("height") / 2).alias("cy"),
    )
    return out.withColumn("norm", T.token_key("text"))


def bucket(cy: Column) -> Column:
    return F.bround(cy / BUCKET).cast("int")


def quantised_dedupe(lines: DataFrame, image: str = "image") -> DataFrame:
    """The first line of each text and height bucket."""
    order = [*(["psm"] if "psm" in lines.columns else []), "cy", "left", "text"]
    w = Window.partitionBy(image, "__k", "__b").orderBy(*order)
    df = lines.withColumns({"__k": T.dedupe_key("text"), "__b": bucket(F.col("cy"))})
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__k", "__b")


def section_end(lines: DataFrame, image: str = "image") -> DataFrame:
    """``advice_y``: the first advice line, or below everything."""
    w = Window.partitionBy(image)
    found = F.min(F.when(F.col("text").rlike(_ADVICE), F.col("cy"))).over(w)
    return lines.withColumn("advice_y", F.coalesce(found, F.max("cy").over(w) + 100.0))


def is_medicine_line(text: Column, left: Column, cy: Column, advice_y: Column) -> Column:
    return (cy < advice_y) & _names_medicine(text, left)


def _names_medicine(text: Column, left: Column) -> Column:
    up = F.upper(text)
    labelled = up.rlike(rf"^\s*{L.any_of(*L.MISREAD_NAMES)}\s*[:;.-]")
    shaped = (left < SHORT_LEFT) | up.rlike(rf"\b{L.any_of(*SHOWN_FORMS)}\b") | up.rlike(rf"(?i)\b{E.NUMBER}\s*{L.any_of(*(u for u in L.STRENGTHS if not u.startswith('unit')))}\b")
    return (text != "") & (left <= LEFT) & labelled & ~up.rlike("|".join(BLOCKED)) & (F.length(T.strip_label(text, "name")) >= 4) & shaped


_ROW = "array<struct<cy:double,left:double,text:string>>"


def _chained(rows: Column, gap: float = GAP) -> Column:
    """Of sorted rows those that ``chain_dedupe`` keeps."""

    def step(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = F.coalesce(F.abs(r["cy"] - last["cy"]) < gap, F.lit(False))
        longer = F.length(r["text"]) > F.length(last["text"])
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(r))
        return F.when(~near, F.concat(kept, F.array(r))).when(longer, swapped).otherwise(kept)

    return F.aggregate(rows.cast(_ROW), F.array().cast(_ROW), step)


def chain_dedupe(lines: DataFrame, image: str = "image", gap: float = GAP) -> DataFrame:
    """Down the page, a line within the gap of the last kept one goes, or takes its
    place if its text is longer. A fold over an image's lines (a page's worth)."""
    lists = lines.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("cy", "left", "text"))).alias("rows"))
    return lists.select(image, F.posexplode(_chained(F.col("rows"), gap)).alias("pos", "r")).select(image, (F.col("pos") + 1).alias("row"), "r.cy", "r.left", "r.text")


def midpoint_bands(anchors: DataFrame, image: str = "image", limit: Column | None = None) -> DataFrame:
    """``upper`` and ``lower`` half-way to the neighbouring anchors (image, row, cy)."""
    w = Window.partitionBy(image).orderBy("row")
    before, after = F.lag("cy").over(w), F.lead("cy").over(w)
    end = F.col("cy") + BELOW if limit is None else F.least(limit, F.col("cy") + BELOW)
    upper = F.greatest(F.lit(0.0), F.coalesce((before + F.col("cy")) / 2, F.col("cy") - ABOVE))
    return anchors.withColumns({"upper": upper, "lower": F.coalesce((F.col("cy") + after) / 2, end)})


def band_join(bands: DataFrame, points: DataFrame, image: str = "image", slack: float = 0.0) -> DataFrame:
    """Points (image, y, ..) inside each band, both ends inclusive."""
    b = bands.alias("b")
    p = points.alias("p")
    on = (F.col(f"b.{image}") == F.col(f"p.{image}")) & F.col("p.y").between(F.col("b.upper") - slack, F.col("b.lower") + slack)
    return b.join(p, on).select("b.*", *[F.col(f"p.{c}") for c in points.columns if c != image])


def nearest_in_band(bands: DataFrame, points: DataFrame, image: str = "image", slack: float = SLACK, ties: tuple[str, ...] = ("y",)) -> DataFrame:
    """Of each band's points the one nearest to its anchor."""
    w = Window.partitionBy(image, "row").orderBy(F.abs(F.col("y") - F.col("cy")), *ties)
    return band_join(bands, points, image, slack).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def horizontal_boxes(boxes: DataFrame, image: str = "image", min_height: float = 10, ratio: float = 0.8, share: float = 0.6) -> DataFrame:
    """Wide boxes of at least a share of the image's tallest, from top to bottom."""
    df = boxes.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).filter((F.col("h") < ratio * F.col("w")) & (F.col("h") >= min_height))
    return df.withColumn("top_h", F.max("h").over(Window.partitionBy(image))).filter(F.col("h") >= share * F.col("top_h")).drop("top_h")


def valid_boxes(boxes: DataFrame, min_confidence: float = 0.0, min_side: int = 5) -> DataFrame:
    keep = (F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side)
    return boxes.filter(keep & (F.col("confidence") >= min_confidence) if "confidence" in boxes.columns else keep)


def scaled_box(x: Column, size: Column) -> Column:
    """A relative coordinate in pixels, cut towards zero and kept inside."""
    return F.least(F.greatest((x * size).cast("int"), F.lit(0)), size.cast("int"))


def expanded_box(low: Column, high: Column, pad: int, size: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), low - pad), F.least(size, high + pad)


def reading_order(boxes: DataFrame, image: str = "image") -> DataFrame:
    """Texts of an image's boxes from top to bottom, left to right."""
    rows = F.array_sort(F.collect_list(F.struct("y1", "x1", "text")))
    said = F.array_join(F.filter(F.transform(rows, lambda r: T.one_line(r["text"])), lambda t: t != ""), " ")
    return boxes.groupBy(image).agg(said.alias("extracted_text"))


def _medicine_rows(lines: DataFrame) -> DataFrame:
    marked = section_end(lines)
    names = marked.filter(is_medicine_line(F.col("text"), F.col("left"), F.col("cy"), F.col("advice_y")))
    ends = marked.groupBy("image").agg(F.max("advice_y").alias("advice_y"))
    rows = chain_dedupe(names).join(ends, "image")
    return midpoint_bands(rows, limit=F.col("advice_y"))


def _page_bands(lines: DataFrame) -> DataFrame:
    """Pages of at least two medicine rows: image, row, name_text, and the lines of the
    row's band from top to bottom as ``at`` (equal for lines at one place) and ``text``."""
    page = lines.groupBy("image").agg(
        F.min(F.when(F.col("text").rlike(_ADVICE), F.col("cy"))).alias("advice"), F.max("cy").alias("bottom"),
        F.array_sort(F.collect_list(F.when(_names_medicine(F.col("text"), F.col("left")), F.struct("cy", "left", "text")))).alias("names"),
        F.collect_list(F.struct(F.col("cy").alias("y"), F.col("left").alias("x"), "text")).alias("points"),
    )
    page = settled(page, "image", "names", "points", F.coalesce("advice", F.col("bottom") + 100.0).alias("advice_y"))
    end = F.col("advice_y")
    rows = settled(page, "image", "points", "advice_y", _chained(F.filter("names", lambda r: r["cy"] < end)).alias("rows")).filter(F.size("rows") >= 2)

    def band(r: Column, i: Column) -> Column:
        cy, before, after = r["cy"], F.get("rows", i - 1)["cy"], F.get("rows", i + 1)["cy"]
        upper = F.greatest(F.lit(0.0), F.coalesce((before + cy) / 2, cy - ABOVE))
        lower = F.coalesce((cy + after) / 2, F.least(end, cy + BELOW))

        def inside(b: Column) -> Column:
            return F.filter("points", lambda p: (p["y"] < end) & (p["y"].between(b["upper"], b["lower"]) | ((p["y"] >= cy - LOOK_UP) & (p["y"] < b["upper"]) & (p["x"] >= LEFT))))

        def placed(found: Column) -> Column:
            place = lambda p: F.struct(p["y"], p["x"])
            return T.let(F.transform(found, place), lambda places: F.transform(found, lambda p: F.struct(F.array_position(places, place(p)).alias("at"), p["text"].alias("text"))))

        return F.struct(r["text"].alias("name_text"), T.let(F.array_sort(T.let(F.struct(upper.alias("upper"), lower.alias("lower")), inside)), placed).alias("lines"))

    return rows.select("image", F.posexplode(F.transform("rows", band)).alias("pos", "b")).select("image", (F.col("pos") + 1).alias("row"), "b.name_text", "b.lines").filter(F.size("lines") > 0)


def _band_parts(bands: DataFrame) -> DataFrame:
    """The four texts of a record, from the row's name and the lines of its band."""

    def bits(value) -> Column:
        rows = F.transform("lines", lambda r: F.struct(r["at"], value(r["text"]).alias("v")))
        return F.transform(F.array_sort(F.filter(rows, lambda r: r["v"].isNotNull())), lambda r: r["v"])

    def labelled(label: str, shown, also):
        """What follows the label, else the whole line if it looks like such a value."""
        return lambda t: T.let(T.value_after(t, label), lambda v: F.when((v != "") | also(t), shown(F.coalesce(F.nullif(v, F.lit("")), t))))

    has = lambda w: lambda t: F.contains(F.upper(t), F.lit(w))
    after = lambda prefix: lambda v: F.concat(F.lit(prefix), v)
    fields = (
        ("d", r"\bDOSE\b", after("DOSE: "), lambda t: t.rlike(E.PATTERN)), ("s", r"\bDURATION\b", after("DURATION: "), has("DURATION")), ("i", r"\bINSTRUCTIONS?\b", T.instruction_text, has("INSTRUCTION")),
    )
    kept = [c for c in bands.columns if c not in ("name_text", "lines")]
    out = settled(bands, *kept, T.medicine_label_text("name_text").alias("name"), *[bits(labelled(label, shown, also)).alias(c) for c, label, shown, also in fields])
    for column, label, shown, _ in fields:
        name, value = F.col("name"), F.col("value")
        rest = [c for c in out.columns if c not in ("name", column)]
        cut = F.when(name.rlike("(?i)" + label), T.strip(F.split(name, "(?i)" + label, 2)[0])).otherwise(name)
        out = settled(out, *out.columns, T.value_after(name, label).alias("value"))
        out = settled(out, *rest, cut.alias("name"), F.when(value != "", F.concat(column, F.array(shown(value)))).otherwise(F.col(column)).alias(column))
    line = lambda c, sep: F.array_join(F.filter(F.array_distinct(c), lambda b: b != ""), sep)
    out = settled(out, *kept, "name", line("d", " ").alias("d"), line("s", " ").alias("s"), line("i", "; ").alias("i"))
    said = lambda *cs: F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in cs])
    parts = settled(out, *kept, F.col("name").alias("medicine_line"), said("d", "s").alias("dose_line"), F.col("i").alias("instruction_line"))
    parts = parts.filter("medicine_line <> ''")
    return parts.withColumn("raw", said("medicine_line", "dose_line", "instruction_line"))


def layout_records(words: DataFrame, lk: Lookups) -> DataFrame:
    """Records of pages whose fields stand in columns; pages of one row give none.

    The words are shuffled once, by their image; no two lines of a band are alike,
    as ``quantised_dedupe`` leaves none on a page.
    """
    bands = _page_bands(quantised_dedupe(word_lines(words.filter("image IS NOT NULL").repartition("image"))))
    rows = bands.select(F.col("image").alias("source_image"), F.lit(0).alias("parser"), F.col("row").alias("pos"), "name_text", "lines")
    return surviving_records(rows, ["name_text", "lines"], _band_parts, lk)


def visual_durations(words: DataFrame) -> DataFrame:
    """The duration nearest to each medicine row: image, row, duration."""
    lines = quantised_dedupe(word_lines(words))
    rows = _medicine_rows(lines)
    spans = section_end(lines).withColumn("duration", E.strict_duration(F.col("text"))).filter((F.col("cy") < F.col("advice_y")) & (F.col("left") >= DURATION_LEFT) & (F.col("duration") != ""))
    w = Window.partitionBy("image", "duration", bucket(F.col("cy"))).orderBy("cy", "left")
    spans = spans.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    best = nearest_in_band(rows.drop("text", "left"), spans.select("image", F.col("cy").alias("y"), F.col("left").alias("x"), "duration"), ties=("y", "x"))
    return rows.select("image", "row").join(best.select("image", "row", "duration"), ["image", "row"], "left").na.fill("", ["duration"])


def fill_durations(records: DataFrame, durations: DataFrame) -> DataFrame:
    """Blank durations filled by the row's position in its image."""
    w = Window.partitionBy("source_image").orderBy("record_number_in_image")
    df = records.withColumn("__row", F.row_number().over(w))
    d = durations.select(F.col("image").alias("__image"), F.col("row").alias("__at"), F.col("duration").alias("__duration"))
    df = df.join(d, (F.col("source_image") == F.col("__image")) & (F.col("__row") == F.col("__at")), "left")
    return df.withColumn("duration", F.when(T.is_blank("duration") & ~T.is_blank("__duration"), F.col("__duration")).otherwise(F.col("duration"))).drop("__row", "__image", "__at", "__duration")
