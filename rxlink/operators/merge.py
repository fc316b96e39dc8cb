"""Reconciling two extractions of the same images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxlink.functions import text as T

SCORED = ("medicine_name", "strength", "dose_pattern", "dose_pattern_meaning", "dose_frequency_abbreviation", "dose_frequency", "dose_frequency_meaning", "duration", "instruction_meaning")
FILLED = (
    "medicine_name", "medicine_name_normalized", "raw_medicine_text", "dosage_form_meaning", "strength", "dose_pattern", "dose_pattern_meaning", "times_per_day_from_pattern", "dose_frequency_abbreviation",
    "dose_frequency", "dose_frequency_meaning", "dose_frequency_safe_check", "duration", "instruction_meaning",
)


def field_score(columns: list[str]) -> Column:
    """How many of the scored columns a row has filled."""
    have = [c for c in SCORED if c in columns]
    return reduce(lambda a, b: a + b, [F.when(T.is_blank(c), 0).otherwise(1) for c in have], F.lit(0))


def stats(df: DataFrame, prefix: str, image: str) -> DataFrame:
    """Rows with a name, and the completeness score, per image."""
    return df.groupBy(F.col(image).alias("__image")).agg(F.count_if(~T.is_blank("medicine_name")).alias(f"{prefix}_rows"), F.sum(field_score(df.columns)).alias(f"{prefix}_score"))


def merge_extractions(first: DataFrame, second: DataFrame, image: str = "source_image", number: str = "record_number_in_image") -> DataFrame:
    """Per image the second extraction if it has more usable rows; with as many
    (and some) the first one with its blanks filled by position; else whichever
    scores higher. Numbered anew. An empty side leaves the other as it is."""
    if second.isEmpty():
        return first
    if first.isEmpty():
        return second
    choice = stats(first, "a", image).join(stats(second, "b", image), "__image", "full").na.fill(0)
    more, same = F.col("b_rows") > F.col("a_rows"), (F.col("b_rows") == F.col("a_rows")) & (F.col("b_rows") > 0)
    choice = choice.select("__image", F.when(more, "second").when(same, "fill").when(F.col("b_score") > F.col("a_score"), "second").otherwise("first").alias("__pick"))
    w = Window.partitionBy(image).orderBy(number)
    a = first.withColumn("__n", F.row_number().over(w)).join(choice, F.col(image) == F.col("__image")).drop("__image")
    b = second.withColumn("__n", F.row_number().over(w)).join(choice, F.col(image) == F.col("__image")).drop("__image")
    fills = [c for c in FILLED if c in second.columns]
    other = b.select(F.col(image).alias("__image"), F.col("__n").alias("__m"), *[F.col(c).alias(f"__b_{c}") for c in fills])
    kept = a.filter("__pick <> 'second'").join(other, (F.col(image) == F.col("__image")) & (F.col("__n") == F.col("__m")), "left")
    for c in fills:
        new = F.col(f"__b_{c}")
        have = F.col(c) if c in first.columns else F.lit("")
        kept = kept.withColumn(c, F.when((F.col("__pick") == "fill") & T.is_blank(have) & ~T.is_blank(new), new).otherwise(have))
    kept = kept.drop("__image", "__m", *[f"__b_{c}" for c in fills])
    out = kept.unionByName(b.filter("__pick = 'second'"), allowMissingColumns=True)
    return out.withColumn(number, F.row_number().over(Window.partitionBy(image).orderBy("__n"))).drop("__n", "__pick")


def image_names(first: DataFrame, second: DataFrame, image: str = "source_image") -> DataFrame:
    """Distinct images of both."""
    return first.select(image).unionByName(second.select(image)).distinct()


def error_rows(images: DataFrame, records: DataFrame, image: str = "source_image") -> DataFrame:
    """One empty row with an error for every image without a record."""
    rest = images.join(records.select(image).distinct(), image, "left_anti")
    message = F.coalesce(F.col("error"), F.lit("no medicine record found")) if "error" in images.columns else F.lit("no medicine record found")
    return records.unionByName(rest.select(image, F.lit(1).alias("record_number_in_image"), message.alias("error")), allowMissingColumns=True)
