"""The three end-to-end plans: mapping, prescriptions to records, name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlink.functions import text as T
from rxlink.operators import layout, mapping, merge, resolve
from rxlink.operators.records import extract_records
from rxlink.sources import io
from rxlink.sources.catalog import Catalog
from rxlink.sources.lookups import Lookups

PRESCRIPTION_COLUMNS = (
    "source_image", "record_number", "medicine_name", "dosage_form_meaning", "strength", "dose_pattern", "dose_pattern_meaning", "times_per_day_from_pattern", "dose_frequency", "dose_frequency_meaning",
    "dose_frequency_safe_check", "duration", "instruction_meaning", "salt_name",
)


def map_files(spark: SparkSession, strip_csv: str, prescription_csv: str, output_csv: str | None = None, keep_unmatched: bool = True, all_candidates_csv: str | None = None) -> DataFrame:
    """Strips and prescription records from CSV to the 16-column mapping; every scored pair too, if a path is given."""
    strips = io.with_ordinal(io.csv(spark, strip_csv, required=("image_name", "extracted_text")), "strip_row")
    records = io.with_ordinal(io.csv(spark, prescription_csv, required=("medicine_name", "salt_name")), "record_row")
    scored = None
    if all_candidates_csv:
        scored = mapping.checkpointed(mapping.candidates(strips, records))
        io.write_csv(mapping.candidate_export(scored), all_candidates_csv)
    out = mapping.final_mapping(strips, records, keep_unmatched, scored=scored)
    if output_csv:
        io.write_csv(out, output_csv, single=True)
    return out


def prescription_records(texts: DataFrame, words: DataFrame | None, lk: Lookups, repair_layout: bool = True) -> DataFrame:
    """Texts and word boxes of the same images to merged records."""
    out = extract_records(texts, lk)
    if words is not None:
        if repair_layout:
            out = merge.merge_extractions(out, layout.layout_records(words, lk))
        out = layout.fill_durations(out, layout.visual_durations(words))
    return merge.error_rows(texts.select("source_image").distinct(), out)


def resolve_file(spark: SparkSession, catalog: Catalog, input_csv: str, output_csv: str | None = None, column: str | None = None, fuzzy: bool = True) -> DataFrame:
    """A CSV's rows with six prediction columns; the first column is asked if none is named."""
    df = io.csv(spark, input_csv)
    column = column or df.columns[0]
    mapping.require_columns(df, column)
    if df.isEmpty():
        raise ValueError("the input has no rows")
    out = resolve.predictions(df, catalog.resolve(df.select(F.col(column).alias("input")), fuzzy), column)
    if output_csv:
        io.write_csv(out, output_csv)
    return out


def attach_salts(records: DataFrame, medicine: DataFrame, salt: DataFrame, column: str | None = None) -> DataFrame:
    """The first salt of each record's first medicine match."""
    asked = records.withColumn("salt_lookup_query", resolve.query_choice(records, column))
    found = resolve.resolve(asked.select(F.col("salt_lookup_query").alias("input")), medicine, salt)
    first = F.try_element_at("matched_medicines", F.lit(1))
    flat = found.select(
        F.col("input").alias("__q"), resolve.first_salt(F.col("matched_medicines")).alias("salt_name"), F.coalesce(F.array_join(first["salts"], "; "), F.lit("")).alias("all_salts_from_first_matched_medicine"),
        F.coalesce(first["medicine"], F.lit("")).alias("matched_medicine"), first["score"].alias("matched_medicine_score"), F.coalesce(first["match_type"], F.lit("")).alias("matched_medicine_match_type"),
        F.col("input_type").alias("salt_lookup_input_type"), F.to_json("matched_medicines").alias("matched_medicines_json"), F.to_json("matched_salts").alias("matched_salts_json"),
    )
    return asked.join(flat, F.col("salt_lookup_query") == F.col("__q"), "left").drop("__q").withColumn("salt_lookup_error", F.lit(""))


def final_prescription(records: DataFrame) -> DataFrame:
    """The 14-column export: renamed, numbers as whole texts, blanks for what is missing."""
    named = records.withColumns({"record_number": F.col("record_number_in_image"), "dose_frequency": F.col("dose_frequency_abbreviation")})
    number = F.col("record_number").cast("string")
    named = named.withColumn("record_number", F.when(number.rlike(r"^\d*\.?\d+$"), number.cast("double").cast("int").cast("string")).otherwise(T.cell(number)))
    return mapping.projected(named, PRESCRIPTION_COLUMNS, blank=True)
