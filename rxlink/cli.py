"""Command lines: ``python -m rxlink.cli {map,catalog,resolve,prescriptions} ...``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlink import session
from rxlink.operators import mapping
from rxlink.plans import pipelines
from rxlink.sources import catalog, io
from rxlink.sources.lookups import load_lookups


def _show(df: DataFrame, rows: int) -> None:
    if rows:
        df.show(rows, truncate=60)


def _map(spark: SparkSession, a: argparse.Namespace) -> None:
    out = pipelines.map_files(spark, a.strip_csv, a.prescription_csv, a.output_csv, not a.drop_unmatched_images, a.all_candidates_csv)
    _show(mapping.summary(out), 1)
    _show(out, a.preview_rows)


def _catalog(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = catalog.knowledge(io.csv(spark, a.knowledge_csv), a.medicine_column, a.salts_column)
    catalog.save_catalog(rows, catalog.catalog_path(a.index_path, a.knowledge_csv), **_thresholds(a))


def _thresholds(a: argparse.Namespace) -> dict:
    return {k: getattr(a, k) for k in ("medicine_threshold", "salt_threshold", "fuzzy_threshold", "top_k")}


def _loaded(spark: SparkSession, a: argparse.Namespace) -> catalog.Catalog:
    return catalog.load_catalog(spark, catalog.catalog_path(a.index_path, a.knowledge_csv)).asked_with(**_thresholds(a))


def _resolve(spark: SparkSession, a: argparse.Namespace) -> None:
    if not a.query and not a.input_csv:
        raise ValueError("state --query or --input-csv")
    if a.input_csv and not a.output_csv:
        raise ValueError("--input-csv needs --output-csv")
    names = _loaded(spark, a)
    if a.query:
        asked = spark.createDataFrame([(a.query,)], "input string")
        print(io.as_json(names.resolve(asked, not a.disable_fuzzy)).first()["json"])
    if a.input_csv:
        pipelines.resolve_file(spark, names, a.input_csv, a.output_csv, a.input_column, not a.disable_fuzzy)


def _texts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """source_image, text: from a table of texts, or from images through the stated backend."""
    if a.ocr_backend:
        module, _, name = a.ocr_backend.partition(":")
        made = getattr(importlib.import_module(module), name)
        return io.recognise(io.images(spark, a.input), made).select(F.col("image_name").alias("source_image"), "text")
    return io.csv(spark, a.input, required=("source_image", "text")).select("source_image", "text")


def _prescriptions(spark: SparkSession, a: argparse.Namespace) -> None:
    terms = load_lookups(spark, a.forms_csv, a.instructions_csv, a.frequencies_csv, a.medicines_csv)
    texts = _texts(spark, a)
    if a.ocr_backend:
        texts = mapping.checkpointed(texts)  # each image is read once
    words = spark.read.parquet(a.words) if a.words else None
    out = pipelines.prescription_records(texts, words, terms, not a.disable_layout_repair)
    if not a.skip_salt_lookup:
        names = _loaded(spark, a)
        out = pipelines.attach_salts(out, names.medicine, names.salt, a.medicine_query_column)
    if a.output_dir and not a.no_save_ocr_text:
        io.write_texts(texts, a.output_dir, "source_image")
    final = mapping.checkpointed(pipelines.final_prescription(out))
    io.write_csv(final, a.output_csv)
    _show(final, a.preview_rows)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rxlink")
    subs = top.add_subparsers(dest="command", required=True)

    p = subs.add_parser("map", help="one record at most for each strip")
    for name in ("--strip_csv", "--prescription_csv", "--output_csv"):
        p.add_argument(name, required=True)
    p.add_argument("--all_candidates_csv")
    p.add_argument("--drop_unmatched_images", action="store_true")
    p.add_argument("--preview-rows", type=int, default=20)
    p.set_defaults(run=_map)

    names = argparse.ArgumentParser(add_help=False)
    names.add_argument("--index-path")
    names.add_argument("--knowledge-csv")
    for name, kind in (("--medicine-threshold", float), ("--salt-threshold", float), ("--fuzzy-threshold", float), ("--top-k", int)):
        names.add_argument(name, type=kind)

    p = subs.add_parser("catalog", parents=[names], help="builds the catalog that resolve and prescriptions ask")
    p.add_argument("--medicine-column", default="medicine")
    p.add_argument("--salts-column", default="salts")
    p.set_defaults(run=_catalog)

    p = subs.add_parser("resolve", parents=[names], help="names to medicines and salts")
    for name in ("--query", "--input-csv", "--input-column", "--output-csv"):
        p.add_argument(name)
    p.add_argument("--disable-fuzzy", action="store_true")
    p.set_defaults(run=_resolve)

    p = subs.add_parser("prescriptions", parents=[names], help="texts or images to records")
    p.add_argument("--input", required=True, help="a CSV of source_image and text; with --ocr-backend an image or a folder of images")
    p.add_argument("--ocr-backend", help="module:class of an OcrBackend")
    p.add_argument("--words", help="Parquet of word boxes of the same images")
    for name in ("--forms-csv", "--instructions-csv", "--frequencies-csv", "--medicines-csv"):
        p.add_argument(name, default="")
    p.add_argument("--output-csv", required=True)
    p.add_argument("--output-dir")
    p.add_argument("--no-save-ocr-text", action="store_true")
    p.add_argument("--medicine-query-column")
    p.add_argument("--skip-salt-lookup", action="store_true")
    p.add_argument("--disable-layout-repair", action="store_true")
    p.add_argument("--preview-rows", type=int, default=20)
    p.set_defaults(run=_prescriptions)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or session.session("rxlink")
    session.ship_package(spark)
    try:
        a.run(spark, a)
    except (ValueError, FileNotFoundError) as e:
        print(f"rxlink: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
