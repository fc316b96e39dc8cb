"""The command lines and the stored catalog over small files."""

import json

import pandas as pd
import pytest

from rxlink import cli
from rxlink.functions import text as T
from rxlink.sources import catalog


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    pd.DataFrame({"medicine": ["Augmentin 625 Duo", "Dolo 650"], "salts": ["Amoxycillin; Clavulanic Acid", "Paracetamol"]}).to_csv(d / "k.csv", index=False)
    assert cli.main(["catalog", "--knowledge-csv", str(d / "k.csv"), "--top-k", "3"]) == 0
    return d


def test_catalog(spark, files):
    got = catalog.load_catalog(spark, str(files / "k_catalog"))
    assert (got.medicine_threshold, got.salt_threshold, got.fuzzy_threshold, got.top_k) == (0.72, 0.70, 92, 3)
    assert {r["name"]: list(r["salts"]) for r in got.medicine.collect()} == {"Augmentin 625 Duo": ["Amoxycillin", "Clavulanic Acid"], "Dolo 650": ["Paracetamol"]}
    with pytest.raises(FileNotFoundError):
        catalog.load_catalog(spark, str(files / "none"))
    with pytest.raises(ValueError):
        catalog.catalog_path(None, None)


def test_resolve(spark, files, capsys):
    k = ["--knowledge-csv", str(files / "k.csv")]
    assert cli.main(["resolve", *k, "--query", "dolo  650"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["output_salts"] == ["Paracetamol"]
    pd.DataFrame({"asked": ["Dolo 650", None, "zzzz"], "n": [1, 2, 3]}).to_csv(files / "q.csv", index=False)
    assert cli.main(["resolve", *k, "--input-csv", str(files / "q.csv"), "--output-csv", str(files / "out")]) == 0
    got = {r["n"]: (r["input_type"], r["output_salts"] or "") for r in spark.read.csv(str(files / "out"), header=True, escape='"').collect()}
    assert got == {"1": ("medicine", "Paracetamol"), "2": ("empty", ""), "3": ("unknown", "")}
    assert cli.main(["resolve", *k]) == 1
    assert cli.main(["resolve", *k, "--input-csv", str(files / "q.csv")]) == 1


def test_prescriptions_then_map(spark, files):
    pd.DataFrame({"source_image": ["a"], "text": ["1. Tab Azithromycin 500 mg, 1-0-0 for 3 days"]}).to_csv(files / "t.csv", index=False)
    assert cli.main(["prescriptions", "--input", str(files / "t.csv"), "--knowledge-csv", str(files / "k.csv"), "--output-csv", str(files / "rx"), "--output-dir", str(files / "ocr")]) == 0
    assert spark.read.csv(str(files / "rx"), header=True).first()["medicine_name"] == "Azithromycin"
    pd.DataFrame({"image_name": ["x.png", "y.png"], "extracted_text": ["azithromycin 500", "zzz"]}).to_csv(files / "s.csv", index=False)
    pd.DataFrame({"medicine_name": ["Azithromycin"], "salt_name": ["Azithromycin"]}).to_csv(files / "p.csv", index=False)
    paths = ["--strip_csv", str(files / "s.csv"), "--prescription_csv", str(files / "p.csv"), "--output_csv", str(files / "m"), "--all_candidates_csv", str(files / "c")]
    assert cli.main(["map", *paths]) == 0
    assert spark.read.csv(str(files / "m"), header=True).count() == 2
    pairs = spark.read.csv(str(files / "c"), header=True)
    assert pairs.count() == 2 and "salt_name_token_set_ratio" in pairs.columns


def test_upload_name(spark):
    rows = spark.createDataFrame([(1, "a b.PNG"), (2, None), (3, "__.jpg"), (1234, "d/x"), (5, ".png")], "i int, n string")
    got = [r[0] for r in rows.orderBy("i").select(T.upload_name("n", "i", "strip")).collect()]
    assert got == ["strip_001_a_b.png", "strip_002_strip_002.png", "strip_003_strip_003.jpg", "strip_005_png.png", "strip_1234_x.png"]
