"""A stored name catalog: two tables and the thresholds they are asked with."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rxlink.operators import resolve
from rxlink.operators.mapping import require_columns

MEDICINE_COLUMNS, SALT_COLUMNS = ("ord", "name", "name_norm", "salts"), ("ord", "name", "name_norm")
_DEFAULTS = {"medicine_threshold": resolve.MEDICINE, "salt_threshold": resolve.SALT, "fuzzy_threshold": float(resolve.FUZZY), "top_k": resolve.TOP_K}


@dataclass(frozen=True)
class Catalog:
    medicine: DataFrame
    salt: DataFrame
    medicine_threshold: float = resolve.MEDICINE
    salt_threshold: float = resolve.SALT
    fuzzy_threshold: float = resolve.FUZZY
    top_k: int = resolve.TOP_K

    def asked_with(self, **stated) -> Catalog:
        """The catalog with the thresholds that are stated; None leaves its own."""
        return replace(self, **{k: v for k, v in stated.items() if v is not None})

    def resolve(self, asked: DataFrame, fuzzy: bool = True) -> DataFrame:
        return resolve.resolve(asked, self.medicine, self.salt, self.medicine_threshold, self.salt_threshold, self.fuzzy_threshold, self.top_k, fuzzy)


def catalog_path(path: str | None, knowledge_csv: str | None) -> str:
    """The stated folder, else the one named after the knowledge file."""
    if path:
        return path
    if knowledge_csv:
        return knowledge_csv.rsplit(".", 1)[0] + "_catalog"
    raise ValueError("state the catalog's folder or the knowledge file it was built from")


def save_catalog(rows: DataFrame, path: str, **thresholds) -> None:
    """rows: medicine, salts (array). Writes the folder that ``load_catalog`` reads."""
    unknown = sorted(set(thresholds) - set(_DEFAULTS))
    if unknown:
        raise ValueError(f"unknown thresholds: {', '.join(unknown)}")
    require_columns(rows, "medicine", "salts")
    medicine, salt = resolve.build_catalog(rows)
    medicine.write.mode("overwrite").parquet(f"{path}/medicine")
    salt.write.mode("overwrite").parquet(f"{path}/salt")
    stated = _DEFAULTS | {k: v for k, v in thresholds.items() if v is not None}
    one = rows.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in stated.items()])
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/thresholds")


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Raises ``FileNotFoundError`` for a folder without a catalog, ``ValueError`` for one that lacks columns."""
    try:
        medicine, salt = spark.read.parquet(f"{path}/medicine"), spark.read.parquet(f"{path}/salt")
        stated = spark.read.parquet(f"{path}/thresholds").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no catalog at {path}") from e
    require_columns(medicine, *MEDICINE_COLUMNS)
    require_columns(salt, *SALT_COLUMNS)
    return Catalog(medicine, salt).asked_with(**{k: stated[k] for k in _DEFAULTS if k in stated.asDict()})


def knowledge(df: DataFrame, medicine: str = "medicine", salts: str = "salts", separator: str = r"[;+|]") -> DataFrame:
    """A table of medicine names and salt lists in one text column as ``medicine, salts``."""
    require_columns(df, medicine, salts)
    parts = F.transform(F.split(F.coalesce(F.col(salts), F.lit("")), separator), lambda s: F.trim(s))
    return df.select(F.col(medicine).alias("medicine"), F.filter(parts, lambda s: s != "").alias("salts"))
