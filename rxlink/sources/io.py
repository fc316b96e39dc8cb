"""Scans and sinks (S1-S13, K1-K9, DM1-DM2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from rxlink.functions import text as T

EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def images(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Image files with their natural order as ``ord``; archives are refused."""
    if path.lower().endswith(".zip"):
        raise ValueError("an archive is no input; unpack it first")
    either = ",".join(sorted({x for e in extensions for x in (e, e.upper())}))
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{either}}}")
    df = reader.option("recursiveFileLookup", str(recursive).lower()).load(path)
    keyed = df.withColumns({"image_name": F.element_at(F.split("path", "/"), -1), "natural": T.natural_key("path")})
    order = keyed.select("path", "natural").withColumn("ord", F.row_number().over(Window.orderBy("natural", "path")))  # names only: contents stay where they are
    return keyed.join(order.select("path", "ord"), "path")


def csv(spark: SparkSession, path: str, schema: ST.StructType | str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header; texts that stand for null become null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    strings = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(~T.is_blank(c), F.col(c)) for c in strings}) if strings else df


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file's rows with nulls as empty texts, or no rows if it is not there."""
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return csv(spark, path, schema).na.fill("")
    return spark.createDataFrame([], schema)


def with_ordinal(df: DataFrame, name: str) -> DataFrame:
    """Row numbers 1.. in file order, without gathering the rows in one task or leaving the JVM.

    Numbers inside a partition come from its ids; a count a partition places them.
    """
    own = F.monotonically_increasing_id()
    counts = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()  # a row a partition
    before, total = {}, 0
    for p, n in sorted(tuple(r) for r in counts):
        before[p], total = total, total + n
    if not before:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    first = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.spark_partition_id())
    return df.withColumn(name, own.bitwiseAND(F.lit((1 << 33) - 1)) + first.cast("long") + F.lit(1))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_texts(df: DataFrame, path: str, name: str = "image_name", text: str = "text") -> None:
    """One folder of text files per image."""
    df.select(F.col(name), F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def preview(df: DataFrame, rows: int = 20) -> DataFrame | None:
    return df.limit(rows) if rows else None


class OcrBackend:
    """What turns an image's bytes into text lines and word boxes; deployments bring their own."""

    def lines(self, content: bytes) -> str:
        raise NotImplementedError("no OCR backend is installed")


def recognise(files: DataFrame, make: Callable[[], OcrBackend]) -> DataFrame:
    """image_name, text, error: the backend is made once a task, a failing image keeps its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for batch in batches:
            rows = []
            for name, content in zip(batch["image_name"], batch["content"]):
                try:
                    rows.append((name, backend.lines(content), None))
                except Exception as e:  # one unreadable image must not end the batch
                    rows.append((name, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["image_name", "text", "error"])

    return files.select("image_name", "content").mapInPandas(run, "image_name string, text string, error string")
