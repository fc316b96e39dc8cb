"""Shared plumbing of the corpus operators: scratch space and text helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words or pad lines.
ASCII_WS = " \t\n\x0b\x0c\r"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only when the session names none (tests, a laptop) is a local temporary
    folder made and set for this application.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rxlink-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.append((spark, path))
    return path


def drop_scratch() -> None:
    """Removes every scratch table that this process wrote."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already; the folder is scratch
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` into the shared folder and rereads it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Arrow batches of whole texts: rows and bytes at most, unless the session states its own.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keeps what a task holds of whole texts small, in the JVM and in Python.

    Spark's default of 10,000 rows a batch is tens to hundreds of MB of texts,
    several times over in each task. Sizes that the session sets stay.
    """
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def require(df: DataFrame, *columns: str) -> None:
    """Bounds the Arrow batches; raises ``ValueError`` naming the columns that are missing."""
    bound_batches(df.sparkSession)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
