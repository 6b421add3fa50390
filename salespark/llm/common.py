"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import salespark
from salespark.plans.session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor
    (once per application), however the driver itself found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(next(iter(salespark.__path__)))
    path = Path(tempfile.mkdtemp(prefix="salespark-")) / "salespark-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, Path(top.name) / file.relative_to(top))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives lost executors and keeps later stages from computing it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def bucket_of(df: DataFrame, modulus: int, key: str = "doc_id"):
    """crc32 of a key as decimal text, modulo ``modulus`` (null key: 0 bytes)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


_MEMO: dict = {}


def memo(key: tuple, make):
    """What a Python worker remembers for ``key`` (an operator and its parameters).

    A worker remembers for one operator at a time: reused by a later stage, it
    forgets what it knew for the stage before, so memory doesn't add up over stages.
    """
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = make()
    return _MEMO[key]


def forget() -> None:
    """Drop what this Python worker remembers, for a stage that needs none of it (workers
    are reused, and whatever they hold adds to the stage's own memory)."""
    import pyarrow as pa

    if _MEMO:
        _MEMO.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
