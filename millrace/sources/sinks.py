"""Where results go: exports, whole replacements, and what changed since a cursor."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then swap: a failed write leaves the old table as it was.

    ``df`` may read ``path`` itself.
    """
    spark = df.sparkSession
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    had = fs.exists(of(path))
    if had:
        fs.rename(of(path), of(old))
    fs.rename(of(staged), of(path))
    if had:
        fs.delete(of(old), True)


def changed_since(df: DataFrame, cursor: Column, updated_at: str = "updated_at", key: str = "id") -> DataFrame:
    """Rows to export after a cursor, soft deletes among them, in the order in which a cursor advances."""
    return df.where(F.col(updated_at) > cursor).orderBy(updated_at, key)
