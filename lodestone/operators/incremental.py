"""Incremental runs: what changed, replacing a file's rows, edges whose target vanished, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINGERPRINT = ("size", "mtime_ns", "sha256")


def dirty_files(scan: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files of the scan that are new or differ in size, time or hash from the stored row of their path."""
    if force:
        return scan
    same = scan.alias("a").join(stored.alias("b"), F.col("a.path") == F.col("b.path"), "left")
    equal = F.lit(True)
    for c in FINGERPRINT:
        equal = equal & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return same.where(F.col("b.path").isNull() | ~equal).select("a.*")


def replace_files(rows: DataFrame, new: DataFrame, file_column: str = "file_id") -> DataFrame:
    """rows without those of the files that `new` brings, and the new rows."""
    return rows.join(new.select(file_column).distinct(), file_column, "left_anti").select(*rows.columns).unionByName(new)


def null_dangling(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose target is gone keep their confidence and lose the target."""
    left = symbols.select(F.col("id").alias("dst_symbol_id"), F.lit(True).alias("_there"))
    out = edges.join(left, "dst_symbol_id", "left")
    return out.withColumn("dst_symbol_id", F.when(F.col("_there"), F.col("dst_symbol_id"))).drop("_there").select(*edges.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)
