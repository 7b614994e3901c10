"""Mosaic panels on a tangent plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plan(spark: SparkSession, columns: int, rows: int, width: float, height: float, overlap: float, serpentine: bool = False) -> DataFrame:
    """(panel, row, column, x, y): centres of equal steps about the middle, row by row, every other row back if serpentine."""
    p = spark.range(rows * columns).select(F.col("id").cast("int").alias("panel"), F.floor(F.col("id") / columns).cast("int").alias("row"), F.pmod("id", F.lit(columns)).cast("int").alias("c"))
    c = F.when(F.lit(serpentine) & (F.col("row") % 2 == 1), F.lit(columns - 1) - F.col("c")).otherwise(F.col("c"))
    p = p.select("panel", "row", c.alias("column"))
    return p.withColumns({"x": (F.col("column") - (columns - 1) / 2) * (width * (1 - overlap)), "y": (F.col("row") - (rows - 1) / 2) * (height * (1 - overlap))})
