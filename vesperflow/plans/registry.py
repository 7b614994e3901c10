"""Queries by name and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperflow.functions import healpix
from vesperflow.operators import region
from vesperflow.plans import common, frame_queries, measure_queries, region_queries, robust_queries, scalar_queries, science_queries, series_queries, source_queries  # noqa: F401  they register their queries

QUERIES, ORACLE_SQL = common.QUERIES, common.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cone search with the robust statistics of each HEALPix cell in it."""
    found = region.within(common.sky(spark, sf_dir), region.Cone(region_queries.CONE.ra, region_queries.CONE.dec, 1.2))
    cells = healpix.with_nested_pixel(found, "cell", 4)
    stats = robust_queries.robust.mad(cells, ["cell"], "mag", normalized=True)
    return stats.join(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("mag").alias("brightest")), "cell")
