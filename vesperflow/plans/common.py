"""The sky, star and pixel tables that the queries derive from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

import functools
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperflow.session import scratch_path, ship, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

DEG = math.pi / 180


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if that exists."""

    def put(f):
        @functools.wraps(f)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = shipped
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_LAYOUTS: dict[tuple, str] = {}


def layout(spark: SparkSession, sf_dir: str, name: str, write) -> DataFrame:
    """A table laid out for its queries, written once an application and table folder by `write(path)`, read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _LAYOUTS:
        try:
            return spark.read.parquet(_LAYOUTS[key])
        except AnalysisException:  # the shared folder has been cleared
            pass
    path = scratch_path(spark, name)
    write(path)
    _LAYOUTS[key] = path
    return spark.read.parquet(path)


def lit(x: float) -> str:
    """A double literal for SQL."""
    s = repr(float(x))
    return s if "e" in s else f"{s}E0"


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ra, decl, mag): a deterministic projection of orders onto the sphere."""
    k = F.col("o_orderkey")
    ra = F.lit(2 * math.pi) * (F.pmod(k * 7919, F.lit(100003)) / F.lit(100003.0))
    dec = F.asin(F.pmod(k * 104729, F.lit(99991)) * 2.0 / F.lit(99991.0) - 1.0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), ra.alias("ra"), dec.alias("decl"), (F.col("o_totalprice") / 30000.0).alias("mag"))


SKY = f"""sky AS (SELECT o_orderkey id, {lit(2 * math.pi)} * (((o_orderkey * 7919) % 100003) / 100003.0E0) ra,
  asin(((o_orderkey * 104729) % 99991) * 2.0E0 / 99991.0E0 - 1.0E0) decl, o_totalprice / 30000.0E0 mag FROM orders)"""


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, idx, x, y, flux): detections of small frames, from lineitem."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 16).cast("int").alias("frame"), k.alias("idx"), (F.pmod(k * 7919, F.lit(10007)) / 8.0).alias("x"), (F.pmod(k * 104729, F.lit(9973)) / 8.0).alias("y"), F.col("l_extendedprice").alias("flux")
    )


STARS = """stars AS (SELECT CAST(l_orderkey // 16 AS INTEGER) frame, l_orderkey * 10 + l_linenumber idx,
  (((l_orderkey * 10 + l_linenumber) * 7919) % 10007) / 8.0E0 x, (((l_orderkey * 10 + l_linenumber) * 104729) % 9973) / 8.0E0 y, l_extendedprice flux FROM lineitem)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, x, y, c, value, weight): frames of 40 x 25 pixels with one to three channels, from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(30)).cast("int").alias("frame"), F.pmod("l_orderkey", F.lit(40)).cast("int").alias("x"), F.pmod("l_partkey", F.lit(25)).cast("int").alias("y"),
        F.pmod("l_linenumber", F.lit(2)).cast("int").alias("c"), (F.col("l_extendedprice") / 99991.0).alias("value"), (F.col("l_quantity") / 50.0).alias("weight"),
    )


PIXELS = """pixels AS (SELECT CAST(l_suppkey % 30 AS INTEGER) frame, CAST(l_orderkey % 40 AS INTEGER) x, CAST(l_partkey % 25 AS INTEGER) y,
  CAST(l_linenumber % 2 AS INTEGER) c, l_extendedprice / 99991.0E0 AS value, l_quantity / 50.0E0 weight FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, s, value): the events as a series for each user, s in seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "value")


SAMPLES = "samples AS (SELECT event_id, user_id, ts, event_type, epoch_us(ts) / 1e6 s, value FROM events)"


def r(c, digits: int = 6):
    """Rounded, with -0.0 made 0.0, as results are compared by value."""
    return F.round(c, digits) + 0.0
