"""Sources and sinks: the driver's tables written in each format and read back."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperflow.operators import region
from vesperflow.plans.common import DEG, SKY, lit, pixels, query, r, sky
from vesperflow.session import materialize, scratch_path, table
from vesperflow.sources import adql, binary, bytes as files, text
from vesperflow.streaming import frames


def _lines(df: DataFrame, name: str) -> str:
    """The text column of `df` written as files of lines; their folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("d"))


# ---- text -----------------------------------------------------------------------------------------------------------


def _csv(spark, sf_dir):
    """Quoted, padded, commented and blank lines."""
    o = _orders(spark, sf_dir)
    row = F.concat(F.col("k").cast("string"), F.lit(' , "say ""no. '), F.pmod("k", F.lit(7)).cast("string"), F.lit('"", twice" ,'), F.col("c").cast("string"))
    more = F.when(F.pmod("k", F.lit(5)) == 0, F.array(F.lit("# a comment, not a row"), F.lit(""), row)).otherwise(F.array(row))
    return _lines(o.select(F.explode(more).alias("value")), "csv")


_CSV_SQL = "SELECT o_orderkey id, 'say \"no. ' || (o_orderkey % 7) || '\", twice' note, o_custkey cust FROM orders"


@query(_CSV_SQL)
def csv_read(spark, sf_dir):
    return text.read_csv(spark, _csv(spark, sf_dir), header=False, schema="id long, note string, cust long")


@query(_CSV_SQL)
def csv_read_stream(spark, sf_dir):
    rows = text.read_csv(spark, _csv(spark, sf_dir), header=False, schema="id long, note string, cust long", stream=True)
    return frames.settle(rows, "append", "rows")


@query("SELECT o_orderkey id, ' a ' || (o_orderkey % 9) || ' ' padded, 'a ' || (o_orderkey % 9) trimmed FROM orders")
def csv_line_parse(spark, sf_dir):
    """Padding within quotes stays or goes."""
    o = _orders(spark, sf_dir)
    line = F.concat(F.lit('x;" a '), F.pmod("k", F.lit(9)).cast("string"), F.lit(' "'))
    return o.select(F.col("k").alias("id"), text.parse_line(line, "h string, v string", ";")["v"].alias("padded"), text.parse_line(line, "h string, v string", ";", force_trim=True)["v"].alias("trimmed"))


@query("SELECT 'line ' || o_orderkey AS value FROM orders WHERE o_orderkey % 3 <> 0")
def line_read(spark, sf_dir):
    o = _orders(spark, sf_dir)
    v = F.when(F.pmod("k", F.lit(3)) == 0, F.lit("   ")).otherwise(F.concat(F.lit("  line "), F.col("k").cast("string"), F.lit(" ")))
    return text.read_lines(spark, _lines(o.select(v.alias("value")), "lines"))


def _fixed(*fields) -> F.Column:
    """A line with texts at their columns, counted from 1: (start, width, column), right-aligned."""
    out, at = [], 1
    for start, width, c in fields:
        out += [F.lit(" " * (start - at))] if start > at else []
        out.append(F.lpad(c.cast("string") if not isinstance(c, str) else F.lit(c), width, " "))
        at = start + width
    return F.concat(*out)


def _dec(v, whole: int, scale: int) -> F.Column:
    """A whole number of 10 ** -scale as decimal text of a fixed width."""
    return F.format_string(f"%{whole + scale + 1}s", F.concat(F.floor(v / 10**scale).cast("string"), F.lit("."), F.lpad(F.pmod(v, F.lit(10**scale)).cast("string"), scale, "0")))


@query(f"""SELECT lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') designation, round((o_orderkey % 300) / 10.0E0, 6) h, make_date(CAST(1950 + o_orderkey % 80 AS INTEGER), CAST(1 + o_orderkey % 12 AS INTEGER), CAST(1 + o_orderkey % 28 AS INTEGER)) epoch,
round((o_orderkey % 3600000) / 10000.0E0 * {lit(DEG)}, 9) mean_anomaly, round((o_orderkey % 9000) / 10000.0E0, 6) eccentricity, round((1000 + o_orderkey % 40000) / 1000.0E0, 6) semi_major_axis FROM orders""")
def minor_planet_elements(spark, sf_dir):
    o = _orders(spark, sf_dir)
    k = F.col("k")
    day = F.make_date(F.pmod(k, F.lit(80)) + 1950, F.pmod(k, F.lit(12)) + 1, F.pmod(k, F.lit(28)) + 1)
    line = _fixed((1, 5, F.lpad(F.pmod(k, F.lit(100000)).cast("string"), 5, "0")), (9, 5, _dec(F.pmod(k, F.lit(300)) * 10, 2, 2)), (21, 5, text.pack_date("day")), (27, 9, _dec(F.pmod(k, F.lit(3600000)) * 10, 3, 5)), (71, 9, _dec(F.pmod(k, F.lit(9000)) * 1000, 1, 7)), (93, 11, _dec((F.pmod(k, F.lit(40000)) + 1000) * 10000, 3, 7)))
    e = text.minor_planets(text.read_lines(spark, _lines(o.withColumn("day", day).select(line.alias("value")), "elements"), trim=False))
    return e.select("designation", r("h").alias("h"), "epoch", r("mean_anomaly", 9).alias("mean_anomaly"), r("eccentricity").alias("eccentricity"), r("semi_major_axis").alias("semi_major_axis"))


@query(f"""SELECT CAST(o_orderkey % 1000 AS INTEGER) number, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE 'C' END orbit_type, CAST(1900 + o_orderkey % 120 AS INTEGER) AS year, round((100000 + o_orderkey % 900000) / 100000.0E0, 6) perihelion, round((o_orderkey % 3600000) / 10000.0E0 * {lit(DEG)}, 9) node FROM orders WHERE o_orderkey % 7 <> 0""")
def comet_elements(spark, sf_dir):
    """Lines whose orbit type is unknown are left out."""
    k = F.col("k")
    kind = F.when(F.pmod(k, F.lit(7)) == 0, "Q").when(F.pmod(k, F.lit(3)) == 0, "P").otherwise("C")
    line = _fixed((1, 4, F.lpad(F.pmod(k, F.lit(1000)).cast("string"), 4, "0")), (5, 1, kind), (15, 4, F.pmod(k, F.lit(120)) + 1900), (31, 9, _dec((F.pmod(k, F.lit(900000)) + 100000) * 10, 2, 6)), (62, 8, _dec(F.pmod(k, F.lit(3600000)), 3, 4)))
    e = text.comets(text.read_lines(spark, _lines(_orders(spark, sf_dir).select(line.alias("value")), "comets"), trim=False))
    return e.select("number", "orbit_type", "year", r("perihelion").alias("perihelion"), r("node", 9).alias("node"))


_DIGITS = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


@query(f"""SELECT o_orderkey id, substr({_DIGITS}, CAST(year(o_orderdate) // 100 + 1 AS BIGINT), 1) || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || substr({_DIGITS}, month(o_orderdate) + 1, 1) || substr({_DIGITS}, day(o_orderdate) + 1, 1) packed, CAST(o_orderdate AS DATE) AS date FROM orders""")
def packed_dates(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("packed", text.pack_date("d"))
    return o.select(F.col("k").alias("id"), "packed", text.unpack_date("packed").alias("date"))


_ARC = lit(math.pi / 648000)


@query(f"""SELECT round(40000 + o_orderkey % 20000 + 0.0E0, 2) mjd, round((o_orderkey % 900000) / 1000000.0E0 * {_ARC}, 15) pm_x, round(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7000000) / 10000000.0E0 ELSE (o_orderkey % 3000000) / 10000000.0E0 END, 8) ut1_utc FROM orders WHERE o_orderkey % 5 <> 0""")
def earth_orientation_finals(spark, sf_dir):
    """The final column where it is there, else the rapid one; rows that lack a field go."""
    k = F.col("k")
    none = F.lit("")
    line = _fixed((8, 8, _dec((F.pmod(k, F.lit(20000)) + 40000) * 100, 5, 2)), (19, 9, F.when(F.pmod(k, F.lit(5)) != 0, _dec(F.pmod(k, F.lit(900000)), 2, 6)).otherwise(none)), (38, 9, _dec(F.pmod(k, F.lit(900000)), 2, 6)), (59, 10, _dec(F.pmod(k, F.lit(3000000)), 2, 7)), (155, 11, F.when(F.pmod(k, F.lit(2)) == 0, _dec(F.pmod(k, F.lit(7000000)), 3, 7)).otherwise(none)))
    e = text.earth_orientation_a(text.read_lines(spark, _lines(_orders(spark, sf_dir).select(line.alias("value")), "finals"), trim=False))
    return e.select(r("mjd", 2).alias("mjd"), r("pm_x", 15).alias("pm_x"), r("ut1_utc", 8).alias("ut1_utc"))


@query(f"""SELECT round(40000 + o_orderkey % 20000 + 0.0E0, 2) mjd, round((o_orderkey % 900000) / 1000000.0E0 * {_ARC}, 15) pm_y, round((o_orderkey % 3000000) / 10000000.0E0, 8) ut1_utc FROM orders""")
def earth_orientation_c04(spark, sf_dir):
    k = F.col("k")
    row = F.concat_ws("  ", F.lit("1962 1 1 0"), (F.pmod(k, F.lit(20000)) + 40000).cast("string"), F.lit("0.1"), _dec(F.pmod(k, F.lit(900000)), 2, 6), _dec(F.pmod(k, F.lit(3000000)), 2, 7))
    lines = F.when(F.pmod(k, F.lit(4)) == 0, F.array(F.lit("# a note"), row)).otherwise(F.array(row))
    e = text.earth_orientation_b(text.read_lines(spark, _lines(_orders(spark, sf_dir).select(F.explode(lines).alias("value")), "c04")))
    return e.select(r("mjd", 2).alias("mjd"), r("pm_y", 15).alias("pm_y"), r("ut1_utc", 8).alias("ut1_utc"))


@query(f"""SELECT CAST(o_orderkey AS INTEGER) id, round((o_orderkey % 2400) / 100.0E0 * {lit(15 * DEG)}, 9) ra, round(((o_orderkey * 7) % 17000 / 100.0E0 - 85) * {lit(DEG)}, 9) decl, round((o_orderkey % 500) / 10.0E0 * {lit(DEG / 3600000)} / cos(((o_orderkey * 7) % 17000 / 100.0E0 - 85) * {lit(DEG)}), 14) pm_ra, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round((o_orderkey % 150) / 10.0E0, 3) END mag FROM orders""")
def star_list_csv(spark, sf_dir):
    """A star list in comma-separated columns: hours, degrees and milliarcseconds become radians, a blank magnitude null."""
    k = F.col("k")
    dec = F.pmod(k * 7, F.lit(17000))
    row = F.concat_ws(",", k.cast("string"), _dec(F.pmod(k, F.lit(2400)), 2, 2), ((dec - 8500) / 100.0).cast("string"), _dec(F.pmod(k, F.lit(500)), 2, 1), F.lit("0"), F.lit("1.5"), F.when(F.pmod(k, F.lit(9)) == 0, "").otherwise(_dec(F.pmod(k, F.lit(150)), 2, 1)), F.lit("10"))
    c = text.read_csv(spark, _lines(_orders(spark, sf_dir).select(row.alias("value")), "stars"), header=False, schema="id string, ra string, dec string, pmra string, pmdec string, rv string, mag string, dist string")
    return text.star_catalogue(c).select("id", r("ra", 9).alias("ra"), r("decl", 9).alias("decl"), r("pm_ra", 14).alias("pm_ra"), r("mag", 3).alias("mag"))


_TLE = f"""round((o_orderkey % 1800000) / 10000.0E0 * {lit(DEG)}, 9) inclination, round((o_orderkey % 9000000) / 10000000.0E0, 9) eccentricity, round((1000000000 + o_orderkey * 7919 % 600000000) / 100000000.0E0 * {lit(2 * math.pi / 1440)}, 12) mean_motion"""


@query(f"""SELECT CAST(o_orderkey % 100000 AS INTEGER) satellite, make_timestamp(1900 + CASE WHEN o_orderkey % 100 < 57 THEN 100 ELSE 0 END + o_orderkey % 100, 1, 1, 0, 0, 0) + to_days(CAST(o_orderkey % 365 AS INTEGER)) epoch, {_TLE} FROM orders""")
def two_line_elements(spark, sf_dir):
    k = F.col("k")
    one = _fixed((1, 2, "1 "), (3, 5, F.lpad(F.pmod(k, F.lit(100000)).cast("string"), 5, "0")), (19, 2, F.lpad(F.pmod(k, F.lit(100)).cast("string"), 2, "0")), (21, 12, _dec((F.pmod(k, F.lit(365)) + 1) * 10**8, 3, 8)), (54, 8, " 11606-4"))
    two = _fixed((1, 2, "2 "), (9, 8, _dec(F.pmod(k, F.lit(1800000)), 3, 4)), (18, 8, _dec(F.pmod(k, F.lit(3600000)), 3, 4)), (27, 7, F.lpad(F.pmod(k, F.lit(9000000)).cast("string"), 7, "0")), (35, 8, "  1.0000"), (44, 8, "  2.0000"), (53, 11, _dec(F.pmod(k * 7919, F.lit(600000000)) + 1000000000, 2, 8)))
    t = text.two_line_elements(_orders(spark, sf_dir).select(one.alias("line1"), two.alias("line2")))
    return t.select("satellite", "epoch", r("inclination", 9).alias("inclination"), r("eccentricity", 9).alias("eccentricity"), r("mean_motion", 12).alias("mean_motion"))


@query(f"SELECT CAST(o_orderkey % 100000 AS INTEGER) satellite, {_TLE} FROM orders")
def mean_elements_json(spark, sf_dir):
    k = F.col("k")
    doc = F.to_json(F.struct(F.pmod(k, F.lit(100000)).alias("NORAD_CAT_ID"), F.lit("2024-01-02T03:04:05.5").alias("EPOCH"), _dec(F.pmod(k, F.lit(1800000)), 3, 4).alias("INCLINATION"), _dec(F.pmod(k, F.lit(9000000)), 1, 7).alias("ECCENTRICITY"), _dec(F.pmod(k * 7919, F.lit(600000000)) + 1000000000, 2, 8).alias("MEAN_MOTION")))
    t = text.mean_elements(_orders(spark, sf_dir).select(doc.alias("value")))
    return t.select("satellite", r("inclination", 9).alias("inclination"), r("eccentricity", 9).alias("eccentricity"), r("mean_motion", 12).alias("mean_motion"))


@query("SELECT o_custkey cust, o_orderkey id, round(o_totalprice, 2) price FROM orders")
def small_body_rows(spark, sf_dir):
    """A service's answers, one a customer: names of fields, and rows of texts."""
    row = F.array(F.col("k").cast("string"), F.col("p").cast("decimal(18,2)").cast("string"))
    answers = _orders(spark, sf_dir).groupBy("c").agg(F.collect_list(row).alias("data"))
    doc = F.to_json(F.struct(F.size("data").cast("string").alias("count"), F.array(F.lit("des"), F.lit("dist")).alias("fields"), F.col("data")))
    docs = answers.select(F.to_json(F.struct(F.col("c").alias("who"))).alias("who"), doc.alias("value"))
    rows = docs.select("who", F.explode(F.from_json("value", "data array<array<string>>")["data"]).alias("v"), "value")
    one = rows.select("who", F.to_json(F.struct(F.array(F.lit("des"), F.lit("dist")).alias("fields"), F.array("v").alias("data"), F.lit("1").alias("count"))).alias("value"))
    got = text.close_approaches(one.withColumnRenamed("value", "doc"), "doc")
    who = answers.select("c", F.explode("data").alias("v")).select(F.col("c").alias("cust"), F.col("v")[0].alias("id"))
    return got.select(F.col("row")["des"].alias("id"), F.col("row")["dist"].try_cast("double").alias("price")).join(who, "id").select("cust", F.col("id").cast("long").alias("id"), r("price", 2).alias("price"))


@query("SELECT o_custkey cust, CAST(o_orderkey AS BIGINT) id, round(o_totalprice, 2) price FROM orders")
def ephemeris_service(spark, sf_dir):
    """A service's text for each customer: the table between its marks, parsed row by row."""
    line = F.concat_ws(",", F.col("k").cast("string"), F.col("p").cast("decimal(18,2)").cast("string"))
    t = _orders(spark, sf_dir).groupBy("c").agg(F.concat(F.lit("Header, $ and text\n$$SOE\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n$$EOE\nnotes, 1, 2\n")).alias("v"))
    rows = t.select(F.col("c").alias("cust"), F.explode(text.ephemeris_table(F.col("v"))).alias("l")).withColumn("f", F.from_csv("l", "id long, price double"))
    return rows.select("cust", "f.id", r("f.price", 2).alias("price"))


@query("""SELECT o_orderkey id, CASE o_orderkey % 5 WHEN 0 THEN '(433)' WHEN 1 THEN '2019 AB' || (o_orderkey % 90) WHEN 2 THEN 'C/2020 F3-B' WHEN 3 THEN '2040 P-L' ELSE 'CERES' END canonical, CASE o_orderkey % 5 WHEN 0 THEN 'numbered' WHEN 1 THEN 'provisional' WHEN 2 THEN 'comet' WHEN 3 THEN 'survey' ELSE 'name' END kind, o_orderkey % 5 = 2 fragment FROM orders""")
def designation_normalise(spark, sf_dir):
    m = F.pmod("k", F.lit(5))
    v = F.when(m == 0, " (433) ").when(m == 1, F.concat(F.lit(" 2019   ab"), F.pmod("k", F.lit(90)).cast("string"))).when(m == 2, "c/2020  f3-b").when(m == 3, "2040 p-l ").otherwise("ceres")
    return _orders(spark, sf_dir).select(F.col("k").alias("id"), text.canonical_designation(v).alias("canonical"), text.designation_kind(v).alias("kind"), text.fragment_of(v, F.lit("C/2020 f3")).alias("fragment"))


@query("SELECT o_custkey cust, count(*) n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) keys FROM orders GROUP BY 1")
def group_into_lists(spark, sf_dir):
    """Rows gathered by a key, in the order of another."""
    g = _orders(spark, sf_dir).groupBy(F.col("c").alias("cust")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("k")).alias("l"))
    return g.select("cust", "n", F.concat_ws(",", F.transform("l", lambda x: x.cast("string"))).alias("keys"))


# ---- remote catalogues ----------------------------------------------------------------------------------------------

_BOX = region.Box(350.0 * DEG, 15.0 * DEG, -20.0 * DEG, 35.0 * DEG)


def _replica(service: adql.Service, box: str) -> str:
    return f"""WITH {SKY}, basic AS (SELECT id oid, ra * {lit(180 / math.pi)} ra, decl * {lit(180 / math.pi)} AS dec FROM sky), allfluxes AS (SELECT id oidref, CASE WHEN id % 4 <> 0 THEN mag END V FROM sky),
    gaia AS (SELECT id source_id, ra * {lit(180 / math.pi)} ra, decl * {lit(180 / math.pi)} AS dec, mag gmag FROM sky) SELECT id, round(ra, 6) ra, round(mag, 6) mag FROM ({box})"""


def _local(spark, sf_dir, service: adql.Service, *args, **kw) -> DataFrame:
    """A service's query text run on local tables of its layout, as its answer in text, parsed."""
    s, k = sky(spark, sf_dir), 180 / math.pi
    s.select(F.col("id").alias("oid"), (F.col("ra") * k).alias("ra"), (F.col("decl") * k).alias("dec")).createOrReplaceTempView("basic")
    s.select(F.col("id").alias("oidref"), F.when(F.pmod("id", F.lit(4)) != 0, F.col("mag")).alias("V")).createOrReplaceTempView("allfluxes")
    s.select(F.col("id").alias("source_id"), (F.col("ra") * k).alias("ra"), (F.col("decl") * k).alias("dec"), F.col("mag").alias("gmag")).createOrReplaceTempView("gaia")
    found = spark.sql(adql.query_text(service, *args, limit=True, **kw))
    answer = found.select(F.concat(F.lit('id\tra\tdec\tmag\n"'), F.concat_ws('"\t', *(F.col(c).cast("string") for c in ("id", "ra", "decl", "mag"))), F.lit("\n")).alias("value"))
    return adql.stars(answer)


@query(_replica(adql.JOINED, adql.query_text(adql.JOINED, [_BOX], 2.0, 12.0, 200, limit=True)))
def remote_equi_join(spark, sf_dir):
    """The text of a remote catalogue's query with its join, on local copies of its two tables."""
    return _local(spark, sf_dir, adql.JOINED, [_BOX], 2.0, 12.0, top=200).select("id", r(F.col("ra") * (180 / math.pi)).alias("ra"), r("mag").alias("mag"))


@query(_replica(adql.SINGLE, adql.query_text(adql.SINGLE, [_BOX], None, 9.0, 300, limit=True)))
def remote_single_table(spark, sf_dir):
    return _local(spark, sf_dir, adql.SINGLE, [_BOX], None, 9.0, top=300).select("id", r(F.col("ra") * (180 / math.pi)).alias("ra"), r("mag").alias("mag"))


@query(f"WITH {SKY} SELECT count(*) n, min(id) low, max(id) high FROM sky WHERE {_BOX.sql()}")
def box_predicate_text(spark, sf_dir):
    return sky(spark, sf_dir).where(_BOX.sql()).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


# ---- binary catalogues ----------------------------------------------------------------------------------------------

_MAS = lit(binary.MAS)


def _zones(spark, sf_dir):
    from pyspark.sql import Window

    s = sky(spark, sf_dir).withColumn("zone", (F.least(F.floor((F.col("decl") + math.pi / 2) * (900 / math.pi)), F.lit(899)) + 1).cast("int")).withColumn("mag", F.when(F.pmod("id", F.lit(6)) != 0, F.col("mag") + 0.001))
    return s.withColumn("record", F.row_number().over(Window.partitionBy("zone").orderBy("ra", "id")))


_ZONES = f"""z AS (SELECT *, CAST(least(floor((decl + {lit(math.pi / 2)}) * {lit(900 / math.pi)}), 899) AS INTEGER) + 1 AS zone, CASE WHEN id % 6 <> 0 THEN mag + 0.001E0 END m FROM sky),
zr AS (SELECT *, CAST(row_number() OVER (PARTITION BY zone ORDER BY ra, id) AS INTEGER) record FROM z)"""
_UCAC = f"SELECT zone, record, round(floor(ra / {_MAS} + 0.5E0) * {_MAS}, 9) ra, round(floor(m * 1000 + 0.5E0) / 1000, 4) mag FROM zr"


def _ucac(spark, sf_dir) -> DataFrame:
    folder = scratch_path(spark, "ucac4")
    files.write_files(binary.encode_ucac4(_zones(spark, sf_dir)), folder)
    return binary.read_ucac4(spark, folder)


@query(f"WITH {SKY}, {_ZONES} {_UCAC}")
def zone_files(spark, sf_dir):
    """Zone files of 78-byte records, written and read back."""
    return _ucac(spark, sf_dir).select("zone", "record", r("ra", 9).alias("ra"), r("mag", 4).alias("mag"))


@query(f"WITH {SKY}, {_ZONES} SELECT * FROM ({_UCAC}) WHERE zone = 450 AND record = 3")
def zone_record_lookup(spark, sf_dir):
    """One record by zone and number from zones stored as partitions, of which one is read."""
    path = scratch_path(spark, "zones")
    _ucac(spark, sf_dir).write.partitionBy("zone").parquet(path)
    stored = spark.read.parquet(path)
    found = binary.lookup(stored.select("zone", *(c for c in stored.columns if c != "zone")), 450, 3)
    return found.select(F.col("zone").cast("int").alias("zone"), "record", r("ra", 9).alias("ra"), r("mag", 4).alias("mag"))


@query(f"WITH {SKY} SELECT id, round(ra, 9) ra, round(floor(mag * 100 + 0.5E0) / 100, 3) mag, CASE WHEN id % 2 = 0 THEN 'K5' ELSE 'A' END sp_type, 'J2000' epoch_system FROM sky")
def star_list_binary(spark, sf_dir):
    """Records whose layout the file's header names, in either byte order."""
    folder = scratch_path(spark, "sao")
    s = sky(spark, sf_dir).withColumn("sp_type", F.when(F.pmod("id", F.lit(2)) == 0, "K5").otherwise("A")).withColumn("part", F.pmod("id", F.lit(8)).cast("int"))
    files.write_files(binary.encode_sao(s.where("part < 4"), "part"), folder)
    files.write_files(binary.encode_sao(s.where("part >= 4"), "part", big_endian=True), folder)
    return binary.read_sao(spark, folder).select("id", r("ra", 9).alias("ra"), r("mag", 3).alias("mag"), "sp_type", "epoch_system")


def _tiles(spark, sf_dir, tiling) -> str:
    folder = scratch_path(spark, "tiles")
    files.write_files(binary.encode_tiles(sky(spark, sf_dir), tiling), folder)
    return folder


def _tiling_sql(t: binary.Tiling) -> str:
    edges = [-4.0, *t.edges]
    bands = ", ".join(f"({lit(lo)}, {lit(hi)}, {t.cells[i]}, {sum(t.cells[:i])})" for i, (lo, hi) in enumerate(zip(edges, [*edges[1:], 4.0], strict=True)))
    return f"bands(lo, hi, n, before) AS (VALUES {bands}), tiled AS (SELECT s.*, CAST(before + least(floor(ra / {lit(2 * math.pi)} * n), n - 1) + 1 AS INTEGER) area FROM sky s JOIN bands ON decl > lo AND decl <= hi)"


_QRA = f"floor(ra / {lit(2 * math.pi)} * 16777215 + 0.5E0) % 16777215 * {lit(2 * math.pi / 16777215)}"
_QDEC = f"floor(decl / {lit(math.pi / 2)} * 8388607 + 0.5E0) * {lit(math.pi / 2 / 8388607)}"
_QMAG = "floor(mag * 10 + 0.5E0) / 10"


@query(f"WITH {SKY}, {_tiling_sql(binary.TILING_290)} SELECT area, round({_QRA}, 8) ra, round({_QDEC}, 8) decl, round({_QMAG}, 3) mag FROM tiled")
def tiles_290(spark, sf_dir):
    """A star archive in 290 tiles, written and read back whole."""
    t = binary.read_tiles(spark, _tiles(spark, sf_dir, binary.TILING_290), tiling=binary.TILING_290)
    return t.select("area", r("ra", 8).alias("ra"), r("decl", 8).alias("decl"), r("mag", 3).alias("mag"))


_TCONE = region.Cone(83.0 * DEG, -5.0 * DEG, 12.0 * DEG)


@query(f"""WITH {SKY}, {_tiling_sql(binary.TILING_1476)}, q AS (SELECT area, {_QRA} ra, {_QDEC} decl, {_QMAG} mag FROM tiled)
SELECT area, round(ra, 8) ra, round(mag, 3) mag FROM q WHERE 2 * asin(sqrt(least(1, pow(sin((decl - {lit(_TCONE.dec)}) / 2), 2) + cos(decl) * {lit(math.cos(_TCONE.dec))} * pow(sin((ra - {lit(_TCONE.ra)}) / 2), 2)))) <= {lit(_TCONE.radius)}""")
def tiles_1476_cone(spark, sf_dir):
    """A cone over a star archive in 1476 tiles: only the files of the tiles that it touches are read."""
    t = binary.query_tiles(spark, _tiles(spark, sf_dir, binary.TILING_1476), binary.TILING_1476, _TCONE)
    return t.select("area", r("ra", 8).alias("ra"), r("mag", 3).alias("mag"))


@query(f"WITH {SKY}, {_tiling_sql(binary.TILING_290)} SELECT DISTINCT area, 2000.0E0 epoch, 5 AS size FROM tiled")
def tile_headers(spark, sf_dir):
    f = binary.files(spark, _tiles(spark, sf_dir, binary.TILING_290))
    number = F.regexp_extract("path", r"_(\d{4})\.290$", 1).cast("int")
    numbers = F.create_map(*(F.lit(x) for k, name, *_ in binary.TILING_290.areas() for x in (int(name[:4]), k)))
    return f.select(F.element_at(numbers, number).alias("area"), binary.tile_header(F.col("content")).alias("h")).select("area", "h.epoch", "h.size")


def _overlap_sql(t: binary.Tiling, radius: float) -> str:
    bounds = (-math.pi / 2, *t.edges, math.pi / 2)
    bands = ", ".join(f"({lit(bounds[i]) if i else '-9.0E0'}, {lit(bounds[i + 1]) if i + 1 < len(t.cells) else '9.0E0'}, {lit(bounds[i])}, {lit(bounds[i + 1])}, {t.cells[i]}, {sum(t.cells[:i])})" for i in range(len(t.cells)))
    side, tau = lit(2 * radius), lit(2 * math.pi)
    return f"""bands(lo, hi, south, north, n, before) AS (VALUES {bands}), k AS (SELECT i * 2 - 1 i, j * 2 - 1 j FROM range(2) a(i), range(2) b(j)),
    c AS (SELECT id, i, j, decl + j * {lit(radius)} d, ra + i * CASE WHEN abs(cos(decl + j * {lit(radius)})) < 1e-12 THEN 0 ELSE {lit(radius)} / cos(decl + j * {lit(radius)}) END a FROM sky, k),
    w AS (SELECT *, (a - floor(a / {tau}) * {tau}) * n / {tau} cell, abs(d) >= {lit(math.pi / 2)} beyond FROM c JOIN bands ON greatest({lit(-math.pi / 2)}, least({lit(math.pi / 2)}, d)) > lo AND greatest({lit(-math.pi / 2)}, least({lit(math.pi / 2)}, d)) <= hi),
    s AS (SELECT id, CAST(before + least(floor(cell), n - 1) + 1 AS INTEGER) area, least(CASE WHEN n = 1 OR beyond THEN {tau} ELSE cos(d) * {tau} / n * CASE WHEN i = 1 THEN cell - floor(cell) ELSE 1 - (cell - floor(cell)) END END, {side})
      * least(CASE WHEN beyond THEN north - south WHEN j = 1 THEN d - south ELSE north - d END, {side}) / ({side} * {side}) share FROM w)
    SELECT id, area, round(least(1, sum(share)), 5) share FROM s WHERE share >= 0.01 GROUP BY ALL"""


@query(f"WITH {SKY}, {_overlap_sql(binary.TILING_290, 0.01)}")
def overlapping_tiles(spark, sf_dir):
    """The one to four tiles that a square field around each star lies on, with their shares."""
    return binary.TILING_290.overlapping(sky(spark, sf_dir).select("id", "ra", "decl"), 0.01).select("id", "area", r("share", 5).alias("share"))


@query("""SELECT o_orderkey id, CASE WHEN o_orderkey % 2 = 0 THEN 'UCAC4' ELSE 'TYC' END catalogue, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 900 ELSE o_orderkey % 9537 END AS INTEGER) region, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1000000 ELSE o_orderkey % 12121 END AS INTEGER) star,
CAST(CASE WHEN o_orderkey % 2 = 1 THEN 1 + o_orderkey % 3 END AS INTEGER) component FROM orders""")
def packed_designations(spark, sf_dir):
    k = F.col("k")
    m = lambda n: F.pmod(k, F.lit(n))
    ucac = F.shiftleft(m(900), 20).bitwiseOR(m(1000000))
    d = binary.decode_designation(F.when(m(2) == 0, ucac).otherwise(binary.pack_tycho(m(9537), m(12121), 1 + m(3))))
    return _orders(spark, sf_dir).select(k.alias("id"), d.alias("d")).select("id", "d.catalogue", "d.region", "d.star", "d.component")


# ---- images ---------------------------------------------------------------------------------------------------------


def _images(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("frame", "x", "y", "c").agg(F.avg("value").alias("value"))


_IMAGE = """u AS (SELECT CAST(l_suppkey % 30 AS INTEGER) frame, CAST(l_orderkey % 40 AS INTEGER) x, CAST(l_partkey % 25 AS INTEGER) y, CAST(l_linenumber % 2 AS INTEGER) c, avg(l_extendedprice / 99991.0E0) AS value FROM lineitem GROUP BY ALL)"""


def _read_back(spark, sf_dir, suffix: str, encode, read) -> DataFrame:
    folder = scratch_path(spark, suffix)
    files.write_files(binary.images_of(_images(spark, sf_dir), "frame", encode, suffix), folder)
    p = binary.explode_pixels(read(spark, folder)).where("value != 0")
    return p.select(F.regexp_extract("path", rf"image(\d+)\.{suffix}$", 1).cast("int").alias("frame"), "x", "y", "c", r("value").alias("value"))


@query(f"WITH {_IMAGE} SELECT frame, x, y, c, round(value, 6) AS value FROM u WHERE value <> 0")
def fits_round_trip(spark, sf_dir):
    """Frames written as FITS files by the tasks and read back as pixels."""
    return _read_back(spark, sf_dir, "fits", None, binary.read_fits)


@query(f"WITH {_IMAGE} SELECT frame, x, y, c, round(value, 6) AS value FROM u WHERE value <> 0")
def xisf_round_trip(spark, sf_dir):
    return _read_back(spark, sf_dir, "xisf", lambda planes: binary.encode_xisf(planes, "Float64", True, True), binary.read_xisf)


@query("SELECT CAST(o_orderkey AS BIGINT) id, round(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 ELSE o_orderkey % 60 END + 0.5E0, 3) exposure, 'M' || (o_orderkey % 110) AS object, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END AS INTEGER) bin FROM orders")
def header_keywords(spark, sf_dir):
    """Typed values of the first of several keywords that a header has."""
    m = lambda n: F.pmod("k", F.lit(n))
    h = F.map_filter(F.map_from_arrays(F.array(F.lit("EXPTIME"), F.lit("EXPOSURE"), F.lit("OBJECT"), F.lit("XBINNING")), F.array(F.when(m(3) == 0, (m(100) + 0.5).cast("string")), (m(60) + 0.5).cast("string"), F.concat(F.lit("M"), m(110).cast("string")), F.when(m(2) == 0, m(4).cast("string")).otherwise("none"))), lambda _, v: v.isNotNull())
    o = _orders(spark, sf_dir).select(F.col("k").alias("id"), h.alias("header"))
    return o.select("id", r(binary.keyword("header", ["EXPTIME", "EXPOSURE"]), 3).alias("exposure"), binary.keyword("header", ["TITLE", "OBJECT"], "string").alias("object"), binary.keyword("header", ["XBINNING"], "int").alias("bin"))


@query("SELECT o_orderkey id, CASE o_orderkey % 4 WHEN 0 THEN 'fits' WHEN 1 THEN 'xisf' WHEN 2 THEN 'jpeg' END kind FROM orders")
def image_kinds(spark, sf_dir):
    m = F.pmod("k", F.lit(4))
    head = F.when(m == 0, F.lit("SIMPLE  =").cast("binary")).when(m == 1, F.lit("XISF0100x").cast("binary")).when(m == 2, F.to_binary(F.lit("FFD8FFE000"), F.lit("hex"))).otherwise(F.lit("plain").cast("binary"))
    return _orders(spark, sf_dir).select(F.col("k").alias("id"), binary.image_kind(head).alias("kind"))


# ---- codecs ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(coalesce(text, '')) digest, CAST(strlen(coalesce(text, '')) AS BIGINT) n FROM documents")
def deflate_round_trip(spark, sf_dir):
    """Texts deflated and expanded again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    x = binary.inflate(binary.deflate("b"))
    return d.select("doc_id", x.alias("x")).select("doc_id", F.md5("x").alias("digest"), F.octet_length("x").cast("long").alias("n"))


@query("SELECT doc_id, base64(CAST(encode(substr(coalesce(text, ''), 1, 30)) AS BLOB)) code, md5(coalesce(text, '')) digest FROM documents")
def base64_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.regexp_replace(files.to_base64(F.substring("t", 1, 30).cast("binary")), r"\s", "").alias("code"), F.md5(files.from_base64(files.to_base64(F.col("t").cast("binary")))).alias("digest"))


@query("SELECT CAST(o_custkey AS BIGINT) cust, list_sum(v) total, len(v) n, round(list_avg(v), 4) mean FROM (SELECT o_custkey, list(CAST(o_orderkey % 30000 AS BIGINT) ORDER BY o_orderkey) v FROM orders GROUP BY 1)".replace("list_sum(v) total", "CAST(list_sum(v) AS BIGINT) total"))
def rice_round_trip(spark, sf_dir):
    """Series of integers Rice coded and decoded."""
    g = _orders(spark, sf_dir).groupBy(F.col("c").alias("cust")).agg(F.array_sort(F.collect_list("k")).alias("l"))
    g = g.select("cust", F.transform("l", lambda x: F.pmod(x, F.lit(30000))).alias("v"))
    d = g.select("cust", binary.unrice_column(binary.rice_column(F.col("v")), F.size("v")).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("cust", total.alias("total"), F.size("v").cast("long").alias("n"), r(total / F.size("v"), 4).alias("mean"))


def _crc_sql(width: int, poly: int, init: int) -> str:
    """A checksum over the bytes of a text, high bit first, by folding eight steps a byte."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    step = f"CASE WHEN (x & {top}) <> 0 THEN xor((x << 1) & {mask}, {poly}) ELSE (x << 1) & {mask} END"
    byte = f"list_reduce(list_prepend(xor(a, b << {width - 8}), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: {step})"
    return f"list_reduce(list_prepend(CAST({init} AS BIGINT), list_transform(string_split(CAST(t AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: {byte})"


@query(f"SELECT id, {_crc_sql(16, 0x1021, 0xFFFF)} ccitt, {_crc_sql(8, 7, 0)} crc8 FROM (SELECT o_orderkey id, 'order ' || o_orderkey || '/' || o_custkey t FROM orders)")
def checksums(spark, sf_dir):
    b = F.concat(F.lit("order "), F.col("k").cast("string"), F.lit("/"), F.col("c").cast("string")).cast("binary")
    return _orders(spark, sf_dir).select(F.col("k").alias("id"), binary.crc_column(b, "CRC-16/CCITT-FALSE").alias("ccitt"), binary.crc_column(b, "CRC-8").alias("crc8"))


@query("""SELECT 'dev' || (event_id % 9) device, 'P' || event_id property, CASE WHEN event_id % 2 = 0 THEN 'Ok' ELSE 'Busy' END state, CAST(round(value, 2) AS DECIMAL(18, 2)) AS value FROM events""")
def property_messages(spark, sf_dir):
    """Instrument messages in XML, parsed to their elements."""
    e = table(spark, sf_dir, "events")
    v = F.round("value", 2).cast("decimal(18,2)").cast("string")
    state = F.when(F.pmod("event_id", F.lit(2)) == 0, "Ok").otherwise("Busy")
    xml = F.concat(F.lit('<setNumberVector device="dev'), F.pmod("event_id", F.lit(9)).cast("string"), F.lit('" name="P'), F.col("event_id").cast("string"), F.lit('" state="'), state, F.lit('"><oneNumber name="X">\n '), v, F.lit(' </oneNumber><oneNumber name="Y">1</oneNumber></setNumberVector>'))
    p = frames.properties(e.select(xml.alias("value")))
    return p.select("device", "property", "state", F.element_at("elements", "X").cast("decimal(18,2)").alias("value"))


@query("""SELECT CAST(l_suppkey % 10 AS INTEGER) target, l_orderkey id, l_linenumber line, round((t + 2 * (l_partkey % 7) * t * t - (l_partkey % 7)) * 0.99712345E0, 7) + 0.0E0 x, round((1 + 4 * (l_partkey % 7) * t) * 0.0142469135E0, 7) + 0.0E0 vx FROM (SELECT *, (l_extendedprice - 100000 * floor(l_extendedprice / 100000)) / 50000.0E0 - 1 t FROM lineitem)""")
def kernel_segments(spark, sf_dir):
    """Positions and rates of Chebyshev records at times within them."""
    t = table(spark, sf_dir, "lineitem")
    s = (F.col("l_extendedprice") - F.floor(F.col("l_extendedprice") / 100000) * 100000) / 1000.0
    a = F.pmod("l_partkey", F.lit(7)).cast("double")
    zero = F.lit(0.0)
    state = binary.chebyshev_state(s, F.lit(2), F.lit(50.0), F.lit(50.0), F.array(zero, F.lit(1.0), a, zero, zero, zero, zero, zero, zero))
    d = t.select(F.pmod("l_suppkey", F.lit(10)).cast("int").alias("target"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), state.alias("s"))
    return d.select("target", "id", "line", r(F.col("s")[0] * 0.99712345, 7).alias("x"), r(F.col("s")[3] * 0.712345675, 7).alias("vx"))
