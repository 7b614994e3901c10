"""Delimited and fixed-width text: CSV variants, orbital elements, Earth orientation, two-line elements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEG = math.pi / 180


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str | None = '"', comment: str = "#", header: bool = True, trim: bool = True, schema: str | None = None, stream: bool = False) -> DataFrame:
    """CSV or TSV as strings (or a schema): quotes doubled inside quotes, newlines within them, comments and blank lines
    skipped. A stream, which needs a schema, takes files as they come."""
    r = (spark.readStream if stream else spark.read).option("sep", delimiter).option("quote", quote or "").option("escape", quote or "\\").option("comment", comment).option("header", header).option("multiLine", True)
    r = r.option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).option("mode", "PERMISSIVE")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.select(*(F.trim(c).alias(c) if trim and t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def parse_line(line, schema: str, delimiter: str = ",", quote: str = '"', force_trim: bool = False) -> Column:
    """A line's fields as a struct of text columns; padding within quotes stays unless `force_trim`."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    row = F.from_csv(line, schema, {"sep": delimiter, "quote": quote, "escape": quote, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return F.struct(*(F.trim(row[n]).alias(n) for n in names)) if force_trim else row


def read_lines(spark: SparkSession, path: str, trim: bool = True, keep_empty: bool = False) -> DataFrame:
    df = spark.read.text(path)
    df = df.select(F.trim("value").alias("value")) if trim else df
    return df if keep_empty else df.where(F.col("value") != "")


def split_any(line: str, delimiters: str) -> Column:
    """Fields of a line parted by any of several delimiters."""
    return F.split(F.col(line), "[" + "".join(f"\\{d}" if not d.isalnum() else d for d in delimiters) + "]")


def _cut(start: int, end: int, value: str = "value") -> Column:
    """Trimmed text of columns start to end, counted from 1; null if blank."""
    t = F.trim(F.substring(value, start, end - start + 1))
    return F.when(t != "", t)


def _num(start: int, end: int) -> Column:
    return _cut(start, end).try_cast("double")


#: Digits of packed dates and numbers: 0-9, A-Z, a-z.
_PACKED = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _digit(c: Column) -> Column:
    return F.instr(F.lit(_PACKED), c) - 1


def unpack_date(packed: str | Column) -> Column:
    """The date of a packed epoch such as K24BM; null if it is none."""
    p = F.col(packed) if isinstance(packed, str) else packed
    year = _digit(F.substring(p, 1, 1)) * 100 + F.substring(p, 2, 2).try_cast("int")
    month, day = _digit(F.substring(p, 4, 1)), _digit(F.substring(p, 5, 1))
    ok = F.substring(p, 1, 1).isin("I", "J", "K") & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def pack_date(date: str) -> Column:
    d = F.col(date)
    at = lambda n: F.substring(F.lit(_PACKED), n + 1, 1)
    return F.concat(at(F.floor(F.year(d) / 100).cast("int")), F.lpad(F.pmod(F.year(d), F.lit(100)).cast("string"), 2, "0"), at(F.month(d)), at(F.dayofmonth(d)))


def minor_planets(lines: DataFrame) -> DataFrame:
    """Minor-planet elements of fixed-width lines in column `value`; angles in radians. Lines without an orbit go."""
    out = lines.select(
        _cut(1, 7).alias("designation"), _num(9, 13).alias("h"), _num(15, 19).alias("g"), unpack_date(F.substring("value", 21, 5)).alias("epoch"),
        *((_num(a, b) * DEG).alias(n) for a, b, n in ((27, 35, "mean_anomaly"), (38, 46, "argument"), (49, 57, "node"), (60, 68, "inclination"))),
        _num(71, 79).alias("eccentricity"), (_num(81, 91) * DEG).alias("mean_motion"), _num(93, 103).alias("semi_major_axis"), _cut(106, 106).alias("uncertainty"),
        _num(118, 122).cast("int").alias("observations"), _num(124, 126).cast("int").alias("oppositions"), _cut(167, 194).alias("name"),
    )
    return out.where(F.col("semi_major_axis").isNotNull() & F.col("eccentricity").isNotNull())


def comets(lines: DataFrame) -> DataFrame:
    """Comet elements of fixed-width lines in column `value`; angles in radians. Rows with an unknown orbit type go."""
    out = lines.select(
        _num(1, 4).cast("int").alias("number"), F.substring("value", 5, 1).alias("orbit_type"), _cut(6, 12).alias("designation"), _num(15, 18).cast("int").alias("year"), _num(20, 21).cast("int").alias("month"), _num(23, 29).alias("day"),
        _num(31, 39).alias("perihelion"), _num(42, 49).alias("eccentricity"), *((_num(a, b) * DEG).alias(n) for a, b, n in ((52, 59, "argument"), (62, 69, "node"), (72, 79, "inclination"))),
        _num(92, 95).alias("h"), _num(97, 100).alias("g"), _cut(103, 158).alias("name"),
    )
    return out.where(F.col("orbit_type").isin(*"CPDXIA") & F.col("perihelion").isNotNull())


def earth_orientation_a(lines: DataFrame) -> DataFrame:
    """(mjd, pm_x, pm_y, ut1_utc) of finals2000A lines: Bulletin B values where given, else A; angles in radians."""
    s = math.pi / 648000
    out = lines.select(_num(8, 15).alias("mjd"), (F.coalesce(_num(135, 144), _num(19, 27)) * s).alias("pm_x"), (F.coalesce(_num(145, 154), _num(38, 46)) * s).alias("pm_y"), F.coalesce(_num(155, 165), _num(59, 68)).alias("ut1_utc"))
    return out.dropna()


def earth_orientation_b(lines: DataFrame) -> DataFrame:
    """(mjd, pm_x, pm_y, ut1_utc) of C04 lines: blank-parted year, month, day, hour, mjd, x, y, ut1-utc; # comments."""
    s, f = math.pi / 648000, F.split(F.trim("value"), r"\s+")
    body = lines.where(~F.col("value").startswith("#")).select(*(F.get(f, F.lit(i)).try_cast("double").alias(n) for i, n in ((4, "mjd"), (5, "pm_x"), (6, "pm_y"), (7, "ut1_utc"))))
    return body.withColumns({"pm_x": F.col("pm_x") * s, "pm_y": F.col("pm_y") * s}).dropna()


def _implied(start: int, end: int, line: str) -> Column:
    """A number such as -12345-3, a mantissa without its point and a power of ten."""
    t = F.trim(F.substring(line, start, end - start + 1))
    m = F.regexp_extract(t, r"^([+-]?)(\d+)([+-]\d)$", 2)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    return F.when(m != "", sign * F.concat(F.lit("0."), m).try_cast("double") * F.pow(F.lit(10.0), F.regexp_extract(t, r"([+-]\d)$", 1).try_cast("int")))


def two_line_elements(df: DataFrame, line1: str = "line1", line2: str = "line2") -> DataFrame:
    """Two-line element sets as typed columns: angles in radians, mean motion in radians a minute, epoch as a timestamp."""

    def num(line: str, a: int, b: int) -> Column:
        return F.trim(F.substring(line, a, b - a + 1)).try_cast("double")

    yy = num(line1, 19, 20).cast("int")
    year = F.when(yy < 57, yy + 2000).otherwise(yy + 1900)
    micros = F.round((num(line1, 21, 32) - 1) * 86400e6).cast("long")
    epoch = F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=(micros / 1e6).cast("decimal(18,6)"))
    return df.select(
        "*", num(line1, 3, 7).cast("int").alias("satellite"), epoch.alias("epoch"), _implied(54, 61, line1).alias("bstar"), (num(line2, 9, 16) * DEG).alias("inclination"), (num(line2, 18, 25) * DEG).alias("node"),
        F.concat(F.lit("0."), F.trim(F.substring(line2, 27, 7))).try_cast("double").alias("eccentricity"), (num(line2, 35, 42) * DEG).alias("argument"), (num(line2, 44, 51) * DEG).alias("mean_anomaly"), (num(line2, 53, 63) * (2 * math.pi / 1440)).alias("mean_motion"),
    )


def close_approaches(df: DataFrame, json: str = "value") -> DataFrame:
    """Rows of a service's JSON {fields: [..], data: [[..], ..]}: one map of field to text for each."""
    doc = F.from_json(F.col(json), "count string, fields array<string>, data array<array<string>>")
    return df.select(doc.alias("d")).select(F.col("d.fields").alias("f"), F.explode("d.data").alias("v")).select(F.map_from_arrays("f", "v").alias("row"))


def ephemeris_table(text: Column) -> Column:
    """The rows between the $$SOE and $$EOE marks of a service's text, as an array of lines."""
    body = F.regexp_extract(text, r"(?s)\$\$SOE\s*\n(.*?)\$\$EOE", 1)
    return F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")


def star_catalogue(df: DataFrame) -> DataFrame:
    """A star list in CSV columns (id, hip, hd, hr, ra in hours, dec, pmra, pmdec, rv, mag, dist) as the common schema.

    Angles are radians; proper motion in right ascension is divided by cos dec, 0 at the poles; a missing magnitude is null.
    """
    ra, dec = F.col("ra").try_cast("double") * (15 * DEG), F.col("dec").try_cast("double") * DEG
    mas = DEG / 3600000
    pm_ra = F.when(F.abs(F.cos(dec)) > 1e-9, F.col("pmra").try_cast("double") * mas / F.cos(dec)).otherwise(0.0)
    ints = [F.col(c).try_cast("int").alias(c) for c in ("id", "hip", "hd", "hr") if c in df.columns]
    return df.select(*ints, ra.alias("ra"), dec.alias("decl"), pm_ra.alias("pm_ra"), (F.col("pmdec").try_cast("double") * mas).alias("pm_dec"), F.col("rv").try_cast("double").alias("rv"), F.col("mag").try_cast("double").alias("mag"), F.col("dist").try_cast("double").alias("distance"), F.lit(2000.0).alias("epoch"))


def mean_elements(df: DataFrame, json: str = "value") -> DataFrame:
    """Orbit mean-elements messages in JSON as the columns that `two_line_elements` gives."""
    m = F.from_json(F.col(json), "NORAD_CAT_ID string, EPOCH string, BSTAR string, INCLINATION string, RA_OF_ASC_NODE string, ECCENTRICITY string, ARG_OF_PERICENTER string, MEAN_ANOMALY string, MEAN_MOTION string")
    num = lambda n: F.col(f"_m.{n}").try_cast("double")
    return df.withColumn("_m", m).select(
        *df.columns, F.col("_m.NORAD_CAT_ID").try_cast("int").alias("satellite"), F.col("_m.EPOCH").try_cast("timestamp_ntz").alias("epoch"), num("BSTAR").alias("bstar"), *((num(n) * DEG).alias(a) for n, a in (("INCLINATION", "inclination"), ("RA_OF_ASC_NODE", "node"))),
        num("ECCENTRICITY").alias("eccentricity"), *((num(n) * DEG).alias(a) for n, a in (("ARG_OF_PERICENTER", "argument"), ("MEAN_ANOMALY", "mean_anomaly"))), (num("MEAN_MOTION") * (2 * math.pi / 1440)).alias("mean_motion"),
    )


def canonical_designation(value) -> Column:
    """A designation in capitals with single blanks and none at its ends."""
    return F.upper(F.regexp_replace(F.trim(value), r"\s+", " "))


def designation_kind(value) -> Column:
    """numbered, provisional, comet, survey or name, by the shape of a canonical designation."""
    d = canonical_designation(value)
    return (
        F.when(d.rlike(r"^\(?\d+\)?$"), "numbered").when(d.rlike(r"^\d+[PDI](-[A-Z]+)?$|^[PCDXAI]/\d{4} [A-Z]\d+(-[A-Z]+)?$"), "comet")
        .when(d.rlike(r"^\d{4} (P-L|T-[123])$"), "survey").when(d.rlike(r"^\d{4} [A-Z]{2}\d*$"), "provisional").otherwise("name")
    )


def fragment_of(candidate, parent) -> Column:
    """Whether a designation names a fragment of another: the parent's, a hyphen, and letters."""
    c, p = canonical_designation(candidate), canonical_designation(parent)
    return c.startswith(F.concat(p, F.lit("-"))) & F.substr(c, F.char_length(p) + 2).rlike("^[A-Z]+[0-9]*$")
