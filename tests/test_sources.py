import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from vesperflow.plans import source_queries
from vesperflow.sources import binary as b
from vesperflow.sources import text as t

D = math.pi / 180


def put(tmp_path, name, data):
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{tmp_path}/{name}"


def test_csv_variants(spark, tmp_path):
    p = put(tmp_path, "a.csv", '# note\nHIP,RA,NAME\n1,"00 00 00.22","a ""b"""\n\n2, 00 00 00.91 ,"two\nlines"\n')
    assert [tuple(r) for r in t.read_csv(spark, p).collect()] == [("1", "00 00 00.22", 'a "b"'), ("2", "00 00 00.91", "two\nlines")]
    p = put(tmp_path, "a.tsv", "x\ty\n1\t\n")
    assert [tuple(r) for r in t.read_csv(spark, p, delimiter="\t").collect()] == [("1", None)]
    assert [r.f for r in spark.createDataFrame([("a;b|c",)], "l string").select(t.split_any("l", ";|").alias("f")).collect()] == [["a", "b", "c"]]


def test_packed_dates(spark):
    df = spark.createDataFrame([("K24BM",), ("J9611",), ("I01A1",), ("X24BM",), ("K24ZZ",), ("K2422",)], "p string").select("p", t.unpack_date("p").alias("d"))
    got = {r.p: str(r.d) for r in df.collect()}
    assert got == {"K24BM": "2024-11-22", "J9611": "1996-01-01", "I01A1": "1801-10-01", "X24BM": "None", "K24ZZ": "None", "K2422": "2024-02-02"}
    assert all(r.p == r.q for r in df.where("d IS NOT NULL").select("p", t.pack_date("d").alias("q")).collect())


def test_fixed_width_elements(spark):
    line = list(" " * 202)

    def at(a, s):
        line[a - 1 : a - 1 + len(s)] = s

    for a, s in ((1, "00001"), (9, " 3.33"), (15, " 0.15"), (21, "K24BM"), (27, " 60.07881"), (38, " 73.42179"), (49, " 80.25496"), (60, " 10.58688"), (71, "0.0789125"), (81, " 0.21406048"), (93, "  2.7672543"), (106, "0"), (118, "  7283"), (167, "(1) Ceres")):
        at(a, s)
    df = spark.createDataFrame([("".join(line),), ("",), ("header text",)], "value string")
    r = t.minor_planets(df).collect()
    assert len(r) == 1 and r[0].designation == "00001" and r[0].name == "(1) Ceres" and abs(r[0].inclination - 10.58688 * D) < 1e-12 and r[0].semi_major_axis == 2.7672543 and str(r[0].epoch) == "2024-11-22"
    line = list(" " * 168)
    for a, s in ((1, "0001"), (5, "P"), (15, "1986"), (20, "02"), (23, "05.8895"), (31, " 0.574706"), (42, "0.967906"), (52, "112.2572"), (62, " 58.4201"), (72, "162.2627"), (92, " 4.0"), (97, " 6.0"), (103, "1P/Halley")):
        at(a, s)
    r = t.comets(spark.createDataFrame([("".join(line),)], "value string")).first()
    assert (r.number, r.orbit_type, r.year, r.perihelion, r.name) == (1, "P", 1986, 0.574706, "1P/Halley")


def test_earth_orientation_files(spark):
    line = list(" " * 190)
    for a, s in ((8, "41684.00"), (19, " 0.120733"), (38, " 0.136966"), (59, " 0.8084178"), (155, "  0.8075000")):
        line[a - 1 : a - 1 + len(s)] = s
    r = t.earth_orientation_a(spark.createDataFrame([("".join(line),), (" " * 190,)], "value string")).collect()
    assert len(r) == 1 and r[0].ut1_utc == 0.8075 and abs(r[0].pm_x - 0.120733 / 206264.806247) < 1e-12
    r = t.earth_orientation_b(spark.createDataFrame([("# head",), ("1962 1 1 0 37665.00 -0.012700 0.213000 0.0326338",)], "value string")).collect()
    assert len(r) == 1 and r[0].mjd == 37665 and r[0].ut1_utc == 0.0326338


def test_two_line_elements(spark):
    l1 = "1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927"
    l2 = "2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537"
    r = t.two_line_elements(spark.createDataFrame([(l1, l2)], "line1 string, line2 string")).first()
    assert r.satellite == 25544 and str(r.epoch).startswith("2008-09-20 12:25:40.104") and abs(r.bstar + 0.11606e-4) < 1e-12 and r.eccentricity == 0.0006703 and abs(r.mean_motion - 15.72125391 * 2 * math.pi / 1440) < 1e-10


def test_service_texts(spark):
    df = spark.createDataFrame([('{"count":"1","fields":["des","dist"],"data":[["99942","0.1"],["1","2"]]}',)], "value string")
    assert [r.row for r in t.close_approaches(df).collect()] == [{"des": "99942", "dist": "0.1"}, {"des": "1", "dist": "2"}]
    e = spark.createDataFrame([("head\n$$SOE\n 1, 2\n 3, 4\n$$EOE\ntail",)], "v string").select(t.ephemeris_table(F.col("v")).alias("l")).first()
    assert e.l == [" 1, 2", " 3, 4"]
    s = spark.createDataFrame([("1", "6.0", "90", "10", "", "1.5")], "id string, ra string, dec string, pmra string, mag string, rv string").selectExpr("*", "'5' AS pmdec", "'10' AS dist")
    r = t.star_catalogue(s).first()
    assert abs(r.ra - math.pi / 2) < 1e-12 and r.pm_ra == 0.0 and r.mag is None


def test_ucac4_zones(spark, tmp_path):
    a = np.zeros(3, b.UCAC4)
    a["ra"], a["spd"] = [1000, 0, 3600000], [324000000, 324001000, 324002000]
    a["aperture_mag"], a["model_mag"], a["j_mag"] = [12000, 20000, 20000], [11000, 13500, 20000], [9000, 9000, 20000]
    a["pm_ra"], a["pm_dec"] = [100, 32767, -50], [-20, 0, 10]
    put(tmp_path, "z451", a.tobytes() + b"\0" * 10)
    r = b.read_ucac4(spark, f"file://{tmp_path}").orderBy("record").collect()
    assert [(x.zone, x.record, x.mag) for x in r] == [(451, 1, 12.0), (451, 2, 13.5), (451, 3, None)]
    assert r[1].pm_ra is None and abs(r[0].decl) < 1e-12 and abs(r[0].pm_dec + 20 * b.MAS / 10) < 1e-18


def test_sao_either_byte_order(spark, tmp_path):
    for e in "<>":
        rec = np.zeros(2, np.dtype([("ra", f"{e}f8"), ("decl", f"{e}f8"), ("type", "S2"), ("mag0", f"{e}i2"), ("pm_ra", f"{e}f4"), ("pm_dec", f"{e}f4")]))
        rec["ra"], rec["decl"], rec["type"], rec["mag0"] = [1.0, 2.0], [0.5, -0.5], [b"A0", b"K"], [720, 810]
        head = struct.pack(f"{e}7i", 0, 1, 3, 0, 1, 1, rec.itemsize)
        p = put(tmp_path, f"sao{ord(e)}", head + rec.tobytes() + b"\1\2")
        r = b.read_sao(spark, p).orderBy("id").collect()
        assert [(x.id, x.ra, x.mag, x.sp_type, x.epoch_system) for x in r] == [(1, 1.0, 7.2, "A0", "B1950"), (2, 2.0, 8.1, "K", "B1950")]


def test_tiles_carry_their_sections(spark, tmp_path):
    def rec(ra, *rest):
        return bytes([ra & 255, ra >> 8 & 255, ra >> 16, *rest])

    body = rec(0xFFFFFF, 128 + 1, 16 + 105) + rec(1000, 10, 1) + rec(2000, 20, 0) + rec(0xFFFFFF, 128 - 1, 16 + 110) + rec(3000, 0, 0)
    p = put(tmp_path, "d50_0101.290", b" " * 109 + bytes([5]) + body)
    r = b.read_tiles(spark, p).orderBy("record").collect()
    k = math.pi / 2 / (128 * 65536 - 1)
    assert [round(x.mag, 6) for x in r] == [10.5, 10.5, 11.0] and abs(r[0].decl - (65536 + 266) * k) < 1e-12 and abs(r[2].decl + 65536 * k) < 1e-12


def test_fits_round_trip_and_pixels(spark, tmp_path):
    planes = np.arange(24, dtype=float).reshape(3, 2, 4)
    for bitpix in (8, 16, 32, -32, -64):
        p = put(tmp_path, f"i{bitpix}.fits", b.encode_fits(planes, bitpix, {"OBJECT": "M'42", "EXPTIME": 30.5}))
        r = b.read_fits(spark, p)
        x = r.first()
        assert (x.width, x.height, x.channels) == (4, 2, 3) and np.array_equal(np.array(x.pixels).reshape(2, 4, 3).transpose(2, 0, 1), planes) and x.header["OBJECT"] == "M'42"
    assert r.select(b.keyword("header", ["EXPOSURE", "EXPTIME"]).alias("e")).first().e == 30.5
    e = {(q.x, q.y, q.c): q.value for q in b.explode_pixels(r).collect()}
    assert e[3, 1, 2] == planes[2, 1, 3] and len(e) == 24
    scaled = b.encode_fits(planes[:1] / 2, 16, {"BSCALE": 0.5, "BZERO": 1.0})
    assert b.decode_fits("x", scaled).pixels[0][:3] == [1.0, 1.0, 1.5]
    assert spark.createDataFrame([(bytearray(b.encode_fits(planes)),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"XISF0100"),), (bytearray(b"x"),)], "c binary").select(b.image_kind(F.col("c")).alias("k")).collect() == [("fits",), ("jpeg",), ("xisf",), (None,)]


def test_spk_segments(spark, tmp_path):
    coefficients = [[1.0, 2.0, 0.5], [0.0, 1.0, 0.0], [3.0, 0.0, 0.0]]
    records = [[50.0 + 100 * i, 50.0, *(c for row in coefficients for c in row)] for i in range(2)]
    data = [x for r in records for x in r] + [0.0, 100.0, 11.0, 2.0]
    head = bytearray(1024)
    struct.pack_into("<8sii", head, 0, b"DAF/SPK ", 2, 6)
    struct.pack_into("<iii", head, 76, 2, 2, 513)
    head[88:96] = b"LTL-IEEE"
    summary = bytearray(1024)
    struct.pack_into("<3d2d6i", summary, 0, 0.0, 0.0, 1.0, 0.0, 200.0, 399, 10, 1, 2, 385, 384 + len(data))
    content = bytes(head) + bytes(summary) + b" " * 1024 + np.array(data, "<f8").tobytes()
    p = put(tmp_path, "a.bsp", content)
    k = b.read_spk(spark, p)
    assert k.count() == 2
    r = k.where("start <= 75 AND 75 < end").select(b.chebyshev_state(F.lit(75.0), "kind", "mid", "radius", "coefficients").alias("s")).first()
    assert np.allclose(r.s, [1 + 2 * 0.5 + 0.5 * (2 * 0.25 - 1), 0.5, 3.0, (2 + 0.5 * 4 * 0.5) / 50, 1 / 50, 0.0])


def test_checksums_and_codecs(spark):
    check = b"123456789"
    want = {"CRC-16/ARC": 0xBB3D, "CRC-16/CCITT-FALSE": 0x29B1, "CRC-16/MODBUS": 0x4B37, "CRC-8": 0xF4, "CRC-32": 0xCBF43926}
    df = spark.createDataFrame([(bytearray(check),)], "b binary")
    assert {n: df.select(b.crc_column(F.col("b"), n).alias("c")).first().c for n in want} == want
    r = df.select(b.inflate(b.deflate("b")).alias("x")).first()
    assert bytes(r.x) == check and b.inflate.func is not None and zlib.crc32(check) == want["CRC-32"]


def test_checksum_tables_are_made_once():
    b._crc_table.cache_clear()
    for i in range(100):
        data = b"order %d" % i
        for p in b.CRCS.values():
            assert b.crc_by_table(data, *p) == b.crc(data, *p)
    made = b._crc_table.cache_info()
    assert made.misses == len({(width, poly, reflect) for width, poly, _, reflect, _, _ in b.CRCS.values()}) and made.hits == 500 - made.misses


def test_tycho_designation_of_zero_bits(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 0, 3), (9536, 12120, 1)], "r long, s long, c long")
    packed = df.select(b.pack_tycho(F.col("r"), F.col("s"), F.col("c")).cast("int").alias("v"))  # as records hold it
    assert [tuple(r.d) for r in packed.select(b.decode_designation("v").alias("d")).collect()] == [("TYC", 0, 0, 1), ("TYC", 0, 0, 2), ("TYC", 0, 0, 3), ("TYC", 9536, 12120, 1)]
    # the order of the driver's 60-fold tables that packs to zero bits
    spark.createDataFrame([(6799881, 1, 2.0), (6799880, 1, 2.0)], "o_orderkey long, o_custkey long, o_totalprice double").selectExpr("*", "timestamp'2024-01-01' o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = source_queries.packed_designations(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(6799880, "UCAC4", 380, 799880, None), (6799881, "TYC", 0, 0, 1)]


def test_xisf_round_trip(spark, tmp_path):
    planes = np.arange(24, dtype=float).reshape(3, 2, 4)
    for k, (sample, compress, shuffle) in enumerate([("Float32", False, False), ("UInt16", True, False), ("Float64", True, True)]):
        p = put(tmp_path, f"{k}.xisf", b.encode_xisf(planes, sample, compress, shuffle, {"OBJECT": "M42"}))
        r = b.read_xisf(spark, p).first()
        assert (r.width, r.height, r.channels) == (4, 2, 3) and np.array_equal(np.array(r.pixels).reshape(2, 4, 3).transpose(2, 0, 1), planes) and r.header == {"OBJECT": "M42"}


def test_rice_round_trip():
    rng = np.random.default_rng(2)
    for size in (1, 2, 4):
        top = 1 << (size * 8 - (size > 1))
        low = -top if size > 1 else 0
        for v in (np.zeros(40, int), np.arange(100) % (256 if size == 1 else 1000), rng.integers(low, top, 77), rng.normal(100, 3, 500).astype(int), np.array([5])):
            assert (b.rice_decode(b.rice_encode(v, size), len(v), size) == v).all()
    v = rng.normal(1000, 4, 4000).astype(int)
    assert len(b.rice_encode(v, 2)) < 4000  # below half of the plain size
    assert len(b.rice_decode(b"", 0)) == 0
