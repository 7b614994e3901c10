"""Binary formats: packed star catalogues, FITS, SPK kernels and images, read with `binaryFile` and decoded in batches.

Each reader lists its files through Spark, so any file system Spark reads will do; a file is one row and is decoded by
one task into many.
"""

from __future__ import annotations

import functools
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAS = math.pi / 648000000
TAU = 2 * math.pi


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")


def _decode(df: DataFrame, decode, schema: str, rows: int = 1 << 16) -> DataFrame:
    """Rows of `decode(path, content)`, a DataFrame, handed on in portions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                out = decode(path, bytes(content))
                for i in range(0, len(out), rows):
                    yield out.iloc[i : i + rows]

    return df.mapInPandas(run, schema)


def _encode(df: DataFrame, by: str, encode, name: str) -> DataFrame:
    """(name, content) of one file for each value of `by`: `encode(rows)` gives a group's bytes, `name` formats its key."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [name.format(p[by].iloc[0])], "content": [encode(p)]})

    return df.groupBy(by).applyInPandas(run, "name string, content binary")


# ---- UCAC4 zones: 78-byte little-endian records, the zone in the file's name ---------------------------------------

UCAC4 = np.dtype(
    [("ra", "<i4"), ("spd", "<i4"), ("model_mag", "<i2"), ("aperture_mag", "<i2"), ("mag_error", "i1"), ("object_type", "i1"), ("double_star", "i1"), ("ra_error", "i1"), ("dec_error", "i1"), ("n_images", "u1"), ("n_used", "u1"), ("n_motion", "u1"), ("ra_epoch", "<u2"), ("dec_epoch", "<u2"),
     ("pm_ra", "<i2"), ("pm_dec", "<i2"), ("pm_ra_error", "i1"), ("pm_dec_error", "i1"), ("pts_key", "<u4"), ("j_mag", "<i2"), ("h_mag", "<i2"), ("k_mag", "<i2"), ("rest", "V28")]
)


def decode_ucac4(path: str, content: bytes) -> pd.DataFrame:
    zone = int(re.search(r"z(\d+)", path.rsplit("/", 1)[-1])[1])
    a = np.frombuffer(content, UCAC4, len(content) // UCAC4.itemsize)
    dec = a["spd"] * MAS - math.pi / 2
    mags = [np.where((m == 20000) | (m == 0), np.nan, m / 1000.0) for m in (a["aperture_mag"].astype(float), a["model_mag"].astype(float), a["j_mag"].astype(float))]
    mag = np.where(np.isnan(mags[0]), np.where(np.isnan(mags[1]), mags[2], mags[1]), mags[0])
    c = np.cos(dec)
    known = (a["pm_ra"] != 32767) & (a["pm_dec"] != 32767)
    pm_ra = np.where(known & (np.abs(c) > 1e-12), a["pm_ra"] * (MAS / 10) / np.where(np.abs(c) > 1e-12, c, 1), np.nan)
    out = pd.DataFrame({"zone": zone, "record": np.arange(1, len(a) + 1), "ra": a["ra"] * MAS, "decl": dec, "mag": mag, "pm_ra": pm_ra, "pm_dec": np.where(known, a["pm_dec"] * (MAS / 10), np.nan), "object_type": a["object_type"].astype(np.int32)})
    return out.astype({"zone": np.int32, "record": np.int32}).replace({np.nan: None})


def read_ucac4(spark: SparkSession, path: str) -> DataFrame:
    """(zone, record, ra, decl, mag, pm_ra, pm_dec, object_type) of zone files z001 to z900; write it partitioned by zone."""
    return _decode(files(spark, path, "z*"), decode_ucac4, "zone int, record int, ra double, decl double, mag double, pm_ra double, pm_dec double, object_type int")


def encode_ucac4(stars: DataFrame) -> DataFrame:
    """(name, content) of the zone files of stars (zone, record, ra, decl, mag), angles to a milliarcsecond, magnitudes to 0.001."""

    def encode(p: pd.DataFrame) -> bytes:
        p = p.sort_values("record")
        a = np.zeros(len(p), UCAC4)
        a["ra"], a["spd"] = np.floor(p["ra"].to_numpy() / MAS + 0.5), np.floor((p["decl"].to_numpy() + math.pi / 2) / MAS + 0.5)
        a["aperture_mag"] = np.where(p["mag"].isna(), 20000, np.floor(p["mag"].fillna(0).to_numpy() * 1000 + 0.5))
        a["model_mag"], a["pm_ra"], a["pm_dec"] = 20000, 32767, 32767
        return a.tobytes()

    return _encode(stars, "zone", encode, "z{:03d}")


def lookup(records: DataFrame, zone: int, record: int) -> DataFrame:
    """A catalogue's record by zone (or area) and number; no row where there is none. Partitions by zone prune the scan."""
    return records.where((F.col(records.columns[0]) == zone) & (F.col("record") == record))


# ---- SAO binary: a 28-byte header names the record layout ----------------------------------------------------------


def decode_sao(path: str, content: bytes) -> pd.DataFrame:
    order = "<" if abs(struct.unpack_from("<i", content, 24)[0]) < 1 << 16 else ">"
    _, first, n, catalogue_ids, motion, mags, size = struct.unpack_from(f"{order}7i", content)
    fields = [("id", f"{order}f4")] if catalogue_ids > 0 else []
    fields += [("ra", f"{order}f8"), ("decl", f"{order}f8"), ("type", "S2")]
    fields += [(f"mag{i}", f"{order}i2") for i in range(abs(mags))]
    fields += [("pm_ra", f"{order}f4"), ("pm_dec", f"{order}f4")] if motion > 0 else []
    layout = np.dtype(fields)
    if layout.itemsize < size:
        layout = np.dtype([*fields, ("pad", f"V{size - layout.itemsize}")])
    count = min(abs(n), (len(content) - 28) // layout.itemsize)  # a cut-off tail is left out
    a = np.frombuffer(content, layout, count, 28)
    out = pd.DataFrame({"id": (a["id"] if catalogue_ids > 0 else np.arange(first, first + count)).astype(np.int64), "ra": a["ra"].astype(float), "decl": a["decl"].astype(float)})
    out["mag"] = a["mag0"] / 100.0 if mags else np.nan
    out["pm_ra"], out["pm_dec"] = (a[c].astype(float) if motion > 0 else np.nan for c in ("pm_ra", "pm_dec"))
    out["sp_type"] = [t.decode("ascii", "replace").strip() for t in a["type"]]
    out["epoch_system"] = "B1950" if n > 0 else "J2000"
    return out


def read_sao(spark: SparkSession, path: str) -> DataFrame:
    return _decode(files(spark, path), decode_sao, "id long, ra double, decl double, mag double, pm_ra double, pm_dec double, sp_type string, epoch_system string")


def encode_sao(stars: DataFrame, by: str, big_endian: bool = False) -> DataFrame:
    """(name, content) of one file for each `by`: stars (id, ra, decl, mag, sp_type) as J2000 records, ids in order."""
    e = ">" if big_endian else "<"

    def encode(p: pd.DataFrame) -> bytes:
        p = p.sort_values("id")
        a = np.zeros(len(p), np.dtype([("id", f"{e}f4"), ("ra", f"{e}f8"), ("decl", f"{e}f8"), ("type", "S2"), ("mag0", f"{e}i2")]))
        a["id"], a["ra"], a["decl"], a["type"], a["mag0"] = p["id"], p["ra"], p["decl"], [t.encode() for t in p["sp_type"]], np.floor(p["mag"] * 100 + 0.5)
        return struct.pack(f"{e}7i", 0, 1, -len(p), 1, 0, 1, a.itemsize) + a.tobytes()

    return _encode(stars, by, encode, "sao{}.bin")


# ---- tiled star archives: 110-byte header, 5 to 11 byte records in sections of one magnitude ------------------------


def decode_tile(path: str, content: bytes) -> pd.DataFrame:
    """Records of 24-bit right ascension and declination; a record of all ones in RA opens a section of one magnitude.

    Sizes 5 and 6 keep the high declination byte in the section's record too; 6 and more also have a colour byte.
    """
    size, area = 11 if content[109] == 32 else content[109], int(re.search(r"(\d+)", path.rsplit("/", 1)[-1].split("_")[-1])[1])
    a = np.frombuffer(content, np.uint8, (len(content) - 110) // size * size, 110).reshape(-1, size).astype(np.int64)
    skip = {5: 0, 6: 0, 7: 0, 9: 0, 10: 4, 11: 4}[size]
    short = size in (5, 6)
    ra = a[:, skip] | a[:, skip + 1] << 8 | a[:, skip + 2] << 16
    header = ra == 0xFFFFFF
    at = np.maximum.accumulate(np.where(header, np.arange(len(a)), -1))
    ok = ~header & (at >= 0)
    if short:
        high = a[at, skip + 3] - 128
        mag = (a[at, skip + 4] - 16) / 10.0
        low = a[:, skip + 3] | a[:, skip + 4] << 8
    else:
        high = np.where(a[:, skip + 5] > 127, a[:, skip + 5] - 256, a[:, skip + 5])
        mag = (a[at, skip + 3] - 16) / 10.0
        low = a[:, skip + 3] | a[:, skip + 4] << 8
    dec = (high * 65536 + low) * (math.pi / 2 / (128 * 65536 - 1))
    colour = a[:, 5] if size == 6 else np.full(len(a), -1)
    out = pd.DataFrame({"area": np.int32(area), "record": np.arange(len(a)), "ra": ra * (2 * math.pi / (256**3 - 1)), "decl": dec, "mag": mag, "colour": np.where(colour > 127, colour - 256, colour) / 10.0})
    out.loc[colour < 0, "colour"] = np.nan
    return out[ok]


def read_tiles(spark: SparkSession, path: str, glob: str | None = None, tiling: Tiling | None = None) -> DataFrame:
    """(area, record, ra, decl, mag, colour) of a tiled archive. area is the file's number as its name has it (band and
    cell), or, with a tiling, the area's own."""
    t = _decode(files(spark, path, glob), decode_tile, "area int, record long, ra double, decl double, mag double, colour double")
    if tiling is None:
        return t
    numbers = F.create_map(*(F.lit(x) for k, name, *_ in tiling.areas() for x in (int(name[:4]), k)))
    return t.withColumn("area", F.element_at(numbers, F.col("area")))


def encode_tiles(stars: DataFrame, tiling: Tiling) -> DataFrame:
    """(name, content) of 5-byte tiles of stars (ra, decl, mag), in sections of one magnitude and high declination byte."""
    names = {k: name for k, name, *_ in tiling.areas()}

    def encode(p: pd.DataFrame) -> bytes:
        ra = np.floor(p["ra"].to_numpy() / (2 * math.pi) * (256**3 - 1) + 0.5).astype(np.int64) % (256**3 - 1)
        dec = np.floor(p["decl"].to_numpy() / (math.pi / 2) * (128 * 65536 - 1) + 0.5).astype(np.int64)
        mag, high = np.floor(p["mag"].to_numpy() * 10 + 0.5).astype(np.int64), dec >> 16
        out, last = [], None
        for i in np.lexsort((dec, ra, high, mag)):
            if (mag[i], high[i]) != last:
                last = (mag[i], high[i])
                out.append(bytes([255, 255, 255, int(high[i]) + 128, int(mag[i]) + 16]))
            out.append(struct.pack("<I", int(ra[i]))[:3] + struct.pack("<H", int(dec[i]) & 0xFFFF))
        return "Epoch=2000.0".ljust(109).encode() + bytes([5]) + b"".join(out)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"t_{names[int(p['area'].iloc[0])]}"], "content": [encode(p)]})

    return stars.withColumn("area", tiling.area_of("ra", "decl")).groupBy("area").applyInPandas(run, "name string, content binary")


def tile_header(content) -> Column:
    """(epoch, size) of a tile's 110-byte header: its Epoch= tag, 2000 without one, and the bytes of a record."""
    text = F.decode(F.substring(content, 1, 109), "ISO-8859-1")
    epoch = F.regexp_extract(text, r"Epoch=\s*([0-9.]+)", 1).try_cast("double")
    return F.struct(F.coalesce(epoch, F.lit(2000.0)).alias("epoch"), F.conv(F.hex(F.substring(content, 110, 1)), 16, 10).cast("int").alias("size"))


def decode_designation(value) -> Column:
    """(catalogue, region, star, component) of a packed designation: UCAC4 zone and record, or, where it is negative,
    Tycho region, star and component. The bits are the format's."""
    v = value if isinstance(value, Column) else F.col(value)
    u = -v.cast("long")  # the least 32-bit value has no negative of its own kind
    bits = lambda x, shift, mask: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)).cast("int")
    ucac = F.struct(F.lit("UCAC4").alias("catalogue"), bits(v, 20, 0xFFF).alias("region"), bits(v, 0, 0xFFFFF).alias("star"), F.lit(None).cast("int").alias("component"))
    component = F.when(bits(u, 15, 1) == 1, 3).when(bits(u, 30, 1) == 1, 2).otherwise(1)
    tycho = F.struct(F.lit("TYC").alias("catalogue"), bits(u, 16, 0x3FFF).alias("region"), bits(u, 0, 0x7FFF).alias("star"), component.alias("component"))
    return F.when(v >= 0, ucac).when(v < 0, tycho)


def pack_tycho(region: Column, star: Column, component: Column) -> Column:
    """The packed designation of a Tycho star, for `decode_designation`: negative, in 32 bits. One whose bits are all zero
    has no negative and would read as UCAC4; it takes the top bit, which is no field's."""
    part = F.when(component == 3, F.lit(0x8000)).when(component == 2, F.lit(0x40000000)).otherwise(F.lit(0))
    u = F.shiftleft(region.cast("long"), 16).bitwiseOR(star.cast("long")).bitwiseOR(part.cast("long"))
    return -F.when(u == 0, F.lit(1 << 31)).otherwise(u)


@dataclass(frozen=True)
class Tiling:
    """A sky cut into bands of declination from south to north, each into so many equal cells from RA 0; areas count
    from 1. cells: of each band; edges: the declinations between the bands."""

    cells: tuple[int, ...]
    edges: tuple[float, ...]
    suffix: str

    def areas(self) -> list[tuple[int, str, float, float, float, float]]:
        """(area, file, ra_min, ra_max, dec_min, dec_max) of every cell."""
        bounds, out = (-math.pi / 2, *self.edges, math.pi / 2), []
        for band, n in enumerate(self.cells):
            for k in range(n):
                out.append((len(out) + 1, f"{band + 1:02d}{k + 1:02d}{self.suffix}", TAU * k / n, TAU * (k + 1) / n, bounds[band], bounds[band + 1]))
        return out

    def _band(self, dec: Column) -> dict[str, Column]:
        at = F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e < dec))
        get = lambda xs: F.get(F.array(*map(F.lit, xs)), at)
        bounds = (-math.pi / 2, *self.edges, math.pi / 2)
        return {"n": get(self.cells), "before": get([sum(self.cells[:i]) for i in range(len(self.cells))]), "south": get(bounds[:-1]), "north": get(bounds[1:])}

    def area_of(self, ra, dec) -> Column:
        """The area that a direction falls into."""
        a, d = (F.col(x) if isinstance(x, str) else x for x in (ra, dec))
        b = self._band(d)
        return (b["before"] + F.least(F.floor(F.pmod(a, F.lit(TAU)) / TAU * b["n"]), b["n"] - 1) + 1).cast("int")

    def touched(self, boxes: list[tuple[float, float, float, float]]) -> list[int]:
        """The areas whose bounds meet any of some boxes (ra_min, ra_max, dec_min, dec_max)."""
        return [k for k, _, a0, a1, d0, d1 in self.areas() if any(a1 >= b0 and a0 <= b1 and d1 >= c0 and d0 <= c1 for b0, b1, c0, c1 in boxes)]

    def overlapping(self, points: DataFrame, radius: float, ra: str = "ra", dec: str = "decl", least: float = 0.01) -> DataFrame:
        """`points` with (area, share): the one to four areas that a square field of half side `radius` lies on.

        Each corner's area has the part of the field between the corner and the area's edges; shares of one area add up to
        1 at most, and corners of under `least` are left out.
        """
        turn, side = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (1, -1) for i in (1, -1))), 2 * radius
        p = points.withColumn("_k", F.explode(turn)).withColumn("_d", F.col(dec) + F.col("_k.j") * radius)
        flat = F.abs(F.cos("_d")) < 1e-12
        p = p.withColumn("_a", F.pmod(F.col(ra) + F.col("_k.i") * F.when(flat, 0.0).otherwise(F.lit(radius) / F.cos("_d")), F.lit(TAU)))
        b = self._band(F.greatest(F.lit(-math.pi / 2), F.least(F.lit(math.pi / 2), F.col("_d"))))
        p = p.withColumns({f"_{k}": v for k, v in b.items()})
        cell = F.col("_a") * F.col("_n") / TAU
        width = F.cos("_d") * TAU / F.col("_n")
        beyond = F.abs("_d") >= math.pi / 2
        inside = cell - F.floor(cell)
        space_a = F.when((F.col("_n") == 1) | beyond, TAU).otherwise(width * F.when(F.col("_k.i") == 1, inside).otherwise(F.lit(1.0) - inside))
        space_d = F.when(beyond, F.col("_north") - F.col("_south")).when(F.col("_k.j") == 1, F.col("_d") - F.col("_south")).otherwise(F.col("_north") - F.col("_d"))
        share = F.least(space_a, F.lit(side)) * F.least(space_d, F.lit(side)) / side**2
        area = (F.col("_before") + F.least(F.floor(cell), F.col("_n") - 1) + 1).cast("int")
        p = p.withColumn("area", area).withColumn("share", share).where(F.col("share") >= least)
        return p.groupBy(*points.columns, "area").agg(F.least(F.lit(1.0), F.sum("share")).alias("share"))


#: Fixed values of the two archives in use: cells of each band, and the first one's band edges.
CELLS_290 = (1, 4, 8, 12, 16, 20, 24, 28, 32, 32, 28, 24, 20, 16, 12, 8, 4, 1)
EDGES_290 = (-1.4875825298262766, -1.3205739884259363, -1.151794878239301, -0.9799125667090463, -0.8034034496024828, -0.6203423859368793, -0.4281907604698024, -0.2233034646423629, 0.0, 0.2233034646423629, 0.4281907604698024, 0.6203423859368793, 0.8034034496024828, 0.9799125667090463, 1.151794878239301, 1.3205739884259363, 1.4875825298262766)
CELLS_1476 = (1, 3, 9, 15, 21, 27, 33, 38, 43, 48, 52, 56, 60, 63, 65, 67, 68, 69, 69, 68, 67, 65, 63, 60, 56, 52, 48, 43, 38, 33, 27, 21, 15, 9, 3, 1)
TILING_290 = Tiling(CELLS_290, EDGES_290, ".290")
#: Its bands are 36 / 7 degrees high, those at the poles half as much.
TILING_1476 = Tiling(CELLS_1476, tuple((math.radians(36 / 7 * (i - 17)) for i in range(35))), ".1476")


def query_tiles(spark: SparkSession, path: str, tiling: Tiling, region) -> DataFrame:
    """The stars of a tiled archive that lie in a region, brightest first: only the files of touched areas are read."""
    names = {k: name for k, name, *_ in tiling.areas()}
    touched = tiling.touched((region.box() if hasattr(region, "box") else region).parts())
    found = read_tiles(spark, path, "*{%s}" % ",".join(names[k] for k in touched), tiling)
    return found.where(region.coarse() & region.exact()).orderBy("mag", "area", "ra")


# ---- FITS -----------------------------------------------------------------------------------------------------------

_BITPIX = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def fits_units(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header, data) of each header-data unit."""
    at = 0
    while at + 2880 <= len(content):
        header: dict = {}
        while True:
            card = content[at : at + 80].decode("ascii", "replace")
            at += 80
            key = card[:8].strip()
            if key == "END" or at >= len(content):
                break
            if card[8:10] == "= ":
                v = card[10:].strip()
                if v.startswith("'"):
                    m = re.match(r"'((?:[^']|'')*)'", v)
                    header[key] = (m[1] if m else v[1:]).replace("''", "'").rstrip()
                else:
                    v = v.split("/", 1)[0].strip()
                    header[key] = v == "T" if v in ("T", "F") else int(v) if re.fullmatch(r"[+-]?\d+", v) else float(v.replace("D", "E")) if v else None
        at += -at % 2880
        n = abs(int(header.get("BITPIX", 8))) // 8 * math.prod(int(header.get(f"NAXIS{i}", 1)) for i in range(1, int(header.get("NAXIS", 0)) + 1)) if header.get("NAXIS") else 0
        n = (n + int(header.get("PCOUNT", 0)) * abs(int(header.get("BITPIX", 8))) // 8) * int(header.get("GCOUNT", 1)) if n else 0
        yield header, content[at : at + n]
        at += n + -n % 2880


def fits_pixels(header: dict, data: bytes) -> np.ndarray:
    """Planes (channel, y, x) with BSCALE and BZERO applied."""
    w, h, c = (int(header.get(f"NAXIS{i}", 1)) for i in (1, 2, 3))
    a = np.frombuffer(data, _BITPIX[int(header["BITPIX"])], w * h * c).reshape(c, h, w).astype(np.float64)
    return a * float(header.get("BSCALE", 1) or 1) + float(header.get("BZERO", 0) or 0)


def decode_fits(path: str, content: bytes, lists: bool = True) -> pd.DataFrame:
    """One row for each unit; pixels as a list, or as the array itself, which Arrow takes without making objects of them."""
    rows = []
    for i, (header, data) in enumerate(fits_units(content)):
        image = header.get("XTENSION", "IMAGE") == "IMAGE" and int(header.get("NAXIS", 0)) >= 2
        planes = fits_pixels(header, data) if image else None
        shape = planes.shape if image else (0, 0, 0)
        rows.append((path, i, shape[2], shape[1], shape[0], {k: str(v) for k, v in header.items()}, (planes.transpose(1, 2, 0).ravel().tolist() if lists else planes.transpose(1, 2, 0).ravel()) if image else None))
    return pd.DataFrame(rows, columns=["path", "hdu", "width", "height", "channels", "header", "pixels"])


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """(path, hdu, width, height, channels, header, pixels): pixels row by row, channels interleaved."""
    return _decode(files(spark, path), lambda p, c: decode_fits(p, c, False), "path string, hdu int, width int, height int, channels int, header map<string,string>, pixels array<double>", 1)


def keyword(header: str, names: list[str], kind: str = "double"):
    """The first of several header keywords that is there, as a type."""
    return F.coalesce(*(F.col(header)[n].try_cast(kind) for n in names))


def explode_pixels(images: DataFrame) -> DataFrame:
    """(path, hdu, x, y, c, value): one row for each sample."""
    p = images.select("path", "hdu", "width", "channels", F.posexplode("pixels").alias("i", "value"))
    return p.select("path", "hdu", F.pmod(F.floor(F.col("i") / F.col("channels")), F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / (F.col("width") * F.col("channels"))).cast("int").alias("y"), F.pmod("i", F.col("channels")).cast("int").alias("c"), "value")


def encode_fits(planes: np.ndarray, bitpix: int = -32, extra: dict | None = None) -> bytes:
    """A FITS file of one image (channel, y, x)."""
    c, h, w = planes.shape
    cards = {"SIMPLE": True, "BITPIX": bitpix, "NAXIS": 3 if c > 1 else 2, "NAXIS1": w, "NAXIS2": h, **({"NAXIS3": c} if c > 1 else {}), **(extra or {})}

    def card(k: str, v) -> str:
        t = f"'{str(v).replace(chr(39), chr(39) * 2):<8}'" if isinstance(v, str) else ("T" if v else "F").rjust(20) if isinstance(v, bool) else (repr(v) if isinstance(v, float) else str(v)).rjust(20)
        return f"{k:<8}= {t}"[:80].ljust(80)

    head = "".join(card(k, v) for k, v in cards.items()) + "END".ljust(80)
    head += " " * (-len(head) % 2880)
    kind = np.dtype(_BITPIX[bitpix])
    data = (np.rint(planes) if kind.kind in "iu" else planes).astype(kind).tobytes()
    return head.encode("ascii") + data + b"\0" * (-len(data) % 2880)


def images_of(pixels: DataFrame, by: str, encode=None, suffix: str = "fits") -> DataFrame:
    """(name, content) of an image file for each `by`, from pixels (by, x, y, c, value): `encode(planes)` gives the bytes.

    A pixel that is not there is 0. Write them with `bytes.write_files`.
    """
    encode = encode or (lambda planes: encode_fits(planes, -64))

    def make(p: pd.DataFrame) -> bytes:
        planes = np.zeros((int(p["c"].max()) + 1, int(p["y"].max()) + 1, int(p["x"].max()) + 1))
        planes[p["c"], p["y"], p["x"]] = p["value"]
        return encode(planes)

    return _encode(pixels, by, make, f"image{{}}.{suffix}")


# ---- DAF / SPK ------------------------------------------------------------------------------------------------------


def decode_spk(path: str, content: bytes) -> pd.DataFrame:
    """Chebyshev segments (types 2 and 3) of an SPK kernel, one row for each record."""
    e = "<" if content[88:96] == b"LTL-IEEE" else ">"
    nd, ni = struct.unpack_from(f"{e}2i", content, 8)
    record = struct.unpack_from(f"{e}i", content, 76)[0]
    words = np.frombuffer(content, f"{e}f8", len(content) // 8)
    rows = []
    while record:
        base = (record - 1) * 128
        nxt, _, n = words[base : base + 3]
        for k in range(int(n)):
            at = (base + 3 + k * (nd + (ni + 1) // 2)) * 8
            start, end = struct.unpack_from(f"{e}{nd}d", content, at)[:2]
            target, center, frame, kind, first, last = struct.unpack_from(f"{e}{ni}i", content, at + nd * 8)[:6]
            if kind not in (2, 3):
                continue
            init, length, size, count = words[last - 4 : last]
            for i in range(int(count)):
                r = words[first - 1 + i * int(size) : first - 1 + (i + 1) * int(size)]
                rows.append((int(target), int(center), int(frame), int(kind), float(init + i * length), float(init + (i + 1) * length), float(r[0]), float(r[1]), [float(x) for x in r[2:]], float(start), float(end)))
        record = int(nxt)
    return pd.DataFrame(rows, columns=["target", "center", "frame", "kind", "start", "end", "mid", "radius", "coefficients", "segment_start", "segment_end"])


def read_spk(spark: SparkSession, path: str) -> DataFrame:
    """Records of Chebyshev coefficients; find a time's by `range_join` on (start, end), then `chebyshev_state`."""
    return _decode(files(spark, path), decode_spk, "target int, center int, frame int, kind int, start double, end double, mid double, radius double, coefficients array<double>, segment_start double, segment_end double")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def chebyshev_state(t: pd.Series, kind: pd.Series, mid: pd.Series, radius: pd.Series, coefficients: pd.Series) -> pd.Series:
    """x, y, z and their rates at seconds t of records' coefficients; rates of type 2 by differentiation."""
    out = []
    for s, k, m, r, c in zip(t, kind, mid, radius, coefficients, strict=True):
        x = (s - m) / r
        a = np.asarray(c, float).reshape(3 if k == 2 else 6, -1)
        p = [np.polynomial.chebyshev.chebval(x, row) for row in a[:3]]
        v = [np.polynomial.chebyshev.chebval(x, np.polynomial.chebyshev.chebder(row)) / r for row in a[:3]] if k == 2 else [np.polynomial.chebyshev.chebval(x, row) for row in a[3:]]
        out.append([float(z) for z in (*p, *v)])
    return pd.Series(out)


# ---- byte codecs and checksums --------------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    """zlib or raw deflate data, expanded; null stays null."""
    return data.map(lambda b: None if b is None else zlib.decompress(b, 15 if b[:1] == b"\x78" else -15))


@F.pandas_udf(T.BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.compress(b))


def crc(data: bytes, width: int, poly: int, init: int, reflect_in: bool, reflect_out: bool, xor: int) -> int:
    """A cyclic checksum of any width by its parameters."""
    mask, reg = (1 << width) - 1, init
    for b in data:
        if reflect_in:
            b = int(f"{b:08b}"[::-1], 2)
        for i in range(7, -1, -1):
            bit = (b >> i & 1) ^ (reg >> (width - 1) & 1)
            reg = (reg << 1) & mask
            if bit:
                reg ^= poly
    if reflect_out:
        reg = int(f"{reg:0{width}b}"[::-1], 2)
    return reg ^ xor


@functools.cache
def _crc_table(width: int, poly: int, reflect: bool) -> list[int]:
    """What each byte does to a register whose low (reflected) or high bits it meets."""
    out = []
    for b in range(256):
        reg = int(f"{b:08b}"[::-1], 2) if reflect else b
        reg <<= width - 8
        for _ in range(8):
            reg = ((reg << 1) ^ (poly if reg >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
        out.append(int(f"{reg:0{width}b}"[::-1], 2) if reflect else reg)
    return out


def crc_by_table(data: bytes, width: int, poly: int, init: int, reflect_in: bool, reflect_out: bool, xor: int) -> int:
    """As `crc`, a byte at a time; for widths of 8 and more whose two reflections agree."""
    if width < 8 or reflect_in != reflect_out:
        return crc(data, width, poly, init, reflect_in, reflect_out, xor)
    table, mask = _crc_table(width, poly, reflect_in), (1 << width) - 1
    reg = int(f"{init:0{width}b}"[::-1], 2) if reflect_in else init
    for b in data:
        reg = (reg >> 8) ^ table[(reg ^ b) & 255] if reflect_in else ((reg << 8) & mask) ^ table[(reg >> (width - 8)) ^ b]
    return reg ^ xor


#: Parameters of common checksums: width, polynomial, start, reflected in, reflected out, final xor.
CRCS = {"CRC-16/ARC": (16, 0x8005, 0, True, True, 0), "CRC-16/CCITT-FALSE": (16, 0x1021, 0xFFFF, False, False, 0), "CRC-16/MODBUS": (16, 0x8005, 0xFFFF, True, True, 0), "CRC-8": (8, 0x07, 0, False, False, 0), "CRC-32": (32, 0x04C11DB7, 0xFFFFFFFF, True, True, 0xFFFFFFFF)}


def crc_column(data, name: str):
    """A checksum of a binary column: built in for CRC-32, else in Arrow batches."""
    if name == "CRC-32":
        return F.crc32(data)
    p = CRCS[name]

    @F.pandas_udf("long")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else crc_by_table(bytes(b), *p))

    return f(data)


def image_kind(content):
    """fits, xisf, jpeg or null by the first bytes."""
    c = content if not isinstance(content, str) else F.col(content)
    head = F.hex(F.substring(c, 1, 8))
    return F.when(head.startswith(b"SIMPLE".hex().upper()), "fits").when(head.startswith(b"XISF0100".hex().upper()), "xisf").when(head.startswith("FFD8FF"), "jpeg")


# ---- XISF -----------------------------------------------------------------------------------------------------------

_SAMPLES = {"UInt8": "u1", "UInt16": "<u2", "UInt32": "<u4", "UInt64": "<u8", "Float32": "<f4", "Float64": "<f8"}


def _expand(data: bytes, compression: str | None) -> bytes:
    """A block's bytes: codec:size[:item] with `+sh` for bytes dealt by their place in the item."""
    if not compression:
        return data
    codec, size, *item = compression.split(":")
    if codec.startswith("zlib"):
        data = zlib.decompress(data)
    elif codec.startswith("zstd"):
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(size))
    else:
        raise ValueError(f"codec {codec} is not supported")
    if codec.endswith("+sh"):
        n = int(item[0])
        data = np.frombuffer(data, np.uint8).reshape(n, -1).T.tobytes()
    return data


def decode_xisf(path: str, content: bytes) -> pd.DataFrame:
    import xml.etree.ElementTree as ET

    if content[:8] != b"XISF0100":
        raise ValueError("not an XISF file")
    root = ET.fromstring(content[16 : 16 + struct.unpack_from("<I", content, 8)[0]].rstrip(b"\0"))
    rows = []
    for k, e in enumerate(x for x in root.iter() if x.tag.rpartition("}")[2] == "Image"):
        w, h, c = (int(v) for v in e.get("geometry").split(":"))
        _, at, size = e.get("location").split(":")
        a = np.frombuffer(_expand(content[int(at) : int(at) + int(size)], e.get("compression")), _SAMPLES[e.get("sampleFormat")]).astype(float)
        a = a.reshape(h, w, c) if e.get("pixelStorage", "Planar") == "Normal" else a.reshape(c, h, w).transpose(1, 2, 0)
        header = {x.get("name"): x.get("value").strip("' ") for x in e if x.tag.rpartition("}")[2] == "FITSKeyword"}
        rows.append((path, k, w, h, c, header, a.ravel()))
    return pd.DataFrame(rows, columns=["path", "hdu", "width", "height", "channels", "header", "pixels"])


def read_xisf(spark: SparkSession, path: str) -> DataFrame:
    """The same columns as `read_fits`; zlib and zstd blocks, byte-shuffled or not."""
    return _decode(files(spark, path), decode_xisf, "path string, hdu int, width int, height int, channels int, header map<string,string>, pixels array<double>", 1)


def decode_image(path: str, content: bytes) -> pd.DataFrame:
    """A FITS or XISF image by its first bytes; no rows for any other file."""
    if content[:6] == b"SIMPLE":
        return decode_fits(path, content, False)
    if content[:8] == b"XISF0100":
        return decode_xisf(path, content)
    return pd.DataFrame(columns=["path", "hdu", "width", "height", "channels", "header", "pixels"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The images of a folder, of whatever kind each file is, in the columns of `read_fits`."""
    return _decode(files(spark, path), decode_image, "path string, hdu int, width int, height int, channels int, header map<string,string>, pixels array<double>", 1)


def read_jpeg(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, pixels) of a folder's pictures that Spark's image source decodes (JPEG among them),
    0 to 1, row by row with channels interleaved, red first; files that are none are left out."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @F.pandas_udf("array<double>")
    def values(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(b, np.uint8).reshape(-1, int(c))[:, ::-1] / 255.0).ravel().tolist() for b, c in zip(data, channels, strict=True)])

    return i.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), values("data", "nChannels").alias("pixels"))


def encode_xisf(planes: np.ndarray, sample: str = "Float32", compress: bool = False, shuffle: bool = False, header: dict | None = None) -> bytes:
    """An XISF file of one planar image (channel, y, x)."""
    c, h, w = planes.shape
    kind = np.dtype(_SAMPLES[sample])
    data = (np.rint(planes) if kind.kind == "u" else planes).astype(kind).tobytes()
    raw, packing = data, ""
    if compress:
        if shuffle:
            data = np.frombuffer(data, np.uint8).reshape(-1, kind.itemsize).T.tobytes()
        data = zlib.compress(data)
        packing = f' compression="zlib{"+sh" if shuffle else ""}:{len(raw)}{f":{kind.itemsize}" if shuffle else ""}"'
    keys = "".join(f'<FITSKeyword name="{k}" value="{v}" comment=""/>' for k, v in (header or {}).items())
    at = 4096
    xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0"><Image geometry="{w}:{h}:{c}" sampleFormat="{sample}" colorSpace="{"RGB" if c == 3 else "Gray"}" location="attachment:{at}:{len(data)}"{packing}>{keys}</Image></xisf>'.encode()
    if len(xml) > at - 16:
        raise ValueError("the header is too long")
    return b"XISF0100" + struct.pack("<II", len(xml), 0) + xml.ljust(at - 16, b"\0") + data


# ---- Rice coding of integers ----------------------------------------------------------------------------------------

_RICE = {1: (3, 6), 2: (4, 14), 4: (5, 25)}  # item bytes: bits of a block's parameter, and its largest value


def rice_encode(values: np.ndarray, size: int = 2, block: int = 32) -> bytes:
    """Rice code of differences: the first value plain, then blocks with the bits that each splits off (White and Becker)."""
    head, most = _RICE[size]
    bits, mask = size * 8, (1 << size * 8) - 1
    v = np.asarray(values, np.int64)
    if not len(v):
        return b""
    d = np.diff(v, prepend=v[0])
    d = ((d + (1 << (bits - 1))) & mask) - (1 << (bits - 1))
    folded = np.where(d < 0, -2 * d - 1, 2 * d)
    out = [f"{int(v[0]) & mask:0{bits}b}"]
    for at in range(0, len(v), block):
        p = folded[at : at + block].tolist()
        fs = max(0, min(most, int(sum(p) / len(p) / 2 + 0.5).bit_length() - (0 if sum(p) else 1)))
        if not any(p):
            out.append("0" * head)
        elif fs >= most:
            out.append(f"{most + 1:0{head}b}" + "".join(f"{x:0{bits}b}" for x in p))
        else:
            out.append(f"{fs + 1:0{head}b}" + "".join("0" * (x >> fs) + "1" + (f"{x & ((1 << fs) - 1):0{fs}b}" if fs else "") for x in p))
    s = "".join(out)
    return int(s + "0" * (-len(s) % 8), 2).to_bytes((len(s) + 7) // 8, "big")


def rice_column(values, size: int = 2) -> Column:
    """Rice code of a column of integer arrays, as bytes; null stays null."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else rice_encode(np.asarray(v, np.int64), size))

    return f(values)


def unrice_column(data, n, size: int = 2) -> Column:
    """The first n integers of Rice coded bytes."""

    @F.pandas_udf("array<long>")
    def f(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else rice_decode(bytes(b), int(m), size).tolist() for b, m in zip(s, k, strict=True)])

    return f(data, n)


def rice_decode(data: bytes, n: int, size: int = 2, block: int = 32) -> np.ndarray:
    head, most = _RICE[size]
    bits, mask = size * 8, (1 << size * 8) - 1
    if not n:
        return np.zeros(0, np.int64)
    s, at = f"{int.from_bytes(data, 'big'):0{len(data) * 8}b}", bits
    last, out = int(s[:bits], 2), []
    while len(out) < n:
        fs = int(s[at : at + head], 2) - 1
        at += head
        for _ in range(min(block, n - len(out))):
            if fs < 0:
                x = 0
            elif fs == most:
                x = int(s[at : at + bits], 2)
                at += bits
            else:
                one = s.index("1", at)
                x = (one - at) << fs | (int(s[one + 1 : one + 1 + fs], 2) if fs else 0)
                at = one + 1 + fs
            last = (last + (~(x >> 1) if x & 1 else x >> 1)) & mask
            out.append(last)
    a = np.array(out, np.int64)
    return a if size == 1 else np.where(a >= 1 << (bits - 1), a - (1 << bits), a)
