"""Star space motion, planet magnitudes and constellation lookup."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperflow.functions.angles import wrap_positive
from vesperflow.functions.mathx import col, horner, let

MAS = math.pi / 648000000
AU_YEAR_KM_S = 4.740470446


#: Codes and names of the constellations, as their union has them.
CONSTELLATIONS = {
    "And": "Andromeda", "Ant": "Antlia", "Aps": "Apus", "Aqr": "Aquarius", "Aql": "Aquila", "Ara": "Ara", "Ari": "Aries", "Aur": "Auriga", "Boo": "Bootes", "Cae": "Caelum", "Cam": "Camelopardalis", "Cnc": "Cancer", "CVn": "Canes Venatici", "CMa": "Canis Major", "CMi": "Canis Minor", "Cap": "Capricornus", "Car": "Carina", "Cas": "Cassiopeia",
    "Cen": "Centaurus", "Cep": "Cepheus", "Cet": "Cetus", "Cha": "Chamaeleon", "Cir": "Circinus", "Col": "Columba", "Com": "Coma Berenices", "CrA": "Corona Australis", "CrB": "Corona Borealis", "Crv": "Corvus", "Crt": "Crater", "Cru": "Crux", "Cyg": "Cygnus", "Del": "Delphinus", "Dor": "Dorado", "Dra": "Draco", "Equ": "Equuleus", "Eri": "Eridanus",
    "For": "Fornax", "Gem": "Gemini", "Gru": "Grus", "Her": "Hercules", "Hor": "Horologium", "Hya": "Hydra", "Hyi": "Hydrus", "Ind": "Indus", "Lac": "Lacerta", "Leo": "Leo", "LMi": "Leo Minor", "Lep": "Lepus", "Lib": "Libra", "Lup": "Lupus", "Lyn": "Lynx", "Lyr": "Lyra", "Men": "Mensa", "Mic": "Microscopium",
    "Mon": "Monoceros", "Mus": "Musca", "Nor": "Norma", "Oct": "Octans", "Oph": "Ophiuchus", "Ori": "Orion", "Pav": "Pavo", "Peg": "Pegasus", "Per": "Perseus", "Phe": "Phoenix", "Pic": "Pictor", "Psc": "Pisces", "PsA": "Piscis Austrinus", "Pup": "Puppis", "Pyx": "Pyxis", "Ret": "Reticulum", "Sge": "Sagitta", "Sgr": "Sagittarius",
    "Sco": "Scorpius", "Scl": "Sculptor", "Sct": "Scutum", "Ser": "Serpens", "Sex": "Sextans", "Tau": "Taurus", "Tel": "Telescopium", "Tri": "Triangulum", "TrA": "Triangulum Australe", "Tuc": "Tucana", "UMa": "Ursa Major", "UMi": "Ursa Minor", "Vel": "Vela", "Vir": "Virgo", "Vol": "Volans", "Vul": "Vulpecula",
}


def space_motion(ra, dec, pm_ra, pm_dec, parallax, rv, years) -> Column:
    """struct(ra, decl, parallax) after so many years of straight motion.

    Radians, proper motions in milliarcseconds a year (right ascension's with cos dec), parallax in milliarcseconds,
    radial velocity in km/s. Stars without a positive parallax move as if very far away.
    """
    px = F.greatest(F.coalesce(col(parallax), F.lit(0.0)), F.lit(1e-7))
    args = F.struct(col(ra).alias("a"), col(dec).alias("d"), (F.coalesce(col(pm_ra), F.lit(0.0)) * MAS).alias("ma"), (F.coalesce(col(pm_dec), F.lit(0.0)) * MAS).alias("md"), (F.coalesce(col(rv), F.lit(0.0)) * px * MAS / AU_YEAR_KM_S).alias("mr"), col(years).cast("double").alias("t"), px.alias("p"))

    def moved(s: Column) -> Column:
        sa, ca, sd, cd = F.sin(s["a"]), F.cos(s["a"]), F.sin(s["d"]), F.cos(s["d"])
        grow = F.lit(1.0) + s["mr"] * s["t"]
        x = cd * ca * grow + s["t"] * (-sa * s["ma"] - sd * ca * s["md"])
        y = cd * sa * grow + s["t"] * (ca * s["ma"] - sd * sa * s["md"])
        z = sd * grow + s["t"] * cd * s["md"]
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), s["p"].alias("p"))

    def place(v: Column) -> Column:
        r = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        return F.struct(wrap_positive(F.atan2(v["y"], v["x"])).alias("ra"), F.atan2(v["z"], r).alias("decl"), (v["p"] / F.sqrt(r * r + v["z"] * v["z"])).alias("parallax"))

    return let(let(args, moved), place)


#: Magnitude at 1 AU from Sun and observer, and phase polynomials in degrees (Astronomical Almanac 1984 on).
MAGNITUDES = {"mercury": (-0.42, (0.0380, -0.000273, 0.000002)), "venus": (-4.40, (0.0009, 0.000239, -0.00000065)), "mars": (-1.52, (0.016,)), "jupiter": (-9.40, (0.005,)), "saturn": (-8.88, (0.044,)), "uranus": (-7.19, (0.0028,)), "neptune": (-6.87, ())}


def planet_magnitude(planet: str, distance, delta, phase) -> Column:
    """Apparent magnitude from distances to the Sun and the observer (AU) and the phase angle; Saturn's without its rings."""
    base, terms = MAGNITUDES[planet]
    return F.log10(col(distance) * col(delta)) * 5 + base + (horner(col(phase) * (180 / math.pi), [0.0, *terms]) if terms else F.lit(0.0))


def phase_angle(distance, delta, earth) -> Column:
    """The angle at a body between Sun and observer, from the three distances."""
    r, d, e = col(distance), col(delta), col(earth)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r * r + d * d - e * e) / (r * d * 2))))


def illuminated(phase) -> Column:
    return (F.cos(col(phase)) + 1) / 2


def constellation(df: DataFrame, boundaries: DataFrame, ra: str = "ra", dec: str = "decl", out: str = "constellation") -> DataFrame:
    """`df` with the label of the boundary row (ra_low, ra_high, dec_low, label) with the highest dec_low not above dec.

    Boundaries are parallels and meridians of B1875, in radians, some hundred rows given by the caller; positions are
    precessed there first. Rows meet in cells of right ascension, so the join is an equality.
    """
    from vesperflow.functions.sphere import precess

    cells = 48
    a, d = precess(ra, dec, 2405889.25855)
    p = df.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_a": a, "_d": d}).withColumn("_c", F.floor(F.col("_a") * (cells / (2 * math.pi))).cast("int"))
    b = boundaries.withColumn("_c", F.explode(F.sequence(F.floor(F.col("ra_low") * (cells / (2 * math.pi))).cast("int"), F.floor(F.col("ra_high") * (cells / (2 * math.pi))).cast("int"))))
    found = p.select("_id", "_c", "_a", "_d").join(b, "_c").where("_a >= ra_low AND _a < ra_high AND _d >= dec_low").groupBy("_id").agg(F.max_by("label", "dec_low").alias(out))
    return p.join(found, "_id", "left").drop("_id", "_a", "_d", "_c")


#: Fixed values of Jupiter's turning: pole (right ascension, declination and their changes a century) and, of each system,
#: the angle at 2000 and its growth a day, in degrees.
JUPITER_POLE = (268.057, -0.006, 64.495, 0.002)
JUPITER_SYSTEMS = {"I": (67.1, 877.900), "II": (43.3, 870.270), "III": (284.95, 870.5360)}
LIGHT_DAYS_AU = 0.005775518331436995


def jupiter_meridian(system: str, jd, x, y, z) -> Column:
    """The longitude, growing with time, of Jupiter's central meridian in a system at a Julian date (TDB), seen from
    (x, y, z), the observer from Jupiter's centre in AU of the celestial frame; light's time is taken off."""
    x, y, z = map(col, (x, y, z))
    d = col(jd) - 2451545.0 - F.sqrt(x * x + y * y + z * z) * LIGHT_DAYS_AU
    century = (col(jd) - 2451545.0) / 36525
    a, p = ((century * JUPITER_POLE[i + 1] + JUPITER_POLE[i]) * (math.pi / 180) for i in (0, 2))
    start, growth = JUPITER_SYSTEMS[system]
    along = y * F.cos(a) - x * F.sin(a)  # towards the equator's node
    across = z * F.cos(p) - F.sin(p) * (x * F.cos(a) + y * F.sin(a))
    turn = (d * growth + start) * (math.pi / 180)
    return wrap_positive(turn - F.atan2(across, along))
