"""Spherical geometry, frame rotations and map projections as columns. Angles are radians."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperflow.functions.angles import wrap_positive, wrap_signed
from vesperflow.functions.mathx import col, let

#: The J2000 equatorial to galactic rotation (IAU 1958 pole and origin, FK5).
GALACTIC = ((-0.0548755604, -0.8734370902, -0.4838350155), (0.4941094279, -0.4448296300, 0.7469822445), (-0.8676661490, -0.1980763734, 0.4559837762))
#: Mean obliquity at J2000, IAU 2006: 84381.406 arcseconds.
OBLIQUITY = 84381.406 * math.pi / 648000


def separation(a1, d1, a2, d2) -> Column:
    """Great-circle distance in the arctangent form, exact for small and large angles alike."""
    a1, d1, a2, d2 = map(col, (a1, d1, a2, d2))
    da = a2 - a1
    x = F.cos(d2) * F.sin(da)
    y = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)
    z = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(da)
    return F.atan2(F.sqrt(x * x + y * y), z)


def haversine(a1, d1, a2, d2) -> Column:
    a1, d1, a2, d2 = map(col, (a1, d1, a2, d2))
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin((a2 - a1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2


def position_angle(a1, d1, a2, d2) -> Column:
    """Direction of the second point from the first, from north through east, in [0, 2 pi)."""
    a1, d1, a2, d2 = map(col, (a1, d1, a2, d2))
    da = a2 - a1
    return wrap_positive(F.atan2(F.sin(da) * F.cos(d2), F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)))


def destination(a, d, angle, distance) -> tuple[Column, Column]:
    """The point at a distance in a direction."""
    a, d, angle, distance = map(col, (a, d, angle, distance))
    s = F.sin(d) * F.cos(distance) + F.cos(d) * F.sin(distance) * F.cos(angle)
    return wrap_positive(a + F.atan2(F.sin(angle) * F.sin(distance) * F.cos(d), F.cos(distance) - F.sin(d) * s)), F.asin(s)


def unit(a, d) -> tuple[Column, Column, Column]:
    a, d = col(a), col(d)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def rotate(m, a, d) -> tuple[Column, Column]:
    """Longitude and latitude after a fixed rotation."""
    v = unit(a, d)
    x, y, z = (v[0] * F.lit(r[0]) + v[1] * F.lit(r[1]) + v[2] * F.lit(r[2]) for r in m)
    return wrap_positive(F.atan2(y, x)), F.atan2(z, F.sqrt(x * x + y * y))


def _transpose(m):
    return tuple(zip(*m, strict=True))


def to_galactic(a, d) -> tuple[Column, Column]:
    return rotate(GALACTIC, a, d)


def from_galactic(a, d) -> tuple[Column, Column]:
    return rotate(_transpose(GALACTIC), a, d)


def _about_x(t: float):
    return ((1.0, 0.0, 0.0), (0.0, math.cos(t), math.sin(t)), (0.0, -math.sin(t), math.cos(t)))


def to_ecliptic(a, d, obliquity: float = OBLIQUITY) -> tuple[Column, Column]:
    return rotate(_about_x(obliquity), a, d)


def from_ecliptic(a, d, obliquity: float = OBLIQUITY) -> tuple[Column, Column]:
    return rotate(_about_x(-obliquity), a, d)


def precession_matrix(jd: float):
    """J2000 to the mean equator and equinox of a date, IAU 1976 angles."""
    t = (jd - 2451545.0) / 36525
    s = math.pi / 648000
    zeta, z, theta = ((2306.2181 * t + 0.30188 * t**2 + 0.017998 * t**3) * s, (2306.2181 * t + 1.09468 * t**2 + 0.018203 * t**3) * s, (2004.3109 * t - 0.42665 * t**2 - 0.041833 * t**3) * s)
    cz, sz, ct, st, ce, se = math.cos(z), math.sin(z), math.cos(theta), math.sin(theta), math.cos(zeta), math.sin(zeta)
    return ((cz * ct * ce - sz * se, -cz * ct * se - sz * ce, -cz * st), (sz * ct * ce + cz * se, -sz * ct * se + cz * ce, -sz * st), (st * ce, -st * se, ct))


def precess(a, d, jd: float) -> tuple[Column, Column]:
    return rotate(precession_matrix(jd), a, d)


def to_horizontal(a, d, latitude, sidereal) -> tuple[Column, Column]:
    """(azimuth from north through east, altitude)."""
    a, d, phi = map(col, (a, d, latitude))
    h = col(sidereal) - a
    x = F.cos(phi) * F.sin(d) - F.sin(phi) * F.cos(d) * F.cos(h)
    y = -F.cos(d) * F.sin(h)
    return wrap_positive(F.atan2(y, x)), F.asin(F.sin(phi) * F.sin(d) + F.cos(phi) * F.cos(d) * F.cos(h))


def from_horizontal(azimuth, altitude, latitude, sidereal) -> tuple[Column, Column]:
    az, alt, phi = map(col, (azimuth, altitude, latitude))
    s = F.sin(phi) * F.sin(alt) + F.cos(phi) * F.cos(alt) * F.cos(az)
    h = F.atan2(-F.cos(alt) * F.sin(az), F.cos(phi) * F.sin(alt) - F.sin(phi) * F.cos(alt) * F.cos(az))
    return wrap_positive(col(sidereal) - h), F.asin(s)


def parallactic_angle(hour_angle, d, latitude) -> Column:
    h, d, phi = map(col, (hour_angle, d, latitude))
    return F.atan2(F.sin(h), F.tan(phi) * F.cos(d) - F.sin(d) * F.cos(h))


def edge_excess(a1, d1, a2, d2) -> Column:
    """Twice the signed spherical excess between an edge and the equator; summed over a closed ring and doubled it is the area."""
    t = F.tan(wrap_signed(col(a2) - col(a1)) / 2)
    b1, b2 = F.tan(col(d1) / 2), F.tan(col(d2) / 2)
    return F.atan(t * (b1 + b2) / (F.lit(1.0) + b1 * b2)) * 2


# ---- projections: each gives (x, y) of a point, null where it is not shown ------------------------------------------


def _azimuthal(a, d, a0: float, d0: float):
    a, d = col(a) - a0, col(d)
    c = F.sin(d) * math.sin(d0) + F.cos(d) * math.cos(d0) * F.cos(a)
    return F.cos(d) * F.sin(a), F.sin(d) * math.cos(d0) - F.cos(d) * math.sin(d0) * F.cos(a), c


def _scaled(x, y, k, shown):
    return F.when(shown, x * k), F.when(shown, y * k)


def gnomonic(a, d, a0: float = 0.0, d0: float = 0.0):
    x, y, c = _azimuthal(a, d, a0, d0)
    return _scaled(x, y, F.lit(1.0) / F.when(c > 1e-12, c), c > 1e-12)


def stereographic(a, d, a0: float = 0.0, d0: float = 0.0):
    x, y, c = _azimuthal(a, d, a0, d0)
    return _scaled(x, y, F.lit(2.0) / F.when(c > -1 + 1e-12, c + 1), c > -1 + 1e-12)


def orthographic(a, d, a0: float = 0.0, d0: float = 0.0):
    x, y, c = _azimuthal(a, d, a0, d0)
    return _scaled(x, y, F.lit(1.0), c >= 0)


def azimuthal_equidistant(a, d, a0: float = 0.0, d0: float = 0.0):
    x, y, c = _azimuthal(a, d, a0, d0)
    z = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))
    return _scaled(x, y, F.when(z > 1e-12, z / F.sin(z)).otherwise(1.0), c > -1 + 1e-12)


def azimuthal_equal_area(a, d, a0: float = 0.0, d0: float = 0.0):
    x, y, c = _azimuthal(a, d, a0, d0)
    return _scaled(x, y, F.sqrt(F.lit(2.0) / F.when(c > -1 + 1e-12, c + 1)), c > -1 + 1e-12)


def plate_carree(a, d, a0: float = 0.0, d0: float = 0.0):
    return wrap_signed(col(a) - a0), col(d) - d0


def equirectangular(a, d, a0: float = 0.0, d0: float = 0.0):
    return wrap_signed(col(a) - a0) * math.cos(d0), col(d) - d0


def mercator(a, d, a0: float = 0.0, d0: float = 0.0):
    d = col(d)
    shown = F.abs(d) < math.pi / 2 - 1e-9
    return F.when(shown, wrap_signed(col(a) - a0)), F.when(shown, F.log(F.tan(d / 2 + math.pi / 4)))


def cylindrical_equal_area(a, d, a0: float = 0.0, d0: float = 0.0):
    return wrap_signed(col(a) - a0) * math.cos(d0), F.sin(col(d)) / math.cos(d0)


def miller(a, d, a0: float = 0.0, d0: float = 0.0):
    return wrap_signed(col(a) - a0), F.log(F.tan(col(d) * 0.4 + math.pi / 4)) * 1.25


def sinusoidal(a, d, a0: float = 0.0, d0: float = 0.0):
    return wrap_signed(col(a) - a0) * F.cos(col(d)), col(d)


def aitoff(a, d, a0: float = 0.0, d0: float = 0.0):
    l, d = wrap_signed(col(a) - a0) / 2, col(d)
    z = F.acos(F.cos(d) * F.cos(l))
    k = F.when(z > 1e-12, z / F.sin(z)).otherwise(1.0)
    return F.cos(d) * F.sin(l) * k * 2, F.sin(d) * k


def hammer(a, d, a0: float = 0.0, d0: float = 0.0):
    l, d = wrap_signed(col(a) - a0) / 2, col(d)
    k = F.sqrt(F.lit(2.0) / (F.cos(d) * F.cos(l) + 1))
    return F.cos(d) * F.sin(l) * k * 2, F.sin(d) * k


def gnomonic_inverse(x, y, a0: float = 0.0, d0: float = 0.0):
    x, y = col(x), col(y)
    r = F.sqrt(x * x + y * y + 1)
    return wrap_positive(F.atan2(x, F.lit(math.cos(d0)) - y * math.sin(d0)) + a0), F.asin((y * math.cos(d0) + math.sin(d0)) / r)


def mercator_inverse(x, y, a0: float = 0.0, d0: float = 0.0):
    return wrap_positive(col(x) + a0), F.atan(F.exp(col(y))) * 2 - math.pi / 2


def azimuthal_inverse(name: str, x, y, a0: float = 0.0, d0: float = 0.0):
    """(ra, decl) of a point of an azimuthal projection; null outside its disc."""
    x, y = col(x), col(y)
    rho = F.sqrt(x * x + y * y)
    angle, shown = {
        "gnomonic": (F.atan(rho), F.lit(True)), "stereographic": (F.atan(rho / 2) * 2, F.lit(True)), "orthographic": (F.asin(F.least(rho, F.lit(1.0))), rho <= 1 + 1e-12),
        "azimuthal_equidistant": (rho, rho <= math.pi + 1e-12), "azimuthal_equal_area": (F.asin(F.least(rho / 2, F.lit(1.0))) * 2, rho <= 2 + 1e-12),
    }[name]
    sc, cc = F.sin(angle), F.cos(angle)
    k = F.when(rho > 1e-300, sc / rho).otherwise(1.0)
    dec = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cc * math.sin(d0) + y * k * math.cos(d0))))
    ra = wrap_positive(F.atan2(x * k, cc * math.cos(d0) - y * k * math.sin(d0)) + a0)
    return F.when(shown, ra), F.when(shown, dec)


#: Latitude up to which a square Mercator map reaches.
WEB_LIMIT = math.atan(math.sinh(math.pi))
#: Cylindrical projections by family and standard parallel (degrees).
CYLINDRICAL = {
    "mercator": ("mercator", 0.0), "web_mercator": ("web", 0.0), "miller": ("miller", 0.0), "central": ("central", 0.0), "lambert": ("area", 0.0), "behrmann": ("area", 30.0), "gall_peters": ("area", 45.0), "hobo_dyer": ("area", 37.5), "balthasart": ("area", 50.0), "trystan_edwards": ("area", 37.4),
    "braun": ("stereographic", 0.0), "gall": ("stereographic", 45.0), "plate_carree": ("distance", 0.0),
}


def _family(name: str, parallel: float | None) -> tuple[str, float]:
    family, own = CYLINDRICAL.get(name, (name, 0.0))
    return family, math.cos(math.radians(own if parallel is None else parallel))


def cylindrical(name: str, a, d, a0: float = 0.0, parallel: float | None = None, eccentricity: float = 0.0):
    """(x, y) by a name of CYLINDRICAL or a family (area, stereographic, distance, ellipsoidal) and its standard parallel
    in degrees. Mercator's maps of an ellipsoid are the family `ellipsoidal`. Null at the poles where they are far away."""
    family, k = _family(name, parallel)
    d = col(d)
    d = F.greatest(F.lit(-WEB_LIMIT), F.least(F.lit(WEB_LIMIT), d)) if family == "web" else d
    shown = F.abs(d) < math.pi / 2 - 1e-9
    y = {
        "mercator": lambda: F.asinh(F.tan(d)), "web": lambda: F.asinh(F.tan(d)), "miller": lambda: F.log(F.tan(d * 0.4 + math.pi / 4)) * 1.25, "central": lambda: F.tan(d), "area": lambda: F.sin(d) / k,
        "stereographic": lambda: F.tan(d / 2) * (1 + k), "distance": lambda: d, "ellipsoidal": lambda: F.atanh(F.sin(d)) - F.atanh(F.sin(d) * eccentricity) * eccentricity,
    }[family]()
    far = family in ("mercator", "central", "ellipsoidal")
    return F.when(shown if far else F.lit(True), wrap_signed(col(a) - a0) * k), F.when(shown if far else F.lit(True), y)


def cylindrical_inverse(name: str, x, y, a0: float = 0.0, parallel: float | None = None, eccentricity: float = 0.0):
    """(ra, decl) of a point of a cylindrical projection; an ellipsoid's latitude by five steps from the sphere's."""
    family, k = _family(name, parallel)
    y = col(y)

    def newton(d: Column) -> Column:
        s = F.sin(d)
        return d - (F.atanh(s) - F.atanh(s * eccentricity) * eccentricity - y) * F.cos(d) * (F.lit(1.0) - s * s * eccentricity**2) / (1 - eccentricity**2)

    sphere_ = F.atan(F.sinh(y))
    d = {
        "mercator": lambda: sphere_, "web": lambda: sphere_, "miller": lambda: (F.atan(F.exp(y * 0.8)) - math.pi / 4) * 2.5, "central": lambda: F.atan(y), "area": lambda: F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * k))),
        "stereographic": lambda: F.atan(y / (1 + k)) * 2, "distance": lambda: y, "ellipsoidal": lambda: reduce(lambda v, _: let(v, newton), range(5), sphere_),
    }[family]()
    return wrap_positive(col(x) / k + a0), d


PROJECTIONS = {f.__name__: f for f in (gnomonic, stereographic, orthographic, azimuthal_equidistant, azimuthal_equal_area, plate_carree, equirectangular, mercator, cylindrical_equal_area, miller, sinusoidal, aitoff, hammer)}
