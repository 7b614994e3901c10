"""Observation-planning formulas as columns. Values outside a formula's domain give null.

Lengths are millimetres, pixel sizes micrometres, image scales arcseconds a pixel, angles radians, temperatures Celsius.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesperflow.functions.mathx import col

ARCSEC = 648000 / math.pi
#: Arcseconds of sky that pass in a second of time.
SIDEREAL_RATE = 15.041067


def _pos(x) -> Column:
    return F.when(col(x) > 0, col(x))


def _nonneg(x) -> Column:
    return F.when(col(x) >= 0, col(x))


def magnification(telescope, eyepiece) -> Column:
    return _pos(telescope) / _pos(eyepiece)


def focal_length(aperture, ratio) -> Column:
    return _pos(aperture) * _pos(ratio)


def focal_ratio(focal, aperture) -> Column:
    return _pos(focal) / _pos(aperture)


def dawes_limit(aperture) -> Column:
    return F.lit(116.0) / _pos(aperture)


def rayleigh_limit(aperture) -> Column:
    return F.lit(138.0) / _pos(aperture)


def limiting_magnitude(aperture) -> Column:
    return F.log10(_pos(aperture)) * 5 + 2.7


def light_grasp(larger, smaller) -> Column:
    q = _pos(larger) / _pos(smaller)
    return F.when(q >= 1, q * q)


def eyepiece_view(telescope, aperture, eyepiece, field) -> Column:
    """struct(magnification, field, exit_pupil): what an eyepiece of an apparent field (degrees) shows."""
    m = magnification(telescope, eyepiece)
    return F.struct(m.alias("magnification"), (_pos(field) / m).alias("field"), (_pos(aperture) / m).alias("exit_pupil"))


def exit_pupil(length, divisor) -> Column:
    return _pos(length) / _pos(divisor)


def field_stop_fov(stop, telescope) -> Column:
    return _pos(stop) / _pos(telescope) * (180 / math.pi)


def plate_scale(telescope) -> Column:
    return F.lit(ARCSEC) / _pos(telescope)


def pixel_scale(pixel, telescope) -> Column:
    return _pos(pixel) * (ARCSEC / 1000) / _pos(telescope)


def sampling_ratio(seeing, scale) -> Column:
    return _pos(seeing) / _pos(scale)


def recommended_focal_length(pixel, sampling, seeing) -> Column:
    return _pos(pixel) * _pos(sampling) * (ARCSEC / 1000) / _pos(seeing)


def airy_disk(wavelength, ratio) -> Column:
    return _pos(wavelength) * _pos(ratio) * 2.44


def airy_disk_pixels(airy, pixel) -> Column:
    return _pos(airy) / _pos(pixel)


def critical_focus_zone(wavelength, ratio) -> Column:
    return _pos(wavelength) * _pos(ratio) * _pos(ratio) * 4.88


def effective_aperture(aperture, obstruction) -> Column:
    a, o = _pos(aperture), _nonneg(obstruction)
    return F.when(o < a, F.sqrt(a * a - o * o))


def obstruction_ratio(aperture, obstruction) -> Column:
    a, o = _pos(aperture), _nonneg(obstruction)
    return F.when(o <= a, o * 100 / a)


def diagonal_fov(diagonal, focal) -> Column:
    return F.atan(_pos(diagonal) / (_pos(focal) * 2)) * 2


def sensor_fov(size, focal) -> Column:
    return _pos(size) / _pos(focal) * (180 / math.pi)


def mosaic_panels(target, camera, overlap) -> Column:
    o = F.when((col(overlap) >= 0) & (col(overlap) < 1), col(overlap))
    return F.ceil(_pos(target) / (_pos(camera) * (F.lit(1.0) - o)))


def error_pixels(arcsec, scale) -> Column:
    return _nonneg(arcsec) / _pos(scale)


def star_trail(dec, seconds, scale) -> Column:
    return F.cos(col(dec)) * SIDEREAL_RATE * _nonneg(seconds) / _pos(scale)


def max_exposure(trail, scale, dec) -> Column:
    c = F.cos(col(dec))
    return F.when(c > 1e-12, _nonneg(trail) * _pos(scale) / (c * SIDEREAL_RATE))


def snr(signal, pixels, background, dark, read_noise) -> Column:
    s, n = _nonneg(signal), _nonneg(read_noise)
    v = s + _pos(pixels) * (_nonneg(background) + _nonneg(dark) + n * n)
    return F.when(v > 0, s / F.sqrt(v))


def stacking_snr_gain(n) -> Column:
    return F.sqrt(_pos(n))


def stacking_magnitude_gain(n) -> Column:
    return F.log10(_pos(n)) * 1.25


def dynamic_range(full_well, read_noise) -> Column:
    return _pos(full_well) / _pos(read_noise)


def dynamic_range_stops(full_well, read_noise) -> Column:
    return F.log2(dynamic_range(full_well, read_noise))


def saturation_time(full_well, rate) -> Column:
    return _pos(full_well) / _pos(rate)


def sky_limited_exposure(read_noise, rate) -> Column:
    n = _nonneg(read_noise)
    return n * n * 10 / _pos(rate)


def total_integration(n, seconds) -> Column:
    return _nonneg(n) * _nonneg(seconds)


def subframes(total, sub) -> Column:
    return _nonneg(total) / _pos(sub)


def required_subframes(total, sub) -> Column:
    return F.ceil(subframes(total, sub))


def airmass(zenith) -> Column:
    z = col(zenith)
    return F.when((z >= 0) & (z < math.pi / 2), F.lit(1.0) / F.cos(z))


def airmass_kasten_young(altitude) -> Column:
    h = F.when((col(altitude) > 0) & (col(altitude) <= math.pi / 2), col(altitude))
    return F.lit(1.0) / (F.sin(h) + F.pow(h * (180 / math.pi) + 6.07995, F.lit(-1.6364)) * 0.50572)


def extinction(k, mass) -> Column:
    return F.when(col(mass) >= 1, _nonneg(k) * col(mass))


def refraction(altitude) -> Column:
    """Arcminutes for an apparent altitude."""
    h = F.when((col(altitude) > 0) & (col(altitude) <= math.pi / 2), col(altitude) * (180 / math.pi))
    return F.lit(1.02) / F.tan((h + F.lit(10.3) / (h + 5.11)) * (math.pi / 180))


def _magnus(t) -> Column:
    t = F.when(col(t).between(-100, 100), col(t))
    return t * 17.625 / (t + 243.04)


def dew_point(temperature, humidity) -> Column:
    h = F.when((col(humidity) > 0) & (col(humidity) <= 100), col(humidity))
    a = _magnus(temperature) + F.log(h / 100)
    return a * 243.04 / (F.lit(17.625) - a)


def relative_humidity(temperature, dew) -> Column:
    return F.exp(_magnus(dew) - _magnus(temperature)) * 100


def altitude_at_transit(latitude, dec) -> Column:
    return F.lit(math.pi / 2) - F.abs(col(latitude) - col(dec))


def hour_angle_at(dec, latitude, altitude) -> Column:
    d, phi = col(dec), col(latitude)
    den = F.cos(phi) * F.cos(d)
    c = (F.sin(col(altitude)) - F.sin(phi) * F.sin(d)) / F.when(den != 0, den)
    return F.when(c.between(-1, 1), F.acos(c))


def angular_diameter(diameter, distance) -> Column:
    return F.atan(_pos(diameter) / (_pos(distance) * 2)) * 2


def surface_brightness(mag, area) -> Column:
    return col(mag) + F.log10(_pos(area)) * 2.5


def comet_magnitude(h, delta, distance, k) -> Column:
    return col(h) + F.log10(_pos(delta)) * 5 + col(k) * F.log10(_pos(distance))


def asteroid_magnitude(h, distance, delta, phase) -> Column:
    return col(h) + F.log10(_pos(distance) * _pos(delta)) * 5 + col(phase)


def hg_magnitude(h, g, distance, delta, phase) -> Column:
    """The two-parameter phase law of Bowell et al. (1989)."""
    t = F.tan(col(phase) / 2)
    p1, p2 = F.exp(F.pow(t, F.lit(0.63)) * -3.33), F.exp(F.pow(t, F.lit(1.22)) * -1.87)
    return col(h) + F.log10(_pos(distance) * _pos(delta)) * 5 - F.log10((F.lit(1.0) - col(g)) * p1 + col(g) * p2) * 2.5
