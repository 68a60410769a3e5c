"""Ephemeris as column expressions: Julian dates, dynamical time, the sun's longitude, moon phases and lunations.

Everything is arithmetic on columns, so a series over ``sequence`` of instants stays in generated code.  The series
are the published low-precision ones of Meeus, "Astronomical Algorithms"; ``syzygy_instant`` is good to some minutes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIX_JD = 2440587.5
SYNODIC = 29.530588861
PHASES = ("new moon", "waxing crescent", "first quarter", "waxing gibbous", "full moon", "waning gibbous", "last quarter", "waning crescent")


def julian_date(at: Column) -> Column:
    return at.cast("timestamp").cast("double") / 86400 + UNIX_JD


def from_julian(jd: Column) -> Column:
    return F.timestamp_seconds((jd - UNIX_JD) * 86400)


def centuries(jd: Column) -> Column:
    return (jd - 2451545.0) / 36525


def delta_t(year: Column) -> Column:
    """Seconds from universal to dynamical time; published polynomials for 1986 to 2150, a parabola elsewhere."""
    t = year - 2000
    return (
        F.when((year >= 1986) & (year < 2005), 63.86 + 0.3345 * t - 0.060374 * t**2 + 0.0017275 * t**3 + 0.000651814 * t**4 + 0.00002373599 * t**5)
        .when((year >= 2005) & (year < 2050), 62.92 + 0.32217 * t + 0.005589 * t**2)
        .when((year >= 2050) & (year < 2150), -20 + 32 * ((year - 1820) / 100) ** 2 - 0.5628 * (2150 - year))
        .otherwise(-20 + 32 * ((year - 1820) / 100) ** 2)
    )


def normalised(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def _sin(degrees: Column) -> Column:
    return F.sin(degrees * (math.pi / 180))


def sun_longitude(jd: Column) -> Column:
    """Apparent geocentric longitude in degrees."""
    t = centuries(jd)
    mean = 280.46646 + 36000.76983 * t + 0.0003032 * t**2
    anomaly = 357.52911 + 35999.05029 * t - 0.0001537 * t**2
    centre = (1.914602 - 0.004817 * t) * _sin(anomaly) + (0.019993 - 0.000101 * t) * _sin(2 * anomaly) + 0.000289 * _sin(3 * anomaly)
    return normalised(mean + centre - 0.00569 - 0.00478 * _sin(125.04 - 1934.136 * t))


def lunation(year: Column) -> Column:
    """Number of lunations from the first new moon of 2000 to the year given with its fraction."""
    return (year - 2000) * 12.3685


#: Coefficients of the periodic terms, as (new moon, full moon, factors of sun, moon, latitude, power of E).
_SYZYGY = (
    (-0.40720, -0.40614, 0, 1, 0, 0), (0.17241, 0.17302, 1, 0, 0, 1), (0.01608, 0.01614, 0, 2, 0, 0), (0.01039, 0.01043, 0, 0, 2, 0),
    (0.00739, 0.00734, -1, 1, 0, 1), (-0.00514, -0.00515, 1, 1, 0, 1), (0.00208, 0.00209, 2, 0, 0, 2), (-0.00111, -0.00111, 0, 1, -2, 0),
    (-0.00057, -0.00057, 0, 1, 2, 0), (0.00056, 0.00056, 1, 2, 0, 1), (-0.00042, -0.00042, 0, 3, 0, 0), (0.00042, 0.00042, 1, 0, 2, 1),
    (0.00038, 0.00038, 1, 0, -2, 1), (-0.00024, -0.00024, -1, 2, 0, 1),
)


def lunation_near(jd: Column) -> Column:
    """The number of the lunation nearest to an instant, counted from the first new moon of 2000."""
    return F.round(lunation(2000 + centuries(jd) * 100))


def syzygy(k: Column) -> Column:
    """Julian ephemeris date of new moon (whole ``k``) or full moon (``k`` and a half)."""
    t = k / 1236.85
    e = 1 - 0.002516 * t - 0.0000074 * t**2
    sun = 2.5534 + 29.10535670 * k - 0.0000014 * t**2
    moon = 201.5643 + 385.81693528 * k + 0.0107582 * t**2
    latitude = 160.7108 + 390.67050284 * k - 0.0016118 * t**2
    node = 124.7746 - 1.56375588 * k + 0.0020672 * t**2
    full = F.pmod(k, F.lit(1.0)) > 0.25
    out = 2451550.09766 + SYNODIC * k + 0.00015437 * t**2 - 0.00017 * _sin(node)
    for new, at_full, s, m, f, power in _SYZYGY:
        size = F.when(full, at_full).otherwise(new)
        out = out + size * (e**power if power else F.lit(1.0)) * _sin(s * sun + m * moon + f * latitude)
    return out + 0.000325 * _sin(299.77 + 0.107408 * k - 0.009173 * t**2)


def syzygy_instant(k: Column) -> Column:
    """The same as an instant of universal time."""
    return from_julian(syzygy(k) - delta_t(2000 + k / 12.3685) / 86400)


def illumination(jd: Column) -> Column:
    """Share of the moon's disc that is lit."""
    t = centuries(jd)
    elongation = 297.8501921 + 445267.1114034 * t
    sun, moon = 357.5291092 + 35999.0502909 * t, 134.9633964 + 477198.8675055 * t
    angle = 180 - elongation - 6.289 * _sin(moon) + 2.100 * _sin(sun) - 1.274 * _sin(2 * elongation - moon) - 0.658 * _sin(2 * elongation) - 0.214 * _sin(2 * moon) - 0.110 * _sin(elongation)
    return (1 + F.cos(angle * (math.pi / 180))) / 2


def phase_name(jd: Column) -> Column:
    """Eighths of the cycle by mean elongation, centred on the four main phases."""
    elongation = normalised(297.8501921 + 445267.1114034 * centuries(jd))
    return F.element_at(F.array(*[F.lit(p) for p in PHASES]), (F.pmod(F.floor((elongation + 22.5) / 45), F.lit(8)) + 1).cast("int"))


def equinox_crossings(days: Column) -> Column:
    """True on the days on which the sun passes a multiple of 90 degrees."""
    before, after = sun_longitude(days), sun_longitude(days + 1)
    return F.floor(before / 90) != F.floor(after / 90)


#: Polynomials of the mean equinoxes and solstices of the years 1000 to 3000, from March on.
_TURNINGS = (
    (2451623.80984, 365242.37404, 0.05169, -0.00411, -0.00057), (2451716.56767, 365241.62603, 0.00325, 0.00888, -0.00030),
    (2451810.21715, 365242.01767, -0.11575, 0.00337, 0.00078), (2451900.05952, 365242.74049, -0.06223, -0.00823, 0.00032),
)
#: Their periodic terms, as (size, phase, speed).
_TURNING_TERMS = (
    (485, 324.96, 1934.136), (203, 337.23, 32964.467), (199, 342.08, 20.186), (182, 27.85, 445267.112), (156, 73.14, 45036.886), (136, 171.52, 22518.443),
    (77, 222.54, 65928.934), (74, 296.72, 3034.906), (70, 243.58, 9037.513), (58, 119.81, 33718.147), (52, 297.17, 150.678), (50, 21.02, 2281.226),
    (45, 247.54, 29929.562), (44, 325.15, 31555.956), (29, 60.93, 4443.417), (18, 155.12, 67555.328), (17, 288.79, 4562.452), (16, 198.04, 62894.029),
    (14, 199.76, 31436.921), (12, 95.39, 14577.848), (12, 287.11, 31931.756), (12, 320.81, 34777.259), (9, 227.73, 1222.114), (8, 15.45, 16859.074),
)


def _cos(degrees: Column) -> Column:
    return F.cos(degrees * (math.pi / 180))


def turning_point(year: Column, quarter: int) -> Column:
    """Julian ephemeris date of the March (0), June (1), September (2) or December (3) turning of a year."""
    y = (year - 2000) / 1000
    mean = sum((c * y**i for i, c in enumerate(_TURNINGS[quarter][1:], 1)), F.lit(_TURNINGS[quarter][0]))
    t = centuries(mean)
    w = 35999.373 * t - 2.47
    total = sum((a * _cos(b + c * t) for a, b, c in _TURNING_TERMS), F.lit(0.0))
    return mean + 0.00001 * total / (1 + 0.0334 * _cos(w) + 0.0007 * _cos(2 * w))


def turning_instant(year: Column, quarter: int) -> Column:
    return from_julian(turning_point(year, quarter) - delta_t(year + (quarter + 1) / 4.0) / 86400)


#: Terms of the moon's distance in metres, as (factors of elongation, sun, moon, latitude, size).
_DISTANCE = (
    (0, 0, 1, 0, -20905355), (2, 0, -1, 0, -3699111), (2, 0, 0, 0, -2955968), (0, 0, 2, 0, -569925), (0, 1, 0, 0, 48888), (0, 0, 0, 2, -3149),
    (2, 0, -2, 0, 246158), (2, -1, -1, 0, -152138), (2, 0, 1, 0, -170733), (2, -1, 0, 0, -204586), (0, 1, -1, 0, -129620), (1, 0, 0, 0, 108743),
    (0, 1, 1, 0, 104755), (2, 0, 0, -2, 10321), (0, 0, 1, -2, 79661), (4, 0, -1, 0, -34782), (0, 0, 3, 0, -23210), (4, 0, -2, 0, -21636),
    (2, 1, -1, 0, 24208), (2, 1, 0, 0, 30824), (1, 0, -1, 0, -8379), (1, 1, 0, 0, -16675), (2, -1, 1, 0, -12831), (2, 0, 2, 0, -10445),
    (4, 0, 0, 0, -11650), (2, 0, -3, 0, 14403), (0, 1, -2, 0, -7003), (2, -1, -2, 0, 10056), (1, 0, 1, 0, 6322), (2, -2, 0, 0, -9884),
    (0, 1, 2, 0, 5751), (2, -2, -1, 0, -4950), (2, 0, 1, -2, 4130), (4, -1, -1, 0, -3958), (3, 0, -1, 0, 3258), (2, 1, 1, 0, 2616),
    (4, -1, -2, 0, -1897), (0, 2, -1, 0, -2117), (2, 2, -1, 0, 2354), (4, 0, 1, 0, -1423), (0, 0, 4, 0, -1117), (4, -1, 0, 0, -1571),
    (1, 0, -2, 0, -1739), (0, 0, 2, -2, -4421), (0, 2, 1, 0, 1165), (2, 0, -1, -2, 8752),
)
SUPERMOON_KM = 360_000


def moon_distance(jd: Column) -> Column:
    """Kilometres between the centres of earth and moon at a Julian ephemeris date."""
    t = centuries(jd)
    d = 297.8501921 + 445267.1114034 * t - 0.0018819 * t**2
    sun, moon = 357.5291092 + 35999.0502909 * t - 0.0001536 * t**2, 134.9633964 + 477198.8675055 * t + 0.0087414 * t**2
    latitude, e = 93.2720950 + 483202.0175233 * t - 0.0036539 * t**2, 1 - 0.002516 * t - 0.0000074 * t**2
    terms = (size * (e ** abs(s) if s else F.lit(1.0)) * _cos(a * d + s * sun + m * moon + f * latitude) for a, s, m, f, size in _DISTANCE)
    return 385000.56 + sum(terms, F.lit(0.0)) / 1000


def eclipses(lunations: DataFrame) -> DataFrame:
    """Adds ``kind``, ``at`` and ``supermoon`` for each lunation ``k``: new moons are whole, full moons have a half.

    ``kind`` is null without an eclipse; ``at`` is the instant of the syzygy.  Angles and sizes are columns of
    their own, so that no series is written out twice in the plan.
    """
    k, e, f, sun, moon = F.col("k"), F.col("__e"), F.col("__f"), F.col("__sun"), F.col("__moon")
    gamma, u, full = F.col("__gamma"), F.col("__u"), F.pmod(F.col("k"), F.lit(1.0)) > 0.25
    t = k / 1236.85
    node = 124.7746 - 1.56375588 * k + 0.0020672 * t**2
    angles = {
        "__jd": syzygy(k),
        "__e": 1 - 0.002516 * t - 0.0000074 * t**2,
        "__sun": 2.5534 + 29.10535670 * k - 0.0000014 * t**2,
        "__moon": 201.5643 + 385.81693528 * k + 0.0107582 * t**2,
        "__f": 160.7108 + 390.67050284 * k - 0.0016118 * t**2 - 0.02665 * _sin(node),
    }
    p = 0.2070 * e * _sin(sun) + 0.0024 * e * _sin(2 * sun) - 0.0392 * _sin(moon) + 0.0116 * _sin(2 * moon) - 0.0073 * e * _sin(moon + sun) + 0.0067 * e * _sin(moon - sun) + 0.0118 * _sin(2 * f)
    q = 5.2207 - 0.0048 * e * _cos(sun) + 0.0020 * e * _cos(2 * sun) - 0.3299 * _cos(moon) - 0.0060 * e * _cos(moon + sun) + 0.0041 * e * _cos(moon - sun)
    sizes = {
        "__gamma": F.abs((p * _cos(f) + q * _sin(f)) * (1 - 0.0048 * F.abs(_cos(f)))),
        "__u": 0.0059 + 0.0046 * e * _cos(sun) - 0.0182 * _cos(moon) + 0.0004 * _cos(2 * moon) - 0.0005 * _cos(sun + moon),
    }
    hybrid = (u <= 0.0047) & (u < 0.00464 * F.sqrt(F.greatest(1 - gamma**2, F.lit(0.0))))
    central = F.when(u < 0, "total solar").when(hybrid, "hybrid solar").otherwise("annular solar")
    solar = F.when(gamma < 0.9972, central).when(gamma < 1.5433 + u, "partial solar")
    umbral, penumbral = (1.0128 - u - gamma) / 0.5450, (1.5573 + u - gamma) / 0.5450
    lunar = F.when(umbral >= 1, "total lunar").when(umbral > 0, "partial lunar").when(penumbral > 0, "penumbral lunar")
    found = {
        "kind": F.when(F.abs(_sin(f)) <= 0.36, F.when(full, lunar).otherwise(solar)),
        "at": from_julian(F.col("__jd") - delta_t(2000 + k / 12.3685) / 86400),
        "supermoon": full & (moon_distance(F.col("__jd")) < SUPERMOON_KM),
    }
    return lunations.withColumns(angles).withColumns(sizes).withColumns(found).drop(*angles, *sizes)
