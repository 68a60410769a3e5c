"""Planets and meteor showers: positions, visibility, milestones, peaks, and the timeline of what comes in the sky.

Positions come from an Arrow function over (planet, Julian date), since Kepler's equation is iterated; milestones are
found on a grid of days with window functions and refined by the same function.  Showers are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import sky

# Published mean elements at J2000 and their change a century, as
# (semi-major axis, eccentricity, inclination, mean longitude, perihelion, node).
ELEMENTS = {
    "Mercury": ((0.38709927, 0.00000037), (0.20563593, 0.00001906), (7.00497902, -0.00594749), (252.25032350, 149472.67411175), (77.45779628, 0.16047689), (48.33076593, -0.12534081)),
    "Venus": ((0.72333566, 0.00000390), (0.00677672, -0.00004107), (3.39467605, -0.00078890), (181.97909950, 58517.81538729), (131.60246718, 0.00268329), (76.67984255, -0.27769418)),
    "Earth": ((1.00000261, 0.00000562), (0.01671123, -0.00004392), (-0.00001531, -0.01294668), (100.46457166, 35999.37244981), (102.93768193, 0.32327364), (0.0, 0.0)),
    "Mars": ((1.52371034, 0.00001847), (0.09339410, 0.00007882), (1.84969142, -0.00813131), (-4.55343205, 19140.30268499), (-23.94362959, 0.44441088), (49.55953891, -0.29257343)),
    "Jupiter": ((5.20288700, -0.00011607), (0.04838624, -0.00013253), (1.30439695, -0.00183714), (34.39644051, 3034.74612775), (14.72847983, 0.21252668), (100.47390909, 0.20469106)),
    "Saturn": ((9.53667594, -0.00125060), (0.05386179, -0.00050991), (2.48599187, 0.00193609), (49.95424423, 1222.49362201), (92.59887831, -0.41897216), (113.66242448, -0.28867794)),
    "Uranus": ((19.18916464, -0.00196176), (0.04725744, -0.00004397), (0.77263783, -0.00242939), (313.23810451, 428.48202785), (170.95427630, 0.40805281), (74.01692503, 0.04240589)),
    "Neptune": ((30.06992276, 0.00026291), (0.00859048, 0.00005105), (1.77004347, 0.00035372), (-55.12002969, 218.45945325), (44.96476227, -0.32241464), (131.78422574, -0.00508664)),
}
# Magnitude at unit distances and its cubic in the phase angle.
BRIGHTNESS = {
    "Mercury": (-0.42, 0.0380, -0.000273, 0.000002), "Venus": (-4.40, 0.0009, 0.000239, -0.00000065), "Mars": (-1.52, 0.0160, 0.0, 0.0), "Jupiter": (-9.40, 0.0050, 0.0, 0.0),
    "Saturn": (-8.88, 0.0, 0.0, 0.0), "Uranus": (-7.19, 0.0, 0.0, 0.0), "Neptune": (-6.87, 0.0, 0.0, 0.0),
}
PLANETS = tuple(BRIGHTNESS)
INNER = ("Mercury", "Venus")
NAKED_EYE = ("Mercury", "Venus", "Mars", "Jupiter", "Saturn")
ALL_NIGHT, SEARCH_DAYS = 120.0, 820
# Name, radiant, parent body, the sun's longitude at the peak, meteors an hour.
SHOWERS = (
    ("Quadrantids", "Boötes", "asteroid 2003 EH1", 283.15, 110), ("Lyrids", "Lyra", "comet Thatcher", 32.32, 18), ("Eta Aquariids", "Aquarius", "comet Halley", 45.5, 50),
    ("Southern Delta Aquariids", "Aquarius", "comet 96P/Machholz", 127.0, 25), ("Alpha Capricornids", "Capricornus", "comet 169P/NEAT", 127.0, 5), ("Perseids", "Perseus", "comet Swift-Tuttle", 140.0, 100),
    ("Draconids", "Draco", "comet 21P/Giacobini-Zinner", 195.4, 10), ("Orionids", "Orion", "comet Halley", 208.0, 20), ("Southern Taurids", "Taurus", "comet 2P/Encke", 223.0, 5),
    ("Leonids", "Leo", "comet Tempel-Tuttle", 235.27, 15), ("Geminids", "Gemini", "asteroid 3200 Phaethon", 262.2, 150), ("Ursids", "Ursa Minor", "comet 8P/Tuttle", 270.7, 10),
)
DIMMED, WASHED_OUT = 0.30, 0.60
VIEW = StructType([StructField(c, DoubleType()) for c in ("elongation", "offset", "magnitude", "distance_au")])


def _turned(degrees: np.ndarray) -> np.ndarray:
    """An angle between -180 and 180."""
    return (np.asarray(degrees) + 180) % 360 - 180


def positions(name: str, t: np.ndarray) -> np.ndarray:
    """Heliocentric ecliptic coordinates, one row an instant, in centuries since J2000."""
    a, e, tilt, longitude, perihelion, node = (base + change * t for base, change in ELEMENTS[name])
    mean = np.radians(_turned(longitude - perihelion))
    anomaly = mean + e * np.sin(mean)
    for _ in range(12):
        step = (mean - anomaly + e * np.sin(anomaly)) / (1 - e * np.cos(anomaly))
        anomaly = anomaly + step
        if np.abs(step).max(initial=0) < 1e-11:
            break
    x, y = a * (np.cos(anomaly) - e), a * np.sqrt(1 - e * e) * np.sin(anomaly)
    # turned by the argument of the perihelion, the inclination and the node, one after the other
    w, i, o = np.radians(perihelion - node), np.radians(tilt), np.radians(node)
    x, y = x * np.cos(w) - y * np.sin(w), x * np.sin(w) + y * np.cos(w)
    y, z = y * np.cos(i), y * np.sin(i)
    return np.stack([x * np.cos(o) - y * np.sin(o), x * np.sin(o) + y * np.cos(o), z], axis=1)


def views(name: str, jd: np.ndarray) -> dict[str, np.ndarray]:
    """How a planet is seen from the earth: elongation, signed offset from the sun, magnitude and distance."""
    t = (np.asarray(jd, float) - 2451545.0) / 36525
    body, earth = positions(name, t), positions("Earth", t)
    seen = body - earth
    r, far, own = (np.sqrt((v * v).sum(1)) for v in (body, earth, seen))
    own = np.maximum(own, 1e-9)
    angle = lambda p, q, opposite: np.degrees(np.arccos(np.clip((p * p + q * q - opposite * opposite) / (2 * p * q), -1, 1)))
    phase = angle(r, own, far)
    sun = np.degrees(np.arctan2(-earth[:, 1], -earth[:, 0]))
    offset = _turned(np.degrees(np.arctan2(seen[:, 1], seen[:, 0])) - sun)
    base, *curve = BRIGHTNESS[name]
    magnitude = base + 5 * np.log10(np.maximum(r * own, 1e-12)) + sum(c * phase**k for k, c in enumerate(curve, 1))
    return {"elongation": angle(far, own, r), "offset": offset, "magnitude": magnitude, "distance_au": own}


@F.pandas_udf(VIEW)
def observed(planet: pd.Series, jd: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(index=planet.index, columns=["elongation", "offset", "magnitude", "distance_au"], dtype=float)
    for name, part in jd.groupby(planet.to_numpy()):
        for column, values in views(name, part.to_numpy()).items():
            out.loc[part.index, column] = values
    return out


def glare(magnitude: Column) -> Column:
    """How near to the sun a planet of this brightness is lost."""
    return F.least(F.greatest(18 + 2 * magnitude, F.lit(10.0)), F.lit(24.0))


def visibility(view: Column) -> Column:
    seen = F.when(view["elongation"] < glare(view["magnitude"]), "lost").when(view["elongation"] >= ALL_NIGHT, "all_night")
    return seen.when(view["offset"] > 0, "evening").otherwise("morning")


def _each_planet(instants: DataFrame) -> DataFrame:
    return instants.select("*", F.explode(F.array(*[F.lit(p) for p in PLANETS])).alias("planet"))


def planets(instants: DataFrame) -> DataFrame:
    """(at, planet, naked_eye, visibility, elongation, magnitude, distance_au, place) for instants in ``at``.

    ``place`` orders the planets of an instant: those lost in the sun's light last, brighter ones first.
    """
    seen = _each_planet(instants).withColumn("v", observed("planet", sky.julian_date(F.col("at")))).withColumn("visibility", visibility(F.col("v")))
    order = W.partitionBy("at").orderBy(F.col("visibility") == "lost", "v.magnitude")
    return seen.select(
        "at", "planet", F.col("planet").isin(*NAKED_EYE).alias("naked_eye"), "visibility", "v.elongation", "v.magnitude", "v.distance_au", F.row_number().over(order).alias("place")
    )


def _refine(inner: bool):
    """Three-point peaks are closed in by thirds, crossings by halves, forty rounds each."""

    @F.pandas_udf(DoubleType())
    def run(planet: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = pd.Series(index=planet.index, dtype=float)
        for name, part in low.groupby(planet.to_numpy()):
            a, b = part.to_numpy(float), high[part.index].to_numpy(float)
            for _ in range(40):
                if inner:
                    p, q = a + (b - a) / 3, b - (b - a) / 3
                    rising = views(name, p)["elongation"] < views(name, q)["elongation"]
                    a, b = np.where(rising, p, a), np.where(rising, b, q)
                else:
                    middle = (a + b) / 2
                    before = _turned(views(name, middle)["offset"] - 180) > 0
                    a, b = np.where(before, middle, a), np.where(before, b, middle)
            out[part.index] = (a + b) / 2
        return out

    return run


def milestones(instants: DataFrame) -> DataFrame:
    """(from, planet, milestone, at, elongation): the next greatest elongation of inner planets, opposition of the others."""
    start = instants.select(F.col("at").alias("from"), sky.julian_date(F.col("at")).alias("jd0"))
    grid = _each_planet(start).select("from", "jd0", "planet", F.explode(F.sequence(F.lit(0), F.lit(SEARCH_DAYS))).alias("day"))
    grid = grid.withColumn("v", observed("planet", F.col("jd0") + F.col("day"))).withColumn("gap", F.pmod(F.col("v.offset") - 180 + 180, F.lit(360.0)) - 180)
    line = W.partitionBy("from", "planet").orderBy("day")
    before, after = F.lag("v.elongation").over(line), F.lead("v.elongation").over(line)
    gap_before = F.lag("gap").over(line)
    inner = F.col("planet").isin(*INNER)
    peak = (F.col("v.elongation") > before) & (F.col("v.elongation") >= after)
    crossing = (gap_before > 0) & (F.col("gap") <= 0) & (gap_before < 90) & (F.col("gap") > -90)
    found = grid.withColumn("hit", F.when(inner, peak).otherwise(crossing)).where("hit").groupBy("from", "jd0", "planet").agg(F.min("day").alias("day"))
    low, day = F.col("jd0") + F.col("day") - 1, F.col("jd0") + F.col("day")
    at = F.when(inner, _refine(True)("planet", low, day + 1)).otherwise(_refine(False)("planet", low, day))
    told = found.withColumn("jd", at).withColumn("v", observed("planet", F.col("jd")))
    name = F.when(~inner, "opposition").when(F.col("v.offset") > 0, "greatest_eastern_elongation").otherwise("greatest_western_elongation")
    return told.select("from", "planet", name.alias("milestone"), sky.from_julian(F.col("jd")).alias("at"), "v.elongation")


def shower_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SHOWERS), "name string, radiant string, parent string, longitude double, hourly int")


def longitude_after(target: Column, jd: Column) -> Column:
    """The Julian date at which the sun next passes a longitude: a step by its mean speed, then halves of four days."""
    away = F.pmod(target - sky.sun_longitude(jd), F.lit(360.0))
    about = jd + away * (365.2422 / 360)
    short = lambda x: F.pmod(sky.sun_longitude(x) - target + 180, F.lit(360.0)) - 180
    ends = F.struct((about - 4).alias("a"), (about + 4).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        early = short(middle) < 0
        return F.struct(F.when(early, middle).otherwise(s["a"]).alias("a"), F.when(early, s["b"]).otherwise(middle).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(45)), ends, halve, lambda s: (s["a"] + s["b"]) / 2)


def shower_peaks(instants: DataFrame) -> DataFrame:
    """(from, name, radiant, parent, hourly, at, lit, moonlight): the next peak of every shower after each instant."""
    both = instants.select(F.col("at").alias("from")).join(F.broadcast(shower_table(instants.sparkSession)))  # twelve rows
    peaks = both.withColumn("jd", longitude_after(F.col("longitude"), sky.julian_date(F.col("from"))))
    lit = sky.illumination(F.col("jd"))
    moonlight = F.when(lit >= WASHED_OUT, "washed_out").when(lit >= DIMMED, "some").otherwise("dark")
    return peaks.select("from", "name", "radiant", "parent", "hourly", sky.from_julian(F.col("jd")).alias("at"), lit.alias("lit"), moonlight.alias("moonlight"))


LOOKBACK_DAYS, HORIZON_DAYS = 3, 400


def timeline(spark: SparkSession, now: str) -> DataFrame:
    """(kind, name, at): moon phases, eclipses in place of theirs, turnings of the year, showers and planets around ``now``.

    From three days before to 400 days after; a syzygy with an eclipse is the eclipse.
    """
    instant = F.to_timestamp(F.lit(now))
    year = F.year(instant)
    first = F.floor((year - 2000) * 12.3685 - 2).cast("int")
    k = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(66))).alias("n")).select((first + F.col("n") / 2).alias("k"))
    moons = sky.eclipses(k)
    full = F.pmod(F.col("k"), F.lit(1.0)) > 0.25
    phase = F.when(F.col("supermoon"), "supermoon").when(full, "full moon").otherwise("new moon")
    moons = moons.select(F.when(F.col("kind").isNull(), "moon").otherwise("eclipse").alias("kind"), F.coalesce(F.concat("kind", F.lit(" eclipse")), phase).alias("name"), "at")
    years = spark.range(1).select(F.explode(F.sequence(year - 1, year + 2)).alias("year"))
    names = ("March equinox", "June solstice", "September equinox", "December solstice")
    turns = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), sky.turning_instant(F.col("year"), q).alias("at")) for q, n in enumerate(names)])).alias("t")
    seasons = years.select(turns).select(F.lit("season").alias("kind"), "t.name", "t.at")
    start = spark.range(1).select((instant - F.expr(f"interval {LOOKBACK_DAYS} days")).alias("at"))
    showers = shower_peaks(start).select(F.lit("shower").alias("kind"), "name", "at")
    worlds = milestones(start).select(F.lit("planet").alias("kind"), F.concat_ws(" ", "planet", F.replace("milestone", F.lit("_"), F.lit(" "))).alias("name"), "at")
    span = (F.col("at") >= instant - F.expr(f"interval {LOOKBACK_DAYS} days")) & (F.col("at") <= instant + F.expr(f"interval {HORIZON_DAYS} days"))
    return moons.unionByName(seasons).unionByName(showers).unionByName(worlds).where(span)
