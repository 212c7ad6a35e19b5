"""Plane-of-array irradiance from global horizontal irradiance, as a few projections.

Sun position: Spencer (1971) Fourier series. Direct/diffuse split: Erbs, Klein and Duffie (1982).
Transposition: Liu and Jordan (1962) isotropic sky. Refraction is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fourier coefficients (constant, then cos/sin pairs of rising order).
DECLINATION = [0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148]
EQUATION_OF_TIME = [0.000075, 0.001868, -0.032077, -0.014615, -0.040849]
ECCENTRICITY = [1.00011, 0.034221, 0.00128, 0.000719, 0.000077]
# Diffuse share of a partly cloudy sky, by rising power of the clearness index.
ERBS_MIDDLE = [0.9511, -0.1604, 4.388, -16.638, 12.336]
SOLAR_CONSTANT = 1367.0
MIN_COS_ZENITH = 0.065
MAX_ZENITH = 87.0


def _fourier(angle: Column, coef: Sequence[float]) -> Column:
    out = F.lit(coef[0])
    for i, c in enumerate(coef[1:]):
        wave = F.cos if i % 2 == 0 else F.sin
        out = out + wave(angle * (i // 2 + 1)) * c
    return out


def _polynomial(x: Column, coef: Sequence[float]) -> Column:
    """Horner's scheme."""
    out = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        out = out * x + c
    return out


def diffuse_share(clearness: Column) -> Column:
    """Diffuse part of the irradiance by clearness of the sky."""
    return (
        F.when(clearness <= 0.22, 1.0 - clearness * 0.09)
        .when(clearness <= 0.8, _polynomial(clearness, ERBS_MIDDLE))
        .otherwise(F.lit(0.165))
    )


def _floor0(c: Column) -> Column:
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def add_sun_position(
    df: DataFrame, utc: str, tilt: float = 30.0, azimuth: float = 180.0, lat: float = 46.23, lon: float = 7.36
) -> DataFrame:
    """Add `_extra` (irradiance outside the atmosphere), `_cos_z` (zenith) and `_cos_i` (angle to the panel normal).

    Azimuth is clockwise from north. Each step is its own projection, because every step uses the one before several
    times: as one expression the generated code would repeat the series dozens of times.
    """
    t = F.col(utc)
    hours = F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0
    phi, beta, facing = math.radians(lat), math.radians(tilt), math.radians(azimuth)
    out = df.withColumns({"_angle": (F.dayofyear(t) - 1) * (2 * math.pi / 365), "_hours": hours})
    angle = F.col("_angle")
    correction = _fourier(angle, EQUATION_OF_TIME) * 229.18
    out = out.withColumns(
        {
            "_decl": _fourier(angle, DECLINATION),
            "_hour_angle": F.radians((F.col("_hours") + lon / 15.0 + correction / 60.0 - 12.0) * 15.0),
            "_extra": _fourier(angle, ECCENTRICITY) * SOLAR_CONSTANT,
        }
    )
    up, south = F.sin("_decl"), F.cos("_decl") * F.cos("_hour_angle")
    west = F.cos("_decl") * F.sin("_hour_angle")
    out = out.withColumns({"_up": up, "_south": south, "_west": west})
    cos_z = F.col("_up") * math.sin(phi) + F.col("_south") * math.cos(phi)
    to_north = F.col("_up") * math.cos(phi) - F.col("_south") * math.sin(phi)
    tilted = to_north * math.cos(facing) - F.col("_west") * math.sin(facing)
    return out.withColumns(
        {"_cos_z": cos_z, "_cos_i": cos_z * math.cos(beta) + tilted * math.sin(beta)}
    ).drop("_angle", "_hours", "_decl", "_hour_angle", "_up", "_south", "_west")


def add_poa_irradiance(
    df: DataFrame,
    utc: str = "utc_timestamp",
    ghi: str = "sion_forecast_global_radiation",
    out: str = "poa_irradiance",
    tilt: float = 30.0,
    azimuth: float = 180.0,
    lat: float = 46.23,
    lon: float = 7.36,
    albedo: float = 0.25,
) -> DataFrame:
    """Irradiance in W/m2 on a tilted panel; null where `ghi` is null, never negative. No shuffle, JVM only."""
    g, cos_z = F.col(ghi), F.col("_cos_z")
    clear = F.when(cos_z < MIN_COS_ZENITH, F.lit(MIN_COS_ZENITH)).otherwise(cos_z)
    sunned = add_sun_position(df, utc, tilt, azimuth, lat, lon).withColumn("_kt", g / (F.col("_extra") * clear))
    sunned = sunned.withColumn("_kt", F.when(F.col("_kt") > 1, F.lit(1.0)).otherwise(_floor0(F.col("_kt"))))
    sun_up = cos_z >= math.cos(math.radians(MAX_ZENITH))
    split = sunned.withColumn("_dhi", F.when(sun_up, g * diffuse_share(F.col("_kt"))).otherwise(g))
    split = split.withColumn("_dni", F.when(sun_up, (g - F.col("_dhi")) / cos_z).otherwise(F.lit(0.0)))
    sky = (1 + math.cos(math.radians(tilt))) / 2
    ground = albedo * (1 - math.cos(math.radians(tilt))) / 2
    beam = _floor0(F.col("_dni")) * _floor0(F.col("_cos_i"))
    total = split.withColumn(out, beam + _floor0(F.col("_dhi")) * sky + g * ground)
    return total.withColumn(out, _floor0(F.col(out))).drop("_extra", "_cos_z", "_cos_i", "_kt", "_dhi", "_dni")
