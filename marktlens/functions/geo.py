"""Distances on the globe and in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    cosine = F.cos(a) * F.cos(c) * F.cos(d - b) + F.sin(a) * F.sin(c)
    return F.lit(RADIUS_KM) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def within_radius(city: DataFrame, name: str, km: float) -> DataFrame:
    """Cities within a distance of the most populous one called so, with or without a suffix after a comma; none if there is
    no such city. The centre is a single row."""
    called = F.col("name").ilike(name) | F.col("name").ilike(f"{name},%")
    centre = city.filter(called).agg(F.max_by(F.struct("lat", "lon"), F.struct(F.coalesce("pop_total", F.lit(0)), -F.col("id"))).alias("_c"))
    rows = city.join(F.broadcast(centre), F.col("_c").isNotNull())
    return rows.withColumn("km", great_circle_km(F.col("_c.lat"), F.col("_c.lon"), F.col("lat"), F.col("lon"))).filter(F.col("km") <= km).drop("_c")


#: Population bands of the city filter.
BANDS = {"small": (12_000, 49_999), "medium": (50_000, 199_999), "large": (200_000, 499_999), "metropolis": (500_000, 4_000_000)}


def in_bands(pop: Column, bands: list[str]) -> Column:
    found = F.lit(False)
    for b in bands:
        found = found | pop.between(*BANDS[b])
    return found
