"""Distances, durations and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_round

EARTH_KM = 6371.0
#: Detour over the straight line, and speeds in km/h. Fixed values.
DETOUR = 1.3
SPEEDS = {"walk": 4.5, "bike": 14.0, "transit": 18.0, "car": 45.0, "scooter": 22.0}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def estimated_minutes(km: Column, mode: str) -> Column:
    return js_round(km * DETOUR / SPEEDS[mode] * 60).cast("int")


def converted_minutes(minutes: Column, old: str, new: str) -> Column:
    return js_round(minutes * SPEEDS[old] / SPEEDS[new]).cast("int")


def distances(lat: Column, lon: Column, points: Column, known: Column | None = None) -> Column:
    """array(struct(label, mode, km, minutes)) for ``points`` array(struct(label, mode, lat, lon)); a known transit time
    (map by label) replaces the estimate."""

    def one(p: Column) -> Column:
        km = haversine_km(lat, lon, p["lat"], p["lon"])
        guess = F.coalesce(*[F.when(p["mode"] == m, estimated_minutes(km, m)) for m in SPEEDS])
        real = F.when(p["mode"] == "transit", known[p["label"]]) if known is not None else F.lit(None).cast("int")
        return F.struct(
            p["label"].alias("label"), p["mode"].alias("mode"), F.round(km, 3).alias("km"),
            F.coalesce(real, guess).cast("int").alias("minutes"),
        )

    return F.when(lat.isNotNull() & lon.isNotNull(), F.transform(points, one))


#: Reference rent a square metre: of all sizes, of one and two rooms, of more. Fixed values.
RENT_ALL, RENT_SMALL, RENT_LARGE = 20.43, 22.74, 19.73


def reference_rent(rooms: Column) -> Column:
    """By the number of rooms; an unknown one has the value of all sizes."""
    return F.when(rooms.isNull(), RENT_ALL).when(rooms <= 2, RENT_SMALL).otherwise(RENT_LARGE)
