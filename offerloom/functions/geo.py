"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The place on the unit sphere."""
    phi, theta = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half_lat, half_lon = f"(radians({lat2} - {lat1}) / 2)", f"(radians({lon2} - {lon1}) / 2)"
    return (
        f"({2 * EARTH_RADIUS_KM}::DOUBLE * asin(sqrt(sin({half_lat}) * sin({half_lat}) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * sin({half_lon}) * sin({half_lon}))))"
    )


def box_deltas(lat: Column, radius_km: Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of the box around a circle."""
    d_lat = radius_km / F.lit(KM_PER_DEGREE)
    d_lon = radius_km / F.greatest(F.lit(0.1), F.cos(F.radians(lat)) * F.lit(KM_PER_DEGREE))
    return d_lat, d_lon
