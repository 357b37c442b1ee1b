"""Distances and shapes on the sphere as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
#: The study area, ends included.
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 20.0, 24.7, 68.0, 74.5


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_RADIUS_M)


def in_area(lat: Column, lon: Column) -> Column:
    """Inside the study area; false for missing or non-finite coordinates."""
    return F.coalesce(lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def grid_steps(size_m: float) -> tuple[float, float]:
    """Latitude and longitude steps of a square cell at the middle latitude of the study area."""
    return size_m / METRES_PER_DEGREE, size_m / (METRES_PER_DEGREE * math.cos(math.radians((LAT_MIN + LAT_MAX) / 2)))


def grid_cell(lat: Column, lon: Column, size_m: float) -> Column:
    """`row_col` of the fixed grid over the study area."""
    step_lat, step_lon = grid_steps(size_m)
    return F.concat_ws("_", F.floor((lat - LAT_MIN) / step_lat).cast("string"), F.floor((lon - LON_MIN) / step_lon).cast("string"))


def elongation(var_x: Column, var_y: Column, covar: Column) -> Column:
    """Smaller over larger eigenvalue of a population covariance: 0 for a line or a point, near 1 for a disc."""
    middle, spread = (var_x + var_y) / 2, F.sqrt(F.greatest(F.lit(0.0), (var_x - var_y) * (var_x - var_y) / 4 + covar * covar))
    large, small = middle + spread, F.greatest(F.lit(0.0), middle - spread)
    return F.when(large <= 1e-9, 0.0).otherwise(small / F.greatest(large, F.lit(1e-300)))


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the 3 by 3 degree raster tile of a point, by its south-west corner."""
    south, west = (F.floor(lat / 3) * 3).cast("int"), (F.floor(lon / 3) * 3).cast("int")
    return F.concat(
        F.when(south >= 0, "N").otherwise("S"), F.lpad(F.abs(south).cast("string"), 2, "0"), F.when(west >= 0, "E").otherwise("W"), F.lpad(F.abs(west).cast("string"), 3, "0")
    )
