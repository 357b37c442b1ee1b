"""Joins by distance as equi-joins on grid cells with a residual distance filter.

Cells only propose candidates: a cell is at least as wide as the search distance anywhere up to the latitude that a search
is given, so a point's partners lie in its own cell and the 8 around it. A search for a nearest row without a cap goes down a
hierarchy of cubes around the globe instead. No cross join of tables, no broadcast that grows with the data; a dense cell is a
skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine
from ..plans.storage import stored

#: The study area lies below this latitude.
AREA_LAT = 25.0
#: Up to here a layer of points is broadcast: some 5 MB.
BROADCAST_POINTS = 100_000
#: A radius is the distance of its farthest member; another point at that place must match whatever the last bits are.
RADIUS_SLACK = 1e-6
#: Sides of the cubes of `nearest_pairs`, in Earth radii: 3,200 km down to 32 m. The grid has at most so many across.
CUBE_SIDES = (0.5, 0.05, 0.005, 0.0005, 0.00005, 0.000005)
CUBES_ACROSS = 1_000_000
#: What rounding can add to a chord, in Earth radii: far under a millimetre.
CHORD_SLACK = 1e-12
#: Places of a metre to which distances are ranked.
TIE_DIGITS = 3


def cells_of(lat: Column, lon: Column, size_m: float, most_lat: float) -> tuple[Column, Column]:
    """Cells at least size_m wide up to a latitude."""
    step_lat = size_m / 110_500
    step_lon = size_m / (111_100 * math.cos(math.radians(most_lat)))
    return F.floor(lat / step_lat).cast("long"), F.floor(lon / step_lon).cast("long")


def _around(cell: Column) -> Column:
    return F.explode(F.array(cell - 1, cell, cell + 1))


def _neighbourhood(points: DataFrame, size_m: float, most_lat: float) -> DataFrame:
    i, j = cells_of(F.col("lat"), F.col("lon"), size_m, most_lat)
    return points.withColumns({"_i": i, "_j": j}).withColumn("_ci", _around(F.col("_i"))).withColumn("_cj", _around(F.col("_j"))).drop("_i", "_j")


def places(points: DataFrame) -> DataFrame:
    """(place, lat, lon, n): the different positions, each named by its smallest id, with how many points it has."""
    return points.groupBy("lat", "lon").agg(F.min("id").alias("place"), F.count(F.lit(1)).alias("n"))


def place_pairs(points: DataFrame, eps_m: float) -> DataFrame:
    """(a, b, metres): pairs a < b of different places within the distance."""
    return pairs_within(places(points).select(F.col("place").alias("id"), "lat", "lon"), eps_m).select("a", "b", "metres")


def pairs_within(points: DataFrame, eps_m: float, eps_days: int | None = None, most_lat: float = AREA_LAT) -> DataFrame:
    """(a, b, metres, days): all pairs a < b of (id, lat, lon[, day]) within both distances. day: days as an int."""
    timed = eps_days is not None
    here = points.select("id", "lat", "lon", *(["day"] if timed else []))
    there_cells = cells_of(F.col("lat"), F.col("lon"), eps_m, most_lat)
    there = here.select(*(F.col(c).alias(f"_{c}") for c in here.columns), there_cells[0].alias("_ti"), there_cells[1].alias("_tj"))
    left = _neighbourhood(here, eps_m, most_lat)
    same = (F.col("_ci") == F.col("_ti")) & (F.col("_cj") == F.col("_tj"))
    if timed:
        left = left.withColumn("_step", F.explode(F.array(*map(F.lit, range(eps_days + 1))))).withColumn("_want", F.col("day") + F.col("_step"))
        same &= (F.col("_want") == F.col("_day")) & ((F.col("_step") > 0) | (F.col("id") < F.col("_id")))
    else:
        same &= F.col("id") < F.col("_id")
    metres = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    days = F.col("_step") if timed else F.lit(None).cast("int")
    return left.join(there, same & (metres <= eps_m)).select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b"), metres.alias("metres"), days.alias("days"))


def candidates(left: DataFrame, right: DataFrame, cap_m: float, most_lat: float = AREA_LAT) -> DataFrame:
    """left rows (key, lat, lon, ...) with every right row (lat, lon, ...; columns prefixed r_) within the cap, and `metres`."""
    renamed = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    i, j = cells_of(F.col("r_lat"), F.col("r_lon"), cap_m, most_lat)
    cells = renamed.withColumns({"_ri": i, "_rj": j})
    metres = haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    small = right.limit(BROADCAST_POINTS + 1).count() <= BROADCAST_POINTS
    joined = _neighbourhood(left, cap_m, most_lat).join(F.broadcast(cells) if small else cells, (F.col("_ci") == F.col("_ri")) & (F.col("_cj") == F.col("_rj")) & (metres <= cap_m))
    return joined.withColumn("metres", metres).drop("_ci", "_cj", "_ri", "_rj")


def within_of(points: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Points at most radius_m from a place, with `metres`."""
    metres = haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    return points.withColumn("metres", metres).filter(F.col("metres") <= radius_m)


def nearest_within(left: DataFrame, right: DataFrame, cap_m: float, out: str, key: str = "id", most_lat: float = AREA_LAT) -> DataFrame:
    """(key, out): the smallest distance within the cap; keys without one are left out."""
    return candidates(left.select(key, "lat", "lon"), right.select("lat", "lon"), cap_m, most_lat).groupBy(key).agg(F.min("metres").alias(out))


def nearest_of_layers(left: DataFrame, layers: dict[str, DataFrame], cap_m: float, key: str = "id", most_lat: float = AREA_LAT) -> DataFrame:
    """(key, a column for each layer): the smallest distance to each layer within the cap, or null; every key once.

    The layers are one table with a tag: their different places, spread over the cells around each of them and joined once.
    """
    tagged = None
    for name, layer in layers.items():
        one = layer.select(F.lit(name).alias("_layer"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        tagged = one if tagged is None else tagged.unionByName(one)
    tagged = stored(tagged.distinct(), "layers")  # points at one place are equally far
    small = tagged.limit(BROADCAST_POINTS + 1).count() <= BROADCAST_POINTS
    i, j = cells_of(F.col("_lat"), F.col("_lon"), cap_m, most_lat)
    spread = tagged.withColumns({"_i": i, "_j": j}).withColumn("_ci", _around(F.col("_i"))).withColumn("_cj", _around(F.col("_j"))).drop("_i", "_j")
    own = cells_of(F.col("lat"), F.col("lon"), cap_m, most_lat)
    points = left.select(key, "lat", "lon", own[0].alias("_ti"), own[1].alias("_tj"))
    metres = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    joined = points.join(F.broadcast(spread) if small else spread, (F.col("_ti") == F.col("_ci")) & (F.col("_tj") == F.col("_cj")) & (metres <= cap_m), "left")
    return joined.withColumn("_m", metres).groupBy(key).agg(*(F.min(F.when(F.col("_layer") == name, F.col("_m"))).alias(name) for name in layers))


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """A place as a point of the unit sphere: no pole and no date line stands out there."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _cube(point: list[Column], side: float) -> Column:
    """The cube of a grid that a point lies in, as one number."""
    at = [F.floor((c + 1) / side).cast("long") for c in point]
    return (at[0] * CUBES_ACROSS + at[1]) * CUBES_ACROSS + at[2]


def nearest_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(place, lat, lon, r_lat, r_lon): for each different place of `left` the right places that can be its nearest one.

    Right places are points on the sphere in a hierarchy of cubes, each level's a tenth as wide. Every left place begins with all
    cubes of the coarsest level that hold something, a few dozen, and goes down: of a cube's occupied children it keeps those
    whose nearest corner is not farther than the nearest known point, as each cube names one of its points. What is kept lies in a shell about as
    thick as the last level's cubes (32 m), so places far from everything keep few as well, and nothing meets every right row; only
    right places that are all about equally far are all kept. Places that many rows share are searched once.
    """
    spot = lambda df: df.select("lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    names = ("_x", "_y", "_z")
    sphere = lambda df: df.withColumns(dict(zip(names, _on_sphere(F.col("lat"), F.col("lon")), strict=True)))
    places_right = stored(sphere(spot(right)).select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), *(F.col(c).alias(f"r{c}") for c in names)), "places")
    mine = [F.col(f"r{c}") for c in names]
    kept = sphere(spot(left)).withColumn("place", F.struct("lat", "lon"))
    parent = None
    for side in CUBE_SIDES:
        own = _cube(mine, side)
        cubes = places_right.groupBy(own.alias("_cube"), *([_cube(mine, parent).alias("_parent")] if parent else [])).agg(F.min(F.struct(*(f"r{c}" for c in names))).alias("_one"))
        if parent is None:
            held = [F.struct(F.lit(r["_cube"]).alias("_cube"), F.struct(*(F.lit(r["_one"][f"r{c}"]).alias(f"r{c}") for c in names)).alias("_one")) for r in cubes.collect()]  # (2 / side + 1)^3 at most
            kept = kept.withColumn("_each", F.explode(F.array(*held))).select("*", "_each.*").drop("_each") if held else kept.limit(0).withColumns({"_cube": F.lit(0).cast("long"), "_one": F.struct(*(F.lit(0.0).alias(f"r{c}") for c in names))})
        else:
            small = cubes.limit(BROADCAST_POINTS + 1).count() <= BROADCAST_POINTS
            kept = kept.join(F.broadcast(cubes) if small else cubes, "_parent")
        low = [F.floor((F.col(f"_one.r{c}") + 1) / side) * side - 1 for c in names]
        gap = [F.greatest(e - F.col(c), F.col(c) - e - side, F.lit(0.0)) for c, e in zip(names, low, strict=True)]
        off = [F.col(c) - F.col(f"_one.r{c}") for c in names]
        length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        best = F.min("_reach").over(Window.partitionBy("place"))
        judged = kept.withColumns({"_least": length(gap), "_reach": length(off)}).withColumn("_best", best)
        kept = judged.filter(F.col("_least") <= F.col("_best") + CHORD_SLACK).select("place", "lat", "lon", *names, F.col("_cube").alias("_parent"))
        parent = side
    last = places_right.withColumn("_parent", _cube(mine, parent)).select("_parent", "r_lat", "r_lon")
    return kept.join(last, "_parent").select("place", "lat", "lon", "r_lat", "r_lon")


def nearest_any(left: DataFrame, right: DataFrame, out: str, key: str = "id") -> DataFrame:
    """(key, out): the smallest distance to any right row, anywhere on the globe, without a cap. No rows if there is no right row;
    left rows without a place are left out."""
    metres = haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    found = nearest_pairs(left, right).groupBy("lat", "lon").agg(F.min(metres).alias(out)).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), out)
    return left.select(key, "lat", "lon").join(found, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))).select(key, out)


def nearest_in_own_radius(left: DataFrame, centres: DataFrame, key: str = "id") -> DataFrame:
    """(key, centre, metres): the one nearest centre, if the point lies within that centre's own radius.

    centres: (centre, lat, lon, radius_m). A farther centre with a larger radius never matches; ties take the smaller centre.
    A nearest centre beyond the largest radius can't match, so that radius caps the search.
    """
    cap = centres.agg(F.max("radius_m")).first()[0]
    if cap is None:
        return left.select(key).limit(0).select(F.col(key), F.lit(None).cast(centres.schema["centre"].dataType).alias("centre"), F.lit(0.0).alias("metres"))
    found = candidates(left.select(key, "lat", "lon"), centres.select("centre", "lat", "lon", "radius_m"), max(float(cap), 1.0) + RADIUS_SLACK)
    first = found.groupBy(key).agg(F.min(F.struct("metres", "r_centre", "r_radius_m")).alias("m"))
    return first.filter(F.col("m.metres") <= F.col("m.r_radius_m") + RADIUS_SLACK).select(key, F.col("m.r_centre").alias("centre"), F.col("m.metres").alias("metres"))


def top_in_radius(left: DataFrame, right: DataFrame, radius: str, cap_m: float, k: int, order: list[str], key: str = "id") -> DataFrame:
    """The k nearest right rows within each left row's own radius, with `rank` and `found`, the number of all within it.

    Distances count as equal where they are the same millimetre, so that ties don't hang on the last bits of a centroid.
    """
    inside = candidates(left.select(key, "lat", "lon", radius), right, cap_m).filter(F.col("metres") <= F.col(radius))
    by_distance = Window.partitionBy(key).orderBy(F.round("metres", TIE_DIGITS), *(f"r_{c}" for c in order))
    ranked = inside.withColumns({"rank": F.row_number().over(by_distance), "found": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return ranked.filter(F.col("rank") <= k)
