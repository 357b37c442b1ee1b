"""Scalar rules as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Map tags as (key, value, label, group), in order of precedence.
MAP_TAGS = [
    ("landuse", "industrial", "Industrial land use", "industrial"),
    ("man_made", "works", "Industrial works", "industrial"),
    ("power", "plant", "Power plant", "power"),
    ("power", "generator", "Power generator", "power"),
    ("power", "substation", "Power substation", "power"),
    ("man_made", "petroleum_well", "Oil/gas well", "industrial"),
    ("pipeline", "substation", "Pipeline substation", "industrial"),
    ("aeroway", "aerodrome", "Airport/aerodrome", "transport"),
    ("landuse", "port", "Port (land use)", "transport"),
    ("harbour", "yes", "Harbour", "transport"),
    ("landuse", "landfill", "Landfill", "waste"),
    ("amenity", "waste_transfer_station", "Waste transfer station", "waste"),
    ("amenity", "waste_disposal", "Waste disposal", "waste"),
    ("landuse", "farmland", "Farmland", "agricultural"),
    ("landuse", "farmyard", "Farmyard", "agricultural"),
    ("landuse", "orchard", "Orchard", "agricultural"),
    ("landuse", "quarry", "Quarry", "other"),
    ("man_made", "chimney", "Chimney", "industrial"),
    ("man_made", "silo", "Silo", "industrial"),
    ("man_made", "wastewater_plant", "Wastewater treatment plant", "waste"),
    ("man_made", "water_works", "Water works", "other"),
]
#: The tags of the older, fixed-radius lookup.
FIXED_RADIUS_TAGS = [t[:3] for t in MAP_TAGS if t[:2] not in (("landuse", "port"), ("harbour", "yes"))]
#: Land-cover names by code.
LAND_COVER = {
    10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 60: "Bare/sparse vegetation",
    70: "Snow/ice", 80: "Water bodies", 90: "Herbaceous wetland", 95: "Mangroves", 100: "Moss/lichen",
}
#: Names of categories, and the wording of the monitoring view.
WORDING = {
    "strong": "Strong",
    "moderate": "Moderate",
    "limited": "Limited",
    "night": "mostly_night",
    "day": "mostly_day",
    "mixed": "mixed",
    "no_context": "No OSM context",
    "named_industrial": "Named industrial",
    "unnamed_industrial": "Unnamed industrial-only",
    "persistent": "Persistent",
    "intermittent": "Intermittent",
    "high_activity": "High-activity",
    "low_activity": "Low-activity",
    "seasonal": "Strongly seasonal",
    "not_seasonal": "Not strongly seasonal",
    "overlap": "Overlaps persistent cluster #",
    "no_overlap": "No persistent-cluster overlap.",
    "just_now": "less than a minute ago",
    "point": "point_facility",
    "landuse": "landuse_polygon",
    "feature": "mapped_feature",
    "blank": "—",
    "no_distance": "— (none within search radius)",
    "recurrence": " (recurrence: ",
    "unknown": "unknown",
    "closing": ").",
}
GROUPS = ("industrial", "power", "waste", "agricultural", "transport", "other")


def settled(x: Column | str, digits: int) -> Column:
    """Rounded, with means that fall on a half up to the last bits always going up, in whatever order they were summed."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, digits)


def minutes_of_day(hhmm: Column) -> Column:
    """An HHMM string, padded or not, as minutes since midnight."""
    padded = F.lpad(hhmm, 4, "0")
    return F.substring(padded, 1, 2).cast("int") * 60 + F.substring(padded, 3, 2).cast("int")


def hours_of_day(hhmm: Column) -> Column:
    return minutes_of_day(hhmm) / F.lit(60.0)


def event_status(end: Column, reference: Column, gap_days: int = 1, strict: bool = False) -> Column:
    """closed once the reference date is `gap_days` past the end; strict waits until no detection can still link."""
    gap = F.datediff(reference, end)
    return F.when(gap > gap_days if strict else gap >= gap_days, "closed").otherwise("provisional")


def parse_counts(text: Column) -> Column:
    """`"2019:3;2020:5"` as a map of ints; empty or null as an empty map."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.create_map().cast("map<int,int>")).otherwise(F.str_to_map(text, F.lit(";"), F.lit(":")).cast("map<int,int>"))


def format_counts(entries: Column) -> Column:
    """An array of (key, count) structs as `"key:count;..."`, by rising key."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["count"].cast("string"))), ";")


def search_radius(extent_m: Column) -> Column:
    """A cluster's own extent plus 500 m, between 750 m and 3 km."""
    return F.greatest(F.lit(750.0), F.least(F.lit(3000.0), extent_m + 500.0))


def classify_tags(tags: Column, dimension: list[tuple] = MAP_TAGS) -> Column:
    """(tag, label, group) of the first listed tag that a map of tags has."""
    out = F.struct(F.lit("unknown").alias("tag"), F.lit("Unknown").alias("label"), F.lit("other").alias("group"))
    for key, value, label, *group in reversed(dimension):
        hit = F.struct(F.lit(f"{key}={value}").alias("tag"), F.lit(label).alias("label"), F.lit(group[0] if group else "other").alias("group"))
        out = F.when(F.try_element_at(tags, F.lit(key)) == value, hit).otherwise(out)
    return out


def geometry_class(element: Column, tag: Column) -> Column:
    return F.when(element == "node", WORDING["point"]).when(F.startswith(tag, F.lit("landuse=")), WORDING["landuse"]).otherwise(WORDING["feature"])


def named_code(code: Column, names: Mapping[int, str] = LAND_COVER) -> Column:
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(code == key, name).otherwise(out)
    return out


def recurrence_strength(unique_dates: Column) -> Column:
    return F.when(unique_dates >= 143, WORDING["strong"]).when(unique_dates >= 73, WORDING["moderate"]).otherwise(WORDING["limited"])


def short_window(span_days: Column) -> Column:
    return span_days <= 80


def burst_concentrated(top3_share: Column) -> Column:
    return top3_share > 0.5


def day_night_pattern(night_fraction: Column) -> Column:
    return F.when(night_fraction > 0.7, WORDING["night"]).when(night_fraction < 0.3, WORDING["day"]).otherwise(WORDING["mixed"])


def map_context_bucket(found: Column, group: Column, named: Column) -> Column:
    return (
        F.when(found == 0, WORDING["no_context"])
        .when((group == "industrial") & named, WORDING["named_industrial"])
        .when(group == "industrial", WORDING["unnamed_industrial"])
        .when(group.isin("power", "waste", "agricultural", "transport"), F.initcap(group))
        .otherwise("Other")
    )


def imputed_distance(distance: Column, extent_m: Column) -> Column:
    """A missing distance counts as the cluster's own search radius."""
    return F.coalesce(distance, search_radius(extent_m))


def persistence_category(unique_years: Column) -> Column:
    return F.when(unique_years == 5, WORDING["persistent"]).otherwise(WORDING["intermittent"])


def activity_category(total: Column, median: Column) -> Column:
    return F.when(total >= median, WORDING["high_activity"]).otherwise(WORDING["low_activity"])


def seasonality_category(share: Column, p75: Column) -> Column:
    return F.when(share >= p75, WORDING["seasonal"]).otherwise(WORDING["not_seasonal"])


LOCAL_ZONE, LOCAL_NAME = "Asia/Kolkata", "IST"


def display_distance(metres: Column) -> Column:
    """Whole metres with thousands separated; a null distance says that nothing was in reach."""
    return F.when(metres.isNull(), WORDING["no_distance"]).otherwise(F.concat(F.format_number(F.round(metres, 0), 0), F.lit(" m")))


def display_number(value: Column, digits: int, unit: str = "") -> Column:
    return F.when(value.isNull(), WORDING["blank"]).otherwise(F.concat(F.format_string(f"%.{digits}f", settled(value.cast("double"), digits)), F.lit(unit)))


def display_percent(share: Column, digits: int = 1) -> Column:
    return display_number(share * 100, digits, "%")


def display_power(mw: Column) -> Column:
    return display_number(mw, 2, " MW")


def display_coordinate(degrees: Column, digits: int = 4) -> Column:
    return display_number(degrees, digits)


def display_overlap(cluster_id: Column, strength: Column) -> Column:
    found = F.concat(F.lit(WORDING["overlap"]), cluster_id.cast("string"), F.lit(WORDING["recurrence"]), F.coalesce(strength, F.lit(WORDING["unknown"])), F.lit(WORDING["closing"]))
    return F.when(cluster_id.isNull(), WORDING["no_overlap"]).otherwise(found)


def seconds_since(then: Column, now: Column) -> Column:
    """Whole seconds between two timestamps, never negative."""
    return F.greatest(F.lit(0), F.round(now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double"), 0).cast("long"))


def next_check(then: Column, interval_s: int = 1800) -> Column:
    return F.timestamp_add("SECOND", F.lit(interval_s), then)


def display_clock(utc: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(utc, LOCAL_ZONE), "HH:mm"), F.lit(f" {LOCAL_NAME}"))


def display_date(utc: Column) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(utc, LOCAL_ZONE), "dd MMM yyyy"), F.lit(WORDING["blank"]))


def display_age(seconds: Column) -> Column:
    """`less than a minute ago`, `1 minute ago`, `5 hours ago`, `2 days ago`."""
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = (F.floor(seconds / k) for k in (60, 3600, 86400))
    return F.when(seconds < 60, WORDING["just_now"]).when(minutes < 60, part(minutes, "minute")).when(hours < 24, part(hours, "hour")).otherwise(part(days, "day"))


def is_stale(seconds: Column, interval_s: int = 1800) -> Column:
    """No update for two polling intervals."""
    return seconds > 2 * interval_s


def bool_int(x: Column) -> Column:
    """1 for true and for the text "True", else 0."""
    return F.coalesce(F.lower(x.cast("string")) == "true", F.lit(False)).cast("int")


def add_days(day: Column, n: int) -> Column:
    """An ISO date n days on, as text."""
    return F.date_add(day.cast("date"), n).cast("string")
