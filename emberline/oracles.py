"""The registered queries in DuckDB SQL, written independently of the Spark plans: brute-force joins, recursive reachability."""

from __future__ import annotations

from .functions.geo import EARTH_RADIUS_M, grid_steps
from .functions.scalars import GROUPS, LAND_COVER, MAP_TAGS
from .operators.clusters import NOTES
from .sources import adapter

R2 = 2 * EARTH_RADIUS_M
KINDS = "['Industrial', 'Gas_Flare', 'Crop_Residue', 'Forest_Wildfire']"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(asin(sqrt(least(1.0, sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2))) * {R2!r})"


def note(name: str, value: str | None = None) -> str:
    """The fixed wording of a note as SQL, with a value in its place."""
    before, _, after = NOTES[name].partition("{}")
    return f"'{before}'" if value is None else f"'{before}' || {value} || '{after}'"


def near(x: str, y: str, metres: float) -> str:
    """A box that holds every pair within the distance, for the join."""
    return f"{y}.lat between {x}.lat - {metres / 110000!r} and {x}.lat + {metres / 110000!r} and {y}.lon between {x}.lon - {metres / 100000!r} and {x}.lon + {metres / 100000!r}"


def cell(size: float) -> str:
    a, b = grid_steps(size)
    return f"concat(cast(floor((lat - 20.0) / {a!r}) as bigint), '_', cast(floor((lon - 68.0) / {b!r}) as bigint))"


def names(code: str) -> str:
    return f"case {code} " + " ".join(f"when {k} then '{v}'" for k, v in LAND_COVER.items()) + " end"


SUMMARY = """count(*) as detection_count, count(distinct acq_date) as unique_dates, min(acq_date) as first_date, max(acq_date) as last_date,
    cast(max(acq_date) - min(acq_date) as int) as active_span_days, avg(frp) as mean_frp, max(frp) as max_frp, count(*) filter (daynight = 'D') as day_count, count(*) filter (daynight = 'N') as night_count"""
TAGS = ", ".join(f"({i}, '{k}={v}', '{label}', '{group}')" for i, (k, v, label, group) in enumerate(MAP_TAGS))
FEATURES = (
    "unique_years", "occurrence_rate", "total_detections_5yr", "mean_frp", "frp_ratio", "trend_slope", "cv_annual_detections", "top3_months_share", "top3_days_share", "night_fraction", "centroid_lat", "centroid_lon",
    "extent_radius_m", "n_industrial", "n_power", "n_waste", "n_agricultural", "n_transport", "n_other", "features_found_in_radius", "nearest_distance_m", "nearest_is_named",
)
WARD = ("detection_count", "unique_dates", "mean_frp", "centroid_lat")
YEARS = (2019, 2020, 2021, 2022, 2023, 2024, 2025)
PAIRED = ("duration_days", "detection_count", "mean_frp", "max_frp", "night_fraction", "spatial_extent_m")
METRICS = ["unique_dates", "occurrence_rate", "detection_count", "active_span_days", "mean_frp", "max_frp", "frp_ratio", "top_day_share"]

CTE: dict[str, str] = {
    "det": adapter.duck_view(adapter.DET),
    "hist": f"select *, cast(year(acq_date) as int) as year from ({adapter.duck_view(adapter.HIST)})",
    "ras": adapter.RASTER_SQL,
    "til": adapter.TILES_SQL,
    "edges": f"""select a.id as a, b.id as b, m, d from (select least(a.id, b.id) as x, greatest(a.id, b.id) as y, {hav("a.lat", "a.lon", "b.lat", "b.lon")} as m, cast(b.acq_date - a.acq_date as int) as d
        from det a join det b on {near("a", "b", 750)} and b.acq_date - a.acq_date between 0 and 1 and (b.acq_date > a.acq_date or a.id < b.id)) e join det a on a.id = x join det b on b.id = y where m <= 750""",
    "reach": "select id, id as other from det union select r.id, s.b from reach r join (select a, b from edges union all select b, a from edges) s on r.other = s.a",
    "comp": "select id, min(other) as component from reach group by id",
    "sized": "select component, count(*) as n, min(acq_date) as s, max(acq_date) as e, round(avg(lat), 9) as cla, round(avg(lon), 9) as clo from det join comp using (id) group by component having count(*) >= 2",
    "named": "select component, 'EVT' || lpad(cast(row_number() over (order by s, e, cla, clo, component) - 1 as varchar), 6, '0') as event_id from sized",
    "mem": "select det.*, event_id from det join comp using (id) join named using (component)",
    "cen": "select event_id, avg(lat) as cla, avg(lon) as clo from mem group by event_id",
    "ev": f"""select event_id, min(acq_date) as start_date, max(acq_date) as end_date, cast(max(acq_date) - min(acq_date) + 1 as int) as duration_days, round(max(cla) + 1e-9, 6) as centroid_lat, round(max(clo) + 1e-9, 6) as centroid_lon,
        round(max({hav("lat", "lon", "cla", "clo")}), 1) as spatial_extent_m, count(*) as detection_count, round(avg(frp) + 1e-9, 3) as mean_frp, max(frp) as max_frp, round(avg(case when daynight = 'N' then 1.0 else 0.0 end), 4) as night_fraction,
        case when date '{adapter.REFERENCE}' - max(acq_date) >= 1 then 'closed' else 'provisional' end as status from mem join cen using (event_id) group by event_id""",
    "tr": """select event_id, case when count(*) >= 2 then round(regr_slope(m, k), 6) end as frp_trend_slope, count(*) >= 2 as frp_trend_computable, count(*) as n_unique_days
        from (select event_id, m, row_number() over (partition by event_id order by acq_date) - 1 as k from (select event_id, acq_date, avg(frp) as m from mem group by all)) group by event_id""",
    "le": f"""select *, {KINDS}[k % 4 + 1] as silver_label, {KINDS}[case when k % 7 = 0 then (k + 1) % 4 else k % 4 end + 1] as predicted_class, (k * 37 % 101) / 101.0e0 as score
        from (select *, cast(substr(event_id, 4, 6) as int) as k from ev)""",
    **{name: adapter.duck_view(view) for name, view in ((n.removesuffix("_m"), v) for n, v in adapter.LAYERS.items())},
    "nearest": "select event_id, "
    + ", ".join(f"(select round(min(m), 1) from (select {hav('centroid_lat', 'centroid_lon', 'p.lat', 'p.lon')} as m from {n.removesuffix('_m')} p) where m <= 20000) as {n}" for n in adapter.LAYERS)
    + " from ev",
    "base": "select * from hist where year = 2023",
    "bp": f"select a.id as a, b.id as b, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as m from base a join base b on a.id < b.id and {near('a', 'b', 500)} where m <= 500",
    "p": "select a, b, m from bp where m <= 375 union all select b, a, m from bp where m <= 375",
    "core": "select id from base left join (select a, count(*) as n from p group by a) on a = id where coalesce(n, 0) + 1 >= 8",
    "creach": "select id, id as other from core union select r.id, p.b from creach r join p on p.a = r.other where p.b in (select id from core)",
    "croot": "select id, dense_rank() over (order by root) - 1 as c from (select id, min(other) as root from creach group by id)",
    "mark": "select base.id, cast(coalesce(r.c, (select min(q.c) from p join croot q on q.id = p.b where p.a = base.id), -1) as int) as cluster_id from base left join croot r on r.id = base.id",
    "lab": "select base.*, cluster_id from base join mark using (id)",
    "cs0": f"select cluster_id, avg(lat) as centroid_lat, avg(lon) as centroid_lon, {SUMMARY}, min(lat) as bbox_min_lat, max(lat) as bbox_max_lat, min(lon) as bbox_min_lon, max(lon) as bbox_max_lon from lab where cluster_id <> -1 group by cluster_id",
    "cs": f"select c.*, (select max({hav('l.lat', 'l.lon', 'c.centroid_lat', 'c.centroid_lon')}) from lab l where l.cluster_id = c.cluster_id) as extent_radius_m from cs0 c",
    "days": "select cluster_id, n, row_number() over (partition by cluster_id order by n desc, acq_date) as r from (select cluster_id, acq_date, count(*) as n from lab where cluster_id <> -1 group by all)",
    "met": """select cs.*, detection_count / unique_dates as detections_per_active_date, unique_dates / (active_span_days + 1) as occurrence_rate, night_count / detection_count as night_fraction, max_frp / nullif(mean_frp, 0) as frp_ratio,
        t1 / detection_count as top_day_share, t3 / detection_count as top3_days_share from cs join (select cluster_id, sum(n) filter (r = 1) as t1, sum(n) filter (r <= 3) as t3 from days group by cluster_id) using (cluster_id)""",
    "prof": "select *, case when unique_dates >= 143 then 'Strong' when unique_dates >= 73 then 'Moderate' else 'Limited' end as recurrence_strength, active_span_days <= 80 as short_window_recurrence, top3_days_share > 0.5 as burst_concentrated from met",
    "feat": f"""select f.*, coalesce(t.tag, 'unknown') as tag, coalesce(t.label, 'Unknown') as label, coalesce(t.grp, 'other') as grp from ({adapter.duck_view(adapter.FEATURES)}) f left join (values {TAGS}) t(i, tag, label, grp) on t.i = f.tag_at""",
    "tf": f"""select cluster_id, rank, found, feature_id, tag, label, grp as "group", coalesce(name, '') as name, coalesce(name, '') <> '' as is_named,
        case when element = 'node' then 'point_facility' when starts_with(tag, 'landuse=') then 'landuse_polygon' else 'mapped_feature' end as geometry_class, m as metres
        from (select *, cast(row_number() over (partition by cluster_id order by round(m, 3), feature_id) as int) as rank, count(*) over (partition by cluster_id) as found from
            (select cs.cluster_id, f.*, {hav("centroid_lat", "centroid_lon", "f.lat", "f.lon")} as m, greatest(750.0, least(3000.0, extent_radius_m + 500)) as radius from cs, feat f) where m <= radius) where rank <= 5""",
    "ctx": f"""select cs.cluster_id, round(greatest(750.0, least(3000.0, extent_radius_m + 500)), 4) as search_radius_m, coalesce(max(found), 0) as features_found_in_radius,
        {", ".join(f'max(t.{c}) filter (rank = 1) as nearest_{c}' for c in ("tag", "label"))}, max(t."group") filter (rank = 1) as nearest_group, max(t.name) filter (rank = 1) as nearest_name, bool_or(is_named) filter (rank = 1) as nearest_is_named,
        max(geometry_class) filter (rank = 1) as nearest_geometry_class, round(max(metres) filter (rank = 1), 1) as nearest_distance_m, arg_min(t.name, rank) filter (is_named) as nearest_named_name, round(arg_min(metres, rank) filter (is_named), 1) as nearest_named_distance_m,
        {", ".join(f'''count(*) filter (t."group" = '{g}') as n_{g}''' for g in GROUPS)},
        coalesce(string_agg(tag || '@' || cast(round(metres, 0) as int) || 'm(' || case when is_named then t.name else 'unnamed' end || ', ' || geometry_class || ')', '; ' order by rank), '') as top_features_summary
        from cs left join tf t on t.cluster_id = cs.cluster_id group by cs.cluster_id, extent_radius_m""",
    "rev": "select * from prof join ctx using (cluster_id)",
    "asg": f"""select *, 'dbscan_2023' as method from lab union all select h.*, coalesce(c, -1), case when c is null then 'unmatched_historical' else 'nearest_centroid_within_radius' end
        from hist h left join (select id, case when m <= extent_radius_m + 1e-6 then cluster_id end as c from (select h.id, cs.cluster_id, extent_radius_m, {hav("h.lat", "h.lon", "centroid_lat", "centroid_lon")} as m,
            row_number() over (partition by h.id order by m, cs.cluster_id) as r from hist h, cs where h.year <> 2023) where r = 1) n on n.id = h.id where h.year <> 2023""",
    "yr": "select cluster_id, year, count(*) as n, count(distinct acq_date) as d from asg where cluster_id <> -1 group by all",
    "cy": """select cs.cluster_id, coalesce(string_agg(cast(year as varchar), ';' order by year) filter (year <= 2023), '') as years_detected, cast(count(year) filter (year <= 2023) as int) as unique_years, min(year) filter (year <= 2023) as first_year,
        max(year) filter (year <= 2023) as last_year, count(year) filter (year <= 2023) >= 2 as recurs_across_multiple_years, coalesce(string_agg(year || ':' || n, ';' order by year), '') as per_year_detection_counts,
        coalesce(string_agg(year || ':' || d, ';' order by year), '') as per_year_unique_dates from cs left join yr using (cluster_id) group by cs.cluster_id""",
    "piv": "select cs.cluster_id, " + ", ".join(f"cast(coalesce(sum(n) filter (year = {y}), 0) as int) as detections_{y}, cast(coalesce(sum(d) filter (year = {y}), 0) as int) as active_days_{y}" for y in YEARS) + " from cs left join yr using (cluster_id) group by cs.cluster_id",
    "mon": "select cs.cluster_id, [" + ", ".join(f"count(id) filter (month(acq_date) = {m})" for m in range(1, 13)) + "] as ms from cs left join (select * from asg where year <= 2023) a using (cluster_id) group by cs.cluster_id",
    "lon0": """select *, detections_2019 + detections_2020 + detections_2021 + detections_2022 + detections_2023 as total, (detections_2020 * -1 + detections_2019 * -2 + detections_2022 + detections_2023 * 2) / 10.0e0 as slope,
        coalesce(stddev_samp_of, 0) as sd from (select *, list_aggregate([detections_2019, detections_2020, detections_2021, detections_2022, detections_2023], 'stddev_samp') as stddev_samp_of from piv)""",
    "lng": """select c.cluster_id, c.years_detected, c.unique_years, c.first_year, c.last_year, c.recurs_across_multiple_years, """
    + ", ".join(f"detections_{y}, active_days_{y}" for y in YEARS)
    + """, cast(total as bigint) as total_detections_5yr, round(total / 5.0e0, 6) as mean_annual_detections, round(sd, 6) as std_annual_detections, round(coalesce(sd / nullif(total / 5.0e0, 0), 0), 6) as cv_annual_detections, round(slope, 6) as trend_slope,
        case when total = 0 or abs(slope) < 0.10e0 * total / 5.0e0 then 'stable' when slope > 0 then 'increasing' else 'decreasing' end as trend_direction,
        array_to_string(list_transform(ms, lambda x, i: i || ':' || x), ';') as per_month_detection_counts, round(coalesce(list_sum(list_reverse_sort(ms)[1:3]) / nullif(list_sum(ms), 0), 0), 6) as top3_months_share,
        case when list_sum(ms) > 0 then cast(list_position(ms, list_max(ms)) as int) end as dominant_month from cy c join lon0 using (cluster_id) join mon using (cluster_id)""",
    "wide": "select * from rev join lng using (cluster_id)",
    "cut": "select median(total_detections_5yr) as md, round(quantile_cont(top3_months_share, 0.75), 9) as p75 from wide",
    "itg": """select w.*, case when unique_years = 5 then 'Persistent' else 'Intermittent' end as persistence_category, case when total_detections_5yr >= md then 'High-activity' else 'Low-activity' end as activity_category,
        persistence_category || ' / ' || activity_category as persistence_activity_quadrant, case when top3_months_share >= p75 then 'Strongly seasonal' else 'Not strongly seasonal' end as seasonality_category, features_found_in_radius > 0 as has_notable_osm_context,
        concat_ws('; ', case when recurrence_strength <> 'Strong' and unique_years = 5 then """
    + note("understated", "recurrence_strength")
    + """ end, case when recurrence_strength = 'Strong' and unique_years < 5 then """
    + note("one_year", "unique_years")
    + """ end, case when short_window_recurrence and top3_months_share < 0.5 then """
    + note("short_window")
    + """ end, case when features_found_in_radius = 0 and unique_years = 5 then """
    + note("no_context")
    + """ end, case when nearest_is_named and nearest_group = 'industrial' and total_detections_5yr < md then """
    + note("named_but_quiet", "nearest_name")
    + """ end) as evidence_notes
        from wide w, cut""",
    "flag0": "select cluster_id, " + ", ".join(f"coalesce({m} < (select a - 1.5 * (b - a) from q_{m}) or {m} > (select b + 1.5 * (b - a) from q_{m}), false) as outlier_{m}" for m in METRICS) + " from met",
    "flags": "select *, cast(" + " + ".join(f"cast(outlier_{m} as int)" for m in METRICS) + " as int) as n_metrics_outlier from flag0",
    **{f"q_{m}": f"select quantile_cont({m}, 0.25) as a, quantile_cont({m}, 0.75) as b from met" for m in METRICS},
    "ovl": f"""select event_id, case when m <= extent_radius_m + 1e-6 then cluster_id end as overlaps_cluster_id, case when m <= extent_radius_m + 1e-6 then round(m, 1) end as cluster_distance_m from
        (select event_id, cluster_id, extent_radius_m, {hav("ev.centroid_lat", "ev.centroid_lon", "cs.centroid_lat", "cs.centroid_lon")} as m, row_number() over (partition by event_id order by m, cluster_id) as r from ev left join cs on true) where r = 1""",
    "lc": f"select event_id, code as land_cover_code, {names('code')} as land_cover_class from ev left join ras on row = floor(centroid_lat / 0.25) and col = floor(centroid_lon / 0.25)",
    "evd": """select ev.*, n.* exclude (event_id), overlaps_cluster_id, p.recurrence_strength as overlap_strength, y.recurs_across_multiple_years as overlap_multiyear, land_cover_code, land_cover_class
        from ev join nearest n using (event_id) join ovl o using (event_id) join lc using (event_id) left join prof p on p.cluster_id = overlaps_cluster_id left join cy y on y.cluster_id = overlaps_cluster_id""",
    "hits": """select event_id, list_filter([
            case when (coalesce(dist_industrial_m <= 1000, false) or coalesce(dist_plant_m <= 1000, false)) and night_fraction > 0 and overlap_strength in ('Strong', 'Moderate') then 'Industrial|R1' end,
            case when dist_flare_m <= 1000 and (coalesce(overlap_multiyear, false) or mean_frp >= (select median(mean_frp) from evd)) then 'Gas_Flare|R2' end,
            case when dist_kiln_m <= 500 and month(start_date) in (11, 12, 1, 2, 3, 4, 5) and duration_days <= 3 then 'Brick_Kiln|R3' end,
            case when land_cover_class = 'Cropland' and duration_days <= 3 and month(start_date) in (10, 11, 12, 4, 5) then 'Crop_Residue|R4' end,
            case when land_cover_class = 'Tree cover' and duration_days <= 3 and month(start_date) in (3, 4, 5, 6) then 'Forest_Wildfire|R5' end], lambda x: x is not null) as h from evd""",
    "sil": """select event_id, case when len(h) = 1 then split_part(h[1], '|', 1) else 'Unknown_Ambiguous' end as silver_label, case when len(h) = 1 then split_part(h[1], '|', 2) end as label_rule_id,
        case when len(h) > 1 then array_to_string(list_transform(h, lambda x: split_part(x, '|', 1)), ';') end as conflict_classes, cast(len(h) as int) as n_classes_matched,
        case when len(h) = 0 then 'insufficient_evidence' when len(h) > 1 then 'conflicting_evidence' end as ambiguity_reason, len(h) <> 1 as excluded_from_training from hits""",
    "sp": "select *, cast(floor(centroid_lat / 0.5) as int) as grid_row, cast(floor(centroid_lon / 0.5) as int) as grid_col, case when (floor(centroid_lat / 0.5) + floor(centroid_lon / 0.5)) % 2 = 1 then 'test' else 'train' end as assignment from le",
    "gg": f"select {cell(375.0)} as cell_id, round(avg(lat) + 1e-9, 6) as cell_lat_center, round(avg(lon) + 1e-9, 6) as cell_lon_center, {SUMMARY} from det group by 1",
}


def _needs(sql: str, seen: dict[str, None]) -> None:
    import re

    for word in re.findall(r"[a-z_0-9]+", sql):
        if word in CTE and word not in seen:
            used = re.search(rf"(from|join|,)\s+\(*{word}\b", sql)
            if used:
                seen[word] = None
                _needs(CTE[word], seen)


def build(final: str) -> str:
    """A query with the table expressions it uses, each before its users."""
    import re

    seen: dict[str, None] = {}
    _needs(final, seen)
    uses = {n: {m for m in seen if m != n and re.search(rf"(from|join|,)\s+\(*{m}\b", CTE[n])} for n in seen}
    order: list[str] = []
    while len(order) < len(seen):
        order += [n for n in seen if n not in order and uses[n] <= set(order)]
    lazy = {"reach", "creach"}
    return "with recursive " + ", ".join(f"{n} as {'' if n in lazy else 'materialized '}({CTE[n]})" for n in order) + " " + final if order else final


FINAL: dict[str, str] = {
    "bbox_scan": """select cast(year(d) as int) as year, count(*) as n, min(id) as first_id, max(id) as last_id from (select event_id as id, 19.5e0 + (user_id % 60) / 10.0e0 as lat, case when event_id % 50 <> 0 then 67.0e0 + (user_id % 80) / 10.0e0 end as lon, cast(ts as date) as d from events)
        where lat between 20.0 and 24.7 and lon between 68.0 and 74.5 group by 1""",
    "dedup_merge": """select is_new, count(*) as n, cast(sum(id) as bigint) as id_sum from (select id, src = 1 as is_new, row_number() over (partition by cast(lat as decimal(9,4)), cast(lon as decimal(9,4)), acq_date, acq_time order by src, id) as r
        from (select *, 0 as src from det where id % 3 <> 0 union all select *, 1 from det)) where r = 1 group by 1""",
    "combine_years": "select cast(year(acq_date) as int) as year, provenance, count(*) as n, count(brightness) as n_brightness, round(avg(frp) + 1e-9, 4) as mean_frp from (select acq_date, frp, brightness, 'recent' as provenance from det union all select acq_date, frp, null, 'archive' from hist) group by 1, 2",
    "date_chunks": """select start, "end", chunk_start, least("end", chunk_start + 4) as chunk_end from (select start, "end", cast(unnest(generate_series(start, "end", interval 5 days)) as date) as chunk_start
        from (select min(cast(o_orderdate as date)) as start, max(cast(o_orderdate as date)) as "end" from orders group by year(o_orderdate)))""",
    "grid_groups": "select * replace (round(mean_frp + 1e-9, 4) as mean_frp) from gg",
    "top20_cells": "select cell_id, unique_dates, detection_count from gg order by unique_dates desc, cell_id limit 20",
    "grid_scales": " union all ".join(f"select {m} as scale_m, count(*) as occupied_cells, round(avg(n), 4) as mean_per_cell, max(n) as max_per_cell from (select {cell(m)} as c, count(*) as n from det group by 1)" for m in (100, 250, 375, 500, 1000)),
    "event_edges": "select a, b, round(m, 3) as metres, d as days from edges",
    "event_components": "select id, component from comp",
    "event_components_rounds": "select id, component from comp",
    "event_table": "select * from ev",
    "event_behavior": """select event_id, round(h + 1e-9, 6) as frac_high_confidence, round(l + 1e-9, 6) as frac_low_confidence, round(s + 1e-9, 6) as mean_scan, round(t + 1e-9, 6) as mean_track,
        round(case when tr / 2 + r <= 1e-9 then 0.0 else greatest(0.0, tr / 2 - r) / (tr / 2 + r) end + 1e-9, 4) as elongation_ratio, round(sd + 1e-9, 4) as time_of_day_std_minutes, round(rate + 1e-9, 6) as detections_per_day from
        (select *, vx + vy as tr, sqrt(greatest(0.0, (vx - vy) ** 2 / 4 + c * c)) as r from (select event_id, avg(case when confidence = 'h' then 1.0 else 0.0 end) as h, avg(case when confidence = 'l' then 1.0 else 0.0 end) as l, avg(scan) as s, avg(track) as t,
            var_pop(lon * (111320.0e0 * 0.924892e0)) as vx, var_pop(lat * 111320.0e0) as vy, covar_pop(lon * (111320.0e0 * 0.924892e0), lat * 111320.0e0) as c,
            stddev_pop(cast(substr(acq_time, 1, 2) as int) * 60 + cast(substr(acq_time, 3, 2) as int)) as sd, count(*) / (max(acq_date) - min(acq_date) + 1) as rate from mem group by event_id))""",
    "frp_trend": "select * from tr",
    "leakage_corr": "select field, round(r, 4) as r, coalesce(abs(round(r, 4)) <= 0.8, true) as safe from ("
    + " union all ".join(f"select '{f}' as field, case when var_pop({f}) > 1e-18 then corr({f}, frp_trend_slope) end as r from tr join ev using (event_id) where frp_trend_computable" for f in ("duration_days", "detection_count", "mean_frp", "max_frp", "night_fraction", "spatial_extent_m"))
    + ")",
    "class_means": "select silver_label, count(*) as n, round(avg(mean_frp) + 1e-9, 4) as mean_mean_frp, round(avg(spatial_extent_m) + 1e-9, 4) as mean_spatial_extent_m, round(median(mean_frp), 4) as median_mean_frp, round(median(spatial_extent_m), 4) as median_spatial_extent_m from le group by 1",
    "nearest_evidence": "select * from nearest",
    "cluster_overlap": "select * from ovl",
    "osm_topk": "select * replace (round(metres, 1) as metres) from tf",
    "osm_nearest_named": "select * from ctx",
    "land_cover": "select * from lc",
    "lc_diversity": "select event_id, nullif(count(distinct nullif(code, 0)), 0) as land_cover_diversity, count(distinct nullif(code, 0)) > 0 as diversity_computable from ev left join ras on abs(row - floor(centroid_lat / 0.25)) <= 1 and abs(col - floor(centroid_lon / 0.25)) <= 1 group by 1",
    "window_diversity": """select event_id, max(case when row = r and col = c then nullif(code, 0) end) as code, nullif(count(distinct nullif(code, 0)), 0) as diversity from (select event_id, cast(floor(centroid_lat / 3) * 3 as int) as s, cast(floor(centroid_lon / 3) * 3 as int) as w,
        cast(floor((s + 3.0e0 - centroid_lat) / 0.05e0) as int) as r, cast(floor((centroid_lon - w) / 0.05e0) as int) as c from ev) e left join til on south = s and west = w and abs(row - r) <= 4 and abs(col - c) <= 4 group by 1""",
    "event_evidence": "select * from evd",
    "silver_labels": "select * from sil",
    "label_counts": "select silver_label, ambiguity_reason, count(*) as n from sil group by all",
    "dbscan": "select id, cluster_id from mark",
    "cluster_stats": "select * replace (" + ", ".join(f"round({c} + 1e-9, {k}) as {c}" for c, k in (("centroid_lat", 6), ("centroid_lon", 6), ("mean_frp", 4), ("bbox_min_lat", 6), ("bbox_max_lat", 6), ("bbox_min_lon", 6), ("bbox_max_lon", 6), ("extent_radius_m", 3))) + ") from cs",
    "cluster_date_metrics": "select cluster_id, " + ", ".join(f"round({c}, 6) as {c}" for c in ("detections_per_active_date", "occurrence_rate", "night_fraction", "frp_ratio", "top_day_share", "top3_days_share")) + " from met",
    "recurrence_profile": "select cluster_id, recurrence_strength, short_window_recurrence, burst_concentrated from prof",
    "cross_year": "select * from cy",
    "year_assignments": "select year, method, count(*) as n, count(distinct nullif(cluster_id, -1)) as n_clusters from asg group by all",
    "longitudinal": "select * from lng",
    "integrated": "select cluster_id, persistence_category, activity_category, persistence_activity_quadrant, seasonality_category, has_notable_osm_context, evidence_notes from itg",
    "intelligence": """select cluster_id, 'Group ' || chr(65 + cluster_id % 3) as unsupervised_group, recurrence_strength in ('Strong', 'Moderate') as corroboration_2023_recurrence, unique_years = 5 as corroboration_5yr_persistence, has_notable_osm_context as corroboration_osm_context,
        cast(cast(recurrence_strength in ('Strong', 'Moderate') as int) + cast(unique_years = 5 as int) + cast(has_notable_osm_context as int) as int) as evidence_corroboration_count from itg""",
    "iqr_flags": "select * from flags",
    "deep_dive": """select cluster_id, case when night_fraction > 0.7 then 'mostly_night' when night_fraction < 0.3 then 'mostly_day' else 'mixed' end as day_night_pattern,
        case when features_found_in_radius = 0 then 'No OSM context' when nearest_group = 'industrial' then case when nearest_is_named then 'Named industrial' else 'Unnamed industrial-only' end
            when nearest_group in ('power', 'waste', 'agricultural', 'transport') then upper(nearest_group[1]) || nearest_group[2:] else 'Other' end as osm_context_bucket, n_metrics_outlier, nd as n_illustrative_defs_satisfied,
        concat_ws('; ', case when night_fraction <= 0.7 then """
    + note("day_night", "day_night_pattern")
    + """ end, case when top_day_share > 0.5 then """
    + note("one_day")
    + """ when top3_days_share > 0.5 then """
    + note("three_days")
    + """ end, case when outlier_frp_ratio then """
    + note("peak")
    + """ end, case when active_span_days >= sp75 and round(occurrence_rate, 9) <= op25 then """
    + note("sparse")
    + """ end, case when features_found_in_radius = 0 and unique_dates > um then """
    + note("busy_without_context")
    + """ end, case when nearest_is_named and nearest_group = 'industrial' and unique_dates < um then """
    + note("named_but_rare")
    + """ end, case when n_metrics_outlier >= 3 then """
    + note("several", "n_metrics_outlier")
    + """ end, case when nd between 1 and 4 then """
    + note("definitions", "nd")
    + """ end) as contradiction_notes
        from (select *, cast(cast(unique_dates >= 20 as int) + cast(occurrence_rate >= 0.1 as int) + cast(unique_dates >= 20 and occurrence_rate >= 0.1 as int) + cast(active_span_days >= 300 as int) + cast(unique_dates >= 143 as int) as int) as nd from rev join flags using (cluster_id)),
            (select median(unique_dates) as um, round(quantile_cont(occurrence_rate, 0.25), 9) as op25, quantile_cont(active_span_days, 0.75) as sp75 from met)""",
    "gaps": """select year, cast(r as int) as rank, round(b, 3) as before, round(f, 3) as after, round(f - b, 3) as gap from (select *, row_number() over (partition by year order by f - b desc, b desc) as r
        from (select year, f, lag(f) over (partition by year order by f) as b from (select distinct year, frp as f from hist)) where b is not null) where r <= 3""",
    "quantile_summary": """select count(*) as n, round(min(frp), 6) as "min", round(quantile_cont(frp, 0.25), 6) as p25, round(median(frp), 6) as median, round(quantile_cont(frp, 0.75), 6) as p75, round(max(frp), 6) as "max", round(avg(frp), 6) as mean,
        round(list(frp order by frp)[cast(floor(0.9 * (count(*) - 1)) as bigint) + 1], 6) as p90 from hist""",
    "daynight": "select year, count(*) as n, count(*) filter (daynight = 'D') as n_day, count(*) filter (daynight = 'N') as n_night, round(count(*) filter (daynight = 'N') * 100.0 / count(*), 4) as pct_night from hist group by 1",
    "time_concentration": """with t as (select daynight, (cast(substr(acq_time, 1, 2) as int) * 60 + cast(substr(acq_time, 3, 2) as int)) / 60.0e0 as h from hist) select daynight, round(median(h), 4) as median_hour, round(stddev_pop(h), 4) as std_hour, round(max(h) - min(h), 4) as range_hours,
        (select x from (select round(u.h, 2) as x, count(*) as n from t u where u.daynight = t.daynight group by 1 order by n desc, x limit 1)) as mode_hour from t group by daynight""",
    "cross_date_pairs": f"""select cluster_id, count(*) as n_pairs, round(min(m), 2) as min_m, round(median(m), 2) as median_m, round(max(m), 2) as max_m from
        (select x.cluster_id, {hav("x.lat", "x.lon", "y.lat", "y.lon")} as m from lab x join lab y on x.cluster_id = y.cluster_id and x.id < y.id and x.acq_date <> y.acq_date where x.cluster_id <> -1) group by 1""",
    "weighted_centroid": """select count(*) as n_cells, cast(sum(detection_count) as bigint) as n_detections, round(sum(cell_lat_center * detection_count) / sum(detection_count), 5) as lat, round(sum(cell_lon_center * detection_count) / sum(detection_count), 5) as lon
        from gg where cell_lat_center between 21.0 and 23.0 and cell_lon_center between 69.0 and 73.0""",
    "box_clusters": "select distinct cluster_id from lab where cluster_id <> -1 and lat between 21.0 and 22.5 and lon between 68.0 and 71.0",
    "spatial_split": "select grid_row, grid_col, assignment, " + ", ".join(f"count(*) filter (silver_label = '{c}') as n_{c}" for c in ("Industrial", "Gas_Flare", "Crop_Residue", "Forest_Wildfire")) + ", count(*) as total from sp group by all",
    "nn_same_class": f"""select silver_label, count(m) as n, round(min(m), 1) as min_m, round(median(m), 1) as median_m, round(max(m), 1) as max_m, count(*) filter (m <= 300) as within_300m, round(count(*) filter (m <= 300) * 100.0 / nullif(count(m), 0), 4) as pct_within_300m
        from (select t.silver_label, t.event_id, min({hav("t.centroid_lat", "t.centroid_lon", "r.centroid_lat", "r.centroid_lon")}) as m from sp t left join sp r on r.silver_label = t.silver_label and r.assignment = 'train' where t.assignment = 'test' group by all) group by 1""",
    "temporal_split": """select case when y between 2019 and 2022 then 'train' when y between 2023 and 2025 then 'test' end as split, silver_label, count(*) as n from (select silver_label, year(start_date - to_months(12 * (k % 6))) as y from le) group by all""",
    "panel": " union all ".join(f"select cluster_id, {y} as year, {z} as target_year, cast(detections_{y} as bigint) as detections_Y, cast(active_days_{y} as bigint) as active_days_Y, cast(detections_{z} > 0 as int) as target from lng" for y, z in ((2019, 2020), (2020, 2021), (2021, 2022), (2023, 2024), (2024, 2025))),
    "metrics": """with c as (select c as class, coalesce(count(*) filter (silver_label = c and predicted_class = c) / nullif(count(*) filter (predicted_class = c), 0), 0) as p, coalesce(count(*) filter (silver_label = c and predicted_class = c) / nullif(count(*) filter (silver_label = c), 0), 0) as r,
            count(*) filter (silver_label = c) as support, count(*) filter (silver_label = c and predicted_class = c) as hit from le, (select distinct unnest([silver_label, predicted_class]) as c from le) group by c), f as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from c)
        select class, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, support, cast(null as double) as accuracy from f union all select 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), cast(sum(support) as bigint), round(sum(hit) / sum(support), 6) from f""",
    "average_precision": """select silver_label, round(coalesce(sum(pos * tp / seen) / nullif(sum(pos), 0), 0), 6) as average_precision from (select silver_label, pos, sum(pos) over w as tp, sum(n) over w as seen from
        (select silver_label, score, sum(cast(silver_label = predicted_class as int)) as pos, count(*) as n from le group by all) window w as (partition by silver_label order by score desc)) group by 1""",
    "ari_nmi": """with t as (select silver_label as a, predicted_class as b, count(*) as n from le group by all), x as (select sum(n) as nn, sum(n * (n - 1) / 2) as ij, sum(n * ln(n)) as hab from t),
        xa as (select sum(n * (n - 1) / 2) as pa, sum(n * ln(n)) as ha from (select sum(n) as n from t group by a)), xb as (select sum(n * (n - 1) / 2) as pb, sum(n * ln(n)) as hb from (select sum(n) as n from t group by b))
        select round((ij - pa * pb / (nn * (nn - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (nn * (nn - 1) / 2)), 6) as ari, round(((hab - ha - hb) / nn + ln(nn)) / ((ln(nn) - ha / nn + ln(nn) - hb / nn) / 2), 6) as nmi from x, xa, xb""",
    "group_profiles": "select 'Group ' || chr(65 + cluster_id % 3) as unsupervised_group, count(*) as n, string_agg(cast(cluster_id as varchar), ';' order by cluster_id) as cluster_ids, round(avg(detection_count), 4) as mean_detection_count, round(avg(unique_dates), 4) as mean_unique_dates, round(avg(mean_frp), 4) as mean_mean_frp from cs group by 1",
    "contract_report": "select cluster_id, 'missing' as finding from cs where cluster_id = 1 union all select cluster_id, 'detection_count' from cs where cluster_id = 2",
    "dash_filter": "select event_id, start_date, predicted_class, status from le where predicted_class in ('Industrial', 'Gas_Flare') and status = 'closed' and start_date between date '2024-03-01' and date '2024-09-30' and starts_with(lower(event_id), 'evt0002')",
    "dash_window": " union all ".join(f"select min(start_date) as first_start, max(start_date) as last_start, count(*) as n, '{w}' as \"window\" from ev where start_date between date '{a}' and date '2024-07-15'" for w, a in (("today", "2024-07-15"), ("24h", "2024-07-14"), ("7d", "2024-07-09"))),
    "dash_display": "select event_id, case when dist_plant_m is null then '— (none within search radius)' else format('{:,}', cast(round(dist_plant_m, 0) as bigint)) || ' m' end as distance, printf('%.1f%%', round(night_fraction * 100 + 1e-9, 1)) as night, printf('%.2f MW', round(max_frp + 1e-9, 2)) as power from nearest join ev using (event_id)",
    "marker_tiers": "select cast(floor(centroid_lat / 0.5) as int) as row, cast(floor(centroid_lon / 0.5) as int) as col, count(*) as n, case when count(*) < 10 then 'sm' when count(*) < 50 then 'md' else 'lg' end as tier from ev group by 1, 2",
    "two_source_ingest": """select viirs_source, count(*) as n, min(acq_date) as first_date, max(acq_date) as last_date from (select distinct lat, lon, acq_date, acq_time, satellite, case when acq_date <= date '2024-06-30' then 'archive' else 'recent' end as viirs_source
        from det where acq_date between date '2024-01-01' and date '2024-12-27') group by 1""",
    "ingest_runs": """select run, y as year, case when run = 2 and y = 2023 then 'skipped' when y = 2050 then 'no_data' else 'written' end as status, case when run = 1 or y <> 2023 then (select count(*) from (select distinct lat, lon, acq_date, acq_time from hist where hist.year = y)) end as rows
        from (values (1, 2022), (1, 2023), (2, 2022), (2, 2023), (2, 2050)) r(run, y)""",
    "joined_features": "select event_id, mean_frp, centroid_lat, start_date, case when frp_trend_computable then frp_trend_slope else 0.0 end as frp_trend_slope, frp_trend_computable from ev join tr using (event_id)",
    "redundancy_audit": "select field, round(r, 4) as r, coalesce(abs(round(r, 4)) <= 0.9, true) as safe from ("
    + " union all ".join(
        f"select '{n}' as field, case when var_pop({f}) > 1e-18 then corr({f}, frp_trend_slope) end as r from tr join ev using (event_id) join lc using (event_id) where frp_trend_computable"
        for n, f in (*((f, f) for f in ("centroid_lat", "centroid_lon", "mean_frp", "night_fraction")), ("is_cropland", "cast(coalesce(land_cover_class = 'Cropland', false) as int)"), ("is_tree_cover", "cast(coalesce(land_cover_class = 'Tree cover', false) as int)"))
    )
    + ")",
    "feature_pairs": "select a, b, round(r, 4) as r, coalesce(abs(round(r, 4)) <= 0.9, true) as independent from ("
    + " union all ".join(f"select '{a}' as a, '{b}' as b, case when var_pop({a}) > 1e-18 and var_pop({b}) > 1e-18 then corr({a}, {b}) end as r from ev" for k, a in enumerate(PAIRED) for b in PAIRED[k + 1 :])
    + ")",
    "feature_matrix": "select cluster_id, "
    + ", ".join(f"round(cast({c} as double) + 1e-9, 6) as {c}" for c in FEATURES if not c.startswith("nearest_"))
    + ", round(coalesce(nearest_distance_m, greatest(750.0, least(3000.0, extent_radius_m + 500))) + 1e-9, 6) as nearest_distance_m, round(case when nearest_is_named then 1.0 else 0.0 end + 1e-9, 6) as nearest_is_named, 22 as places from itg",
    "figure_marks": "select persistence_activity_quadrant, unique_years, total_detections_5yr, count(*) as n from itg group by all",
    "figure_heat": "select r as recurrence_strength, cast(y as varchar) as unique_years, count(i.cluster_id) as n from (select unnest(['Strong', 'Moderate', 'Limited']) as r) a, (select distinct unique_years as y from itg) b left join itg i on i.recurrence_strength = r and i.unique_years = y group by 1, 2",
    "figure_bars": "select r as trend_direction, y as persistence_category, count(i.cluster_id) as n from (select unnest(['increasing', 'stable', 'decreasing']) as r) a, (select distinct persistence_category as y from itg) b left join itg i on i.trend_direction = r and i.persistence_category = y group by 1, 2",
    "date_order": "select id, acq_date, acq_time, row_number() over (order by acq_date, acq_time, id) - 1 as position from det",
    "ward_heights": "select n as n_rows, n - 1 as n_merges, round(n * f + 1e-9, 4) as scatter, round((select min(sqrt("
    + " + ".join(f"((a.{c} - b.{c}) / s.{c}) ** 2" for c in WARD)
    + ")) from cs a join cs b on a.cluster_id < b.cluster_id) + 1e-9, 4) as first_height from (select count(*) as n, "
    + " + ".join(f"cast(stddev_pop({c}) > 0 as int)" for c in WARD)
    + " as f, "
    + ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) as {c}" for c in WARD)
    + " from cs) s",
    "tier_counts": " union all ".join(f"select '{f}' as field, {f} as value, count(*) as n from itg group by {f}" for f in ("persistence_activity_quadrant", "seasonality_category", "trend_direction", "recurrence_strength", "nearest_group")),
    "category_crosstab": "select recurrence_strength, " + ", ".join(f"count(*) filter (trend_direction = '{v}') as n_{v}" for v in ("increasing", "decreasing", "stable")) + ", count(*) as total from itg group by 1",
    "top_lists": " union all ".join(
        f"""select '{name}' as list, cast(rank as int) as rank, cluster_id, round(cast(v as double), 6) as value from (select cluster_id, {m} as v, row_number() over (order by {m} {way}, cluster_id) as rank from itg where {where}) where rank <= {k}"""
        for name, m, k, where, way in (
            ("most_active", "total_detections_5yr", 5, "activity_category = 'High-activity'", "desc"), ("least_active", "total_detections_5yr", 5, "activity_category = 'Low-activity'", "asc"),
            ("most_seasonal", "top3_months_share", 8, "seasonality_category = 'Strongly seasonal'", "desc"), ("most_variable", "cv_annual_detections", 5, "mean_annual_detections >= 5", "desc"),
        )
    ),
    "frp_histogram": "select bin, round(bin * 25e0, 9) as low, round((bin + 1) * 25e0, 9) as high, n from (select cast(least(floor(frp / 25.0), 19) as int) as bin, count(*) as n from hist where frp between 0 and 500 group by 1)",
    "median_report": "select daynight, 'frp' as field, round(median(frp), 4) as median from hist group by 1 union all select daynight, 'lat', round(median(lat), 4) from hist group by 1",
    "fixed_radius_lookup": f"""select cs.cluster_id, count(m) as n_found, min_by(tag, (round(m, 3), feature_id)) as tag, min_by(label, (round(m, 3), feature_id)) as label, arg_min_null(name, (round(m, 3), feature_id)) as name, round(min(m), 1) as metres from cs left join
        (select c.cluster_id, f.*, {hav("c.centroid_lat", "c.centroid_lon", "f.lat", "f.lon")} as m from cs c, feat f where tag not in ('unknown', 'landuse=port', 'harbour=yes')) x on x.cluster_id = cs.cluster_id and m <= 2000 group by cs.cluster_id""",
    "stream_cycle": """with recursive dd as (select * exclude (r) from (select *, row_number() over (partition by lat, lon, acq_date, acq_time, satellite order by id) as r from det) where r = 1),
        ee as (select a.id as a, b.id as b from dd a join dd b on a.id <> b.id and """
    + near("a", "b", 750)
    + f""" and abs(b.acq_date - a.acq_date) <= 1 and {hav("a.lat", "a.lon", "b.lat", "b.lon")} <= 750),
        rr as (select id, id as other from dd union select rr.id, ee.b from rr join ee on ee.a = rr.other), cc as (select id, min(other) as c from rr group by id),
        tt as (select c, count(*) as n, min(acq_date) as s, max(acq_date) as e from dd join cc using (id) group by c having count(*) >= 2)
        select case when date '{adapter.REFERENCE}' - e >= 1 then 'closed' else 'provisional' end as status, count(*) as n_events, cast(sum(n) as bigint) as n_detections, min(s) as first_start, max(e) as last_end from tt group by 1""",
    "stream_events": """with recursive ss as (select *, cast(id * 13 % 10 as int) as delay from det), mark as (select max(acq_date + delay + case when delay < 6 then 1 else 0 end) - 1 as w, count(*) filter (delay > 6) as late from ss),
        dd as (select * exclude (r) from (select *, row_number() over (partition by lat, lon, acq_date, acq_time, satellite order by acq_date + delay, frp, daynight = 'N') as r from ss where delay <= 6) where r = 1),
        ee as (select a.id as a, b.id as b from dd a join dd b on a.id <> b.id and """
    + near("a", "b", 750)
    + f""" and abs(b.acq_date - a.acq_date) <= 1 and {hav("a.lat", "a.lon", "b.lat", "b.lon")} <= 750),
        rr as (select id, id as other from dd union select rr.id, ee.b from rr join ee on ee.a = rr.other), cc as (select id, min(other) as c from rr group by id),
        mm as (select dd.*, c, avg(lat) over (partition by c) as cla, avg(lon) over (partition by c) as clo from dd join cc using (id))
        select min(acq_date) as start_date, max(acq_date) as end_date, cast(max(acq_date) - min(acq_date) + 1 as int) as duration_days, round(max(cla) + 1e-9, 6) as centroid_lat, round(max(clo) + 1e-9, 6) as centroid_lon,
        round(max({hav("lat", "lon", "cla", "clo")}) + 1e-9, 1) as spatial_extent_m, count(*) as detection_count, round(avg(frp) + 1e-9, 3) as mean_frp, max(frp) as max_frp, round(avg(case when daynight = 'N' then 1.0 else 0.0 end) + 1e-9, 4) as night_fraction,
        (select late from mark) as late from mm group by c having count(*) >= 2 and max(acq_date) + 8 <= (select w from mark)""",
    "change_feed": """with a as (select acq_date, count(*) as n, max(frp) as max_frp from det where acq_date <= date '2024-06-30' and id % 50 <> 0 group by 1), b as (select acq_date, count(*) as n, max(frp) as max_frp from det where acq_date >= date '2024-02-01' group by 1)
        select case when a.acq_date is null then 'insert' when b.acq_date is null then 'delete' else 'update' end as op, coalesce(b.acq_date, a.acq_date) as acq_date, coalesce(b.n, a.n) as n, coalesce(b.max_frp, a.max_frp) as max_frp
        from a full join b using (acq_date) where a.n is distinct from b.n or a.max_frp is distinct from b.max_frp""",
}


def _sweep() -> str:
    parts, ctes = [], []
    for eps in (250, 300, 375, 400, 500):
        for least in (3, 5, 8):
            k = f"{eps}_{least}"
            ctes.append(f"p{k} as materialized (select a, b from bp where m <= {eps} union all select b, a from bp where m <= {eps})")
            ctes.append(f"c{k} as materialized (select id from base left join (select a, count(*) as n from p{k} group by a) on a = id where coalesce(n, 0) + 1 >= {least})")
            ctes.append(f"r{k} as (select id, id as other from c{k} union select r.id, p.b from r{k} r join p{k} p on p.a = r.other join c{k} c on c.id = p.b)")
            ctes.append(f"t{k} as materialized (select id, min(other) as c from r{k} group by id)")
            ctes.append(f"m{k} as materialized (select base.id, acq_date, coalesce(t.c, q.c) as c from base left join t{k} t on t.id = base.id left join (select p.a, min(t.c) as c from p{k} p join t{k} t on t.id = p.b group by p.a) q on q.a = base.id)")
            ctes.append(f"s{k} as materialized (select c, count(*) as n, count(distinct acq_date) as dates from m{k} where c is not null group by c)")
            parts.append(f"""select {eps} as eps_m, {least} as min_samples, count(*) as n_clusters, (select count(*) from m{k} where c is null) as n_noise, round((select count(*) from m{k} where c is null) * 100.0 / nullif((select count(*) from base), 0), 4) as noise_pct,
                coalesce(max(n), 0) as largest, coalesce(median(n), 0) as median_size, count(*) filter (dates > 1) as n_repeated_date_clusters from s{k}""")
    body = build("select 1 from bp, base").rsplit(" select 1", 1)[0]
    return body + ", " + ", ".join(ctes) + " " + " union all ".join(parts)


def _all() -> dict[str, str]:
    out = {}
    for name, final in FINAL.items():
        if final.startswith("with "):
            head, rest = ("with recursive ", final[15:]) if final.startswith("with recursive ") else ("with ", final[5:])
            body = build("select 1 from " + ", ".join(n for n in ("det", "hist", "le") if f" {n}" in rest)).rsplit(" select 1", 1)[0]
            out[name] = f"{body}, {rest}"
            del head
        else:
            out[name] = build(final)
    return out | {"dbscan_sweep": _sweep()}


ORACLES: dict[str, str] = _all()
