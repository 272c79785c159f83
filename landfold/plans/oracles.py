"""SQL with the same rows as the queries, written independently: windows, joins and brute force."""

from __future__ import annotations

BASE = """
scenes(scene_id, k, year) AS (VALUES ('a', 0, 1990), ('b', 1, 1998), ('c', 2, 2005), ('d', 3, 2014), ('e', 4, 2022)),
p0 AS (SELECT event_id // 10000 AS site_id, scene_id, k, year, (event_id % 10000) % 100 AS x, (event_id % 10000) // 100 AS y, user_id, event_id FROM events, scenes),
p1 AS (SELECT *, 14 + (y // 10) % 3 AS shore, x // 12 AS cx, y // 12 AS cy, (user_id * 7 + event_id * 31 + k * 17) % 23 AS noise FROM p0),
p2 AS (SELECT *, CASE WHEN x < shore THEN 4 WHEN x < shore + 2 THEN 5 ELSE (cx * cx + 3 * cy + cx * cy) % 4 END AS c0 FROM p1),
p3 AS (SELECT *, CASE WHEN c0 = 1 AND x % 12 < 2 * k THEN 0 WHEN c0 = 2 AND k >= 3 AND y % 12 < 2 THEN 1 ELSE c0 END AS cls FROM p2),
p4 AS (SELECT *, [40, 105, 170, 150, 30, 215][cls + 1] + noise AS r0, [75, 130, 165, 140, 60, 215][cls + 1] + noise AS g0, [45, 80, 110, 150, 130, 212][cls + 1] + noise // 2 AS b0 FROM p3),
px AS (SELECT site_id, scene_id, k, year, x, y, cls,
  CASE WHEN k = 0 THEN (299 * r0 + 587 * g0 + 114 * b0) // 1000 ELSE r0 END AS r,
  CASE WHEN k = 0 THEN (299 * r0 + 587 * g0 + 114 * b0) // 1000 ELSE g0 END AS g,
  CASE WHEN k = 0 THEN (299 * r0 + 587 * g0 + 114 * b0) // 1000 ELSE b0 END AS b FROM p4),
bands AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS lum, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS chroma,
  g - (r + b) / 2::DOUBLE AS green, b - (r + g) / 2::DOUBLE AS blue FROM px),
m AS (SELECT site_id, scene_id, k, year, x, y, cls, cls = 1 AS buffer, cls = 0 AS forest, cls IN (2, 3) AS human, cls = 1 AS sparse, cls = 2 AS open, cls = 3 AS built,
  cls = 4 AS water, cls = 5 AS coast, cls < 4 AS land FROM px),
sizes AS (SELECT event_id // 10000 AS site_id, 100 AS width, max((event_id % 10000) // 100) + 1 AS height FROM events GROUP BY 1),
sites AS (SELECT DISTINCT event_id // 10000 AS site_id FROM events),
samples AS (SELECT site_id, v.* FROM sites, (VALUES
  (NULL, 'forest', 'f1', 30.0::DOUBLE, 42.0::DOUBLE, 4), (NULL, 'forest', 'f2', 66.0, 30.0, 4), (NULL, 'open', 'o1', 42.0, 6.0, 4), (NULL, 'open', 'o2', 90.0, 54.0, 4),
  ('c', 'sparse', 's1', 54.0, 30.0, 4), ('d', 'sparse', 's2', 30.0, 6.0, NULL), ('e', 'built', 'b1', 54.0, 6.0, 4), ('e', 'built', 'b2', 99.0, 99.0, 4), ('b', 'sparse', 's3', 200.0, 200.0, 1)
  ) v(scene_id, class, circle_id, x, y, r)),
polygons AS (SELECT site_id, v.* FROM sites, (VALUES
  ('aoi', 'main', 0, 2.0::DOUBLE, 2.0::DOUBLE), ('aoi', 'main', 1, 97.5, 3.0), ('aoi', 'main', 2, 96.0, 95.5), ('aoi', 'main', 3, 4.0, 97.0),
  ('exclusion', 'concave', 0, 60.0, 60.0), ('exclusion', 'concave', 1, 90.0, 60.0), ('exclusion', 'concave', 2, 75.0, 72.0), ('exclusion', 'concave', 3, 90.0, 90.0), ('exclusion', 'concave', 4, 60.0, 90.0),
  ('exclusion', 'crossed', 0, 10.0, 10.0), ('exclusion', 'crossed', 1, 40.0, 40.0), ('exclusion', 'crossed', 2, 40.0, 10.0), ('exclusion', 'crossed', 3, 10.0, 40.0),
  ('exclusion', 'two', 0, 1.0, 1.0), ('exclusion', 'two', 1, 50.0, 50.0),
  ('settlement', 'yard', 0, 50.0, 20.0), ('settlement', 'yard', 1, 52.0, 21.0), ('settlement', 'yard', 2, 70.0, 22.0), ('settlement', 'yard', 3, 68.0, 35.0), ('settlement', 'yard', 4, 51.0, 34.0)
  ) v(kind, poly_id, vertex_no, x, y)),
edges AS (SELECT kind, poly_id, site_id, vertex_no, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_, count(*) OVER (PARTITION BY site_id, kind, poly_id) AS n
  FROM polygons WINDOW w AS (PARTITION BY site_id, kind, poly_id ORDER BY vertex_no)),
crossings AS (SELECT e.*, s.width, row_y, ax + (row_y + 0.5 - ay) / (by_ - ay) * (bx - ax) AS at_x FROM edges e JOIN sizes s USING (site_id), (SELECT unnest(range(100)) AS row_y)
  WHERE n >= 3 AND row_y < s.height AND ((ay <= row_y + 0.5 AND by_ > row_y + 0.5) OR (by_ <= row_y + 0.5 AND ay > row_y + 0.5))),
spans AS (SELECT *, lead(at_x) OVER w AS to_x, row_number() OVER w AS rn FROM crossings WINDOW w AS (PARTITION BY site_id, kind, poly_id, row_y ORDER BY at_x)),
inside AS (SELECT DISTINCT kind, poly_id, site_id, unnest(range(greatest(0, ceil(at_x - 0.5))::BIGINT, least(width - 1, floor(to_x - 0.5))::BIGINT + 1)) AS x, row_y AS y FROM spans WHERE rn % 2 = 1 AND to_x IS NOT NULL),
houses AS (SELECT 0::BIGINT AS site_id, [NULL, 'a', 'b', 'c', 'd', 'e'][CASE s_suppkey % 6 WHEN 5 THEN 1 ELSE s_suppkey % 6 + 2 END] AS scene_id, s_suppkey AS house_id,
  (20 + s_suppkey * 7 % 78)::DOUBLE AS x, (s_suppkey * 13 % 100)::DOUBLE AS y FROM supplier),
series AS (SELECT site_id, scene_id, year, count(*) FILTER (buffer) * 0.0004::DOUBLE AS area_ha FROM m GROUP BY ALL),
oseries AS (SELECT o_orderpriority AS site_id, year(o_orderdate) AS year, count(*)::DOUBLE AS area_ha FROM orders GROUP BY ALL),
photos AS (SELECT c_custkey AS photo_id, 0::BIGINT AS site_id, 'IMG_' || c_custkey || '.JPG' AS file, 37.46::DOUBLE + (c_custkey % 997) / 50000::DOUBLE AS lat, 137.09::DOUBLE + (c_custkey * 31 % 991) / 50000::DOUBLE AS lon,
  (c_custkey % 300)::DOUBLE AS alt, '2024-05-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' AS taken, (c_custkey * 37 % 360)::DOUBLE AS dir,
  CASE WHEN c_custkey % 15 = 0 THEN 'buffer' WHEN c_custkey % 15 = 7 THEN 'edge' END AS tag FROM customer),
tags(tag, label, color) AS (VALUES ('buffer', 'Buffer zone', '#ff0'), ('edge', 'Forest edge', '#0f0')),
catalogue AS (SELECT DISTINCT site_id, scene_id, k, year::DOUBLE AS year, 'scene, ' || scene_id AS label FROM px)
"""

ORACLES: dict[str, str] = {}


def add(name: str, body: str, ctes: str = "") -> None:
    ORACLES[name] = f"WITH RECURSIVE {BASE}{', ' + ctes if ctes else ''} {body}"


def focal(name: str, source: str, outs: dict[str, str], r: int, agg: str = "sum") -> str:
    """CTEs: source with the aggregate of each expression over the window, in one pass along rows and one along columns."""
    row = f"OVER (PARTITION BY site_id, scene_id, y ORDER BY x RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    col = f"OVER (PARTITION BY site_id, scene_id, x ORDER BY y RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    first = ", ".join(f"{agg}({e}) {row} AS {o}_" for o, e in outs.items())
    second = ", ".join(f"{agg}({o}_) {col} AS {o}" for o in outs)
    return f"{name}_r AS (SELECT *, {first} FROM {source}), {name} AS (SELECT * EXCLUDE ({', '.join(o + '_' for o in outs)}), {second} FROM {name}_r)"


def morph(name: str, source: str, col: str, r: int, grow: bool) -> str:
    """CTEs: site_id, scene_id, x, y, {name}v of the grown or shrunk mask."""
    f = focal(name + "f", source, {"s": f"CASE WHEN {col} THEN 1 ELSE 0 END"}, r)
    test = "s > 0" if grow else f"s = {(2 * r + 1) ** 2}"
    return f"{f}, {name} AS (SELECT * EXCLUDE (s), {test} AS {name}v FROM {name}f)"


def labels(name: str, source: str, where: str, conn: int) -> str:
    """CTEs: smallest raster number reachable, by repeated minima over neighbours."""
    offsets = "(-1, 0), (1, 0), (0, -1), (0, 1)" + (", (-1, -1), (1, 1), (-1, 1), (1, -1)" if conn == 8 else "")
    return f"""{name}_on AS (SELECT site_id, scene_id, x, y FROM {source} WHERE {where}),
{name}(site_id, scene_id, x, y, region) USING KEY (site_id, scene_id, x, y) AS (
  SELECT site_id, scene_id, x, y, (y * 2147483648 + x)::BIGINT FROM {name}_on
  UNION
  SELECT n.site_id, n.scene_id, n.x, n.y, min(l.region) FROM {name} l, (VALUES {offsets}) o(dx, dy), recurring.{name} n
  WHERE n.site_id = l.site_id AND n.scene_id = l.scene_id AND n.x = l.x + dx AND n.y = l.y + dy AND l.region < n.region GROUP BY ALL)"""


def near(name: str, source: str, where: str, of: str = "TRUE") -> str:
    """CTE: site_id, scene_id, x, y, d3 for pixels of source that satisfy ``of``, by brute force."""
    return f"""{name} AS (SELECT a.site_id, a.scene_id, a.x, a.y, coalesce(min(3 * greatest(abs(a.x - t.x), abs(a.y - t.y)) + least(abs(a.x - t.x), abs(a.y - t.y))), 3000000) AS d3
FROM (SELECT * FROM {source} WHERE {of}) a LEFT JOIN (SELECT site_id, scene_id, x, y FROM {source} WHERE {where}) t ON a.site_id = t.site_id AND a.scene_id = t.scene_id GROUP BY ALL)"""


def kept(name: str, source: str, where: str, conn: int, test: str) -> str:
    """CTEs: source with {name}v, whether the pixel is in a region of ``where`` for which ``test`` holds (window w: the region)."""
    return f"""{labels(name + "l", source, where, conn)},
{name} AS (SELECT s.*, coalesce(t.ok, FALSE) AS {name}v FROM {source} s LEFT JOIN (SELECT l.site_id, l.scene_id, l.x, l.y, {test} AS ok
  FROM {name}l l JOIN {source} p USING (site_id, scene_id, x, y) WINDOW w AS (PARTITION BY l.site_id, l.scene_id, l.region)) t USING (site_id, scene_id, x, y))"""


OTSU = """{n}_h AS (SELECT {k}, least(greatest(floor({v} + 0.5), 0), 255) AS bin, count(*) AS n FROM {s} GROUP BY ALL),
{n}_c AS (SELECT {k}, bin, sum(n) OVER (PARTITION BY {k} ORDER BY bin) AS wb, sum(bin * n) OVER (PARTITION BY {k} ORDER BY bin) AS sb, sum(n) OVER (PARTITION BY {k}) AS w, sum(bin * n) OVER (PARTITION BY {k}) AS st FROM {n}_h),
{n}_v AS (SELECT {k}, bin, CASE WHEN w - wb > 0 THEN wb::DOUBLE * (w - wb) * (sb / wb - (st - sb) / (w - wb)) * (sb / wb - (st - sb) / (w - wb)) END AS v FROM {n}_c),
{n} AS (SELECT {k}, coalesce(arg_min(bin, (-v, bin)) FILTER (v > 0), 128)::INT AS threshold FROM {n}_v GROUP BY ALL)"""

RATE = "(area_ha - lag(area_ha) OVER w) / nullif(year - lag(year) OVER w, 0)"
TREND = """{n}_c AS (SELECT site_id, count(*) AS points, count(*) FILTER (year IS NOT NULL) AS nn, regr_slope({y}, year - 2000) AS slope, regr_intercept({y}, year - 2000) AS i0, coalesce(regr_r2({y}, year - 2000), 1) AS r2 FROM {s} GROUP BY 1),
{n} AS (SELECT site_id, slope, i0 - 2000 * slope AS intercept, r2, points FROM {n}_c)"""
SETUP = (
    TREND.format(n="lin", y="area_ha", s="series")
    + """,
setup0 AS (SELECT l.site_id, slope, r2, max(s.year)::DOUBLE AS start_year, arg_max(s.area_ha, s.year) AS a0, arg_min(s.area_ha, s.year) AS initial_ha, min(s.year)::DOUBLE AS x_min FROM lin l JOIN series s USING (site_id) GROUP BY ALL),
setup1 AS (SELECT *, initial_ha * 5 / 100 AS threshold_ha FROM setup0),
setup2 AS (SELECT *, CASE WHEN a0 <= threshold_ha THEN start_year WHEN slope >= 0 THEN NULL ELSE start_year + (threshold_ha - a0) / slope END AS disappear_year FROM setup1),
setup AS (SELECT *, slope AS rate_ha, CASE WHEN a0 > 0 THEN slope / a0 * 100 ELSE 0 END AS rate_pct,
  greatest(start_year, x_min + 10, CASE WHEN disappear_year > start_year THEN ceil((disappear_year + 2) / 5) * 5 WHEN disappear_year IS NOT NULL THEN start_year + 10 ELSE start_year + 100 END) AS x_max FROM setup2)"""
)

add("forest_area_trend", f"""SELECT site_id, scene_id, year, threshold, round(area_ha, 6) AS area_ha, round({RATE}, 6) AS rate, round(slope, 6) AS slope, round(r2, 6) AS r2
FROM area JOIN lin USING (site_id) WINDOW w AS (PARTITION BY site_id ORDER BY year, scene_id)""",
    OTSU.format(n="o", k="site_id, scene_id", v="lum", s="bands") + ", area AS (SELECT site_id, scene_id, year, any_value(threshold) AS threshold, count(*) FILTER (lum < threshold) * 0.0004::DOUBLE AS area_ha FROM bands JOIN o USING (site_id, scene_id) GROUP BY ALL), "
    + TREND.format(n="lin", y="area_ha", s="area"))

# sources and sinks
add("read_scene_images", "SELECT site_id, scene_id, x, y, r, g, b FROM px")
add("write_and_read_pixels", "SELECT site_id, scene_id, count(*) AS n, sum((x + 1) * r + (y + 1) * g + b)::BIGINT AS mark FROM px GROUP BY ALL")
add("regrid_nearest", """SELECT p.site_id, p.scene_id, tx AS x, ty AS y, r, g, b FROM px p JOIN sizes s USING (site_id), range(70) a(tx), range(130) c(ty)
WHERE p.x = least(floor((tx + 0.5) * 100 / 70), 99) AND p.y = least(floor((ty + 0.5) * s.height / 130), s.height - 1)""")
add("read_scene_config", """SELECT what, site_id, about, count(*) AS n FROM (
SELECT 'scenes' AS what, site_id, concat_ws('|', scene_id, scene_id || '.png', CASE WHEN k = 1 THEN 'true' ELSE 'false' END) AS about FROM catalogue
UNION ALL SELECT 'samples', site_id, concat_ws('|', coalesce(scene_id, '-'), class, coalesce(r::VARCHAR, '-')) FROM samples
UNION ALL SELECT 'houses', site_id, coalesce(scene_id, '-') FROM houses WHERE site_id IN (SELECT site_id FROM sites)
UNION ALL SELECT 'polygons', site_id, concat_ws('|', kind, vertex_no::VARCHAR) FROM polygons) GROUP BY ALL""")
add("merge_settings", """SELECT site_id, scene_id, CASE WHEN hit AND same THEN year + 1 ELSE year END AS year, CASE WHEN hit AND same THEN label || '!' ELSE label END AS label, CASE WHEN hit AND same THEN true ELSE k = 1 END AS estimated,
CASE WHEN hit AND same THEN 9 WHEN k % 2 = 1 THEN k END::DOUBLE AS bias, CASE WHEN hit THEN '0,5' ELSE '' END AS correction, NOT same AS migrated
FROM (SELECT *, scene_id IN ('b', 'c') AS hit, site_id % 2 = 0 AS same FROM catalogue)""")
add("merge_site_settings", """SELECT s.site_id, v AS saved_version, v = 2 AS migrated, CASE v WHEN 3 THEN '0.6' ELSE '0.45' END AS opacity, 'all' AS lost_base, CASE v WHEN 3 THEN 80 + s.site_id ELSE 100 END::DOUBLE AS edge_band, 40::DOUBLE AS forest_near,
'5' AS threshold_pct, CASE v WHEN 3 THEN '7' ELSE '1' END AS seed, CASE v WHEN 3 THEN 12 ELSE 0 END::DOUBLE AS auto_m, 20::DOUBLE AS house_radius, CASE v WHEN 3 THEN 50 ELSE 35 END::DOUBLE AS coast_band, 1.5::DOUBLE AS dx, 0::DOUBLE AS dy,
CASE v WHEN 3 THEN 0 ELSE (SELECT count(*) FROM polygons p WHERE p.site_id = s.site_id AND kind = 'aoi') END::INT AS aoi, 0 AS exclusion, (SELECT count(*) FROM polygons p WHERE p.site_id = s.site_id AND kind = 'settlement')::INT AS yards,
(SELECT count(*) FROM samples p WHERE p.site_id = s.site_id)::INT AS circles, (SELECT count(*) FROM houses p WHERE p.site_id = s.site_id)::INT AS houses FROM sites s, (VALUES (3), (2)) t(v)""")
add("resolve_params", """SELECT site_id, scene_id, gray AS grayscale, CASE WHEN k % 2 = 1 THEN k ELSE 0 END::DOUBLE AS bias, CASE WHEN k % 2 = 1 THEN 180 WHEN gray THEN 200 ELSE 190 END::DOUBLE AS builtMin,
CASE WHEN gray THEN 255 ELSE 24 END::DOUBLE AS builtChromaMax, 4::DOUBLE AS strictness, NULL::DOUBLE AS forestMax FROM catalogue JOIN (SELECT site_id, scene_id, avg(chroma) < 3 AS gray FROM bands GROUP BY ALL) USING (site_id, scene_id)""")
add("read_photos", "SELECT 'p' || photo_id % 25 AS folder, file, round(lat, 6) AS lat, round(lon, 6) AS lon, alt, taken, tag, label FROM photos LEFT JOIN tags USING (tag)")
OBSERVED = """obs AS (SELECT site_id, scene_id, year, count(*) FILTER (land) * 0.0004::DOUBLE AS land, count(*) FILTER (buffer) * 0.0004::DOUBLE AS area_ha, count(*) FILTER (forest) * 0.0004::DOUBLE AS forest,
count(*) FILTER (sparse) * 0.0004::DOUBLE AS sparse, count(*) FILTER (open) * 0.0004::DOUBLE AS field, count(*) FILTER (built) * 0.0004::DOUBLE AS built FROM m GROUP BY ALL)"""
FORECAST = """fc AS (SELECT s.site_id, y::DOUBLE AS year, CASE WHEN y <= start_year THEN a0 ELSE greatest(0, least(a0, a0 + slope * (y - start_year))) END AS area_ha, rate_ha, land, disappear_year, threshold_ha
FROM setup s JOIN (SELECT site_id, arg_min(land, year) AS land FROM obs GROUP BY 1) l USING (site_id), (SELECT unnest(range(1900, 2400, 5)) AS y) WHERE y > start_year AND y <= x_max)"""
add("write_area_table", f"""SELECT site_id, 'observed' AS kind, scene_id AS id, year::VARCHAR AS year, 'scene  ' || scene_id AS label, printf('%.2f', land) AS land_ha, printf('%.2f', area_ha) AS buffer_ha,
CASE WHEN land > 0 THEN printf('%.1f', area_ha / land * 100) ELSE '' END AS buffer_land_pct, printf('%.2f', forest) AS forest_ha, printf('%.2f', sparse) AS sparse_ha, printf('%.2f', field) AS field_ha, printf('%.2f', built) AS built_ha, '0.00' AS settlement_ha,
coalesce(printf('%.3f', {RATE}), '') AS change_ha_per_year FROM obs WINDOW w AS (PARTITION BY site_id ORDER BY year, scene_id)
UNION ALL SELECT site_id, 'forecast', '', year::BIGINT::VARCHAR, '', '', printf('%.2f', area_ha), CASE WHEN land > 0 THEN printf('%.1f', area_ha / land * 100) ELSE '' END, '', '', '', '', '', printf('%.3f', rate_ha) FROM fc
UNION ALL SELECT site_id, 'gone', '', printf('%.1f', disappear_year), 'threshold ' || printf('%.2f', threshold_ha) || ' ha', '', '', '', '', '', '', '', '', '' FROM setup WHERE disappear_year IS NOT NULL""",
    f"{SETUP}, {OBSERVED}, {FORECAST}")
RLE = """rv AS (SELECT site_id, scene_id, y * 100 + x AS i, (cls = 1)::INT - (cls = 0)::INT AS v FROM px),
rg AS (SELECT *, row_number() OVER (PARTITION BY site_id, scene_id ORDER BY i) - row_number() OVER (PARTITION BY site_id, scene_id, v ORDER BY i) AS g FROM rv),
rr AS (SELECT site_id, scene_id, v, min(i) AS i, count(*) AS n FROM rg GROUP BY site_id, scene_id, v, g),
rle AS (SELECT site_id, scene_id, flatten(list([v::BIGINT, n] ORDER BY i)) AS runs FROM rr GROUP BY ALL)"""
add("export_settings", """SELECT site_id, 3 AS version, scene_id, year, label, scene_id || '.png' AS file, k = 1 AS estimated, CASE WHEN k % 2 = 1 THEN k END::DOUBLE AS bias, len(runs)::INT AS n, list_reduce([0::BIGINT] || runs, lambda a, v: (a * 31 + v + 7) % 1000003) AS mark FROM catalogue JOIN rle USING (site_id, scene_id)""", RLE)
FILES = """img AS (SELECT 'P' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.heic' WHEN 2 THEN '.png' ELSE '.txt' END AS name, s_suppkey AS k, s_suppkey % 13 <> 0 AS readable,
CASE WHEN s_suppkey % 10 <> 0 THEN (37 + (s_suppkey % 60) / 60.0::DOUBLE + (s_suppkey * 7 % 6000) / 100.0::DOUBLE / 3600) * CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END END AS lat,
(137 + (s_suppkey * 3 % 60) / 60.0::DOUBLE + (s_suppkey * 11 % 6000) / 100.0::DOUBLE / 3600) * CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END AS lon,
CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey * 10 / 7.0::DOUBLE * CASE WHEN s_suppkey % 2 = 1 THEN -1 ELSE 1 END END AS alt,
CASE WHEN s_suppkey % 4 <> 0 THEN '2024:05:01 10:00:00' WHEN s_suppkey % 8 <> 0 THEN '2024:06:01 11:00:00' END AS taken_at FROM supplier),
mov AS (SELECT 'M' || p_partkey || '.MOV' AS name, p_partkey % 3 AS t, CASE p_partkey % 3 WHEN 0 THEN ('37.4' || p_partkey % 1000)::DOUBLE WHEN 1 THEN -('37.4' || p_partkey % 1000)::DOUBLE END AS lat,
CASE p_partkey % 3 WHEN 0 THEN ('137.0' || p_partkey * 7 % 1000)::DOUBLE WHEN 1 THEN -('137.0' || p_partkey % 77)::DOUBLE END AS lon,
CASE p_partkey % 3 WHEN 0 THEN p_partkey % 500 + 0.5::DOUBLE END AS alt, CASE p_partkey % 3 WHEN 0 THEN '2024:01:0' || (p_partkey % 9 + 1) || ' 10:20:30' ELSE '' END AS taken_at FROM part),
listing AS (SELECT name, CASE WHEN readable AND lat IS NOT NULL THEN lat END AS lat, CASE WHEN readable AND lat IS NOT NULL THEN lon END AS lon, CASE WHEN readable AND lat IS NOT NULL THEN alt END AS alt,
  CASE WHEN readable THEN coalesce(taken_at, '') ELSE '' END AS taken_at, CASE WHEN NOT readable THEN 'read error' WHEN lat IS NULL THEN 'no GPS' ELSE 'OK' END AS status FROM img WHERE k % 4 <> 3
  UNION ALL SELECT name, lat, lon, alt, taken_at, CASE WHEN t < 2 THEN 'OK (movie)' ELSE 'no GPS (movie)' END FROM mov)"""
add("write_gps_listing", "SELECT name, coalesce(printf('%.8f', lat), '') AS lat, coalesce(printf('%.8f', lon), '') AS lon, coalesce(printf('%.2f', alt), '') AS alt_m, taken_at, status AS note FROM listing", FILES)
add("append_scenes", """SELECT site_id, scene_id, year, FALSE AS is_new FROM catalogue UNION ALL
SELECT site_id, s, coalesce(y, 2022 + 10 * n)::DOUBLE, TRUE FROM sites, (VALUES (1, 'a_1', NULL), (2, 'new', 2030), (3, 'new_1', NULL)) v(n, s, y)""")

# expressions on pixels
add("spectral_bands", "SELECT site_id, scene_id, x, y, round(lum, 6) AS lum, round(chroma, 6) AS chroma, round(green, 6) AS green, round(blue, 6) AS blue FROM bands")
add("grayscale_flag", "SELECT site_id, scene_id, avg(chroma) < 3 AS grayscale FROM bands GROUP BY ALL")
add("sort_scenes", "SELECT site_id, scene_id, 2050 - year AS year, (row_number() OVER (PARTITION BY site_id ORDER BY 2050 - year) - 1)::INT AS k FROM catalogue WHERE scene_id NOT IN ('b', 'd')")
add("land_mask", "SELECT site_id, scene_id, count(*) FILTER (cls < 4) AS land, count(*) FILTER (cls <> 4) AS with_coast FROM m GROUP BY ALL")
add("built_rule", """SELECT site_id, scene_id, count(*) FILTER (hit) AS n, sum(CASE WHEN hit THEN y * 100 + x ELSE 0 END)::BIGINT AS mark FROM (SELECT *, l / n > 145.2 AND c / n < 24 AS hit FROM f) GROUP BY ALL""",
    focal("f", "bands", {"l": "lum", "c": "chroma", "n": "1"}, 3))
add("apply_aoi", "SELECT site_id, scene_id, count(*) AS n, count(*) FILTER (buffer) AS buffer FROM m JOIN (SELECT site_id, x, y FROM inside WHERE kind = 'aoi') USING (site_id, x, y) GROUP BY ALL")
LAYERS = """lay AS (SELECT * REPLACE (sparse OR i % 53 = 0 AS sparse), i % 31 = 0 AS lost, i % 7 = 0 AS band, i % 41 = 0 AS settlement, i % 37 = 0 AS excl, open AS field, x > 5 AS aoi FROM (SELECT *, y * 100 + x AS i FROM m)),
lab AS (SELECT *, CASE WHEN buffer THEN 'buffer' WHEN settlement THEN 'settlement' WHEN open THEN 'open' WHEN built THEN 'built' WHEN sparse THEN 'sparse' WHEN forest THEN 'forest' WHEN water OR coast THEN 'water' ELSE 'unknown' END AS label FROM lay)"""
LAYER = """CASE WHEN NOT aoi AND NOT water THEN 'dim' WHEN buffer THEN 'buffer' WHEN lost THEN 'lost' WHEN band AND forest THEN 'band_lost' WHEN settlement THEN 'settlement' {excl} WHEN field THEN 'field' WHEN sparse THEN 'sparse' WHEN water THEN 'water' WHEN built THEN 'built' WHEN forest THEN 'forest' ELSE 'none' END"""
add("pixel_class_label", "SELECT site_id, scene_id, label, count(*) AS n FROM lab GROUP BY ALL", LAYERS)
add("overlay_layer", f"SELECT site_id, scene_id, x, y, {LAYER.format(excl='')} AS layer FROM lay", LAYERS)
add("overlay_rgba", f"""SELECT site_id, scene_id, layer, coalesce(a::BIGINT * 16777216 + b * 65536 + g * 256 + r, 0)::BIGINT AS rgba, count(*) AS n FROM (SELECT *, {LAYER.format(excl="WHEN excl THEN 'excl'")} AS layer FROM lay)
LEFT JOIN (VALUES ('dim', 20, 20, 20, 110), ('buffer', 255, 212, 0, 153), ('lost', 255, 60, 40, 140), ('band_lost', 180, 60, 160, 102), ('settlement', 80, 80, 220, 128), ('excl', 90, 90, 90, 102), ('field', 250, 240, 160, 102), ('sparse', 160, 220, 120, 102),
('water', 40, 120, 220, 115), ('built', 210, 210, 210, 128), ('forest', 20, 110, 40, 89)) s(layer, r, g, b, a) USING (layer) GROUP BY ALL""".replace("SELECT *, CASE", "SELECT site_id, scene_id, CASE"), LAYERS)
add("crossfade_pixels", "SELECT p.site_id, p.x, p.y, p.r * 0.75::DOUBLE + q.r * 0.25::DOUBLE AS r, p.g * 0.75::DOUBLE + q.g * 0.25::DOUBLE AS g, p.b * 0.75::DOUBLE + q.b * 0.25::DOUBLE AS b FROM px p JOIN px q ON p.site_id = q.site_id AND p.x = q.x AND p.y = q.y WHERE p.scene_id = 'b' AND q.scene_id = 'd'")
add("water_with_coast", "SELECT m.site_id, m.scene_id, count(*) FILTER (m.coast OR a.water) AS wet FROM m JOIN m a ON a.scene_id = 'a' AND a.site_id = m.site_id AND a.x = m.x AND a.y = m.y GROUP BY ALL")
add("override_report", "SELECT site_id, scene_id, CASE WHEN k % 2 = 1 THEN 'bias=' || k || '.0 builtMin=180.0' ELSE '' END AS overrides, k = 1 AS estimated FROM catalogue")

# neighbourhoods
add("focal_sum", "SELECT site_id, scene_id, x, y, round(s, 6) AS focal FROM f", focal("f", "bands", {"s": "lum"}, 3))
add("focal_count", "SELECT site_id, scene_id, x, y, n::BIGINT AS n FROM f", focal("f", "px", {"n": "1"}, 4))
add("focal_mean", "SELECT site_id, scene_id, x, y, round(s / n, 6) AS focal FROM f", focal("f", "bands", {"s": "chroma", "n": "1"}, 2))
add("focal_min", "SELECT site_id, scene_id, x, y, round(s, 6) AS focal FROM f", focal("f", "bands", {"s": "lum"}, 2, "min"))
add("focal_std", "SELECT site_id, scene_id, x, y, round(sqrt(greatest(0, q / n - (s / n) * (s / n))), 6) AS focal FROM f", focal("f", "bands", {"s": "lum", "q": "lum * lum", "n": "1"}, 2))
EDGE = """gr AS (SELECT *, coalesce(0.5 * sqrt(pow(lead(lum) OVER r - lag(lum) OVER r, 2) + pow(lead(lum) OVER c - lag(lum) OVER c, 2)), 0) AS edge FROM bands
WINDOW r AS (PARTITION BY site_id, scene_id, y ORDER BY x), c AS (PARTITION BY site_id, scene_id, x ORDER BY y))"""
add("gradient", "SELECT site_id, scene_id, x, y, round(edge, 6) AS edge FROM gr", EDGE)
FEATURES = ", ".join([
    EDGE,
    focal("ft", "gr", {"ts": "lum", "tq": "lum * lum", "tn": "1"}, 2),
    focal("fw", "ft", {"ws": "lum", "wq": "lum * lum", "wn": "1"}, 5),
    focal("fm", "fw", {"mn": "lum"}, 2, "min"),
    "fs AS (SELECT *, sqrt(greatest(0, tq / tn - (ts / tn) * (ts / tn))) AS tex, sqrt(greatest(0, wq / wn - (ws / wn) * (ws / wn))) AS wid FROM fm)",
    focal("fa", "fs", {"a0": "lum", "a1": "chroma", "a2": "green", "a3": "tex", "a4": "mn", "a5": "wid", "a6": "edge", "an": "1"}, 3),
    "feat AS (SELECT site_id, scene_id, x, y, a0 / an AS f_lum, a1 / an AS f_chroma, a2 / an AS f_green, a3 / an AS f_texture, a4 / an AS f_min, a5 / an AS f_wide, a6 / an AS f_edge FROM fa)",
])
NAMES = ["f_lum", "f_chroma", "f_green", "f_texture", "f_min", "f_wide", "f_edge"]
add("feature_vector", "SELECT site_id, scene_id, x, y, " + ", ".join(f"round({f}, 6) AS {f}" for f in NAMES) + " FROM feat", FEATURES)
add("dilate", "SELECT site_id, scene_id, x, y FROM d WHERE dv", morph("d", "m", "buffer", 3, True))
add("erode", "SELECT site_id, scene_id, x, y FROM d WHERE dv", morph("d", "m", "forest", 2, False))
add("morph_open", "SELECT site_id, scene_id, x, y FROM d WHERE dv", morph("c", "m", "forest", 2, False) + ", " + morph("d", "c", "cv", 2, True))
add("morph_close", "SELECT site_id, scene_id, x, y FROM d WHERE dv", morph("c", "m", "forest", 2, True) + ", " + morph("d", "c", "cv", 2, False))
add("majority_filter", """SELECT site_id, scene_id, x, y, CASE WHEN land THEN w = 0 ELSE forest END AS forest, CASE WHEN land THEN w = 1 ELSE sparse END AS sparse, CASE WHEN land THEN w = 3 ELSE built END AS built
FROM (SELECT *, CASE greatest(nf, ns, no, nb) WHEN nf THEN 0 WHEN ns THEN 1 WHEN no THEN 2 ELSE 3 END AS w FROM f)""",
    focal("f", "m", {"nf": "forest::INT", "ns": "sparse::INT", "no": "(land AND cls = 2)::INT", "nb": "built::INT"}, 2))

# regions and distance
add("connected_components", "SELECT site_id, scene_id, x, y, region FROM l", labels("l", "m", "buffer", 8))
add("region_labels", "SELECT site_id, scene_id, x, y, dense_rank() OVER (PARTITION BY site_id, scene_id ORDER BY region) AS label, count(*) OVER (PARTITION BY site_id, scene_id, region) AS size FROM l", labels("l", "m", "forest", 8))
add("region_sizes", "SELECT site_id, scene_id, region, count(*) AS size FROM l GROUP BY ALL", labels("l", "m", "forest", 4))
add("remove_small_regions", "SELECT site_id, scene_id, x, y FROM (SELECT *, count(*) OVER (PARTITION BY site_id, scene_id, region) AS n FROM l) WHERE n >= 64", labels("l", "m", "forest", 8))
add("keep_border_regions", "SELECT site_id, scene_id, x, y FROM (SELECT l.*, bool_or(x <= 2 OR y <= 2 OR x >= width - 3 OR y >= height - 3) OVER (PARTITION BY site_id, scene_id, region) AS e FROM l JOIN sizes USING (site_id)) WHERE e", labels("l", "m", "forest", 4))
add("keep_touching_regions", "SELECT site_id, scene_id, x, y FROM (SELECT *, bool_or(x % 29 = 0 AND y % 17 = 0) OVER (PARTITION BY site_id, scene_id, region) AS e FROM l) WHERE e", labels("l", "m", "buffer", 8))
add("distance_transform", "SELECT site_id, scene_id, x, y, d3 AS dist3 FROM d", near("d", "m", "forest"))
add("within_distance", "SELECT site_id, scene_id, count(*) FILTER (d3 / 3.0 <= 6) AS near, count(*) FILTER (d3 / 3.0 <= 6 AND buffer) AS near_buffer FROM d JOIN m USING (site_id, scene_id, x, y) GROUP BY ALL", near("d", "m", "human"))

# thresholds and areas
add("upper_median", """SELECT key, round(v, 6) AS median FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM (
SELECT l_returnflag AS key, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT site_id || '/' || scene_id, blue FROM bands)) WHERE i = n // 2""")
add("upper_median_of_prices", """SELECT l_linestatus, round(v, 6) AS median FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_linestatus) AS n FROM (
SELECT l_linestatus, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) AS v FROM lineitem)) WHERE i = n // 2""")
add("histogram256", "SELECT site_id, scene_id, least(greatest(floor(lum + 0.5), 0), 255)::INT AS bin, count(*) AS n FROM bands WHERE x >= 20 GROUP BY ALL")
add("otsu_threshold", "SELECT key, threshold FROM a UNION ALL SELECT site_id || '/' || scene_id, threshold FROM o", OTSU.format(n="a", k="key", v="p_size", s="(SELECT p_brand AS key, p_size FROM part)") + ", " + OTSU.format(n="o", k="site_id, scene_id", v="lum", s="bands"))
add("mask_area", "SELECT site_id, scene_id, round(count(*) FILTER (forest) * 0.0004::DOUBLE, 6) AS area_ha FROM m GROUP BY ALL")
add("scene_stats", "SELECT site_id, scene_id, " + ", ".join(f"round(count(*) FILTER ({c}) * 0.0004::DOUBLE, 6) AS {n}" for n, c in [("buffer", "buffer"), ("settlement", "human AND x % 3 = 0 AND x > 20"), ("field", "open AND x > 20"), ("sparse", "sparse AND x > 20"), ("land", "land AND x > 20"), ("forest", "forest AND x > 20"), ("built", "built AND x > 20")]) + " FROM m GROUP BY ALL")
add("catalogue_counts", """SELECT site_id, 'sample' AS what, coalesce(scene_id, 'shared') AS scope, class AS kind, count(*) AS n FROM samples GROUP BY ALL
UNION ALL SELECT site_id, 'house', coalesce(scene_id, 'shared'), 'house', count(*) FROM houses GROUP BY ALL UNION ALL SELECT site_id, 'polygon', 'shared', kind, count(DISTINCT poly_id) FROM polygons GROUP BY ALL""")

# geometry
add("polygon_mask", "SELECT site_id, kind, poly_id, x, y FROM inside")
add("polygon_union_mask", "SELECT DISTINCT site_id, x, y FROM inside WHERE kind = 'exclusion'")
add("disc_pixels", "SELECT h.site_id, h.scene_id, house_id, p.x, p.y FROM houses h JOIN px p ON p.k = 0 AND p.site_id = h.site_id AND (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) <= 30.25")
add("settlement_mask", """SELECT site_id, scene_id, x, y FROM inside JOIN catalogue USING (site_id) WHERE kind = 'settlement'
UNION SELECT p.site_id, p.scene_id, p.x, p.y FROM houses h JOIN px p ON p.site_id = h.site_id AND (h.scene_id IS NULL OR h.scene_id = p.scene_id) AND (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) <= 16
UNION SELECT site_id, scene_id, x, y FROM d WHERE dv AND land""", morph("d", "m", "built", 1, True))
add("dedupe_vertices", "SELECT site_id, kind, poly_id, vertex_no, x, y FROM (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM polygons WINDOW w AS (PARTITION BY site_id, kind, poly_id ORDER BY vertex_no)) WHERE lx IS NULL OR sqrt(pow(x - lx, 2) + pow(y - ly, 2)) > 3")
add("georeference_points", "SELECT photo_id, round((lon + 180) / 360 * 16777216 - 14777102.08 + 2, 4) AS x, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16777216 - 6502220.83 - 3, 4) AS y FROM photos")
ASK = "ask AS (SELECT photo_id, site_id, photo_id % 130 * 0.9::DOUBLE - 5.3::DOUBLE AS x, photo_id * 7 % 117 * 0.9::DOUBLE AS y FROM photos)"
add("class_at_points", "SELECT photo_id, c.scene_id, coalesce(lab.label, 'outside') AS label FROM ask JOIN catalogue c USING (site_id) LEFT JOIN lab ON lab.site_id = ask.site_id AND lab.scene_id = c.scene_id AND lab.x = floor(ask.x + 0.5) AND lab.y = floor(ask.y + 0.5)", f"{LAYERS}, {ASK}")
add("nearest_within", """SELECT photo_id AS query_id, b.house_id AS point_id, round(b.d, 6) AS d FROM ask LEFT JOIN (SELECT photo_id, house_id, sqrt(pow(ask.x - h.x, 2) + pow(ask.y - h.y, 2)) AS d FROM ask JOIN houses h USING (site_id)
WHERE sqrt(pow(ask.x - h.x, 2) + pow(ask.y - h.y, 2)) < 13 QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY d, house_id) = 1) b USING (photo_id)""", ASK)
add("compass8", "SELECT photo_id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][(floor(dir / 45 + 0.5) % 8)::INT + 1] AS point FROM photos")
add("apply_corrections", """SELECT site_id, scene_id, x, y FROM (SELECT *, y * 100 + x AS i FROM m) WHERE CASE WHEN i % 97 = 1 OR i % 194 = 0 THEN FALSE WHEN i % 97 = 0 AND land THEN TRUE ELSE buffer END""")

# water, land cover, buffer
add("water_votes", """SELECT f.site_id, x, y, sum((blue > greatest(18, med + 10) AND sqrt(greatest(0, q / n - (s / n) * (s / n))) < 12)::INT)::BIGINT AS votes, count(*) AS refs FROM f JOIN md USING (site_id, scene_id) GROUP BY ALL""",
    focal("f", "(SELECT * FROM bands WHERE scene_id IN ('c', 'd'))", {"s": "lum", "q": "lum * lum", "n": "1"}, 2)
    + ", md AS (SELECT site_id, scene_id, blue AS med FROM (SELECT *, row_number() OVER (PARTITION BY site_id, scene_id ORDER BY blue) - 1 AS i, count(*) OVER (PARTITION BY site_id, scene_id) AS c FROM bands) WHERE i = c // 2)")
add("coastal_zone", """SELECT site_id, scene_id, x, y FROM (SELECT l.*, w.water, bool_or(w.water) OVER (PARTITION BY l.site_id, l.scene_id, region) AS hit FROM l JOIN w USING (site_id, scene_id, x, y)) WHERE hit AND NOT water""",
    focal("f", "bands", {"s": "lum", "c": "chroma", "n": "1"}, 1) + ", w AS (SELECT f.*, cls = 4 AS water, cls = 4 OR (s / n > 120 AND c / n < 60) AS bright FROM f), " + labels("l", "w", "bright", 4))
SCENE_SAMPLES = "ss AS (SELECT c.site_id, c.scene_id, class, circle_id, x, y, coalesce(r, 8)::INT AS r FROM samples s JOIN catalogue c ON c.site_id = s.site_id AND (s.scene_id IS NULL OR s.scene_id = c.scene_id))"
add("samples_for_scene", "SELECT * FROM ss", SCENE_SAMPLES)
PROTO = (
    f"{FEATURES}, {SCENE_SAMPLES}, pr AS (SELECT f.site_id, f.scene_id, class, circle_id, count(*) AS n, "
    + ", ".join(f"avg({f}) AS mu{k}, var_pop({f}) AS v{k}" for k, f in enumerate(NAMES))
    + " FROM ss JOIN feat f ON f.site_id = ss.site_id AND f.scene_id = ss.scene_id AND (f.x - ss.x) * (f.x - ss.x) + (f.y - ss.y) * (f.y - ss.y) <= ss.r * ss.r GROUP BY ALL HAVING count(*) >= 4), vc AS (SELECT site_id, scene_id, class, sum(n) AS n, "
    + ", ".join(f"greatest(9, sum(v{k} * n) / sum(n)) AS v{k}" for k in range(7))
    + " FROM pr GROUP BY ALL), va AS (SELECT site_id, scene_id, "
    + ", ".join(f"greatest(9, sum(v{k} * n) / sum(n)) AS v{k}" for k in range(7))
    + " FROM vc GROUP BY ALL)"
)
add("train_prototypes", "SELECT site_id, scene_id, class, circle_id, n, " + ", ".join(f"round(mu{k}, 5) AS mu{k}" for k in range(7)) + " FROM pr", PROTO)
add("share_variance", "SELECT site_id, scene_id, " + ", ".join(f"round(v{k}, 4) AS va{k}" for k in range(7)) + " FROM va", PROTO)
add("prototype_scores", "SELECT f.site_id, f.scene_id, f.x, f.y, " + ", ".join(f"round(max(d) FILTER (class = '{c}'), 4) AS score_{c}" for c in ("forest", "sparse", "open", "built")) + " FROM feat f LEFT JOIN (SELECT f.site_id, f.scene_id, f.x, f.y, class, -0.5 * (" + " + ".join(f"(f.{n} - mu{k}) * (f.{n} - mu{k}) / va.v{k}" for k, n in enumerate(NAMES)) + ") AS d FROM feat f JOIN pr USING (site_id, scene_id) JOIN va USING (site_id, scene_id)) USING (site_id, scene_id, x, y) GROUP BY ALL", PROTO)
SCORED = """sc0 AS (SELECT site_id, scene_id, x, y, cls < 4 AS land, lum, chroma, """ + ", ".join(
    f"CASE WHEN cls = {at} THEN -0.5 ELSE -((x * 7 + y * 3 + {at} * 5 + {c}) % 11) END::DOUBLE AS {n}" for c, at, n in ((1, 0, "sf"), (2, 1, "ss"), (3, 2, "so"), (4, 3, "sb"))
) + """ FROM bands),
sc AS (SELECT *, CASE WHEN scene_id <> 'a' THEN ss + 0.5 ELSE '-inf'::DOUBLE END AS s2, so + 1 AS s3, CASE WHEN scene_id = 'e' THEN sb WHEN lum > 150 AND chroma < 24 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS s4 FROM sc0)"""
add("decide_class", """SELECT site_id, scene_id, x, y, CASE WHEN NOT land THEN NULL WHEN k = 4 THEN 'built' WHEN b1 < 'inf'::DOUBLE AND b2 > '-inf'::DOUBLE AND 2 * (b1 - b2) < 4 THEN 'forest' WHEN k = 2 THEN 'sparse' WHEN k = 1 THEN 'forest' ELSE 'open' END AS cls
FROM (SELECT *, list_sort([sf, s2, s3, s4], 'DESC')[1] AS b1, list_sort([sf, s2, s3, s4], 'DESC')[2] AS b2, list_position([sf, s2, s3, s4], list_sort([sf, s2, s3, s4], 'DESC')[1]) AS k FROM sc)""", SCORED)
add("threshold_classify", """SELECT site_id, scene_id, x, y, CASE WHEN cls >= 4 THEN NULL WHEN lum < CASE WHEN scene_id = 'b' THEN 100 ELSE threshold END - 5 THEN 'forest' WHEN lum > 150 AND chroma < 24 THEN 'built' ELSE 'open' END AS cls FROM bands JOIN o USING (site_id, scene_id)""",
    OTSU.format(n="o", k="site_id, scene_id", v="lum", s="(SELECT * FROM bands WHERE cls < 4)"))


def cleaned(source: str) -> str:
    """CTEs to k3: source's forest closed and opened, then small open and small sparse regions given away."""
    return ", ".join([
        morph("c1", source, "forest", 2, True), morph("c2", "c1", "c1v", 2, False), morph("c3", "c2", "c2v", 2, False), morph("c4", "c3", "c3v", 2, True),
        "k1 AS (SELECT site_id, scene_id, x, y, land, built, c4v AND land AS f1, sparse AND NOT (c4v AND land) AS s1, land AND NOT c4v AND NOT built AND NOT sparse AS o1 FROM c4)",
        labels("lo", "k1", "o1", 8),
        "k2 AS (SELECT k1.*, coalesce(n >= 16, FALSE) AS o2, s1 OR (o1 AND n < 16) AS s2 FROM k1 LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY site_id, scene_id, region) AS n FROM lo) USING (site_id, scene_id, x, y))",
        labels("ls", "k2", "s2", 8),
        "k3 AS (SELECT k2.*, coalesce(n >= 8, FALSE) AS s3, f1 OR (s2 AND n < 8) AS f3 FROM k2 LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY site_id, scene_id, region) AS n FROM ls) USING (site_id, scene_id, x, y))",
    ])


add("clean_classes", "SELECT site_id, scene_id, x, y, f3 AS forest, s3 AS sparse, o2 AS open, built FROM k3", cleaned("m"))
add("human_mask", """SELECT m.site_id, m.scene_id, m.x, m.y FROM m LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY site_id, scene_id, region) AS n FROM l) l USING (site_id, scene_id, x, y)
LEFT JOIN (SELECT site_id, x, y, TRUE AS s FROM inside WHERE kind = 'settlement') i USING (site_id, x, y) WHERE land AND (n >= 60 OR s)""", labels("l", "m", "human", 8))
add("buffer_band", "SELECT site_id, scene_id, x, y, land AND NOT human AND d3 / 3.0 <= 8 AS band, land AND NOT human AND d3 / 3.0 <= 8 AND sparse AS buffer FROM m JOIN d USING (site_id, scene_id, x, y)", near("d", "m", "human"))
add("band_forested", "SELECT site_id, scene_id, count(*) FILTER (land AND NOT human AND d3 / 3.0 <= 8 AND forest) AS n FROM m JOIN d USING (site_id, scene_id, x, y) GROUP BY ALL", near("d", "m", "human"))

# whole jobs: the steps above in turn
GRAY = "gray AS (SELECT site_id, scene_id, avg(chroma) < 3 AS gray FROM bands GROUP BY ALL)"
SEA = ", ".join([
    GRAY,
    focal("vf", "(SELECT * FROM bands JOIN gray USING (site_id, scene_id) WHERE NOT gray)", {"s": "lum", "q": "lum * lum", "n": "1"}, 2),
    "md AS (SELECT site_id, scene_id, blue AS med FROM (SELECT *, row_number() OVER (PARTITION BY site_id, scene_id ORDER BY blue) - 1 AS i, count(*) OVER (PARTITION BY site_id, scene_id) AS c FROM bands) WHERE i = c // 2)",
    """vt AS (SELECT site_id, 'site' AS scene_id, x, y, sum((blue > greatest(18, med + 10) AND sqrt(greatest(0, q / n - (s / n) * (s / n))) < 12)::INT) >= count(*) // 2 + 1 AS voted
FROM vf JOIN md USING (site_id, scene_id) GROUP BY site_id, x, y)""",
    morph("w1", "vt", "voted", 2, True), morph("w2", "w1", "w1v", 2, False),
    kept("w3", "w2", "NOT w2v", 4, "count(*) OVER w >= 300"),
    morph("w4", "w3", "NOT w3v", 2, True), morph("w5", "w4", "w4v", 2, False),
    "w6 AS (SELECT w5.*, x <= 3 OR y <= 3 OR x >= width - 4 OR y >= height - 4 AS rim FROM w5 JOIN sizes USING (site_id))",
    kept("w7", "w6", "w5v", 4, "bool_or(rim) OVER w"), morph("w8", "w7", "w7v", 1, True),
])
add("water_mask", "SELECT site_id, x, y FROM w8 WHERE w8v", SEA)
DISTANCE = "-0.5 * (" + " + ".join(f"(f.{n} - mu{k}) * (f.{n} - mu{k}) / va.v{k}" for k, n in enumerate(NAMES)) + ")"
TO_THRESHOLD = "-0.5 * (" + " + ".join(f"pow({n} - {'(threshold + 40)' if k == 0 else '(threshold + 20)' if k == 4 else '0'}, 2) / 400" for k, n in enumerate(NAMES)) + ")"
COVER = ", ".join([
    SEA, PROTO,
    focal("cf", "bands", {"s": "lum", "c": "chroma", "n": "1"}, 1),
    "cw AS (SELECT cf.*, coalesce(w8v, FALSE) AS water, coalesce(w8v, FALSE) OR (s / n > 185 AND c / n < 30) AS bright FROM cf LEFT JOIN (SELECT site_id, x, y, w8v FROM w8) USING (site_id, x, y))",
    kept("ch", "cw", "bright", 4, "bool_or(water) OVER w"),
    "lf AS (SELECT f.*, k, water, chv AND NOT water AS coast, NOT chv AND NOT water AS land FROM feat f JOIN ch USING (site_id, scene_id, x, y))",
    OTSU.format(n="ot", k="site_id, scene_id", v="f_lum", s="(SELECT * FROM lf WHERE land)"),
    "kn AS (SELECT site_id, scene_id, bool_or(class = 'forest') AND bool_or(class = 'open') AS by_samples FROM pr GROUP BY ALL)",
    "ds AS (SELECT f.site_id, f.scene_id, f.x, f.y, " + ", ".join(f"max({DISTANCE}) FILTER (class = '{c}') AS {n}" for c, n in (("forest", "sf"), ("sparse", "ss"), ("open", "so"), ("built", "sb"))) + " FROM feat f JOIN pr USING (site_id, scene_id) JOIN va USING (site_id, scene_id) GROUP BY ALL)",
    """sp1 AS (SELECT lf.*, sf, ss, so, sb, coalesce(by_samples, FALSE) AS by_samples, coalesce(threshold, 128) AS threshold, CASE WHEN k % 2 = 1 THEN k ELSE 0 END::DOUBLE AS bias,
  f_lum > CASE WHEN k % 2 = 1 THEN 180 WHEN gray THEN 200 ELSE 190 END AND f_chroma < CASE WHEN gray THEN 255 ELSE 24 END AS rule
  FROM lf JOIN gray USING (site_id, scene_id) LEFT JOIN kn USING (site_id, scene_id) LEFT JOIN ot USING (site_id, scene_id) LEFT JOIN ds USING (site_id, scene_id, x, y))""",
    "sp2 AS (SELECT *, [coalesce(sf, '-inf'::DOUBLE), coalesce(ss + bias * 0.5, '-inf'::DOUBLE), coalesce(so + bias, '-inf'::DOUBLE), coalesce(sb, CASE WHEN rule THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END)] AS s FROM sp1)",
    "sp3 AS (SELECT *, list_sort(s, 'DESC')[1] AS b1, list_sort(s, 'DESC')[2] AS b2, list_position(s, list_sort(s, 'DESC')[1]) AS place FROM sp2)",
    f"""dc AS (SELECT * EXCLUDE (s), CASE WHEN NOT land THEN -1 WHEN NOT by_samples THEN CASE WHEN f_lum < threshold - bias * 5 THEN 0 WHEN coalesce(sb > {TO_THRESHOLD}, rule) THEN 3 ELSE 2 END
  WHEN place = 4 THEN 3 WHEN b1 < 'inf'::DOUBLE AND b2 > '-inf'::DOUBLE AND 2 * (b1 - b2) < 4 THEN 0 ELSE place - 1 END AS cl FROM sp3)""",
    focal("mj", "dc", {f"n{c}": f"(cl = {c})::INT" for c in range(4)}, 2),
    "mk AS (SELECT *, CASE WHEN NOT by_samples OR NOT land THEN cl ELSE CASE greatest(n0, n1, n2, n3) WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 ELSE 3 END END AS mc FROM mj)",
    "cv AS (SELECT site_id, scene_id, x, y, land, coast, water, by_samples, mc = 0 AS forest, mc = 1 AS sparse, mc = 3 AS built FROM mk)",
    cleaned("cv"),
    "classes AS (SELECT k3.site_id, k3.scene_id, k3.x, k3.y, k3.land, coast, water, f3 AS forest, s3 AS sparse, o2 AS open, k3.built, by_samples FROM k3 JOIN cv USING (site_id, scene_id, x, y))",
])
add("classify_scene", "SELECT * FROM classes", COVER)
add("refreshed_classes", "SELECT site_id, scene_id, (scene_id = 'e')::INT AS run, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("water", "forest", "sparse", "open", "built")) + " FROM classes GROUP BY ALL", COVER)


def zoned(source: str) -> str:
    """CTEs to zone: source with human, band and buffer."""
    flag = lambda kind: f"EXISTS (SELECT 1 FROM inside i WHERE i.kind = '{kind}' AND i.site_id = z.site_id AND i.x = z.x AND i.y = z.y)"
    return ", ".join([
        f"""st AS (SELECT i.site_id, c.scene_id, i.x, i.y FROM inside i JOIN catalogue c USING (site_id) WHERE kind = 'settlement'
UNION SELECT p.site_id, p.scene_id, p.x, p.y FROM houses h JOIN px p ON p.site_id = h.site_id AND (h.scene_id IS NULL OR h.scene_id = p.scene_id) AND (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) <= 16),
z0 AS (SELECT z.site_id, z.scene_id, z.x, z.y, land, forest, sparse, open, built, water, coast, land AND (open OR built) AS work, st.x IS NOT NULL AS lived
  FROM {source} z LEFT JOIN st ON st.site_id = z.site_id AND st.scene_id = z.scene_id AND st.x = z.x AND st.y = z.y)""",
        kept("z1", "z0", "work", 8, "count(*) OVER w >= 60"), "z2 AS (SELECT *, land AND (lived OR z1v) AS human FROM z1)",
        near("nh", "z2", "human", "land AND NOT human"),
        "z3 AS (SELECT z2.*, coalesce(d3 / 3.0 <= 8, FALSE) AS band, coalesce(d3 / 3.0 <= 8, FALSE) AND sparse AS buf, coalesce(d3 / 3.0 <= 3, FALSE) AS close FROM z2 LEFT JOIN nh USING (site_id, scene_id, x, y))",
        kept("z4", "z3", "forest", 8, "count(*) OVER w >= 64"),
        near("nf", "z4", "z4v", "buf"), near("nw", "z4", "water OR coast", "buf"),
        f"z5 AS (SELECT z.*, coalesce(f.d3 / 3.0 <= 6 AND c.d3 / 3.0 > 4, FALSE) AND NOT {flag('exclusion')} AS b5 FROM z4 z LEFT JOIN nf f USING (site_id, scene_id, x, y) LEFT JOIN nw c USING (site_id, scene_id, x, y))",
        kept("z6", "z5", "b5", 8, "count(*) OVER w >= 30"), kept("z7", "z6", "z6v", 8, "bool_or(close) OVER w"),
        f"""zone AS (SELECT z.*, z.band AND {flag('aoi')} AS in_band, {flag('aoi')} AS aoi,
  {flag('aoi')} AND CASE WHEN (y * 100 + x) % 97 = 1 OR (y * 100 + x) % 194 = 0 THEN FALSE WHEN (y * 100 + x) % 97 = 0 AND land THEN TRUE ELSE z7v END AS buffer FROM z7 z)""",
    ])


add("buffer_zone", "SELECT site_id, scene_id, x, y, human, in_band AS band, buffer FROM zone", zoned("m"))
add("buffer_area_per_year", f"""SELECT site_id, scene_id, year, {", ".join(f"round({c}, 6) AS {c}" for c in ("land", "buffer", "forest", "sparse", "field", "built"))}, round({RATE.replace("area_ha", "buffer")}, 6) AS rate,
round(CASE WHEN land > 0 THEN buffer / land * 100 END, 6) AS share_pct FROM yearly WINDOW w AS (PARTITION BY site_id ORDER BY year, scene_id)""",
    f"""{COVER}, {zoned("classes")}, yearly AS (SELECT site_id, scene_id, c.year, count(*) FILTER (buffer) * 0.0004::DOUBLE AS buffer, """
    + ", ".join(f"count(*) FILTER ({c} AND aoi) * 0.0004::DOUBLE AS {n}" for c, n in (("land", "land"), ("forest", "forest"), ("sparse", "sparse"), ("open", "field"), ("built", "built")))
    + " FROM zone JOIN catalogue c USING (site_id, scene_id) GROUP BY ALL)")

# change
MOVES = "mv AS (SELECT a.site_id, a.scene_id, a.k, a.year AS y0, b.year AS y1, a.x, a.y, CASE WHEN a.buffer THEN 'lost' ELSE 'gained' END AS kind FROM m a JOIN m b ON a.site_id = b.site_id AND a.x = b.x AND a.y = b.y AND b.k = a.k + 1 WHERE a.buffer <> b.buffer)"
add("mask_transitions", "SELECT site_id, k::INT AS k, y0, y1, x, y, kind FROM mv", MOVES)
add("union_past", "SELECT site_id, t, count(DISTINCT (x, y)) AS n FROM m, (SELECT (1990 + 8 * i)::DOUBLE AS t FROM range(5) r(i)) WHERE buffer AND year < t - 1e-9 GROUP BY ALL")
add("lost_vs_base", """SELECT site_id, t, compare_year, count(*) AS n, sum(y * 100 + x)::BIGINT AS mark, base FROM (
  SELECT DISTINCT b.site_id, c.year::DOUBLE AS t, 1990 AS compare_year, b.x, b.y, 'all' AS base, c.k FROM m b JOIN scenes c ON b.year < c.year WHERE b.buffer
  UNION ALL SELECT b.site_id, c.year, b.year, b.x, b.y, 'prev', c.k FROM m b JOIN scenes c ON b.k = c.k - 1 WHERE b.buffer
  UNION ALL SELECT b.site_id, c.year, b.year, b.x, b.y, 'first', c.k FROM m b JOIN scenes c ON b.k = 0 AND c.k > 0 WHERE b.buffer
  UNION ALL SELECT b.site_id, c.year, b.year, b.x, b.y, 'c', c.k FROM m b JOIN scenes c ON b.scene_id = 'c' AND c.k > 2 WHERE b.buffer) p
WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.site_id = p.site_id AND n.k = p.k AND n.x = p.x AND n.y = p.y AND n.buffer) GROUP BY ALL""")


def draw(seed: str, n: str) -> str:
    """Draw n of the generator, with 128-bit integers."""
    one = f"((({seed})::HUGEINT + (({n}) + 1)::HUGEINT * 1831565813) & 4294967295::HUGEINT)"
    t = f"((xor({one}, {one} >> 15) * ({one} | 1::HUGEINT)) & 4294967295::HUGEINT)"
    return f"(SELECT xor(u, u >> 14)::DOUBLE / 4294967296 FROM (SELECT xor((t + (xor(t, t >> 7) * (t | 61::HUGEINT) & 4294967295::HUGEINT)) & 4294967295::HUGEINT, t) AS u FROM (SELECT {t} AS t)))"


def ranked(name: str, source: str, keys: str, p: str) -> str:
    """CTE: source with its 0-based rank by bucket of the priority, ties in raster order."""
    return f"""{name}_b AS (SELECT *, greatest(max({p}::DOUBLE) OVER (PARTITION BY {keys}), 0) AS mx FROM {source}),
{name}_n AS (SELECT *, least(1048576, floor(mx / 0.25) + 2) AS nb FROM {name}_b),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY least(nb - 1, floor({p}::DOUBLE * ((nb - 1) / greatest(mx, 1e-9)))), y, x) - 1 AS rank FROM {name}_n)"""


add("jitter", f"SELECT event_id, round({draw('104730', 'event_id')}, 12) AS u FROM events")
add("priority_order", "SELECT site_id, scene_id, x, y, rank FROM o", "pp AS (SELECT site_id, scene_id, x, y, ((x * 37 + y * 11) % 101 / 7::DOUBLE)::FLOAT AS p FROM m WHERE buffer), " + ranked("o", "pp", "site_id, scene_id", "p"))
INTERVALS = ", ".join([
    MOVES, near("df", "m", "forest", "(site_id, scene_id, x, y) IN (SELECT (site_id, scene_id, x, y) FROM mv WHERE kind = 'lost')"), near("db", "m", "buffer", "(site_id, scene_id, x, y) IN (SELECT (site_id, scene_id, x, y) FROM mv WHERE kind = 'gained')"),
    """i0 AS (SELECT mv.*, (coalesce(df.d3, db.d3) / 3::DOUBLE)::FLOAT AS p0, row_number() OVER (PARTITION BY mv.site_id, k ORDER BY kind = 'gained', mv.y, mv.x) - 1 AS j
  FROM mv LEFT JOIN df ON kind = 'lost' AND df.site_id = mv.site_id AND df.scene_id = mv.scene_id AND df.x = mv.x AND df.y = mv.y LEFT JOIN db ON kind = 'gained' AND db.site_id = mv.site_id AND db.scene_id = mv.scene_id AND db.x = mv.x AND db.y = mv.y)""",
    f"i1 AS (SELECT *, (p0 + {draw('1 + k * 7919', 'j')} * 6)::FLOAT AS p FROM i0)",
    ranked("iv", "i1", "site_id, k, kind", "p"),
])
add("build_intervals", "SELECT site_id, k::INT AS k, x, y, kind, rank FROM iv", INTERVALS)


def frames(first: float, last: float, step: float) -> str:
    """CTE cur: site_id, t, x, y of observed and interpolated years up to the last scene."""
    return f"""ts AS (SELECT {first}::DOUBLE + i * {step} AS t FROM range({int((last - first) / step) + 1}) r(i)),
at0 AS (SELECT t, max(k) AS k FROM ts JOIN scenes ON year <= t OR k = 0 GROUP BY t),
at1 AS (SELECT t, a.k, CASE WHEN a.k = 4 OR t < 1990 THEN 0 ELSE (t - s.year) / ((SELECT n.year FROM scenes n WHERE n.k = a.k + 1) - s.year) END AS f FROM at0 a JOIN scenes s USING (k)),
mvr AS (SELECT site_id, t, x, y, kind FROM (SELECT iv.*, count(*) OVER (PARTITION BY site_id, k, kind) AS n FROM iv) JOIN at1 USING (k) WHERE rank < floor(f * n + 0.5)),
cur AS (SELECT site_id, t, x, y FROM m JOIN at1 USING (k) WHERE buffer AND (site_id, t, x, y) NOT IN (SELECT (site_id, t, x, y) FROM mvr WHERE kind = 'lost')
  UNION ALL SELECT site_id, t, x, y FROM mvr WHERE kind = 'gained')"""


add("interpolate_mask", "SELECT site_id, t, count(*) AS n, sum(y * 100 + x)::BIGINT AS mark FROM cur GROUP BY ALL", INTERVALS + ", " + frames(1988, 2024, 1.5))
GRID = "ts AS (SELECT {0}::DOUBLE + i * {2} AS t FROM range({3}) r(i))"
add("observed_area_at", """SELECT site_id, t, round(CASE WHEN t <= 1990 THEN (SELECT area_ha FROM series s WHERE s.site_id = z.site_id AND year = 1990) WHEN t >= 2022 THEN (SELECT area_ha FROM series s WHERE s.site_id = z.site_id AND year = 2022)
ELSE (SELECT s.area_ha + (t - s.year) / (n.year - s.year) * (n.area_ha - s.area_ha) FROM (SELECT *, CASE scene_id WHEN 'a' THEN 'b' WHEN 'b' THEN 'c' WHEN 'c' THEN 'd' ELSE 'e' END AS nx FROM series) s JOIN series n ON n.site_id = s.site_id AND n.scene_id = s.nx
  WHERE s.site_id = z.site_id AND s.year < t AND t <= n.year) END, 6) AS area_ha FROM sites z, ts""", GRID.format(1988, 0, 0.5, 85))
add("area_change_rate", f"SELECT site_id, year::INT AS year, area_ha, round({RATE}, 6) AS rate FROM oseries WINDOW w AS (PARTITION BY site_id ORDER BY year)")
add("buffer_share", "SELECT site_id, scene_id, round(CASE WHEN scene_id <> 'e' THEN count(*) FILTER (buffer) * 0.0004::DOUBLE / (count(*) FILTER (land) * 0.0004::DOUBLE) * 100 END, 6) AS share_pct FROM m GROUP BY site_id, scene_id")
add("frame_years", """SELECT site_id, year::DOUBLE AS t FROM series UNION SELECT site_id, y::DOUBLE FROM setup, (SELECT unnest(range(1900, 2400, 5)) AS y) WHERE y > start_year AND y <= x_max
UNION SELECT site_id, floor(disappear_year + 0.5) FROM setup WHERE disappear_year IS NOT NULL""", SETUP)


def order(jitter: bool, protect: float, scene: str = "e", n: str = "") -> str:
    """CTEs ro{n}: site_id, x, y, rank of the start scene's buffer."""
    start = f"(SELECT * FROM m WHERE scene_id = '{scene}')"
    return ", ".join([
        near(f"rf{n}", start, "forest", "buffer"), near(f"rb{n}", start, "built", "buffer"),
        f"rn{n} AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY y, x) - 1 AS j FROM rf{n}), r0{n} AS (SELECT a.site_id, a.x, a.y, ((a.d3 / 3::DOUBLE)::FLOAT + {draw('104730', 'j')} * 6)::FLOAT AS p0, {protect}::DOUBLE - (b.d3 / 3::DOUBLE)::FLOAT::DOUBLE AS gap FROM rn{n} a JOIN rb{n} b USING (site_id, x, y))",
        f"r1{n} AS (SELECT *, CASE WHEN gap > 0 THEN (p0 + gap)::FLOAT ELSE p0 END AS p FROM r0{n})", ranked(f"ro{n}", f"r1{n}", "site_id", "p"),
    ])


def schedule(t: str) -> str:
    return f"CASE WHEN {t} <= start_year THEN a0 ELSE greatest(0, least(a0, a0 + slope * ({t} - start_year))) END"


FUTURE = f"fut AS (SELECT site_id, t, x, y FROM ro JOIN (SELECT site_id, count(*) AS n FROM ro GROUP BY 1) USING (site_id) JOIN setup USING (site_id), ts WHERE t > start_year AND rank >= least(n, greatest(0, floor((n * 0.0004::DOUBLE - ({schedule('t')})) / 0.0004::DOUBLE + 0.5))))"
SUMMARY = """past AS (SELECT DISTINCT site_id, t, x, y FROM m, ts WHERE buffer AND year < t - 1e-9),
now AS (SELECT * FROM cur WHERE t <= 2022 UNION ALL SELECT * FROM fut),
gone AS (SELECT site_id, t, count(*) AS n FROM past ANTI JOIN now USING (site_id, t, x, y) GROUP BY ALL),
have AS (SELECT site_id, t, count(*) AS n FROM now GROUP BY ALL),
frm AS (SELECT z.site_id, ts.t, CASE WHEN ts.t > 2022 THEN 'pred' WHEN ts.t IN (SELECT year FROM scenes) THEN 'obs' ELSE 'interp' END AS mode, coalesce(have.n, 0) * 0.0004::DOUBLE AS area_ha, coalesce(gone.n, 0) * 0.0004::DOUBLE AS lost_ha,
CASE WHEN ts.t > 1990 THEN 1990 END AS compare_year FROM sites z CROSS JOIN ts LEFT JOIN have ON have.site_id = z.site_id AND have.t = ts.t LEFT JOIN gone ON gone.site_id = z.site_id AND gone.t = ts.t)"""
add("frame_summary", "SELECT site_id, t, mode, round(area_ha, 6) AS area_ha, round(lost_ha, 6) AS lost_ha, compare_year FROM frm", ", ".join([INTERVALS, frames(1988, 2040, 4), order(True, 0), SETUP, FUTURE, SUMMARY]))
add("write_frame_table", "SELECT site_id::VARCHAR AS site_id, t::VARCHAR AS year, mode, printf('%.2f', area_ha) AS buffer_ha, printf('%.2f', lost_ha) AS lost_ha, compare_year::BIGINT AS compare_year FROM frm", ", ".join([INTERVALS, frames(1990, 2022, 4), order(True, 0), SETUP, FUTURE, SUMMARY]))

#: Options of the sites of ``frame_bases``: base, start scene and its year, slope of the line or of the logarithm, whether it is of the logarithm, protection.
OPTIONS = [
    ("all", "e", 2022, "regr_slope(area_ha, year)", False, 0), ("prev", "d", 2014, "regr_slope(ln(area_ha), year)", True, 0), ("first", "e", 2022, "(arg_max(area_ha, year) - max(area_ha) FILTER (year = 2014)) / 8", False, 5),
    ("c", "c", 2005, "-0.04::DOUBLE", True, 0), ("none", "e", 2022, "regr_slope(area_ha, year)", False, 0),
]


def framed(n: int) -> str:
    """CTEs fr{n}: site_id, t, mode, compare_year, bs (base scene), px{n}: the pixels with flags buffer, lost and forest."""
    base, scene, year, slope, log, protect = OPTIONS[n]
    line = "a0 * exp(slope * (t - 1.0 * Y))" if log else "a0 + slope * (t - 1.0 * Y)"
    before = "(SELECT max(s.year) FROM scenes s WHERE s.year < t)"
    year_of = {
        "all": "CASE WHEN t > 1990 THEN 1990 END", "first": "CASE WHEN t > 1990 THEN 1990 END", "c": "CASE WHEN t > 2005 THEN 2005 END", "none": "NULL::INT",
        "prev": f"CASE WHEN t > {year} THEN {year} WHEN t < 1990 THEN 1990 ELSE {before} END",
    }[base]
    past = {"all": "m.year < t", "none": "FALSE"}.get(base, "m.year = compare_year")
    return f"""cn{n} AS (SELECT site_id, count(*) AS n FROM ro{n} GROUP BY 1),
tr{n} AS (SELECT site_id, {slope} AS slope, arg_max(area_ha, year) AS a0 FROM series WHERE year <= {year} GROUP BY 1),
fr{n} AS (SELECT z.site_id, t, CASE WHEN t > {year} THEN 'pred' WHEN t IN (SELECT year FROM scenes) THEN 'obs' ELSE 'interp' END AS mode, {year_of} AS compare_year,
  CASE WHEN t > {year} THEN '{scene}' WHEN t < 1990 THEN 'a' ELSE (SELECT arg_max(s.scene_id, s.year) FROM scenes s WHERE s.year <= t) END AS bs FROM sites z, ts),
nw{n} AS (SELECT site_id, t, x, y FROM cur WHERE t <= {year} UNION ALL SELECT site_id, t, x, y FROM ro{n} JOIN cn{n} USING (site_id) JOIN tr{n} USING (site_id), ts
  WHERE t > {year} AND rank >= least(n, greatest(0, floor((n * 0.0004::DOUBLE - greatest(0, least(a0, {line.replace("Y", str(year))}))) / 0.0004::DOUBLE + 0.5)))),
lo{n} AS (SELECT DISTINCT m.site_id, t, x, y FROM m JOIN fr{n} USING (site_id) WHERE m.buffer AND {past}),
ls{n} AS (SELECT * FROM lo{n} ANTI JOIN nw{n} USING (site_id, t, x, y)),
px{n} AS (SELECT site_id, t, x, y, max(b) AS b, max(l) AS l, max(f) AS f FROM (SELECT *, 1 AS b, 0 AS l, 0 AS f FROM nw{n} UNION ALL SELECT *, 0, 1, 1 FROM ls{n}
  UNION ALL SELECT m.site_id, t, x, y, 0, 0, 1 FROM m JOIN fr{n} ON m.site_id = fr{n}.site_id AND m.scene_id = bs WHERE m.forest) GROUP BY ALL)"""


def all_framed(select: str) -> str:
    return " UNION ALL ".join(select.replace("{n}", str(n)) for n in range(len(OPTIONS)))


FRAMED = ", ".join([*(order(True, o[5], o[1], str(n)) for n, o in enumerate(OPTIONS)), *(framed(n) for n in range(len(OPTIONS)))])
add("frame_bases", all_framed("""SELECT site_id * 10 + {n} AS site_id, t, mode, round(coalesce(b.n, 0) * 0.0004::DOUBLE, 6) AS area_ha, round(coalesce(l.n, 0) * 0.0004::DOUBLE, 6) AS lost_ha, compare_year::DOUBLE AS compare_year, bs AS scene_id
FROM fr{n} LEFT JOIN (SELECT site_id, t, count(*) AS n FROM nw{n} GROUP BY ALL) b USING (site_id, t) LEFT JOIN (SELECT site_id, t, count(*) AS n FROM ls{n} GROUP BY ALL) l USING (site_id, t)"""), f"{INTERVALS}, {frames(1988, 2040, 1)}, {FRAMED}")
add("frame_pixels", all_framed("SELECT site_id * 10 + {n} AS site_id, t, sum(b)::BIGINT AS buffer, sum(l)::BIGINT AS lost, sum(f)::BIGINT AS forest, sum((y * 100 + x) * (1 + 2 * b + 3 * l + 5 * f))::BIGINT AS mark FROM px{n} GROUP BY site_id, t"), f"{INTERVALS}, {frames(1988, 2040, 13)}, {FRAMED}")

# trend and projection
add("fit_trend", """SELECT site_id, 'linear' AS model, 'linear' AS kind, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, points, TRUE AS ok FROM lin
UNION ALL SELECT site_id, 'exp', 'exp', round(slope, 6), round(intercept, 4), round(r2, 6), points, TRUE FROM ex
UNION ALL SELECT site_id, 'last', 'linear', round(s, 6), NULL, NULL, points, TRUE FROM lin JOIN (SELECT site_id, (area_ha - lag(area_ha) OVER w) / (year - lag(year) OVER w) AS s FROM oseries WINDOW w AS (PARTITION BY site_id ORDER BY year) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY year DESC) = 1) USING (site_id)
UNION ALL SELECT site_id, 'manual', 'exp', -0.02, NULL, NULL, points, TRUE FROM lin""", TREND.format(n="lin", y="area_ha", s="oseries") + ", " + TREND.format(n="ex", y="ln(area_ha)", s="oseries"))
add("area_schedule", f"""SELECT site_id, 'linear' AS model, t, round({schedule('t')}, 6) AS area_ha FROM setup, ts
UNION ALL SELECT site_id, 'exp', t, round(CASE WHEN t <= start_year THEN a0 ELSE greatest(0, least(a0, a0 * exp(ex.slope * (t - start_year)))) END, 6) FROM setup JOIN ex USING (site_id), ts
UNION ALL SELECT site_id, 'manual', t, round(CASE WHEN t <= start_year THEN a0 ELSE greatest(0, least(a0, a0 * exp(-0.02 * (t - start_year)))) END, 6) FROM setup, ts""",
    SETUP + ", " + TREND.format(n="ex", y="ln(area_ha)", s="series") + ", " + GRID.format(2020, 0, 2, 21))
add("disappear_year", "SELECT site_id, target, round(CASE WHEN a0 <= target THEN start_year WHEN slope >= 0 THEN NULL ELSE start_year + (target - a0) / slope END, 6) AS year FROM setup, (VALUES (0::DOUBLE), (0.05), (0.2), (0.5), (5)) v(target)", SETUP)
add("trend_rates", "SELECT site_id, round(a0 * ex.slope, 6) AS rate_ha, round(CASE WHEN a0 > 0 THEN ex.slope * 100 ELSE 0 END, 6) AS rate_pct FROM setup JOIN ex USING (site_id)", SETUP + ", " + TREND.format(n="ex", y="ln(area_ha)", s="series"))
add("removal_order", "SELECT site_id, x, y, rank FROM ro", order(True, 5))
add("projected_mask", f"SELECT site_id, t, count(*) AS n, sum(y * 100 + x)::BIGINT AS mark FROM (SELECT site_id, t, x, y FROM ro JOIN (SELECT site_id, count(*) AS n FROM ro GROUP BY 1) USING (site_id) JOIN setup USING (site_id), ts WHERE rank >= least(n, greatest(0, floor((n * 0.0004::DOUBLE - ({schedule('t')})) / 0.0004::DOUBLE + 0.5)))) GROUP BY ALL", ", ".join([order(True, 0), SETUP, GRID.format(2020, 0, 3, 9)]))
add("projection_setup", """SELECT site_id, start_year, round(a0, 6) AS a0, round(threshold_ha, 6) AS threshold_ha, round(disappear_year, 6) AS disappear_year, round(rate_ha, 6) AS rate_ha, round(rate_pct, 6) AS rate_pct, x_min, x_max,
CASE WHEN disappear_year > start_year THEN '' WHEN disappear_year IS NOT NULL THEN 'below the threshold at the start' ELSE 'no decline: not gone within 100 years' END AS note FROM setup""", SETUP)
add("forecast_table", """SELECT site_id, 'forecast' AS kind_of_row, round(year, 6) AS year, round(area_ha, 6) AS area_ha, round(area_ha / land * 100, 6) AS share_pct, round(rate_ha, 6) AS rate_ha FROM fc
UNION ALL SELECT site_id, 'gone', round(disappear_year, 6), NULL, NULL, NULL FROM setup WHERE disappear_year IS NOT NULL""", f"{SETUP}, {OBSERVED}, {FORECAST}")
add("hindcast", """SELECT s.site_id, scene_id, year, round(area_ha, 6) AS area_ha, round(p, 6) AS predicted_ha, round(p - area_ha, 6) AS error_ha FROM (
SELECT s.*, greatest(0, least(c.area_ha, c.area_ha + l.slope * (s.year - 2005))) AS p FROM series s JOIN lin3 l USING (site_id) JOIN series c ON c.site_id = s.site_id AND c.scene_id = 'c' WHERE s.year > 2005) s""", TREND.format(n="lin3", y="area_ha", s="(SELECT * FROM series WHERE year <= 2005)"))

# coding, text and dates
add("rle_runs", """SELECT site_id, scene_id, min(i)::BIGINT AS start, v, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY site_id, scene_id, v ORDER BY i) AS g
  FROM (SELECT site_id, scene_id, (CASE WHEN y % 9 < 4 AND x >= y % 9 THEN 0 ELSE (cls = 1)::INT - (cls = 0)::INT END)::BIGINT AS v, row_number() OVER (PARTITION BY site_id, scene_id ORDER BY y, x) - 1 AS i FROM px)) GROUP BY site_id, scene_id, v, g""")
add("rle_encode", "SELECT site_id, scene_id, array_to_string(runs, ',') AS runs FROM rle", RLE)
add("rle_decode", "SELECT site_id, scene_id, x, y, (cls = 1)::BIGINT - (cls = 0)::BIGINT AS v FROM px")
add("dms_to_decimal", "SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM img", FILES)
add("gps_altitude", "SELECT name, round(alt, 6) AS alt FROM img", FILES)
add("photo_datetime", "SELECT name, taken_at, replace(taken_at[1:10], ':', '-') || taken_at[11:] AS taken FROM img", FILES)
add("parse_iso6709", "SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 6) AS alt, taken_at FROM mov", FILES)
add("gps_listing", "SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 6) AS alt, taken_at, status FROM listing", FILES)
add("photo_paths", "SELECT photo_id, 'data/thumbs/IMG_' || photo_id || '.jpg' AS thumb, 'data/mid/IMG_' || photo_id || '.jpg' AS mid, 'data/IMG_' || photo_id || '.JPG' AS \"full\" FROM photos")
add("tag_counts", "SELECT tag, label, color, count(*) AS n FROM photos JOIN tags USING (tag) GROUP BY ALL")
