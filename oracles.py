"""DuckDB SQL that answers every registered query independently of the Spark plans."""

from __future__ import annotations

from zoneflow import texts

ZONES = """
zones AS (
  SELECT CAST(c_custkey AS VARCHAR) AS taz,
         CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS g250,
         CAST(c_nationkey AS VARCHAR) AS g33, CAST(n_regionkey AS VARCHAR) AS g15,
         'CITY_' || CAST(c_custkey // 25 AS VARCHAR) AS city,
         CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_name END AS zone_name,
         CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS name_250, n_name AS name_33, r_name AS name_15,
         CAST(34 AS DOUBLE) + (c_custkey % 40) * CAST(0.0625 AS DOUBLE) AS x0,
         CAST(29.5 AS DOUBLE) + (c_custkey // 40) * CAST(0.0625 AS DOUBLE) AS y0
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

OD = """
od AS (
  SELECT CAST(o_custkey AS VARCHAR) AS from_zone, CAST(l_suppkey AS VARCHAR) AS to_zone,
         CASE isodow(l_shipdate) WHEN 5 THEN 'friday' WHEN 6 THEN 'saturday' ELSE 'weekday' END AS day,
         CAST(l_partkey % 24 AS INTEGER) AS hour, l_quantity AS trips
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

PICKED = "('3', '7', '11')"
MORNING = "day = 'weekday' AND hour >= 7 AND hour < 10"
WEEKDAY = "day = 'weekday'"


def base(*more: str) -> str:
    return "WITH " + ",".join([ZONES, OD, *more]) + "\n"


def flows(o: str, d: str, where: str = "TRUE", having: float = 1, anti: bool = False) -> str:
    """Roll-up written as the plain join query; `anti` drops pairs that share a base zone."""
    join = cond = ""
    if anti:
        join = f"LEFT JOIN (SELECT DISTINCT {o} AS a, {d} AS b FROM zones) ip ON ip.a = o.{o} AND ip.b = d.{d}"
        cond = "AND ip.a IS NULL"
    return f"""SELECT o.{o} AS origin_id, d.{d} AS dest_id, SUM(trips) AS trips
      FROM od JOIN zones o ON from_zone = o.taz JOIN zones d ON to_zone = d.taz {join}
      WHERE {where} {cond} GROUP BY o.{o}, d.{d} HAVING SUM(trips) >= {having}"""


def tagged(tag: str, body: str) -> str:
    return f"SELECT '{tag}' AS tag, origin_id, dest_id, trips FROM ({body})"


def top(body: str, n: int) -> str:
    return f"SELECT * FROM ({body}) ORDER BY trips DESC, origin_id, dest_id LIMIT {n}"


def limited(body: str, cap: int | None) -> str:
    return body if cap is None else top(body, cap)


IN_O, IN_D = f"o.g33 IN {PICKED}", f"d.g33 IN {PICKED}"
OUT_O, OUT_D = f"o.g33 NOT IN {PICKED}", f"d.g33 NOT IN {PICKED}"
DIFFER = "o.g33 <> d.g33"


def mode4(time: str, loops: bool = True, cap: int | None = None) -> str:
    extra = "" if loops else f" AND {DIFFER}"
    parts = {"internal": f"{IN_O} AND {IN_D}{extra}", "outgoing": f"{IN_O} AND {OUT_D}", "incoming": f"{OUT_O} AND {IN_D}"}
    return "\nUNION ALL\n".join(
        f"({tagged(tag, limited(flows('g33', 'g33', f'{time} AND {where}'), cap))})" for tag, where in parts.items()
    )


MODE4 = f"m4 AS ({mode4(MORNING)})"
NAMES33 = "names AS (SELECT DISTINCT g33 AS id, name_33 AS label FROM zones)"
CENTERS33 = """centers AS (
  SELECT g33 AS id, MIN(name_33) AS label, AVG(x0 + 0.03125) AS lon, AVG(y0 + 0.03125) AS lat FROM zones GROUP BY g33)"""

# zone tabs of the breakdown as one table of (tab, id, trips)
TAB_ROWS = """tab_rows AS (
  SELECT 'outgoing' AS tab, dest_id AS id, SUM(trips) AS trips FROM m4 WHERE tag = 'outgoing' GROUP BY dest_id
  UNION ALL SELECT 'incoming', origin_id, SUM(trips) FROM m4 WHERE tag = 'incoming' GROUP BY origin_id
  UNION ALL SELECT 'internal_origins', origin_id, SUM(trips) FROM m4 WHERE tag = 'internal' GROUP BY origin_id
  UNION ALL SELECT 'internal_dests', dest_id, SUM(trips) FROM m4 WHERE tag = 'internal' GROUP BY dest_id)"""
SLICES = f"""ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tab ORDER BY trips DESC, id) AS r FROM tab_rows),
slices AS (
  SELECT tab, ranked.id, COALESCE(label, ranked.id) AS label, trips, CAST(1 AS BIGINT) AS n_zones, r AS ord
  FROM ranked LEFT JOIN names ON names.id = ranked.id WHERE r <= 10
  UNION ALL
  SELECT tab, 'others', 'אחרים (' || CAST(COUNT(*) AS VARCHAR) || ' אזורים)', SUM(trips), COUNT(*), 11
  FROM ranked WHERE r > 10 GROUP BY tab)"""
OVERVIEW = f"""overview AS (
  SELECT * FROM (
    SELECT 'outgoing' AS id, '{texts.TAG_LABELS["outgoing"]}' AS label, SUM(trips) AS trips, 1 AS ord FROM m4 WHERE tag = 'outgoing'
    UNION ALL SELECT 'incoming', '{texts.TAG_LABELS["incoming"]}', SUM(trips), 2 FROM m4 WHERE tag = 'incoming'
    UNION ALL SELECT 'inter_selected', '{texts.INTER_SELECTED}', SUM(trips), 3 FROM m4 WHERE tag = 'internal' AND origin_id <> dest_id
    UNION ALL SELECT 'intra_zone', '{texts.INTRA_ZONE}', SUM(trips), 4 FROM m4 WHERE tag = 'internal' AND origin_id = dest_id)
  WHERE trips > 0)"""

GEOMETRY = """geo AS (
  SELECT m4.*, o.lon AS x1, o.lat AS y1, d.lon AS x2, d.lat AS y2, o.label AS o_label, d.label AS d_label,
         MAX(trips) OVER (PARTITION BY tag) AS largest
  FROM m4 JOIN centers o ON o.id = origin_id JOIN centers d ON d.id = dest_id)"""

MELT = " UNION ALL ".join(f"SELECT from_zone, to_zone, day, {h} AS hour, SUM(trips) AS trips FROM od WHERE hour = {h} GROUP BY ALL"
                          for h in range(24))

SIDES = """sides AS (
  SELECT taz, g250, g33, g15, city, x0 AS x1, y0 AS y1, x0 + 0.0625 AS x2, y0 AS y2 FROM zones
  UNION ALL SELECT taz, g250, g33, g15, city, x0, y0 + 0.0625, x0 + 0.0625, y0 + 0.0625 FROM zones
  UNION ALL SELECT taz, g250, g33, g15, city, x0, y0, x0, y0 + 0.0625 FROM zones
  UNION ALL SELECT taz, g250, g33, g15, city, x0 + 0.0625, y0, x0 + 0.0625, y0 + 0.0625 FROM zones)"""


def pieces() -> str:
    """Connected pieces of each group by transitive closure over zones that share a side."""
    touching = " UNION ALL ".join(
        f"""SELECT '{level}' AS level, a.{level} AS group_id, a.taz AS p, b.taz AS r FROM zones a JOIN zones b
        ON a.{level} = b.{level} AND ((a.x0 = b.x0 AND ABS(a.y0 - b.y0) <= 0.0625) OR (a.y0 = b.y0 AND ABS(a.x0 - b.x0) <= 0.0625))"""
        for level in ("g250", "g33", "g15", "city"))
    return "WITH RECURSIVE " + ",".join([ZONES, SIDES, f"near AS ({touching})", """reach AS (
      SELECT level, group_id, p, r FROM near UNION
      SELECT reach.level, reach.group_id, reach.p, near.r FROM reach JOIN near
        ON near.level = reach.level AND near.group_id = reach.group_id AND near.p = reach.r)""",
      "piece AS (SELECT level, group_id, p, MIN(r) AS piece FROM reach GROUP BY ALL)"]) + "\n"


def outline(level: str) -> str:
    return f"""SELECT '{level}' AS level, group_id, COUNT(*) AS n_edges, COUNT(*) * CAST(0.0625 AS DOUBLE) AS perimeter FROM (
      SELECT {level} AS group_id, x1, y1, x2, y2 FROM sides GROUP BY ALL HAVING COUNT(*) = 1) GROUP BY group_id"""


def dissolved(level: str, label: str) -> str:
    return f"""SELECT '{level}' AS level, {level} AS group_id, MIN({label}) AS label, COUNT(*) AS n_zones,
      COUNT(*) * CAST(0.00390625 AS DOUBLE) AS area, ROUND(AVG(x0 + 0.03125), 6) AS centroid_lon,
      ROUND(AVG(y0 + 0.03125), 6) AS centroid_lat FROM zones GROUP BY {level}"""


def summary(cap: int | None, time: str = MORNING, day: str = texts.DAY_LABELS["weekday"], hours: str = "7–10") -> str:
    warning = f"(SELECT CASE WHEN MAX(n) > {cap} THEN 'הנתונים גדולים מ-{cap} שורות — מוצגות {cap} הגדולות בלבד' END FROM uncut)" if cap else "NULL"
    rows = [
        (texts.KEY_DAY, f"'{day}'"), (texts.KEY_HOURS, f"'{hours}'"), (texts.KEY_MIN_TRIPS, "'1'"),
        (texts.KEY_SELF_LOOPS, f"'{texts.YES}'"), (texts.KEY_LEVEL, "'TAZ_33'"),
        (texts.KEY_FLOWS, "(SELECT CAST(COUNT(*) AS VARCHAR) FROM m4)"),
        (texts.KEY_TRIPS, "(SELECT CAST(CAST(SUM(FLOOR(trips + 0.5)) AS BIGINT) AS VARCHAR) FROM m4)"),
        (texts.KEY_WARNING, warning),
        (texts.KEY_ZONES, "(SELECT label FROM names WHERE id = '3')"), ("", "(SELECT label FROM names WHERE id = '7')"),
        ("", "(SELECT label FROM names WHERE id = '11')"),
    ]
    body = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ord, '{key}' AS key, {value} AS value" for i, (key, value) in enumerate(rows, 1)
    )
    return (
        base(f"m4 AS ({mode4(time, cap=cap)})", NAMES33, f"every AS ({mode4(time, cap=None)})",
             "uncut AS (SELECT tag, COUNT(*) AS n FROM every GROUP BY tag)")
        + f"SELECT * FROM ({body}) WHERE value IS NOT NULL"
    )


def name_list() -> str:
    """Longest prefix by brute force over all prefixes that could fit."""
    return base("""named AS (
      SELECT g33 AS group_id, COALESCE(zone_name, taz) AS name, ROW_NUMBER() OVER (PARTITION BY g33 ORDER BY taz) AS r,
             COUNT(*) OVER (PARTITION BY g33) AS n FROM zones)""", """running AS (
      SELECT *, STRING_AGG(name, ', ') OVER (PARTITION BY group_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS upto FROM named)""",
      """texted AS (SELECT *, CASE WHEN r = n THEN upto ELSE upto || ', ועוד ' || CAST(n - r AS VARCHAR) || ' אזורים' END AS t FROM running)""",
      """missed AS (SELECT group_id, MIN(r) AS r FROM texted WHERE LENGTH(t) > 120 GROUP BY group_id)""",
      """whole AS (SELECT group_id, t FROM texted WHERE r = n AND LENGTH(t) <= 120)""") + """
    SELECT g.group_id, COALESCE(whole.t, texted.t, 'ועוד ' || CAST(g.n AS VARCHAR) || ' אזורים') AS names
    FROM (SELECT DISTINCT group_id, n FROM named) g LEFT JOIN whole USING (group_id) LEFT JOIN missed USING (group_id)
    LEFT JOIN texted ON texted.group_id = g.group_id AND texted.r = missed.r - 1"""


def oracle_sql() -> dict[str, str]:
    m4_all = base(MODE4)
    q: dict[str, str] = {}
    q["flows_same_level"] = base() + flows("g33", "g33", f"{MORNING} AND {DIFFER}")
    q["flows_cross_level"] = base() + flows("g33", "city", anti=True)
    q["flows_with_self_loops"] = base() + flows("g15", "g15", MORNING)
    q["flows_hour_range"] = base() + flows("g33", "g33", f"hour BETWEEN 22 AND 23 AND {DIFFER}")
    q["flows_day_filter"] = base() + flows("g33", "g33", f"day = 'saturday' AND {DIFFER}")
    q["flows_all_days"] = base() + flows("g250", "g250", "o.g250 <> d.g250")
    q["flows_include_ids"] = base() + flows("g33", "g33", f"{MORNING} AND {DIFFER} AND {IN_O} AND d.g33 IN ('1', '2', '5')")
    q["flows_exclude_ids"] = base() + flows("g33", "g33", f"{MORNING} AND {DIFFER} AND {IN_O} AND {OUT_D}")
    q["flows_min_trips"] = base() + flows("taz", "g33", having=100, anti=True)
    q["flows_topk"] = base(f"f AS ({flows('taz', 'taz', 'o.taz <> d.taz')})") + """
      SELECT origin_id, dest_id, trips, ROW_NUMBER() OVER (ORDER BY trips DESC, origin_id, dest_id) AS rnk,
             (SELECT COUNT(*) FROM f) > 5000 AS truncated FROM f QUALIFY rnk <= 5000"""
    q["internal_pairs"] = base() + "SELECT DISTINCT g33 AS orig_gid, city AS dest_gid FROM zones"
    q["level_lookup"] = base() + " UNION ALL ".join(
        f"SELECT taz AS base_id, '{level}' AS level, {level} AS group_id FROM zones" for level in ("taz", "g250", "g33", "g15", "city"))
    q["od_ingest_long"] = base(f"melted AS ({MELT})") + "SELECT * FROM melted WHERE trips > 0"
    q["od_roundtrip"] = base() + "SELECT day, COUNT(*) AS n, SUM(trips) AS trips FROM od GROUP BY day"
    q["zones_base"] = base() + "SELECT taz, g250, g33, g15, city, zone_name FROM zones"
    q["zone_level_names"] = base("""sheet AS (
      SELECT CAST(n_nationkey AS DOUBLE) AS id, n_name AS name, n_nationkey AS src FROM nation
      UNION ALL SELECT NULL, 'note', -1 UNION ALL SELECT n_nationkey, 'DUP', n_nationkey + 100 FROM nation WHERE n_nationkey < 3)""",
      "clean AS (SELECT CAST(CAST(id AS BIGINT) AS VARCHAR) AS id, name FROM sheet WHERE id IS NOT NULL "
      "QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY src) = 1)") + """
      SELECT DISTINCT g33 AS group_id, clean.name AS label FROM zones LEFT JOIN clean ON clean.id = g33"""
    ids = "(SELECT from_zone AS id FROM od UNION SELECT to_zone FROM od)"
    unknown = "od2 AS (SELECT * FROM od UNION ALL SELECT from_zone, 'X' || to_zone, day, hour, trips FROM od WHERE hour = 0)"
    ids = "(SELECT from_zone AS id FROM od2 UNION SELECT to_zone FROM od2)"
    q["quality_summary"] = base(unknown) + f"""SELECT (SELECT COUNT(*) FROM od2) AS n_rows, (SELECT COUNT(DISTINCT day) FROM od2) AS n_days,
      (SELECT STRING_AGG(DISTINCT day, ',' ORDER BY day) FROM od2) AS days, (SELECT MIN(trips) FROM od2) AS min_trips,
      (SELECT MAX(trips) FROM od2) AS max_trips, (SELECT COUNT(*) FROM {ids}) AS n_od_zones, (SELECT COUNT(*) FROM zones) AS n_zones,
      (SELECT COUNT(*) FROM {ids} WHERE id NOT IN (SELECT taz FROM zones)) AS n_missing,
      (SELECT COUNT(*) FROM zones WHERE zone_name IS NULL) AS n_unnamed"""
    q["quality_missing_zones"] = base(unknown) + """SELECT zone_id FROM (
      (SELECT from_zone AS zone_id FROM od2 UNION SELECT to_zone FROM od2) EXCEPT SELECT taz FROM zones) ORDER BY zone_id LIMIT 20"""
    q["od_metadata"] = base() + """SELECT CAST(3 AS BIGINT) AS n_days, 'weekday,friday,saturday' AS days, CAST(0 AS BIGINT) AS hour_min,
      CAST(23 AS BIGINT) AS hour_max, CAST(1 AS DOUBLE) AS trips_min, MAX(trips) AS trips_max, MIN(trips) AS trips_lowest,
      CAST(5 AS BIGINT) AS n_levels FROM od"""

    out1, in1 = flows("g33", "g250", "o.g33 = '3'", anti=True), flows("g250", "g33", "d.g33 = '3'", anti=True)
    q["mode1_single_zone"] = base() + f"{tagged('outgoing', out1)} UNION ALL {tagged('incoming', in1)}"
    q["mode2_internal"] = base() + tagged("internal", flows("g33", "g33", f"{WEEKDAY} AND {IN_O} AND {IN_D}"))
    q["mode3_group_external"] = base() + " UNION ALL ".join([
        tagged("outgoing", flows("g33", "g33", f"{WEEKDAY} AND {IN_O} AND {OUT_D}")),
        tagged("incoming", flows("g33", "g33", f"{WEEKDAY} AND {OUT_O} AND {IN_D}"))])
    q["mode4_combined"] = base() + mode4(WEEKDAY, cap=20)
    q["mode_destination_role"] = base() + tagged("incoming", flows("g15", "g33", f"{WEEKDAY} AND {IN_D}", anti=True))

    q["breakdown_by_origin"] = m4_all.rstrip() + f", {NAMES33}" + """
      SELECT m.id, COALESCE(label, m.id) AS label, m.trips FROM (
        SELECT origin_id AS id, SUM(trips) AS trips FROM m4 WHERE tag = 'internal' GROUP BY origin_id) m LEFT JOIN names USING (id)"""
    q["breakdown_by_dest"] = q["breakdown_by_origin"].replace("origin_id AS id", "dest_id AS id").replace(
        "'internal' GROUP BY origin_id", "'outgoing' GROUP BY dest_id")
    sliced = base(MODE4, NAMES33, TAB_ROWS, SLICES, OVERVIEW)
    q["breakdown_topn_others"] = sliced + "SELECT id, label, trips, n_zones FROM slices WHERE tab = 'outgoing'"
    q["breakdown_overview"] = sliced + "SELECT id, label, trips FROM overview"
    q["breakdown_share"] = sliced + """
      SELECT id, trips, ROUND(trips / SUM(trips) OVER () * 100, 1) AS pct FROM slices WHERE tab = 'outgoing'"""
    q["breakdown_cumulative"] = sliced + """
      SELECT id, trips, ROUND(before / total * 360, 6) AS start_deg, ROUND(trips / total * 360, 6) AS sweep_deg,
             ROUND((before + trips / 2) / total * 360, 6) AS mid_deg, trips / total >= 0.05 AS show_label
      FROM (SELECT id, trips, SUM(trips) OVER () AS total,
                   (SELECT COALESCE(SUM(b.trips), 0) FROM slices b WHERE b.tab = 'outgoing' AND b.ord < a.ord) AS before
            FROM slices a WHERE tab = 'outgoing')"""
    q["export_breakdown"] = sliced + f"""
      , rows AS (
        SELECT tab, ord, CASE WHEN id = 'others' THEN '—' ELSE id END AS id, label, CAST(FLOOR(trips + 0.5) AS BIGINT) AS trips,
               ROUND(trips / SUM(trips) OVER (PARTITION BY tab) * 100, 1) AS pct FROM slices
        UNION ALL
        SELECT 'overview', ord, id, label, CAST(FLOOR(trips + 0.5) AS BIGINT), ROUND(trips / SUM(trips) OVER () * 100, 1) FROM overview)
      SELECT tab, id, label, trips, pct FROM rows
      UNION ALL SELECT tab, '', '{texts.TOTAL}', CAST(SUM(trips) AS BIGINT), 100.0 FROM rows GROUP BY tab"""
    q["flow_totals"] = m4_all + """SELECT COUNT(*) AS n_flows, CAST(FLOOR(SUM(trips) + 0.5) AS BIGINT) AS total_trips,
      MIN(trips) AS min_trips, MAX(trips) AS max_trips FROM m4"""

    q["zone_centroids"] = base() + "SELECT taz, x0 + 0.03125 AS centroid_lon, y0 + 0.03125 AS centroid_lat FROM zones"
    q["zone_extent"] = base() + """SELECT MIN(x0) AS min_lon, MIN(y0) AS min_lat, MAX(x0 + 0.0625) AS max_lon,
      MAX(y0 + 0.0625) AS max_lat FROM zones"""
    q["zones_dissolved"] = base() + " UNION ALL ".join(
        dissolved(*x) for x in (("g250", "name_250"), ("g33", "name_33"), ("g15", "name_15"), ("city", "city")))
    q["dissolve_boundary"] = base(SIDES) + " UNION ALL ".join(outline(level) for level in ("city", "g15", "g33", "g250"))
    q["zones_reproject"] = base() + """
      SELECT taz, 0 AS ring, "at", ROUND(x0 + 0.0625 * dx, 6) AS lon, ROUND(y0 + 0.0625 * dy, 6) AS lat
      FROM zones, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS corner("at", dx, dy)"""

    corners = '(VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS corner("at", dx, dy)'
    e2, w2 = "(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101))", "(2 / 298.257223563 - 1 / (298.257223563 * 298.257223563))"
    q["zones_datum_shift"] = base(
        f"degrees_of AS (SELECT taz, \"at\", radians(x0 + 0.0625 * dx) AS l, radians(y0 + 0.0625 * dy) AS p FROM zones, {corners})",
        f"normal AS (SELECT *, 6378137 / sqrt(1 - {e2} * sin(p) * sin(p)) AS n FROM degrees_of)",
        f"old AS (SELECT taz, \"at\", n * cos(p) * cos(l) AS x, n * cos(p) * sin(l) AS y, n * (1 - {e2}) * sin(p) AS z FROM normal)",
        "turn AS (SELECT radians(-0.33077 / 3600) AS rx, radians(-1.85269 / 3600) AS ry, radians(1.66969 / 3600) AS rz, 1 + 5.4248e-6 AS m)",
        "moved AS (SELECT taz, \"at\", -24.0024 + m * (x - rz * y + ry * z) AS x, -17.1032 + m * (rz * x + y - rx * z) AS y, -17.8444 + m * (z - ry * x + rx * y) AS z FROM old, turn)",
        f"flat AS (SELECT *, sqrt(x * x + y * y) AS r, 6378137 * sqrt(1 - {w2}) AS b FROM moved)",
        "reduced AS (SELECT *, atan2(z * 6378137, r * b) AS t FROM flat)",
    ) + f"""
      SELECT taz, 0 AS ring, "at", ROUND(degrees(atan2(y, x)), 7) AS lon,
        ROUND(degrees(atan2(z + {w2} / (1 - {w2}) * b * pow(sin(t), 3), r - {w2} * 6378137 * pow(cos(t), 3))), 7) AS lat FROM reduced"""
    # a zone that reaches half a cell further covers three by three half cells
    q["zones_union"] = base(
        "half AS (SELECT DISTINCT level, group_id, CAST(x0 / 0.03125 AS BIGINT) + i AS x, CAST(y0 / 0.03125 AS BIGINT) + j AS y "
        "FROM (SELECT x0, y0, UNNEST(['g33', 'city']) AS level, UNNEST([g33, city]) AS group_id FROM zones), range(3) a(i), range(3) b(j))",
        "side AS (SELECT level, group_id, x, y, 'v' AS kind FROM half UNION ALL SELECT level, group_id, x + 1, y, 'v' FROM half "
        "UNION ALL SELECT level, group_id, x, y, 'h' FROM half UNION ALL SELECT level, group_id, x, y + 1, 'h' FROM half)",
        "outer_side AS (SELECT level, group_id FROM side GROUP BY level, group_id, x, y, kind HAVING COUNT(*) = 1)",
    ) + """
      SELECT level, group_id, perimeter, area
      FROM (SELECT level, group_id, COUNT(*) * CAST(0.03125 AS DOUBLE) AS perimeter FROM outer_side GROUP BY ALL)
      JOIN (SELECT level, group_id, COUNT(*) * CAST(0.0009765625 AS DOUBLE) AS area FROM half GROUP BY ALL) USING (level, group_id)"""
    q["zones_shapefile"] = base() + "SELECT taz, g250, g33, g15, city, x0, y0, CAST(0.00390625 AS DOUBLE) AS area FROM zones"
    q["zone_names_workbook"] = base() + "SELECT taz, zone_name FROM zones"
    q["flows_bucketed"] = base() + flows("g33", "g33", f"{MORNING} AND {DIFFER}")
    q["flows_from_sums"] = base() + flows("g15", "g33", MORNING, anti=True)
    q["flows_from_sums_ids"] = base() + flows("g33", "g33", IN_O)
    q["flows_zone_selection"] = base() + flows("taz", "taz", "o.taz IN ('3', '77', '120') AND d.taz IN ('1', '5', '12', '40', '99') AND o.taz <> d.taz")

    q["dissolved_polygons"] = pieces() + " UNION ALL ".join(f"""
      SELECT '{level}' AS level, s.group_id, n_polygons, n_vertices, area
      FROM (SELECT {level} AS group_id, COUNT(*) * CAST(0.00390625 AS DOUBLE) AS area FROM zones GROUP BY ALL) s
      JOIN (SELECT group_id, COUNT(DISTINCT piece) AS n_polygons FROM piece WHERE level = '{level}' GROUP BY ALL) USING (group_id)
      JOIN (SELECT group_id, COUNT(*) AS n_vertices FROM (
        SELECT {level} AS group_id, x1, y1, x2, y2 FROM sides GROUP BY ALL HAVING COUNT(*) = 1) GROUP BY ALL) USING (group_id)"""
      for level in ("g250", "g33", "g15", "city"))
    q["zones_geojson"] = pieces() + """
      SELECT ROW_NUMBER() OVER (ORDER BY id) - 1 AS idx, id, label, CASE WHEN n > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
             label AS feature_label, n AS n_polygons
      FROM (SELECT g33 AS id, MIN(name_33) AS label FROM zones GROUP BY g33)
      JOIN (SELECT group_id AS id, COUNT(DISTINCT piece) AS n FROM piece WHERE level = 'g33' GROUP BY ALL) USING (id)"""
    corner = ["[' || x0 || ',' || y0 || ']", "[' || x0 + 0.0625 || ',' || y0 || ']", "[' || x0 + 0.0625 || ',' || y0 + 0.0625 || ']",
              "[' || x0 || ',' || y0 + 0.0625 || ']", "[' || x0 || ',' || y0 || ']"]
    q["zones_geojson_base"] = base() + f"""
      SELECT ROW_NUMBER() OVER (ORDER BY taz) - 1 AS idx, taz AS id, zone_name AS label,
        '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[{",".join(corner)}]]}},"properties":{{"id":"' || taz
        || '","label":' || COALESCE('"' || zone_name || '"', 'null') || ',"centroid_lat":' || (y0 + 0.03125)
        || ',"centroid_lon":' || (x0 + 0.03125) || ',"idx":' || (ROW_NUMBER() OVER (ORDER BY taz) - 1) || '}}}}' AS feature
      FROM zones"""
    q["zones_collection"] = (
        """SELECT 0 AS at, '{"type":"FeatureCollection","features":[' AS value UNION ALL SELECT idx + 1, CASE WHEN idx > 0 THEN ',' ELSE '' END || feature FROM ("""
        + q["zones_geojson_base"] + ") UNION ALL SELECT COUNT(*) + 1, ']}' FROM (" + base() + "SELECT taz FROM zones)"
    )
    q["flow_geometry"] = base(MODE4, CENTERS33, GEOMETRY) + """
      SELECT tag, origin_id, dest_id, trips, ROUND(2 + POW(trips, 1.5) / POW(largest, 1.5) * 12, 6) AS width,
        ROUND(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing,
        ROUND(0.25 * x1 + 0.75 * x2, 6) AS arrow_lon, ROUND(0.25 * y1 + 0.75 * y2, 6) AS arrow_lat
      FROM (SELECT *, DEGREES(ATAN2(SIN(RADIANS(x2 - x1)) * COS(RADIANS(y2)), COS(RADIANS(y1)) * SIN(RADIANS(y2))
              - SIN(RADIANS(y1)) * COS(RADIANS(y2)) * COS(RADIANS(x2 - x1)))) AS b FROM geo)"""
    q["flow_geojson"] = base(MODE4, CENTERS33, GEOMETRY) + """
      SELECT tag, origin_id, dest_id, 'LineString' AS kind, ROUND(x1, 6) AS lon1, ROUND(y1, 6) AS lat1, ROUND(x2, 6) AS lon2,
             ROUND(y2, 6) AS lat2, trips, o_label AS orig_label, d_label AS dest_label FROM geo"""
    q["flow_display_round"] = m4_all + """SELECT tag, origin_id, dest_id, CAST(FLOOR(t + 0.5) AS BIGINT) AS plain,
      CAST(CASE WHEN t >= 10000 THEN FLOOR(t / 100 + 0.5) * 100 ELSE FLOOR(t / 10 + 0.5) * 10 END AS BIGINT) AS rounded
      FROM (SELECT *, trips * 13 AS t FROM m4)"""
    q["flow_captions"] = base(MODE4, NAMES33) + """
      SELECT tag, origin_id, dest_id, o.label || ' ← ' || d.label || ', ' || FORMAT('{:,}', CAST(FLOOR(trips + 0.5) AS BIGINT))
             || ' נסיעות' AS caption FROM m4 JOIN names o ON o.id = origin_id JOIN names d ON d.id = dest_id"""
    q["relevant_zones"] = base(CENTERS33, f"m3 AS ({mode4(WEEKDAY)})") + f"""
      SELECT id, label, ROUND(lon, 6) AS centroid_lon, ROUND(lat, 6) AS centroid_lat FROM centers
      WHERE id IN {PICKED} OR id IN (SELECT origin_id FROM m3 WHERE tag <> 'internal')
         OR id IN (SELECT dest_id FROM m3 WHERE tag <> 'internal')"""
    q["flows_labelled"] = base(f"f AS ({flows('taz', 'taz', 'o.taz <> d.taz')})") + """
      SELECT origin_id, COALESCE(o.zone_name, origin_id) AS origin_label, dest_id, COALESCE(d.zone_name, dest_id) AS dest_label, trips
      FROM f LEFT JOIN zones o ON o.taz = origin_id LEFT JOIN zones d ON d.taz = dest_id"""
    q["export_flows"] = base(MODE4, NAMES33) + f"""
      SELECT origin_id, o.label AS origin_name, dest_id, d.label AS dest_name, CAST(FLOOR(trips + 0.5) AS BIGINT) AS trips,
        CASE tag WHEN 'outgoing' THEN '{texts.TAG_LABELS["outgoing"]}' WHEN 'incoming' THEN '{texts.TAG_LABELS["incoming"]}'
          ELSE CASE WHEN origin_id = dest_id THEN '{texts.INTRA_ZONE}' ELSE '{texts.INTER_SELECTED}' END END AS type
      FROM m4 LEFT JOIN names o ON o.id = origin_id LEFT JOIN names d ON d.id = dest_id"""
    q["sink_flows"] = m4_all + "SELECT * FROM m4"
    q["sink_flow_export"] = q["export_flows"].replace("SELECT origin_id, o.label", "SELECT CAST(10 AS BIGINT) AS n_summary, origin_id, o.label")
    q["sink_breakdown"] = q["export_breakdown"]
    q["sink_features"] = base() + "SELECT feature FROM (" + q["zones_geojson_base"].removeprefix(base()) + ")"
    q["filter_line"] = m4_all + """SELECT COUNT(*) AS n_flows, 'יום חול · ‪7–10‬' AS line, 'כל הימים · סה"כ יומי' AS every FROM m4"""
    q["flow_arrows"] = base(MODE4, CENTERS33, GEOMETRY) + """
      SELECT tag, origin_id, dest_id, 'Point' AS kind, ROUND(0.25 * x1 + 0.75 * x2, 6) AS lon, ROUND(0.25 * y1 + 0.75 * y2, 6) AS lat,
        ROUND(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing
      FROM (SELECT *, DEGREES(ATAN2(SIN(RADIANS(x2 - x1)) * COS(RADIANS(y2)), COS(RADIANS(y1)) * SIN(RADIANS(y2))
              - SIN(RADIANS(y1)) * COS(RADIANS(y2)) * COS(RADIANS(x2 - x1)))) AS b FROM geo)"""
    q["zone_label_points"] = "SELECT id, 'Point' AS kind, label, centroid_lon AS lon, centroid_lat AS lat FROM (" + q["relevant_zones"] + ")"
    loops = {"outgoing": f"{IN_O} AND {OUT_D}", "incoming": f"{OUT_O} AND {IN_D}", "internal": f"{IN_O} AND {IN_D}"}
    whole = {"outgoing": IN_O, "incoming": IN_D}
    for name, tabs in {
        "internal": {"origin": ("origin_id", loops["internal"]), "dest": ("dest_id", loops["internal"])},
        "external": {"outgoing": ("dest_id", loops["outgoing"]), "incoming": ("origin_id", loops["incoming"])},
        "single": {"outgoing": ("dest_id", whole["outgoing"]), "incoming": ("origin_id", whole["incoming"])},
        "destination": {"incoming": ("origin_id", whole["incoming"])},
    }.items():
        rows = " UNION ALL ".join(
            f"SELECT '{tab}' AS tab, {end} AS id, SUM(trips) AS trips FROM ({flows('g33', 'g33', f'{MORNING} AND {where}')}) GROUP BY ALL"
            for tab, (end, where) in tabs.items()
        )
        q[f"breakdown_tabs_{name}"] = base(NAMES33, f"tab_rows AS ({rows})", SLICES) + "SELECT tab, id, label, trips, n_zones FROM slices"
    q["export_summary"] = summary(20)
    q["export_summary_all_days"] = summary(None, "TRUE", "כל הימים", "0–24")
    q["zone_name_list"] = name_list()
    q["zone_search"] = base() + """SELECT taz AS id, zone_name AS label FROM zones
      WHERE (LOWER(zone_name) LIKE '%00012%' OR LOWER(taz) LIKE '%00012%') AND taz <> '12' ORDER BY taz LIMIT 8"""
    q["zone_search_index"] = q["zone_search"]
    return q
