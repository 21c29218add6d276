"""DuckDB SQL for the library's own queries, from the same definitions."""

from __future__ import annotations

_HAV = "2 * 6371008.8 * atan2(sqrt({a}), sqrt(abs(1 - {a})))"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    return "(" + _HAV.format(a=a) + ")"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = f"radians(({lon2}) - ({lon1}))"
    angle = f"degrees(atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))) + 360"
    return f"({angle} - 360 * floor(({angle}) / 360))"


NODES = """nodes AS (SELECT c_custkey AS node_id, (420000000 + (c_custkey * 7919 % 90000) * 1000)::BIGINT AS lat_e7, (-45000000 + (c_custkey * 104729 % 120000) * 1000)::BIGINT AS lon_e7 FROM customer)"""
EDGES = f"""{NODES}, raw_edges AS (SELECT o_orderkey AS edge_id, o_custkey AS src, (o_custkey * 31 + o_orderkey) % (SELECT count(*) FROM customer) AS dst, (1 + o_orderkey % 12)::INT AS road_class,
 (o_orderkey % 16)::INT AS flags, ((o_orderkey % 14) * 10)::INT AS max_speed_kph FROM orders),
edges AS (SELECT e.*, round({hav("a.lat_e7 / 1e7", "a.lon_e7 / 1e7", "b.lat_e7 / 1e7", "b.lon_e7 / 1e7")} * 100)::BIGINT AS length_cm FROM raw_edges e JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE src <> dst)"""
TRACK = """track AS (SELECT user_id AS trip, row_number() OVER w AS seq, (430000000 + sum((event_id * 7919 % 2001 - 1000) * 10) OVER w)::BIGINT AS lat_e7, (10000000 + sum((event_id * 104729 % 2001 - 1000) * 10) OVER w)::BIGINT AS lon_e7,
 (1 + event_id % 5)::INT AS dt_s, round(value * 100)::BIGINT % 4000 AS speed_cms, (event_id * 37 % 360)::INT AS heading_deg, event_id, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
ROUTES = f"""{TRACK}, routes AS (SELECT trip, (seq - 1)::INT AS point, lat_e7, lon_e7 FROM track)"""
PLACES = """places AS (SELECT p_partkey AS place_id, p_name AS name, (1 + p_partkey % 10)::INT AS kind, p_size AS rank, (420000000 + (p_partkey * 6007 % 90000) * 1000)::BIGINT AS lat_e7, (-45000000 + (p_partkey * 99991 % 120000) * 1000)::BIGINT AS lon_e7 FROM part)"""
POINTS = """points AS (SELECT s_suppkey AS point_id, (420000000 + (s_suppkey * 6151 % 90000) * 1000 + 137)::BIGINT AS lat_e7, (-45000000 + (s_suppkey * 98953 % 120000) * 1000 + 411)::BIGINT AS lon_e7 FROM supplier)"""
CELLS = """cells AS (SELECT DISTINCT ((o_orderkey * 7919 + o_orderkey % 13) % 600)::INT AS x, ((o_orderkey * 31 + o_orderkey % 7) % 600)::INT AS y FROM orders),
nine AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))"""
LINES = """lines AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, (l_orderkey % 3)::INT AS kind, (l_orderkey * 7919 % 100000) / 100000.0::DOUBLE AS x1, (l_orderkey * 104729 % 100000) / 100000.0::DOUBLE AS y1,
 (l_orderkey * 7919 % 100000) / 100000.0::DOUBLE + (l_partkey % 97 - 48) / 50000.0::DOUBLE AS x2, (l_orderkey * 104729 % 100000) / 100000.0::DOUBLE + (l_partkey % 89 - 44) / 50000.0::DOUBLE AS y2 FROM lineitem)"""
DIMENSION = """dimension AS (SELECT p.profile, c.road_class, c.default_kph, CASE p.profile WHEN 'TOURING' THEN c.touring WHEN 'TRAIL' THEN c.trail ELSE c.fastest END AS multiplier FROM (VALUES
 (0, 40, 1.0::DOUBLE, 1.25::DOUBLE, 1.30::DOUBLE), (1, 110, 1.0, 2.50, 5.00), (2, 90, 1.0, 1.80, 3.00), (3, 80, 1.0, 1.35, 2.00), (4, 80, 1.0, 1.10, 1.50), (5, 70, 1.0, 1.00, 1.20), (6, 60, 1.0, 1.00, 1.10),
 (7, 50, 1.0, 1.10, 1.30), (8, 30, 1.0, 1.30, 1.15), (9, 20, 1.0, 1.20, 1.20), (10, 25, 1.35, 1.40, 1.00), (11, 15, 1.50, 1.70, 1.05), (12, 40, 1.0, 1.25, 1.30)) c(road_class, default_kph, fastest, touring, trail),
 (VALUES ('FASTEST'), ('TOURING'), ('TRAIL')) p(profile))"""
COSTS = f"""{EDGES}, {DIMENSION}, timed AS (SELECT e.*, d.profile, d.multiplier, e.flags & 4 <> 0 AS unpaved, e.length_cm / 100 / (greatest(5, least(130, CASE WHEN max_speed_kph > 0 THEN max_speed_kph ELSE default_kph END)) / 3.6) AS seconds FROM edges e JOIN dimension d USING (road_class)),
costs AS (SELECT *, seconds * (multiplier * CASE WHEN profile = 'TOURING' AND unpaved THEN 1.10::DOUBLE WHEN profile = 'TRAIL' AND NOT unpaved AND road_class NOT IN (10, 11) THEN 1.20::DOUBLE WHEN profile = 'FASTEST' AND unpaved THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) AS cost FROM timed)"""
REGIONS = f"""{EDGES}, best AS (SELECT src AS node_id, coalesce(min(CASE WHEN road_class > 0 THEN road_class END), 12) AS best_class FROM edges GROUP BY src),
withclass AS (SELECT * FROM nodes JOIN best USING (node_id)),
penal AS (SELECT *, CASE WHEN best_class <= 3 THEN 0 WHEN best_class = 4 THEN 500 WHEN best_class = 5 THEN 1200 ELSE 3000 END AS pen FROM withclass),
gates AS (SELECT l.node_id AS left_node, r.node_id AS right_node, lat_e7, lon_e7, least(65535, l.pen + r.pen) AS penalty_m
 FROM (SELECT lat_e7, lon_e7, min(node_id) AS node_id, arg_min(pen, node_id) AS pen FROM penal WHERE node_id % 3 IN (0, 1) GROUP BY ALL) l JOIN (SELECT lat_e7, lon_e7, min(node_id) AS node_id, arg_min(pen, node_id) AS pen FROM penal WHERE node_id % 3 IN (1, 2) GROUP BY ALL) r USING (lat_e7, lon_e7))"""
STEPS = f"""stepped AS (SELECT *, coalesce({hav("lag(lat_e7) OVER w / 1e7", "lag(lon_e7) OVER w / 1e7", "lat_e7 / 1e7", "lon_e7 / 1e7")}, 0.0) AS step_m FROM track WINDOW w AS (PARTITION BY trip ORDER BY seq))"""
MERC_X = "((lon_e7 / 1e7 + 180) / 360 - floor((lon_e7 / 1e7 + 180) / 360))"
MERC_Y = "(0.5 - asinh(tan(radians(greatest(-85.05112878, least(85.05112878, lat_e7 / 1e7))))) / (2 * 3.141592653589793))"
INSTRUCTIONS = f"""{ROUTES}, bent AS (SELECT *, {bearing("lag(lat_e7) OVER w / 1e7", "lag(lon_e7) OVER w / 1e7", "lat_e7 / 1e7", "lon_e7 / 1e7")} AS into_, {bearing("lat_e7 / 1e7", "lon_e7 / 1e7", "lead(lat_e7) OVER w / 1e7", "lead(lon_e7) OVER w / 1e7")} AS out_,
 coalesce({hav("lag(lat_e7) OVER w / 1e7", "lag(lon_e7) OVER w / 1e7", "lat_e7 / 1e7", "lon_e7 / 1e7")}, 0.0) AS step, lag(point) OVER w IS NULL AS first_, lead(point) OVER w IS NULL AS last_ FROM routes WINDOW w AS (PARTITION BY trip ORDER BY point)),
turned AS (SELECT *, (out_ - into_) - 360 * floor((out_ - into_) / 360) AS t, sum(step) OVER (PARTITION BY trip ORDER BY point ROWS UNBOUNDED PRECEDING) AS at_m FROM bent),
signed AS (SELECT *, CASE WHEN t > 180 THEN t - 360 ELSE t END AS turn FROM turned),
kinds AS (SELECT *, CASE WHEN first_ THEN 'DEPART' WHEN last_ THEN 'ARRIVE' WHEN abs(turn) < 25 THEN NULL WHEN abs(turn) >= 165 THEN 'UTURN'
 ELSE CASE WHEN abs(turn) < 55 THEN 'SLIGHT_' WHEN abs(turn) < 120 THEN '' ELSE 'SHARP_' END || CASE WHEN turn < 0 THEN 'LEFT' ELSE 'RIGHT' END END AS kind FROM signed),
instructions AS (SELECT trip, point, kind, at_m, CASE WHEN kind IN ('DEPART', 'ARRIVE') THEN 0.0 ELSE turn END AS turn FROM kinds WHERE kind IS NOT NULL)"""
AHEAD = f"""{INSTRUCTIONS}, gaps AS (SELECT *, lead(at_m) OVER (PARTITION BY trip ORDER BY point) - at_m AS gap FROM instructions),
marks AS (SELECT *, at_m + CASE WHEN gap IS NULL THEN 0.0 WHEN gap <= 50 THEN 2.5 WHEN gap <= 100 THEN 3.5 ELSE 5.0 END AS until FROM gaps),
ahead AS (SELECT s.trip, s.point AS seq, s.at_m, m.point, m.kind, m.at_m - s.at_m AS ahead_m FROM turned s JOIN marks m ON m.trip = s.trip AND m.until >= s.at_m
 QUALIFY row_number() OVER (PARTITION BY s.trip, s.point ORDER BY m.until, m.point) = 1)"""


def normalized(name: str) -> str:
    return f"nullif(trim(regexp_replace(lower(translate(replace(replace({name}, 'œ', 'oe'), 'Œ', 'oe'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY')), '[^a-z0-9]+', ' ', 'g')), '')"


def _match(query: str) -> str:
    return f"CASE WHEN normalized = '{query}' THEN 0 WHEN starts_with(normalized, '{query}') THEN 1 WHEN contains(normalized, '{query}') THEN 2 END"


_PARTS = "(SELECT s.trip * 1000000 + s.point AS a, lead(s.trip * 1000000 + s.point) OVER w AS b, lat_e7 AS a_lat, lon_e7 AS a_lon, lead(lat_e7) OVER w AS b_lat, lead(lon_e7) OVER w AS b_lon FROM routes s WINDOW w AS (PARTITION BY trip ORDER BY point))"
_CHEAP = f"{COSTS}, arcs AS (SELECT src, dst, min(round(cost * 1000)::BIGINT) AS c FROM costs WHERE profile = 'TOURING' GROUP BY ALL)"

SQL: dict[str, str] = {
    "geo_haversine_edges": f"WITH {EDGES} SELECT road_class, count(*) AS n, sum(length_cm)::BIGINT AS length_cm, max(length_cm) AS longest_cm FROM edges GROUP BY 1",
    "mercator_tiles": f"WITH {NODES} SELECT node_id, floor({MERC_X} * 4096)::INT AS tile_x, floor({MERC_Y} * 4096)::INT AS tile_y, round({MERC_X}, 9) AS x, round({MERC_Y}, 9) AS y FROM nodes",
    "tile_counts_by_zoom": f"""WITH {NODES}, z AS (SELECT zoom, floor({MERC_X} * power(2.0, zoom))::INT AS tx, floor({MERC_Y} * power(2.0, zoom))::INT AS ty FROM nodes, (SELECT unnest([6, 8, 10, 12, 14]) AS zoom))
        SELECT zoom, count(DISTINCT (tx, ty)) AS tiles, count(*) AS points FROM z GROUP BY 1""",
    "grid_cells_csr": f"""WITH {NODES}, c AS (SELECT floor(lat_e7 / 2500000)::BIGINT AS cell_y, floor(lon_e7 / 2500000)::BIGINT AS cell_x, count(*) AS n FROM nodes GROUP BY 1, 2)
        SELECT *, coalesce(sum(n) OVER (ORDER BY cell_y, cell_x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c""",
    "segments_distinct": f"WITH {EDGES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges",
    "nearest_node": f"""WITH {NODES}, {POINTS}, d AS (SELECT point_id, node_id, {hav("p.lat_e7 / 1e7", "p.lon_e7 / 1e7", "n.lat_e7 / 1e7", "n.lon_e7 / 1e7")} AS m FROM points p, nodes n)
        SELECT point_id, arg_min(node_id, (m, node_id)) AS node_id, round(min(m), 3) AS distance_m FROM d GROUP BY 1""",
    "snap_segment": f"""WITH {ROUTES}, parts AS (SELECT * FROM {_PARTS} WHERE b IS NOT NULL),
        asked AS (SELECT trip * 1000000 + seq AS point_id, (lat_e7 + 1370) / 1e7 AS la, (lon_e7 - 2110) / 1e7 AS lo FROM track),
        near AS (SELECT point_id, la, lo, a, b, a_lat / 1e7 AS y1, a_lon / 1e7 AS x1, b_lat / 1e7 AS y2, b_lon / 1e7 AS x2, cos(radians(la)) AS k FROM asked JOIN parts
          ON la BETWEEN least(a_lat, b_lat) / 1e7 - 0.001 AND greatest(a_lat, b_lat) / 1e7 + 0.001 AND lo BETWEEN least(a_lon, b_lon) / 1e7 - 0.002 AND greatest(a_lon, b_lon) / 1e7 + 0.002),
        cut AS (SELECT *, CASE WHEN ((x2 - x1) * k) ** 2 + (y2 - y1) ** 2 <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((lo - x1) * k * ((x2 - x1) * k) + (la - y1) * (y2 - y1)) / (((x2 - x1) * k) * ((x2 - x1) * k) + (y2 - y1) * (y2 - y1)))) END AS f FROM near),
        far AS (SELECT *, {hav("la", "lo", "y1 + (y2 - y1) * f", "x1 + (x2 - x1) * f")} AS m FROM cut)
        SELECT point_id, arg_min(a, (m, a, b)) AS a, arg_min(b, (m, a, b)) AS b, round(min(m), 3) AS distance_m FROM far WHERE m <= 60 GROUP BY 1""",
    "gateways_exact_join": f"WITH {REGIONS} SELECT * FROM gates",
    "gateways_topk": f"""WITH {REGIONS} SELECT left_node, right_node, penalty_m, round({hav("43.5", "-1.25", "lat_e7 / 1e7", "lon_e7 / 1e7")} + {hav("lat_e7 / 1e7", "lon_e7 / 1e7", "48.25", "5.5")} + penalty_m, 3) AS score
        FROM gates ORDER BY score, left_node, right_node LIMIT 8""",
    "edge_costs_by_profile": f"WITH {COSTS} SELECT profile, road_class, count(*) AS n, sum(round(seconds * 1000)::BIGINT)::BIGINT AS ms, sum(round(cost * 1000)::BIGINT)::BIGINT AS cost_ms FROM costs WHERE flags & 1 = 0 GROUP BY 1, 2",
    "sssp_costs": f"""WITH RECURSIVE {_CHEAP}, walk(origin, node, cost) USING KEY (origin, node) AS (
        SELECT * FROM (VALUES (0, 1::BIGINT, 0::BIGINT), (1, 7, 0), (1, 11, 60000)) s(origin, node, cost)
        UNION (SELECT w.origin, a.dst, min(w.cost + a.c) FROM walk w JOIN arcs a ON a.src = w.node LEFT JOIN recurring.walk r ON r.origin = w.origin AND r.node = a.dst
          WHERE r.cost IS NULL OR w.cost + a.c < r.cost GROUP BY ALL)) SELECT origin, node, cost FROM walk""",
    "route_points": f"""WITH RECURSIVE {_CHEAP}, starts AS (SELECT * FROM (VALUES (0, 1::BIGINT, 0::BIGINT), (1, 7, 0), (1, 11, 60000)) s(origin, node, cost)),
        walk(origin, node, cost) USING KEY (origin, node) AS (SELECT * FROM starts
        UNION (SELECT w.origin, a.dst, min(w.cost + a.c) FROM walk w JOIN arcs a ON a.src = w.node LEFT JOIN recurring.walk r ON r.origin = w.origin AND r.node = a.dst
          WHERE r.cost IS NULL OR w.cost + a.c < r.cost GROUP BY ALL)),
        via AS (SELECT w.origin, w.node, min(a.src) AS via FROM walk w JOIN arcs a ON a.dst = w.node JOIN walk p ON p.origin = w.origin AND p.node = a.src AND p.cost + a.c = w.cost
          WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.origin = w.origin AND s.node = w.node AND s.cost = w.cost) GROUP BY ALL),
        path(origin, target, hop, node) AS (SELECT origin, node, 0, node FROM walk UNION ALL SELECT p.origin, p.target, p.hop + 1, v.via FROM path p JOIN via v ON v.origin = p.origin AND v.node = p.node)
        SELECT origin, target, hop, node FROM path""",
    "region_corridor": """WITH RECURSIVE pairs AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation),
        arcs AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), walk(node, cost) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT b::BIGINT, cost + 1 FROM walk JOIN arcs ON a = node WHERE cost < 25)
        SELECT node, min(cost) AS cost FROM walk GROUP BY 1""",
    "missing_regions": "SELECT n_nationkey AS region_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 <> 0)",
    "graph_validation": f"WITH {EDGES}, s AS (SELECT 'src' AS side, src AS node_id FROM edges UNION ALL SELECT 'dst', dst FROM edges) SELECT side, count(*) AS n FROM s WHERE node_id NOT IN (SELECT node_id FROM nodes WHERE node_id % 3 <> 2) GROUP BY 1",
    "place_search": f"""WITH {PLACES}, n AS (SELECT *, {normalized("name")} AS normalized FROM places), m AS (SELECT *, {_match("red")} AS match FROM n)
        SELECT place_id, name, match, rank FROM m WHERE match IS NOT NULL ORDER BY match, rank DESC, length(name), lower(name), place_id LIMIT 20""",
    "place_search_multi": f"""WITH {PLACES}, n AS (SELECT *, {normalized("name")} AS normalized FROM places), m AS (SELECT *, {_match("blue")} AS match FROM n),
        u AS (SELECT *, 0 AS source_no FROM m WHERE match IS NOT NULL AND place_id % 2 = 0 UNION ALL SELECT *, 1 FROM m WHERE match IS NOT NULL AND (place_id % 2 = 1 OR place_id % 3 = 0)),
        d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lat_e7, lon_e7, normalized ORDER BY source_no, place_id) = 1)
        SELECT place_id, name, match, rank, source_no FROM d ORDER BY match, rank DESC, length(normalized), name, place_id LIMIT 12""",
    "trip_cumulative": f"WITH {TRACK}, {STEPS} SELECT trip, seq::INT AS seq, round(step_m, 3) AS step_m, round(sum(step_m) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING), 2) AS total_m FROM stepped",
    "turn_instructions": f"WITH {INSTRUCTIONS} SELECT trip, point, kind, round(at_m, 2) AS at_m, round(turn, 4) AS turn FROM instructions",
    "instruction_asof": f"WITH {AHEAD} SELECT trip, seq, point, kind, round(ahead_m, 2) AS ahead_m FROM ahead",
    "announcements": f"""WITH {AHEAD}, v AS (SELECT trip, (seq - 1)::INT AS seq, greatest(0.0, least(60.0, speed_cms / 100)) AS v FROM track),
        j AS (SELECT * FROM ahead JOIN v USING (trip, seq)),
        s AS (SELECT trip, point, 'far' AS stage, seq FROM j WHERE ahead_m <= greatest(200.0, least(600.0, 20 * v)) UNION ALL SELECT trip, point, 'near', seq FROM j WHERE ahead_m <= greatest(60.0, least(180.0, 8 * v))
          UNION ALL SELECT trip, point, 'now', seq FROM j WHERE ahead_m <= greatest(20.0, least(45.0, 2 * v))) SELECT trip, point, stage, min(seq) AS seq FROM s GROUP BY ALL""",
    "track_islands_longest": f"""WITH {TRACK}, i AS (SELECT *, sum((seq = 1 OR event_id % 7 = 0)::INT) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM track),
        c AS (SELECT trip, island, count(*) AS points FROM i GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY trip ORDER BY points DESC, island) = 1""",
    "trip_stats": f"""WITH {TRACK}, {STEPS} SELECT trip, sum(dt_s)::BIGINT AS elapsed_s, sum(CASE WHEN speed_cms >= 100 THEN dt_s ELSE 0 END)::BIGINT AS moving_s,
        round(sum(CASE WHEN seq > 1 AND step_m <= greatest(35.0, 70.0 * greatest(dt_s, 0.2)) THEN step_m ELSE 0.0 END), 2) AS distance_m, max(speed_cms) AS top_speed_cms FROM stepped GROUP BY trip""",
    "off_route_hysteresis": f"""WITH {TRACK}, s AS (SELECT trip, seq, (event_id * 7919 % 90)::DOUBLE AS d FROM track), f AS (SELECT *, coalesce(last_value(CASE WHEN d > 45 THEN true WHEN d <= 25 THEN false END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS off FROM s)
        SELECT trip, count(*) FILTER (off) AS off, count(*) AS samples FROM f GROUP BY trip""",
    "location_filter": f"""WITH RECURSIVE {TRACK}, f(trip, seq, lat, lon) AS (SELECT trip, 1::BIGINT, lat_e7 / 1e7, lon_e7 / 1e7 FROM track WHERE seq = 1 UNION ALL
        SELECT t.trip, t.seq, CASE WHEN {hav("f.lat", "f.lon", "t.lat_e7 / 1e7", "t.lon_e7 / 1e7")} > 350 THEN t.lat_e7 / 1e7 ELSE f.lat + (t.lat_e7 / 1e7 - f.lat) * (1 - exp(-t.dt_s / 0.35)) END,
        CASE WHEN {hav("f.lat", "f.lon", "t.lat_e7 / 1e7", "t.lon_e7 / 1e7")} > 350 THEN t.lon_e7 / 1e7 ELSE f.lon + (t.lon_e7 / 1e7 - f.lon) * (1 - exp(-t.dt_s / 0.35)) END
        FROM f JOIN track t ON t.trip = f.trip AND t.seq = f.seq + 1) SELECT trip, seq::INT AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM f""",
    "gps_quality_counts": f"""WITH {TRACK}, s AS (SELECT trip, seq, CASE WHEN NOT heading_deg < 350 THEN 'OFF' WHEN dt_s * (1 + event_id % 2) > 5 THEN 'LOST' WHEN event_id * 31 % 80 <= 0 OR event_id * 31 % 80 > 50 THEN 'POOR' WHEN event_id * 31 % 80 > 20 THEN 'FAIR' ELSE 'GOOD' END AS state FROM track),
        c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY trip ORDER BY seq) <> state, true) AS changed FROM s) SELECT state, count(*) AS n, count(*) FILTER (changed) AS changes FROM c GROUP BY 1""",
    "mask_closing": f"WITH {CELLS}, wide AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM cells, nine) SELECT x + dx AS x, y + dy AS y FROM wide, nine GROUP BY 1, 2 HAVING count(*) = 9",
    "mask_pyramid_or": f"WITH {CELLS} SELECT DISTINCT x >> k AS x, y >> k AS y, k::INT AS level FROM cells, (SELECT unnest([1, 2, 3]) AS k)",
    "sparse_filter": f"WITH {CELLS}, c AS (SELECT x + dx AS x, y + dy AS y, count(*) AS n FROM cells, nine GROUP BY 1, 2 HAVING count(*) >= 3) SELECT x, y, n FROM c JOIN cells USING (x, y)",
    "mask_boundary": f"""WITH {CELLS}, f AS (SELECT x, y, side, x + dx AS nx, y + dy AS ny FROM cells, (VALUES ('N', 0, -1), ('E', 1, 0), ('S', 0, 1), ('W', -1, 0)) s(side, dx, dy))
        SELECT x, y, side FROM f WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.x = nx AND c.y = ny)""",
    "mask_runs": f"WITH {CELLS}, i AS (SELECT x, y, x - row_number() OVER (PARTITION BY y ORDER BY x) AS island FROM cells) SELECT y, min(x) AS x_from, max(x) AS x_to FROM i GROUP BY y, island",
    "line_clip_tiles": f"""WITH {LINES}, s AS (SELECT line_id, x1 * 1024 AS x1, y1 * 1024 AS y1, x2 * 1024 - x1 * 1024 AS dx, y2 * 1024 - y1 * 1024 AS dy, floor(least(x1, x2) * 1024)::INT AS lx, floor(greatest(x1, x2) * 1024)::INT AS hx, floor(least(y1, y2) * 1024)::INT AS ly, floor(greatest(y1, y2) * 1024)::INT AS hy FROM lines),
        c AS (SELECT * FROM s, LATERAL (SELECT unnest(range(lx, hx + 1))::INT AS tile_x), LATERAL (SELECT unnest(range(ly, hy + 1))::INT AS tile_y) WHERE hx - lx <= 8 AND hy - ly <= 8),
        t AS (SELECT line_id, tile_x, tile_y, greatest(0.0, CASE WHEN dx = 0 THEN 0.0 ELSE least((tile_x - x1) / dx, (tile_x + 1 - x1) / dx) END, CASE WHEN dy = 0 THEN 0.0 ELSE least((tile_y - y1) / dy, (tile_y + 1 - y1) / dy) END) AS t0,
          least(1.0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((tile_x - x1) / dx, (tile_x + 1 - x1) / dx) END, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((tile_y - y1) / dy, (tile_y + 1 - y1) / dy) END) AS t1
          FROM c WHERE (dx <> 0 OR x1 BETWEEN tile_x AND tile_x + 1) AND (dy <> 0 OR y1 BETWEEN tile_y AND tile_y + 1)) SELECT line_id, tile_x, tile_y, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM t WHERE t0 < t1""",
    "overview_generalize": f"""WITH {LINES}, q AS (SELECT kind, round(x1 * 4096)::INT AS a, round(y1 * 4096)::INT AS b, round(x2 * 4096)::INT AS c, round(y2 * 4096)::INT AS d FROM lines), k AS (SELECT *, a > c OR (a = c AND b > d) AS turn FROM q WHERE a <> c OR b <> d)
        SELECT DISTINCT kind, CASE WHEN turn THEN c ELSE a END AS x1, CASE WHEN turn THEN d ELSE b END AS y1, CASE WHEN turn THEN a ELSE c END AS x2, CASE WHEN turn THEN b ELSE d END AS y2 FROM k""",
    "robust_bounds": f"""WITH {NODES}, v AS (SELECT 'lat' AS axis, lat_e7 AS v FROM nodes UNION ALL SELECT 'lon', lon_e7 FROM nodes), b AS (SELECT axis, floor(v / 500000)::BIGINT AS bin, count(*) AS n FROM v GROUP BY 1, 2),
        s AS (SELECT *, sum(n) OVER (PARTITION BY axis ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY axis) AS total FROM b), k AS (SELECT axis, min(bin) AS lo, max(bin) AS hi FROM s WHERE upto > 0.01 * total AND upto - n < 0.99 * total GROUP BY 1)
        SELECT axis, greatest(min(v), any_value(lo) * 500000 - 1000000)::BIGINT AS low_e7, least(max(v), (any_value(hi) + 1) * 500000 + 1000000)::BIGINT AS high_e7 FROM v JOIN k USING (axis) GROUP BY axis""",
    "polygon_area": f"""WITH {ROUTES}, r AS (SELECT trip AS ring_id, point, (lon_e7 - 10000000) // 10 AS x, (lat_e7 - 430000000) // 10 AS y FROM routes), s AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM r WINDOW w AS (PARTITION BY ring_id ORDER BY point))
        SELECT ring_id, sum(x * ny - nx * y)::BIGINT AS area2, sum((nx - x) ** 2 + (ny - y) ** 2)::BIGINT AS perimeter2 FROM s GROUP BY 1""",
    "topk_history": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "settings_upsert": "SELECT event_type, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1",
    "labels_lod": f"WITH {PLACES}, l AS (SELECT place_id % 25 AS region, place_id, kind, row_number() OVER (PARTITION BY place_id % 25 ORDER BY kind, rank DESC, place_id)::INT AS nth FROM places WHERE kind BETWEEN 1 AND 3) SELECT * FROM l WHERE nth <= 3",
    "place_normalize": f"""WITH s AS (SELECT s_suppkey, ' Étang-du ' || s_name || ' Œuvre ' AS name, (s_suppkey * 37 % 20000)::DOUBLE AS m FROM supplier) SELECT s_suppkey, {normalized("name")} AS normalized,
        CASE WHEN m < 100 THEN (floor((m + 5) / 10) * 10)::BIGINT || ' m' WHEN m < 1000 THEN (floor((m + 25) / 50) * 50)::BIGINT || ' m' WHEN m < 10000 THEN printf('%.1f km', m / 1000) ELSE printf('%.0f km', m / 1000) END AS spoken FROM s""",
    "route_overlap": """WITH s AS (SELECT l_suppkey AS route, l_orderkey * 10 + l_linenumber AS seq, least(l_partkey % 40, l_orderkey % 40) AS a, greatest(l_partkey % 40, l_orderkey % 40) AS b, (l_quantity * 100)::BIGINT AS length_cm FROM lineitem),
        n AS (SELECT *, row_number() OVER (PARTITION BY route, a, b ORDER BY seq, length_cm) AS nth FROM s) SELECT route, sum(CASE WHEN nth > 1 THEN length_cm ELSE 0 END)::BIGINT AS repeated_cm FROM n GROUP BY 1""",
    "flagship": f"""WITH {TRACK}, {STEPS}, {NODES}, w AS (SELECT trip, count(*) AS samples, round(sum(step_m), 2) AS total_m FROM stepped GROUP BY 1),
        d AS (SELECT trip, node_id, {hav("t.lat_e7 / 1e7", "t.lon_e7 / 1e7", "n.lat_e7 / 1e7", "n.lon_e7 / 1e7")} AS m FROM track t, nodes n WHERE seq = 1), b AS (SELECT trip, arg_min(node_id, (m, node_id)) AS node_id, round(min(m), 3) AS start_m FROM d GROUP BY 1)
        SELECT trip, node_id, start_m, samples, total_m FROM w JOIN b USING (trip)""",
}
