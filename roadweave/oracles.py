"""DuckDB SQL for the registered queries, written from their definitions. Column names and types match the queries'."""

from __future__ import annotations

from roadweave.functions.vocabulary import ACTOR_CLASSES, EDGE_FEATURES, PAIR_RADII, SIZE_PRIORS

ORACLE: dict[str, str] = {}

TRACKS = """tracks AS (
  SELECT user_id AS track_id, CAST(f AS INTEGER) AS frame_idx, x_m, y_m, CAST(user_id % 8 AS INTEGER) AS cls_idx FROM (
    SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS f, value AS x_m, CAST(event_id % 100 AS DOUBLE) AS y_m,
           row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) WHERE rn = 1)"""

KIN = TRACKS + """, step AS (
  SELECT *, CAST(frame_idx AS DOUBLE) AS t_sec, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy, CAST(frame_idx - lag(frame_idx) OVER w AS DOUBLE) AS dt
  FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
moved AS (SELECT *, sqrt(dx*dx + dy*dy) AS distance_m, sqrt(dx*dx + dy*dy) / nullif(dt, 0) AS speed_mps, atan2(dy, dx) AS heading_rad, dx / nullif(dt, 0) AS vx_mps, dy / nullif(dt, 0) AS vy_mps FROM step),
kin AS (SELECT *, (speed_mps - lag(speed_mps) OVER (PARTITION BY track_id ORDER BY frame_idx)) / nullif(dt, 0) AS accel_mps2 FROM moved)"""


def rounded(*names: str) -> str:
    """Rounded columns; adding 0.0 gives every zero one sign, as decimal rounding does."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


ORACLE["time_seconds"] = f"WITH {TRACKS} SELECT track_id, frame_idx, round(frame_idx / 30.0::DOUBLE, 6) AS t_sec FROM tracks"
ORACLE["kinematics"] = f"WITH {KIN} SELECT track_id, frame_idx, {rounded('t_sec', 'dx', 'dy', 'dt', 'distance_m', 'speed_mps', 'heading_rad', 'vx_mps', 'vy_mps', 'accel_mps2')} FROM kin"
for name, back, ahead in (("smooth_odd", 1, 1), ("smooth_even", 2, 1)):
    over = f"OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    ORACLE[name] = f"WITH {TRACKS} SELECT track_id, frame_idx, round(avg(x_m) {over}, 6) AS x_m, round(avg(y_m) {over}, 6) AS y_m FROM tracks"

NEAR = """near AS (
  SELECT a.frame_idx, CAST(a.track_id AS VARCHAR) AS track_id_a, CAST(b.track_id AS VARCHAR) AS track_id_b, sqrt((b.x_m-a.x_m)**2 + (b.y_m-a.y_m)**2) AS dist, {more}
  FROM {rel} a JOIN {rel} b ON a.frame_idx = b.frame_idx AND CAST(a.track_id AS VARCHAR) < CAST(b.track_id AS VARCHAR)
  WHERE sqrt((b.x_m-a.x_m)**2 + (b.y_m-a.y_m)**2) < 15)"""
ORACLE["nearby_pairs"] = ORACLE["nearby_pairs_bucketed"] = ORACLE["nearby_pairs_tree"] = f"WITH {TRACKS}, {NEAR.format(rel='tracks', more='1 AS one')} SELECT frame_idx, track_id_a, track_id_b, round(dist, 6) AS dist FROM near"

PAIRS = KIN + ", " + NEAR.format(rel="kin", more="abs(a.speed_mps - b.speed_mps) AS rel") + """, pairs AS (
  SELECT track_id_a, track_id_b, string_agg(CAST(frame_idx AS VARCHAR), ',' ORDER BY frame_idx) AS frames, count(*) AS n_frames, min(dist) AS min_distance,
         arg_min(frame_idx, (dist, frame_idx)) AS min_distance_frame, coalesce(avg(rel), 0) AS avg_relative_speed
  FROM near GROUP BY ALL HAVING count(*) >= 3)"""
_pair = "track_id_a, track_id_b, frames, n_frames, round(min_distance, 6) AS min_distance, min_distance_frame, round(avg_relative_speed, 6) AS avg_relative_speed"
ORACLE["conflict_pairs"] = f"WITH {PAIRS} SELECT {_pair} FROM pairs"
ORACLE["meaningful_conflicts"] = f"WITH {PAIRS} SELECT {_pair} FROM pairs WHERE min_distance <= 5 AND avg_relative_speed >= 1"

TTC = """rel AS (
  SELECT a.frame_idx, CAST(a.track_id AS VARCHAR) AS track_id_a, CAST(b.track_id AS VARCHAR) AS track_id_b, a.x_m AS x1, a.y_m AS y1, a.vx_mps AS vx1, a.vy_mps AS vy1,
         b.x_m-a.x_m AS rx, b.y_m-a.y_m AS ry, b.vx_mps-a.vx_mps AS rvx, b.vy_mps-a.vy_mps AS rvy
  FROM kin a JOIN kin b ON a.frame_idx = b.frame_idx AND CAST(a.track_id AS VARCHAR) < CAST(b.track_id AS VARCHAR)
  WHERE a.vx_mps IS NOT NULL AND b.vx_mps IS NOT NULL AND sqrt((b.x_m-a.x_m)**2 + (b.y_m-a.y_m)**2) < 15),
quad AS (SELECT *, rvx*rvx+rvy*rvy AS qa, 2*(rx*rvx+ry*rvy) AS qb, rx*rx+ry*ry-2.25 AS qc FROM rel),
disc AS (SELECT *, qb*qb-4*qa*qc AS d FROM quad),
roots AS (SELECT *, CASE WHEN qa >= 1e-12 AND d >= 0 THEN (-qb - sqrt(greatest(d, 0)))/(2*qa) END AS t1, CASE WHEN qa >= 1e-12 AND d >= 0 THEN (-qb + sqrt(greatest(d, 0)))/(2*qa) END AS t2 FROM disc),
first_root AS (SELECT *, least(CASE WHEN t1 > 0 THEN t1 END, CASE WHEN t2 > 0 THEN t2 END) AS t0 FROM roots),
ttc AS (SELECT *, CASE WHEN qa < 1e-12 THEN 'zero_relative_speed' WHEN -qb/2 <= 0 THEN 'diverging_or_parallel' WHEN d < 0 THEN 'no_collision' WHEN t0 IS NULL THEN 'collision_in_past_or_now' ELSE 'collision_predicted' END AS status FROM first_root)"""
ORACLE["ttc_constant_velocity"] = f"""WITH {KIN}, {TTC} SELECT frame_idx, track_id_a, track_id_b, CASE WHEN status = 'collision_predicted' THEN round(t0, 6) END AS ttc,
  CASE WHEN status = 'collision_predicted' THEN round(x1 + vx1*t0, 6) END AS collision_x, CASE WHEN status = 'collision_predicted' THEN round(y1 + vy1*t0, 6) END AS collision_y,
  status NOT IN ('zero_relative_speed', 'diverging_or_parallel') AS is_approaching, status,
  CASE WHEN status = 'no_collision' THEN round(sqrt((rx - qb/2/qa*rvx)**2 + (ry - qb/2/qa*rvy)**2), 6) END AS min_separation,
  status = 'collision_predicted' AND t0 <= 3 AS is_critical,
  CASE WHEN status <> 'collision_predicted' OR t0 >= 5 THEN 0.0 ELSE round(1 - t0/5, 6) END AS severity FROM ttc"""
ORACLE["conflict_risk"] = f"""WITH {PAIRS}, {TTC}, least_ttc AS (SELECT track_id_a, track_id_b, min(t0) FILTER (status = 'collision_predicted') AS t FROM ttc GROUP BY ALL)
SELECT track_id_a, track_id_b, n_frames, round(min_distance, 6) AS min_distance, min_distance_frame, round(avg_relative_speed, 6) AS avg_relative_speed, round(t, 6) AS min_ttc
FROM pairs LEFT JOIN least_ttc USING (track_id_a, track_id_b)"""

ORACLE["pet_pairs"] = f"""WITH {TRACKS}, t AS (SELECT CAST(track_id AS VARCHAR) AS track, frame_idx, x_m, y_m, CAST(frame_idx AS DOUBLE) AS t_sec FROM tracks),
ok AS (SELECT track, min(frame_idx) AS first, max(frame_idx) AS last FROM t GROUP BY track HAVING count(*) >= 2),
s AS (SELECT t.* FROM t JOIN ok USING (track)),
d AS (SELECT a.track AS ta, b.track AS tb, a.frame_idx AS fa, b.frame_idx AS fb, a.x_m AS ax, a.y_m AS ay, b.x_m AS bx, b.y_m AS b_y, sqrt((b.x_m-a.x_m)**2+(b.y_m-a.y_m)**2) AS dist
  FROM s a JOIN s b ON a.track < b.track AND abs(a.x_m-b.x_m) <= 2 AND abs(a.y_m-b.y_m) <= 2 WHERE sqrt((b.x_m-a.x_m)**2+(b.y_m-a.y_m)**2) <= 2),
c AS (SELECT ta, tb, min(dist) AS dist, arg_min({{'x': (ax+bx)/2, 'y': (ay+b_y)/2}}, (dist, fa, fb)) AS c FROM d GROUP BY ta, tb),
z AS (SELECT c.ta, c.tb, dist, c.c.x AS cx, c.c.y AS cy,
  min(s.frame_idx) FILTER (s.track = ta) AS na, max(s.frame_idx) FILTER (s.track = ta) AS xa, min(s.frame_idx) FILTER (s.track = tb) AS nb, max(s.frame_idx) FILTER (s.track = tb) AS xb
  FROM c JOIN s ON (s.track = c.ta OR s.track = c.tb) AND sqrt((s.x_m-c.c.x)**2+(s.y_m-c.c.y)**2) <= 2 GROUP BY ALL),
p AS (SELECT *, CASE WHEN xa <= nb THEN nb-xa WHEN xb <= na THEN na-xb ELSE 0 END AS pet, CASE WHEN xa <= nb THEN 'agent1_then_agent2' WHEN xb <= na THEN 'agent2_then_agent1' ELSE 'zone_overlap' END AS st,
  CASE WHEN xa <= nb THEN 'agent1' WHEN xb <= na THEN 'agent2' END AS ef FROM z WHERE na IS NOT NULL AND nb IS NOT NULL)
SELECT 'PET_' || ta || '_' || tb AS event_id, ta AS track_id_a, tb AS track_id_b, least(o1.first, o2.first) AS start_frame, greatest(o1.last, o2.last) AS end_frame, CAST(pet AS DOUBLE) AS min_value,
  CASE WHEN pet <= 5 THEN 'critical' ELSE 'non_critical' END AS severity, round(cx, 6) AS conflict_x, round(cy, 6) AS conflict_y, round(dist, 6) AS min_pair_distance_m, st AS pet_status, ef AS enters_first
FROM p JOIN ok o1 ON o1.track = ta JOIN ok o2 ON o2.track = tb"""

_classes = "[" + ", ".join(f"'{c}'" for c in ACTOR_CLASSES) + "]"


def size_case(c: str) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SIZE_PRIORS.items()) + " END"


ORACLE["safe_float_cast"] = """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 3) THEN -1.0::DOUBLE ELSE round(coalesce(value, -1), 3) END AS v FROM events"""
ORACLE["actor_class_norm"] = f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 1 THEN ' Car ' END AS a, CASE WHEN event_type = 'click' THEN 'BUS' WHEN event_type = 'view' THEN '  ' ELSE event_type END AS b FROM events),
n AS (SELECT event_id, lower(trim(coalesce(a, nullif(b, ''), 'other'))) AS c FROM r), k AS (SELECT event_id, CASE WHEN list_contains({_classes}, c) THEN c ELSE 'other' END AS actor_class FROM n)
SELECT event_id, actor_class, CAST(list_position({_classes}, actor_class) - 1 AS INTEGER) AS class_index, {size_case('actor_class')} AS size_prior,
  array_to_string(list_transform({_classes}, lambda x: CASE WHEN x = actor_class THEN '1' ELSE '0' END), '') AS one_hot FROM k"""
ORACLE["wrapped_angles"] = "SELECT event_id, round(atan2(sin(value / 3), cos(value / 3)), 6) AS angle FROM events"
ORACLE["invalid_detections"] = """WITH d AS (SELECT CASE WHEN l_quantity * 10 - l_linenumber * 40 < l_quantity THEN 'bbox x2 must be >= x1' WHEN l_tax < 1 THEN 'bbox y2 must be >= y1'
  WHEN l_discount * 12 < 0 OR l_discount * 12 > 1 THEN 'confidence must be in [0, 1]' WHEN l_linenumber - 2 < 0 THEN 'frame_idx must be >= 0' END AS reason FROM lineitem)
SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY reason"""
ORACLE["bbox_center"] = "SELECT l_returnflag, round(avg((l_quantity + l_extendedprice) / 2), 6) AS x, round(avg(l_discount), 6) AS y FROM lineitem GROUP BY l_returnflag"
_proj = "(1.2*x_m + 0.1*y_m + 3.0) / (0.0005*x_m + 0.0002*y_m + 1.0)", "(-0.05*x_m + 0.9*y_m + 1.0) / (0.0005*x_m + 0.0002*y_m + 1.0)"
ORACLE["project_homography"] = f"WITH {TRACKS} SELECT track_id, frame_idx, round({_proj[0]}, 6) AS x_m, round({_proj[1]}, 6) AS y_m FROM tracks"
ORACLE["world_roundtrip"] = f"WITH {TRACKS} SELECT track_id, frame_idx, round(x_m, 4) AS image_x, round(y_m, 4) AS image_y FROM tracks"

# Graphs

NODES = KIN + f""", nodes AS (
  SELECT frame_idx AS frame_id, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY track_id) - 1 AS INTEGER) AS node_id, track_id, {_classes}[cls_idx + 1] AS actor_class, cls_idx AS class_index,
         coalesce(x_m, 0) AS x, coalesce(y_m, 0) AS y, coalesce(vx_mps, 0) AS vx, coalesce(vy_mps, 0) AS vy, coalesce(heading_rad, 0) AS heading FROM kin),
full_nodes AS (SELECT *, sqrt(vx*vx + vy*vy) AS speed, {size_case('actor_class')} AS size_prior FROM nodes)"""
ORACLE["graph_nodes"] = f"""WITH {NODES} SELECT frame_id, node_id, track_id, actor_class, class_index, {rounded('x', 'y', 'vx', 'vy', 'speed')}, 0.0::DOUBLE AS accel_mag,
  round(sin(heading), 6) AS sin_heading, round(cos(heading), 6) AS cos_heading, size_prior FROM full_nodes"""

_radius = "CASE " + " ".join(f"WHEN (a.actor_class = '{p}' AND b.actor_class = '{q}') OR (a.actor_class = '{q}' AND b.actor_class = '{p}') THEN {r}" for (p, q), r in PAIR_RADII.items()) + " ELSE 6.0 END"


def edges_cte(radius: str = _radius, max_ttc: float = 10.0) -> str:
    return f""", pair AS (
  SELECT a.frame_id, a.node_id AS i, b.node_id AS j, b.x-a.x AS dx, b.y-a.y AS dy, sqrt((b.x-a.x)**2+(b.y-a.y)**2) AS distance, b.vx-a.vx AS dvx, b.vy-a.vy AS dvy,
         b.heading-a.heading AS turn, CASE WHEN a.actor_class = b.actor_class THEN 1.0 ELSE 0.0 END::DOUBLE AS same_class, a.size_prior AS size_src, b.size_prior AS size_dst
  FROM full_nodes a JOIN full_nodes b ON a.frame_id = b.frame_id AND a.node_id < b.node_id
  WHERE sqrt((b.x-a.x)**2+(b.y-a.y)**2) > 1e-8 AND sqrt((b.x-a.x)**2+(b.y-a.y)**2) <= {radius}),
q AS (SELECT *, dvx*dvx+dvy*dvy AS qa, 2*(dx*dvx+dy*dvy) AS qb, dx*dx+dy*dy-2.25 AS qc FROM pair),
q2 AS (SELECT *, CASE WHEN qa >= 1e-8 AND qb*qb-4*qa*qc >= 0 THEN (-qb-sqrt(greatest(qb*qb-4*qa*qc, 0)))/(2*qa) END AS t1, CASE WHEN qa >= 1e-8 AND qb*qb-4*qa*qc >= 0 THEN (-qb+sqrt(greatest(qb*qb-4*qa*qc, 0)))/(2*qa) END AS t2 FROM q),
fwd AS (SELECT frame_id, i AS src, j AS dst, 0 AS direction, dx, dy, distance, dvx, dvy, sqrt(dvx*dvx+dvy*dvy) AS relative_speed, -(dvx*dx+dvy*dy)/distance AS closing_speed, dy/distance AS bearing_sin, dx/distance AS bearing_cos,
  sin(atan2(sin(turn), cos(turn))) AS rel_heading_sin, cos(atan2(sin(turn), cos(turn))) AS rel_heading_cos,
  coalesce(least(CASE WHEN t1 BETWEEN 0 AND {max_ttc} THEN t1 END, CASE WHEN t2 BETWEEN 0 AND {max_ttc} THEN t2 END), {max_ttc})::DOUBLE AS ttc, same_class, size_src, size_dst FROM q2),
edges AS (SELECT * FROM fwd UNION ALL SELECT frame_id, dst, src, 1, -dx, -dy, distance, -dvx, -dvy, relative_speed, closing_speed, -bearing_sin, -bearing_cos, -rel_heading_sin, rel_heading_cos, ttc, same_class, size_dst, size_src FROM fwd)"""


GRAPH = NODES + edges_cte()
ORACLE["graph_edges"] = f"WITH {GRAPH} SELECT frame_id, src, dst, {rounded(*EDGE_FEATURES)} FROM edges"
ORACLE["graph_edges_filtered"] = f"WITH {NODES}{edges_cte('8.0', 4.0)} SELECT frame_id, src, dst, {rounded(*EDGE_FEATURES)} FROM fwd WHERE closing_speed >= 0.5"
ORACLE["graph_adaptive_radius"] = f"WITH {NODES}{edges_cte(f'({_radius}) + 0.05 * greatest(a.speed, b.speed)')} SELECT frame_id, src, dst, round(distance, 6) AS distance FROM edges"
ORACLE["graph_edges_undirected"] = f"WITH {GRAPH} SELECT frame_id, src + 1 AS src, dst + 1 AS dst, src AS src_node, dst AS dst_node, round(distance, 6) AS distance FROM fwd"
ORACLE["deceleration_to_avoid_crash"] = f"WITH {GRAPH} SELECT frame_id, src, dst, CASE WHEN closing_speed <= 0 THEN 0.0 ELSE round(closing_speed**2 / (2*distance), 6) END AS drac FROM fwd"
_valid = f"""WITH {GRAPH} SELECT frame_id, true AS has_nodes, EXISTS (SELECT 1 FROM edges e WHERE e.frame_id = n.frame_id) AS has_edges, true AS finite_node_features, true AS finite_edge_features, true AS no_self_loops, true AS valid_edge_indices
FROM (SELECT DISTINCT frame_id FROM nodes) n"""
ORACLE["graph_validate"] = ORACLE["regraphed"] = _valid
ORACLE["plain_exports"] = f"""WITH {GRAPH}, e AS (SELECT frame_id, arg_min(src, (src, dst)) AS src, arg_min(dst, (src, dst)) AS dst FROM fwd GROUP BY frame_id),
n AS (SELECT frame_id, CAST(count(*) AS INTEGER) AS num_nodes, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY node_id) AS track_ids FROM nodes GROUP BY frame_id)
SELECT frame_id, num_nodes, track_ids, 12 AS width, src, dst, CAST(CASE WHEN src IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_edges FROM n LEFT JOIN e USING (frame_id)"""
ORACLE["graph_tensors"] = f"""WITH {GRAPH}, e AS (SELECT frame_id, CAST(count(*) AS INTEGER) AS m, CAST(sum(src * 3 + dst) AS INTEGER) AS mark FROM fwd GROUP BY frame_id),
n AS (SELECT frame_id, CAST(count(*) AS INTEGER) AS n FROM nodes GROUP BY frame_id) SELECT frame_id, n, coalesce(m, 0) AS m, coalesce(mark, 0) AS mark FROM n LEFT JOIN e USING (frame_id)"""
ORACLE["node_slices"] = f"WITH {NODES} SELECT frame_id, node_id, 11 AS base, 8 AS kin, round(speed, 6) AS speed, size_prior, actor_class AS name FROM full_nodes"
ORACLE["edge_slices"] = f"WITH {GRAPH} SELECT frame_id, src, dst, round(distance, 6) AS r0, round(relative_speed, 6) AS r1, round(closing_speed, 6) + 0.0 AS r2, round(ttc, 6) AS r3, same_class AS r4, size_src AS r5, size_dst AS r6 FROM edges"

_kept = "kept AS (SELECT * FROM full_nodes WHERE class_index IN (0, 4, 5))"
_sub = """ren AS (SELECT frame_id, node_id, row_number() OVER (PARTITION BY frame_id ORDER BY node_id) - 1 AS n FROM {rel}),
es AS (SELECT e.frame_id, a.n AS src FROM edges e JOIN ren a ON a.frame_id = e.frame_id AND a.node_id = e.src JOIN ren b ON b.frame_id = e.frame_id AND b.node_id = e.dst)
SELECT r.frame_id, r.nodes, CAST(r.last AS INTEGER) AS last, coalesce(x.edges, 0) AS edges, coalesce(x.src_sum, 0) AS src_sum FROM (SELECT frame_id, count(*) AS nodes, max(n) AS last FROM ren GROUP BY frame_id) r
LEFT JOIN (SELECT frame_id, count(*) AS edges, CAST(sum(src) AS BIGINT) AS src_sum FROM es GROUP BY frame_id) x USING (frame_id)"""
ORACLE["subgraph_by_class"] = f"WITH {GRAPH}, {_kept}, {_sub.format(rel='kept')}"
_ends = """ends AS (SELECT k.* FROM kept k WHERE EXISTS (SELECT 1 FROM edges e JOIN kept o ON o.frame_id = e.frame_id AND o.node_id = e.dst WHERE e.frame_id = k.frame_id AND e.src = k.node_id))"""
ORACLE["subgraph_no_isolated"] = f"WITH {GRAPH}, {_kept}, {_ends}, {_sub.format(rel='ends')}"
ORACLE["feature_stats"] = """SELECT CAST(i - 1 AS INTEGER) AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (
  SELECT unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY i"""
ORACLE["z_scores"] = """SELECT vec_id, round((embedding[1]::DOUBLE - 0.1) / 0.5, 6) AS z0, round(embedding[2]::DOUBLE + 0.2, 6) AS z1, round(embedding[3]::DOUBLE / 0.25, 6) AS z2 FROM embeddings"""

_h = [1.2, 0.1, 3.0, -0.05, 0.9, 1.0, 0.0005, 0.0002, 1.0]
ORACLE["homography_fit"] = f"WITH {TRACKS} SELECT DISTINCT cls_idx AS camera, {', '.join(f'{v}::DOUBLE AS h{i}' for i, v in enumerate(_h))}, 0.0::DOUBLE AS rms_error FROM tracks".replace("0.0005::DOUBLE", "round(0.0005::DOUBLE, 5)")
ORACLE["interaction_graphs"] = f"""WITH {GRAPH}, e AS (SELECT frame_id, CAST(count(*) AS INTEGER) AS m, string_agg((src + 1) || '-' || (dst + 1) || '-' || src || '-' || dst, ',' ORDER BY src, dst) AS edges FROM fwd GROUP BY frame_id),
n AS (SELECT frame_id, CAST(count(*) AS INTEGER) AS num_nodes, string_agg(node_id || ':' || track_id || ':' || actor_class, ',' ORDER BY node_id) AS nodes,
  round(sum(x + y + vx + vy + speed + sin(heading) + cos(heading) + size_prior + 1), 3) AS feature_sum FROM full_nodes GROUP BY frame_id)
SELECT frame_id, true AS directed, 6.0::DOUBLE AS radius, num_nodes, coalesce(m, 0) AS num_edges, nodes, coalesce(edges, '') AS edges, feature_sum FROM n LEFT JOIN e USING (frame_id)"""
ORACLE["trimmed_edges"] = f"""WITH {GRAPH}, e AS (SELECT frame_id, arg_min(src, (src, dst)) + 1 AS src, arg_min(dst, (src, dst)) + 1 AS dst FROM fwd GROUP BY frame_id)
SELECT n.frame_id, CAST(CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS INTEGER) AS num_edges, CAST(e.src AS INTEGER) AS src, CAST(e.dst AS INTEGER) AS dst FROM (SELECT DISTINCT frame_id FROM nodes) n LEFT JOIN e USING (frame_id)"""
ORACLE["graph_samples_roundtrip"] = f"""WITH {GRAPH}, e AS (SELECT frame_id, CAST(count(*) AS INTEGER) AS m FROM fwd GROUP BY frame_id)
SELECT 's' || frame_id AS sample_id, 'site' || (frame_id % 3) AS site_id, CAST(frame_id % 2 AS INTEGER) AS label, CAST(frame_id AS BIGINT) AS frame_id, n, coalesce(m, 0) AS m, track_ids, CAST(frame_id % 2 AS DOUBLE) AS y
FROM (SELECT frame_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY node_id) AS track_ids FROM nodes GROUP BY frame_id) LEFT JOIN e USING (frame_id)"""
ORACLE["sample_lines_missing_keys"] = """SELECT missing, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'sample_id' END, CASE WHEN event_id % 2 = 0 THEN 'label' END) AS missing FROM events) WHERE missing <> '' GROUP BY missing"""
ORACLE["graph_folder_by_number"] = f"""WITH {TRACKS}, f AS (SELECT frame_idx, count(*) AS n FROM tracks GROUP BY frame_idx), o AS (SELECT *, row_number() OVER (ORDER BY 'frame_id=' || frame_idx || '/') AS k FROM f)
SELECT frame_idx AS frame_id, n, 'sample_unknown_f' || lpad(CAST(frame_idx AS VARCHAR), 6, '0') AS sample_name FROM o WHERE k = 3"""
ORACLE["row_numbers"] = "SELECT o_custkey, n, row_number() OVER (ORDER BY o_custkey) - 1 AS ordinal FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"
ORACLE["toy_measures"] = f"""WITH {TRACKS}, t AS (SELECT track_id, count(*) AS n, row_number() OVER (ORDER BY track_id) AS k FROM tracks GROUP BY track_id)
SELECT format('ssm_{{:03d}}', k) AS event_id, track_id, 'car' AS class_name, 'ttc' AS measure, greatest(0, 5 - 0.5 * n)::DOUBLE AS value, 'toy_computed' AS status FROM t WHERE n >= 2"""
ORACLE["window_manifest"] = f"""WITH {TRACKS}, f AS (SELECT frame_idx AS frame_id, row_number() OVER (ORDER BY frame_idx) - 1 AS p FROM (SELECT DISTINCT frame_idx FROM tracks))
SELECT 'window_' || lpad(CAST(p // 4 + 1 AS VARCHAR), 3, '0') AS window_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS members, CAST(count(*) AS INTEGER) AS num_graphs FROM f GROUP BY p // 4"""
ORACLE["detections_from_tracks"] = """SELECT CAST(l_linenumber AS INTEGER) AS frame_idx, 'car' AS class_name, count(*) AS n, round(sum(CASE WHEN l_linenumber > 2 THEN round(l_discount, 6) ELSE 1.0 END), 4) AS confidence, round(sum(round(l_quantity + 4, 6)), 2) AS x2,
  count(DISTINCT l_partkey) AS actors FROM lineitem GROUP BY l_linenumber"""
ORACLE["best_epochs"] = """WITH e AS (SELECT CAST(p_partkey % 7 AS INTEGER) AS epoch, round(avg(p_size / 50), 3) AS f1 FROM part GROUP BY 1) SELECT arg_max(epoch, (f1, -epoch)) AS best_epoch, max(f1) AS best_f1 FROM e"""
ORACLE["group_split"] = """WITH g AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders)
SELECT n, CAST(ceil(k * 0.2::DOUBLE) AS BIGINT) AS val_groups, CAST(k - ceil(k * 0.2::DOUBLE) AS BIGINT) AS train_groups, 1::BIGINT AS most_sides FROM g"""

# Windows

VIDEOS = TRACKS + """, frames AS (SELECT DISTINCT 'v' || CAST(track_id % 4 AS VARCHAR) AS video_id, frame_idx AS frame_id FROM tracks),
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM frames)"""


def windows(size: int, stride: int) -> str:
    return f""", own AS (SELECT video_id, max(n) AS n, (max(n) - {size}) // {stride} + 1 AS k FROM placed GROUP BY video_id HAVING max(n) >= {size}),
based AS (SELECT *, coalesce(sum(k) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM own),
wins AS (SELECT video_id, base, unnest(range(0, k)) AS w FROM based),
members AS (SELECT w.video_id, CAST(w.base + w.w AS BIGINT) AS window_index, CAST(p.p - w.w * {stride} AS INTEGER) AS position, p.frame_id FROM wins w JOIN placed p ON p.video_id = w.video_id AND p.p BETWEEN w.w * {stride} AND w.w * {stride} + {size} - 1)"""


ORACLE["sliding_windows"] = f"WITH {VIDEOS}{windows(8, 3)} SELECT video_id, window_index, position, frame_id FROM members"
ORACLE["tumbling_windows"] = f"""WITH {VIDEOS} SELECT video_id, 'window_' || lpad(CAST(p // 4 + 1 AS VARCHAR), 3, '0') AS window_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS members, CAST(count(*) AS INTEGER) AS num_graphs
FROM placed GROUP BY video_id, p // 4"""
_video_nodes = ", vn AS (SELECT 'v' || CAST(track_id % 4 AS VARCHAR) AS video_id, frame_idx AS frame_id, track_id, row_number() OVER (PARTITION BY track_id % 4, frame_idx ORDER BY track_id) - 1 AS node_id FROM tracks)"
_window_nodes = """, wn AS (SELECT m.video_id, m.window_index, m.position, m.frame_id, v.track_id, v.node_id, CAST(row_number() OVER (PARTITION BY m.video_id, m.window_index ORDER BY m.position, v.node_id) - 1 AS INTEGER) AS id
  FROM members m JOIN vn v ON v.video_id = m.video_id AND v.frame_id = m.frame_id)"""
_temporal = """SELECT a.video_id, a.window_index, a.id AS src, b.id AS dst, 1 AS edge_type FROM wn a JOIN wn b ON a.video_id = b.video_id AND a.window_index = b.window_index AND a.track_id = b.track_id AND b.position = a.position + 1
UNION ALL SELECT a.video_id, a.window_index, b.id AS src, a.id AS dst, 1 AS edge_type FROM wn a JOIN wn b ON a.video_id = b.video_id AND a.window_index = b.window_index AND a.track_id = b.track_id AND b.position = a.position + 1"""
ORACLE["temporal_edges"] = f"WITH {VIDEOS}{windows(3, 2)}{_video_nodes}{_window_nodes} {_temporal}"
_video_edges = f""", full_vn AS (SELECT v.*, k.x_m AS x, k.y_m AS y, {_classes}[k.cls_idx + 1] AS actor_class FROM vn v JOIN tracks k ON k.track_id = v.track_id AND k.frame_idx = v.frame_id),
ve AS (SELECT a.video_id, a.frame_id, a.node_id AS i, b.node_id AS j FROM full_vn a JOIN full_vn b ON a.video_id = b.video_id AND a.frame_id = b.frame_id AND a.node_id < b.node_id
  WHERE sqrt((b.x-a.x)**2+(b.y-a.y)**2) > 1e-8 AND sqrt((b.x-a.x)**2+(b.y-a.y)**2) <= {_radius}),
both_ways AS (SELECT video_id, frame_id, i, j FROM ve UNION ALL SELECT video_id, frame_id, j, i FROM ve)"""
ORACLE["window_graph_edges"] = f"""WITH {VIDEOS}{windows(4, 2)}{_video_nodes}{_window_nodes}{_video_edges}, every AS (
  SELECT a.video_id, a.window_index, a.id AS src, b.id AS dst, 0 AS edge_type FROM both_ways e JOIN wn a ON a.video_id = e.video_id AND a.frame_id = e.frame_id AND a.node_id = e.i
  JOIN wn b ON b.video_id = e.video_id AND b.frame_id = e.frame_id AND b.node_id = e.j AND b.window_index = a.window_index UNION ALL {_temporal})
SELECT video_id, window_index, edge_type, count(*) AS n, CAST(sum(src) AS BIGINT) AS src_sum, CAST(sum(dst) AS BIGINT) AS dst_sum FROM every GROUP BY ALL"""
ORACLE["window_last_label"] = f"WITH {VIDEOS}{windows(4, 2)} SELECT video_id, window_index, arg_max(frame_id, position) FILTER (frame_id % 3 = 0) AS y FROM members GROUP BY video_id, window_index"

# Graph vectors, metrics and models


def _stats(rel: str, name: str, l2: bool) -> str:
    out = f"avg(v) AS {name}_mean, stddev_pop(v) AS {name}_std, min(v) AS {name}_min, max(v) AS {name}_max, avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END) AS {name}_nonzero"
    flat = f"(SELECT graph_id, CAST(unnest(features) AS DOUBLE) AS v FROM {rel})"
    rows = f"(SELECT graph_id, sqrt(list_sum(list_transform(features, lambda x: x * x))) AS l FROM {rel})"
    sums = f"SELECT graph_id, {out} FROM {flat} GROUP BY graph_id"
    if not l2:
        return sums
    return f"SELECT * FROM ({sums}) JOIN (SELECT graph_id, avg(l) AS {name}_l2_mean, stddev_pop(l) AS {name}_l2_std, min(l) AS {name}_l2_min, max(l) AS {name}_l2_max FROM {rows} GROUP BY graph_id) USING (graph_id)"


_s4 = lambda n: ", ".join(f"round({n}_{s}, 6) AS {n}_{s}" for s in ("mean", "std", "min", "max"))
_zero = lambda *names: ", ".join(f"0.0::DOUBLE AS {n}" for n in names)
ORACLE["graph_feature_vector"] = f"""WITH n AS (SELECT label AS graph_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features, vec_id % 5 AS track_id FROM embeddings),
e AS (SELECT graph_id, features[1:15] AS features FROM n), p AS (SELECT graph_id, features[1:2] AS features FROM n),
xs AS ({_stats('n', 'x', True)}), es AS ({_stats('e', 'e', True)}), ps AS ({_stats('p', 'pos', False)}),
c AS (SELECT graph_id, count(*)::DOUBLE AS num_nodes, avg(track_id) AS track_id_mean, count(DISTINCT track_id)::DOUBLE AS track_id_unique, (graph_id % 2)::DOUBLE AS y FROM n GROUP BY graph_id),
m AS (SELECT graph_id, count(*)::DOUBLE AS num_edges FROM e GROUP BY graph_id)
SELECT graph_id, num_nodes, num_edges, round(num_edges / (num_nodes * (num_nodes - 1)), 6) AS density, 64.0::DOUBLE AS node_dim, 15.0::DOUBLE AS edge_dim, 2.0::DOUBLE AS pos_dim,
  {_s4('x')}, {_s4('x_l2')}, round(x_nonzero, 6) AS x_nonzero, {_s4('e')}, {_s4('e_l2')}, round(e_nonzero, 6) AS e_nonzero, {_s4('pos')},
  y AS y_mean, 0.0::DOUBLE AS y_std, y AS y_min, y AS y_max, {_zero('frame_id_mean', 'frame_id_unique', 'video_id_mean', 'video_id_unique')}, round(track_id_mean, 6) AS track_id_mean, track_id_unique,
  {_zero('node_frame_index_mean', 'node_frame_index_unique', 'actor_class_index_mean', 'actor_class_index_unique')}
FROM c JOIN m USING (graph_id) JOIN xs USING (graph_id) JOIN es USING (graph_id) JOIN ps USING (graph_id)"""

SCORED = "s AS (SELECT l.doc_id, l.quality AS y_true, (d.n_chars % 97) / 20.0::DOUBLE - 2.0 AS logit, l.toxic AS label, 1 / (1 + exp(-((d.n_chars % 97) / 20.0::DOUBLE - 2.0))) AS prob FROM labels l JOIN documents d USING (doc_id))"
_conf = "count(*) FILTER ({y} = 1 AND {p} = 1) AS tp, count(*) FILTER ({y} = 0 AND {p} = 0) AS tn, count(*) FILTER ({y} = 0 AND {p} = 1) AS fp, count(*) FILTER ({y} = 1 AND {p} = 0) AS fn"
ORACLE["binary_metrics"] = f"""WITH {SCORED}, c AS (SELECT count(*) AS n, {_conf.format(y='y_true', p='(prob >= 0.5)::INT')} FROM s),
m AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS p, tp / greatest(tp + fn, 1)::DOUBLE AS r FROM c)
SELECT round((tp + tn) / greatest(n, 1)::DOUBLE, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, tp, tn, fp, fn FROM m"""
ORACLE["roc_auc"] = f"""WITH {SCORED}, r AS (SELECT y_true, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS k FROM s), c AS (SELECT sum(k) FILTER (y_true = 1) AS k, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM r)
SELECT round(((k - p * (p + 1) / 2.0) / (p * n))::DOUBLE, 6) AS roc_auc FROM c"""
ORACLE["average_precision"] = f"""WITH {SCORED}, g AS (SELECT logit, count(*) FILTER (y_true = 1) AS p, count(*) AS m FROM s GROUP BY logit), c AS (SELECT p, sum(p) OVER (ORDER BY logit DESC) AS tp, sum(m) OVER (ORDER BY logit DESC) AS k FROM g)
SELECT round((sum(p * tp / k::DOUBLE) / sum(p))::DOUBLE, 6) AS average_precision FROM c"""
ORACLE["calibration_error"] = f"""WITH {SCORED}, b AS (SELECT least(floor(prob * 10), 9) AS b, count(*) AS n, avg(y_true) AS y, avg(prob) AS p FROM s GROUP BY 1) SELECT round((sum(n * abs(y - p)) / sum(n))::DOUBLE, 6) AS calibration_error FROM b"""
ORACLE["bce_loss"] = f"WITH {SCORED} SELECT round(avg(greatest(logit, 0) - logit * y_true + ln(1 + exp(-abs(logit)))), 6) AS loss FROM s"
ORACLE["predictions"] = f"WITH {SCORED} SELECT doc_id, round(logit, 6) AS logit, round(prob, 6) AS prob, (prob >= 0.5)::INT AS pred_label FROM s"
ORACLE["val_summary"] = f"""WITH {SCORED}, c AS (SELECT count(*) AS val_sample_count, count(*) FILTER (label = 1) AS val_positive_count, count(*) FILTER (label = 0) AS val_negative_count, count(*) FILTER (prob >= 0.5) AS val_pred_positive_count,
  count(*) FILTER (prob < 0.5) AS val_pred_negative_count, {_conf.format(y='label', p='(prob >= 0.5)::INT')} FROM s)
SELECT *, array_to_string(list_filter([CASE WHEN val_sample_count < 10 THEN 'validation split has fewer than 10 samples; metrics may be unstable' END,
  CASE WHEN val_positive_count = 0 OR val_negative_count = 0 THEN 'validation split is single-class; binary metrics are not reliable' END,
  CASE WHEN val_pred_positive_count = 0 AND val_sample_count > 0 THEN 'model predicted zero positive samples at threshold 0.5' END], lambda x: x IS NOT NULL), '|') AS warnings FROM c"""
ORACLE["majority_class"] = "SELECT (SELECT quality FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)::BIGINT AS prediction, count(*) AS n FROM labels"
ORACLE["label_summary"] = """SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives, string_agg(DISTINCT 'site' || CAST(doc_id % 3 AS VARCHAR), ',' ORDER BY 'site' || CAST(doc_id % 3 AS VARCHAR)) AS sites FROM labels"""
for how, f in (("mean", "avg"), ("max", "max"), ("add", "sum")):
    ORACLE[f"pool_{how}"] = f"WITH {NODES} SELECT frame_id, round({f}(x / 100), 6) AS p0, round({f}(y / 100), 6) AS p1, round({f}(size_prior), 6) AS p2 FROM full_nodes GROUP BY frame_id"
_GCN = f"""WITH {GRAPH}, deg AS (SELECT frame_id, dst, count(*) AS c FROM edges GROUP BY ALL),
h0 AS (SELECT n.frame_id, n.node_id, x / 100 AS a, y / 100 AS b, size_prior AS c, coalesce(d.c, 0) + 1.0::DOUBLE AS d FROM full_nodes n LEFT JOIN deg d ON d.frame_id = n.frame_id AND d.dst = n.node_id),
loops AS (SELECT frame_id, src, dst FROM edges UNION ALL SELECT frame_id, node_id, node_id FROM h0),
s0 AS (SELECT l.frame_id, l.dst AS node_id, sum(h.a / sqrt(h.d * t.d)) AS a, sum(h.b / sqrt(h.d * t.d)) AS b, sum(h.c / sqrt(h.d * t.d)) AS c, any_value(t.d) AS d FROM loops l JOIN h0 h ON h.frame_id = l.frame_id AND h.node_id = l.src JOIN h0 t ON t.frame_id = l.frame_id AND t.node_id = l.dst GROUP BY l.frame_id, l.dst),
h1 AS (SELECT frame_id, node_id, d, greatest(0.1 * a + 0.05 * b + 0.2 * c + 0.01, 0) AS a, greatest(-0.2 * a + 0.3 * b + 0.1 * c - 0.02, 0) AS b FROM s0),
s1 AS (SELECT l.frame_id, l.dst AS node_id, sum(h.a / sqrt(h.d * t.d)) AS a, sum(h.b / sqrt(h.d * t.d)) AS b FROM loops l JOIN h1 h ON h.frame_id = l.frame_id AND h.node_id = l.src JOIN h1 t ON t.frame_id = l.frame_id AND t.node_id = l.dst GROUP BY l.frame_id, l.dst),
h2 AS (SELECT frame_id, greatest(0.3 * a - 0.1 * b, 0) AS a, greatest(0.2 * a + 0.4 * b + 0.05, 0) AS b FROM s1)"""
ORACLE["gcn_forward"] = _GCN + " SELECT frame_id, round(0.7 * avg(a) - 0.5 * avg(b) + 0.1, 6) AS logit FROM h2 GROUP BY frame_id"

_SUMMED = {
    **{("W0", i, j): f"(SELECT sum(s.{c} * z.{d}) FROM s0 s JOIN z1 z USING (frame_id, node_id))" for i, c in enumerate("abc") for j, d in enumerate("ab")},
    **{("b0", j, 0): f"(SELECT sum({d}) FROM z1)" for j, d in enumerate("ab")},
    **{("W1", i, j): f"(SELECT sum(s.{c} * z.{d}) FROM s1 s JOIN z2 z USING (frame_id, node_id))" for i, c in enumerate("ab") for j, d in enumerate("ab")},
    **{("b1", j, 0): f"(SELECT sum({d}) FROM z2)" for j, d in enumerate("ab")},
    **{("W2", i, 0): f"(SELECT sum(g * {d}) FROM slope)" for i, d in enumerate("ab")},
    ("b2", 0, 0): "(SELECT sum(g) FROM slope)",
}
_rows = " UNION ALL ".join(f"SELECT '{n}' AS weight, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round({v}, 6) + 0.0 AS gradient" for (n, i, j), v in _SUMMED.items())
ORACLE["gcn_gradients"] = _GCN.replace("h2 AS (SELECT frame_id,", "h2 AS (SELECT frame_id, node_id,") + f""",
slope AS (SELECT *, 1 / (1 + exp(-(0.7 * a - 0.5 * b + 0.1))) - n % 2 AS g FROM (SELECT frame_id, avg(a) AS a, avg(b) AS b, count(*) AS n FROM h2 GROUP BY frame_id)),
z2 AS (SELECT frame_id, node_id, CASE WHEN h.a > 0 THEN 0.7 * g / n ELSE 0 END AS a, CASE WHEN h.b > 0 THEN -0.5 * g / n ELSE 0 END AS b FROM h2 h JOIN slope USING (frame_id)),
t1 AS (SELECT l.frame_id, l.src AS node_id, sum(z.a / sqrt(s.d * t.d)) AS a, sum(z.b / sqrt(s.d * t.d)) AS b FROM loops l JOIN z2 z ON z.frame_id = l.frame_id AND z.node_id = l.dst
  JOIN h1 s ON s.frame_id = l.frame_id AND s.node_id = l.src JOIN h1 t ON t.frame_id = l.frame_id AND t.node_id = l.dst GROUP BY l.frame_id, l.src),
z1 AS (SELECT frame_id, node_id, CASE WHEN h.a > 0 THEN 0.3 * t.a + 0.2 * t.b ELSE 0 END AS a, CASE WHEN h.b > 0 THEN -0.1 * t.a + 0.4 * t.b ELSE 0 END AS b FROM t1 t JOIN h1 h USING (frame_id, node_id))
{_rows}"""

_NET = """WITH v AS (SELECT vec_id, label % 2 AS y, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
h1 AS (SELECT *, greatest(0.4 * a + 0.2 * b - 0.6 * c + 0.05, 0) AS d, greatest(-0.3 * a + 0.5 * b + 0.1 * c - 0.1, 0) AS e FROM v),
h2 AS (SELECT *, greatest(0.7 * d + 0.3 * e + 0.1, 0) AS f, greatest(-0.2 * d + 0.9 * e + 0.02, 0) AS g FROM h1),
p AS (SELECT *, 1 / (1 + exp(-(1.1 * f - 0.8 * g + 0.15))) AS p FROM h2)"""
ORACLE["mlp_forward"] = _NET + " SELECT vec_id, round(p, 6) AS p1 FROM p"
_slopes = {
    "rows": "1", "loss": "-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)",
    **{f"W0_{i}_{j}": f"{x} * {z}" for i, x in enumerate("abc") for j, z in enumerate(("dd", "de"))}, **{f"b0_{j}": z for j, z in enumerate(("dd", "de"))},
    **{f"W1_{i}_{j}": f"{x} * {z}" for i, x in enumerate("de") for j, z in enumerate(("df", "dg"))}, **{f"b1_{j}": z for j, z in enumerate(("df", "dg"))},
    "W2_0_0": "f * z", "W2_1_0": "g * z", "b2_0": "z",
}
ORACLE["mlp_gradients"] = _NET + """, z AS (SELECT *, p - y AS z FROM p),
top AS (SELECT *, CASE WHEN f > 0 THEN 1.1 * z ELSE 0 END AS df, CASE WHEN g > 0 THEN -0.8 * z ELSE 0 END AS dg FROM z),
low AS (SELECT *, CASE WHEN d > 0 THEN 0.7 * df - 0.2 * dg ELSE 0 END AS dd, CASE WHEN e > 0 THEN 0.3 * df + 0.9 * dg ELSE 0 END AS de FROM top)
""" + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(round(sum({v}), 6) + 0.0 AS DOUBLE) AS total FROM low" for n, v in _slopes.items())

ORACLE["forest_first_split"] = """WITH e AS (SELECT label % 2 AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
cw AS (SELECT y, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM e GROUP BY y),
f AS (SELECT j, x[j + 1] AS v, CASE WHEN y = 0 THEN w ELSE 0 END AS w0, CASE WHEN y = 1 THEN w ELSE 0 END AS w1 FROM e JOIN cw USING (y), (SELECT unnest(range((SELECT max(len(x)) FROM e))) AS j)),
g AS (SELECT j, v, sum(w0) AS w0, sum(w1) AS w1 FROM f GROUP BY j, v),
c AS (SELECT j, v, lead(v) OVER o AS next, sum(w0) OVER o AS l0, sum(w1) OVER o AS l1, sum(w0) OVER (PARTITION BY j) AS t0, sum(w1) OVER (PARTITION BY j) AS t1 FROM g WINDOW o AS (PARTITION BY j ORDER BY v)),
s AS (SELECT *, (l0 * l0 + l1 * l1) / (l0 + l1) + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / (t0 - l0 + t1 - l1) AS gain FROM c WHERE next IS NOT NULL),
b AS (SELECT * FROM s ORDER BY gain DESC LIMIT 1)
SELECT 'left' AS side, CAST(j AS INTEGER) AS feature, round((v + next) / 2, 6) AS threshold, round(l0, 6) AS w0, round(l1, 6) AS w1 FROM b
UNION ALL SELECT 'right', CAST(j AS INTEGER), round((v + next) / 2, 6), round(t0 - l0, 6), round(t1 - l1, 6) FROM b"""

ORACLE["closest_approach"] = f"""WITH {TRACKS}, near AS (
  SELECT CAST(a.track_id AS VARCHAR) AS track_id_a, CAST(b.track_id AS VARCHAR) AS track_id_b, sqrt((b.x_m-a.x_m)**2 + (b.y_m-a.y_m)**2) AS dist, a.frame_idx AS frame_a, b.frame_idx AS frame_b, a.x_m AS x_a, b.x_m AS x_b
  FROM tracks a JOIN tracks b ON CAST(a.track_id AS VARCHAR) < CAST(b.track_id AS VARCHAR) AND abs(b.x_m - a.x_m) <= 2 AND abs(b.y_m - a.y_m) <= 2 WHERE (b.x_m-a.x_m)**2 + (b.y_m-a.y_m)**2 <= 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id_a, track_id_b ORDER BY dist, frame_a, frame_b) AS rn FROM near)
SELECT track_id_a, track_id_b, round(dist, 6) AS dist, frame_a, frame_b, round(x_a, 6) AS x_a, round(x_b, 6) AS x_b FROM ranked WHERE rn = 1"""

ORACLE["stream_pairs"] = """WITH p AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS frame_idx, CAST(event_id AS VARCHAR) AS id, value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events)
SELECT a.frame_idx, a.id AS track_id_a, b.id AS track_id_b, round(sqrt((b.x - a.x)**2 + (b.y - a.y)**2), 6) AS dist FROM p a JOIN p b ON a.frame_idx = b.frame_idx AND a.id < b.id WHERE sqrt((b.x - a.x)**2 + (b.y - a.y)**2) < 6"""
