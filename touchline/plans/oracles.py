"""SQL for the catalogue, written independently of the operators; views are put before a query as it needs them."""

from __future__ import annotations

import re

from touchline.functions.geometry import HOMOGRAPHY, PITCH_CORNERS
from touchline.sources.tables import ADAPTERS
from touchline.plans.payloads import PAYLOADS

_H = HOMOGRAPHY
_EDGES = list(zip(PITCH_CORNERS, PITCH_CORNERS[1:] + PITCH_CORNERS[:1], strict=True))
_INSIDE = " AND ".join(f"({bx - ax}) * (trunc(ay) - ({ay})) - ({by - ay}) * (trunc(ax) - ({ax})) >= 0" for (ax, ay), (bx, by) in _EDGES)


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _clip(x: str, high: int) -> str:
    return f"greatest(0, least({high}, {x}))"


def _lab(prefix: str, r: str, g: str, b: str) -> str:
    """Lab columns of three channel columns, as nested selects' building blocks."""
    lin = lambda v: f"CASE WHEN least(greatest({v},0),255)/255.0 <= 0.04045 THEN least(greatest({v},0),255)/255.0/12.92 ELSE power((least(greatest({v},0),255)/255.0+0.055)/1.055,2.4) END"
    return f"{lin(r)} AS {prefix}lr, {lin(g)} AS {prefix}lg, {lin(b)} AS {prefix}lb"


_F = lambda t: f"CASE WHEN {t} > 0.008856 THEN power({t}, CAST(1 AS DOUBLE)/3) ELSE 7.787*{t} + CAST(16 AS DOUBLE)/116 END"
_XYZ = "(CAST(0.412453 AS DOUBLE)*lr+0.357580*lg+0.180423*lb)/0.950456 AS x, CAST(0.212671 AS DOUBLE)*lr+0.715160*lg+0.072169*lb AS y, (CAST(0.019334 AS DOUBLE)*lr+0.119193*lg+0.950227*lb)/1.088754 AS z"
_TWO = lambda n: f"CASE WHEN length({n}) < 2 THEN '0' || {n} ELSE {n} END"
_CLOCK = lambda s: f"""{_TWO(f"CAST(CAST(floor({s}) AS BIGINT) // 60 AS VARCHAR)")} || ':' || {_TWO(f"CAST(CAST(floor({s}) AS BIGINT) % 60 AS VARCHAR)")}"""


def _payloads() -> str:
    """The payloads, made by shape, and their trees gone down by recursion: a level a step."""
    shapes = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PAYLOADS))
    texts, scores = (f"CASE WHEN json_array_length(x, '$.rec_{k}') > 0 THEN x->'$.rec_{k}' ELSE x->'$.{k}' END" for k in ("texts", "scores"))
    scored = lambda v: f"(json_type({v}) = 'ARRAY' AND json_array_length({v}) = 2 AND json_type({v}, '$[0]') = 'VARCHAR')"
    return f"""WITH made AS (SELECT match_id, frame_num, replace(replace(replace(CASE frame_num % {len(PAYLOADS)} {shapes} END, '{{t}}', CAST(to_json(text) AS VARCHAR)), '{{a}}', CAST(round(confidence, 2) AS VARCHAR)), '{{b}}', CAST(round(crop_quality, 2) AS VARCHAR)) AS p FROM ocr_candidates),
 level AS (SELECT match_id, frame_num, CAST([] AS BIGINT[]) AS trail, CAST(p AS JSON) AS v FROM made UNION ALL
 SELECT match_id, frame_num, list_append(trail, unnest(range(len(kids)))), unnest(kids) FROM (SELECT match_id, frame_num, trail, CASE
  WHEN json_type(x) = 'OBJECT' AND (texts IS NULL OR scores IS NULL) THEN map_values(CAST(x AS MAP(VARCHAR, JSON)))
  WHEN json_type(x) = 'ARRAY' AND NOT (paired OR boxed) THEN CAST(x AS JSON[]) ELSE CAST([] AS JSON[]) END AS kids
  FROM (SELECT *, {texts} AS texts, {scores} AS scores, {scored("x")} AND json_type(x, '$[1]') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS paired, coalesce({scored("x->'$[1]'")}, false) AS boxed
   FROM (SELECT *, CASE WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.res') THEN v->'$.res' ELSE v END AS x FROM level)))),
 found AS (SELECT match_id, frame_num, trail, CASE WHEN json_type(x) = 'OBJECT' THEN list_zip(CAST(texts AS JSON[]), CAST(scores AS JSON[]), true) WHEN paired THEN [(x->'$[0]', x->'$[1]')] WHEN boxed THEN [(x->'$[1][0]', x->'$[1][1]')] END AS pairs
  FROM (SELECT *, {texts} AS texts, {scores} AS scores, {scored("x")} AND json_type(x, '$[1]') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS paired, coalesce({scored("x->'$[1]'")}, false) AS boxed
   FROM (SELECT *, CASE WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.res') THEN v->'$.res' ELSE v END AS x FROM level))
  WHERE json_type(x) <> 'OBJECT' OR (json_type(texts) = 'ARRAY' AND json_type(scores) = 'ARRAY')),
 pair AS (SELECT match_id, frame_num, trail, unnest(range(len(pairs))) AS k, unnest(pairs) AS z FROM found WHERE pairs IS NOT NULL)
 SELECT match_id, frame_num, CAST(row_number() OVER (PARTITION BY match_id, frame_num ORDER BY trail, k) - 1 AS INT) AS item, z.t->>'$' AS text, greatest(0, least(1, z.s)) AS score
 FROM (SELECT match_id, frame_num, trail, k, struct_pack(t := z[1], s := TRY_CAST(z[2] AS DOUBLE)) AS z FROM pair) WHERE z.s IS NOT NULL"""


_PAYLOADS = _payloads()


def _two_means(steps: int = 10) -> str:
    """Centres by match after so many steps, a select for each."""
    gap = lambda c: " + ".join(f"({k} - {k}{c}) * ({k} - {k}{c})" for k in "bgr")
    mean = lambda k, c, own: f"coalesce(sum({k}) FILTER ({own}) / count(*) FILTER ({own}), any_value({k}{c})) AS {k}{c}"
    kept = "any_value(n_samples) AS n_samples, any_value(colours) AS colours"
    far = lambda o: "+".join(f"({k} - {o}{k}) * ({k} - {o}{k})" for k in "bgr")
    sql = "SELECT match_id, count(*) AS n_samples, count(DISTINCT (b, g, r)) AS colours, sum(b) / count(*) AS mb, sum(g) / count(*) AS mg, sum(r) / count(*) AS mr FROM kit_samples GROUP BY match_id"
    for o, names in (("m", ("sb", "sg", "sr")), ("s", ("b1", "g1", "r1"))):
        first = ", ".join(f"arg_min({k}, (-({far(o)}), b, g, r)) AS {n}" for k, n in zip("bgr", names, strict=True))
        sql = f"SELECT match_id, {kept}, {', '.join(f'any_value(s{k}) AS s{k}' for k in 'bgr' if o == 's')}{', ' if o == 's' else ''}{first} FROM kit_samples JOIN ({sql}) USING (match_id) GROUP BY match_id"
    sql = f"SELECT match_id, n_samples, colours, sb AS b0, sg AS g0, sr AS r0, b1, g1, r1 FROM ({sql})"
    for _ in range(steps):
        near = f"({gap(1)}) < ({gap(0)})"
        sql = f"SELECT match_id, {kept}, {', '.join(mean(k, c, own) for c, own in ((0, f'NOT ({near})'), (1, near)) for k in 'bgr')} FROM kit_samples JOIN ({sql}) USING (match_id) GROUP BY match_id"
    return sql


_HEX = lambda c: f"printf('%02X', CAST(trunc(least(255, greatest(0, {c}))) AS INT))"
_GAP = lambda c: " + ".join(f"({k} - {k}{c}) * ({k} - {k}{c})" for k in "bgr")


def _spaced(source: str, cooldown: int, by: str, name: str) -> str:
    """Greedy choice as a recursion: the least frame, then each time the least that is far enough on."""
    same = " AND ".join(f"e.{k} = t.{k}" for k in by.split(", "))
    keys = ", ".join(f"t.{k}" for k in by.split(", "))
    return f"""{name} AS (
 SELECT {by}, min(frame_num) AS frame_num FROM {source} GROUP BY {by}
 UNION ALL
 SELECT {keys}, (SELECT min(e.frame_num) FROM {source} e WHERE {same} AND e.frame_num >= t.frame_num + {cooldown}) AS frame_num
 FROM {name} t WHERE t.frame_num IS NOT NULL)"""


VIEWS = {k: f"{k} AS ({_plain(v)})" for k, v in ADAPTERS.items()}
for _k in ("detections", "team_frames", "feature_pairs"):
    VIEWS[_k] = re.sub(r"\((tracks|old_points|new_points)\) ", r"\1 ", VIEWS[_k])
VIEWS |= {
    "player_colors": "player_colors AS (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS match_id, vec_id % 22 + 1 AS track_id, vec_id % 100 AS frame_num, "
    + ", ".join(f"floor((CAST(embedding[{k}] AS DOUBLE) + 5e-1) * 255) AS {c}" for k, c in ((1, "b"), (2, "g"), (3, "r"))) + " FROM embeddings)",
    "nearest": """nearest AS (SELECT match_id, frame_num, track_id, distance FROM (
 SELECT *, row_number() OVER (PARTITION BY match_id, frame_num ORDER BY distance, track_id) AS k FROM (
  SELECT t.match_id, t.frame_num, t.track_id, least(sqrt((t.x1-bx)*(t.x1-bx)+(t.y2-by_)*(t.y2-by_)), sqrt((t.x2-bx)*(t.x2-bx)+(t.y2-by_)*(t.y2-by_))) AS distance
  FROM tracks t JOIN (SELECT match_id, frame_num, trunc((x1+x2)/2) AS bx, trunc((y1+y2)/2) AS by_ FROM ball) b USING (match_id, frame_num)) WHERE distance < 70) WHERE k = 1)""",
    "named_plays": "named_plays AS (SELECT match_id, team_slot, team_name FROM plays JOIN teams USING (team_id))",
    "team_state": """team_state AS (SELECT match_id, track_id, frame_num, CAST(coalesce(first_value(CASE WHEN team_id <> 0 THEN team_id END IGNORE NULLS) OVER w, 0) AS INT) AS slot FROM team_frames
 WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_num ROWS UNBOUNDED PRECEDING))""",
    "touches": """touches AS (SELECT n.match_id, n.frame_num, n.track_id, n.distance, CAST(coalesce(s.slot, 0) AS INT) AS team_id, coalesce(team_name, 'unknown_team') AS team_name
 FROM nearest n LEFT JOIN team_state s ON s.match_id = n.match_id AND s.track_id = n.track_id AND s.frame_num = n.frame_num
 LEFT JOIN named_plays p ON p.match_id = n.match_id AND p.team_slot = s.slot)""",
    "goal_state": """goal_state AS (SELECT g.match_id, g.goal_frame, arg_max(s.slot, s.frame_num) AS slot FROM scorers g
 JOIN team_state s ON s.match_id = g.match_id AND s.track_id = g.track_id AND s.frame_num <= g.goal_frame GROUP BY g.match_id, g.goal_frame)""",
    "present": """present AS (SELECT match_id, frame_num, coalesce(players, 0) AS players, coalesce(has_ball, false) AS has_ball
 FROM (SELECT match_id, frame_num, count(DISTINCT track_id) AS players FROM tracks GROUP BY ALL)
 FULL JOIN (SELECT DISTINCT match_id, frame_num, true AS has_ball FROM ball) USING (match_id, frame_num))""",
    "eligible": """eligible AS (SELECT d.match_id, d.frame_num, d.event, d.confidence FROM detected_events d LEFT JOIN present p USING (match_id, frame_num)
 WHERE event <> 'none' AND CASE event WHEN 'goal' THEN confidence >= 0.5 AND coalesce(has_ball, false)
  WHEN 'foul' THEN confidence >= 0.7 AND coalesce(players, 0) > 1 ELSE confidence >= 0.7 END)""",
    "taken": _spaced("eligible", 60, "match_id", "taken"),
    "confirmed": "confirmed AS (SELECT e.* FROM eligible e JOIN taken t USING (match_id, frame_num))",
    "goals": "goals AS (SELECT match_id, frame_num AS goal_frame FROM confirmed WHERE event = 'goal')",
    "scorers": """scorers AS (SELECT match_id, goal_frame, max(CASE WHEN k = 1 THEN track_id END) AS track_id, max(CASE WHEN k = 1 THEN frame_num END) AS last_touch_frame,
  round_even(avg(CASE WHEN track_id = top THEN 1.0 ELSE 0.0 END), 3) AS possession_confidence FROM (
 SELECT g.match_id, g.goal_frame, t.frame_num, t.track_id, row_number() OVER w AS k, first_value(t.track_id) OVER w AS top
 FROM goals g JOIN touches t ON t.match_id = g.match_id AND t.frame_num BETWEEN g.goal_frame - 180 AND g.goal_frame
 WINDOW w AS (PARTITION BY g.match_id, g.goal_frame ORDER BY t.frame_num DESC)) WHERE k <= 12 GROUP BY match_id, goal_frame)""",
    "kits": "kits AS (SELECT match_id, track_id, frame_num, CAST(CASE WHEN least(d1,d2) <= 62 AND abs(d1-d2) >= 10 THEN CASE WHEN d1 <= d2 THEN 1 ELSE 2 END ELSE 0 END AS INT) AS team_id,"
    " round_even(0.7*greatest(0, 1 - least(d1,d2)/62) + 0.3*least(1, abs(d1-d2)/20), 3) AS confidence, round(least(d1,d2), 4) AS distance, round(abs(d1-d2), 4) AS separation"
    " FROM (SELECT c.*, sqrt((c.l-p.l)*(c.l-p.l)+(c.a-p.a)*(c.a-p.a)+(c.lab_b-p.lab_b)*(c.lab_b-p.lab_b)) AS d1, sqrt((c.l-q.l)*(c.l-q.l)+(c.a-q.a)*(c.a-q.a)+(c.lab_b-q.lab_b)*(c.lab_b-q.lab_b)) AS d2"
    " FROM labs c, kit_labs p, kit_labs q WHERE p.track_id = 1 AND q.track_id = 2))",
    "crops_scored": """crops_scored AS (SELECT *, quality + 0.25 * rear_facing_score AS score FROM (SELECT *,
 round_even(greatest(0, least(1, 0.45*least(1, h*w/12000) + 0.35*least(1, sharpness/180) + 0.20*rear_facing_score)), 3) AS quality FROM crops))""",
    "goal_readings": """goal_readings AS (SELECT g.match_id, g.goal_frame, o.frame_num, o.text, o.confidence, g.quality AS crop_quality FROM goal_crops g
 JOIN ocr_candidates o ON o.match_id = g.match_id AND o.track_id = g.track_id AND o.frame_num = g.crop_frame)""",
    "moves": """moves AS (SELECT match_id, frame_num, CASE WHEN far > 5 THEN dx ELSE 0 END AS dx, CASE WHEN far > 5 THEN dy ELSE 0 END AS dy FROM (
 SELECT *, row_number() OVER (PARTITION BY match_id, frame_num ORDER BY far DESC, feature_idx) AS k FROM (
  SELECT match_id, frame_num, feature_idx, old_x-new_x AS dx, old_y-new_y AS dy, sqrt((old_x-new_x)*(old_x-new_x)+(old_y-new_y)*(old_y-new_y)) AS far FROM feature_pairs)) WHERE k = 1)""",
    "adjusted": """adjusted AS (SELECT match_id, track_id, frame_num, px, py, px - coalesce(dx, 0) AS ax, py - coalesce(dy, 0) AS ay FROM (
 SELECT match_id, track_id, frame_num, CAST(trunc((x1+x2)/2) AS INT) AS px, CAST(trunc(y2) AS INT) AS py FROM tracks) t
 LEFT JOIN moves m USING (match_id, frame_num))""",
    "on_pitch": f"on_pitch AS (SELECT *, {_INSIDE} AS inside FROM adjusted)",
    "projected": f"""projected AS (SELECT match_id, track_id, frame_num,
 CASE WHEN inside THEN (CAST({_H[0]!r} AS DOUBLE)*ax + CAST({_H[1]!r} AS DOUBLE)*ay + CAST({_H[2]!r} AS DOUBLE)) / (CAST({_H[6]!r} AS DOUBLE)*ax + CAST({_H[7]!r} AS DOUBLE)*ay + 1) END AS x,
 CASE WHEN inside THEN (CAST({_H[3]!r} AS DOUBLE)*ax + CAST({_H[4]!r} AS DOUBLE)*ay + CAST({_H[5]!r} AS DOUBLE)) / (CAST({_H[6]!r} AS DOUBLE)*ax + CAST({_H[7]!r} AS DOUBLE)*ay + 1) END AS y FROM on_pitch)""",
    "speeds": """speeds AS (SELECT p.match_id, p.track_id, p.frame_num, s.speed, s.distance, p.x, p.y FROM projected p JOIN (
 SELECT a.match_id, a.track_id, a.frame_num // 5 AS w, e_frame, far / ((e_frame - a.frame_num) / 24) * 3.6 AS speed,
  sum(far) OVER (PARTITION BY a.match_id, a.track_id ORDER BY a.frame_num ROWS UNBOUNDED PRECEDING) AS distance FROM (
  SELECT a.match_id, a.track_id, a.frame_num, e.frame_num AS e_frame, sqrt((a.x-e.x)*(a.x-e.x)+(a.y-e.y)*(a.y-e.y)) AS far
  FROM projected a JOIN (SELECT match_id, max(frame_num) AS n FROM frames GROUP BY match_id) f USING (match_id)
  JOIN projected e ON e.match_id = a.match_id AND e.track_id = a.track_id AND e.frame_num = least(a.frame_num + 5, n)
  WHERE a.frame_num % 5 = 0 AND e.frame_num > a.frame_num AND a.x IS NOT NULL AND e.x IS NOT NULL) a) s
 ON s.match_id = p.match_id AND s.track_id = p.track_id AND p.frame_num // 5 = s.w AND p.frame_num < s.e_frame)""",
    "peaks": """peaks AS (SELECT match_id, frame_num, event, confidence FROM (
 SELECT *, max(confidence) OVER (PARTITION BY match_id, event ORDER BY frame_num ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS top FROM detected_events WHERE (frame_num + 1) % 2 = 0)
 WHERE confidence = top AND confidence > CASE event WHEN 'goal' THEN 0.25 WHEN 'card' THEN 0.30 WHEN 'foul' THEN 0.55 END)""",
    "peak_taken": _spaced("peaks", 20, "match_id, event", "peak_taken"),
    "matches": """matches AS (SELECT match_id, match_date, user_id, CASE WHEN open > 0 THEN 'completed' ELSE 'failed' END AS status FROM (
 SELECT CAST(floor(o_orderkey/1000) AS BIGINT) AS match_id, max(o_orderdate) AS match_date, min(o_custkey) % 5 AS user_id, count(*) FILTER (o_orderstatus = 'P') AS open FROM orders GROUP BY 1))""",
}
for _name, _source in (("labs", "player_colors"), ("kit_labs", "(SELECT 0 AS match_id, * FROM (VALUES (1, 0, 70.0::DOUBLE, 70.0::DOUBLE, 180.0::DOUBLE), (2, 0, 180.0, 70.0, 70.0)) v(track_id, frame_num, b, g, r))")):
    VIEWS[_name] = (
        f"{_name} AS (SELECT match_id, track_id, frame_num, CASE WHEN y > 0.008856 THEN 116*power(y, CAST(1 AS DOUBLE)/3) - 16 ELSE 903.3*y END AS l, "
        f"500*({_F('x')} - {_F('y')}) AS a, 200*({_F('y')} - {_F('z')}) AS lab_b FROM (SELECT match_id, track_id, frame_num, {_XYZ} FROM "
        f"(SELECT match_id, track_id, frame_num, {_lab('', 'r', 'g', 'b')} FROM {_source})))"
    )
_VALUES = {
    "number": """SELECT *, unnest(list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) <= 2), lambda x: CAST(x AS INT))) AS value FROM {source}""",
    "name": """SELECT * FROM (SELECT *, trim(regexp_replace(regexp_replace(upper(text), '[^A-Z ''\\-]', ' ', 'g'), ' +', ' ', 'g')) AS value FROM {source})
 WHERE regexp_full_match(value, '[A-Z][A-Z ''\\-]{{2,23}}') AND len(list_filter(string_split(value, ' '), lambda w: w NOT IN ('GOAL','TEAM','PLAYER','SCORE','SPORT','LIVE','MATCH','HOME','AWAY'))) > 0""",
}
for _kind, _name, _source, _by in [(k, k, "ocr_candidates", "match_id, track_id") for k in _VALUES] + [(k, f"goal_{k}", "goal_readings", "match_id, goal_frame") for k in _VALUES]:
    VIEWS[f"{_name}_values"] = f"{_name}_values AS ({_VALUES[_kind].format(source=_source)})"
    VIEWS[f"{_name}_consensus"] = f"""{_name}_consensus AS (SELECT {_by}, CASE WHEN sure THEN value END AS value, CASE WHEN sure THEN round_even(average, 3) ELSE average END AS confidence, support FROM (
 SELECT *, support >= 2 AND average >= 0.58 AND NOT coalesce(weight < 1.15 * next_weight, false) AS sure FROM (
  SELECT *, row_number() OVER w AS k, lead(weight) OVER w AS next_weight FROM (
   SELECT {_by}, value, round(sum(confidence*crop_quality), 9) AS weight, count(DISTINCT frame_num) AS support,
    round(sum(confidence*crop_quality) / greatest(sum(crop_quality), 1e-9), 9) AS average, min(frame_num) AS first_read
   FROM {_name}_values WHERE confidence >= 0.5 GROUP BY {_by}, value)
  WINDOW w AS (PARTITION BY {_by} ORDER BY weight DESC, support DESC, average DESC, first_read, value)) WHERE k = 1))"""
_GOAL = """CASE WHEN jersey_number IS NULL THEN 'GOAL — ' || team_name || ' — scorer number unavailable'
 WHEN length(trim(player_name)) > 0 THEN 'GOAL — ' || team_name || ' — #' || jersey_number || ' ' || player_name || ' scored'
 ELSE 'GOAL — ' || team_name || ' — #' || jersey_number || ' scored' END"""
VIEWS["named_scorers"] = f"""named_scorers AS (SELECT *, {_GOAL} AS g FROM (
 SELECT g.match_id, g.goal_frame, s.track_id, s.last_touch_frame, coalesce(p.team_name, 'unknown_team') AS team_name, n.value AS jersey_number, n.confidence AS jersey_confidence,
  m.value AS player_name, m.confidence AS name_confidence, s.possession_confidence
 FROM goals g LEFT JOIN scorers s USING (match_id, goal_frame)
 LEFT JOIN goal_number_consensus n ON n.match_id = g.match_id AND n.goal_frame = g.goal_frame
 LEFT JOIN goal_name_consensus m ON m.match_id = g.match_id AND m.goal_frame = g.goal_frame
 LEFT JOIN goal_state t ON t.match_id = g.match_id AND t.goal_frame = g.goal_frame
 LEFT JOIN named_plays p ON p.match_id = g.match_id AND p.team_slot = t.slot))"""
VIEWS |= {
    "players": """players AS (SELECT CAST(s_nationkey AS BIGINT) AS team_id, CAST(s_suppkey % 100 AS INT) AS jersey_no, min(s_suppkey) AS player_id, min(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END) AS name
 FROM supplier WHERE s_acctbal > 4500 GROUP BY ALL)""",
    "numbered_plays": "numbered_plays AS (SELECT match_id * 2 + team_slot AS play_id, match_id, team_id, team_name FROM plays JOIN teams USING (team_id))",
    "told": """told AS (SELECT c.match_id * 1000000 + c.frame_num AS event_id, c.match_id, c.frame_num, c.event, s.track_id, s.team_name, s.jersey_number, s.player_name, s.g, p.play_id, p.team_id FROM confirmed c
 LEFT JOIN named_scorers s ON c.event = 'goal' AND s.match_id = c.match_id AND s.goal_frame = c.frame_num LEFT JOIN numbered_plays p ON p.match_id = c.match_id AND p.team_name = s.team_name)""",
    "seen_players": """seen_players AS (SELECT team_id, jersey_number AS jersey_no, arg_min(player_name, event_id) FILTER (player_name IS NOT NULL) AS name FROM told WHERE jersey_number IS NOT NULL AND team_id IS NOT NULL GROUP BY ALL)""",
    "kept_players": """kept_players AS (SELECT player_id, team_id, jersey_no, coalesce(nullif(p.name, ''), f.name) AS name FROM players p LEFT JOIN seen_players f USING (team_id, jersey_no)
 UNION ALL SELECT (SELECT max(player_id) FROM players) + row_number() OVER (ORDER BY substr(md5(team_id || '/' || jersey_no), 1, 3), team_id, jersey_no), team_id, jersey_no, name FROM seen_players ANTI JOIN players USING (team_id, jersey_no))""",
    "requests": """requests AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 1 THEN upper(c_name) ELSE 'Customer#' || lpad(CAST(c_custkey - c_custkey % 3 + 2 AS VARCHAR), 9, '0') END AS username,
 'mail' || (c_custkey % 997) || '@example.com' AS email, c_name, c_acctbal FROM customer)""",
    "kit_samples": """kit_samples AS (SELECT match_id, CASE WHEN match_id % 7 = 3 THEN 40 ELSE b END AS b, CASE WHEN match_id % 7 = 3 THEN 40 ELSE g END AS g, CASE WHEN match_id % 7 = 3 THEN 40 ELSE r END AS r,
 frame_num % 50 + 40 AS area, match_id * 100 + frame_num AS sample_id FROM player_colors WHERE match_id % 11 <> 4 OR frame_num = 0)""",
    "pixels": """pixels AS (SELECT match_id, frame_num, i // 8 AS y, i % 8 AS x, CAST(greatest(0, least(255, floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255))) AS BIGINT) AS v
 FROM (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS match_id, vec_id % 100 AS frame_num, embedding FROM embeddings), (SELECT unnest(range(64)) AS i))""",
    "kit_centers": f"kit_centers AS ({_two_means()})",
    "kit_clusters": f"""kit_clusters AS (SELECT match_id, CAST(k AS INT) AS cluster_id, color, 'Team ' || (k + 1) AS label, sample_id, members, 'team_' || (k + 1) || '.jpg' AS sample_image, CAST(NULL AS VARCHAR) AS reason FROM (
 SELECT match_id, CASE WHEN second <> ((r1, g1, b1) < (r0, g0, b0)) THEN 1 ELSE 0 END AS k, any_value('#' || CASE WHEN second THEN {_HEX("r1")} || {_HEX("g1")} || {_HEX("b1")} ELSE {_HEX("r0")} || {_HEX("g0")} || {_HEX("b0")} END) AS color,
  arg_min(sample_id, (far, -area, sample_id)) AS sample_id, count(*) AS members FROM (SELECT *, ({_GAP(1)}) < ({_GAP(0)}) AS second, least({_GAP(0)}, {_GAP(1)}) AS far FROM kit_samples JOIN kit_centers USING (match_id) WHERE n_samples >= 2 AND colours >= 2) GROUP BY ALL)
 UNION ALL SELECT match_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN n_samples < 2 THEN 'too few samples' ELSE 'one colour only' END FROM kit_centers WHERE n_samples < 2 OR colours < 2)""",
    "open_requests": """open_requests AS (SELECT *, row_number() OVER (ORDER BY request_id) AS k FROM requests r WHERE NOT EXISTS (
 SELECT 1 FROM requests o WHERE o.c_acctbal > 4500 AND (lower(o.c_name) = lower(r.username) OR o.email = r.email)))""",
    "tried_requests": """tried_requests AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS emails, false AS fits UNION ALL
 SELECT o.k, CASE WHEN f THEN list_append(names, lower(username)) ELSE names END, CASE WHEN f THEN list_append(emails, email) ELSE emails END, f FROM (
  SELECT o.k, username, email, names, emails, NOT list_contains(names, lower(username)) AND NOT list_contains(emails, email) AS f FROM tried_requests t JOIN open_requests o ON o.k = t.k + 1) o)""",
    "free_requests": "free_requests AS (SELECT o.* FROM open_requests o JOIN tried_requests t ON t.k = o.k WHERE fits)",
}
VIEWS["occurrences"] = """occurrences AS (SELECT event_id, 2*event_id AS occurrence_id, track_id AS detected_track_id, jersey_number AS detected_jersey_no FROM (SELECT *, match_id*1000+goal_frame AS event_id FROM named_scorers)
 UNION ALL SELECT event_id, 2*event_id+1, track_id + 100, jersey_number FROM (SELECT *, match_id*1000+goal_frame AS event_id FROM named_scorers) WHERE event_id % 3 = 0)"""
VIEWS["top_crops"] = """top_crops AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id, track_id ORDER BY score DESC, frame_num DESC) AS INT) AS rank FROM crops_scored WHERE frame_num % 3 = 0) WHERE rank <= 16)"""
VIEWS["goal_crops"] = """goal_crops AS (SELECT * FROM (SELECT s.match_id, s.goal_frame, s.track_id, CAST(row_number() OVER (PARTITION BY s.match_id, s.goal_frame ORDER BY score DESC, c.frame_num DESC) AS INT) AS rank,
 c.frame_num AS crop_frame, quality FROM scorers s JOIN crops_scored c ON c.match_id = s.match_id AND c.track_id = s.track_id AND c.frame_num <= s.goal_frame AND c.frame_num % 3 = 0) WHERE rank <= 8)"""

SELECTS = {
    "bbox_center_foot": """SELECT match_id, frame_num, object_class, track_id, cx, cy, cx AS fx, fy, cx AS px, CASE WHEN object_class = 'ball' THEN cy ELSE fy END AS py, width FROM (
 SELECT *, CAST(trunc((x1+x2)/2) AS INT) AS cx, CAST(trunc((y1+y2)/2) AS INT) AS cy, CAST(trunc(y2) AS INT) AS fy, x2-x1 AS width FROM (
 SELECT match_id, frame_num, 'player' AS object_class, track_id, x1, y1, x2, y2 FROM tracks UNION ALL SELECT match_id, frame_num, 'ball', 1, x1, y1, x2, y2 FROM ball))""",
    "pair_distance": """SELECT t.match_id, t.frame_num, track_id, sqrt((fx-bx)*(fx-bx)+(fy-by_)*(fy-by_)) AS distance, fx-bx AS dx, fy-by_ AS dy
 FROM (SELECT match_id, frame_num, track_id, CAST(trunc((x1+x2)/2) AS INT) AS fx, CAST(trunc(y2) AS INT) AS fy FROM tracks) t
 JOIN (SELECT match_id, frame_num, CAST(trunc((x1+x2)/2) AS INT) AS bx, CAST(trunc((y1+y2)/2) AS INT) AS by_ FROM ball) b USING (match_id, frame_num)""",
    "class_remap_split": "SELECT match_id, frame_num, track_id, replace(object_class, 'goalkeeper', 'player') AS object_class, confidence FROM detections WHERE confidence >= 0.1",
    "ball_last_detection": """SELECT match_id, frame_num, CAST(1 AS INT) AS track_id, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_num ORDER BY det_order DESC) AS k
 FROM ball_detections WHERE confidence >= 0.1) WHERE k = 1""",
    "class_split": """SELECT CASE object_class WHEN 'referee' THEN 'referees' ELSE 'players' END AS part, match_id, frame_num, track_id, x1, y2 FROM detections WHERE confidence >= 0.1
 UNION ALL SELECT 'ball', match_id, frame_num, 1, arg_max(x1, det_order), arg_max(y2, det_order) FROM ball_detections WHERE confidence >= 0.1 GROUP BY match_id, frame_num""",
    "camera_movement_argmax": "SELECT match_id, frame_num, dx, dy FROM moves",
    "flow_features": """SELECT match_id, frame_num, coalesce(moved, first_frame) AS features_from FROM (SELECT match_id, frame_num, last_value(CASE WHEN dx <> 0 OR dy <> 0 THEN frame_num END IGNORE NULLS) OVER w AS moved, first_value(frame_num) OVER w AS first_frame
 FROM moves WINDOW w AS (PARTITION BY match_id ORDER BY frame_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE first_frame IS NOT NULL""",
    "staged_tracks": "SELECT match_id, track_id, count(*) AS n_rows, min(frame_num) AS first_frame, max(x2) AS right FROM tracks GROUP BY ALL",
    "movement_labels": "SELECT match_id, frame_num, 'Camera Movement X: ' || printf('%.2f', round(dx, 2)) AS x_text, 'Camera Movement Y: ' || printf('%.2f', round(dy, 2)) AS y_text FROM moves",
    "frame_numbers": "SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS match_id, o_orderkey, row_number() OVER (PARTITION BY CAST(floor(o_orderkey / 1000) AS BIGINT) ORDER BY o_orderkey) - 1 AS frame_num FROM orders",
    "camera_adjust": "SELECT match_id, frame_num, track_id, px, py, ax, ay FROM adjusted",
    "point_in_pitch": "SELECT match_id, track_id, frame_num, inside FROM on_pitch",
    "homography_project": "SELECT match_id, track_id, frame_num, round(x, 6) AS x, round(y, 6) AS y FROM projected",
    "crop_boxes": f"""SELECT match_id, frame_num, track_id, px1, py1, px2, py2, py2-py1 >= 40 AND px2-px1 >= 20 AS p_ok, CAST(py1 + trunc((py2-py1)/2) AS INT) AS c_y2, py2-py1 >= 4 AND px2-px1 >= 4 AS c_ok,
 jx1, jy1, jx2, jy2, jy2-jy1 >= 24 AND jx2-jx1 >= 16 AS j_ok FROM (SELECT match_id, frame_num, track_id,
 CAST({_clip('trunc(x1)', 1920)} AS INT) AS px1, CAST({_clip('trunc(x2)', 1920)} AS INT) AS px2, CAST({_clip('trunc(y1)', 1080)} AS INT) AS py1, CAST({_clip('trunc(y2)', 1080)} AS INT) AS py2,
 CAST({_clip('trunc(x1+(x2-x1)*CAST(0.08 AS DOUBLE))', 1920)} AS INT) AS jx1, CAST({_clip('trunc(x2-(x2-x1)*CAST(0.08 AS DOUBLE))', 1920)} AS INT) AS jx2,
 CAST({_clip('trunc(y1+(y2-y1)*CAST(0.08 AS DOUBLE))', 1080)} AS INT) AS jy1, CAST({_clip('trunc(y1+(y2-y1)*CAST(0.67 AS DOUBLE))', 1080)} AS INT) AS jy2 FROM tracks)""",
    "crop_quality": "SELECT match_id, frame_num, track_id, quality, round(score, 6) AS score FROM crops_scored",
    "crops_topk": """SELECT match_id, track_id, rank, frame_num, quality, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id, track_id ORDER BY score DESC, frame_num DESC) AS INT) AS rank FROM crops_scored) WHERE rank <= 16""",
    "crops_as_of_goal": "SELECT match_id, goal_frame, track_id, rank, crop_frame, quality FROM goal_crops",
    "scorer_image_path": "SELECT match_id, goal_frame, '/media/scorers/track_' || track_id || '_frame_' || crop_frame || '.jpg' AS url FROM goal_crops WHERE rank = 1",
    "hex_rgb_roundtrip": """SELECT *, CASE WHEN r IS NOT NULL THEN printf('#%02X%02X%02X', r, g, b) END AS back FROM (SELECT p_partkey, value,
 CASE WHEN ok THEN CAST(CAST('0x' || substr(bare, 1, 2) AS BIGINT) AS INT) END AS r, CASE WHEN ok THEN CAST(CAST('0x' || substr(bare, 3, 2) AS BIGINT) AS INT) END AS g, CASE WHEN ok THEN CAST(CAST('0x' || substr(bare, 5, 2) AS BIGINT) AS INT) END AS b
 FROM (SELECT *, ltrim(value, '#') AS bare, regexp_full_match(value, '#?[0-9A-Fa-f]{6}') AS ok FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_brand
 ELSE (CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '' END) || printf('%06X', p_partkey * 7919 % 16777216) END AS value FROM part)))""",
    "bgr_to_lab": "SELECT match_id, track_id, frame_num, round(l, 4) AS l, round(a, 4) AS a, round(lab_b, 4) AS lab_b FROM labs",
    "color_match_team": "SELECT * FROM kits",
    "team_sticky": """SELECT match_id, track_id, frame_num, coalesce(first_value(CASE WHEN team_id <> 0 THEN team_id END IGNORE NULLS) OVER w, team_id) AS team_id,
 coalesce(first_value(CASE WHEN team_id <> 0 THEN confidence END IGNORE NULLS) OVER w, confidence) AS confidence FROM kits
 WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_num ROWS UNBOUNDED PRECEDING)""",
    "nearest_player": "SELECT * FROM nearest",
    "possession": "SELECT * FROM touches",
    "ball_control_pct": """SELECT match_id, frame_num, holder, round(avg(CASE WHEN holder = 1 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS team_1_share, round(avg(CASE WHEN holder = 2 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS team_2_share FROM (
 SELECT f.match_id, f.frame_num, last_value(team_id IGNORE NULLS) OVER (PARTITION BY f.match_id ORDER BY f.frame_num ROWS UNBOUNDED PRECEDING) AS holder
 FROM (SELECT DISTINCT * FROM frames) f LEFT JOIN (SELECT * FROM touches WHERE team_id IN (1, 2)) t USING (match_id, frame_num)) WHERE holder IS NOT NULL
 WINDOW w AS (PARTITION BY match_id ORDER BY frame_num ROWS UNBOUNDED PRECEDING)""",
    "ball_interpolate": "SELECT match_id, frame_num, "
    + ", ".join(f"round(coalesce({c}, CASE WHEN pf IS NOT NULL AND nf IS NOT NULL THEN p{c} + (n{c} - p{c}) * ((frame_num - pf) / (nf - pf)) ELSE coalesce(p{c}, n{c}) END), 6) AS {c}" for c in ("x1", "y1", "x2", "y2"))
    + " FROM (SELECT f.match_id, f.frame_num, x1, y1, x2, y2, last_value(CASE WHEN x1 IS NOT NULL THEN frame_num END IGNORE NULLS) OVER b AS pf, first_value(CASE WHEN x1 IS NOT NULL THEN frame_num END IGNORE NULLS) OVER a AS nf, "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER b AS p{c}, first_value({c} IGNORE NULLS) OVER a AS n{c}" for c in ("x1", "y1", "x2", "y2"))
    + " FROM (SELECT DISTINCT * FROM frames) f LEFT JOIN ball USING (match_id, frame_num) WINDOW b AS (PARTITION BY f.match_id ORDER BY f.frame_num ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY f.match_id ORDER BY f.frame_num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    "speed_distance": "SELECT match_id, track_id, frame_num, round(speed, 6) AS speed, round(distance, 6) AS distance FROM speeds",
    "speed_labels": """SELECT match_id, track_id, frame_num, CAST(trunc((x1+x2)/2) AS INT) AS label_x, CAST(trunc(y2) AS INT) + 40 AS speed_y, CAST(trunc(y2) AS INT) + 60 AS distance_y,
 printf('%.2f', round(speed, 2)) || ' km/h' AS speed_text, printf('%.2f', round(distance, 2)) || ' m' AS distance_text FROM speeds JOIN tracks USING (match_id, track_id, frame_num)""",
    "annotations": """SELECT match_id, frame_num, track_id, cx AS ellipse_x, CAST(trunc(y2) AS INT) AS ellipse_y, CAST(trunc(x2-x1) AS INT) AS axis_x, CAST(trunc((x2-x1)*CAST(0.35 AS DOUBLE)) AS INT) AS axis_y, cx AS marker_x, ty AS marker_y,
 cx-10 AS marker_left, cx+10 AS marker_right, ty-20 AS marker_top, ty-24 AS label_y FROM (SELECT *, CAST(trunc((x1+x2)/2) AS INT) AS cx, CAST(trunc(y1) AS INT) AS ty FROM tracks)""",
    "feature_window": """SELECT match_id, frame_num, CAST(10 AS INT) AS steps, round(first_sum, 4) AS first_sum, round(last_sum, 4) AS last_sum FROM (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS match_id, vec_id % 100 AS frame_num,
 lag(s, 9) OVER (PARTITION BY floor(vec_id / 100) ORDER BY vec_id) AS first_sum, s AS last_sum FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings)) WHERE first_sum IS NOT NULL""",
    "feature_fixed": """SELECT CAST(floor(vec_id / 100) AS BIGINT) AS match_id, vec_id % 100 AS frame_num, CAST(40 AS INT) AS n_cut, CAST(80 AS INT) AS n_filled,
 round(list_sum(list_transform(embedding[1:40], lambda x: CAST(x AS DOUBLE))), 4) AS cut_sum, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS filled_sum FROM embeddings""",
    "event_types": "SELECT * FROM detected_events WHERE event IN ('goal', 'foul')",
    "event_thresholds": "SELECT * FROM eligible",
    "event_presence": "SELECT * FROM present",
    "event_cooldown": "SELECT * FROM confirmed",
    "event_cooldown_per_class": "SELECT p.match_id, p.frame_num, p.event, p.confidence FROM peaks p JOIN peak_taken t USING (match_id, event, frame_num)",
    "event_peak": "SELECT * FROM peaks",
    "scorer_last_touch": "SELECT match_id, goal_frame, track_id, last_touch_frame FROM scorers",
    "possession_confidence": "SELECT match_id, goal_frame, possession_confidence FROM scorers",
    "ocr_numbers": "SELECT match_id, frame_num, track_id, text, value AS number FROM number_values",
    "ocr_names": "SELECT match_id, frame_num, track_id, text, value AS name FROM name_values",
    "jersey_consensus": "SELECT * FROM number_consensus",
    "name_consensus": "SELECT * FROM name_consensus",
    "ocr_payload_flatten": _PAYLOADS,
    "text_kinds": "SELECT match_id, frame_num, track_id, text, regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, '[A-Za-z]') AS letter FROM ocr_candidates",
    "goal_text": "SELECT match_id, goal_frame, g AS description FROM named_scorers",
    "match_summary_text": f"""SELECT c.match_id, c.frame_num, {_CLOCK('c.frame_num / 24')} || ' → ' || CASE WHEN event = 'goal' THEN g ELSE upper(event) END AS line,
 CASE WHEN event = 'goal' THEN g ELSE upper(event) || ' detected' END AS description, upper(substr(event, 1, 1)) || substr(event, 2) AS event_name
 FROM confirmed c LEFT JOIN named_scorers s ON s.match_id = c.match_id AND s.goal_frame = c.frame_num""",
    "time_mmss": f"SELECT match_id, frame_num, frame_num / 24 AS seconds, {_CLOCK('frame_num / 24')} AS clock FROM frames",
    "time_mss_rounded": f"""SELECT match_id, frame_num, CAST(s // 60 AS VARCHAR) || ':' || {_TWO('CAST(s % 60 AS VARCHAR)')} AS clock FROM (SELECT *, CAST(greatest(floor((frame_num - 24) / 24 + 0.5), 0) AS BIGINT) AS s FROM frames)""",
    "score_sheet": """SELECT match_id, team_slot, team_name, count(goal_frame) AS score FROM named_plays p LEFT JOIN (SELECT match_id, goal_frame, slot AS team_slot FROM goal_state) s
 USING (match_id, team_slot) GROUP BY ALL""",
    "scorer_list": "SELECT * EXCLUDE (g, last_touch_frame) FROM named_scorers",
    "scorers_shown": "SELECT match_id, goal_frame, coalesce(CAST(jersey_number AS VARCHAR), '—') AS number, coalesce(player_name, 'Name not confirmed') AS name FROM named_scorers",
    "possession_ring": "SELECT match_id, frame_num, track_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_num DESC, track_id DESC) AS k FROM touches) WHERE k <= 600",
    "stored_plays": "SELECT play_id, match_id, team_id, count(frame_num) AS score FROM numbered_plays LEFT JOIN (SELECT play_id, frame_num FROM told WHERE event = 'goal') USING (play_id) GROUP BY ALL",
    "stored_events": f"""SELECT event_id, match_id, event AS event_type, upper(substr(event, 1, 1)) || substr(event, 2) AS event_name,
 CASE WHEN event = 'goal' THEN g ELSE upper(event) || ' detected' END AS description, round(frame_num / 24, 6) AS time_seconds FROM told""",
    "stored_occurrences": """SELECT event_id AS occurrence_id, event_id, play_id, player_id, track_id AS detected_track_id, jersey_number AS detected_jersey_no, player_name AS detected_player_name,
 coalesce(team_name, 'unknown_team') AS detected_team_name FROM told LEFT JOIN kept_players ON kept_players.team_id = told.team_id AND jersey_no = jersey_number""",
    "stored_players": "SELECT player_id, team_id, jersey_no, name FROM kept_players",
    "match_object": """SELECT match_id, CAST(coalesce(n_teams, 0) AS INT) AS n_teams, CAST(coalesce(n_play, 0) AS INT) AS n_play, CAST(coalesce(n_events, 0) AS INT) AS n_events, CAST(coalesce(n_events, 0) AS INT) AS n_occurby,
 CAST(coalesce(n_players, 0) AS INT) AS n_players, coalesce(team_names, '') AS team_names, coalesce(goals, 0) AS goals, coalesce(descriptions, '') AS descriptions FROM matches
 LEFT JOIN (SELECT match_id, count(DISTINCT team_id) AS n_teams, count(*) AS n_play, string_agg(team_name, '|' ORDER BY team_id) AS team_names FROM numbered_plays GROUP BY 1) USING (match_id)
 LEFT JOIN (SELECT match_id, count(*) AS n_events, count(*) FILTER (event = 'goal' AND play_id IS NOT NULL) AS goals, string_agg(CASE WHEN event = 'goal' THEN g ELSE upper(event) || ' detected' END, '|' ORDER BY event_id) AS descriptions FROM told GROUP BY 1) USING (match_id)
 LEFT JOIN (SELECT told.match_id, count(DISTINCT player_id) AS n_players FROM told JOIN kept_players ON kept_players.team_id = told.team_id AND jersey_no = jersey_number GROUP BY 1) USING (match_id)""",
    "sample_frames": """SELECT DISTINCT match_id, frame_num FROM (SELECT match_id, CAST(floor(i * least(greatest(n - 1, 0), 1125) / 11) AS BIGINT) AS frame_num FROM
 (SELECT match_id, count(*) AS n FROM frames GROUP BY match_id), (SELECT unnest(range(0, 12)) AS i)) JOIN frames USING (match_id, frame_num)""",
    "match_list": 'SELECT match_id AS "matchId", match_date AS "matchDate", user_id AS "userId", status FROM matches',
    "match_list_of_user": 'SELECT match_id AS "matchId", match_date AS "matchDate", user_id AS "userId", status FROM matches WHERE user_id = 1',
    "match_summary": """SELECT m.*, team_1, team_2, coalesce(n_events, 0) AS n_events, coalesce(goals, 0) AS goals, coalesce(fouls, 0) AS fouls, coalesce(cards, 0) AS cards FROM matches m
 LEFT JOIN (SELECT match_id, max(team_name) FILTER (team_slot = 1) AS team_1, max(team_name) FILTER (team_slot = 2) AS team_2 FROM named_plays GROUP BY match_id) USING (match_id)
 LEFT JOIN (SELECT match_id, count(*) AS n_events, count(*) FILTER (event = 'goal') AS goals, count(*) FILTER (event = 'foul') AS fouls, count(*) FILTER (event = 'card') AS cards FROM confirmed GROUP BY match_id) USING (match_id)""",
    "occurrence_lookup": """SELECT e.event_id, e.match_id, e.event, o.occurrence_id, o.detected_track_id, o.detected_jersey_no FROM (SELECT match_id*1000+frame_num AS event_id, match_id, event FROM confirmed) e
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY occurrence_id DESC) AS k FROM occurrences) WHERE k = 1) o ON o.event_id = e.event_id""",
    "team_upsert": """WITH w AS (SELECT lower(n) AS k, min(n) AS n, coalesce(arg_max(c, s_suppkey) FILTER (c <> ''), '') AS c FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'Club ' || s_nationkey ELSE 'germany' END AS n, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE '#' || lpad(CAST(s_nationkey * 1000 + s_suppkey * 7 % 1000 AS VARCHAR), 6, '0') END AS c FROM supplier) GROUP BY 1)
 SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name, coalesce(nullif(c, ''), '#000000') AS color FROM nation LEFT JOIN w ON k = lower(n_name)
 UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY substr(md5(k), 1, 3), k), n, c FROM w WHERE k NOT IN (SELECT lower(n_name) FROM nation)""",
    "player_upsert": """WITH p AS (SELECT * FROM players), f AS (SELECT CAST(s_nationkey AS BIGINT) AS team_id, CAST(s_suppkey % 100 AS INT) AS jersey_no, 'P' || min(s_suppkey) AS name FROM supplier GROUP BY ALL)
 SELECT player_id, team_id, jersey_no, coalesce(nullif(p.name, ''), f.name) AS name FROM p LEFT JOIN f USING (team_id, jersey_no)
 UNION ALL SELECT (SELECT max(player_id) FROM p) + row_number() OVER (ORDER BY substr(md5(team_id || '/' || jersey_no), 1, 3), team_id, jersey_no), team_id, jersey_no, name FROM f ANTI JOIN p USING (team_id, jersey_no)""",
    "register_dedupe": "SELECT request_id, username, email FROM free_requests",
    "register_rows": """SELECT (SELECT max(c_custkey) FROM customer WHERE c_acctbal > 4500) + row_number() OVER (ORDER BY substr(md5(email), 1, 3), email) AS user_id, username, email, 'register' AS action,
 CAST('2020-01-01 00:00:00' AS TIMESTAMP) AS timestamp FROM free_requests""",
    "login_status": """SELECT request_id, user_id, CAST(CASE WHEN user_id IS NOT NULL AND request_id % 3 > 0 THEN 200 ELSE 401 END AS INT) AS status FROM requests
 LEFT JOIN (SELECT email, min(request_id) AS user_id FROM requests WHERE c_acctbal > 4500 GROUP BY email) USING (email)""",
    "registration_check": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'username' WHEN c_custkey % 7 = 0 THEN 'email' WHEN c_custkey % 140 < 6 OR c_custkey % 140 > 128 THEN 'password' END AS reason FROM customer""",
    "team_names_check": "SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 OR n_name = r_name THEN 'same name' END AS reason FROM nation JOIN region ON r_regionkey = n_regionkey",
    "upload_status": "SELECT page_id, CAST(CASE WHEN page_id % 4 = 0 THEN 415 WHEN page_id * 100000000 > 2147483648 THEN 413 ELSE 202 END AS INT) AS status FROM pages",
    "video_suffix_filter": """SELECT page_id, file_name, suffix, suffix IN ('.mp4', '.mov', '.avi', '.mkv') AS accepted FROM (SELECT *, lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) AS suffix FROM (
 SELECT page_id, page_id || CASE page_id % 6 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.avi' WHEN 3 THEN '.mkv' WHEN 4 THEN '.webm' ELSE '' END AS file_name FROM pages))""",
    "job_status": """SELECT 'job-' || match_id AS job_id, status, CASE WHEN status = 'completed' THEN 'Analysis complete' ELSE 'Analysis failed' END AS stage,
 CAST(CASE WHEN status = 'completed' THEN 100 END AS INT) AS progress_percent, CAST(NULL AS VARCHAR) AS team_candidates, CASE WHEN status <> 'completed' THEN 'no ball' END AS error FROM matches""",
    "job_results": """SELECT 'job-' || match_id AS job_id, CAST(CASE WHEN status = 'completed' THEN 200 ELSE 409 END AS INT) AS code, CASE WHEN status = 'completed' THEN match_id END AS result FROM matches
 UNION ALL SELECT 'job-' || match_id || 'x', 404, NULL FROM matches""",
    "match_config_check": """SELECT n_nationkey, color, team_id, CASE WHEN team_id NOT IN (1, 2) THEN 'no such team' WHEN length(trim(n_name)) = 0 THEN 'nameless team'
 WHEN NOT regexp_full_match(color, '#?[0-9A-Fa-f]{6}') THEN 'no such colour' END AS reason FROM (
 SELECT *, n_regionkey AS team_id, CASE WHEN n_nationkey % 4 = 0 THEN 'blue' ELSE '#' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') END AS color FROM nation)""",
    "identity_snapshot": """SELECT match_id, track_id, CAST(coalesce(slot, 0) AS INT) AS team_id, coalesce(team_name, 'unknown_team') AS team_name, coalesce(team_confidence, 0) AS team_confidence,
 n.value AS jersey_number, n.confidence AS jersey_confidence, m.value AS player_name, m.confidence AS name_confidence, coalesce(crop_count, 0) AS crop_count,
 coalesce(jersey_candidates, '') AS jersey_candidates, coalesce(name_candidates, '') AS name_candidates FROM
 (SELECT match_id, track_id, count(*) AS crop_count FROM top_crops GROUP BY ALL)
 FULL JOIN (SELECT match_id, track_id, string_agg(text, '|' ORDER BY frame_num, text) FILTER (regexp_matches(text, '[0-9]')) AS jersey_candidates,
  string_agg(text, '|' ORDER BY frame_num, text) FILTER (regexp_matches(text, '[A-Za-z]')) AS name_candidates FROM ocr_candidates WHERE confidence >= 0.5 GROUP BY ALL) USING (match_id, track_id)
 LEFT JOIN (SELECT match_id, track_id, arg_min(team_id, frame_num) AS slot, arg_min(team_confidence, frame_num) AS team_confidence FROM team_frames WHERE team_id <> 0 GROUP BY ALL) k USING (match_id, track_id)
 LEFT JOIN (SELECT match_id, team_slot AS slot, team_name FROM named_plays) p USING (match_id, slot)
 LEFT JOIN number_consensus n USING (match_id, track_id) LEFT JOIN name_consensus m USING (match_id, track_id)""",
    "job_progress": """WITH w AS (SELECT greatest(1, CAST(ceil((max(frame_num) + 1) / 12) AS BIGINT)) AS width FROM frames), c AS (SELECT frame_num // width AS slot, count(*) AS n FROM frames, w GROUP BY ALL)
 SELECT CAST(row_number() OVER (ORDER BY slot) AS INT) AS trigger, n AS n_rows, round(100 * sum(n) OVER (ORDER BY slot) / sum(n) OVER (), 2) AS percent FROM c""",
    "store_read_back": """SELECT 'plays' AS name, match_id, play_id AS id FROM numbered_plays UNION ALL SELECT 'events', match_id, event_id FROM told UNION ALL SELECT 'occurrences', match_id, event_id FROM told""",
    "result_json": """SELECT 'job-' || match_id AS job_id, CAST(CASE WHEN status = 'completed' THEN 200 ELSE 409 END AS INT) AS code, CAST(CASE WHEN status = 'completed' THEN g END AS BIGINT) AS goals,
 CAST(CASE WHEN status = 'completed' THEN n END AS INT) AS teams FROM matches JOIN (SELECT match_id, count(DISTINCT play_id) AS n, count(frame_num) AS g FROM numbered_plays LEFT JOIN (SELECT play_id, frame_num FROM told WHERE event = 'goal') USING (play_id) GROUP BY ALL) USING (match_id)""",
    "crop_sharpness": """WITH n AS (SELECT p.match_id, p.frame_num, p.y, p.x, sum(CASE WHEN k = 0 THEN -4 * q.v ELSE q.v END) AS l FROM pixels p, (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([0, 0, 0, 1, -1]) AS dy, unnest([0, 1, -1, 0, 0]) AS dx) d
  JOIN pixels q ON q.match_id = p.match_id AND q.frame_num = p.frame_num AND q.y = 7 - abs(7 - abs(p.y + dy)) AND q.x = 7 - abs(7 - abs(p.x + dx)) GROUP BY ALL)
 SELECT match_id, frame_num, CAST(round(var_pop(l) * 4096) AS BIGINT) AS sharpness FROM n GROUP BY ALL""",
    "crop_variants": """WITH h AS (SELECT match_id, frame_num, v, count(*) AS n FROM pixels GROUP BY ALL),
 e AS (SELECT match_id, frame_num, v, 256 * row_number() OVER w + (v + 1) * (64 - count(*) OVER (PARTITION BY match_id, frame_num)) AS upto FROM h WINDOW w AS (PARTITION BY match_id, frame_num ORDER BY v)),
 s AS (SELECT match_id, frame_num, y, x, (510 * upto + 16384) // 32768 AS v FROM pixels JOIN e USING (match_id, frame_num, v)),
 b AS (SELECT p.match_id, p.frame_num, p.y, p.x, any_value(p.v) AS v, sum((2 - abs(dy)) * (2 - abs(dx)) * q.v) AS blur FROM s p, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
  JOIN s q ON q.match_id = p.match_id AND q.frame_num = p.frame_num AND q.y = 7 - abs(7 - abs(p.y + dy)) AND q.x = 7 - abs(7 - abs(p.x + dx)) GROUP BY ALL),
 u AS (SELECT match_id, frame_num, y, x, 1 AS variant, greatest(0, least(255, CAST(floor((288 * v - 8 * blur + 80) / 160) AS BIGINT))) AS v FROM b UNION ALL SELECT match_id, frame_num, y, x, 0, v FROM pixels)
 SELECT match_id, frame_num, CAST(variant AS INT) AS variant, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (8 * y + x + 1)) AS BIGINT) AS weighted FROM u GROUP BY ALL""",
    "model_detections": """WITH o AS (SELECT match_id, frame_num, 0 AS k, 'ball' AS c, max(v) / 255 AS s, arg_min(8 * y + x, (-v, 8 * y + x)) AS i FROM pixels GROUP BY ALL
 UNION ALL SELECT match_id, frame_num, 1, 'player', (255 - min(v)) / 255 / 2, arg_min(8 * y + x, (v, 8 * y + x)) FROM pixels GROUP BY ALL)
 SELECT match_id, frame_num, CAST(k AS INT) AS det_order, c AS object_class, round(s, 6) AS confidence, CAST(i % 8 AS DOUBLE) AS x1, CAST(i // 8 AS DOUBLE) AS y1, CAST(i % 8 + 1 AS DOUBLE) AS x2, CAST(i // 8 + 1 AS DOUBLE) AS y2 FROM o WHERE s >= 0.45""",
    "model_readings": """WITH f AS (SELECT match_id, frame_num, any_value(v) FILTER (y = 0 AND x = 0) AS a, any_value(v) FILTER (y = 0 AND x = 1) AS b, any_value(v) FILTER (y = 0 AND x = 2) AS c FROM pixels GROUP BY ALL),
 r AS (SELECT match_id, frame_num, CAST(a % 23 AS VARCHAR) AS text, round(least(1, b / 200), 6) AS confidence, CAST(NULL AS VARCHAR) AS error FROM f WHERE match_id % 2 = 0 AND a % 7 <> 0
 UNION ALL SELECT match_id, frame_num, 'NO ' || c, 0.25, NULL FROM f WHERE match_id % 2 = 0 AND a % 7 <> 0 UNION ALL SELECT match_id, frame_num, NULL, NULL, 'no engine' FROM f WHERE match_id % 2 = 1)
 SELECT match_id, frame_num % 22 + 1 AS track_id, frame_num, text, confidence, CAST(0.5 AS DOUBLE) AS crop_quality, error FROM r""",
    "team_calibration": "SELECT * FROM kit_clusters",
    "team_names": """WITH t AS (SELECT o.match_id, o.frame_num, upper(substr(text, 1, CAST(2 + o.frame_num % 5 AS INT))) AS token, confidence, b, g, r FROM ocr_candidates o JOIN player_colors c ON c.match_id = o.match_id AND c.frame_num = o.frame_num % 100),
 n AS (SELECT match_id, frame_num // 100 AS w, token, round(sum(confidence), 9) AS weight, round(sum(confidence * (1 - sqrt((b - b0) * (b - b0) + (g - g0) * (g - g0) + (r - r0) * (r - r0)) / (sqrt(3) * 255))) / sum(confidence), 9) AS n0,
  round(sum(confidence * (1 - sqrt((b - b1) * (b - b1) + (g - g1) * (g - g1) + (r - r1) * (r - r1)) / (sqrt(3) * 255))) / sum(confidence), 9) AS n1
  FROM t JOIN kit_centers USING (match_id) WHERE regexp_full_match(token, '[A-Z]{2,5}') AND token NOT IN ('GOAL', 'TEAM', 'SCORE', 'SPORT', 'LIVE', 'MATCH', 'HOME', 'AWAY') GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY match_id, w ORDER BY weight DESC, token) AS k FROM n),
 p AS (SELECT a.match_id, a.w, a.token AS ta, b.token AS tb, a.n0 AS a0, a.n1 AS a1, b.n0 AS b0, b.n1 AS b1, round(a.n0 + b.n1, 9) >= round(a.n1 + b.n0, 9) AS straight FROM k a JOIN k b ON b.match_id = a.match_id AND b.w = a.w AND a.k = 1 AND b.k = 2),
 c AS (SELECT match_id, w, 0 AS cluster_id, CASE WHEN straight THEN ta ELSE tb END AS name, CASE WHEN straight THEN a0 ELSE b0 END AS near FROM p UNION ALL SELECT match_id, w, 1, CASE WHEN straight THEN tb ELSE ta END, CASE WHEN straight THEN b1 ELSE a1 END FROM p),
 s AS (SELECT *, round(0.6 * near + 0.4 * (count(*) OVER (PARTITION BY match_id, cluster_id, name ORDER BY w)) / (count(*) OVER (PARTITION BY match_id, cluster_id ORDER BY w)), 6) AS confidence FROM c),
 z AS (SELECT *, CASE WHEN confidence >= 0.7 THEN 'assign' WHEN confidence >= 0.45 THEN 'hold' ELSE 'none' END AS band FROM s)
 SELECT match_id, w AS "window", CAST(cluster_id AS INT) AS cluster_id, name, confidence, band, CASE WHEN band <> 'none' THEN last_value(CASE WHEN band = 'assign' THEN name END IGNORE NULLS) OVER (PARTITION BY match_id, cluster_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS shown FROM z""",
    "team_candidates": """SELECT match_id, '[' || string_agg('{"cluster_id":' || cluster_id || ',"color":"' || color || '","label":"' || label || '","sample_image":"' || sample_image || '"}', ',' ORDER BY cluster_id) || ']' AS team_candidates,
 max(reason) AS error FROM kit_clusters GROUP BY match_id""",
    "kit_color_udf": "SELECT match_id, frame_num, track_id, greatest(0, least(255, b)) AS b, greatest(0, least(255, g)) AS g, greatest(0, least(255, r)) AS r FROM player_colors",
    "stream_goal_crops": "SELECT * FROM goal_crops",
    "stream_match": "SELECT * EXCLUDE (g, last_touch_frame) FROM named_scorers",
    "stream_cooldown": "SELECT * FROM confirmed",
    "stream_last_touch": "SELECT * FROM scorers",
    "stream_sticky_team": "SELECT match_id, track_id, team_id, frame_num AS since FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_num) AS k FROM kits WHERE team_id <> 0) WHERE k = 1",
}


def compose(select: str) -> str:
    """The query with the views that it needs, directly or not, in front."""
    needed: dict[str, None] = {}

    def visit(sql: str, own: str = "") -> None:
        for word in re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", sql)):
            if word in VIEWS and word != own and word not in needed:
                visit(VIEWS[word].split(" AS ", 1)[1], word)
                needed[word] = None

    visit(select)
    if not needed:
        return select
    body = ", ".join(VIEWS[k] for k in needed)
    if select.startswith("WITH "):
        return f"WITH RECURSIVE {body}, {select[5:]}"
    return f"WITH RECURSIVE {body} {select}"


def _recurrence(steps: int = 10, hidden: int = 128) -> str:
    """The network gate by gate: windows meet the gates' weights as rows, a select for each step."""
    e = lambda k: f"m[({k}) % len(m) + 1]"
    scaled = lambda f, v: f"list_transform({v}, lambda x: {f} * x)"
    both = lambda a, b: f"list_concat({a}, {b})"
    sig = lambda x: f"(1 / (1 + exp(-({x}))))"
    tanh = lambda x: f"(1 - 2 / (exp(2 * ({x})) + 1))"
    sql = f"""WITH m AS (SELECT list(e ORDER BY vec_id) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id < 500)),
 gate AS (SELECT j, {scaled(0.5, e("j"))} AS wx, {scaled(0.25, both(e("j + 7"), e("j + 13")))} AS wh, {e("3 * j")}[j % 64 + 1] AS b FROM m, (SELECT unnest(range({4 * hidden})) AS j)),
 seen AS (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS match_id, vec_id % 100 AS frame_num, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 step0 AS (SELECT match_id, frame_num, xs, list_transform(range({hidden}), lambda k: CAST(0 AS DOUBLE)) AS h, list_transform(range({hidden}), lambda k: CAST(0 AS DOUBLE)) AS c
  FROM (SELECT match_id, frame_num, list(e) OVER (PARTITION BY match_id ORDER BY frame_num ROWS BETWEEN {steps - 1} PRECEDING AND CURRENT ROW) AS xs FROM seen) WHERE len(xs) = {steps})"""
    for t in range(1, steps + 1):
        sql += f""",
 z{t} AS (SELECT match_id, frame_num, any_value(c) AS c, list(list_inner_product(wx, xs[{t}]) + list_inner_product(wh, h) + b ORDER BY j) AS z FROM step{t - 1}, gate GROUP BY match_id, frame_num),
 n{t} AS (SELECT match_id, frame_num, z, list_transform(range(1, {hidden + 1}), lambda k: {sig(f"z[{hidden} + k]")} * c[k] + {sig("z[k]")} * {tanh(f"z[{2 * hidden} + k]")}) AS c FROM z{t}),
 step{t} AS (SELECT match_id, frame_num, xs, n.c, list_transform(range(1, {hidden + 1}), lambda k: {sig(f"n.z[{3 * hidden} + k]")} * {tanh("n.c[k]")}) AS h FROM n{t} n JOIN step0 USING (match_id, frame_num))"""
    z = [f"exp(list_inner_product(h, {both(e(f'{100 + k}'), e(f'{200 + k}'))}) + {e(f'{300 + k}')}[1])" for k in range(3)]
    return f"""{sql}
 SELECT match_id, frame_num, CASE greatest(a, b, n) WHEN a THEN 'goal' WHEN b THEN 'foul' ELSE 'none' END AS event, round(greatest(a, b, n) / (a + b + n), 6) AS confidence
 FROM (SELECT match_id, frame_num, {z[0]} AS a, {z[1]} AS b, {z[2]} AS n FROM step{steps}, m)"""


SELECTS["lstm_event_udf"] = _recurrence()
SELECTS["stream_feature_windows"] = SELECTS["feature_window"]
ORACLES = {k: compose(v) for k, v in SELECTS.items()}
