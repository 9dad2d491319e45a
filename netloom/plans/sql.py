"""DuckDB SQL of the board queries: one chain of named steps, then a SELECT."""

from __future__ import annotations

from netloom.operators import drills
from netloom.sources import boards

_LAYERS = ", ".join(f"'{x}'" for x in boards.COPPER)
_VALUES = ", ".join(f"('{x}')" for x in boards.COPPER)


def labels(name: str, src: str) -> str:
    """Connected runs of ``src`` as table ``name`` with column component."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (ORDER BY board_id, layer, y, x0) AS id FROM {src}),
{name}_d AS (SELECT a.id AS u, b.id AS v FROM {name}_n a JOIN {name}_n b ON a.board_id = b.board_id AND a.layer = b.layer AND a.y + 1 = b.y AND a.x0 < b.x1 AND b.x0 < a.x1),
{name}_e AS (SELECT u, v FROM {name}_d UNION ALL SELECT v, u FROM {name}_d),
{closure(name)},
{name} AS (SELECT board_id, layer, y, x0, x1, dense_rank() OVER (PARTITION BY board_id, layer ORDER BY c)::INT AS component FROM {name}_n JOIN {name}_cc USING (id))"""


def closure(name: str) -> str:
    """Smallest reachable id of every id, over the edges ``name``_e."""
    return f"""{name}_cc(id, c) USING KEY (id) AS (SELECT id, id FROM {name}_n UNION
  SELECT e.v, min(cc.c) FROM {name}_cc cc JOIN {name}_e e ON cc.id = e.u JOIN recurring.{name}_cc r ON r.id = e.v WHERE cc.c < r.c GROUP BY e.v)"""


def _score(name: str, mask: str) -> str:
    return f"""{labels(f"{name}_lab", mask)},
{name} AS (SELECT c.board_id, coalesce(n, 0)::BIGINT AS n_drills, coalesce(t, 0)::BIGINT AS touches, CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE coalesce(t, 0)::DOUBLE / n END AS score FROM canvas c
  LEFT JOIN (SELECT board_id, count(DISTINCT component) AS n FROM {name}_lab GROUP BY board_id) USING (board_id)
  LEFT JOIN (SELECT l.board_id, count(DISTINCT component) AS t FROM {name}_lab l JOIN outer_run o ON l.board_id = o.board_id AND l.y = o.y AND l.x0 < o.x1 AND o.x0 < l.x1 GROUP BY l.board_id) USING (board_id))"""


def _classified(mode: str) -> str:
    real = "touch" if mode == "explicit" else f"touch AND pad_ring_fraction >= {drills.PAD_COPPER} AND pad_ring_angular_coverage >= {drills.PAD_ANGLES}"
    rules = {
        "never": "[(true, false, 'explicit_npth', 1)]",
        "explicit": "CASE WHEN n > 0 THEN (true, 'explicit_pth', 2) ELSE (false, 'explicit_pth_no_copper', 2) END",
        "infer": """CASE WHEN n = 0 THEN (false, 'likely_npth', 3) WHEN radius_px >= large_px AND n <= 1 THEN (false, 'likely_npth', 4)
  WHEN n = 1 AND (f OR l) THEN (false, 'ambiguous_likely_npth', 5) WHEN f AND l THEN (true, 'likely_pth', 6) WHEN radius_px <= small_px AND p THEN (true, 'likely_pth', 7)
  WHEN p AND n >= 2 THEN (true, 'likely_pth', 8) WHEN NOT p THEN (false, 'likely_npth', 9) ELSE (false, 'ambiguous_likely_npth', 10) END""",
    }
    pick = "(false, 'explicit_npth', 1)" if mode == "never" else rules[mode]
    return f"""decision_{mode} AS (SELECT board_id, drill, radius_px, d[1]::BOOLEAN AS plated, d[2] AS classification, d[3]::INT AS rule FROM (SELECT *, {pick} AS d FROM (
  SELECT b.board_id, b.drill, b.radius_px, small_px, large_px, coalesce(n, 0) AS n, coalesce(f, false) AS f, coalesce(l, false) AS l, coalesce(p, false) AS p FROM blob b JOIN limits USING (board_id) LEFT JOIN
  (SELECT board_id, drill, count(*) FILTER ({real}) AS n, bool_or({real} AND layer = '{boards.COPPER[0]}') AS f, bool_or({real} AND layer = '{boards.COPPER[-1]}') AS l, bool_or({real} AND contact = 'partial') AS p
   FROM (SELECT *, contact <> 'none' AND len(component_ids) > 0 AS touch FROM contact) GROUP BY board_id, drill) USING (board_id, drill))))"""


def _stats(name: str, src: str) -> str:
    return f"""{name} AS (SELECT board_id, layer, component, sum(x1 - x0)::BIGINT AS area_px, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, (max(y) + 1)::INT AS y1,
  sum((x0 + x1 - 1) / 2.0::DOUBLE * (x1 - x0)) / sum(x1 - x0) AS cx, sum(y::DOUBLE * (x1 - x0)) / sum(x1 - x0) AS cy FROM {src} GROUP BY board_id, layer, component)"""


_D = "sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))"
CHAIN = f"""{boards.sql("")},
copper AS (SELECT * FROM run WHERE layer IN ({_LAYERS})),
{labels("lab", "copper")},
{_stats("comp", "lab")},
{labels("dlab", "drill")},
{_stats("dstat", "dlab")},
blob AS (SELECT board_id, component AS drill, area_px, sqrt(area_px / pi()) AS radius_px, x0, y0, x1, y1, cx, cy FROM dstat),
limits AS (SELECT board_id, greatest({drills.LEAST_SMALL}, coalesce(p60, {drills.LEAST_SMALL}))::DOUBLE AS small_px, greatest({drills.LEAST_LARGE}, coalesce(p90, {drills.LEAST_LARGE}))::DOUBLE AS large_px FROM canvas
  LEFT JOIN (SELECT board_id, quantile_cont(radius_px, 0.6) AS p60, quantile_cont(radius_px, 0.9) AS p90 FROM blob GROUP BY board_id) USING (board_id)),
px AS (SELECT board_id, drill, y, x, {_D} >= radius_px + 1 AND {_D} <= radius_px + 5 AS near, {_D} > radius_px AND {_D} <= greatest(radius_px + 1, radius_px * 1.05::DOUBLE) AS pad,
  least(31, greatest(0, floor((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 32)))::INT AS bin FROM (SELECT *, unnest(range(greatest(0, floor(cx - radius_px - 5)::INT), least({boards.SIDE}, ceil(cx + radius_px + 5)::INT + 1)))::INT AS x
  FROM (SELECT *, unnest(range(greatest(0, floor(cy - radius_px - 5)::INT), least({boards.SIDE}, ceil(cy + radius_px + 5)::INT + 1)))::INT AS y FROM blob))),
ring AS (SELECT board_id, drill, count(*) FILTER (near) AS near, count(*) FILTER (pad) AS pad, count(DISTINCT bin) FILTER (pad) AS bins FROM px GROUP BY board_id, drill),
met AS (SELECT px.board_id, drill, layer, count(*) FILTER (near) AS near, count(*) FILTER (pad) AS pad, count(DISTINCT bin) FILTER (pad) AS bins, list_sort(coalesce(list(DISTINCT component) FILTER (near), [])) AS ids
  FROM px JOIN lab ON px.board_id = lab.board_id AND px.y = lab.y AND px.x >= lab.x0 AND px.x < lab.x1 GROUP BY px.board_id, drill, layer),
share AS (SELECT board_id, drill, v.layer, coalesce(m.near / nullif(r.near, 0), 0)::DOUBLE AS f, CASE WHEN r.near > 0 THEN coalesce(m.pad / nullif(r.pad, 0), 0) ELSE 0 END::DOUBLE AS p, CASE WHEN r.near > 0 THEN coalesce(m.bins / nullif(r.bins, 0), 0) ELSE 0 END::DOUBLE AS a, m.ids
  FROM blob CROSS JOIN (VALUES {_VALUES}) v(layer) LEFT JOIN ring r USING (board_id, drill) LEFT JOIN met m USING (board_id, drill, layer)),
contact AS (SELECT board_id, drill, layer, CASE WHEN f >= {drills.LEAST_COPPER} THEN coalesce(ids, []) ELSE [] END AS component_ids, f AS copper_fraction, p AS pad_ring_fraction, a AS pad_ring_angular_coverage,
  p >= {drills.PAD_COPPER} AND a >= {drills.PAD_ANGLES} AS pad_ring_contact, CASE WHEN f < {drills.LEAST_COPPER} THEN 'none' WHEN f >= {drills.ALL_AROUND} THEN 'all_around' ELSE 'partial' END AS contact FROM share),
{_classified("infer")},
{_classified("explicit")},
{_classified("never")},
member AS (SELECT c.board_id, c.drill, layer, unnest(component_ids) AS component FROM contact c JOIN decision_infer d ON c.board_id = d.board_id AND c.drill = d.drill AND d.plated),
node_n AS (SELECT board_id, layer, component, row_number() OVER (ORDER BY board_id, layer, component) AS id FROM comp),
hub AS (SELECT board_id, drill, min(id) AS h FROM member JOIN node_n USING (board_id, layer, component) GROUP BY board_id, drill),
node_e AS (SELECT id AS u, h AS v FROM member JOIN node_n USING (board_id, layer, component) JOIN hub USING (board_id, drill) UNION SELECT h, id FROM member JOIN node_n USING (board_id, layer, component) JOIN hub USING (board_id, drill)),
{closure("node")},
net AS (SELECT board_id, layer, component, dense_rank() OVER (PARTITION BY board_id ORDER BY c)::INT AS net FROM node_n JOIN node_cc USING (id)),
nrun AS (SELECT board_id, layer, y, x0, x1, net FROM lab JOIN net USING (board_id, layer, component)),
outer_raw AS (SELECT board_id, 'outer' AS layer, y, x0, x1 FROM run WHERE NOT starts_with(layer, 'In')),
outer_run AS ({boards.merge_sql("outer_raw")}),
{_score("score", "drill")},
{_score("score_shifted", "shifted")},
poor AS (SELECT board_id FROM score_shifted WHERE score < 0.9 AND n_drills > 0),
votes AS (SELECT board_id, dy, dx, count(*) AS n FROM (SELECT board_id, dy, unnest(range(x0 - x, x1 - x)) AS dx FROM
  (SELECT d.board_id, o.y - d.y AS dy, o.x0, o.x1, d.x FROM (SELECT board_id, y, unnest(range(x0, x1)) AS x FROM shifted WHERE board_id IN (FROM poor)) d JOIN outer_run o ON d.board_id = o.board_id)) GROUP BY ALL),
offs AS (SELECT board_id, dy::INT AS dy, dx::INT AS dx FROM votes QUALIFY row_number() OVER (PARTITION BY board_id ORDER BY n DESC, dy, dx) = 1),
moved AS (SELECT board_id, layer, y + dy AS y, greatest(0, x0 + dx) AS x0, least({boards.SIDE}, x1 + dx) AS x1 FROM shifted JOIN offs USING (board_id) WHERE y + dy BETWEEN 0 AND {boards.SIDE - 1} AND greatest(0, x0 + dx) < least({boards.SIDE}, x1 + dx)),
{_score("score_moved", "moved")},
files AS (SELECT n_nationkey::INT AS board_id, unnest([{{names}}][n_nationkey % {{families}} + 1]) AS filename FROM nation)"""


def query(select: str, files: str = "['a.gtl']", families: int = 1) -> str:
    return CHAIN.replace("{names}", files).replace("{families}", str(families)) + "\n" + select
