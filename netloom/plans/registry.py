"""Every registered query of the engine, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import catalog
from netloom.operators import artwork, audit, components, drawing, drills, export, geometry, masks, netmap, nets, paint, vector
from netloom.plans import jobs, sql
from netloom.plans.extract import Extraction
from netloom.sources import boards, files
from netloom.sources.boards import COPPER, PLANE, SIDE, STACK
from netloom.plans.store import NetCache, board_digests, digest_sql, mask_digests, settings
from netloom.storage import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def registered(select: str | None, **options):
    """Registers a query under its name with the SELECT that it equals."""

    def add(f: Query) -> Query:
        _ALL[f.__name__] = f, None if select is None else sql.query(select, **options)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in _ALL.items() if s is not None}


def extraction(spark: SparkSession, sf_dir: str, mode: str = "infer") -> Extraction:
    b = boards.derive(spark, sf_dir)
    return Extraction(b.copper, b.drill, b.canvas, COPPER, mode)


def digits(*names: str, n: int = 6) -> list[Column]:
    """Doubles rounded, so that engines agree on the last place."""
    return [F.round(c, n).alias(c) for c in names]


def sql_digits(*names: str, n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in names)


# masks


@registered("SELECT board_id, layer, y, x0, x1 FROM run")
def mask_runs(spark, sf_dir):
    return boards.derive(spark, sf_dir).runs


@registered(f"SELECT board_id, layer, coalesce(px, 0)::BIGINT AS area_px, coalesce(px, 0)::DOUBLE / {SIDE * SIDE} AS fill FROM canvas CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in STACK)}) v(layer) LEFT JOIN (SELECT board_id, layer, sum(x1 - x0) AS px FROM run GROUP BY ALL) USING (board_id, layer)")
def mask_fill(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    return masks.fill(b.runs, masks.layer_canvas(b.canvas, STACK))


@registered(boards.complement_sql("(SELECT * FROM run WHERE layer = 'F_Cu')", "(SELECT *, 'F_Cu' AS layer FROM canvas)"))
def mask_invert_runs(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    return masks.complement(b.runs.where("layer = 'F_Cu'"), masks.layer_canvas(b.canvas, ("F_Cu",)))


@registered("SELECT board_id, layer, y, x0, x1 FROM shifted")
def mask_shift(spark, sf_dir):
    return boards.derive(spark, sf_dir).shifted


@registered("SELECT board_id, layer, y, x0, x1 FROM outer_run")
def mask_union_outer(spark, sf_dir):
    return audit.outer_copper(boards.derive(spark, sf_dir).runs)


@registered("SELECT c.board_id, c.layer, c.y, greatest(c.x0, d.x0) AS x0, least(c.x1, d.x1) AS x1 FROM copper c JOIN drill d ON c.board_id = d.board_id AND c.y = d.y AND c.x0 < d.x1 AND d.x0 < c.x1")
def mask_and_drill(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    return masks.intersect(b.copper, b.drill)


_FREE = boards.complement_sql("drill", "(SELECT *, 'drill' AS layer FROM canvas)")


@registered(f"SELECT c.board_id, c.layer, c.y, greatest(c.x0, d.x0) AS x0, least(c.x1, d.x1) AS x1 FROM copper c JOIN ({_FREE}) d ON c.board_id = d.board_id AND c.y = d.y AND c.x0 < d.x1 AND d.x0 < c.x1")
def mask_punch(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    return masks.punch(b.copper, b.drill, b.canvas)


@registered("SELECT board_id, layer, y, x, CASE WHEN bool_or(layer_kind = 1) THEN 255 ELSE 128 END AS red, CASE WHEN bool_or(layer_kind = 1) THEN 0 ELSE 128 END AS green_blue FROM (SELECT board_id, 'audit' AS layer, y, unnest(range(x0, x1))::INT AS x, 0 AS layer_kind FROM run UNION ALL SELECT board_id, 'audit', y, unnest(range(x0, x1))::INT, 1 FROM drill) GROUP BY ALL")
def audit_overlay_rows(spark, sf_dir):
    """The pixels of every row of the overlay: copper grey, drilled areas pure red."""
    b = boards.derive(spark, sf_dir)
    both = b.runs.withColumn("k", F.lit(0)).unionByName(b.drill.withColumn("k", F.lit(1)))
    px = both.select("board_id", F.lit("audit").alias("layer"), "y", "k", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    top = px.groupBy("board_id", "layer", "y", "x").agg(F.max("k").alias("k"))
    return top.select("board_id", "layer", "y", "x", F.when(F.col("k") == 1, 255).otherwise(128).alias("red"), F.when(F.col("k") == 1, 0).otherwise(128).alias("green_blue"))


@registered(None)
def audit_overlay(spark, sf_dir):
    """The overlay as runs; audit_overlay_rows has its pixels."""
    b = boards.derive(spark, sf_dir)
    return audit.overlay(b.runs, b.drill, b.canvas)


# audits

_FILL = f"(SELECT board_id, layer, coalesce(px, 0)::DOUBLE / {SIDE * SIDE} AS fill FROM canvas CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in STACK)}) v(layer) LEFT JOIN (SELECT board_id, layer, sum(x1 - x0) AS px FROM run GROUP BY ALL) USING (board_id, layer))"
_VERDICT = f"(SELECT *, CASE WHEN layer IN ('F_Cu', 'B_Cu') AND fill > 0.6 THEN 'warn' WHEN layer IN ('F_Cu', 'B_Cu') THEN 'none' WHEN fill > 0.6 THEN 'invert' WHEN fill < 0.4 THEN 'none' ELSE 'ambiguous' END AS verdict FROM {_FILL})"


@registered(f"SELECT board_id, layer, fill, verdict, verdict = 'invert' AS invert, 'auto' AS source FROM {_VERDICT}")
def polarity_verdicts(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    v = audit.polarity(masks.fill(b.runs, masks.layer_canvas(b.canvas, STACK)))
    return audit.resolve_invert(v).select("board_id", "layer", "fill", "verdict", "invert", "source")


@registered(f"SELECT board_id, layer, sum(x1 - x0)::BIGINT AS area_px, count(*) AS n_runs FROM (SELECT r.* FROM run r JOIN {_VERDICT} v ON r.board_id = v.board_id AND r.layer = v.layer AND verdict <> 'invert' UNION ALL {boards.complement_sql(f'(SELECT * FROM run WHERE layer = {PLANE!r} AND board_id IN (SELECT board_id FROM {_VERDICT} WHERE verdict = {'invert'!r}))', f'(SELECT *, {PLANE!r} AS layer FROM canvas WHERE board_id IN (SELECT board_id FROM {_VERDICT} WHERE verdict = {'invert'!r}))')}) GROUP BY ALL")
def prepare_masks(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    layers = masks.layer_canvas(b.canvas, STACK)
    ready = audit.prepare(b.runs, layers, audit.resolve_invert(audit.polarity(masks.fill(b.runs, layers))))
    return ready.groupBy("board_id", "layer").agg(F.sum(F.col("x1") - F.col("x0")).alias("area_px"), F.count("*").alias("n_runs"))


@registered(f"SELECT board_id, n_drills, touches, {sql_digits('score')} FROM score")
def alignment_score(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    return audit.alignment_score(b.drill, audit.outer_copper(b.runs), b.canvas).select("board_id", "n_drills", "touches", *digits("score"))


@registered("SELECT board_id, dy, dx FROM offs")
def detect_offset(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    copper = audit.outer_copper(b.runs)
    poor = audit.alignment_score(b.shifted, copper, b.canvas).where("score < 0.9 AND n_drills > 0").select("board_id")
    mine = lambda df: df.join(poor, "board_id", "left_semi")
    return audit.detect_offset(mine(b.shifted), mine(copper), mine(b.canvas))


_EVERY = "SELECT board_id, dy, unnest(range(x0 - x, x1 - x)) AS dx FROM (SELECT d.board_id, o.y - d.y AS dy, o.x0, o.x1, d.x FROM (SELECT board_id, y, unnest(range(x0, x1)) AS x FROM shifted) d JOIN outer_run o ON d.board_id = o.board_id)"


@registered(f"SELECT board_id, coalesce(dy, 0)::INT AS dy, coalesce(dx, 0)::INT AS dx FROM canvas LEFT JOIN (SELECT board_id, dy, dx FROM (SELECT board_id, dy, dx, count(*) AS n FROM ({_EVERY}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY board_id ORDER BY n DESC, dy, dx) = 1) USING (board_id)")
def detect_offset_all(spark, sf_dir):
    """Every board's displacement, in tiles smaller than a board."""
    b = boards.derive(spark, sf_dir)
    return audit.detect_offset(b.shifted, audit.outer_copper(b.runs), b.canvas, tile=100)


_ALIGN = """(SELECT s.board_id, s.n_drills, s.touches, s.score, coalesce(dy, 0) AS dy, coalesce(dx, 0) AS dx, coalesce(m.score, 0) AS score2 FROM score_shifted s LEFT JOIN offs USING (board_id) LEFT JOIN (SELECT * FROM score_moved WHERE board_id IN (FROM poor)) m ON m.board_id = s.board_id)"""
_AV = f"(SELECT *, CASE WHEN n_drills = 0 OR score >= 0.9 THEN 'none' WHEN (dy <> 0 OR dx <> 0) AND score2 >= 0.9 AND score2 > score + 0.1 THEN 'shift' WHEN score >= 0.6 THEN 'none' ELSE 'fail' END AS verdict FROM {_ALIGN})"


@registered(f"SELECT board_id, n_drills, touches, {sql_digits('score')}, verdict, CASE WHEN verdict = 'shift' THEN dy ELSE 0 END AS dy, CASE WHEN verdict = 'shift' THEN dx ELSE 0 END AS dx FROM {_AV}")
def alignment_verdict(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    v = audit.audit_alignment(b.shifted, b.runs, b.canvas)
    return v.select("board_id", "n_drills", "touches", *digits("score"), "verdict", "dy", "dx")


# connectivity


@registered("SELECT board_id, layer, component, y, x0, x1 FROM lab")
def labelled_runs(spark, sf_dir):
    return extraction(spark, sf_dir).labelled.select("board_id", "layer", "component", "y", "x0", "x1")


@registered("SELECT board_id, layer, count(*) AS n_components, max(area_px) AS largest_px FROM comp GROUP BY ALL")
def components_by_layer(spark, sf_dir):
    return extraction(spark, sf_dir).components.groupBy("board_id", "layer").agg(F.count("*").alias("n_components"), F.max("area_px").alias("largest_px"))


@registered(f"SELECT board_id, layer, component, area_px, x0, y0, x1, y1, {sql_digits('cx', 'cy')} FROM comp")
def component_stats(spark, sf_dir):
    return extraction(spark, sf_dir).components.select("board_id", "layer", "component", "area_px", "x0", "y0", "x1", "y1", *digits("cx", "cy"))


@registered(f"SELECT board_id, drill, area_px, x0, y0, x1, y1, {sql_digits('radius_px', 'cx', 'cy')} FROM blob")
def drill_stats(spark, sf_dir):
    return extraction(spark, sf_dir).blobs.select("board_id", "drill", "area_px", "x0", "y0", "x1", "y1", *digits("radius_px", "cx", "cy"))


@registered(f"SELECT board_id, {sql_digits('small_px', 'large_px')} FROM limits")
def drill_radius_thresholds(spark, sf_dir):
    return extraction(spark, sf_dir).limits.select("board_id", *digits("small_px", "large_px"))


@registered(f"SELECT board_id, drill, layer, array_to_string(component_ids, ',') AS component_ids, {sql_digits('copper_fraction', 'pad_ring_fraction')}, pad_ring_contact, contact FROM contact")
def drill_contacts(spark, sf_dir):
    c = extraction(spark, sf_dir).contacts
    ids = F.array_join(F.col("component_ids").cast("array<string>"), ",").alias("component_ids")
    return c.select("board_id", "drill", "layer", ids, *digits("copper_fraction", "pad_ring_fraction"), "pad_ring_contact", "contact")


@registered(f"SELECT board_id, drill, layer, {sql_digits('pad_ring_angular_coverage')} FROM contact")
def drill_angular_coverage(spark, sf_dir):
    return extraction(spark, sf_dir).contacts.select("board_id", "drill", "layer", *digits("pad_ring_angular_coverage"))


def _decisions(mode: str):
    def run(spark, sf_dir):
        return extraction(spark, sf_dir, mode).decisions.select("board_id", "drill", *digits("radius_px"), "plated", "classification", "rule")

    run.__name__ = f"drill_classify_{mode}"
    return registered(f"SELECT board_id, drill, {sql_digits('radius_px')}, plated, classification, rule FROM decision_{mode}")(run)


for _mode in ("infer", "explicit", "never"):
    _decisions(_mode)


_SAID = " ".join(f"WHEN rule = {r} AND classification = '{c}' THEN " + (f"printf('{t}', radius_px)" if "%" in t else f"'{t}'") for (r, c), t in drills.REASONS.items())


@registered(f"SELECT board_id, drill, mode, CASE {_SAID} END AS reason FROM ({' UNION ALL '.join(f"SELECT *, '{m}' AS mode FROM decision_{m}" for m in ('infer', 'explicit', 'never'))})")
def drill_reasons(spark, sf_dir):
    """Why each hole is what it is, in every mode of reading the mask."""
    e = extraction(spark, sf_dir)
    said = [drills.classify(e.blobs, e.contacts, e.limits, e.layers, m).select("board_id", "drill", F.lit(m).alias("mode"), drills.reason().alias("reason")) for m in ("infer", "explicit", "never")]
    return said[0].unionByName(said[1]).unionByName(said[2])


@registered("SELECT l.board_id, CASE WHEN plated THEN 'PTH' ELSE 'NPTH' END AS layer, y, x0, x1 FROM dlab l JOIN decision_infer d ON l.board_id = d.board_id AND component = drill")
def drill_split_masks(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return drills.split_masks(e.drill_labelled, e.decisions)


@registered("SELECT board_id, drill, classification, CASE WHEN drill % 3 = 0 THEN drill % 2 = 0 ELSE plated END AS plated, drill % 3 = 0 AS override FROM decision_infer")
def drill_choices_override(spark, sf_dir):
    """Each third hole's decision is overridden by a JSON of choices."""
    d = extraction(spark, sf_dir).decisions
    one = F.struct("drill", (F.col("drill") % 2 == 0).alias("plated"))
    texts = d.where("drill % 3 = 0").groupBy("board_id").agg(F.to_json(F.struct(F.collect_list(one).alias("decisions"))).alias("json"))
    return drills.override(d, files.read_choices(texts)).select("board_id", "drill", "classification", "plated", "override")


@registered("SELECT board_id, layer, component, net FROM net")
def nets_merge(spark, sf_dir):
    return extraction(spark, sf_dir).nets


@registered("SELECT board_id, net, string_agg(layer || ':' || component, ' ' ORDER BY layer, component) AS members FROM net GROUP BY board_id, net HAVING count(*) > 1")
def net_groups(spark, sf_dir):
    g = nets.groups(extraction(spark, sf_dir).nets)
    return g.select("board_id", "net", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["layer"], m["component"])), " ").alias("members"))


@registered("""SELECT c.board_id, coalesce(n, 0)::INT AS n_nets, round(coalesce(most / nullif(total, 0), 0)::DOUBLE, 6) AS largest_net_share,
 CASE WHEN coalesce(n, 0) = 0 THEN 'no nets' WHEN n = 1 THEN 'a single net' WHEN most / total > 0.7 THEN 'one net dominates' ELSE '' END AS warnings FROM canvas c LEFT JOIN
 (SELECT board_id, max(net) AS n, sum(px)::DOUBLE AS total, max(px)::DOUBLE AS most FROM (SELECT board_id, layer, net, sum(area_px) AS px FROM net JOIN comp USING (board_id, layer, component) GROUP BY ALL) GROUP BY board_id) USING (board_id)""")
def net_check(spark, sf_dir):
    c = extraction(spark, sf_dir).check
    return c.select("board_id", "n_nets", *digits("largest_net_share"), F.array_join("warnings", "; ").alias("warnings"))


_EDGES = "(SELECT board_id, drill, classification, coalesce(n, 0)::BIGINT AS n_members, coalesce(net, 0)::INT AS net FROM decision_infer LEFT JOIN (SELECT board_id, drill, count(*) AS n, min(net) AS net FROM member LEFT JOIN net USING (board_id, layer, component) GROUP BY ALL) USING (board_id, drill))"


@registered(f"SELECT * FROM {_EDGES}")
def drill_net_edges(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return nets.drill_edges(e.members, e.nets, e.decisions)


@registered(f"SELECT board_id, drill, n_members, net FROM {_EDGES} ORDER BY n_members DESC, board_id, drill LIMIT 10")
def drill_top10_members(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return nets.drill_edges(e.members, e.nets, e.decisions).select("board_id", "drill", "n_members", "net").orderBy(F.desc("n_members"), "board_id", "drill").limit(10)


_WANT = "(SELECT board_id, net, min(id) AS s, max(id) AS t FROM net JOIN node_n USING (board_id, layer, component) GROUP BY ALL HAVING count(*) > 1)"


@registered(f"""SELECT w.board_id, a.layer || ':' || a.component AS start, b.layer || ':' || b.component AS "end", d::BIGINT AS n_steps FROM
 (WITH RECURSIVE pair AS (SELECT DISTINCT x.id AS u, y.id AS v FROM (SELECT * FROM member JOIN node_n USING (board_id, layer, component)) x JOIN (SELECT * FROM member JOIN node_n USING (board_id, layer, component)) y ON x.board_id = y.board_id AND x.drill = y.drill AND x.id <> y.id),
  want AS (SELECT * FROM {_WANT}),
  walk(s, id, d) USING KEY (s, id) AS (SELECT s, s, 0 FROM want UNION SELECT w.s, p.v, min(w.d) + 1 FROM walk w JOIN pair p ON w.id = p.u LEFT JOIN recurring.walk r ON r.s = w.s AND r.id = p.v WHERE r.id IS NULL GROUP BY w.s, p.v)
  SELECT want.board_id, want.s, want.t, d FROM want JOIN walk ON walk.s = want.s AND walk.id = want.t) w JOIN node_n a ON a.id = w.s JOIN node_n b ON b.id = w.t""")
def explain_paths(spark, sf_dir):
    """Length of the path from the first to the last component of every net."""
    e = extraction(spark, sf_dir)
    node = F.struct("layer", "component")
    name = lambda c: F.concat_ws(":", F.col(f"{c}.layer"), F.col(f"{c}.component"))
    ends = e.nets.groupBy("board_id", "net").agg(F.min(node).alias("a"), F.max(node).alias("b"), F.count("*").alias("n")).where("n > 1")
    steps = nets.explain(e.members, ends.select("board_id", name("a").alias("start"), name("b").alias("end")))
    return steps.groupBy("board_id", "start", "end").agg(F.count("*").alias("n_steps"))


@registered(f"""SELECT w.board_id, a.layer || ':' || a.component AS start, b.layer || ':' || b.component AS "end", i::INT AS step, f.layer || ':' || f.component AS from_node, path[2 * i - 1]::INT AS drill, g.layer || ':' || g.component AS to_node FROM
 (WITH RECURSIVE pair AS (SELECT x.id AS u, y.id AS v, x.drill FROM (SELECT * FROM member JOIN node_n USING (board_id, layer, component)) x JOIN (SELECT * FROM member JOIN node_n USING (board_id, layer, component)) y ON x.board_id = y.board_id AND x.drill = y.drill AND x.id <> y.id),
  want AS (SELECT * FROM {_WANT}),
  walk(s, id, path) USING KEY (s, id) AS (SELECT s, s, []::BIGINT[] FROM want UNION SELECT w.s, p.v, min(list_concat(w.path, [p.drill::BIGINT, p.v])) FROM walk w JOIN pair p ON w.id = p.u LEFT JOIN recurring.walk r ON r.s = w.s AND r.id = p.v WHERE r.id IS NULL GROUP BY w.s, p.v)
  SELECT want.board_id, want.s, want.t, path, unnest(range(1, len(path) // 2 + 1)) AS i FROM want JOIN walk ON walk.s = want.s AND walk.id = want.t) w
 JOIN node_n a ON a.id = w.s JOIN node_n b ON b.id = w.t JOIN node_n f ON f.id = CASE WHEN i = 1 THEN w.s ELSE path[2 * i - 2] END JOIN node_n g ON g.id = path[2 * i]""")
def explain_steps(spark, sf_dir):
    """Every step of those paths: of the shortest ones, the first by holes and
    pieces, which is what a search in order of discovery finds."""
    e = extraction(spark, sf_dir)
    node = F.struct("layer", "component")
    name = lambda c: F.concat_ws(":", F.col(f"{c}.layer"), F.col(f"{c}.component"))
    ends = e.nets.groupBy("board_id", "net").agg(F.min(node).alias("a"), F.max(node).alias("b"), F.count("*").alias("n")).where("n > 1")
    return nets.explain(e.members, ends.select("board_id", name("a").alias("start"), name("b").alias("end")))


# export


@registered("SELECT board_id, net, (net >> 16) & 255 AS r, (net >> 8) & 255 AS g, net & 255 AS b, net AS decoded FROM (SELECT DISTINCT board_id, net FROM net)")
def idmap_codec(spark, sf_dir):
    n = extraction(spark, sf_dir).nets.select("board_id", "net").distinct()
    rgb = n.select("board_id", "net", export.encode_rgb(F.col("net")).alias("c")).select("board_id", "net", "c.*")
    return rgb.withColumn("decoded", export.decode_rgb(F.col("r"), F.col("g"), F.col("b")))


@registered("SELECT board_id, layer, y // 4 AS by, x // 4 AS bx, max(net) AS net FROM (SELECT board_id, layer, y, unnest(range(x0, x1))::INT AS x, net FROM nrun) GROUP BY ALL")
def downsample_block_max(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return export.downsample(e.net_runs, e.canvas, 0.25)


_TILE = f"(SELECT unnest({list(COPPER)}) AS layer, unnest(range({len(COPPER)}))::INT % 2 AS col, unnest(range({len(COPPER)}))::INT // 2 AS \"row\")"


@registered(f'SELECT board_id, layer, col, "row", col * {SIDE // 2} AS x, "row" * {SIDE // 2} AS y, {SIDE // 2} AS w, {SIDE // 2} AS h, {SIDE} AS grid_w, {SIDE // 2 * -(-len(COPPER) // 2)} AS grid_h FROM canvas CROSS JOIN {_TILE}')
def grid_placements(spark, sf_dir):
    """Where each layer lies in a grid of two columns at half size."""
    return export.placements(boards.derive(spark, sf_dir).canvas, COPPER, scale=0.5)


@registered(f'SELECT board_id, (y + "row" * {SIDE}) // 2 AS y, (x + col * {SIDE}) // 2 AS x, max(net) AS net FROM (SELECT board_id, layer, y, unnest(range(x0, x1))::INT AS x, net FROM nrun) JOIN {_TILE} USING (layer) GROUP BY ALL')
def grid_id_map(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return export.id_map(e.net_runs, e.canvas, COPPER, scale=0.5)


_RECTS = "(SELECT board_id, layer, net, x0, min(y)::INT AS y0, x1, (max(y) + 1)::INT AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY board_id, layer, net, x0, x1 ORDER BY y) AS i FROM nrun) GROUP BY board_id, layer, net, x0, x1, i)"


@registered(f"SELECT * FROM {_RECTS}")
def netmap_rects(spark, sf_dir):
    return export.rectangles(extraction(spark, sf_dir).net_runs)


@registered(f"""SELECT board_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {SIDE} {SIDE}" preserveAspectRatio="none">' || chr(10) || '{export.NETMAP_STYLE}' || chr(10) || string_agg('<g data-layer="' || layer || '">' || coalesce(p, '') || chr(10) || '</g>', chr(10) ORDER BY list_position({list(COPPER)}, layer)) || chr(10) || '</svg>' AS svg
 FROM canvas CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in COPPER)}) v(layer) LEFT JOIN (SELECT board_id, layer, string_agg(chr(10) || '<path class="net-shape" data-net-id="' || net || '" data-layer="' || layer || '" d="' || d || '"/>', '' ORDER BY net) AS p FROM
 (SELECT board_id, layer, net, string_agg('M' || x0 || ' ' || y0 || 'H' || x1 || 'V' || y1 || 'H' || x0 || 'Z', '' ORDER BY y0, x0, 'M' || x0 || ' ' || y0 || 'H' || x1) AS d FROM {_RECTS} GROUP BY ALL) GROUP BY ALL) USING (board_id, layer) GROUP BY board_id""")
def netmap_svg(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return export.netmap(export.rectangles(e.net_runs), e.canvas, e.layers)


@registered(f"SELECT board_id, layer, net, x0 >> 1 AS x0, y0 >> 1 AS y0, least({SIDE // 2}, greatest((x0 >> 1) + 1, x1 >> 1)) AS x1, least({SIDE // 2}, greatest((y0 >> 1) + 1, y1 >> 1)) AS y1 FROM {_RECTS}")
def netmap_parse(spark, sf_dir):
    """The exported text, read again at half size."""
    e = extraction(spark, sf_dir)
    return vector.parse_netmap(export.netmap(export.rectangles(e.net_runs), e.canvas, e.layers), shift=1).drop("ord")


def _resized(n: int) -> str:
    at = lambda c: f"floor(({c} + 0.5) * {SIDE} / {n})"
    return f"SELECT board_id, layer, oy AS y, ox AS x, net FROM nrun JOIN (SELECT unnest(range(0, {n}))::INT AS oy) ON {at('oy')} = y JOIN (SELECT unnest(range(0, {n}))::INT AS ox) ON {at('ox')} >= x0 AND {at('ox')} < x1"


_SMALL, _TINY = 96, 40


@registered(_resized(_SMALL))
def resize_nearest(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return export.resize_nearest(e.net_runs, e.canvas, _SMALL, _SMALL)


_AROUND = f"(SELECT unnest(range({-export.REACH}, {export.REACH + 1}))::INT AS "


@registered(f"""FROM (WITH RECURSIVE small AS MATERIALIZED ({_resized(_TINY)}),
lost AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY board_id, layer ORDER BY net) AS k FROM (SELECT board_id, layer, net, least({_TINY - 1}, floor((min(y) + 0.5) * {_TINY} / {SIDE}))::INT AS oy,
  least({_TINY - 1}, floor((arg_min(x0, y * {SIDE} + x0) + 0.5) * {_TINY} / {SIDE}))::INT AS ox FROM nrun GROUP BY ALL) l WHERE NOT EXISTS (FROM small s WHERE s.board_id = l.board_id AND s.layer = l.layer AND s.net = l.net)),
spot AS MATERIALIZED (SELECT board_id, layer, k, list(y * {_TINY} + x ORDER BY greatest(abs(y - oy), abs(x - ox)), y, x) AS free FROM
  (SELECT board_id, layer, k, oy, ox, oy + dy AS y, ox + dx AS x FROM lost CROSS JOIN {_AROUND}dy) CROSS JOIN {_AROUND}dx)) c
  WHERE y BETWEEN 0 AND {_TINY - 1} AND x BETWEEN 0 AND {_TINY - 1} AND NOT EXISTS (FROM small s WHERE s.board_id = c.board_id AND s.layer = c.layer AND s.y = c.y AND s.x = c.x) GROUP BY ALL),
step AS (SELECT board_id, layer, 0::BIGINT AS k, NULL::INT AS net, NULL::INT AS code, []::INT[] AS taken FROM lost WHERE k = 1
 UNION ALL SELECT board_id, layer, k, net, code, list_append(taken, code) FROM (SELECT l.board_id, l.layer, l.k, l.net, taken, coalesce(list_filter(free, lambda c: NOT list_contains(taken, c))[1], l.oy * {_TINY} + l.ox)::INT AS code
  FROM step s JOIN lost l ON l.board_id = s.board_id AND l.layer = s.layer AND l.k = s.k + 1 LEFT JOIN spot f ON f.board_id = l.board_id AND f.layer = l.layer AND f.k = l.k)),
put AS (SELECT board_id, layer, code // {_TINY} AS y, code % {_TINY} AS x, max(net) AS net FROM step WHERE k > 0 GROUP BY ALL)
SELECT board_id, layer, y, x, net FROM put UNION ALL SELECT board_id, layer, y, x, net FROM small s WHERE NOT EXISTS (FROM put p WHERE p.board_id = s.board_id AND p.layer = s.layer AND p.y = s.y AND p.x = s.x))""")
def resize_rescue(spark, sf_dir):
    e = extraction(spark, sf_dir)
    small = export.resize_nearest(e.net_runs, e.canvas, _TINY, _TINY)
    return export.rescue(small, e.net_runs, e.canvas, _TINY, _TINY)


# vectors

_CELL = "SELECT point, gx, gy, net, x - gx AS dx, y - gy AS dy FROM p JOIN (SELECT board_id, layer, y, unnest(range(x0, x1))::INT AS x, net FROM nrun) c ON p.board_id = c.board_id AND p.layer = c.layer AND abs(x - gx) <= 3 AND abs(y - gy) <= 3"


@registered(f"""SELECT p.board_id, p.layer, p.point, coalesce(n.net, 0)::INT AS net FROM (SELECT c_nationkey::INT AS board_id, 'F_Cu' AS layer, c_custkey::INT AS point, (c_custkey * 29 % {SIDE})::INT AS gx, (c_custkey * 31 % {SIDE})::INT AS gy FROM customer) p LEFT JOIN
 (SELECT point, arg_min(net, [dx * dx + dy * dy, least(CASE WHEN dy = -r THEN (dx + r) * 4 END, CASE WHEN dy = r THEN (dx + r) * 4 + 1 END, CASE WHEN dx = -r THEN (dy + r) * 4 + 2 END, CASE WHEN dx = r THEN (dy + r) * 4 + 3 END)]) AS net FROM (SELECT *, greatest(abs(dx), abs(dy)) AS r FROM
 (WITH p AS (SELECT c_nationkey::INT AS board_id, 'F_Cu' AS layer, c_custkey::INT AS point, (c_custkey * 29 % {SIDE})::INT AS gx, (c_custkey * 31 % {SIDE})::INT AS gy FROM customer) {_CELL})) GROUP BY point) n USING (point)""")
def nearest_label(spark, sf_dir):
    e = extraction(spark, sf_dir)
    k = F.col("c_custkey").cast("int")
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("int").alias("board_id"), F.lit("F_Cu").alias("layer"), k.alias("point"), (k * 29 % SIDE).alias("gx"), (k * 31 % SIDE).alias("gy"))
    return vector.nearest_label(points, e.net_runs, e.canvas)


@registered("SELECT n.board_id, n.layer, count(*) AS n_segments, count(*) FILTER (net > 0) AS n_attributed FROM (SELECT c_nationkey::INT AS board_id, c_custkey::INT AS k, [" + ", ".join(f"'{x}'" for x in COPPER) + "][c_custkey % 3 + 1] AS layer FROM customer) r JOIN LATERAL (SELECT r.board_id, r.layer, (SELECT max(net) FROM nrun c WHERE c.board_id = r.board_id AND c.layer = r.layer AND c.y = r.k * 53 % 240 + (4 + r.k % 7) // 2 AND c.x0 <= r.k * 37 % 240 + (4 + r.k % 13) // 2 AND c.x1 > r.k * 37 % 240 + (4 + r.k % 13) // 2) AS net) n ON true GROUP BY ALL")
def attribute_segments(spark, sf_dir):
    """Each rectangle's middle line, attributed to the net it lies on."""
    e = extraction(spark, sf_dir)
    k = F.col("c_custkey").cast("int")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("int").alias("board_id"), k.alias("seg"), F.get(F.array(*map(F.lit, COPPER)), k % 3).alias("layer"))
    s = F.col("seg")
    y = s * 53 % 240 + F.floor((4 + s % 7) / 2)
    seg = c.select("board_id", "layer", "seg", F.lit(1).alias("polarity"), (s * 37 % 240).alias("x1"), y.alias("y1"), (s * 37 % 240 + 4 + s % 13).alias("x2"), y.alias("y2"))
    return vector.attribute_segments(seg, e.net_runs, e.canvas).groupBy("board_id", "layer").agg(F.count("*").alias("n_segments"), F.count_if(F.col("net") > 0).alias("n_attributed"))


@registered("SELECT c_nationkey::INT AS board_id, c_custkey::INT AS path_id, 0 AS part, true AS closed, (2 * (4 + c_custkey % 13) + 2 * (4 + c_custkey % 7))::DOUBLE AS length FROM customer")
def svg_path_flatten(spark, sf_dir):
    """Each rectangle as path data in relative commands, flattened again."""
    k = F.col("c_custkey").cast("int")
    w, h = 4 + k % 13, 4 + k % 7
    d = F.format_string("m%d,%dh%dv%dl-%d 0z", k * 37 % 240, k * 53 % 240, w, h, w)
    paths = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("int").alias("board_id"), k.alias("path_id"), d.alias("d"))
    return vector.flatten(paths).select("board_id", "path_id", "part", "closed", *digits("length"))


# drawings

_W, _H = "(4 + k % 13)", "(4 + k % 7)"
_DRAWN = f"""(SELECT board_id, row_number() OVER (PARTITION BY board_id ORDER BY hole, k)::INT AS el, hole, k % 4 AS shape, x, y, {_W} AS w, {_H} AS h, r FROM
 (SELECT c_nationkey::INT AS board_id, 0 AS hole, c_custkey::INT AS k, (c_custkey * 37 % 240)::INT AS x, (c_custkey * 53 % 240)::INT AS y, 0 AS r FROM customer UNION ALL
  SELECT s_nationkey::INT, 1, s_suppkey::INT, (20 + s_suppkey * 41 % 216)::INT, (20 + s_suppkey * 59 % 216)::INT, (3 + s_suppkey % 4)::INT FROM supplier))"""


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing of every board over a dark background: customers as rectangles,
    strokes, paths or areas of an unknown colour, then suppliers' holes."""
    read = lambda name, key: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(f"{key[0]}_nationkey").cast("int").alias("board_id"), F.col(key).cast("int").alias("k"))
    k = F.col("k")
    x, y, w, h = k * 37 % 240, k * 53 % 240, 4 + k % 13, 4 + k % 7
    rect = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" fill="#ffffff"/>', x, y, w, h)
    line = F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="white" stroke-width="%d"/>', x, y, x + w, y, h)
    path = F.format_string('<path d="m%d,%dh%dv%dh-%dz" fill="#fefefe"/>', x, y, w, h, w)
    other = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" fill="teal"/>', x, y, w, h)
    shape = F.when(k % 4 == 0, rect).when(k % 4 == 1, line).when(k % 4 == 2, path).otherwise(other)
    hole = F.format_string('<circle cx="%d" cy="%d" r="%d" fill="#010101"/>', 20 + k * 41 % 216, 20 + k * 59 % 216, 3 + k % 4)
    one = read("customer", "c_custkey").select("board_id", F.struct(F.lit(0), k, shape.alias("t")).alias("e")).unionByName(read("supplier", "s_suppkey").select("board_id", F.struct(F.lit(0) + 1, k, hole.alias("t")).alias("e")))
    body = one.groupBy("board_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["t"]), "").alias("body"))
    head = f'<svg viewBox="0 0 {SIDE} {SIDE}"><mask><rect x="0" y="0" width="{SIDE}" height="{SIDE}" fill="#000000"/>'
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("board_id"))
    return nation.join(body, "board_id", "left").select("board_id", F.lit("F_Cu").alias("layer"), F.concat(F.lit(head), F.coalesce("body", F.lit("")), F.lit("</mask></svg>")).alias("svg"))


def _subpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(artwork.subpaths(artwork.elements(artwork.documents(drawings(spark, sf_dir)))), "subpaths")


@registered(f"""SELECT board_id, el, CASE WHEN hole = 1 THEN 'dot' WHEN shape = 1 THEN 'seg' ELSE 'tri' END AS kind, CASE WHEN hole = 1 THEN -1 ELSE 1 END AS polarity, CASE WHEN hole = 1 OR shape = 1 THEN 1 ELSE 4 END::BIGINT AS n,
 CASE WHEN hole = 1 THEN x - r WHEN shape = 1 THEN x - h / 2::DOUBLE ELSE x END::DOUBLE AS x0, CASE WHEN hole = 1 THEN y - r WHEN shape = 1 THEN y - h / 2::DOUBLE ELSE y END::DOUBLE AS y0,
 CASE WHEN hole = 1 THEN x + r WHEN shape = 1 THEN x + w + h / 2::DOUBLE ELSE x + w END::DOUBLE AS x1, CASE WHEN hole = 1 THEN y + r WHEN shape = 1 THEN y + h / 2::DOUBLE ELSE y + h END::DOUBLE AS y1,
 CASE WHEN hole = 0 AND shape <> 1 THEN w * h ELSE 0 END::DOUBLE AS area FROM {_DRAWN} WHERE hole = 1 OR shape <> 3""")
def artwork_primitives(spark, sf_dir):
    """Every element's primitives: how many, their bounds, and the triangles' area."""
    p = artwork.bounds(artwork.primitives(_subpaths(spark, sf_dir)))
    c = lambda i: F.get("coords", F.lit(i))
    cross = (c(2) - c(0)) * (c(5) - c(1)) - (c(4) - c(0)) * (c(3) - c(1))
    g = p.groupBy("board_id", F.floor(F.col("ord") / 2).cast("int").alias("el"), "kind", "polarity").agg(
        F.count("*").alias("n"), *(f(F.round(x, 6)).alias(x) for f, x in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
        F.round(F.sum(F.when(F.col("kind") == "tri", cross / 2).otherwise(0.0)), 6).alias("area"),
    )
    return g


@registered(f"""SELECT board_id, run::INT AS run, min(polarity) AS polarity, count(*) FILTER (hole = 1 OR shape = 1) AS caps, (4 * count(*) FILTER (hole = 0 AND shape <> 1))::BIGINT AS tris FROM
 (SELECT *, hole + 1 - min(hole) OVER (PARTITION BY board_id) AS run, CASE WHEN hole = 1 THEN -1 ELSE 1 END AS polarity FROM {_DRAWN} WHERE hole = 1 OR shape <> 3) GROUP BY board_id, run""")
def artwork_runs(spark, sf_dir):
    """Consecutive primitives of one polarity: copper, then holes."""
    return artwork.polarity_runs(artwork.primitives(_subpaths(spark, sf_dir))).select("board_id", "run", "polarity", "caps", "tris")


@registered(f"""SELECT board_id, (1 + coalesce(n, 0))::BIGINT AS elements, 1::BIGINT AS backgrounds, coalesce(u, 0)::BIGINT AS unknown, coalesce(s, 0)::BIGINT AS segs, coalesce(d, 0)::BIGINT AS dots, coalesce(4 * t, 0)::BIGINT AS tris FROM canvas LEFT JOIN
 (SELECT board_id, count(*) AS n, count(*) FILTER (hole = 0 AND shape = 3) AS u, count(*) FILTER (hole = 0 AND shape = 1) AS s, count(*) FILTER (hole = 1) AS d, count(*) FILTER (hole = 0 AND shape IN (0, 2)) AS t FROM {_DRAWN} GROUP BY board_id) USING (board_id)""")
def artwork_stats(spark, sf_dir):
    docs = stored(artwork.documents(drawings(spark, sf_dir)), "documents")
    els = stored(artwork.elements(docs), "elements")
    return artwork.stats(docs, els, artwork.primitives(artwork.subpaths(els))).drop("layer")


_PX = f"""(SELECT board_id, px, py, arg_max(hole, el) AS top FROM (SELECT *, unnest(range(greatest(0, y - greatest(h, r) - 1), least({SIDE}, y + greatest(h, r) + 2)))::INT AS py FROM
 (SELECT *, unnest(range(greatest(0, x - h - r - 1), least({SIDE}, x + w + h + r + 2)))::INT AS px FROM {_DRAWN} WHERE hole = 1 OR shape <> 3)) WHERE CASE
 WHEN hole = 1 THEN (px + 0.5::DOUBLE - x) ** 2 + (py + 0.5::DOUBLE - y) ** 2 <= r * r WHEN shape = 1 THEN greatest(0, x - px - 0.5::DOUBLE, px + 0.5::DOUBLE - x - w) ** 2 + (py + 0.5::DOUBLE - y) ** 2 <= h * h / 4::DOUBLE
 ELSE px >= x AND px < x + w AND py >= y AND py < y + h END GROUP BY ALL)"""


@registered(boards.merge_sql(f"(SELECT board_id, 'F_Cu' AS layer, py AS y, px AS x0, px + 1 AS x1 FROM {_PX} WHERE top = 0)"))
def artwork_mask(spark, sf_dir):
    """The drawings' pixels as runs."""
    return paint.rasterise(drawings(spark, sf_dir))


_PAINTED = boards.merge_sql(f"(SELECT board_id, 'F_Cu' AS layer, py AS y, px AS x0, px + 1 AS x1 FROM {_PX} WHERE top = 0)")
_MID = "CASE WHEN dy = -r THEN (dx + r) * 4 END, CASE WHEN dy = r THEN (dx + r) * 4 + 1 END, CASE WHEN dx = -r THEN (dy + r) * 4 + 2 END, CASE WHEN dx = r THEN (dy + r) * 4 + 3 END"


@registered(f""", amask AS ({_PAINTED}),
{sql.labels("alab", "amask")},
shown AS (SELECT * FROM {_DRAWN} WHERE hole = 1 OR shape <> 3),
apt AS (SELECT board_id, el, j, least({SIDE - 1}, floor(px))::INT AS gx, least({SIDE - 1}, floor(py))::INT AS gy FROM (SELECT board_id, el, unnest(CASE WHEN shape = 1 THEN [0, 1, 2] ELSE [0] END) AS j,
  unnest(CASE WHEN shape = 1 THEN [x + w / 2::DOUBLE, x, x + w] ELSE [x + w / 2::DOUBLE] END) AS px, CASE WHEN shape = 1 THEN y ELSE y + h / 2::DOUBLE END AS py FROM shown WHERE hole = 0)),
acell AS (SELECT p.board_id, el, j, component AS net, x - gx AS dx, c.y - gy AS dy FROM apt p JOIN (SELECT board_id, y, unnest(range(x0, x1))::INT AS x, component FROM alab) c ON p.board_id = c.board_id AND abs(x - gx) <= 3 AND abs(c.y - gy) <= 3),
ahit AS (SELECT board_id, el, j, arg_min(net, [dx * dx + dy * dy, least({_MID})]) AS net FROM (SELECT *, greatest(abs(dx), abs(dy)) AS r FROM acell) GROUP BY board_id, el, j),
anet AS (SELECT board_id, el, arg_min(net, j) AS net FROM ahit GROUP BY board_id, el),
abox AS (SELECT board_id, el, hole, shape, CASE WHEN hole = 1 THEN x - r WHEN shape = 1 THEN x - h / 2::DOUBLE ELSE x END AS x0, CASE WHEN hole = 1 THEN y - r WHEN shape = 1 THEN y - h / 2::DOUBLE ELSE y END AS y0,
  CASE WHEN hole = 1 THEN x + r WHEN shape = 1 THEN x + w + h / 2::DOUBLE ELSE x + w END AS x1, CASE WHEN hole = 1 THEN y + r WHEN shape = 1 THEN y + h / 2::DOUBLE ELSE y + h END AS y1 FROM shown),
aown AS (SELECT * FROM anet JOIN abox USING (board_id, el))
SELECT board_id, net, el, 1 AS polarity, CASE WHEN shape = 1 THEN 1 ELSE 4 END::BIGINT AS n FROM aown UNION ALL
SELECT DISTINCT a.board_id, a.net, e.el, -1, 1::BIGINT FROM aown a JOIN abox e ON a.board_id = e.board_id AND e.hole = 1 AND a.el < e.el AND a.x0 < e.x1 AND e.x0 < a.x1 AND a.y0 < e.y1 AND e.y0 < a.y1""")
def net_geometry(spark, sf_dir):
    """What draws each net of the drawings: its elements and the holes in them."""
    subs = _subpaths(spark, sf_dir)
    canvas = boards.derive(spark, sf_dir).canvas
    net = components.label(paint.paint(paint.spans(subs))).withColumnRenamed("component", "net")
    shown = geometry.by_net(stored(geometry.attributed(subs, stored(net, "nets"), canvas), "primitives"), canvas)
    return shown.groupBy("board_id", "net", F.floor(F.col("ord") / 2).cast("int").alias("el"), "polarity").agg(F.count("*").alias("n"))


@registered(boards.complement_sql(f"({_PAINTED})", "(SELECT *, 'F_Cu' AS layer FROM canvas)"))
def drawing_inverted(spark, sf_dir):
    """Pixels of the drawings rewritten as masks with all layers turned round."""
    svgs = drawings(spark, sf_dir)
    turned = stored(drawing.luminance(svgs, svgs.select("board_id", "layer")), "turned")
    return paint.paint(paint.spans(stored(artwork.subpaths(artwork.elements(artwork.documents(turned))), "subpaths")))


@registered("SELECT c.board_id, coalesce(p, 0)::BIGINT AS plated, coalesce(u, 0)::BIGINT AS unplated FROM canvas c LEFT JOIN (SELECT board_id, count(*) FILTER (plated) AS p, count(*) FILTER (NOT plated) AS u FROM decision_infer GROUP BY board_id) USING (board_id)")
def plated_counts(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return jobs.plated_counts(e.decisions, e.canvas)


@registered("SELECT board_id, 'holes' AS layer, y, x0, x1 FROM drill WHERE board_id % 2 = 0 UNION ALL SELECT board_id, 'holes', y, x0, x1 FROM shifted WHERE board_id % 2 = 1")
def visual_drill(spark, sf_dir):
    """Holes to show: even boards have one mask for both uses, odd ones two."""
    b = boards.derive(spark, sf_dir)
    names = b.canvas.select("board_id", F.lit("drill").alias("drill_name"), F.when(F.col("board_id") % 2 == 0, "drill").otherwise("via").alias("via_name"))
    still = b.canvas.select("board_id", F.lit(0).alias("dy"), F.lit(0).alias("dx"))
    return masks.visual_drill(b.shifted, b.drill, names, still, b.canvas)


# names and files

#: File names of four families of tools, by board.
FAMILIES = (
    ("proj-F_Cu.gbr", "proj-In1_Cu.gbr", "proj-In2.Cu.gbr", "proj-B_Cu.gbr", "proj-F_SilkS.gbr", "proj-B.Mask.gbr", "proj-Edge_Cuts.gm1", "proj-PTH.drl", "proj-NPTH.drl", "readme.md"),
    ("b.gtl", "b.g1", "b.gp2", "b.gbl", "b.gto", "b.gbs", "b.gko", "b.drl", "b.txt"),
    ("a.cmp", "a.ly2", "a.ly3", "a.sol", "a.plc", "a.sts", "a.drd", "a_via.ncd", "a.dri", "a.gpi"),
    ("x-F_Cu.gbl", "x.gtl", "x.gbl", "x-VIAS.xln", "X-PTH.nc"),
)
_FILES = {"files": "['" + "'], ['".join("', '".join(f) for f in FAMILIES) + "']", "families": len(FAMILIES)}
_CASES = " ".join(f"WHEN ext = '{e}' THEN '{n}'" for e, n in catalog.BY_EXTENSION.items())
_STEMS = " ".join(f"WHEN regexp_matches(part, '(?i)^{rx}') THEN '{n}'" for n, rx in catalog.BY_STEM.items())
_DETECT = f"""(SELECT board_id, canonical, min(filename) AS filename FROM (SELECT *, CASE
 WHEN ext IN {catalog.DRILL_EXTENSIONS} THEN CASE WHEN regexp_matches(stem, '(?i)(^|[-_])VIAS?$') THEN 'via' WHEN regexp_matches(stem, '(?i)(^|[-_])PTH$') THEN 'PTH' WHEN regexp_matches(stem, '(?i)(^|[-_])NPTH$') THEN 'NPTH' ELSE 'drill' END
 WHEN NOT (ext IN {(*catalog.BY_EXTENSION, *catalog.OTHER_EXTENSIONS)} OR regexp_matches(ext, '^(gp?|ly)[0-9]+$')) THEN NULL
 WHEN regexp_matches(part, '(?i)^In[0-9]+[._]Cu$') THEN 'In' || regexp_extract(part, '[0-9]+')::INT || '_Cu' {_STEMS}
 WHEN regexp_matches(ext, '^gp?[0-9]+$') THEN 'In' || regexp_extract(ext, '[0-9]+')::INT || '_Cu' WHEN regexp_matches(ext, '^ly[0-9]+$') THEN 'In' || (regexp_extract(ext, '[0-9]+')::INT - 1) || '_Cu' {_CASES} END AS canonical
 FROM (SELECT *, regexp_extract(stem, '([^-]*)$', 1) AS part FROM (SELECT *, lower(regexp_extract(filename, '^.+\\.([^.]*)$', 1)) AS ext, regexp_extract(filename, '^(.+)\\.[^.]*$', 1) AS stem FROM files))) WHERE canonical IS NOT NULL GROUP BY board_id, canonical)"""


def board_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("board_id"))
    names = F.array(*(F.array(*map(F.lit, f)) for f in FAMILIES))
    return n.select("board_id", F.explode(F.get(names, F.col("board_id") % len(FAMILIES))).alias("filename"))


@registered(f"SELECT * FROM {_DETECT}", **_FILES)
def layer_detect(spark, sf_dir):
    return catalog.detect_layers(board_files(spark, sf_dir))


@registered(f"""SELECT board_id, canonical AS layer, (row_number() OVER (PARTITION BY board_id ORDER BY CASE canonical WHEN 'F_Cu' THEN 0 WHEN 'B_Cu' THEN 1000 ELSE regexp_extract(canonical, '[0-9]+')::INT END) - 1)::INT AS layer_ord
 FROM {_DETECT} WHERE regexp_matches(canonical, '^(F_Cu|B_Cu|In[0-9]+_Cu)$') AND board_id IN (SELECT board_id FROM {_DETECT} WHERE canonical IN ('F_Cu', 'B_Cu') GROUP BY board_id HAVING count(*) = 2)""", **_FILES)
def layer_resolution(spark, sf_dir):
    got = catalog.detect_layers(board_files(spark, sf_dir)).select("board_id", F.col("canonical").alias("name"))
    return catalog.resolve_layers(got)


@registered(f"""SELECT board_id, coalesce(max(name) FILTER (k = 1), max(name) FILTER (k = 2), max(name) FILTER (k = 3), 'via') AS name, CASE WHEN bool_or(k = 1) AND bool_or(k = 3) AND NOT bool_or(k = 2) THEN 'infer' WHEN bool_or(k IN (1, 2)) THEN 'explicit' ELSE 'infer' END AS mode
 FROM (SELECT board_id, canonical AS name, list_position(['via', 'PTH', 'drill'], canonical) AS k FROM {_DETECT}) GROUP BY board_id""", **_FILES)
def connector_resolution(spark, sf_dir):
    """Which mask connects layers and how it is read; all masks equal here."""
    got = catalog.detect_layers(board_files(spark, sf_dir)).select("board_id", F.col("canonical").alias("name"))
    return catalog.connector_mode(got.withColumn("sha", F.sha2(F.lit("same"), 256)), catalog.via_name(got))


@registered(f"SELECT board_id, canonical AS layer FROM {_DETECT} WHERE canonical IN ('F_Cu', 'B_Cu') AND board_id IN (SELECT board_id FROM {_DETECT} WHERE canonical IN ('F_Cu', 'B_Cu') GROUP BY board_id HAVING count(*) = 2)", **_FILES)
def outer_layers(spark, sf_dir):
    """Outer layers that a build takes when none are named."""
    got = catalog.detect_layers(board_files(spark, sf_dir)).select("board_id", F.col("canonical").alias("name"))
    return catalog.default_outer(catalog.resolve_layers(got))


@registered(f"SELECT board_id, coalesce(max(name) FILTER (k = 1), max(name) FILTER (k = 2), max(name) FILTER (k = 3), 'drill') AS name FROM (SELECT board_id, canonical AS name, list_position(['drill', 'PTH', 'via'], canonical) AS k FROM {_DETECT}) GROUP BY board_id", **_FILES)
def drill_resolution(spark, sf_dir):
    got = catalog.detect_layers(board_files(spark, sf_dir)).select("board_id", F.col("canonical").alias("name"))
    return catalog.drill_name(got)


@registered(f"""SELECT * FROM (WITH h AS (SELECT board_id, canonical AS name, canonical AS mask FROM {_DETECT} WHERE canonical IN ('via', 'PTH', 'drill', 'NPTH')),
 extra AS (SELECT board_id, unnest(CASE WHEN bool_or(name = 'PTH') THEN ['via', 'drill'] WHEN bool_or(name = 'via') THEN ['drill'] ELSE [] END) AS name, CASE WHEN bool_or(name = 'PTH') THEN 'PTH' ELSE 'via' END AS mask FROM h GROUP BY board_id)
 SELECT * FROM h UNION ALL SELECT * FROM extra ANTI JOIN h USING (board_id, name))""", **_FILES)
def drill_aliases(spark, sf_dir):
    """Hole masks by name, and the mask that stands in for a name."""
    got = catalog.detect_layers(board_files(spark, sf_dir)).select("board_id", F.col("canonical").alias("name"), F.col("canonical").alias("mask"))
    return catalog.with_aliases(got.where("name IN ('via', 'PTH', 'drill', 'NPTH')"))


@registered(f"SELECT board_id, CASE canonical WHEN 'F_Cu' THEN 'F_Mask' ELSE 'B_Mask' END AS mask, canonical AS copper FROM {_DETECT} WHERE canonical IN ('F_Cu', 'B_Cu')", **_FILES)
def mask_pairs(spark, sf_dir):
    got = catalog.detect_layers(board_files(spark, sf_dir)).select("board_id", F.col("canonical").alias("name"))
    return catalog.mask_pairs(got)


def drill_files(holes: DataFrame) -> DataFrame:
    """(board_id, text): a drill file with a hit for every hole, in their order."""
    line = F.struct("drill", F.format_string("X%dY%d", "x0", "y0").alias("hit"))
    hits = holes.groupBy("board_id").agg(F.sort_array(F.collect_list(line)).alias("hits"))
    return hits.select("board_id", F.concat(F.lit("M48\nT01C0.800\n%\nT01\n"), F.array_join(F.transform("hits", lambda h: h["hit"]), "\n"), F.lit("\nM30\n")).alias("text"))


@registered("SELECT board_id, (drill - 1)::INT AS object_index, 1 AS tool, 0.8::DOUBLE AS diameter, x0::DOUBLE AS x, y0::DOUBLE AS y FROM blob")
def excellon_read(spark, sf_dir):
    """A drill file of every board's holes, written as text and read."""
    d = drills.blobs(components.label(boards.derive(spark, sf_dir).drill))
    return files.read_excellon(drill_files(d))


@registered("SELECT board_id, (10000 - drill)::INT AS object_index, plated FROM decision_infer")
def object_choices(spark, sf_dir):
    """Decisions by the object of the drill file that each hole came from."""
    e = extraction(spark, sf_dir)
    return files.object_decisions(excellon_assignment(spark, sf_dir), e.decisions)


@registered("""SELECT board_id, before, after, gain, gain >= 0.1 AS accepted FROM (SELECT board_id, coalesce(b, 0)::BIGINT AS before, coalesce(a, 0)::BIGINT AS after, (coalesce(a, 0) - coalesce(b, 0)) / greatest(coalesce(b, 0), 1)::DOUBLE AS gain FROM canvas
 LEFT JOIN (SELECT s.board_id, sum(least(s.x1, d.x1) - greatest(s.x0, d.x0)) AS b FROM shifted s JOIN drill d ON s.board_id = d.board_id AND s.y = d.y AND s.x0 < d.x1 AND d.x0 < s.x1 GROUP BY s.board_id) USING (board_id)
 LEFT JOIN (SELECT board_id, sum(x1 - x0) AS a FROM drill GROUP BY board_id) USING (board_id))""")
def solder_mask_gain(spark, sf_dir):
    """What a displaced mask gains over the pads when it is moved back."""
    b = boards.derive(spark, sf_dir)
    return audit.mask_gain(b.shifted, b.drill, b.drill, b.canvas)


_OVER = "(SELECT m.board_id, sum(least(m.x1, o.x1) - greatest(m.x0, o.x0)) AS px FROM {} m JOIN outer_run o ON m.board_id = o.board_id AND m.y = o.y AND m.x0 < o.x1 AND o.x0 < m.x1 GROUP BY m.board_id)"


@registered(f"""SELECT board_id, 'F_Mask' AS layer, 'F_Cu' AS reference, dy, dx, b AS before, a AS after, gain, gain >= 0.1 AND (dy <> 0 OR dx <> 0) AS accepted FROM (SELECT board_id, dy, dx, coalesce(b.px, 0)::BIGINT AS b, coalesce(a.px, 0)::BIGINT AS a,
 (coalesce(a.px, 0) - coalesce(b.px, 0)) / greatest(coalesce(b.px, 0), 1)::DOUBLE AS gain FROM offs LEFT JOIN {_OVER.format("shifted")} b USING (board_id) LEFT JOIN {_OVER.format("moved")} a USING (board_id))""")
def mask_displacements(spark, sf_dir):
    """Openings of the boards whose holes miss their copper, laid over it again."""
    b = boards.derive(spark, sf_dir)
    copper = audit.outer_copper(b.runs)
    poor = audit.alignment_score(b.shifted, copper, b.canvas).where("score < 0.9 AND n_drills > 0").select("board_id")
    openings = b.shifted.join(poor, "board_id", "left_semi").withColumn("layer", F.lit("F_Mask"))
    pairs = b.canvas.select("board_id", F.lit("F_Mask").alias("mask"), F.lit("F_Cu").alias("copper"))
    return audit.mask_alignment(openings, copper.withColumn("layer", F.lit("F_Cu")), b.canvas, pairs)


@registered("""SELECT board_id, layer, 'M48' || chr(10) || 'T01C0.800' || chr(10) || '%' || chr(10) || 'T01' || chr(10) || coalesce(hits, '') || 'M30' || chr(10) AS text FROM (SELECT DISTINCT board_id FROM blob) CROSS JOIN (VALUES ('PTH', true), ('NPTH', false)) v(layer, plated)
 LEFT JOIN (SELECT board_id, plated, string_agg('X' || x0 || 'Y' || y0 || chr(10), '' ORDER BY drill) AS hits FROM blob JOIN (SELECT board_id, drill, plated FROM decision_infer) USING (board_id, drill) GROUP BY ALL) USING (board_id, plated)""")
def excellon_split(spark, sf_dir):
    """Every board's drill file, split by what its masks say."""
    e = extraction(spark, sf_dir)
    decided = e.decisions.select("board_id", (F.col("drill") - 1).alias("object_index"), "plated")
    return files.split_excellon(drill_files(e.blobs), decided)


@registered("SELECT board_id, drill, (10000 - drill)::INT AS object_index FROM blob")
def excellon_assignment(spark, sf_dir):
    """Drilled areas against the holes they came from, y upwards, shuffled."""
    b = boards.derive(spark, sf_dir)
    d = drills.blobs(components.label(b.drill))
    objects = d.select("board_id", (F.lit(10_000) - F.col("drill")).alias("object_index"), (F.col("cx") * 0.1).alias("x"), ((SIDE - F.col("cy")) * 0.1).alias("y"))
    return files.match_objects(d, objects)


@registered("SELECT c.board_id, 'board ' || c.board_id AS title, coalesce(n, 0)::INT AS n_nets, coalesce(k, 0)::BIGINT AS n_components FROM canvas c LEFT JOIN (SELECT board_id, max(net) AS n, count(*) AS k FROM net GROUP BY board_id) USING (board_id)")
def gallery_index(spark, sf_dir):
    """Build metadata as JSON, read again as a gallery."""
    e = extraction(spark, sf_dir)
    n = e.nets.groupBy("board_id").agg(F.max("net").alias("n"), F.count("*").alias("k"))
    meta = e.canvas.join(n, "board_id", "left").select("board_id", F.to_json(F.struct(F.format_string("board %d", "board_id").alias("title"), F.struct(F.coalesce("n", F.lit(0)).alias("nets"), F.coalesce("k", F.lit(0)).alias("components")).alias("counts"))).alias("json"))
    m = F.from_json("json", "title string, counts struct<nets:int,components:bigint>")
    return meta.select("board_id", m["title"].alias("title"), m["counts"]["nets"].alias("n_nets"), m["counts"]["components"].alias("n_components"))


@registered("SELECT board_id, layer, y, x0, x1, component FROM lab")
def labelled_by_strips(spark, sf_dir):
    return components.label_distributed(boards.derive(spark, sf_dir).copper, strip=40)


@registered("SELECT board_id, count(*) AS rects, count(DISTINCT (layer, net)) AS paths, 0::BIGINT AS odd_paths, max(net) AS max_net FROM (SELECT *, x0 - lag(x1) OVER w AS gap, y FROM nrun WINDOW w AS (PARTITION BY board_id, layer, y ORDER BY x0)) r WHERE NOT EXISTS (SELECT 1 FROM nrun q WHERE q.board_id = r.board_id AND q.layer = r.layer AND q.net = r.net AND q.x0 = r.x0 AND q.x1 = r.x1 AND q.y = r.y - 1) GROUP BY board_id")
def netmap_stats(spark, sf_dir):
    """What reading the netmaps back finds: a path a net and layer, a rectangle
    for runs alike on consecutive rows."""
    e = extraction(spark, sf_dir)
    return netmap.netmap_stats(export.netmap(export.rectangles(e.net_runs), e.canvas, e.layers)).where("paths > 0")


_HELD = """(SELECT board_id, layer, y, x0, x1 FROM run UNION ALL SELECT board_id, 'drill', y, x0, x1 FROM drill UNION ALL SELECT board_id, 'via', y, x0, x1 FROM drill WHERE board_id % 3 = 0
 UNION ALL SELECT board_id, 'via', y, x0, x1 FROM shifted WHERE board_id % 3 = 1 UNION ALL SELECT board_id, 'PTH', y, x0, x1 FROM drill WHERE board_id % 4 = 0)"""


@registered(f"""SELECT board_id, layers, CASE WHEN via IS NOT NULL THEN 'via' WHEN pth IS NOT NULL THEN 'PTH' ELSE 'drill' END AS via,
 CASE WHEN via IS NOT NULL AND via = drill AND pth IS NULL THEN 'infer' WHEN via IS NOT NULL OR pth IS NOT NULL THEN 'explicit' ELSE 'infer' END AS mode FROM (SELECT board_id,
 string_agg(layer, ',' ORDER BY CASE layer WHEN 'F_Cu' THEN 0 WHEN 'B_Cu' THEN 9 ELSE TRY_CAST(substr(layer, 3, 1) AS INT) END) FILTER (layer LIKE '%Cu') AS layers, count(*) FILTER (layer IN ('F_Cu', 'B_Cu')) AS outer_layers,
 max(held) FILTER (layer = 'via') AS via, max(held) FILTER (layer = 'drill') AS drill, max(held) FILTER (layer = 'PTH') AS pth
 FROM (SELECT board_id, layer, string_agg(y || ':' || x0 || '-' || x1, ';' ORDER BY y, x0) AS held FROM {_HELD} GROUP BY ALL) GROUP BY board_id) WHERE outer_layers = 2 AND coalesce(via, pth, drill) IS NOT NULL""")
def board_plans(spark, sf_dir):
    """Stack, connecting mask and mode from boards' masks: a third have a via mask
    like the drill mask, a third another one, a quarter a PTH mask."""
    b = boards.derive(spark, sf_dir)
    named = lambda df, name, rule="true": df.where(rule).withColumn("layer", F.lit(name)).select(*b.runs.columns)
    every = b.runs.unionByName(named(b.drill, "drill")).unionByName(named(b.drill, "via", "board_id % 3 = 0")).unionByName(named(b.shifted, "via", "board_id % 3 = 1")).unionByName(named(b.drill, "PTH", "board_id % 4 = 0"))
    return jobs.board_plans(stored(mask_digests(every), "digests")).withColumn("layers", F.array_join("layers", ","))


# kept results


@registered(digest_sql(settings(COPPER, "infer"), "SELECT * FROM copper UNION ALL SELECT * FROM drill").replace("WITH spans", ", spans", 1))
def mask_content_digests(spark, sf_dir):
    b = boards.derive(spark, sf_dir)
    cols = ["board_id", "layer", "y", "x0", "x1"]
    return board_digests(b.copper.select(*cols).unionByName(b.drill.select(*cols)), b.canvas, settings(COPPER, "infer"))


@registered("SELECT board_id, layer, component, net FROM net")
def nets_incremental(spark, sf_dir):
    """An earlier run kept the first boards; a run over all of them labels the rest."""
    b = boards.derive(spark, sf_dir)
    kept = NetCache(spark, new_path(spark, "cache"))
    first = "board_id < 12"
    kept.extract(b.copper.where(first), b.drill.where(first), b.canvas.where(first), COPPER)
    return kept.extract(b.copper, b.drill, b.canvas, COPPER)[0].nets
