import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_connectivity import RUN, ellipse, extract, rect

from netloom.operators import audit, drills, export, masks
from netloom.plans import jobs


def table(spark, rows):
    return masks.merge_runs(spark.createDataFrame(rows, RUN))


@pytest.fixture(scope="module")
def canvas(spark):
    return spark.createDataFrame([(1, 200, 100)], "board_id int, w int, h int")


def test_polarity(spark, canvas):
    rows = [(1, n, f) for n, f in (("F_Cu", 0.02), ("B_Cu", 0.98), ("In1_Cu", 0.98), ("In2_Cu", 0.5), ("In3_Cu", 0.4), ("In4_Cu", 0.6), ("In5_Cu", 0.1))]
    v = audit.polarity(spark.createDataFrame(rows, "board_id int, layer string, fill double"))
    assert [r.verdict for r in v.collect()] == ["none", "warn", "invert", "ambiguous", "ambiguous", "ambiguous", "none"]
    got = {r.layer: (r.invert, r.source, r.conflict) for r in audit.resolve_invert(v, True, ("F_Cu", "In2_Cu"), ("In1_Cu", "In2_Cu")).collect()}
    assert got["F_Cu"] == (True, "override", False) and got["In1_Cu"] == (False, "override", False)
    assert got["In2_Cu"] == (False, "override", True) and got["B_Cu"] == (False, "auto", False)
    assert not audit.resolve_invert(v, False).where("invert").count()


def test_plane_is_inverted(spark, canvas):
    plane = masks.complement(table(spark, ellipse("In1_Cu", 90, 40, 110, 60)), masks.layer_canvas(canvas, ("In1_Cu",)))
    size = masks.layer_canvas(canvas, ("In1_Cu",))
    ready = audit.prepare(plane, size, audit.resolve_invert(audit.polarity(masks.fill(plane, size))))
    assert masks.fill(ready, size).first().fill < 0.05


def test_alignment(spark, canvas):
    pads = table(spark, rect("F_Cu", 30, 30, 70, 70) + rect("B_Cu", 130, 50, 170, 90))
    holes = ellipse("drill", 45, 45, 55, 55) + ellipse("drill", 145, 65, 155, 75)
    good = audit.audit_alignment(table(spark, holes), pads, canvas).first()
    assert (good.score, good.verdict, good.n_drills) == (1.0, "none", 2)
    none = audit.audit_alignment(table(spark, holes).where("false"), pads, canvas).first()
    assert (none.n_drills, none.score, none.verdict) == (0, 1.0, "none")
    off = table(spark, [(b, n, y, x0 + 80 if x0 > 100 else x0 + 35, x1 + 80 if x0 > 100 else x1 + 35) for b, n, y, x0, x1 in holes if x0 < 110])
    bad = audit.audit_alignment(off, pads, canvas)
    assert bad.first().verdict == "shift" and audit.audit_alignment(off, pads, canvas, auto=False).first().verdict == "fail"


def test_offset_is_the_exact_maximum(spark):
    r = np.random.default_rng(7)
    small = spark.createDataFrame([(1, 16, 12)], "board_id int, w int, h int")
    for _ in range(2):
        d, c = r.random((12, 16)) < 0.15, r.random((12, 16)) < 0.3
        rows = lambda g, n: masks.from_pixels(spark.createDataFrame([(1, n, int(y), int(x)) for y, x in np.argwhere(g)], "board_id int, layer string, y int, x int"))
        got = audit.detect_offset(rows(d, "drill"), rows(c, "F_Cu"), small, most=5).first()
        votes = {}
        for y, x in np.argwhere(d):
            for v, u in np.argwhere(c):
                if abs(v - y) <= 5 and abs(u - x) <= 5:
                    votes[v - y, u - x] = votes.get((v - y, u - x), 0) + 1
        assert (got.dy, got.dx) == min(votes, key=lambda k: (-votes[k], k))
    empty = audit.detect_offset(rows(d, "drill").where("false"), rows(c, "F_Cu"), small).first()
    assert (empty.dy, empty.dx) == (0, 0)


def test_mask_gain(spark, canvas):
    pads, mask = table(spark, rect("F_Cu", 30, 30, 49, 49)), table(spark, rect("F_Mask", 35, 30, 54, 49))
    moved = masks.shift(mask, spark.createDataFrame([(1, 0, -5)], "board_id int, dy int, dx int"), canvas)
    g = audit.mask_gain(mask, pads, moved, canvas).first()
    assert (g.before, g.after, g.accepted) == (300, 400, True)


def test_codec_and_palette(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 300, 65536, 16777215, 0)], "net int")
    c = df.select("net", export.encode_rgb(F.col("net")).alias("c"), export.palette(F.col("net")).alias("p"))
    for r in c.select("net", export.decode_rgb(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("back"), "p").collect():
        assert r.net == r.back
        assert tuple(r.p) == (0, 0, 0) if r.net == 0 else min(r.p) >= 64


def test_downsample_resize_rescue(spark):
    run = "board_id int, layer string, y int, x0 int, x1 int, net int"
    tiny = spark.createDataFrame([(1, "a", 1, 1, 2, 42)], run)
    assert [tuple(r) for r in export.downsample(tiny, spark.createDataFrame([(1, 2, 2)], "board_id int, w int, h int"), 0.5).collect()] == [(1, "a", 0, 0, 42)]
    r = np.random.default_rng(1)
    g = r.integers(0, 3, (20, 30)) * (r.random((20, 30)) < 0.5)
    g[3, 3], g[17, 29] = 7, 8
    rows = [(1, "a", y, x, x + 1, int(g[y, x])) for y, x in np.ndindex(20, 30) if g[y, x]]
    df, size = spark.createDataFrame(rows, run), spark.createDataFrame([(1, 30, 20)], "board_id int, w int, h int")
    small = export.resize_nearest(df, size, 7, 6)
    want = {(y, x): int(g[int((y + 0.5) * 20 / 6), int((x + 0.5) * 30 / 7)]) for y in range(6) for x in range(7)}
    assert {(p.y, p.x): p.net for p in small.collect()} == {k: v for k, v in want.items() if v}
    assert {p.net for p in export.rescue(small, df, size, 7, 6).collect()} == {1, 2, 7, 8}


def placed_one_by_one(small, lost, width, height):
    """The rescue by a plain loop over a layer's whole map."""
    grid = dict(small)
    for net, oy, ox in sorted(lost):
        near = [(r, y, x) for r in range(4) for y in range(max(0, oy - r), min(height, oy + r + 1)) for x in range(max(0, ox - r), min(width, ox + r + 1)) if (y, x) not in grid]
        grid[min(near)[1:] if near else (oy, ox)] = net
    return grid


def test_rescue_in_chains_equals_one_loop(spark):
    run, cell = "board_id int, layer string, y int, x0 int, x1 int, net int", "board_id int, layer string, y int, x int, net int"
    r = np.random.default_rng(5)
    cases = {(1, "a"): (0.02, 12), (1, "b"): (0.7, 60), (2, "a"): (1.0, 9), (2, "b"): (0.0, 40), (3, "a"): (0.3, 0)}  # share of the map that is taken, nets lost
    width, height, small, rows, lost = 23, 31, {}, [], {}
    for key, (share, n) in cases.items():
        small[key] = {(y, x): 1 for y, x in np.ndindex(height, width) if r.random() < share}
        at = [(int(r.integers(height)), int(r.integers(width))) for _ in range(n)]
        at[: n // 3] = [at[0]] * (n // 3) if n else []  # many nets in one place
        lost[key] = [(10 + int(i), *p) for i, p in zip(r.permutation(n), at, strict=True)]
        rows += [(*key, y, x, x + 1, net) for net, y, x in lost[key]] + [(*key, 0, 0, 1, 1)] * bool(small[key])
    size = spark.createDataFrame([(b, width, height) for b in (1, 2, 3)], "board_id int, w int, h int")
    have = spark.createDataFrame([(*k, y, x, net) for k, g in small.items() for (y, x), net in g.items()], cell)
    got = {}
    for p in export.rescue(have, spark.createDataFrame(rows, run), size, width, height).collect():
        assert (p.y, p.x) not in got.setdefault((p.board_id, p.layer), {})  # no pixel twice
        got[p.board_id, p.layer][p.y, p.x] = p.net
    assert got == {k: placed_one_by_one(small[k], lost[k], width, height) for k in cases}


def test_windows_that_meet():
    p = pd.DataFrame([(1, "a", 0, 0), (1, "a", 6, 6), (1, "a", 12, 9), (1, "a", 20, 9), (1, "a", 13, 30)], columns=["board_id", "layer", "oy", "ox"])
    meet = export.meeting(p)["meet"].tolist()
    assert meet[0] == meet[1] == meet[2] and len(set(meet)) == 3

def test_rectangles_cover_and_netmap_round_trip(spark):
    from netloom.operators import vector

    e = extract(spark, rect("F_Cu", 5, 5, 20, 9) + rect("F_Cu", 5, 10, 9, 20) + rect("B_Cu", 2, 2, 30, 30), ellipse("drill", 8, 6, 14, 12), "explicit", (40, 40))
    rects = export.rectangles(e.net_runs)
    area = rects.select(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).first()[0]
    assert area == e.components.agg(F.sum("area_px")).first()[0]
    svg = export.netmap(rects, e.canvas, e.layers)
    back = vector.parse_netmap(svg)
    key = lambda df: sorted(map(tuple, df.select("layer", "net", "x0", "y0", "x1", "y1").collect()))
    assert key(back) == key(rects)
    odd = vector.odd_paths(svg).first()
    assert (odd.paths, odd.odd_paths) == (2, 0)
    broken = svg.select("board_id", F.regexp_replace("svg", "H", "Q").alias("svg"))
    assert vector.odd_paths(broken).first().odd_paths > 0


def test_overlay_paints_the_whole_canvas(spark, canvas, tmp_path):
    copper = table(spark, rect("F_Cu", 10, 3, 60, 40) + rect("In1_Cu", 40, 20, 90, 61))
    holes = table(spark, ellipse("drill", 50, 30, 70, 50) + ellipse("drill", 150, 70, 160, 80))
    got = np.zeros((100, 200, 2), int)
    for r in audit.overlay(copper, holes, canvas).collect():
        assert not got[r.y, r.x0 : r.x1].any()  # no pixel twice
        got[r.y, r.x0 : r.x1] = r.red, r.green_blue
    want = np.zeros((100, 200, 2), int)
    for colour, mask in (((128, 128), copper), ((255, 0), holes)):
        for r in mask.collect():
            want[r.y, r.x0 : r.x1] = colour
    assert (got == want).all() and {y % 8 for y in np.nonzero(got.any(axis=(1, 2)))[0]} == set(range(8))


def test_overlay_queries_hold_the_same_pixels(spark):
    from netloom.plans import registry

    q = {n: registry.queries()[n](spark, "/root/testdata/sf0.001") for n in ("audit_overlay", "audit_overlay_rows")}
    px = q["audit_overlay"].select("board_id", "layer", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "red", "green_blue")
    assert px.exceptAll(q["audit_overlay_rows"]).count() == 0 == q["audit_overlay_rows"].exceptAll(px).count()


def test_best_offset_against_brute_force():
    import random

    import pandas as pd

    from netloom.operators import audit

    r = random.Random(3)
    for case in range(40):
        runs = lambda n: pd.DataFrame([(0, r.randrange(12), x, x + r.randint(1, 4)) for x in (r.randrange(14) for _ in range(n))], columns=["board_id", "y", "x0", "x1"]).drop_duplicates(["y"])
        d, c, most = runs(5), runs(8), r.choice([2, 5, 30])
        pixels = lambda df: {(y, x) for y, a, b in zip(df.y, df.x0, df.x1, strict=True) for x in range(a, b)}
        p, q = pixels(d), pixels(c)
        hits = {(dy, dx): sum((y + dy, x + dx) in q for y, x in p) for dy in range(-most, most + 1) for dx in range(-most, most + 1)}
        best = max(hits.values())
        want = min(k for k, v in hits.items() if v == best) if best else (0, 0)
        assert audit.best_offset(d, c, most) == want, case


def test_openings_move_onto_their_copper(spark):
    canvas = spark.createDataFrame([(1, 60, 40), (2, 60, 40)], "board_id int, w int, h int")
    box = lambda board, layer, x, y, n=6: [(board, layer, y + i, x, x + n) for i in range(n)]
    schema = "board_id int, layer string, y int, x0 int, x1 int"
    copper = spark.createDataFrame([*box(1, "F_Cu", 10, 10), *box(1, "F_Cu", 40, 20), *box(1, "B_Cu", 5, 5), *box(2, "F_Cu", 10, 10)], schema)
    openings = spark.createDataFrame([*box(1, "F_Mask", 13, 8), *box(1, "F_Mask", 43, 18), *box(1, "B_Mask", 5, 5)], schema)
    pairs = spark.createDataFrame([(b, f"{s}_Mask", f"{s}_Cu") for b in (1, 2) for s in "FB"], "board_id int, mask string, copper string")
    got = {(r.board_id, r.layer): r for r in audit.mask_alignment(openings, copper, canvas, pairs).collect()}
    assert set(got) == {(1, "F_Mask"), (1, "B_Mask")}  # board 2 has no openings
    moved, still = got[1, "F_Mask"], got[1, "B_Mask"]
    assert (moved.reference, moved.dy, moved.dx, moved.before, moved.after, moved.accepted) == ("F_Cu", 2, -3, 24, 72, True)
    assert (still.dy, still.dx, still.accepted) == (0, 0, False)
    none = spark.createDataFrame([], schema)
    assert audit.mask_alignment(none, copper, canvas, pairs).count() == 0
    holes = spark.createDataFrame([*box(1, "drill", 10, 10), *box(1, "drill", 40, 20)], schema)
    via = copper.where("board_id = 1 AND layer = 'F_Cu'").selectExpr("board_id", "'via' AS layer", "y + 9 AS y", "x0 + 8 AS x0", "x1 + 8 AS x1")
    shifts = jobs.detected_shifts(copper.unionByName(openings).unionByName(via), holes, canvas).collect()
    assert {(r.layer, r.dy, r.dx, r.source) for r in shifts} == {("F_Mask", 2, -3, "auto"), ("via", -9, -8, "auto")}


def test_grid_of_layers(spark):
    canvas = spark.createDataFrame([(1, 5, 3)], "board_id int, w int, h int")
    got = {r.layer: (r.col, r.row, r.x, r.y, r.w, r.h, r.grid_w, r.grid_h) for r in export.placements(canvas, ("a", "b", "c"), 2, 0.5).collect()}
    assert got == {"a": (0, 0, 0, 0, 2, 1, 5, 3), "b": (1, 0, 2, 0, 2, 1, 5, 3), "c": (0, 1, 0, 1, 2, 1, 5, 3)}
    runs = spark.createDataFrame([(1, "a", 0, 0, 2, 7), (1, "b", 2, 4, 5, 300), (1, "c", 0, 0, 1, 9), (1, "other", 0, 0, 1, 1)], "board_id int, layer string, y int, x0 int, x1 int, net int")
    cells = {(r.y, r.x): r.net for r in export.id_map(runs, canvas, ("a", "b", "c"), 2).collect()}
    assert cells == {(0, 0): 7, (0, 1): 7, (2, 9): 300, (3, 0): 9}
    with pytest.raises(ValueError):
        export.placements(canvas, ())


def test_every_rule_has_its_reason(spark):
    rows = spark.createDataFrame([(rule, name, 4.26) for rule, name in drills.REASONS] + [(99, "x", 1.0)], "rule int, classification string, radius_px double")
    said = {(r.rule, r.classification): r.reason for r in rows.withColumn("reason", drills.reason()).collect()}
    assert len({*said.values()}) == 12 and said[99, "x"] is None
    assert "substantial pad ring" in said[3, "likely_npth"] and "4.3 px" in said[7, "likely_pth"]
