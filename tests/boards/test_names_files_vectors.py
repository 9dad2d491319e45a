import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import catalog
from netloom.operators import vector
from netloom.plans import jobs
from netloom.sources import files


def detect(spark, names):
    df = spark.createDataFrame([(1, n) for n in names], "board_id int, filename string")
    return {r.canonical: r.filename for r in catalog.detect_layers(df).collect()}


@pytest.mark.parametrize("names,want", [
    (["p-F_Cu.gbr", "p-In1_Cu.gbr", "p-In12.Cu.gbr", "p-B.Cu.gbr", "p-F_SilkS.gbr", "p-B_Silkscreen.gbr", "p-F.Mask.gbr", "p-Edge_Cuts.gm1", "p-PTH.drl", "p-NPTH.drl"],
     {"F_Cu": "p-F_Cu.gbr", "In1_Cu": "p-In1_Cu.gbr", "In12_Cu": "p-In12.Cu.gbr", "B_Cu": "p-B.Cu.gbr", "F_Silkscreen": "p-F_SilkS.gbr", "B_Silkscreen": "p-B_Silkscreen.gbr", "F_Mask": "p-F.Mask.gbr", "Edge_Cuts": "p-Edge_Cuts.gm1", "PTH": "p-PTH.drl", "NPTH": "p-NPTH.drl"}),
    (["b.gtl", "b.g1", "b.gp2", "b.GBL", "b.gto", "b.drl"], {"F_Cu": "b.gtl", "In1_Cu": "b.g1", "In2_Cu": "b.gp2", "B_Cu": "b.GBL", "F_Silkscreen": "b.gto", "drill": "b.drl"}),
    (["a.cmp", "a.ly2", "a.ly3", "a.sol", "a.drd", "a.dri", "a.gpi", "a_via.ncd"], {"F_Cu": "a.cmp", "In1_Cu": "a.ly2", "In2_Cu": "a.ly3", "B_Cu": "a.sol", "drill": "a.drd", "via": "a_via.ncd"}),
    (["proj-F_Cu.gbl"], {"F_Cu": "proj-F_Cu.gbl"}),
    (["readme.md", "x.zip", "noext"], {}),
    (["a-F_Cu.gbr", "b-F_Cu.gbr"], {"F_Cu": "a-F_Cu.gbr"}),
])
def test_detection(spark, names, want):
    assert detect(spark, names) == want


def test_resolution(spark):
    stack = ["B_Cu", "In4_Cu", "F_Cu", "In2_Cu", "In1_Cu", "In3_Cu", "drill", "F_Mask"]
    rows = [(1, n) for n in stack] + [(2, n) for n in ("top", "bottom", "inner1", "PTH", "drill")] + [(3, "via"), (3, "drill")] + [(4, "NPTH")]
    have = spark.createDataFrame(rows, "board_id int, name string")
    got = catalog.resolve_layers(have).orderBy("layer_ord").collect()
    assert [r.layer for r in got] == ["F_Cu", "In1_Cu", "In2_Cu", "In3_Cu", "In4_Cu", "B_Cu"]
    names = lambda df: {r.board_id: r.name for r in df.collect()}
    assert names(catalog.drill_name(have)) == {1: "drill", 2: "drill", 3: "drill", 4: "drill"}
    assert names(catalog.via_name(have)) == {1: "drill", 2: "PTH", 3: "via", 4: "via"}
    sha = spark.createDataFrame([(1, "via", "x"), (1, "drill", "x"), (2, "via", "x"), (2, "drill", "y"), (3, "via", "x"), (3, "drill", "x"), (3, "PTH", "x"), (4, "NPTH", "z"), (5, "drill", "z")], "board_id int, name string, sha string")
    vias = spark.createDataFrame([(1, "via"), (2, "via"), (3, "via"), (4, "NPTH"), (5, "drill")], "board_id int, name string")
    assert {r.board_id: r.mode for r in catalog.connector_mode(sha, vias).collect()} == {1: "infer", 2: "explicit", 3: "explicit", 4: "never", 5: "infer"}
    outer = catalog.default_outer(spark.createDataFrame([(1, "top", 0), (1, "F_Cu", 1), (1, "In1_Cu", 2), (1, "bot", 3)], "board_id int, layer string, layer_ord int"))
    assert {r.layer for r in outer.collect()} == {"top", "F_Cu", "bot"}
    alias = catalog.with_aliases(spark.createDataFrame([(1, "PTH", 5), (2, "via", 6), (3, "PTH", 7), (3, "via", 8)], "board_id int, name string, v int"))
    assert sorted(map(tuple, alias.collect())) == [(1, "PTH", 5), (1, "drill", 5), (1, "via", 5), (2, "drill", 6), (2, "via", 6), (3, "PTH", 7), (3, "drill", 7), (3, "via", 8)]


def test_mapping_and_choices(spark):
    texts = spark.createDataFrame([(1, '{"layers": {"F_Cu": "a", "_x": "kept"}}'), (2, '{"_note": "no", "B_Cu": "b"}')], "board_id int, json string")
    assert sorted(map(tuple, files.read_mapping(texts).collect())) == [(1, "F_Cu", "a"), (1, "_x", "kept"), (2, "B_Cu", "b")]
    more = spark.createDataFrame([(2, "z.gtl"), (3, "c.gbl"), (3, "c.gtl")], "board_id int, filename string")
    both = files.mapping_or_detected(texts, more)
    assert {(r.board_id, r.canonical) for r in both.collect()} == {(1, "F_Cu"), (1, "_x"), (2, "B_Cu"), (3, "F_Cu"), (3, "B_Cu")}
    assert files.mapping_json(both.where("board_id = 3")).first().json == '{"layers":{"F_Cu":"c.gtl","B_Cu":"c.gbl"}}'
    ch = spark.createDataFrame([(1, '{"decisions": [{"drill": 1, "plated": true}, {"drill": 2}, {"plated": false}]}')], "board_id int, json string")
    assert [tuple(r) for r in files.read_choices(ch).collect()] == [(1, 1, True)]
    ob = spark.createDataFrame([(1, '{"drill_classifications": [{"object_index": 0, "plated": true}, {"source_object_index": 1, "plated": false}]}')], "board_id int, json string")
    decided = files.read_object_choices(ob)
    objects = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 2.0, 2.0)], "board_id int, object_index int, x double, y double")
    pth, npth = jobs.split_objects(objects, decided)
    assert [r.object_index for r in pth.collect()] == [0] and [r.object_index for r in npth.collect()] == [1]
    with pytest.raises(ValueError, match="no object index"):
        files.read_object_choices(ch)


def test_excellon_and_assignment(spark):
    text = "M48\nMETRIC\nT1C0.3\nT2C1.0\n%\nT1\nX0.0Y0.0\nY100.0\nT2\nX1Y1G85X3Y1\nM30"
    got = files.read_excellon(spark.createDataFrame([(1, text)], "board_id int, text string")).collect()
    assert [(r.object_index, r.diameter, r.x, r.y) for r in got] == [(0, 0.3, 0.0, 0.0), (1, 0.3, 0.0, 100.0), (2, 1.0, 2.0, 1.0)]
    d = spark.createDataFrame([(1, 1, 0.0, 100.0), (1, 2, 0.0, 0.0)], "board_id int, drill int, cx double, cy double")
    o = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 100.0)], "board_id int, object_index int, x double, y double")
    assert {r.drill: r.object_index for r in files.match_objects(d, o).collect()} == {1: 0, 2: 1}
    r = np.random.default_rng(3)
    for n in range(1, 7):
        cost = r.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert math.isclose(sum(cost[i, j] for i, j in enumerate(files._assign(cost))), best)


def test_svg_sizes(spark):
    rows = ['<svg viewBox="0 0 10.5 20.4">', '<svg width="11.6mm" height="0.2mm">', '<svg viewBox="0 0 100 50"><g transform="matrix(10 0 0 -10 -20 70)">']
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    assert [tuple(r.z) for r in df.select(files.svg_size(F.col("s")).alias("z")).collect()] == [(10, 20), (12, 1), (100, 50)]
    w = df.where("s like '%matrix%'").select(files.transform_window(F.col("s")).alias("w")).first().w
    assert tuple(w) == (2.0, 2.0, 10.0, 5.0)


def test_paths():
    closed, pts = vector.polylines("M10 10 20 10 h5 v5 l-5 0 Z")[0]
    assert closed and [c for p in pts for c in p] == [10, 10, 20, 10, 25, 10, 25, 15, 20, 15]
    arc = vector.polylines("M10 0 A10 10 0 0 1 0 10", 0.001)[0][1]
    assert arc[-1] == (0.0, 10.0) and all(abs(math.hypot(*p) - 10) < 0.01 for p in arc)
    assert abs(max(p[1] for p in vector.polylines("M0 0 C0 10 10 10 10 0", 0.001)[0][1]) - 7.5) < 0.05
    assert [c for c, _ in vector.polylines("M0 0 1 1 M2 2 3 3")] == [False, False]
    assert [c for c, _ in vector.polylines("M0 0 1 1 2 0Z m0 0")] == [True]
    smooth = vector.polylines("M0 0 Q5 10 10 0 T20 0", 0.01)[0][1]
    assert min(p[1] for p in smooth) < -4.5 and smooth[-1] == (20.0, 0.0)
    assert vector.polylines("M0 0a1 1 0 012 0")[0][1][-1] == (2.0, 0.0)


def scan(grid, gx, gy, reach):
    """Nearest label by growing squares, as a picker would walk them."""
    h, w = grid.shape
    gx, gy = min(w - 1, max(0, gx)), min(h - 1, max(0, gy))
    best = (math.inf, 0)
    for r in range(reach + 1):
        if r * r > best[0]:
            break
        for i in range(-r, r + 1):
            for x, y in ((gx + i, gy - r), (gx + i, gy + r), (gx - r, gy + i), (gx + r, gy + i)):
                if 0 <= x < w and 0 <= y < h and grid[y, x] and (x - gx) ** 2 + (y - gy) ** 2 < best[0]:
                    best = ((x - gx) ** 2 + (y - gy) ** 2, grid[y, x])
    return best[1]


def test_nearest_and_attribution(spark):
    r = np.random.default_rng(5)
    g = r.integers(1, 9, (12, 14)) * (r.random((12, 14)) < 0.12)
    canvas = spark.createDataFrame([(1, 14, 12)], "board_id int, w int, h int")
    runs = spark.createDataFrame([(1, "a", int(y), int(x), int(x) + 1, int(g[y, x])) for y, x in np.argwhere(g)], "board_id int, layer string, y int, x0 int, x1 int, net int")
    pts = [(1, "a", i, x, y) for i, (x, y) in enumerate(itertools.product(range(-1, 15), range(-1, 13)))]
    got = {p.point: p.net for p in vector.nearest_label(spark.createDataFrame(pts, "board_id int, layer string, point int, gx int, gy int"), runs, canvas).collect()}
    assert got == {i: int(scan(g, x, y, 3)) for _, _, i, x, y in pts}
    seg = spark.createDataFrame([(1, "a", 0, 1, 0.5, 0.5, 8.5, 0.5), (1, "a", 1, -1, 0.0, 0.0, 1.0, 1.0)], "board_id int, layer string, seg int, polarity int, x1 double, y1 double, x2 double, y2 double")
    want = next((int(v) for v in (scan(g, 4, 0, 3), scan(g, 0, 0, 3), scan(g, 8, 0, 3)) if v), 0)
    assert [tuple(x) for x in vector.attribute_segments(seg, runs, canvas).collect()] == [(1, "a", 0, want)]
    fill = spark.createDataFrame([(1, "a", 0, 1, 0.0, 0.0, 14.0, 12.0, 7.0, 6.0), (1, "a", 1, 1, 0.0, 0.0, 1.0, 1.0, 0.5, 0.5)], "board_id int, layer string, fill int, polarity int, x0 double, y0 double, x1 double, y1 double, sx double, sy double")
    votes = [int(scan(g, int(x), int(y), 3)) for x, y in ((7, 6), (3.5, 6), (10.5, 6), (7, 3), (7, 9))]
    hits = [v for v in votes if v]
    big = max(hits, key=lambda v: (hits.count(v), -hits.index(v))) if hits else 0
    assert {x.fill: x.net for x in vector.attribute_fills(fill, runs, canvas).collect()} == {0: big, 1: int(scan(g, 0, 0, 3))}


def test_primitives(spark):
    schema = "board_id int, layer string, ord int, kind string, polarity int, coords array<double>, net int"
    p = spark.createDataFrame([(1, "a", 0, "seg", 1, [1.0], 7), (1, "a", 1, "seg", -1, [2.0], 0), (1, "a", 2, "seg", 1, [3.0], 8), (1, "b", 0, "seg", -1, [4.0], 0)], schema)
    assert [r.ord for r in vector.net_geometry(p, 7).orderBy("ord").collect()] == [0, 1]
    inv = vector.invert_primitives(p.drop("net").where("layer = 'a'"), spark.createDataFrame([(1, "a", 9, 8)], "board_id int, layer string, w int, h int"))
    assert [(r.ord, r.polarity) for r in inv.orderBy("ord").collect()] == [(-1, 1), (0, -1), (1, 1), (2, -1)]


def test_drill_files_are_split_line_by_line(spark):
    text = "M48\nT1C0.8\nT2C1.2\n%\nT1\nX1.0Y2.0\nY3.0\nT2\nX5Y5G85X7Y5\nX9\nM30"
    texts = spark.createDataFrame([(1, text), (2, None), (3, "X1Y1")], "board_id int, text string")
    decided = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 3, False), (2, 0, True)], "board_id int, object_index int, plated boolean")
    got = {(r.board_id, r.layer): r.text for r in files.split_excellon(texts, decided).collect()}
    head = "M48\nT1C0.8\nT2C1.2\n%\nT1\n"
    assert got[1, "PTH"] == head + "X1.0Y2.0\nT2\nM30\n"
    assert got[1, "NPTH"] == head + "X1.0Y3.0\nT2\nX9Y5\nM30\n"  # the slot is undecided
    assert got[2, "PTH"] == got[2, "NPTH"] == got[3, "PTH"] == got[3, "NPTH"] == "\n"
    again = files.read_excellon(spark.createDataFrame([(1, got[1, "NPTH"])], "board_id int, text string")).collect()
    assert [(r.tool, r.x, r.y) for r in again] == [(1, 1.0, 3.0), (2, 9.0, 5.0)]
    whole = files.read_excellon(texts.where("board_id = 1")).collect()
    assert [(r.object_index, r.tool, r.diameter, r.x, r.y) for r in whole] == [(0, 1, 0.8, 1.0, 2.0), (1, 1, 0.8, 1.0, 3.0), (2, 2, 1.2, 6.0, 5.0), (3, 2, 1.2, 9.0, 5.0)]
