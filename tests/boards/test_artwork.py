import math
import time

import pytest
from pyspark.sql import functions as F

from netloom.functions import catalog
from netloom.operators import artwork, masks, vector
from netloom.plans import jobs


def parsed(spark, *bodies, head='<svg viewBox="0 0 100 80">'):
    svgs = spark.createDataFrame([(i, "a", f"{head}{b}</svg>") for i, b in enumerate(bodies)], "board_id int, layer string, svg string")
    docs = artwork.documents(svgs)
    els = artwork.elements(docs)
    subs = artwork.subpaths(els)
    return docs, els, subs, artwork.primitives(subs)


def rows(prims):
    return [(r.ord, r.kind, r.polarity, [round(c, 3) for c in r.coords]) for r in prims.orderBy("board_id", "ord", "part").collect()]


def even_odd(tris, x, y):
    """Whether an odd number of triangles holds the point."""
    side = lambda a, b: (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
    n = 0
    for t in tris:
        p = [(t[0], t[1]), (t[2], t[3]), (t[4], t[5])]
        s = [side(p[i], p[(i + 1) % 3]) for i in range(3)]
        n += all(v > 0 for v in s) or all(v < 0 for v in s)
    return n % 2 == 1


def test_elements_and_strokes(spark):
    body = """<rect x="0" y="0" width="100" height="80" fill="#000000"/><line x1='1' y1='2' x2='5' y2='2' stroke="WHITE" stroke-width="4" fill="none"/>
      <polyline points="1,1 3 1, 3,3" stroke="#fff"/><polygon points="1,1 3,1 3,3" stroke="#010101"/><polyline points="7 8" stroke="#fff" stroke-width="2"/><rect width="1" height="1" fill="grey"/><path fill="#fff"/>"""
    docs, els, _, prims = parsed(spark, body)
    assert rows(prims) == [
        (2, "seg", 1, [1, 2, 5, 2, 2]), (4, "seg", 1, [1, 1, 3, 1, 0.5]), (4, "seg", 1, [3, 1, 3, 3, 0.5]),
        (6, "seg", -1, [1, 1, 3, 1, 0.5]), (6, "seg", -1, [3, 1, 3, 3, 0.5]), (6, "seg", -1, [3, 3, 1, 1, 0.5]), (8, "dot", 1, [7, 8, 7, 8, 1]),
    ]
    assert tuple(artwork.stats(docs, els, prims).first()) == (0, "a", 7, 1, 1, 6, 1, 0)
    run = artwork.polarity_runs(prims).orderBy("run").collect()
    assert [(r.polarity, r.caps, r.tris) for r in run] == [(1, 3, 0), (-1, 3, 0), (1, 1, 0)]
    assert (run[0].x0, run[0].y0, run[0].x1, run[0].y1) == (-1, 0, 7, 4)


def test_background_is_the_first_element_only(spark):
    full = '<rect width="100" height="80" fill="black"/>'
    small = '<rect width="99" height="80" fill="black"/>'
    docs, els, _, prims = parsed(spark, full + full, small, '<path fill="black"/>' + full, '<rect fill="red" width="1" height="1"/>' + full, "", "<mask>" + full + "</mask>" + small)
    n = {r.board_id: (r.elements, r.backgrounds, r.tris) for r in artwork.stats(docs, els, prims).collect()}
    assert n == {0: (2, 1, 4), 1: (1, 0, 4), 2: (2, 1, 0), 3: (2, 0, 4), 4: (0, 0, 0), 5: (1, 1, 0)}


def test_ring_with_a_hole(spark):
    outer, inner = "M10 10H60V60H10Z", "M20 20H40V40H20Z"
    _, _, subs, prims = parsed(spark, f'<path d="{outer}{inner}" fill="#ffffff"/>')
    tris = [r.coords for r in prims.where("kind = 'tri'").collect()]
    assert len(tris) == 8
    for x, y in ((15.3, 30.1), (50.2, 12.7), (41.1, 39.3)):
        assert even_odd(tris, x, y)
    for x, y in ((30.3, 25.1), (21.7, 38.2), (5.1, 5.3), (70.2, 30.9)):
        assert not even_odd(tris, x, y)
    a = artwork.areas(subs).orderBy("fill").collect()
    assert [(tuple(r.fill), r.sx, r.sy) for r in a] == [((0, 0), 35.0, 35.0), ((0, 1), 30.0, 30.0)]


def circle(cx, cy, r):
    return f"M{cx - r} {cy}A{r} {r} 0 0 1 {cx + r} {cy}A{r} {r} 0 0 1 {cx - r} {cy}Z"


def test_circles_become_dots_only_alone(spark):
    alone, two = circle(20, 20, 5), circle(50, 50, 5)
    inside = circle(50, 50, 2)
    _, _, _, prims = parsed(
        spark, f'<path d="{alone}{two}" fill="white"/>', f'<path d="{alone}{two}{inside}" fill="white"/>', '<circle cx="9" cy="8" r="3" fill="white"/><ellipse cx="30" cy="30" rx="9" ry="3" fill="white"/>',
        '<path d="M0 0H40V40H0Z" fill="white"/>', '<rect x="1" width="5" height="5" fill="none" stroke="none"/>',
    )
    dots = {(r.board_id, r.part): r.coords for r in prims.where("kind = 'dot'").collect()}
    assert set(dots) == {(0, 0), (0, 1), (1, 0), (2, 0)}
    for key, (x, y, r) in {(0, 0): (20, 20, 5), (0, 1): (50, 50, 5), (2, 0): (9, 8, 3)}.items():
        assert all(math.isclose(a, b, abs_tol=0.3) for a, b in zip(dots[key], (x, y, x, y, r), strict=True))
    assert {(r.board_id, r.part) for r in prims.where("kind = 'tri'").collect()} == {(1, 1), (1, 2), (2, 0), (3, 0)}


def test_sizes_and_empty_drawings(spark):
    assert parsed(spark, '<rect width="1" height="1" fill="white"/>', head='<svg width="10mm" height="8mm">')[3].count() == 4
    assert parsed(spark, '<rect width="1" height="1" fill="white"/>', head="<svg>")[3].count() == 0
    docs, els, _, prims = parsed(spark, "no drawing")
    assert tuple(artwork.stats(docs, els, prims).first()) == (0, "a", 0, 0, 0, 0, 0, 0)
    null = spark.createDataFrame([(1, "a", None)], "board_id int, layer string, svg string")
    assert artwork.elements(artwork.documents(null)).count() == 0


def test_primitives_invert(spark):
    _, _, _, prims = parsed(spark, '<rect width="1" height="1" fill="white"/>')
    inv = vector.invert_primitives(prims.drop("part"), spark.createDataFrame([(0, "a", 100, 80)], "board_id int, layer string, w int, h int"))
    assert sorted((r.ord, r.kind, r.polarity) for r in inv.collect()) == [(-1, "board", 1)] + [(1, "tri", -1)] * 4


def test_mask_pairs_visual_drill_and_corrections(spark):
    have = spark.createDataFrame([(1, "F_Cu"), (1, "B_Cu"), (2, "B_Cu"), (3, "top")], "board_id int, name string")
    assert sorted(map(tuple, catalog.mask_pairs(have).collect())) == [(1, "B_Mask", "B_Cu"), (1, "F_Mask", "F_Cu"), (2, "B_Mask", "B_Cu")]
    run = "board_id int, layer string, y int, x0 int, x1 int"
    canvas = spark.createDataFrame([(b, 9, 9) for b in (1, 2, 3)], "board_id int, w int, h int")
    raw = spark.createDataFrame([(b, "drill", 1, 1, 2) for b in (1, 2, 3)], run)
    via = spark.createDataFrame([(b, "via", 5, 5, 6) for b in (1, 2, 3)], run)
    names = spark.createDataFrame([(1, "drill", "drill"), (2, "drill", "via"), (3, "drill", "via")], "board_id int, drill_name string, via_name string")
    manual = spark.createDataFrame([(3, 2, 1)], "board_id int, dy int, dx int")
    got = masks.visual_drill(raw, via, names, manual, canvas).collect()
    assert sorted((r.board_id, r.y, r.x0, r.x1) for r in got) == [(1, 5, 5, 6), (2, 1, 1, 2), (3, 3, 2, 3)]
    corr = spark.createDataFrame([(1, "F_Cu", True, 0, 0), (1, "B_Cu", False, 0, 3), (2, "F_Cu", True, None, None)], "board_id int, layer string, invert boolean, dy int, dx int")
    jobs.check_drawable(corr.where("board_id = 2 OR layer = 'F_Cu'"))
    with pytest.raises(ValueError, match=r"board 1 B_Cu: dy=0 dx=3"):
        jobs.check_drawable(corr)
    d = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)], "board_id int, drill int, plated boolean")
    assert [tuple(r) for r in jobs.plated_counts(d, canvas.where("board_id < 3")).orderBy("board_id").collect()] == [(1, 2, 1), (2, 0, 0)]


def test_elements_are_dealt_out_and_circles_fitted_once(spark):
    """One drawing's elements spread over tasks, and a fit takes time in proportion to its points."""
    ring = " ".join(f"{50 + 40 * math.cos(2 * math.pi * i / 1500):.6f},{50 + 40 * math.sin(2 * math.pi * i / 1500):.6f}" for i in range(1500))
    dots = "".join(f'<circle cx="{3 * i % 90}" cy="{7 * i % 90}" r="2" fill="#000"/>' for i in range(60))
    docs = artwork.documents(spark.createDataFrame([(1, "F_Cu", f'<svg viewBox="0 0 100 100"><polygon points="{ring}" fill="white"/>{dots}</svg>')], "board_id int, layer string, svg string"))
    els = artwork.elements(docs)
    assert els.count() == 61 and els.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    began = time.perf_counter()
    got = artwork.filled(artwork.subpaths(els)).where("dot").select("ord", "cx", "cy", "radius").orderBy("ord").collect()
    assert time.perf_counter() - began < 60 and len(got) == 61
    assert (round(got[0].cx, 4), round(got[0].cy, 4), round(got[0].radius, 4)) == (50.0, 50.0, 40.0)
    assert (round(got[5].cx, 6), round(got[5].cy, 6), round(got[5].radius, 6)) == (12.0, 28.0, 2.0)
