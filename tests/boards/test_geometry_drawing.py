import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.__main__ import main
from netloom.operators import artwork, components, drawing, geometry, paint
from netloom.plans import jobs
from netloom.plans.extract import Extraction
from netloom.storage import stored
from tests.boards.test_paint import shapes

W, H = 40, 30
SVG = "board_id int, layer string, svg string"


def subs_of(svgs):
    return stored(artwork.subpaths(artwork.elements(artwork.documents(svgs))), "subpaths")


def pixels(runs):
    return {(r.board_id, r.layer, r.y, x) for r in runs.collect() for x in range(r.x0, r.x1)}


@pytest.fixture(scope="module")
def drawn(spark):
    r = random.Random(11)
    made = [(b, "a", f'<svg viewBox="0 0 {W} {H}">' + "".join(s[0] for s in shapes(r, 12)) + "</svg>") for b in range(6)]
    return spark.createDataFrame(made, SVG).coalesce(1).cache()


def painted(prims):
    """Pixels of primitives, one drawing for each net: laid down in Python."""
    grids = {}
    for r in sorted(prims.collect(), key=lambda r: (r.board_id, r.net, r.ord)):
        grids.setdefault((r.board_id, r.net, r.ord), []).append(r)
    out = {}
    y, x = np.mgrid[0:H, 0:W] + 0.5
    for (b, net, _), rows in sorted(grids.items()):
        hit = np.zeros((H, W), bool)
        for q in rows:
            c = q.coords
            if q.kind == "tri":
                s = [(c[i], c[i + 1], c[(i + 2) % 6], c[(i + 3) % 6]) for i in (0, 2, 4)]
                inside = np.zeros((H, W), bool)
                for x0, y0, x1, y1 in s:
                    if y0 != y1:
                        inside ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0))
                hit ^= inside
            else:
                dx, dy = c[2] - c[0], c[3] - c[1]
                t = np.clip(((x - c[0]) * dx + (y - c[1]) * dy) / (dx * dx + dy * dy or 1), 0, 1)
                hit |= np.hypot(x - c[0] - t * dx, y - c[1] - t * dy) <= c[4]
        g = out.setdefault((b, net), np.zeros((H, W), bool))
        g[hit] = rows[0].polarity > 0
    return {k: g.tobytes() for k, g in out.items() if g.any()}


def test_nets_keep_all_erasures_that_change_their_pixels(spark, drawn):
    canvas = spark.createDataFrame([(b, W, H) for b in range(6)], "board_id int, w int, h int")
    subs = subs_of(drawn)
    runs = stored(components.label(paint.paint(paint.spans(subs))).withColumnRenamed("component", "net"), "nets")
    prims = stored(geometry.attributed(subs, runs, canvas), "primitives")
    assert prims.count() == artwork.primitives(subs).count()
    some = stored(geometry.by_net(prims, canvas), "geometry")
    nets = prims.where("net > 0").select("board_id", "layer", "net").distinct()
    own = prims.where("polarity = 1 AND net > 0")
    # the plain form: every erasure of the layer
    every = own.unionByName(prims.where("polarity = -1").drop("net").join(nets, ["board_id", "layer"]))
    assert nets.count() > 6
    assert painted(some) == painted(every)
    assert some.where("polarity = -1").count() < every.where("polarity = -1").count()
    assert geometry.by_net(prims.where("false"), canvas).count() == 0


def test_drawings_become_masks(spark, drawn):
    none, every = drawn.where("false").select("board_id", "layer"), drawn.select("board_id", "layer")
    before = pixels(paint.paint(paint.spans(subs_of(drawn))))
    assert pixels(paint.paint(paint.spans(subs_of(drawing.luminance(drawn, none))))) == before
    board = {(b, "a", y, x) for b in range(6) for y in range(H) for x in range(W)}
    turned = pixels(paint.paint(paint.spans(subs_of(drawing.luminance(drawn, every)))))
    assert turned == board - before


def test_names_and_colours(spark):
    rows = [
        (1, "F_Cu", """<svg viewBox="1.5 2 30 20"><mask id='a'><path id="b" fill="#FEFEFE" stroke="#010101" d="M0 0"/><use xlink:href="#b"/><g fill="teal" clip-path="url(#c)"/></mask><path fill="#FFF" mask="url(#a)"/></svg>"""),
        (2, "In 1", '<svg width="9mm" height="8"><rect width="3" height="3" fill="white"/></svg>'), (3, "F_Cu", "<svg></svg>"), (4, "F_Cu", None),
    ]
    df = spark.createDataFrame(rows, SVG)
    got = {r.board_id: r.svg for r in drawing.luminance(df, df.where("board_id = 1").select("board_id", "layer")).collect()}
    head = '<svg xmlns="http://www.w3.org/2000/svg" shape-rendering="crispEdges" viewBox="{}"><mask id="{}-copper" maskUnits="userSpaceOnUse"{}>'
    tail = '</mask><rect{} fill="currentColor" mask="url(#{}-copper)"/></svg>'
    area = ' x="1.5" y="2" width="30" height="20"'
    body = f'<rect{area} fill="#ffffff"/><path id="F_Cu-b" fill="#000000" stroke="#ffffff" d="M0 0"/><use xlink:href="#F_Cu-b"/><g fill="teal" clip-path="url(#F_Cu-c)"/>'
    assert got[1] == head.format("1.5 2 30 20", "F_Cu", area) + body + tail.format(area, "F_Cu")
    area = ' x="0" y="0" width="9" height="8"'
    assert got[2] == head.format("0 0 9 8", "In_1", area) + '<rect width="3" height="3" fill="#ffffff"/>' + tail.format(area, "In_1")
    assert got[3] is None and got[4] is None
    assert drawing.luminance(df.where("false"), df.select("board_id", "layer")).count() == 0


def test_render_writes_drawings_and_geometry(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    run = "board_id int, layer string, y int, x0 int, x1 int"
    spark.createDataFrame([(1, W, H)], "board_id int, w int, h int").write.parquet(f"{src}/canvas")
    spark.createDataFrame([(1, n, y, 5, 12) for n in ("F_Cu", "B_Cu") for y in range(4, 10)], run).write.parquet(f"{src}/runs")
    spark.createDataFrame([(1, "drill", y, 7, 9) for y in (6, 7)], run).write.parquet(f"{src}/drill")
    folder = tmp_path / "svg" / "board_id=1"
    folder.mkdir(parents=True)
    text = '<svg viewBox="0 0 {} {}"><rect x="5" y="4" width="7" height="6" fill="#fff"/><circle cx="8" cy="7" r="1" fill="#000"/><circle cx="30" cy="20" r="1" fill="#000"/></svg>'
    for layer in ("F_Cu", "B_Cu"):
        (folder / f"{layer}.svg").write_text(text.format(W, H))
    (folder / "readme.txt").write_text("not a drawing")
    args = ["render", str(src), "--layers", "F_Cu,B_Cu", "--out", str(out), "--drawings", str(tmp_path / "svg")]
    assert main(args) == 0
    made = spark.read.text(f"{out}/drawings", wholetext=True)
    assert {r.layer for r in made.where(F.col("value").contains("currentColor")).collect()} == {"F_Cu", "B_Cu"}
    shown = spark.read.parquet(f"{out}/geometry")
    assert {(r.layer, r.ord, r.polarity, r["count"]) for r in shown.groupBy("layer", "ord", "polarity").count().collect()} == {(n, o, p, c) for n in ("F_Cu", "B_Cu") for o, p, c in ((1, 1, 4), (3, -1, 1))}
    canvas = spark.read.parquet(f"{src}/canvas")
    runs, drill = spark.read.parquet(f"{src}/runs"), spark.read.parquet(f"{src}/drill")
    e = Extraction(runs, drill, canvas, ("F_Cu", "B_Cu"))
    svgs = jobs.read_drawings(spark, str(tmp_path / "svg"))
    done = spark.createDataFrame([(1, "F_Cu", True, 1, 0), (1, "drill", False, 5, 5)], "board_id int, layer string, invert boolean, dy int, dx int")
    with pytest.raises(ValueError, match=r"board 1 F_Cu: dy=1 dx=0$"):
        jobs.write_drawings(e, svgs, done, str(out))
    wide = svgs.withColumn("svg", F.regexp_replace("svg", f"0 0 {W} ", f"0 0 {W + 1} "))
    with pytest.raises(ValueError, match="board 1 B_Cu: 41.0 x 30.0"):
        jobs.write_drawings(e, wide, done.where("layer = 'drill'"), str(out))
    manual = spark.createDataFrame([(1, "drill", 2, 3)], "board_id int, layer string, dy int, dx int")
    got = jobs.corrections(runs, drill, canvas, ("F_Cu", "B_Cu"), manual, force=("B_Cu",)).collect()
    assert {tuple(r) for r in got} == {(1, "F_Cu", False, None, None), (1, "B_Cu", True, None, None), (1, "drill", False, 2, 3)}
