"""Layer drawings: SVG text to primitives that add or erase copper.

``svgs(board_id, layer, svg)`` has one drawing a row.  Its elements become rows
at once, so that a drawing's geometry spreads over the cluster; only path data
is read in Python.  A drawing without a usable size has no elements.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from netloom.operators.vector import polylines

#: Colours that add and that erase, and the tolerances of a circle.
ADDS = ("#fefefe", "#fff", "#ffffff", "white")
ERASES = ("#010101", "#000", "#000000", "black")
ROUND, LEAST_POINTS = 0.04, 8

KEY = ("board_id", "layer", "ord")
CELLS = 64
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POINTS = "array<struct<x:double,y:double>>"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in either kind of quotes; null if absent or empty."""
    return F.nullif(F.regexp_extract(tag, rf"""\s{name}\s*=\s*(["'])(.*?)\1""", 2), F.lit(""))


def colour_polarity(value: Column) -> Column:
    """1 for colours that add copper, -1 for those that erase it, else 0."""
    v = F.lower(value)
    return F.when(v.isin(*ADDS), 1).when(v.isin(*ERASES), -1).otherwise(0)


def _number(tag: Column, name: str, default: float | None = None) -> Column:
    return F.coalesce(F.regexp_extract(attribute(tag, name), NUMBER, 0).try_cast("double"), F.lit(default).cast("double"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once, also where ``then`` uses it for each item of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _pairs(flat: Column) -> Column:
    """Points of an array x, y, x, y, ..."""
    none = F.array().cast(POINTS)
    point = lambda v, i: _point(F.get(v, 2 * i), F.get(v, 2 * i + 1))
    every = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: point(v, i))
    return _let(flat, lambda v: F.when(F.size(v) >= 2, every(v)).otherwise(none))


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _path(d: pd.Series, tol: pd.Series) -> pd.Series:
    """Subpaths of path data, each as 1 or 0 for closed or open, then its points."""
    return pd.Series([[[float(closed), *(c for p in pts for c in p)] for closed, pts in polylines(text or "", t)] for text, t in zip(d, tol, strict=True)])


def documents(svgs: DataFrame) -> DataFrame:
    """(board_id, layer, w, h, tol, tags): size and elements in document order;
    those within a mask if there is one."""
    root = F.regexp_extract("svg", r"<svg\b[^>]*>", 0)
    box = F.split(F.trim(attribute(root, "viewBox")), r"[\s,]+")
    side = lambda i, name: F.coalesce(F.get(box, F.lit(i)).try_cast("double"), _number(root, name))
    masked = F.regexp_extract("svg", r"<mask\b[^>]*>([\s\S]*?)(?:</mask>|\z)", 1)
    body = F.when(F.col("svg").contains("<mask"), masked).otherwise(F.col("svg"))
    tags = F.regexp_extract_all(body, F.lit(r"<(?:path|circle|rect|line|polyline|polygon|ellipse)\b[^>]*>"), F.lit(0))
    return svgs.select("board_id", "layer", side(2, "width").alias("w"), side(3, "height").alias("h"), tags.alias("tags")).withColumn("tol", F.greatest("w", "h") / 20000)


def elements(docs: DataFrame) -> DataFrame:
    """(board_id, layer, ord, w, h, tol, fill, stroke, half, subs, background):
    polarities, half a stroke's width, and subpaths (closed, points).  The first
    element is background where it erases the whole board.  Elements are dealt
    out: a drawing is one row, and few bytes for the work that is in it."""
    t = F.col("tag")
    coloured = lambda x: (colour_polarity(attribute(x, "fill")) != 0) | (colour_polarity(attribute(x, "stroke")) != 0)
    drawn = F.filter("tags", lambda x: ~(x.startswith("<path") & coloured(x) & attribute(x, "d").isNull()))
    e = docs.where("w > 0 AND h > 0").select("board_id", "layer", "w", "h", "tol", F.posexplode(drawn).alias("ord", "tag"))
    e = e.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    e = e.select("*", F.regexp_extract(t, r"^<(\w+)", 1).alias("kind"), colour_polarity(attribute(t, "fill")).alias("fill"), colour_polarity(attribute(t, "stroke")).alias("stroke"), (_number(t, "stroke-width", 1.0) / 2).alias("half"))
    n = lambda name, default=None: _number(t, name, default)
    cx, cy = n("cx", 0.0), n("cy", 0.0)
    rx, ry = F.coalesce(n("r"), n("rx")), F.coalesce(n("r"), n("ry"))
    turn = lambda c: F.acos(F.greatest(F.lit(-1.0), 1 - F.col("tol") / F.greatest(c["rx"], c["ry"], F.lit(1e-9))))
    steps = lambda c: F.greatest(F.lit(16), F.least(F.lit(128), F.ceil(2 * math.pi / F.greatest(F.lit(0.05), 2 * turn(c))).cast("int")))
    around = lambda c, m: F.transform(F.sequence(F.lit(0), m - 1), lambda i: _point(c["cx"] + c["rx"] * F.cos(2 * math.pi * i / m), c["cy"] + c["ry"] * F.sin(2 * math.pi * i / m)))
    ring = _let(F.struct(cx.alias("cx"), cy.alias("cy"), rx.alias("rx"), ry.alias("ry")), lambda c: _let(steps(c), lambda m: around(c, m)))
    x, y, w, h = n("x", 0.0), n("y", 0.0), n("width"), n("height")
    box = F.array(_point(x, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h))
    ends = F.array(_point(n("x1", 0.0), n("y1", 0.0)), _point(n("x2", 0.0), n("y2", 0.0)))
    given = _pairs(F.transform(F.regexp_extract_all(F.coalesce(attribute(t, "points"), F.lit("")), F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double")))
    kind = F.col("kind")
    plain = F.when(kind.isin("circle", "ellipse"), ring).when(kind == "rect", box).when(kind == "line", ends).otherwise(given).cast(POINTS)
    sub = lambda closed, pts: F.struct(closed.alias("closed"), pts.alias("points"))
    e = e.withColumn("read", _path(F.when(kind == "path", attribute(t, "d")), F.col("tol")))
    paths = F.transform("read", lambda s: sub(s[0] == 1, _pairs(F.slice(s, 2, F.size(s) - 1))))
    e = e.withColumn("subs", F.when(kind == "path", paths).otherwise(F.array(sub(~kind.isin("line", "polyline"), plain))))
    every = F.flatten(F.transform("subs", lambda s: s["points"]))
    xs, ys = F.transform(every, lambda p: p["x"]), F.transform(every, lambda p: p["y"])
    covers = (F.array_min(xs) <= 0) & (F.array_min(ys) <= 0) & (F.array_max(xs) >= F.col("w")) & (F.array_max(ys) >= F.col("h"))
    background = (F.col("ord") == 0) & (F.col("fill") == -1) & F.coalesce(covers, F.lit(False))
    return e.select(*KEY, "w", "h", "tol", "fill", "stroke", "half", "subs", background.alias("background"))


def subpaths(els: DataFrame) -> DataFrame:
    """A row for each subpath that draws, with its box."""
    s = els.where("NOT background AND (fill <> 0 OR stroke <> 0)").select(*KEY, "w", "h", "tol", "fill", "stroke", "half", F.size("subs").alias("parts"), F.posexplode("subs").alias("part", "s"))
    s = s.select("*", "s.closed", "s.points").drop("s").where(F.size("points") > 0)
    along = lambda c: F.transform("points", lambda p: p[c])
    return s.select("*", F.array_min(along("x")).alias("x0"), F.array_min(along("y")).alias("y0"), F.array_max(along("x")).alias("x1"), F.array_max(along("y")).alias("y1"))


def _edges(closed: Column) -> Column:
    """Consecutive points (a, b), with the closing edge where ``closed``."""
    n = F.size("points")
    rest = F.slice("points", F.lit(2), n - 1)
    to = F.when(closed, F.concat(rest, F.slice("points", 1, 1))).otherwise(rest)
    return F.arrays_zip(F.slice("points", F.lit(1), F.size(to)).alias("a"), to.alias("b"))


def strokes(subs: DataFrame) -> DataFrame:
    """Capsules (x1, y1, x2, y2, half) along stroked subpaths; one point is a dot."""
    one = F.size("points") == 1
    rows = subs.where("stroke <> 0").select("board_id", "layer", (F.col("ord") * 2).alias("ord"), "part", F.when(one, "dot").otherwise("seg").alias("kind"), F.col("stroke").alias("polarity"), "half", F.explode(_edges(F.col("closed") | one)).alias("e"))
    return rows.select("board_id", "layer", "ord", "part", "kind", "polarity", F.array("e.a.x", "e.a.y", "e.b.x", "e.b.y", "half").alias("coords"))


def filled(subs: DataFrame) -> DataFrame:
    """Filled subpaths of three or more points with the circle that fits them
    (cx, cy, radius), and ``dot`` where it fits and no box of the same element
    meets it: there, a disc is exact whatever the other subpaths fill."""
    n = F.size("points")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / n
    along = lambda c: F.transform("points", lambda p: p[c])
    middle = F.struct(*(total(along(c)).alias(f"c{c}") for c in "xy"))
    away = lambda m: F.transform("points", lambda p: F.hypot(p["x"] - m["cx"], p["y"] - m["cy"]))
    worst = lambda d, r: F.array_max(F.transform(d, lambda v: F.abs(v - r)))
    fit = lambda m, d, r: F.struct(m["cx"].alias("cx"), m["cy"].alias("cy"), r.alias("radius"), worst(d, r).alias("worst"))
    s = subs.where((F.col("fill") != 0) & (n >= 3)).withColumn("fit", _let(middle, lambda m: _let(away(m), lambda d: _let(total(d), lambda r: fit(m, d, r)))))
    s = s.select(*subs.columns, "fit.cx", "fit.cy", "fit.radius", "fit.worst")
    s = s.withColumn("circle", (n >= LEAST_POINTS) & (F.col("radius") > 0) & (F.col("worst") <= F.greatest(F.col("tol") * 3, ROUND * F.col("radius")))).drop("worst")
    cell = F.greatest("w", "h") / CELLS
    at = lambda c: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(F.col(c) / cell).cast("int")))
    boxes = s.where("parts > 1").select(*KEY, "part", "circle", "x0", "y0", "x1", "y1", F.explode(F.sequence(at("x0"), at("x1"))).alias("gx"), "w", "h").withColumn("gy", F.explode(F.sequence(at("y0"), at("y1"))))
    a = boxes.where("circle").select(*KEY, "gx", "gy", F.col("part").alias("p"), *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")))
    meet = a.join(boxes, [*KEY, "gx", "gy"]).where("p <> part AND ax0 <= x1 AND ax1 >= x0 AND ay0 <= y1 AND ay1 >= y0")
    crowded = meet.select(*KEY, F.col("p").alias("part"), F.lit(True).alias("crowded")).distinct()
    return s.join(crowded, [*KEY, "part"], "left").withColumn("dot", F.col("circle") & F.col("crowded").isNull())


def discs(fills: DataFrame) -> DataFrame:
    return fills.where("dot").select("board_id", "layer", (F.col("ord") * 2 + 1).alias("ord"), "part", F.lit("dot").alias("kind"), F.col("fill").alias("polarity"), F.array("cx", "cy", "cx", "cy", "radius").alias("coords"))


def fans(fills: DataFrame) -> DataFrame:
    """Triangles (anchor, a, b) of an even-odd fill: the anchor is the first point
    of the element's first subpath here, and every edge gives one triangle."""
    rest = fills.where("NOT dot").withColumn("anchor", F.first(F.col("points")[0]).over(W.partitionBy(*KEY).orderBy("part")))
    rows = rest.select("board_id", "layer", (F.col("ord") * 2 + 1).alias("ord"), "part", F.lit("tri").alias("kind"), F.col("fill").alias("polarity"), "anchor", F.explode(_edges(F.lit(True))).alias("e")).where("e.a <> e.b")
    return rows.select("board_id", "layer", "ord", "part", "kind", "polarity", F.array("anchor.x", "anchor.y", "e.a.x", "e.a.y", "e.b.x", "e.b.y").alias("coords"))


def primitives(subs: DataFrame) -> DataFrame:
    """(board_id, layer, ord, part, kind, polarity, coords) in the order of ord:
    an element's stroke, then its fill."""
    f = filled(subs)
    return strokes(subs).unionByName(discs(f)).unionByName(fans(f))


def areas(subs: DataFrame) -> DataFrame:
    """Fans as areas for ``vector.attribute_fills``, sampled at their box's middle."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return filled(subs).where("NOT dot").select("board_id", "layer", F.struct("ord", "part").alias("fill"), F.col("fill").alias("polarity"), "x0", "y0", "x1", "y1", mid("x0", "x1").alias("sx"), mid("y0", "y1").alias("sy"))


def bounds(prims: DataFrame) -> DataFrame:
    """Primitives with their box."""
    c = lambda i: F.col("coords")[i]
    tri = F.col("kind") == "tri"
    lo = lambda i: F.when(tri, F.least(c(i), c(i + 2), F.get("coords", F.lit(i + 4)))).otherwise(F.least(c(i), c(i + 2)) - c(4))
    hi = lambda i: F.when(tri, F.greatest(c(i), c(i + 2), F.get("coords", F.lit(i + 4)))).otherwise(F.greatest(c(i), c(i + 2)) + c(4))
    return prims.select("*", lo(0).alias("x0"), lo(1).alias("y0"), hi(0).alias("x1"), hi(1).alias("y1"))


def polarity_runs(prims: DataFrame) -> DataFrame:
    """(board_id, layer, run, polarity, caps, tris, x0, y0, x1, y1): consecutive
    operations of one polarity as one run, with its size and bounds."""
    op = bounds(prims).groupBy("board_id", "layer", "ord", "polarity").agg(F.count_if(F.col("kind") != "tri").alias("caps"), F.count_if(F.col("kind") == "tri").alias("tris"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    order = W.partitionBy("board_id", "layer").orderBy("ord")
    turn = F.when(F.lag("polarity").over(order) == F.col("polarity"), 0).otherwise(1)
    run = op.withColumn("turn", turn).withColumn("run", F.sum("turn").over(order).cast("int"))
    return run.groupBy("board_id", "layer", "run", "polarity").agg(F.sum("caps").alias("caps"), F.sum("tris").alias("tris"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))


def stats(docs: DataFrame, els: DataFrame, prims: DataFrame) -> DataFrame:
    """(board_id, layer, elements, backgrounds, unknown, segs, dots, tris)."""
    key = ["board_id", "layer"]
    e = els.groupBy(key).agg(F.count_if("background").alias("backgrounds"), F.count_if((F.col("fill") == 0) & (F.col("stroke") == 0)).alias("unknown"))
    p = prims.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("seg", "dot", "tri")))
    rows = docs.select(*key, F.size("tags").cast("long").alias("elements")).join(e, key, "left").join(p, key, "left")
    return rows.fillna(0, ["backgrounds", "unknown", "segs", "dots", "tris"])
