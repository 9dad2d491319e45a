"""Netmap text back to rectangles.

A netmap is an SVG whose groups, named by data-layer, hold a path for every net
(data-net-id).  A path's data is a chain of pieces, each a rectangle "M x y H x
V y H x Z"; numbers may stand after spaces or commas.  What counts of a path is
its longest well-formed beginning: pieces end in Z, so data is split there and
cut before the first piece that is no rectangle.  A group reaches to the last
</g> before the next group.  Attributes come in any order and either quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[ ,]*([-.0-9]*)"
PIECE = f"^[ ,]*M{NUMBER}{NUMBER}H{NUMBER}V{NUMBER}H{NUMBER}$"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, line ends included; '' if there is none."""
    rx = rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.concat(F.regexp_extract(tag, rx, 1), F.regexp_extract(tag, rx, 2))


def opening(element: str) -> str:
    """Pattern of an element's opening tag; quoted values may hold any sign."""
    return rf"""<{element}(?=[\s/>])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""


def number(text: Column) -> Column:
    """The number that a text begins with; 0 if it begins with none."""
    return F.coalesce(F.regexp_extract(text, r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double"), F.lit(0.0))


def paths(maps: DataFrame) -> DataFrame:
    """(board_id, w, h, layer, gi, pi, net, pieces, odd) of every net's path:
    its rectangles' data, and whether anything but blanks follows them."""
    size = F.split(F.trim(attribute(F.regexp_extract("svg", opening("svg"), 0), "viewBox")), r"[\s,]+")
    side = lambda i: F.floor(F.get(size, F.lit(i)).try_cast("double") + 0.5).cast("int")
    group = F.posexplode(F.split("svg", r"(?=<g\s[^<>]*?\bdata-layer\s*=)"))
    g = maps.select("board_id", side(2).alias("w"), side(3).alias("h"), group.alias("at", "part")).where("w > 0 AND h > 0 AND at > 0")
    g = g.withColumn("layer", F.nullif(attribute(F.regexp_extract("part", "^" + opening("g"), 0), "data-layer"), F.lit("")))
    named = g.where("layer IS NOT NULL").withColumn("body", F.regexp_extract("part", r"^([\s\S]*)</g>", 1))
    one = named.select("board_id", "w", "h", "layer", F.col("at").alias("gi"), F.posexplode(F.regexp_extract_all("body", F.lit(opening("path")), F.lit(0))).alias("pi", "tag"))
    one = one.select("board_id", "w", "h", "layer", "gi", "pi", attribute(F.col("tag"), "data-net-id").alias("id"), F.split(attribute(F.col("tag"), "d"), "Z").alias("all")).where(F.col("id").rlike("^[0-9]+$"))
    whole = F.slice("all", F.lit(1), F.size("all") - 1)  # no Z ends the last part
    bad = F.array_position(F.transform(whole, lambda p: p.rlike(PIECE)), False).cast("int")
    good = F.when(bad > 0, F.slice(whole, F.lit(1), bad - 1)).otherwise(whole)
    odd = (bad > 0) | ~F.element_at("all", -1).rlike("^[ ,]*$")
    return one.select("board_id", "w", "h", "layer", "gi", "pi", F.col("id").cast("int").alias("net"), good.alias("pieces"), odd.alias("odd"))


def parse_netmap(maps: DataFrame, shift: int = 0) -> DataFrame:
    """Rectangles of ``maps(board_id, svg)`` in cells of 2**shift: (board_id,
    layer, net, ord, x0, y0, x1, y1); later ones overwrite earlier ones.  Every
    rectangle has a cell at least, within the canvas."""
    r = paths(maps).select("board_id", "layer", "net", "gi", "pi", F.shiftright("w", shift).alias("w"), F.shiftright("h", shift).alias("h"), F.posexplode("pieces").alias("ri", "m"))
    cell = lambda i: F.shiftright(F.floor(number(F.regexp_extract("m", PIECE, i)) + 0.5).cast("int"), shift)
    first = lambda i, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), cell(i)))
    stop = lambda i, n, a: F.least(F.col(n), F.greatest(a + 1, cell(i)))
    x, y = first(1, "w"), first(2, "h")
    order = F.col("gi").cast("long") * (1 << 40) + F.col("pi").cast("long") * (1 << 20) + F.col("ri")
    return r.select("board_id", "layer", "net", order.alias("ord"), x.alias("x0"), y.alias("y0"), stop(3, "w", x).alias("x1"), stop(4, "h", y).alias("y1"))


def netmap_stats(maps: DataFrame) -> DataFrame:
    """(board_id, paths, rects, odd_paths, max_net) of every map."""
    p = paths(maps).groupBy("board_id").agg(F.count("*").alias("paths"), F.sum(F.size("pieces")).alias("rects"), F.count_if("odd").alias("odd_paths"), F.max("net").alias("max_net"))
    rows = maps.select("board_id").distinct().join(p, "board_id", "left")
    return rows.fillna(0, ["paths", "rects", "odd_paths", "max_net"])


def odd_paths(maps: DataFrame) -> DataFrame:
    """(board_id, paths, odd_paths): paths that aren't rectangles throughout."""
    return netmap_stats(maps).select("board_id", "paths", "odd_paths")
