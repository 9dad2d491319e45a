"""Drawings as masks: what a viewer would fill, pixel by pixel, as runs.

A pixel is set by its centre.  Shapes become spans, a row at a time: the edges
of an even-odd fill cross a row's middle and a window pairs the crossings; a
capsule (a stroke, a disc) is convex, so its span goes from the least to the
greatest of where its round ends and long sides meet the row.  Spans of later
elements lie on earlier ones, whether they add copper or erase it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators import artwork
from netloom.storage import stored

KEY = ("board_id", "layer")
BAND = 64
SPANS = [*KEY, "y", "ord", "polarity", "x0", "x1"]


def _rows(low, high):
    """Rows of the canvas whose middle lies from ``low`` to ``high``."""
    first, last = F.greatest(F.lit(0), F.ceil(low - 0.5).cast("int")), F.least(F.ceil("h").cast("int") - 1, F.floor(high - 0.5).cast("int"))
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def fill_spans(fills: DataFrame) -> DataFrame:
    """Spans of even-odd fills: all subpaths of an element that aren't discs."""
    e = fills.where("NOT dot").select(*KEY, "w", "h", (F.col("ord") * 2 + 1).alias("ord"), F.col("fill").alias("polarity"), F.explode(artwork._edges(F.lit(True))).alias("e"))
    e = e.where("e.a.y <> e.b.y").select(*KEY, "w", "h", "ord", "polarity", *(F.when(F.col("e.a.y") < F.col("e.b.y"), F.col(f"e.{p}.{c}")).otherwise(F.col(f"e.{q}.{c}")).alias(f"{c}{i}") for i, (p, q) in enumerate(("ab", "ba")) for c in "xy"))
    # an edge has its upper end and not its lower one
    at = e.select("*", _rows(F.col("y0"), F.col("y1")).alias("y")).where("y + 0.5 < y1")
    x = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    order = W.partitionBy(*KEY, "ord", "y").orderBy("x")
    paired = at.withColumn("x", x).withColumn("n", F.row_number().over(order)).withColumn("to", F.lead("x").over(order)).where("n % 2 = 1")
    return paired.select(*KEY, "w", "y", "ord", "polarity", F.ceil(F.col("x") - 0.5).cast("int").alias("x0"), F.ceil(F.col("to") - 0.5).cast("int").alias("x1"))


def capsule_spans(capsules: DataFrame) -> DataFrame:
    """Spans of (x1, y1, x2, y2, half) in ``coords``, of rows with w and h."""
    c = lambda i: F.col("coords")[i]
    rows = capsules.select("*", _rows(F.least(c(1), c(3)) - c(4), F.greatest(c(1), c(3)) + c(4)).alias("y"))
    mid, dx, dy = F.col("y") + 0.5, c(2) - c(0), c(3) - c(1)
    long = F.hypot(dx, dy)
    found = []
    for x, y in ((c(0), c(1)), (c(2), c(3))):
        off = mid - y
        reach = F.sqrt(c(4) * c(4) - off * off)
        found += [F.when(F.abs(off) <= c(4), x + s * reach) for s in (-1, 1)]
    for side in (-1, 1):  # a level side lies between the round ends' outermost points
        y = c(1) + side * dx * c(4) / long
        t = (mid - y) / dy
        found.append(F.when((dy != 0) & (t >= 0) & (t <= 1), c(0) - side * dy * c(4) / long + t * dx))
    rows = rows.withColumn("x", F.filter(F.array(*found), lambda v: v.isNotNull())).where(F.size("x") > 0)
    return rows.select(*KEY, "w", "y", "ord", "polarity", F.ceil(F.array_min("x") - 0.5).cast("int").alias("x0"), (F.floor(F.array_max("x") - 0.5) + 1).cast("int").alias("x1"))


def spans(subs: DataFrame) -> DataFrame:
    """Spans of every stroke and fill of ``artwork.subpaths``, cut at the canvas."""
    fills = artwork.filled(subs)
    size = subs.select(*KEY, "w", "h").distinct()
    capsules = artwork.strokes(subs).unionByName(artwork.discs(fills)).join(size, [*KEY])
    both = capsule_spans(capsules).unionByName(fill_spans(fills))
    wide = F.ceil("w").cast("int")
    cut = both.select(*KEY, wide.alias("w"), "y", "ord", "polarity", F.greatest(F.lit(0), "x0").alias("x0"), F.least(wide, "x1").alias("x1"))
    return cut.where("x0 < x1")


def paint(spans_: DataFrame, band: int = BAND) -> DataFrame:
    """Runs of what is left when spans are laid down in the order of ``ord``.  A
    group is a band of ``band`` rows of one layer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(pdf["y"].min())
        grid = np.zeros((int(pdf["y"].max()) - top + 1, int(pdf["w"].iloc[0])), bool)
        pdf = pdf.sort_values("ord", kind="stable")
        for y, x0, x1, on in zip((pdf["y"] - top).tolist(), pdf["x0"].tolist(), pdf["x1"].tolist(), (pdf["polarity"] > 0).tolist(), strict=True):
            grid[y, x0:x1] = on
        edge = np.diff(np.pad(grid.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        return pd.DataFrame({"board_id": pdf["board_id"].iloc[0], "layer": pdf["layer"].iloc[0], "y": (y + top).astype("int32"), "x0": x0.astype("int32"), "x1": x1.astype("int32")})

    rows = spans_.withColumn("band", F.floor(F.col("y") / band))
    return rows.groupBy(*KEY, "band").applyInPandas(run, "board_id int, layer string, y int, x0 int, x1 int")


def rasterise(svgs: DataFrame) -> DataFrame:
    """Masks (board_id, layer, y, x0, x1) of drawings (board_id, layer, svg)."""
    return paint(spans(stored(artwork.subpaths(artwork.elements(artwork.documents(svgs))), "subpaths")))
