"""What a viewer draws to show a net: geometry of all nets at once.

A net is shown by its own areas and by the erasures that take something from
them, in drawing order.  An erasure belongs to a net where its box meets that of
an operation of the net which comes before it; others can't change the net's
pixels.  Boxes meet through a grid, so no net is held against all erasures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import artwork, vector
from netloom.storage import stored

KEY = ["board_id", "layer"]
GRID = 64
#: Boxes that share less than this in either direction only touch.
TOUCH = 1e-6


def attributed(subs: DataFrame, net_runs: DataFrame, canvas: DataFrame, cells: float = 1.0) -> DataFrame:
    """``artwork.primitives`` with the net that each belongs to: 0 for erasures
    and for areas without a net within reach.  ``cells`` is a drawing unit in pixels."""
    fills = stored(artwork.filled(subs), "fills")
    caps = artwork.strokes(subs).unionByName(artwork.discs(fills))
    own = F.struct("ord", "part", "coords")
    seg = caps.select(*KEY, own.alias("seg"), "polarity", *(F.col("coords")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2")))).distinct()
    of_caps = vector.attribute_segments(seg, net_runs, canvas, cells).select(*KEY, "seg.*", "net")
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    area = fills.where("NOT dot").select(*KEY, F.struct("ord", "part").alias("fill"), F.col("fill").alias("polarity"), "x0", "y0", "x1", "y1", mid("x0", "x1").alias("sx"), mid("y0", "y1").alias("sy"))
    of_fills = vector.attribute_fills(area, net_runs, canvas, cells).select(*KEY, (F.col("fill.ord") * 2 + 1).alias("ord"), "fill.part", "net")
    both = caps.join(of_caps, [*KEY, "ord", "part", "coords"], "left").unionByName(artwork.fans(fills).join(of_fills, [*KEY, "ord", "part"], "left"))
    return both.select(*KEY, "ord", "part", "kind", "polarity", "coords", F.coalesce("net", F.lit(0)).alias("net"))


def by_net(prims: DataFrame, canvas: DataFrame, cells: float = 1.0) -> DataFrame:
    """(board_id, layer, net, ord, part, kind, polarity, coords) of every net of
    ``attributed`` primitives.  An even-odd erasure comes whole or not at all."""
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    held = artwork.bounds(prims)
    size = canvas.select("board_id", (F.greatest("w", "h") / (cells * GRID)).alias("cell"))
    at = lambda c: F.least(F.lit(GRID - 1), F.greatest(F.lit(0), F.floor(F.col(c) / F.col("cell")).cast("int")))

    def spread(ops: DataFrame) -> DataFrame:
        row = ops.join(size, "board_id").select("*", F.explode(F.sequence(at("x0"), at("x1"))).alias("gx"))
        return row.select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("gy")).drop("cell")

    mine = spread(held.where("polarity = 1 AND net > 0").groupBy(*KEY, "net", "ord").agg(*box))
    off = spread(held.where("polarity = -1").groupBy(*KEY, "ord").agg(*box))
    off = off.select(*KEY, "gx", "gy", F.col("ord").alias("e_ord"), *(F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")))
    meets = [F.col(f"{a}{c}0") + TOUCH < F.col(f"{b}{c}1") for c in "xy" for a, b in (("", "e_"), ("e_", ""))]
    hits = mine.join(off, [*KEY, "gx", "gy"]).where((F.col("e_ord") > F.col("ord")) & meets[0] & meets[1] & meets[2] & meets[3])
    taken = hits.select(*KEY, "net", F.col("e_ord").alias("ord")).distinct()
    out = [*KEY, "net", "ord", "part", "kind", "polarity", "coords"]
    erased = prims.where("polarity = -1").drop("net").join(taken, [*KEY, "ord"]).select(*out)
    return prims.where("polarity = 1 AND net > 0").select(*out).unionByName(erased)
