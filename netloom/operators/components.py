"""Connected copper on a layer: 4-neighbour labelling of runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.storage import stored


class Forest:
    """Union-find with path halving; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def overlapping(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the runs, sorted by (y, x0) and apart, that overlap with i on the
    row above j: those of the row above lie between two searches."""
    wide = int(x1.max(initial=0)) + 1
    above = (y - 1) * wide
    first = np.searchsorted(y * wide + x1, above + x0, side="right")
    n = np.maximum(0, np.searchsorted(y * wide + x0, above + x1, side="left") - first)
    j = np.repeat(np.arange(len(y)), n)
    return np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), j


def _label_layer(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
    y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    forest = Forest(len(pdf))
    for i, j in zip(*(x.tolist() for x in overlapping(y, x0, x1)), strict=True):
        forest.join(i, j)
    roots = np.array([forest.find(i) for i in range(len(y))])
    # rows come in raster order, so roots rise with each component's first pixel
    return pdf.assign(component=(np.unique(roots, return_inverse=True)[1] + 1).astype("int32"))


def label(runs: DataFrame) -> DataFrame:
    """Runs with ``component``, numbered from 1 by first pixel in raster order.

    A group is one layer of one board, bounded by its canvas; for a layer that
    outgrows an executor use label_distributed().
    """
    out = runs.select("board_id", "layer", "y", "x0", "x1")
    return out.groupBy("board_id", "layer").applyInPandas(_label_layer, "board_id int, layer string, y int, x0 int, x1 int, component int")


def adjacent(a: DataFrame, b: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs of overlapping runs on consecutive rows: an equi-join on the row."""
    upper = a.select("board_id", "layer", (F.col("y") + 1).alias("y"), *(F.col(c).alias(f"u_{c}") for c in ["x0", "x1", *extra]))
    return upper.join(b, ["board_id", "layer", "y"]).where("u_x0 < x1 AND x0 < u_x1")


def label_distributed(runs: DataFrame, strip: int = 4096) -> DataFrame:
    """The same labels without grouping a layer in one task.

    Strips of ``strip`` rows are labelled alone.  Pieces that meet across a seam
    are edges of a graph, which has no more nodes than the seams have runs; one
    contraction a layer joins them.  A component is numbered by its first piece:
    pieces before it in its strip, after all of the strips above.
    """
    on = ["board_id", "layer"]
    cut = runs.select(*on, F.floor(F.col("y") / strip).cast("int").alias("strip"), "y", "x0", "x1")
    schema = "board_id int, layer string, strip int, y int, x0 int, x1 int, component int"
    local = stored(cut.groupBy(*on, "strip").applyInPandas(_label_layer, schema), "strips")
    seam = adjacent(local.where(F.col("y") % strip == strip - 1), local.where(F.col("y") % strip == 0), ["component"])
    edges = seam.select(*on, (F.col("strip") - 1).alias("a_strip"), F.col("u_component").alias("a"), F.col("strip").alias("b_strip"), F.col("component").alias("b")).distinct()

    def contract(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [list(zip(pdf[f"{e}_strip"], pdf[e], strict=True)) for e in "ab"]
        nodes = sorted({*ends[0], *ends[1]})
        at = {n: i for i, n in enumerate(nodes)}
        forest = Forest(len(nodes))
        for a, b in zip(*ends, strict=True):
            forest.join(at[a], at[b])
        roots = [nodes[forest.find(i)] for i in range(len(nodes))]
        return pd.DataFrame({"board_id": pdf["board_id"].iloc[0], "layer": pdf["layer"].iloc[0], "strip": [n[0] for n in nodes], "component": [n[1] for n in nodes], "to_strip": [r[0] for r in roots], "to": [r[1] for r in roots]})

    joined = stored(edges.groupBy(on).applyInPandas(contract, "board_id int, layer string, strip int, component int, to_strip int, to int"), "joined")
    own = joined.where("strip = to_strip AND component = to").select(*on, "strip", "component", F.lit(True).alias("own"))
    pieces = local.select(*on, "strip", "component").distinct().join(joined.select(*on, "strip", "component", F.lit(True).alias("met")), [*on, "strip", "component"], "left").join(own, [*on, "strip", "component"], "left")
    heads = pieces.where("met IS NULL OR own")
    above = F.sum("n").over(W.partitionBy(*on).orderBy("strip").rowsBetween(W.unboundedPreceding, -1))
    before = heads.groupBy(*on, "strip").agg(F.count("*").alias("n")).select(*on, "strip", F.coalesce(above, F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy(*on, "strip").orderBy("component"))
    numbered = heads.select(*on, "strip", "component", rank.alias("rank")).join(before, [*on, "strip"]).select(*on, F.col("strip").alias("to_strip"), F.col("component").alias("to"), (F.col("rank") + F.col("before")).cast("int").alias("number"))
    led = local.join(joined, [*on, "strip", "component"], "left").withColumns({"to_strip": F.coalesce("to_strip", "strip"), "to": F.coalesce("to", "component")})
    return led.join(numbered, [*on, "to_strip", "to"]).select(*on, "y", "x0", "x1", F.col("number").alias("component"))


def stats(labelled: DataFrame) -> DataFrame:
    """Area, half-open bounding box and centroid of every component."""
    n, x = F.col("x1") - F.col("x0"), (F.col("x0") + F.col("x1") - 1) / 2
    return labelled.groupBy("board_id", "layer", "component").agg(
        F.sum(n).alias("area_px"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"),
        (F.sum(x * n) / F.sum(n)).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"),
    )
