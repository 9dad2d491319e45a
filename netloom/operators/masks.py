"""Mask algebra on run-length rows (board_id, layer, y, x0, x1), x1 exclusive.

Background is the absence of a row.  Every operation shuffles on row keys at
most, so boards and rows spread over the cluster, and none grows with pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW = ("board_id", "layer", "y")


def merge_runs(spans: DataFrame) -> DataFrame:
    """Union of overlapping or touching spans of a row: gaps and islands."""
    order = W.partitionBy(*ROW).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)
    marked = spans.where("x0 < x1").select(*ROW, "x0", "x1", new.alias("new"))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*ROW, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def complement(runs: DataFrame, layers: DataFrame) -> DataFrame:
    """The background of ``layers(board_id, layer, w, h)`` as runs."""
    edge = layers.select("board_id", "layer", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.lit(-1).alias("x0"), F.lit(0).alias("x1"))
    rows = runs.select(*ROW, "x0", "x1").unionByName(edge).join(layers.select("board_id", "layer", "w"), ["board_id", "layer"])
    ahead = F.lead("x0").over(W.partitionBy(*ROW).orderBy("x0"))
    return rows.select(*ROW, F.col("x1").alias("x0"), F.coalesce(ahead, F.col("w")).alias("x1")).where("x0 < x1")


def shift(runs: DataFrame, offsets: DataFrame, canvas: DataFrame, how: str = "inner") -> DataFrame:
    """Runs moved by ``offsets(board_id, [layer,] dy, dx)`` and clipped to the
    canvas.  With ``how`` left, runs without an offset stay where they are."""
    key = [c for c in ("board_id", "layer") if c in offsets.columns]
    rows = runs.join(offsets.select(*key, "dy", "dx"), key, how).fillna(0, ["dy", "dx"]).join(canvas, "board_id")
    moved = rows.select(
        "board_id", "layer", (F.col("y") + F.col("dy")).alias("y"), F.greatest(F.lit(0), F.col("x0") + F.col("dx")).alias("x0"),
        F.least(F.col("w"), F.col("x1") + F.col("dx")).alias("x1"), "h",
    )
    return moved.where("y >= 0 AND y < h AND x0 < x1").drop("h")


def union_layers(runs: DataFrame, name: str, rule: Column | None = None) -> DataFrame:
    """OR of the layers that ``rule`` admits, as one layer."""
    chosen = runs if rule is None else runs.where(rule)
    return merge_runs(chosen.withColumn("layer", F.lit(name)))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND of a's runs with b's mask; b's layer doesn't matter, a's stays."""
    r = b.select("board_id", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    hit = a.join(r, ["board_id", "y"]).where("x0 < b1 AND b0 < x1")
    return hit.select(*ROW, F.greatest("x0", "b0").alias("x0"), F.least("x1", "b1").alias("x1"))


def punch(a: DataFrame, b: DataFrame, canvas: DataFrame) -> DataFrame:
    """AND NOT: a's runs where b (one layer a board) has none."""
    holes = union_layers(b, "holes")
    free = complement(holes, canvas.withColumn("layer", F.lit("holes")))
    return intersect(a, free)


def fill(runs: DataFrame, layers: DataFrame) -> DataFrame:
    """Area and fill of every layer of ``layers(board_id, layer, w, h)``."""
    area = runs.groupBy("board_id", "layer").agg(F.sum(F.col("x1") - F.col("x0")).alias("area_px"))
    rows = layers.join(area, ["board_id", "layer"], "left")
    n = F.coalesce("area_px", F.lit(0)).cast("long")
    return rows.select("board_id", "layer", n.alias("area_px"), (n / (F.col("w") * F.col("h"))).alias("fill"))


def layer_canvas(canvas: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """canvas with a row for every layer."""
    return canvas.withColumn("layer", F.explode(F.array(*map(F.lit, layers))))


def mismatched(sizes: DataFrame) -> DataFrame:
    """Boards whose layers (board_id, layer, w, h) don't share one size."""
    return sizes.groupBy("board_id").agg(F.count_distinct("w", "h").alias("sizes")).where("sizes > 1")


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Runs of (board_id, layer, y, x) rows."""
    return merge_runs(pixels.select(*ROW, F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")))


def to_pixels(runs: DataFrame) -> DataFrame:
    return runs.select(*ROW, F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def visual_drill(raw: DataFrame, via: DataFrame, names: DataFrame, manual: DataFrame, canvas: DataFrame) -> DataFrame:
    """Holes that a viewer shows empty, for ``names(board_id, drill_name, via_name)``:
    the connector mask, aligned already, where it is the drill mask too, else
    the drill mask moved by ``manual(board_id, dy, dx)`` alone."""
    same = names.where("drill_name = via_name").select("board_id")
    other = names.where("drill_name <> via_name").select("board_id")
    by = other.join(manual, "board_id", "left").fillna(0, ["dy", "dx"])
    kept = via.join(same, "board_id", "left_semi").select(*ROW, "x0", "x1")
    return kept.unionByName(shift(raw, by, canvas)).withColumn("layer", F.lit("holes"))
