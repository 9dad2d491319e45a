"""Audits of the inputs: polarity of layers, alignment of the drill mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import components, masks
from netloom.storage import stored

#: Limits of the verdicts.
INVERTED, NORMAL = 0.6, 0.4
HEALTHY, POOR, GAIN = 0.90, 0.60, 0.10


def polarity(fills: DataFrame, outer: tuple[str, ...] = ("F_Cu", "B_Cu")) -> DataFrame:
    """Verdict on each layer's fill: none, warn, invert or ambiguous."""
    is_outer, f = F.col("layer").isin(*outer), F.col("fill")
    v = F.when(is_outer & (f > INVERTED), "warn").when(is_outer, "none").when(f > INVERTED, "invert").when(f < NORMAL, "none").otherwise("ambiguous")
    return fills.withColumn("verdict", v)


def resolve_invert(verdicts: DataFrame, auto: bool = True, force: tuple[str, ...] = (), forbid: tuple[str, ...] = ()) -> DataFrame:
    """Whether a layer is inverted, and who said so; opposite orders keep it."""
    on, off = F.col("layer").isin(*force), F.col("layer").isin(*forbid)
    by_auto = F.lit(auto) & (F.col("verdict") == "invert")
    source = F.when(on | off, "override").otherwise(F.lit("auto" if auto else "none"))
    return verdicts.select("*", ((on & ~off) | (~on & ~off & by_auto)).alias("invert"), source.alias("source"), (on & off).alias("conflict"))


def prepare(runs: DataFrame, layers: DataFrame, corrections: DataFrame) -> DataFrame:
    """Runs with the layers that ``corrections`` inverts replaced by their background."""
    flip = corrections.where("invert").select("board_id", "layer")
    kept = runs.join(flip, ["board_id", "layer"], "left_anti")
    turned = masks.complement(runs.join(flip, ["board_id", "layer"], "left_semi"), layers.join(flip, ["board_id", "layer"]))
    return kept.unionByName(turned)


def overlay(runs: DataFrame, drill: DataFrame, canvas: DataFrame) -> DataFrame:
    """The audit overlay of the whole canvas as runs with their colour: copper of
    any layer grey, drilled areas pure red on top.  Black is the absence of a run."""
    copper = masks.union_layers(runs, "audit")
    colours = lambda df, red, rest: df.select(*masks.ROW, "x0", "x1", F.lit(red).alias("red"), F.lit(rest).alias("green_blue"))
    return colours(masks.punch(copper, drill, canvas), 128, 128).unionByName(colours(masks.union_layers(drill, "audit"), 255, 0))


def outer_copper(runs: DataFrame) -> DataFrame:
    """OR of the copper that isn't an inner layer."""
    return masks.union_layers(runs, "outer", ~F.col("layer").startswith("In"))


def alignment_score(drill_runs: DataFrame, copper: DataFrame, canvas: DataFrame) -> DataFrame:
    """Share of drilled areas that touch copper; 1 without any."""
    lab = components.label(drill_runs)
    n = lab.groupBy("board_id").agg(F.count_distinct("component").alias("n"))
    c = copper.select("board_id", "y", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    t = lab.join(c, ["board_id", "y"]).where("x0 < c1 AND c0 < x1").groupBy("board_id").agg(F.count_distinct("component").alias("t"))
    rows = canvas.select("board_id").join(n, "board_id", "left").join(t, "board_id", "left")
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0))
    return rows.select("board_id", n.cast("long").alias("n_drills"), t.cast("long").alias("touches"), F.when(n == 0, 1.0).otherwise(t / n).alias("score"))


def correlation(drill: np.ndarray, copper: np.ndarray) -> np.ndarray:
    """How many drill pixels lie on copper at each displacement: entry (i, j) for
    a drill mask moved by i - h + 1 rows and j - w + 1 columns against the corner
    of the copper mask, h by w being the drill mask's size.

    Made by real transforms in doubles.  The masks hold 0 and 1, so a rounding
    error is below 2**-52 * log2(n) * sqrt(drill area * copper area), far under
    the half that rint() forgives.
    """
    h, w = (drill.shape[i] + copper.shape[i] - 1 for i in (0, 1))
    size = [1 << (n - 1).bit_length() for n in (h, w)]
    product = np.fft.rfft2(copper, size) * np.fft.rfft2(drill[::-1, ::-1], size)
    return np.rint(np.fft.irfft2(product, size)[:h, :w]).astype(np.int64)


def raster(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(mask of the runs' bounding box, its top, its left)."""
    top, left = int(y.min()), int(x0.min())
    edge = np.zeros((int(y.max()) - top + 1, int(x1.max()) - left + 1), np.int32)
    np.add.at(edge, (y - top, x0 - left), 1)
    np.add.at(edge, (y - top, x1 - left), -1)
    return np.cumsum(edge, axis=1)[:, :-1] > 0, top, left


def best_offset(drill: pd.DataFrame, copper: pd.DataFrame, most: int) -> tuple[int, int]:
    """(dy, dx) of one small board in memory that puts most drill pixels on copper."""
    sides = [raster(*(df[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))) for df in (drill, copper)]
    (d, d_top, d_left), (c, c_top, c_left) = sides
    found = correlation(d.astype(float), c.astype(float))
    dy = c_top - d_top - len(d) + 1 + np.arange(len(found))
    dx = c_left - d_left - d.shape[1] + 1 + np.arange(found.shape[1])
    found[np.abs(dy) > most] = 0
    found[:, np.abs(dx) > most] = 0
    i, j = np.unravel_index(found.argmax(), found.shape)
    return (int(dy[i]), int(dx[j])) if found[i, j] else (0, 0)


def overlaps(drill_runs: DataFrame, copper: DataFrame, canvas: DataFrame, most: int, tile: int) -> DataFrame:
    """(board_id, dy, first, counts): overlaps by displacement, summed over the
    tiles that a task had; counts are 64-bit from dx = first on.

    The drill mask is cut into tiles.  A tile meets the copper within ``most``
    pixels of it, so its work depends on its size, not on runs or board.
    """
    at = lambda c, d=0: F.floor((F.col(c) + d) / tile).cast("int")
    cut = lambda df: df.select("board_id", "y", "x0", "x1")
    d = cut(drill_runs).select("*", at("y").alias("ty"), F.explode(F.sequence(at("x0"), at("x1", -1))).alias("tx"))
    d = d.select("board_id", "ty", "tx", F.lit(0).alias("side"), "y", F.greatest("x0", F.col("tx") * tile).alias("x0"), F.least("x1", (F.col("tx") + 1) * tile).alias("x1"))
    c = cut(copper).select("*", F.explode(F.sequence(at("y", -most), at("y", most))).alias("ty")).select("*", F.explode(F.sequence(at("x0", -most), at("x1", most - 1))).alias("tx"))
    used = d.select("board_id", "ty", "tx").distinct()
    c = c.join(used, ["board_id", "ty", "tx"], "left_semi").select("board_id", "ty", "tx", F.lit(1).alias("side"), "y", "x0", "x1")
    keys = ["board_id", "ty", "tx"]
    rows = d.unionByName(c).join(canvas.select("board_id", "w", "h"), "board_id").repartition(*keys).sortWithinPartitions(*keys, "side")

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole tiles, a tile's rows being consecutive."""
        held = []
        for pdf in batches:
            new = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            for a, b in zip(new, [*new[1:], len(pdf)], strict=True):
                part = pdf.iloc[a:b]
                if held and (held[0][keys].iloc[0] != part[keys].iloc[0]).any():
                    yield pd.concat(held)
                    held = []
                held.append(part)
        if held:
            yield pd.concat(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        board, total, my, mx = None, None, 0, 0

        def flush() -> pd.DataFrame:
            some = np.flatnonzero(total.any(axis=1))
            return pd.DataFrame({"board_id": board, "dy": (some - my).astype("int32"), "first": -mx, "counts": [total[i].tobytes() for i in some]})

        for pdf in tiles(batches):
            if pdf["board_id"].iloc[0] != board:
                if total is not None:
                    yield flush()
                board, h, w = pdf["board_id"].iloc[0], int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])
                my, mx = min(most, h - 1), min(most, w - 1)
                total = np.zeros((2 * my + 1, 2 * mx + 1), np.int64)
            first, rest = ([g[c].to_numpy(np.int64) for c in ("y", "x0", "x1")] for g in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]))
            if not len(rest[0]):
                continue
            top, left = int(first[0].min()), int(first[1].min())
            bottom, right = int(first[0].max()), int(first[2].max())
            near = (rest[0] >= top - my) & (rest[0] <= bottom + my) & (rest[1] < right + mx) & (rest[2] > left - mx)
            rest = [x[near] for x in rest]
            if not len(rest[0]):
                continue
            rest[1], rest[2] = np.maximum(rest[1], left - mx), np.minimum(rest[2], right + mx)
            drill, _, _ = raster(*first)
            copper, c_top, c_left = raster(*rest)
            found = correlation(drill.astype(float), copper.astype(float))
            y0, x0 = c_top - top - len(drill) + 1 + my, c_left - left - drill.shape[1] + 1 + mx  # where found[0, 0] goes
            a, b = max(0, -y0), max(0, -x0)
            part = found[a : len(total) - y0, b : total.shape[1] - x0]
            total[y0 + a : y0 + a + part.shape[0], x0 + b : x0 + b + part.shape[1]] += part
        if total is not None:
            yield flush()

    return rows.mapInPandas(run, "board_id long, dy int, first int, counts binary")


def detect_offset(drill_runs: DataFrame, copper: DataFrame, canvas: DataFrame, most: int = 500, tile: int = 1024) -> DataFrame:
    """(board_id, dy, dx): the displacement that puts most drill pixels on copper.

    Exact cross-correlation by tiles; ties go to the lower (dy, dx); boards
    without drill or copper, or whose masks never meet, get (0, 0).
    """
    found = overlaps(drill_runs, copper, canvas, most, tile).repartition("board_id", "dy").sortWithinPartitions("board_id", "dy")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, first = None, None, 0
        out = []
        for pdf in batches:
            for board, dy, start, counts in zip(pdf["board_id"], pdf["dy"], pdf["first"], pdf["counts"], strict=True):
                if (board, dy) != at:
                    if at is not None:
                        out.append((*at, int(total.argmax()) + first, int(total.max())))
                    at, first, total = (board, dy), start, np.zeros(len(counts) // 8, np.int64)
                total += np.frombuffer(counts, np.int64)
        if at is not None:
            out.append((*at, int(total.argmax()) + first, int(total.max())))
        yield pd.DataFrame(out, columns=["board_id", "dy", "dx", "n"])

    rows = found.mapInPandas(run, "board_id long, dy int, dx int, n long")
    best = rows.groupBy("board_id").agg(F.max(F.struct("n", (-F.col("dy")).alias("up"), (-F.col("dx")).alias("back"))).alias("b"))
    best = best.select(F.col("board_id").cast(canvas.schema["board_id"].dataType), (-F.col("b.up")).alias("dy"), (-F.col("b.back")).alias("dx"))
    return canvas.select("board_id").join(best, "board_id", "left").select("board_id", F.coalesce("dy", F.lit(0)).alias("dy"), F.coalesce("dx", F.lit(0)).alias("dx"))


def alignment_verdict(n: Column, score: Column, dy: Column, dx: Column, score2: Column, auto: bool = True) -> Column:
    """none, shift or fail."""
    if not auto:
        return F.when((n == 0) | (score >= POOR), "none").otherwise("fail")
    better = ((dy != 0) | (dx != 0)) & (score2 >= HEALTHY) & (score2 > score + GAIN)
    return F.when((n == 0) | (score >= HEALTHY), "none").when(better, "shift").when(score >= POOR, "none").otherwise("fail")


def audit_alignment(drill_runs: DataFrame, runs: DataFrame, canvas: DataFrame, auto: bool = True, most: int = 500) -> DataFrame:
    """Score of each board's drill mask, the best displacement, and the verdict.
    Displacements are searched only for boards that need one."""
    copper = outer_copper(runs)
    score = stored(alignment_score(drill_runs, copper, canvas), "alignment")
    poor = score.where((F.col("score") < HEALTHY) & (F.col("n_drills") > 0)).select("board_id")
    mine = lambda df: df.join(poor, "board_id", "left_semi")
    off = stored(detect_offset(mine(drill_runs), mine(copper), mine(canvas), most), "offsets")
    moved = alignment_score(masks.shift(mine(drill_runs), off, canvas), mine(copper), mine(canvas)).select("board_id", F.col("score").alias("score2"))
    rows = score.join(off, "board_id", "left").join(moved, "board_id", "left")
    dy, dx = F.coalesce("dy", F.lit(0)), F.coalesce("dx", F.lit(0))
    v = alignment_verdict(F.col("n_drills"), F.col("score"), dy, dx, F.coalesce("score2", F.lit(0.0)), auto)
    return rows.select("board_id", "n_drills", "touches", "score", v.alias("verdict"), F.when(v == "shift", dy).otherwise(0).alias("dy"), F.when(v == "shift", dx).otherwise(0).alias("dx"))


def mask_alignment(openings: DataFrame, copper: DataFrame, canvas: DataFrame, pairs: DataFrame, most: int = 500) -> DataFrame:
    """(board_id, layer, reference, dy, dx, before, after, gain, accepted) of
    every opening that ``pairs(board_id, mask, copper)`` compares with a copper
    layer.  Each is a board of its own to ``detect_offset``: its key is a row of
    the pairs."""
    has = lambda df, name: df.select("board_id", F.col("layer").alias(name)).distinct()
    both = pairs.join(has(openings, "mask"), ["board_id", "mask"]).join(has(copper, "copper"), ["board_id", "copper"])
    both = stored(both.select(F.xxhash64("board_id", "mask").alias("key"), "board_id", "mask", "copper"), "pairs")
    runs = lambda df, side: df.withColumnRenamed("layer", side).join(both, ["board_id", side]).select(F.col("key").alias("board_id"), F.lit("m").alias("layer"), "y", "x0", "x1")
    mask, pads = runs(openings, "mask"), runs(copper, "copper")
    size = canvas.join(both, "board_id").select(F.col("key").alias("board_id"), "w", "h")
    off = stored(detect_offset(mask, pads, size, most), "offsets")
    found = mask_gain(mask, pads, masks.shift(mask, off, size), size).join(off, "board_id").withColumnRenamed("board_id", "key")
    moves = (F.col("dy") != 0) | (F.col("dx") != 0)
    return both.join(found, "key").select("board_id", F.col("mask").alias("layer"), F.col("copper").alias("reference"), "dy", "dx", "before", "after", "gain", (F.col("accepted") & moves).alias("accepted"))


def mask_gain(mask: DataFrame, pads: DataFrame, moved: DataFrame, canvas: DataFrame) -> DataFrame:
    """Overlap of a solder mask with pads before and after a displacement; it is
    accepted if it gains a tenth."""
    area = lambda a: masks.intersect(a, pads).groupBy("board_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("px"))
    rows = canvas.select("board_id").join(area(mask).withColumnRenamed("px", "before"), "board_id", "left").join(area(moved).withColumnRenamed("px", "after"), "board_id", "left")
    before, after = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    gain = (after - before) / F.greatest(before, F.lit(1))
    return rows.select("board_id", before.alias("before"), after.alias("after"), gain.alias("gain"), (gain >= GAIN).alias("accepted"))
