"""How drilled holes meet the copper around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import components

#: Thresholds of the contact and classification rules.
GAP, WIDTH = 1, 4
LEAST_COPPER, ALL_AROUND = 0.10, 0.85
PAD_COPPER, PAD_ANGLES, BINS = 0.80, 0.75, 32
LEAST_SMALL, LEAST_LARGE = 8.0, 20.0

#: What each rule of ``classify`` says, by (rule, class); %.1f is the radius.
REASONS = {
    (1, "explicit_npth"): "a mask of unplated holes was chosen, which never connect",
    (2, "explicit_pth"): "a mask of plated holes was chosen, and copper touches this one",
    (2, "explicit_pth_no_copper"): "a mask of plated holes was chosen, but no copper touches this one",
    (3, "likely_npth"): "no substantial pad ring on any layer",
    (4, "likely_npth"): "large hole (radius %.1f px) with copper on one layer at most",
    (5, "ambiguous_likely_npth"): "copper on one outer side only",
    (6, "likely_pth"): "pad rings on both outer layers",
    (7, "likely_pth"): "small hole (radius %.1f px) with partial copper around it",
    (8, "likely_pth"): "partial copper around it on several layers",
    (9, "likely_npth"): "nothing but copper all around, as in a clearance that was not drawn",
    (10, "ambiguous_likely_npth"): "partial copper on too few layers to tell",
}


def blobs(drill_labelled: DataFrame) -> DataFrame:
    """Drilled areas as (board_id, drill, area_px, radius_px, bbox, cx, cy)."""
    s = components.stats(drill_labelled).withColumnRenamed("component", "drill").drop("layer")
    return s.withColumn("radius_px", F.sqrt(F.col("area_px") / math.pi))


def thresholds(drills: DataFrame, canvas: DataFrame) -> DataFrame:
    """What counts as a small or a large radius on each board."""
    by = drills.groupBy("board_id").agg(F.percentile("radius_px", F.lit(0.6)).alias("p60"), F.percentile("radius_px", F.lit(0.9)).alias("p90"))
    rows = canvas.select("board_id").join(by, "board_id", "left")
    least = lambda p, v: F.greatest(F.lit(v), F.coalesce(p, F.lit(v)))
    return rows.select("board_id", least("p60", LEAST_SMALL).alias("small_px"), least("p90", LEAST_LARGE).alias("large_px"))


def neighbourhood(drills: DataFrame, canvas: DataFrame) -> DataFrame:
    """Pixels near each hole with their ring membership: a bounded window that
    turns the distance join into an equi-join on board and row."""
    r, cx, cy = F.col("radius_px"), F.col("cx"), F.col("cy")
    reach = r + (GAP + WIDTH)
    lo = lambda c, d: F.greatest(F.lit(0), F.floor(c - d).cast("int"))
    hi = lambda c, d, n: F.least(n - 1, F.ceil(c + d).cast("int"))
    w = drills.join(canvas, "board_id").select("board_id", "drill", "radius_px", "cx", "cy", F.explode(F.sequence(lo(cy, reach), hi(cy, reach, F.col("h")))).alias("y"), "w")
    px = w.select("*", F.explode(F.sequence(lo(cx, reach), hi(cx, reach, F.col("w")))).alias("x"))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    d = F.hypot(dy, dx)
    px = px.select(
        "board_id", "drill", "y", "x",
        ((d >= r + GAP) & (d <= reach)).alias("near"), ((d > r) & (d <= F.greatest(r + 1.0, r * 1.05))).alias("pad"),
        F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * BINS).cast("int"))).alias("bin"),
    )
    return px.where("near OR pad")


def contacts(drills: DataFrame, labelled: DataFrame, canvas: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """One row per hole and layer: touched components and ring coverage."""
    px = neighbourhood(drills, canvas)
    total = px.groupBy("board_id", "drill").agg(F.count_if("near").alias("near"), F.count_if("pad").alias("pad"), F.count_distinct(F.when(F.col("pad"), F.col("bin"))).alias("bins"))
    hit = px.join(labelled.where(F.col("layer").isin(*layers)), ["board_id", "y"]).where("x >= x0 AND x < x1")
    met = hit.groupBy("board_id", "drill", "layer").agg(
        F.count_if("near").alias("c_near"), F.count_if("pad").alias("c_pad"), F.count_distinct(F.when(F.col("pad"), F.col("bin"))).alias("c_bins"),
        F.sort_array(F.collect_set(F.when(F.col("near"), F.col("component")))).alias("ids"),
    )
    every = drills.select("board_id", "drill").withColumn("layer", F.explode(F.array(*map(F.lit, layers))))
    rows = every.join(total, ["board_id", "drill"], "left").join(met, ["board_id", "drill", "layer"], "left")
    share = lambda a, b: F.when(F.coalesce("near", F.lit(0)) > 0, F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))).otherwise(F.lit(0.0))
    frac, pad, angle = share("c_near", "near"), share("c_pad", "pad"), share("c_bins", "bins")
    none = F.array().cast("array<int>")
    return rows.select(
        "board_id", "drill", "layer", F.when(frac >= LEAST_COPPER, F.coalesce("ids", none)).otherwise(none).alias("component_ids"),
        frac.alias("copper_fraction"), pad.alias("pad_ring_fraction"), angle.alias("pad_ring_angular_coverage"),
        ((pad >= PAD_COPPER) & (angle >= PAD_ANGLES)).alias("pad_ring_contact"), contact_kind(frac).alias("contact"),
    )


def contact_kind(fraction: Column) -> Column:
    return F.when(fraction < LEAST_COPPER, "none").when(fraction >= ALL_AROUND, "all_around").otherwise("partial")


def classify(drills: DataFrame, met: DataFrame, limits: DataFrame, layers: tuple[str, ...], mode: str = "infer") -> DataFrame:
    """(board_id, drill, radius_px, plated, classification, rule) for a connector
    mode: never, explicit or infer.  The first rule that holds decides.  A
    contact without angular coverage counts as covered."""
    touching = (F.col("contact") != "none") & (F.size("component_ids") > 0)
    real = touching if mode == "explicit" else touching & (F.col("pad_ring_fraction") >= PAD_COPPER) & (F.coalesce("pad_ring_angular_coverage", F.lit(1.0)) >= PAD_ANGLES)
    on = lambda name: F.max(real & (F.col("layer") == name))
    seen = met.groupBy("board_id", "drill").agg(
        F.count_if(real).alias("n"), on(layers[0]).alias("first"), on(layers[-1]).alias("last"), F.max(real & (F.col("contact") == "partial")).alias("partial"),
    )
    rows = drills.select("board_id", "drill", "radius_px").join(seen, ["board_id", "drill"], "left").join(limits, "board_id")
    n, first, last, partial = F.coalesce("n", F.lit(0)), *(F.coalesce(c, F.lit(False)) for c in ("first", "last", "partial"))
    if mode == "never":
        table = [(F.lit(True), False, "explicit_npth", 1)]
    elif mode == "explicit":
        table = [(n > 0, True, "explicit_pth", 2), (F.lit(True), False, "explicit_pth_no_copper", 2)]
    else:
        table = [
            (n == 0, False, "likely_npth", 3),
            ((F.col("radius_px") >= F.col("large_px")) & (n <= 1), False, "likely_npth", 4),
            ((n == 1) & (first | last), False, "ambiguous_likely_npth", 5),
            (first & last, True, "likely_pth", 6),
            ((F.col("radius_px") <= F.col("small_px")) & partial, True, "likely_pth", 7),
            (partial & (n >= 2), True, "likely_pth", 8),
            (~partial, False, "likely_npth", 9),
            (F.lit(True), False, "ambiguous_likely_npth", 10),
        ]
    pick = F.lit(None)
    for rule, plated, name, k in reversed(table):
        pick = F.when(rule, F.struct(F.lit(plated).alias("plated"), F.lit(name).alias("classification"), F.lit(k).alias("rule"))).otherwise(pick)
    return rows.withColumn("d", pick).select("board_id", "drill", "radius_px", "d.plated", "d.classification", "d.rule")


def reason() -> Column:
    """Why a hole is what it is, from the columns that ``classify`` returns."""
    text = F.lit(None).cast("string")
    for (rule, name), words in REASONS.items():
        said = F.format_string(words, "radius_px") if "%" in words else F.lit(words)
        text = F.when((F.col("rule") == rule) & (F.col("classification") == name), said).otherwise(text)
    return text


def override(decisions: DataFrame, choices: DataFrame) -> DataFrame:
    """Decisions with ``choices(board_id, drill, plated)`` taking precedence."""
    c = choices.select("board_id", "drill", F.col("plated").alias("chosen"))
    rows = decisions.join(c, ["board_id", "drill"], "left")
    return rows.withColumn("override", F.col("chosen").isNotNull()).withColumn("plated", F.coalesce("chosen", "plated")).drop("chosen")


def split_masks(drill_labelled: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drill runs as layer PTH or NPTH."""
    d = decisions.select("board_id", F.col("drill").alias("component"), "plated")
    rows = drill_labelled.join(d, ["board_id", "component"])
    return rows.select("board_id", F.when(F.col("plated"), "PTH").otherwise("NPTH").alias("layer"), "y", "x0", "x1")


def members(decisions: DataFrame, met: DataFrame) -> DataFrame:
    """(board_id, drill, layer, component): what a plated hole joins, which is
    every component it touches, also by contacts too weak to decide."""
    plated = decisions.where("plated").select("board_id", "drill")
    return met.join(plated, ["board_id", "drill"]).select("board_id", "drill", "layer", F.explode("component_ids").alias("component"))
