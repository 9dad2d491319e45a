"""Boards derived from the star-schema tables: one board per nation.

Customers become copper rectangles, suppliers drilled holes with pads, and a
plane layer is cut by antipads.  Everything is integer arithmetic on keys, so
that any engine derives the same boards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import masks

SIDE = 256
COPPER = ("F_Cu", "In1_Cu", "B_Cu")
PLANE = "In2_Cu"
STACK = ("F_Cu", "In1_Cu", "In2_Cu", "B_Cu")
#: Pads of a hole by supplier key modulo 10: (layer, margin around the hole).
PADS = {
    1: (("F_Cu", 6),), 2: (("B_Cu", 6),), 3: (("F_Cu", 6), ("B_Cu", 6)), 4: (("F_Cu", 2), ("B_Cu", 2)), 5: (("In1_Cu", 2),),
    6: (("In1_Cu", 6),), 7: (("F_Cu", 2), ("In1_Cu", 2)), 8: (("F_Cu", 6), ("In1_Cu", 6)), 9: (("F_Cu", 6), ("B_Cu", 6), ("In1_Cu", 6)),
}
FLOODED = 7  # this board's front copper covers more than 60 %


@dataclass(frozen=True)
class Boards:
    canvas: DataFrame  # board_id, w, h
    runs: DataFrame  # board_id, layer, y, x0, x1: all copper layers
    drill: DataFrame  # the same with layer "drill"
    shifted: DataFrame  # the drill mask, displaced by board

    @property
    def copper(self) -> DataFrame:
        """The layers whose nets are extracted."""
        return self.runs.where(F.col("layer").isin(*COPPER))


def disc(df: DataFrame, radius: Column) -> DataFrame:
    """Spans of discs: ``df`` has board_id, layer, cx, cy; clipped to the canvas."""
    rows = df.withColumn("r", radius).withColumn("dy", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    half = F.floor(F.sqrt((F.col("r") * F.col("r") - F.col("dy") * F.col("dy")).cast("double"))).cast("int")
    spans = rows.select("board_id", "layer", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") - half).alias("x0"), (F.col("cx") + half + 1).alias("x1"))
    return spans.select("board_id", "layer", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.lit(SIDE)).alias("x1")).where(f"y >= 0 AND y < {SIDE} AND x0 < x1")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").cast("int").alias("board_id"), F.col("s_suppkey").cast("int").alias("s"))
    r = F.when(F.col("s") % 17 == 0, 22).when(F.col("s") % 13 == 0, 10).otherwise(3 + F.col("s") % 4)
    return s.select("board_id", "s", (20 + F.col("s") * 41 % 216).alias("cx"), (20 + F.col("s") * 59 % 216).alias("cy"), r.cast("int").alias("hole"))


def derive(spark: SparkSession, sf_dir: str) -> Boards:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("board_id"))
    canvas = nation.select("board_id", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))
    k = F.col("k")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("int").alias("board_id"), F.col("c_custkey").cast("int").alias("k"))
    rect = c.select("board_id", F.get(F.array(*map(F.lit, COPPER)), k % 3).alias("layer"), (k * 37 % 240).alias("x0"), (k * 53 % 240).alias("y0"), (4 + k % 13).alias("w"), (4 + k % 7).alias("h"))
    rects = rect.select("board_id", "layer", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)).alias("y"), "x0", (F.col("x0") + F.col("w")).alias("x1"))
    hole = holes(spark, sf_dir)
    plan = F.create_map(*(x for s, pads in PADS.items() for x in (F.lit(s), F.array(*(F.struct(F.lit(a).alias("layer"), F.lit(m).alias("margin")) for a, m in pads)))))
    pad = hole.select("board_id", "cx", "cy", "hole", F.explode(F.get(F.array(plan[F.col("s") % 10]), 0)).alias("p")).select("board_id", "cx", "cy", "hole", "p.*")
    pads = disc(pad, F.col("hole") + F.col("margin"))
    row = nation.select("board_id", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y"))
    whole = lambda layer, rule: row.where(rule).select("board_id", F.lit(layer).alias("layer"), "y", F.lit(0).alias("x0"), F.lit(SIDE).alias("x1"))
    flood = whole("F_Cu", f"board_id = {FLOODED} AND y < 160")
    half = whole(PLANE, f"board_id % 3 = 1 AND y < {SIDE // 2}")
    antipads = masks.merge_runs(disc(hole.where("board_id % 3 = 0").withColumn("layer", F.lit(PLANE)), F.col("hole") + 8))
    planes = masks.complement(antipads, canvas.where("board_id % 3 = 0").withColumn("layer", F.lit(PLANE)))
    runs = masks.merge_runs(rects.unionByName(pads).unionByName(flood).unionByName(half)).unionByName(planes)
    drill = masks.merge_runs(disc(hole.withColumn("layer", F.lit("drill")), F.col("hole")))
    shift = canvas.select("board_id", (F.col("board_id") % 7 - 3).alias("dy"), (F.col("board_id") % 5 - 2).alias("dx"))
    return Boards(canvas, runs, drill, masks.shift(drill, shift, canvas))


def sql(name: str) -> str:
    """DuckDB CTEs up to ``name``: canvas, run, drill or shifted."""
    pad_rows = ", ".join(f"({s}, '{a}', {m})" for s, pads in PADS.items() for a, m in pads)
    discs = lambda src, radius: f"SELECT board_id, layer, y, greatest(x0, 0) AS x0, least(x1, {SIDE}) AS x1 FROM (SELECT board_id, layer, cy + dy AS y, cx - floor(sqrt(r * r - dy * dy))::INT AS x0, cx + floor(sqrt(r * r - dy * dy))::INT + 1 AS x1 FROM (SELECT *, unnest(range(-r, r + 1))::INT AS dy FROM (SELECT *, ({radius})::INT AS r FROM {src}))) WHERE y >= 0 AND y < {SIDE} AND x0 < x1"
    layers = ", ".join(f"'{x}'" for x in COPPER)
    return f"""WITH RECURSIVE canvas AS (SELECT n_nationkey::INT AS board_id, {SIDE} AS w, {SIDE} AS h FROM nation),
grid AS (SELECT board_id, unnest(range(0, {SIDE}))::INT AS y FROM canvas),
rect AS (SELECT c_nationkey::INT AS board_id, [{layers}][c_custkey % 3 + 1] AS layer, (c_custkey * 37 % 240)::INT AS x0, (c_custkey * 53 % 240)::INT AS y0, (4 + c_custkey % 13)::INT AS w, (4 + c_custkey % 7)::INT AS h FROM customer),
hole AS (SELECT s_nationkey::INT AS board_id, s_suppkey::INT AS s, (20 + s_suppkey * 41 % 216)::INT AS cx, (20 + s_suppkey * 59 % 216)::INT AS cy, (CASE WHEN s_suppkey % 17 = 0 THEN 22 WHEN s_suppkey % 13 = 0 THEN 10 ELSE 3 + s_suppkey % 4 END)::INT AS hole FROM supplier),
pad_plan(m, layer, margin) AS (VALUES {pad_rows}),
pad AS (SELECT hole.*, layer, margin FROM hole JOIN pad_plan ON s % 10 = m),
raw AS (SELECT board_id, layer, (y0 + unnest(range(0, h)))::INT AS y, x0, x0 + w AS x1 FROM rect
  UNION ALL ({discs("pad", "hole + margin")})
  UNION ALL SELECT board_id, 'F_Cu', y, 0, {SIDE} FROM grid WHERE board_id = {FLOODED} AND y < 160
  UNION ALL SELECT board_id, '{PLANE}', y, 0, {SIDE} FROM grid WHERE board_id % 3 = 1 AND y < {SIDE // 2}),
antipad AS ({discs(f"(SELECT *, '{PLANE}' AS layer FROM hole WHERE board_id % 3 = 0)", "hole + 8")}),
antipad_run AS ({merge_sql("antipad")}),
plane AS ({complement_sql("antipad_run", f"(SELECT *, '{PLANE}' AS layer FROM canvas WHERE board_id % 3 = 0)")}),
run AS ({merge_sql("raw")} UNION ALL SELECT * FROM plane),
drill_raw AS ({discs("(SELECT *, 'drill' AS layer FROM hole)", "hole")}),
drill AS ({merge_sql("drill_raw")}),
shifted AS (SELECT board_id, layer, y + board_id % 7 - 3 AS y, greatest(0, x0 + board_id % 5 - 2) AS x0, least({SIDE}, x1 + board_id % 5 - 2) AS x1 FROM drill WHERE y + board_id % 7 - 3 BETWEEN 0 AND {SIDE - 1} AND greatest(0, x0 + board_id % 5 - 2) < least({SIDE}, x1 + board_id % 5 - 2))""" + (f" {name}" if name else "")


def merge_sql(src: str) -> str:
    part = "PARTITION BY board_id, layer, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"SELECT board_id, layer, y, min(x0)::INT AS x0, max(x1)::INT AS x1 FROM (SELECT *, sum(CASE WHEN pm IS NULL OR x0 > pm THEN 1 ELSE 0 END) OVER ({part} CURRENT ROW) AS g FROM (SELECT *, max(x1) OVER ({part} 1 PRECEDING) AS pm FROM {src})) GROUP BY board_id, layer, y, g"


def complement_sql(src: str, canvas: str) -> str:
    return f"""SELECT board_id, layer, y, a AS x0, b AS x1 FROM (
  SELECT r.board_id, r.layer, r.y, x1 AS a, coalesce(lead(x0) OVER (PARTITION BY r.board_id, r.layer, r.y ORDER BY x0), w) AS b FROM
    (SELECT board_id, layer, y, x0, x1 FROM {src} UNION ALL SELECT board_id, layer, unnest(range(0, h))::INT, -1, 0 FROM {canvas}) r JOIN {canvas} c ON r.board_id = c.board_id AND r.layer = c.layer) WHERE a < b"""
