"""Files around a board: masks, mappings, choices, drill files, SVG sizes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import masks
from netloom.operators.assignment import Assignment
from netloom.sources import png


def read_masks(spark: SparkSession, path: str, threshold: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sizes, runs) of PNG masks laid out as board_id=N/<layer>.png; pixels
    brighter than the threshold are set."""
    pictures = png.files(spark, path)
    return png.sizes(pictures), png.runs(pictures, threshold)


def checked(sizes: DataFrame) -> DataFrame:
    """canvas(board_id, w, h); an error if a board's masks differ in size."""
    bad = masks.mismatched(sizes).limit(1).collect()
    if bad:
        raise ValueError(f"mask dimensions differ on board {bad[0].board_id}")
    return sizes.groupBy("board_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))


def read_mapping(texts: DataFrame) -> DataFrame:
    """(board_id, canonical, filename) of ``texts(board_id, json)``: either
    {"layers": {...}} or a flat object, whose names with _ are remarks."""
    layered = F.from_json("json", "layers map<string,string>")["layers"]
    flat = F.map_filter(F.from_json("json", "map<string,string>"), lambda k, _: ~k.startswith("_"))
    return texts.select("board_id", F.explode(F.coalesce(layered, flat)).alias("canonical", "filename"))


def mapping_json(mapping: DataFrame) -> DataFrame:
    """(board_id, json) of (board_id, canonical, filename), layers in canonical order."""
    from netloom.functions.catalog import order_key

    rows = F.sort_array(F.collect_list(F.struct(order_key(F.col("canonical")).alias("o"), "canonical", "filename")))
    entries = F.map_from_entries(F.transform(rows, lambda r: F.struct(r["canonical"], r["filename"])))
    return mapping.groupBy("board_id").agg(F.to_json(F.struct(entries.alias("layers"))).alias("json"))


def mapping_or_detected(texts: DataFrame, files: DataFrame) -> DataFrame:
    """A board's own mapping where it has one, else what its files' names say."""
    from netloom.functions.catalog import detect_layers

    own = read_mapping(texts)
    rest = files.join(texts.select("board_id"), "board_id", "left_anti")
    return own.unionByName(detect_layers(rest).select("board_id", "canonical", "filename"))


def read_choices(texts: DataFrame) -> DataFrame:
    """(board_id, drill, plated) of ``texts(board_id, json)``, incomplete entries skipped."""
    one = "array<struct<drill:int,plated:boolean>>"
    c = F.from_json("json", f"drill_classifications {one}, decisions {one}")
    rows = texts.select("board_id", F.explode(F.coalesce(c["drill_classifications"], c["decisions"])).alias("d")).select("board_id", "d.*")
    return rows.where("drill IS NOT NULL AND plated IS NOT NULL")


def read_object_choices(texts: DataFrame) -> DataFrame:
    """(board_id, object_index, plated); an error where a board names no object."""
    one = "array<struct<source_object_index:int,object_index:int,plated:boolean>>"
    c = F.from_json("json", f"drill_classifications {one}, decisions {one}")
    rows = texts.select("board_id", F.explode(F.coalesce(c["drill_classifications"], c["decisions"])).alias("d"))
    rows = rows.select("board_id", F.coalesce("d.source_object_index", "d.object_index").alias("object_index"), "d.plated")
    missing = rows.groupBy("board_id").agg(F.count("object_index").alias("n")).where("n = 0").limit(1).collect()
    if missing:
        raise ValueError(f"choices of board {missing[0].board_id} name no object index")
    return rows.where("object_index IS NOT NULL AND plated IS NOT NULL")


def excellon_lines(text: str | None) -> Iterator[tuple[str, tuple | None]]:
    """The lines of a drill file in order; a hit or slot has both coordinates of
    each end spelled out and comes with its (tool, diameter, x, y)."""
    tools, tool, at = {}, None, {"X": "0", "Y": "0"}
    for raw in (text or "").splitlines():
        line = raw.strip().split(";")[0]
        made = re.match(r"T(\d+).*?C([\d.]+)", line)
        if made:
            tools[int(made[1])] = float(made[2])
        elif re.fullmatch(r"T\d+", line):
            tool = int(line[1:])
        elif line[:1] in "XY" and line:
            ends = []
            for part in line.split("G85"):
                at |= dict(re.findall(r"([XY])(-?[\d.]+)", part))
                ends.append((at["X"], at["Y"]))
            x, y = (sum(float(e[i]) for e in ends) / len(ends) for i in (0, 1))
            yield "G85".join(f"X{a}Y{b}" for a, b in ends), (tool, tools.get(tool), x, y)
            continue
        yield raw, None


def read_excellon(texts: DataFrame) -> DataFrame:
    """(board_id, object_index, tool, diameter, x, y) of ``texts(board_id, text)``:
    drill hits with decimal coordinates, and slots (G85) by their middle."""

    def run(batches):
        for pdf in batches:
            rows = []
            for board, text in zip(pdf["board_id"], pdf["text"], strict=True):
                hits = (hit for _, hit in excellon_lines(text) if hit)
                rows += [(board, n, *hit) for n, hit in enumerate(hits)]
            yield pd.DataFrame(rows, columns=["board_id", "object_index", "tool", "diameter", "x", "y"])

    return texts.mapInPandas(run, "board_id int, object_index int, tool int, diameter double, x double, y double")


def split_excellon(texts: DataFrame, decided: DataFrame) -> DataFrame:
    """(board_id, layer, text): each board's drill file twice, as PTH with its
    plated objects and as NPTH with the others of ``decided(board_id,
    object_index, plated)``.  Undecided objects are in neither; all other lines
    are kept."""
    chosen = decided.groupBy("board_id").agg(*(F.collect_set(F.when(rule, F.col("object_index"))).alias(n) for n, rule in (("PTH", F.col("plated")), ("NPTH", ~F.col("plated")))))
    rows = texts.select("board_id", "text").join(chosen, "board_id", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for board, text, *sides in pdf[["board_id", "text", "PTH", "NPTH"]].itertuples(index=False):
                for layer, keep in zip(("PTH", "NPTH"), sides, strict=True):
                    keep, n, lines = set() if keep is None else set(keep), -1, []
                    for line, hit in excellon_lines(text):
                        n += hit is not None
                        if hit is None or n in keep:
                            lines.append(line)
                    out.append((board, layer, "\n".join(lines) + "\n"))
            yield pd.DataFrame(out, columns=["board_id", "layer", "text"])

    return rows.mapInPandas(run, "board_id int, layer string, text string")


def _assign(cost: np.ndarray) -> list[int]:
    """Partner of each row in a cheapest one-to-one assignment of a square matrix."""
    return Assignment(len(cost), lambda rows: cost[rows]).of


def match_objects(drills: DataFrame, objects: DataFrame) -> DataFrame:
    """(board_id, drill, object_index): the cheapest one-to-one match of drilled
    areas (cx, cy) and file objects (x, y; y upwards), both clouds scaled to the
    unit square.  Without coordinates they pair in order.  A group is a board."""

    def unit(p: np.ndarray) -> np.ndarray:
        span = p.max(axis=0) - p.min(axis=0)
        return (p - p.min(axis=0)) / np.where(span > 0, span, 1.0)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("drill", ignore_index=True), b.sort_values("object_index", ignore_index=True)
        if len(a) != len(b):
            raise ValueError(f"{len(a)} drilled areas but {len(b)} objects")
        order = list(range(len(a)))
        if len(a) and b[["x", "y"]].notna().all(axis=None):
            p, q = unit(a[["cx", "cy"]].to_numpy(float)), unit(b[["x", "y"]].to_numpy(float) * [1, -1])
            order = Assignment.of_points(p, q).of
        return pd.DataFrame({"board_id": a["board_id"], "drill": a["drill"], "object_index": b["object_index"].iloc[order].to_numpy()})

    return drills.groupBy("board_id").cogroup(objects.groupBy("board_id")).applyInPandas(run, "board_id int, drill int, object_index int")


def object_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """(board_id, object_index, plated): the decision of each object's hole."""
    return matches.join(decisions.select("board_id", "drill", "plated"), ["board_id", "drill"]).select("board_id", "object_index", "plated")


def svg_size(svg: Column) -> Column:
    """struct<w, h> in whole units: from viewBox, else width and height."""
    box = F.split(F.trim(F.regexp_extract(svg, r"viewBox\s*=\s*[\"']([^\"']*)[\"']", 1)), r"[\s,]+")
    attr = lambda n: F.nullif(F.regexp_extract(svg, rf"<svg\b[^>]*?\b{n}\s*=\s*[\"']\s*([\d.]+)", 1), F.lit(""))
    side = lambda i, n: F.greatest(F.lit(1), F.bround(F.coalesce(F.when(F.size(box) == 4, F.get(box, F.lit(i))), attr(n)).cast("double")).cast("int"))
    return F.struct(side(2, "width").alias("w"), side(3, "height").alias("h"))


def transform_window(svg: Column) -> Column:
    """struct<x, y, w, h>, the board window that an SVG's y-flipping group maps to
    its canvas: the largest scale counts."""
    rx = r"matrix\(\s*([-\d.eE]+)[\s,]+[-\d.eE]+[\s,]+[-\d.eE]+[\s,]+(-[\d.eE]+)[\s,]+([-\d.eE]+)[\s,]+([-\d.eE]+)\s*\)"
    parts = F.arrays_zip(*(F.transform(F.regexp_extract_all(svg, F.lit(rx), F.lit(i)), lambda x: x.cast("double")).alias(n) for i, n in ((1, "sx"), (2, "sy"), (3, "tx"), (4, "ty"))))
    best = F.array_max(F.transform(parts, lambda p: F.struct(F.abs(p["sx"]).alias("scale"), p["sx"].alias("sx"), p["sy"].alias("sy"), p["tx"].alias("tx"), p["ty"].alias("ty"))))
    size = svg_size(svg)
    return F.struct((-best["tx"] / best["sx"]).alias("x"), ((best["ty"] - size["h"]) / F.abs(best["sy"])).alias("y"), (size["w"] / F.abs(best["sx"])).alias("w"), (size["h"] / F.abs(best["sy"])).alias("h"))
