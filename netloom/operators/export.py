"""Label maps for viewers: colour codec, down-sampling, rectangles, resizing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.components import Forest
from netloom.storage import stored

#: Fixed value: how a viewer shows nets, and the one that is selected.
NETMAP_STYLE = "<style>.net-shape{fill:transparent;stroke:transparent;pointer-events:all}.net-shape.selected{fill:rgba(255,80,80,.75);stroke:rgba(255,80,80,.75);pointer-events:all}</style>"


def encode_rgb(net: Column) -> Column:
    """A 24-bit id as struct<r, g, b>."""
    byte = lambda n: F.shiftright(net, n).bitwiseAND(255)
    return F.struct(byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"))


def decode_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def palette(net: Column, seed: int = 0) -> Column:
    """A reproducible bright colour for each net; black for background."""
    h = F.xxhash64(net, F.lit(seed))
    part = lambda n: (F.pmod(F.shiftright(h, n), F.lit(192)) + 64).cast("int")
    black = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return F.when(net == 0, black).otherwise(F.struct(part(0).alias("r"), part(16).alias("g"), part(32).alias("b")))


def net_runs(labelled: DataFrame, net: DataFrame) -> DataFrame:
    """Runs with the net of their component."""
    return labelled.join(net, ["board_id", "layer", "component"]).select("board_id", "layer", "y", "x0", "x1", "net")


def downsample(runs: DataFrame, canvas: DataFrame, scale: float) -> DataFrame:
    """Largest net of each block; sides that don't divide are cropped."""
    new = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(scale)).cast("int"))
    size = canvas.select("board_id", new(F.col("w")).alias("nw"), new(F.col("h")).alias("nh"), "w", "h")
    size = size.select("board_id", "nw", "nh", F.floor(F.col("w") / F.col("nw")).cast("int").alias("bw"), F.floor(F.col("h") / F.col("nh")).cast("int").alias("bh"))
    rows = runs.join(size, "board_id").withColumn("by", F.floor(F.col("y") / F.col("bh")).cast("int"))
    cells = rows.select("board_id", "layer", "by", "net", "nw", "nh", F.explode(F.sequence(F.floor(F.col("x0") / F.col("bw")).cast("int"), F.floor((F.col("x1") - 1) / F.col("bw")).cast("int"))).alias("bx"))
    return cells.where("by < nh AND bx < nw").groupBy("board_id", "layer", "by", "bx").agg(F.max("net").alias("net"))


def placements(canvas: DataFrame, layers: tuple[str, ...], cols: int = 2, scale: float = 1.0) -> DataFrame:
    """(board_id, layer, col, row, x, y, w, h, grid_w, grid_h): the tiles of a
    grid with ``cols`` columns, filled row by row in the order given."""
    if not layers:
        raise ValueError("a grid needs a layer")
    rows = -(-len(layers) // cols)
    whole = lambda n: F.floor(n * F.lit(float(scale))).cast("int")
    tile = canvas.select("board_id", "w", "h", F.posexplode(F.array(*map(F.lit, layers))).alias("at", "layer"))
    tile = tile.withColumn("col", F.col("at") % cols).withColumn("row", F.floor(F.col("at") / cols).cast("int"))
    side = lambda n, k: F.greatest(F.lit(1), whole(F.col(n) * k))
    return tile.select("board_id", "layer", "col", "row", whole(F.col("col") * F.col("w")).alias("x"), whole(F.col("row") * F.col("h")).alias("y"), whole(F.col("w")).alias("w"), whole(F.col("h")).alias("h"), side("w", cols).alias("grid_w"), side("h", rows).alias("grid_h"))


def id_map(runs: DataFrame, canvas: DataFrame, layers: tuple[str, ...], cols: int = 2, scale: float = 1.0) -> DataFrame:
    """(board_id, y, x, net): the nets of all layers as cells of one grid of that
    scale; of the nets in a cell the largest, so that traces stay visible."""
    tile = placements(canvas, layers, cols).select("board_id", "layer", "x", "y", "grid_w", "grid_h")
    moved = runs.join(tile.withColumnRenamed("y", "ty"), ["board_id", "layer"]).select("board_id", F.lit("grid").alias("layer"), (F.col("y") + F.col("ty")).alias("y"), (F.col("x0") + F.col("x")).alias("x0"), (F.col("x1") + F.col("x")).alias("x1"), "net")
    grid = tile.select("board_id", F.col("grid_w").alias("w"), F.col("grid_h").alias("h")).distinct()
    return downsample(moved, grid, scale).select("board_id", F.col("by").alias("y"), F.col("bx").alias("x"), "net")


def rectangles(runs: DataFrame) -> DataFrame:
    """Equal runs on consecutive rows as one rectangle (half-open)."""
    order = W.partitionBy("board_id", "layer", "net", "x0", "x1").orderBy("y")
    island = runs.withColumn("island", F.col("y") - F.row_number().over(order))
    g = island.groupBy("board_id", "layer", "net", "x0", "x1", "island").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return g.select("board_id", "layer", "net", "x0", "y0", "x1", "y1")


def netmap(rects: DataFrame, canvas: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """(board_id, svg): a group for every layer in the order given, one path a
    net and layer, rectangles from the top."""
    cmd = F.format_string("M%d %dH%dV%dH%dZ", "x0", "y0", "x1", "y1", "x0")
    paths = rects.groupBy("board_id", "layer", "net").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", cmd.alias("c")))), lambda s: s["c"]), "").alias("d"))
    name = F.col("layer")
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        name = F.replace(name, F.lit(sign), F.lit(code))
    path = F.concat(F.lit('\n<path class="net-shape" data-net-id="'), "net", F.lit('" data-layer="'), name, F.lit('" d="'), "d", F.lit('"/>'))
    body = paths.groupBy("board_id", "layer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("net", path.alias("p")))), lambda s: s["p"]), "").alias("body"))
    every = canvas.select("board_id", F.posexplode(F.array(*map(F.lit, layers))).alias("at", "layer"))
    group = every.join(body, ["board_id", "layer"], "left").withColumn("g", F.concat(F.lit('<g data-layer="'), name, F.lit('">'), F.coalesce("body", F.lit("")), F.lit("\n</g>")))
    doc = group.groupBy("board_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "g"))), lambda s: s["g"]), "\n").alias("all"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d" preserveAspectRatio="none">\n', "w", "h")
    return canvas.join(doc, "board_id").select("board_id", F.concat(head, F.lit(NETMAP_STYLE + "\n"), F.col("all"), F.lit("\n</svg>")).alias("svg"))


def resize_nearest(runs: DataFrame, canvas: DataFrame, width: int, height: int) -> DataFrame:
    """(board_id, layer, y, x, net) at another size by nearest sample centre."""
    def samples(side: int, out: int, name: str, src: str) -> DataFrame:
        c = canvas.select("board_id", F.col(side).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(out - 1))).alias(name))
        return c.select("board_id", name, F.floor((F.col(name) + 0.5) * F.col("n") / out).cast("int").alias(src))

    rows = runs.join(samples("h", height, "oy", "y"), ["board_id", "y"])
    lo = lambda c: F.ceil(F.col(c) * width / F.col("w") - 0.5).cast("int")  # noqa: E731  first sample at or after a column
    hit = rows.join(canvas.select("board_id", "w"), "board_id").withColumn("a", lo("x0")).withColumn("b", lo("x1") - 1).where("a <= b")
    return hit.select("board_id", "layer", F.col("oy").alias("y"), F.explode(F.sequence("a", "b")).alias("x"), "net")


#: How far from its own place a net that the samples missed may be put.
REACH = 3


def meeting(places: pd.DataFrame) -> pd.DataFrame:
    """``places`` (board_id, layer, oy, ox; distinct) with ``meet``, equal for the
    places that a chain of meeting windows joins.

    All places in a cell as wide as a window meet, so only neighbouring cells have
    to be compared, at most a window's pixels with as many.
    """
    wide = 2 * REACH + 1
    cells: dict[tuple[int, int], list[int]] = {}
    oy, ox = places["oy"].to_numpy(), places["ox"].to_numpy()
    for i, cell in enumerate(zip((oy // wide).tolist(), (ox // wide).tolist(), strict=True)):
        cells.setdefault(cell, []).append(i)
    forest = Forest(len(places))
    for (cy, cx), mine in cells.items():
        for i in mine:
            forest.join(mine[0], i)
        for other in ((cy, cx + 1), (cy + 1, cx - 1), (cy + 1, cx), (cy + 1, cx + 1)):
            yours = cells.get(other)
            if yours and ((np.abs(oy[mine][:, None] - oy[yours]) < wide) & (np.abs(ox[mine][:, None] - ox[yours]) < wide)).any():
                forest.join(mine[0], yours[0])
    return places.assign(meet=np.array([forest.find(i) for i in range(len(places))], np.int32))


def rescue(small: DataFrame, runs: DataFrame, canvas: DataFrame, width: int, height: int) -> DataFrame:
    """The resized map with a pixel for every net that the samples missed: nets
    ascending, the first free pixel in growing squares up to REACH around the
    net's first pixel, else that pixel itself, whatever it holds.

    Free pixels come from a join of the windows with the map.  Nets whose windows
    a chain of meeting windows joins are placed one after the other in a task, all
    others at once; the chains of a layer are found among its distinct places,
    never more than the small map has pixels.
    """
    keys = ["board_id", "layer"]
    first = runs.groupBy(*keys, "net").agg(F.min(F.struct("y", "x0")).alias("p"))
    gone = first.join(small.select(*keys, "net").distinct(), [*keys, "net"], "left_anti").join(canvas, "board_id")
    nearest = lambda c, n, side: F.least(F.lit(n - 1), F.floor((F.col(c) + 0.5) * n / F.col(side))).cast("int")
    lost = stored(gone.select(*keys, "net", nearest("p.y", height, "h").alias("oy"), nearest("p.x0", width, "w").alias("ox")), "lost")
    chains = lost.select(*keys, "oy", "ox").distinct().groupBy(keys).applyInPandas(meeting, "board_id int, layer string, oy int, ox int, meet int")

    near = lambda c, n: F.sequence(F.greatest(F.lit(0), F.col(c) - REACH), F.least(F.lit(n - 1), F.col(c) + REACH))
    window = lost.withColumn("y", F.explode(near("oy", height))).withColumn("x", F.explode(near("ox", width)))
    free = window.join(small.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    ring = F.greatest(F.abs(F.col("y") - F.col("oy")), F.abs(F.col("x") - F.col("ox")))
    spots = free.groupBy(*keys, "net").agg(F.sort_array(F.collect_list(F.struct(ring.alias("ring"), "y", "x"))).alias("s"))
    code = F.transform("s", lambda c: c["y"].cast("long") * width + c["x"])
    tried = lost.join(chains, [*keys, "oy", "ox"]).join(spots.select(*keys, "net", code.alias("spots")), [*keys, "net"], "left")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("net")
        taken: dict[int, int] = {}
        for net, oy, ox, spots in zip(pdf["net"], pdf["oy"], pdf["ox"], pdf["spots"], strict=True):
            taken[next((int(c) for c in (() if spots is None else spots) if int(c) not in taken), oy * width + ox)] = net
        at = np.fromiter(taken, np.int64, len(taken))
        return pd.DataFrame({"board_id": pdf["board_id"].iloc[0], "layer": pdf["layer"].iloc[0], "y": at // width, "x": at % width, "net": list(taken.values())})

    put = stored(tried.groupBy(*keys, "meet").applyInPandas(place, "board_id int, layer string, y int, x int, net int"), "placed")
    kept = small.select(*keys, "y", "x", "net").join(put.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    return kept.select(*put.columns).unionByName(put)
