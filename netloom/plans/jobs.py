"""Whole jobs over a folder of boards, with their files.

Layout of a folder: <out>/{labels,nets,components,drills,contacts,members,canvas}
as Parquet by board, <out>/json with one document a board, and a manifest.  A
run replaces its own boards (``netloom.plans.store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import catalog
from netloom.operators import artwork, audit, drawing, drills, export, geometry, masks, nets
from netloom.plans.extract import Extraction
from netloom.plans.store import by_board, publish, table, tables_of
from netloom.sources import files
from netloom.storage import stored

def write_extraction(e: Extraction, out: str) -> None:
    """Tables of an extraction and nets.json documents, for its boards."""
    publish(out, "nets", tables_of(e), e.canvas)
    by_board(debug_json(e.copper.sparkSession, out).join(e.canvas.select("board_id"), "board_id", "left_semi"), f"{out}/json", "text")


def debug_json(spark: SparkSession, out: str) -> DataFrame:
    """(board_id, value): components, drills with members, and merged groups."""
    read = lambda n: table(spark, out, n)
    rows = lambda df, name, *order: df.groupBy("board_id").agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in (*order, "board_id"))))).alias(name))
    net = read("nets")
    comp = rows(read("components").join(net, ["board_id", "layer", "component"]), "components", "layer", "component")
    member = read("members").groupBy("board_id", "drill").agg(F.sort_array(F.collect_list(F.struct("layer", "component"))).alias("members"))
    drill = rows(read("drills").join(member, ["board_id", "drill"]), "drills", "drill")
    group = rows(nets.groups(net), "groups", "net")
    doc = comp.join(drill, "board_id", "left").join(group, "board_id", "left")
    return doc.select("board_id", F.to_json(F.struct("components", "drills", "groups")).alias("value"))


def load_labels(spark: SparkSession, out: str, layers: tuple[str, ...], canvas: DataFrame | None = None) -> DataFrame:
    """Net runs of an earlier run in the requested layer order; an error if its
    layers aren't the requested ones, or its boards not of the size in ``canvas``."""
    if canvas is not None:
        size = table(spark, out, "canvas").select("board_id", F.col("w").alias("had_w"), F.col("h").alias("had_h"))
        bad = canvas.join(size, "board_id").where("w <> had_w OR h <> had_h").limit(1).collect()
        if bad:
            raise ValueError(f"board {bad[0].board_id}: expected {bad[0].w} x {bad[0].h}, found {bad[0].had_w} x {bad[0].had_h}")
    net = table(spark, out, "nets")
    found = {r.layer for r in net.select("layer").distinct().collect()}
    if found != set(layers):
        raise ValueError(f"expected layers {sorted(layers)}, found {sorted(found)}")
    ord_ = F.array_position(F.array(*map(F.lit, layers)), F.col("layer")) - 1
    return export.net_runs(table(spark, out, "labels"), net).withColumn("layer_ord", ord_.cast("int"))


def resolve_spec(labelled: DataFrame, specs: DataFrame) -> DataFrame:
    """(board_id, spec, layer, component, error) of ``specs(board_id, spec)``
    written LAYER:ID or LAYER:X,Y."""
    layer, rest = F.substring_index("spec", ":", 1), F.substring(F.col("spec"), F.instr("spec", ":") + 1, F.length("spec"))
    point = rest.rlike(r"^\s*-?\d+\s*,\s*-?\d+\s*$")
    num = lambda c: F.trim(c).try_cast("int")
    s = specs.select("board_id", "spec", layer.alias("layer"), F.when(~point, num(rest)).alias("id"), F.when(point, num(F.split(rest, ",")[0])).alias("px"), F.when(point, num(F.get(F.split(rest, ","), F.lit(1)))).alias("py"))
    hit = labelled.select("board_id", "layer", F.col("y").alias("py"), "x0", "x1", F.col("component").alias("found"))
    at = s.where("px IS NOT NULL").join(hit, ["board_id", "layer", "py"]).where("px >= x0 AND px < x1").select("board_id", "spec", "found")
    rows = s.join(at, ["board_id", "spec"], "left")
    error = F.when(F.col("px").isNull() & F.col("id").isNull(), "neither an id nor a point").when(F.col("id") < 1, "ids count from 1").when(F.col("px").isNotNull() & F.col("found").isNull(), "background or outside")
    return rows.select("board_id", "spec", "layer", F.coalesce("id", "found").alias("component"), error.alias("error"))


def explained(spark: SparkSession, out: str, specs: DataFrame) -> DataFrame:
    """Text of the path between ``specs(board_id, start, end)`` from files of a
    run, one row a step, places by box middle and hole centre."""
    members, comp = table(spark, out, "members"), table(spark, out, "components")
    hole = table(spark, out, "drills").select("board_id", "drill", F.round("cx", 1).alias("hx"), F.round("cy", 1).alias("hy"))
    mid = lambda side: comp.select("board_id", F.concat_ws(":", "layer", "component").alias(f"{side}_node"), F.format_string("~(%d,%d)", F.floor((F.col("x0") + F.col("x1") - 1) / 2), F.floor((F.col("y0") + F.col("y1") - 1) / 2)).alias(f"{side}_at"))
    steps = nets.explain(members, specs).join(mid("from"), ["board_id", "from_node"]).join(mid("to"), ["board_id", "to_node"]).join(hole, ["board_id", "drill"])
    return steps.select("board_id", "start", "end", "step", F.format_string("%s %s - drill %d (%.1f,%.1f) - %s %s", "from_node", "from_at", "drill", "hx", "hy", "to_node", "to_at").alias("text"))


def board_plans(digests: DataFrame) -> DataFrame:
    """(board_id, layers, via, mode) from ``digests(board_id, layer, digest)`` of
    a board's own masks: its stack in order, the mask that connects, and how."""
    have = digests.select("board_id", F.col("layer").alias("name"), F.col("digest").alias("sha"))
    stack = catalog.resolve_layers(have.select("board_id", "name")).groupBy("board_id")
    stack = stack.agg(F.transform(F.sort_array(F.collect_list(F.struct("layer_ord", "layer"))), lambda s: s["layer"]).alias("layers"))
    modes = catalog.connector_mode(have, catalog.via_name(have.select("board_id", "name")))
    return stack.join(modes, "board_id").select("board_id", "layers", F.col("name").alias("via"), "mode")


def audit_report(runs: DataFrame, drill: DataFrame, canvas: DataFrame, layers: tuple[str, ...], auto_align: bool = True) -> DataFrame:
    """One row for each layer's polarity and each board's alignment; ``warns``
    says what would make an audit fail."""
    pol = audit.resolve_invert(audit.polarity(masks.fill(runs, masks.layer_canvas(canvas, layers))))
    ali = audit.audit_alignment(drill, runs, canvas, auto_align)
    a = pol.select("board_id", F.lit("polarity").alias("check"), "layer", F.round("fill", 4).alias("value"), "verdict", F.col("verdict").isin("warn", "ambiguous").alias("warns"), F.lit(None).cast("string").alias("action"))
    b = ali.select("board_id", F.lit("alignment").alias("check"), F.lit("drill").alias("layer"), F.round("score", 4).alias("value"), "verdict", (F.col("verdict") == "fail").alias("warns"), F.when(F.col("verdict") == "shift", F.format_string("dy=%d dx=%d", "dy", "dx")).alias("action"))
    return a.unionByName(b)


def prepared(runs: DataFrame, drill: DataFrame, canvas: DataFrame, layers: tuple[str, ...], auto_align: bool = False, manual: DataFrame | None = None, **invert) -> tuple[DataFrame, DataFrame]:
    """(copper, drill) with planes inverted and the drill mask aligned: polarity
    first, alignment against the inverted layers; ``manual(board_id, dy, dx)``
    skips the audit for its boards; ``invert`` goes to ``audit.resolve_invert``."""
    size = masks.layer_canvas(canvas, layers)
    copper = audit.prepare(runs, size, audit.resolve_invert(audit.polarity(masks.fill(runs, size)), **invert))
    found = audit.audit_alignment(drill, copper, canvas, auto_align).select("board_id", "dy", "dx")
    if manual is not None:
        found = found.join(manual, "board_id", "left_anti").unionByName(manual.select("board_id", "dy", "dx"))
    return copper, masks.shift(drill, found, canvas)


def identify_drills(e: Extraction, out: str, choices: DataFrame | None = None) -> None:
    """Masks PTH, via (as PTH), NPTH and drill, and the decisions as JSON."""
    d = e.decisions if choices is None else drills.override(e.decisions, choices)
    split = drills.split_masks(e.drill_labelled, d)
    via = split.where("layer = 'PTH'").withColumn("layer", F.lit("via"))
    publish(out, "masks", {"masks": split.unionByName(via).unionByName(e.drill.select("board_id", "layer", "y", "x0", "x1"))}, e.canvas)
    by_board(d.withColumn("reason", drills.reason()), f"{out}/decisions", "json")


def write_drill_files(texts: DataFrame, decided: DataFrame, out: str) -> None:
    """Every board's drill file as <out>/drills/board_id=N/layer=PTH and NPTH."""
    line = F.expr("left(text, length(text) - 1)").alias("value")  # the writer ends it
    by_board(files.split_excellon(texts, decided).select("board_id", "layer", line), f"{out}/drills", "text", "layer")


def plated_counts(decisions: DataFrame, canvas: DataFrame) -> DataFrame:
    """(board_id, plated, unplated) of every board."""
    n = decisions.groupBy("board_id").agg(F.count_if("plated").alias("plated"), F.count_if(~F.col("plated")).alias("unplated"))
    return canvas.select("board_id").join(n, "board_id", "left").fillna(0, ["plated", "unplated"])


def check_drawable(corrections: DataFrame) -> None:
    """An error where ``corrections(board_id, layer, invert, dy, dx)`` moves a layer,
    which drawings can't follow; they can follow an inversion."""
    bad = corrections.where("dy <> 0 OR dx <> 0").select("board_id", "layer", F.coalesce("dy", F.lit(0)).alias("dy"), F.coalesce("dx", F.lit(0)).alias("dx")).limit(20).collect()
    if bad:
        raise ValueError("drawings of moved layers: " + "; ".join(f"board {r.board_id} {r.layer}: dy={r.dy} dx={r.dx}" for r in bad))


def split_objects(objects: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plated, unplated) objects of a drill file by (board_id, object_index, plated)."""
    rows = objects.join(decided, ["board_id", "object_index"])
    return rows.where("plated").drop("plated"), rows.where("NOT plated").drop("plated")


def align_layers(runs: DataFrame, canvas: DataFrame, shifts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved runs, manifest) for ``shifts(board_id, layer, dy, dx, source)``;
    where a layer has several, manual comes before auto."""
    first = shifts.groupBy("board_id", "layer").agg(F.max_by(F.struct("dy", "dx", "source"), F.col("source") == "manual").alias("s")).select("board_id", "layer", "s.*")
    return masks.shift(runs, first, canvas, "left"), first


def detected_shifts(runs: DataFrame, drill: DataFrame, canvas: DataFrame) -> DataFrame:
    """(board_id, layer, dy, dx, source): useful displacements of the drill mask
    and of the layers via, F_Mask and B_Mask among ``runs``; the rest is copper."""
    kind = F.col("layer")
    masked = kind.isin("F_Mask", "B_Mask")
    copper = stored(runs.where(~masked & (kind != "via")), "copper")
    move = lambda name, df: df.select("board_id", name, "dy", "dx", F.lit("auto").alias("source"))
    holes = [move(F.lit(name).alias("layer"), audit.audit_alignment(df, copper, canvas).where("verdict = 'shift'")) for name, df in (("drill", drill), ("via", runs.where(kind == "via")))]
    pairs = catalog.mask_pairs(copper.select("board_id", F.col("layer").alias("name")))
    openings = move("layer", audit.mask_alignment(runs.where(masked), copper, canvas, pairs).where("accepted"))
    return holes[0].unionByName(holes[1]).unionByName(openings)


def write_aligned(runs: DataFrame, drill: DataFrame, canvas: DataFrame, out: str, manual: DataFrame) -> None:
    """Masks moved onto copper, and alignment as JSON: detected shifts, under
    ``manual(board_id, layer, dy, dx)``."""
    auto = detected_shifts(runs, drill, canvas)
    moved, manifest = align_layers(runs.unionByName(drill.select(*runs.columns)), canvas, auto.unionByName(manual.withColumn("source", F.lit("manual"))))
    manifest = stored(manifest, "alignment")
    publish(out, "masks", {"masks": moved}, canvas)
    by_board(manifest, f"{out}/alignment", "json")


def render(e: Extraction, out: str, scale: int = 1) -> None:
    """Netmap text and metadata of every board."""
    rects = export.rectangles(e.net_runs)
    by_board(export.netmap(rects, e.canvas, e.layers).select("board_id", F.col("svg").alias("value")), f"{out}/netmap", "text")
    size = e.canvas.select("board_id", (F.col("w") / scale).cast("int").alias("width"), (F.col("h") / scale).cast("int").alias("height"))
    by_board(e.check.join(size, "board_id"), f"{out}/meta", "json")


def read_drawings(spark: SparkSession, folder: str) -> DataFrame:
    """(board_id, layer, svg) of <folder>/board_id=N/<layer>.svg."""
    text = spark.read.option("pathGlobFilter", "*.svg").text(folder, wholetext=True)
    return text.select(F.col("board_id").cast("int").alias("board_id"), F.regexp_extract("_metadata.file_name", r"^(.*)\.svg$", 1).alias("layer"), F.col("value").alias("svg"))


def corrections(runs: DataFrame, drill: DataFrame, canvas: DataFrame, layers: tuple[str, ...], manual: DataFrame, auto_align: bool = False, **invert) -> DataFrame:
    """(board_id, layer, invert, dy, dx): what ``prepared`` does to each mask,
    under ``manual(board_id, layer, dy, dx)``; the drill mask is layer drill."""
    size = masks.layer_canvas(canvas, layers)
    turned = audit.resolve_invert(audit.polarity(masks.fill(runs, size)), **invert).select("board_id", "layer", "invert")
    copper = audit.prepare(runs, size, turned)
    own = manual.where("layer = 'drill'").select("board_id", "dy", "dx")
    found = audit.audit_alignment(drill, copper, canvas, auto_align).select("board_id", "dy", "dx").join(own, "board_id", "left_anti").unionByName(own)
    of_layers = turned.join(manual.where("layer <> 'drill'"), ["board_id", "layer"], "left").select("board_id", "layer", "invert", "dy", "dx")
    return of_layers.unionByName(found.select("board_id", F.lit("drill").alias("layer"), F.lit(False).alias("invert"), "dy", "dx"))


def write_drawings(e: Extraction, svgs: DataFrame, corrected: DataFrame, out: str) -> None:
    """Drawings as masks under <out>/drawings/board_id=N/layer=L, and what draws
    each net of the copper layers under <out>/geometry.  An error where a layer
    was moved, or where a drawing isn't of its board's size."""
    check_drawable(corrected.join(svgs, ["board_id", "layer"], "left_semi"))
    size = drawing.size(svgs).join(e.canvas.select("board_id", F.col("w").alias("board_w"), F.col("h").alias("board_h")), "board_id")
    bad = size.where("w IS NULL OR h IS NULL OR w <> board_w OR h <> board_h OR x <> 0 OR y <> 0").orderBy("board_id", "layer").limit(20).collect()
    if bad:
        raise ValueError("drawings of another size: " + "; ".join(f"board {r.board_id} {r.layer}: {r.w} x {r.h} from ({r.x}, {r.y}), expected {r.board_w} x {r.board_h}" for r in bad))
    made = stored(drawing.luminance(svgs, corrected.where("invert")), "drawings")
    copper = made.where(F.col("layer").isin(*e.layers))
    subs = stored(artwork.subpaths(artwork.elements(artwork.documents(copper))), "subpaths")
    shown = stored(geometry.by_net(stored(geometry.attributed(subs, stored(e.net_runs, "net_runs"), e.canvas), "primitives"), e.canvas), "geometry")
    by_board(made.select("board_id", "layer", F.col("svg").alias("value")), f"{out}/drawings", "text", "layer")
    by_board(shown, f"{out}/geometry")


def gallery(spark: SparkSession, out: str) -> DataFrame:
    """A row for every rendered board."""
    return spark.read.json(f"{out}/meta").select("board_id", "n_nets", "width", "height", "largest_net_share")
