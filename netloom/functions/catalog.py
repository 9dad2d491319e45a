"""Names of layers and files: detection, order and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File extensions of drill files, and what an extension or the
#: end of a file's stem says about its layer.
DRILL_EXTENSIONS = ("drl", "txt", "xln", "nc", "drd", "ncd")
OTHER_EXTENSIONS = ("gbr", "gpb", "gpt", "gpl")
BY_EXTENSION = {
    "gtl": "F_Cu", "gbl": "B_Cu", "gto": "F_Silkscreen", "gbo": "B_Silkscreen", "gts": "F_Mask", "gbs": "B_Mask", "gtp": "F_Paste", "gbp": "B_Paste",
    "gko": "Edge_Cuts", "gm1": "Edge_Cuts", "gml": "Edge_Cuts", "cmp": "F_Cu", "sol": "B_Cu", "plc": "F_Silkscreen", "pls": "B_Silkscreen",
    "stc": "F_Mask", "sts": "B_Mask", "crc": "F_Paste", "crs": "B_Paste",
}
BY_STEM = {
    "F_Cu": "F[._]Cu$", "B_Cu": "B[._]Cu$", "F_Silkscreen": "F[._](SilkS|Silkscreen|Silk)$", "B_Silkscreen": "B[._](SilkS|Silkscreen|Silk)$",
    "F_Mask": "F[._]Mask$", "B_Mask": "B[._]Mask$", "Edge_Cuts": "Edge[._]Cuts$",
}
NOT_COPPER = ("drill", "via", "PTH", "NPTH", "F_Silkscreen", "B_Silkscreen", "F_Mask", "B_Mask", "F_Paste", "B_Paste", "Edge_Cuts")


def canonical(filename: Column) -> Column:
    """Layer name of a file, or null for files that are none."""
    dot = F.regexp_extract(filename, r"^.+\.([^.]*)$", 1)
    ext = F.lower(dot)
    stem = F.when(dot != "", F.regexp_extract(filename, r"^(.+)\.[^.]*$", 1)).otherwise(filename)
    part = F.regexp_extract(stem, r"([^-]*)$", 1)
    drill = F.when(stem.rlike(r"(?i)(^|[-_])VIAS?$"), "via").when(stem.rlike(r"(?i)(^|[-_])PTH$"), "PTH").when(stem.rlike(r"(?i)(^|[-_])NPTH$"), "NPTH").otherwise("drill")
    number = lambda c, rx, less=0: F.concat(F.lit("In"), (F.regexp_extract(c, rx, 1).cast("int") - less).cast("string"), F.lit("_Cu"))
    known = ext.isin(*BY_EXTENSION, *OTHER_EXTENSIONS) | ext.rlike(r"^(gp?|ly)[0-9]+$")
    out = F.when(ext.isin(*DRILL_EXTENSIONS), drill).when(~known, F.lit(None))
    out = out.when(part.rlike(r"(?i)^In[0-9]+[._]Cu$"), number(part, r"(?i)^In([0-9]+)"))
    for name, rx in BY_STEM.items():
        out = out.when(part.rlike(f"(?i)^{rx}"), name)
    out = out.when(ext.rlike("^gp?[0-9]+$"), number(ext, "^gp?([0-9]+)$")).when(ext.rlike("^ly[0-9]+$"), number(ext, "^ly([0-9]+)$", 1))
    for e, name in BY_EXTENSION.items():
        out = out.when(ext == e, name)
    return out


def detect_layers(files: DataFrame) -> DataFrame:
    """(board_id, canonical, filename): the first file by name of each layer."""
    named = files.withColumn("canonical", canonical(F.col("filename"))).where("canonical IS NOT NULL")
    return named.groupBy("board_id", "canonical").agg(F.min("filename").alias("filename"))


def order_key(name: Column) -> Column:
    """Sorts layers: copper from front to back, holes, silk, mask, edge, others."""
    inner = F.regexp_extract(name, r"^In([0-9]+)_Cu$", 1)
    group = (
        F.when(name.isin("F_Cu", "B_Cu") | (inner != ""), 0).when(name.isin("via", "PTH", "drill", "NPTH"), 1)
        .when(name.endswith("Silkscreen"), 2).when(name.endswith("Mask"), 3).when(name == "Edge_Cuts", 4).otherwise(5)
    )
    within = F.when(name == "F_Cu", 0).when(inner != "", inner.cast("int")).when(name == "B_Cu", 10**6).otherwise(
        F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("via", "PTH", "drill", "NPTH"))), name).cast("int"), F.lit(0)), F.lit(0))
    )
    return F.struct(group.alias("group"), within.alias("within"), name.alias("name"))


def resolve_layers(available: DataFrame) -> DataFrame:
    """(board_id, layer, layer_ord) of boards that have both outer copper layers
    among ``available(board_id, name)``."""
    copper = available.where(~F.col("name").isin(*NOT_COPPER) & F.col("name").rlike("^(F_Cu|B_Cu|In[0-9]+_Cu)$")).distinct()
    whole = copper.groupBy("board_id").agg(F.count_if(F.col("name").isin("F_Cu", "B_Cu")).alias("n")).where("n = 2").select("board_id")
    rank = F.row_number().over(W.partitionBy("board_id").orderBy(order_key(F.col("name"))))
    return copper.join(whole, "board_id", "left_semi").select("board_id", F.col("name").alias("layer"), (rank - 1).alias("layer_ord"))


def first_of(available: DataFrame, names: tuple[str, ...], otherwise: str) -> DataFrame:
    """(board_id, name): the first of ``names`` that a board has."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    best = F.min(F.when(place > 0, F.struct(place, F.col("name"))))["name"]
    return available.groupBy("board_id").agg(F.coalesce(best, F.lit(otherwise)).alias("name"))


def drill_name(available: DataFrame) -> DataFrame:
    return first_of(available, ("drill", "PTH", "via"), "drill")


def via_name(available: DataFrame) -> DataFrame:
    """The mask whose holes connect layers; NPTH is never taken."""
    return first_of(available, ("via", "PTH", "drill"), "via")


def connector_mode(masks: DataFrame, vias: DataFrame) -> DataFrame:
    """(board_id, name, mode) from ``masks(board_id, name, sha)``: a via mask equal
    to the drill mask, without a PTH mask, must be inferred."""
    sha = lambda n: F.max(F.when(F.col("name") == n, F.col("sha")))
    by = masks.groupBy("board_id").agg(sha("via").alias("via"), sha("drill").alias("drill"), sha("PTH").alias("pth"))
    same = F.col("pth").isNull() & (F.col("via") == F.col("drill"))
    mode = F.when(F.col("name") == "NPTH", "never").when((F.col("name") == "via") & F.coalesce(same, F.lit(False)), "infer").when(F.col("name").isin("via", "PTH"), "explicit").otherwise("infer")
    return vias.join(by, "board_id").select("board_id", "name", mode.alias("mode"))


def default_outer(layers: DataFrame) -> DataFrame:
    """Outer layers of a stack (board_id, layer, layer_ord): both ends, and
    F_Cu and B_Cu where present."""
    ends = layers.groupBy("board_id").agg(F.min("layer_ord").alias("lo"), F.max("layer_ord").alias("hi"))
    rows = layers.join(ends, "board_id").where((F.col("layer_ord") == F.col("lo")) | (F.col("layer_ord") == F.col("hi")) | F.col("layer").isin("F_Cu", "B_Cu"))
    return rows.select("board_id", "layer")


def with_aliases(holes: DataFrame) -> DataFrame:
    """Hole masks (board_id, name, ...) with via and drill filled in from PTH,
    and drill from via; masks that exist stay."""
    have = holes.select("board_id", "name").distinct()
    want = have.where("name IN ('PTH', 'via')").select("board_id", F.col("name").alias("source"), F.explode(F.when(F.col("name") == "PTH", F.array(F.lit("via"), F.lit("drill"))).otherwise(F.array(F.lit("drill")))).alias("name"))
    want = want.join(have, ["board_id", "name"], "left_anti").groupBy("board_id", "name").agg(F.min("source").alias("source"))
    extra = holes.withColumnRenamed("name", "source").join(want, ["board_id", "source"]).drop("source")
    return holes.unionByName(extra)


def mask_pairs(have: DataFrame) -> DataFrame:
    """(board_id, mask, copper): the solder mask that goes with each outer copper
    layer of ``have(board_id, name)``."""
    side = F.create_map(F.lit("F_Cu"), F.lit("F_Mask"), F.lit("B_Cu"), F.lit("B_Mask"))
    return have.select("board_id", side[F.col("name")].alias("mask"), F.col("name").alias("copper")).where("mask IS NOT NULL").distinct()
