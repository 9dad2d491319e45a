"""Layer drawings for viewers: text that can stand beside other drawings.

A drawing becomes a mask by luminance under one rectangle in the viewer's
colour, so that what erases copper is transparent and a style sheet colours the
layer.  Names within a drawing get its layer as prefix, since drawings on one
page would share them.  An inverted layer begins with a full area and swaps the
colours that add and erase; colours of neither kind stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import artwork


def _names(text: Column, prefix: Column) -> Column:
    """Ids and the references to them, prefixed."""
    for before in (r"""(\sid\s*=\s*["'])""", r"""(url\(\s*["']?#)""", r"""(\s(?:xlink:)?href\s*=\s*["']#)"""):
        text = F.regexp_replace(text, F.lit(before), F.concat(F.lit("$1"), prefix, F.lit("-")))
    return text


def _painted(text: Column, pairs: list[tuple[tuple[str, ...], str]]) -> Column:
    """Fill and stroke of each list of colours replaced, all lists at once."""
    mark = "colour:{}"
    for i, (colours, _) in enumerate(pairs):
        text = F.regexp_replace(text, rf"""(?i)(\s(?:fill|stroke)\s*=\s*["'])(?:{"|".join(colours)})(?=["'])""", "$1" + mark.format(i))
    for i, (_, colour) in enumerate(pairs):
        text = F.regexp_replace(text, rf"""(\s(?:fill|stroke)\s*=\s*["']){mark.format(i)}(?=["'])""", "$1" + colour)
    return text


def size(svgs: DataFrame) -> DataFrame:
    """(board_id, layer, x, y, w, h) of drawings; null where there is no size."""
    root = F.regexp_extract("svg", r"<svg\b[^>]*>", 0)
    box = F.split(F.trim(artwork.attribute(root, "viewBox")), r"[\s,]+")
    origin = lambda i: F.coalesce(F.get(box, F.lit(i)).try_cast("double"), F.lit(0.0))
    known = artwork.documents(svgs).select("board_id", "layer", "w", "h")
    return svgs.select("board_id", "layer", origin(0).alias("x"), origin(1).alias("y")).join(known, ["board_id", "layer"])


def luminance(svgs: DataFrame, inverted: DataFrame) -> DataFrame:
    """(board_id, layer, svg) of ``svgs`` as masks; ``inverted(board_id, layer)``
    names layers to turn round.  A drawing without a usable size has null text.

    What is within a drawing's own mask counts, or all of it if it has none.
    """
    s = svgs.join(size(svgs), ["board_id", "layer"]).join(inverted.select("board_id", "layer", F.lit(True).alias("turned")).distinct(), ["board_id", "layer"], "left")
    masked = F.regexp_extract("svg", r"<mask\b[^>]*>([\s\S]*?)(?:</mask>|\z)", 1)
    whole = F.regexp_extract("svg", r"<svg\b[^>]*>([\s\S]*?)(?:</svg>\s*\z|\z)", 1)
    prefix = F.regexp_replace("layer", r"[^A-Za-z0-9_-]", "_")
    body = _names(F.when(F.col("svg").contains("<mask"), masked).otherwise(whole), prefix)
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    area = F.concat(*(part for c, n in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height")) for part in (F.lit(f' {n}="'), number(c), F.lit('"'))))
    plain = _painted(body, [(artwork.ADDS, "#ffffff"), (artwork.ERASES, "#000000")])
    turned = F.concat(F.lit("<rect"), area, F.lit(' fill="#ffffff"/>'), _painted(body, [(artwork.ADDS, "#000000"), (artwork.ERASES, "#ffffff")]))
    text = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" shape-rendering="crispEdges" viewBox="'), F.concat_ws(" ", *map(number, "xywh")), F.lit('"><mask id="'), prefix, F.lit('-copper" maskUnits="userSpaceOnUse"'), area, F.lit(">"),
        F.when(F.col("turned"), turned).otherwise(plain), F.lit("</mask><rect"), area, F.lit(' fill="currentColor" mask="url(#'), prefix, F.lit('-copper)"/></svg>'),
    )
    return s.select("board_id", "layer", F.when((F.col("w") > 0) & (F.col("h") > 0), text).alias("svg"))
