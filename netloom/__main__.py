"""Command line: python -m netloom {nets,audit,align,explain,drill-identify,render,index} ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import masks
from netloom.plans import jobs
from netloom.plans.extract import Extraction
from netloom.plans.store import NetCache, by_board, mask_digests
from netloom.sources import boards, files, png
from netloom.storage import stored


def offset(spec: str) -> tuple[str, int, int]:
    """LAYER=DY,DX, or DY,DX for the drill mask."""
    layer, _, pair = spec.rpartition("=")
    try:
        dy, dx = map(int, pair.split(","))
    except ValueError:
        raise argparse.ArgumentTypeError(f"an offset is [LAYER=]DY,DX in whole pixels, not {spec!r}") from None
    return layer or "drill", dy, dx


def names(text: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in text.split(",") if n.strip())


def shown(rows: DataFrame) -> None:
    """Prints all rows, as tab-separated lines, one partition at a time."""
    print(*rows.columns, sep="\t")
    for r in rows.toLocalIterator():
        print(*r, sep="\t")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="netloom", description="Board connectivity on Spark")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("nets", "audit", "align", "drill-identify", "render"):
        s = sub.add_parser(name)
        s.add_argument("source", help="folder of canvas, runs and drill tables, or of star-schema tables with --derive")
        s.add_argument("--derive", action="store_true")
        s.add_argument("--masks", action="store_true", help="the source is a folder of board_id=N/<layer>.png; layers and mode are each board's own unless named")
        s.add_argument("--threshold", type=int, default=0, help="brightness above which a pixel of a PNG is set")
        s.add_argument("--layers", type=names)
        s.add_argument("--mode", choices=("infer", "explicit", "never"))
        s.add_argument("--auto-align", action="store_true")
        s.add_argument("--invert", type=names, default=(), help="layers to invert whatever the audit says")
        s.add_argument("--no-invert", type=names, default=(), help="layers never to invert")
        s.add_argument("--no-auto-invert", action="store_true")
        s.add_argument("--offset", type=offset, action="append", default=[], metavar="[LAYER=]DY,DX", help="move a mask on every board, as --offset=-1,2 where DY is negative")
        s.add_argument("--choices", help="folder of JSON documents board_id=N/*.json with decisions by drill")
        s.add_argument("--drill-files", help="folder of drill files board_id=N/*, split by --choices by object, or by what the masks say")
        s.add_argument("--drawings", help="folder of board_id=N/<layer>.svg: render writes them as masks, with the geometry of all nets")
        s.add_argument("--cache", help="folder of nets by mask contents: only boards that are new there are labelled")
        s.add_argument("--out")
    s = sub.add_parser("explain")
    s.add_argument("out")
    s.add_argument("board", type=int)
    s.add_argument("start")
    s.add_argument("end")
    sub.add_parser("index").add_argument("out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("netloom").getOrCreate()

    if a.job == "index":
        rows = jobs.gallery(spark, a.out).orderBy("board_id")
        rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{a.out}/gallery")
        shown(rows)
        return 0
    if a.job == "explain":
        labels = jobs.table(spark, a.out, "labels")
        got = jobs.resolve_spec(labels, spark.createDataFrame([(a.board, x) for x in (a.start, a.end)], "board_id int, spec string")).collect()
        bad = [r for r in got if r.error]
        if bad:
            print(*(f"{r.spec}: {r.error}" for r in bad), sep="\n", file=sys.stderr)
            return 2
        name = {r.spec: f"{r.layer}:{r.component}" for r in got}
        ends = spark.createDataFrame([(a.board, name[a.start], name[a.end])], "board_id int, start string, end string")
        steps = jobs.explained(spark, a.out, ends).orderBy("step").collect()
        print(*(r.text for r in steps) if steps else ("not connected",), sep="\n")
        return 0 if steps else 1

    if a.masks:
        canvas, every = png.load(spark, a.source, threshold=a.threshold)
        every = stored(every, "masks")
        if a.layers is None and a.job != "align":
            return by_own_stack(spark, a, p, canvas, every)
        runs, drill = every.where("layer <> 'drill'"), every.where("layer = 'drill'")
    elif a.derive:
        b = boards.derive(spark, a.source)
        canvas, runs, drill = b.canvas, b.runs, b.drill
    else:
        canvas, runs, drill = (spark.read.parquet(f"{a.source}/{n}") for n in ("canvas", "runs", "drill"))
    return run(spark, a, p, canvas, runs, drill, a.layers or boards.COPPER, a.mode or "infer")


def by_own_stack(spark: SparkSession, a: argparse.Namespace, p: argparse.ArgumentParser, canvas: DataFrame, every: DataFrame) -> int:
    """The job for every kind of board: one run for each stack, connecting mask
    and mode among them, over all boards of that kind."""
    plans = stored(jobs.board_plans(mask_digests(every)), "plans")
    kinds = plans.select("layers", "via", "mode").distinct().orderBy("layers", "via", "mode").collect()  # as many as there are kinds
    worst = 0
    for kind in kinds:
        mine = plans.where((F.col("layers") == F.array(*map(F.lit, kind.layers))) & (F.col("via") == kind.via) & (F.col("mode") == kind.mode)).select("board_id")
        own = every.join(mine, "board_id", "left_semi")
        drill = own.where(F.col("layer") == kind.via).withColumn("layer", F.lit("drill"))
        worst = max(worst, run(spark, a, p, canvas.join(mine, "board_id", "left_semi"), own, drill, tuple(kind.layers), a.mode or kind.mode))
    return worst


def run(spark: SparkSession, a: argparse.Namespace, p: argparse.ArgumentParser, canvas: DataFrame, runs: DataFrame, drill: DataFrame, layers: tuple[str, ...], mode: str) -> int:
    chosen = runs.where(runs.layer.isin(*layers))
    if a.job == "audit":
        report = jobs.audit_report(chosen, drill, canvas, layers, a.auto_align)
        if a.out:
            by_board(report, f"{a.out}/audit", "json")
        shown(report.orderBy("board_id", "check", "layer"))
        return int(report.where("warns").limit(1).count() > 0)
    if not a.out:
        p.error("--out is needed")
    moves = F.array(*(F.struct(*map(F.lit, o)) for o in a.offset)).cast("array<struct<layer:string,dy:int,dx:int>>")
    manual = canvas.select("board_id", F.explode(moves).alias("o")).select("board_id", "o.*")
    if a.job == "align":
        moved = runs.where(runs.layer.isin(*layers, "via", "F_Mask", "B_Mask"))
        jobs.write_aligned(moved, drill, canvas, a.out, manual)
        return 0
    chosen = masks.shift(chosen, manual, canvas, "left")
    own = manual.where("layer = 'drill'") if any(n == "drill" for n, _, _ in a.offset) else None
    copper, holes = jobs.prepared(chosen, drill, canvas, layers, a.auto_align, own, auto=not a.no_auto_invert, force=a.invert, forbid=a.no_invert)
    if a.cache:
        e, n = NetCache(spark, a.cache).extract(stored(copper, "copper"), stored(holes, "drill"), canvas, layers, mode)
        print(f"{n} boards labelled", file=sys.stderr)
    else:
        e = Extraction(copper, holes, canvas, layers, mode)
    if a.job == "drill-identify":
        texts = spark.read.text(a.choices, wholetext=True).select("board_id", F.col("value").alias("json")) if a.choices else None
        jobs.identify_drills(e, a.out, files.read_choices(texts) if a.choices else None)
        if a.drill_files:
            whole = spark.read.text(a.drill_files, wholetext=True).select("board_id", F.col("value").alias("text"))
            decided = files.read_object_choices(texts) if a.choices else files.object_decisions(files.match_objects(e.blobs, files.read_excellon(whole)), e.decisions)
            jobs.write_drill_files(whole, decided, a.out)
    else:
        if a.job == "render" and a.drawings:  # first: it refuses what drawings can't follow
            svgs = stored(jobs.read_drawings(spark, a.drawings).join(canvas.select("board_id"), "board_id", "left_semi"), "svgs")
            done = jobs.corrections(chosen, drill, canvas, layers, manual, a.auto_align, auto=not a.no_auto_invert, force=a.invert, forbid=a.no_invert)
            jobs.write_drawings(e, svgs, stored(done, "corrections"), a.out)
        {"nets": jobs.write_extraction, "render": jobs.render}[a.job](e, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
