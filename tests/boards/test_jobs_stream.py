import numpy as np
import pytest
from pyspark.sql import functions as F
from test_connectivity import ellipse, extract, rect

from netloom.__main__ import main
from netloom.plans import jobs
from netloom.sources import files
from netloom.streaming import boards as stream


def board(spark):
    return extract(spark, rect("F_Cu", 50, 30, 90, 70) + rect("B_Cu", 60, 40, 100, 80) + rect("F_Cu", 5, 5, 9, 9), ellipse("drill", 65, 45, 85, 65), "explicit")


def test_files_of_a_run(spark, tmp_path):
    out = str(tmp_path)
    jobs.write_extraction(board(spark), out)
    assert spark.read.parquet(f"{out}/nets").count() == 3
    specs = spark.createDataFrame([(1, s) for s in ("F_Cu:2", "F_Cu:60,50", "F_Cu:0", "F_Cu:0,0", "F_Cu:x", "B_Cu:70,60")], "board_id int, spec string")
    got = {r.spec: (r.component, bool(r.error)) for r in jobs.resolve_spec(spark.read.parquet(f"{out}/labels"), specs).collect()}
    assert got["F_Cu:2"] == (2, False) and got["F_Cu:60,50"] == (2, False) and got["B_Cu:70,60"] == (1, False)
    assert got["F_Cu:0"][1] and got["F_Cu:0,0"][1] and got["F_Cu:x"][1]
    want = spark.createDataFrame([(1, "F_Cu:2", "B_Cu:1")], "board_id int, start string, end string")
    assert "drill 1 (75.0,55.0)" in jobs.explained(spark, out, want).first().text
    runs = jobs.load_labels(spark, out, ("F_Cu", "B_Cu"))
    assert {(r.layer, r.layer_ord) for r in runs.select("layer", "layer_ord").distinct().collect()} == {("F_Cu", 0), ("B_Cu", 1)}
    try:
        jobs.load_labels(spark, out, ("F_Cu",))
        raise AssertionError("layers differ")
    except ValueError as e:
        assert "expected" in str(e)


def test_render_identify_and_report(spark, tmp_path):
    e, out = board(spark), str(tmp_path)
    jobs.render(e, out)
    assert jobs.gallery(spark, out).first().n_nets == 2
    jobs.identify_drills(e, out)
    assert {r.layer for r in spark.read.parquet(f"{out}/masks").select("layer").distinct().collect()} == {"PTH", "via", "drill"}
    report = jobs.audit_report(e.copper, e.drill, e.canvas, ("F_Cu", "B_Cu")).collect()
    assert {(r.check, r.verdict) for r in report} == {("polarity", "none"), ("alignment", "none")}
    shifts = spark.createDataFrame([(1, "drill", 2, 3, "manual"), (1, "drill", 9, 9, "auto")], "board_id int, layer string, dy int, dx int, source string")
    moved, manifest = jobs.align_layers(e.drill, e.canvas, shifts)
    assert manifest.first().source == "manual" and moved.agg({"y": "min"}).first()[0] == 47


def test_command_line(spark, tmp_path):
    e, src, out = board(spark), tmp_path / "in", str(tmp_path / "out")
    for name, df in (("canvas", e.canvas), ("runs", e.copper), ("drill", e.drill)):
        df.write.parquet(str(src / name))
    run = lambda job, *more: main([job, str(src), "--layers", "F_Cu,B_Cu", "--mode", "explicit", "--out", out, *more])
    assert run("align", "--offset", "F_Cu=3,-2", "--offset", "1,0") == 0
    moved = spark.read.parquet(f"{out}/masks")
    top = {r.layer: (r.y, r.x) for r in moved.groupBy("layer").agg(F.min("y").alias("y"), F.min("x0").alias("x")).collect()}
    first = {r.layer: (r.y, r.x) for r in e.copper.groupBy("layer").agg(F.min("y").alias("y"), F.min("x0").alias("x")).collect()}
    assert top["B_Cu"] == first["B_Cu"] and top["F_Cu"] == (first["F_Cu"][0] + 3, first["F_Cu"][1] - 2)
    assert {(r.layer, r.dy, r.dx, r.source) for r in spark.read.json(f"{out}/alignment").collect()} == {("F_Cu", 3, -2, "manual"), ("drill", 1, 0, "manual")}
    (tmp_path / "c/board_id=1").mkdir(parents=True)
    (tmp_path / "c/board_id=1/c.json").write_text('{"decisions": [{"drill": 1, "plated": false}]}')
    assert run("drill-identify", "--choices", str(tmp_path / "c")) == 0
    assert {r.layer for r in spark.read.parquet(f"{out}/masks").select("layer").distinct().collect()} == {"NPTH", "drill"}
    (tmp_path / "d/board_id=1").mkdir(parents=True)
    (tmp_path / "d/board_id=1/all.drl").write_text("M48\nT1C0.5\n%\nT1\nX75Y55\nM30\n")
    assert run("drill-identify", "--drill-files", str(tmp_path / "d")) == 0
    text = {n: "".join(f.read_text() for f in (tmp_path / f"out/drills/board_id=1/layer={n}").glob("*.txt")) for n in ("PTH", "NPTH")}
    assert text == {"PTH": "M48\nT1C0.5\n%\nT1\nX75Y55\nM30\n", "NPTH": "M48\nT1C0.5\n%\nT1\nM30\n"}
    assert "copper touches" in spark.read.json(f"{out}/decisions").first().reason
    assert run("nets", "--offset=-40,0") == 0  # the drill leaves the copper, so nothing merges
    assert spark.read.parquet(f"{out}/nets").select("net").distinct().count() == 3
    assert run("nets", "--invert", "B_Cu", "--no-auto-invert") == 0
    assert spark.read.parquet(f"{out}/labels").where("layer = 'B_Cu' AND y = 0").count() == 1
    with pytest.raises(SystemExit):
        run("nets", "--offset", "one,two")


def test_png_masks(spark, tmp_path):
    import struct
    import zlib

    def png(path, grid, bits):
        h, w = grid.shape
        rows = np.packbits(grid, axis=1) if bits == 1 else np.where(grid, 100, 30).astype(np.uint8)
        body = b"".join(b"\0" + r.tobytes() for r in rows)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))

    grid = np.random.default_rng(1).random((9, 13)) < 0.4
    (tmp_path / "board_id=3").mkdir()
    png(tmp_path / "board_id=3/F_Cu.png", grid, 8)
    png(tmp_path / "board_id=3/drill.png", grid, 1)
    sizes, runs = files.read_masks(spark, str(tmp_path), threshold=50)
    assert tuple(files.checked(sizes).first()) == (3, 13, 9)
    for layer in ("F_Cu", "drill"):
        got = np.zeros_like(grid)
        for r in runs.where(f"layer = '{layer}'").collect():
            got[r.y, r.x0 : r.x1] = True
        assert (got == grid).all()


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(b, 200, 100, n, y, x0, x1) for b in (1, 2) for _, n, y, x0, x1 in rect("F_Cu", 50, 30, 90, 70) + rect("B_Cu", 60, 40, 100, 80) + ellipse("drill", 65, 45, 85, 65)]
    spark.createDataFrame(rows, stream.RUNS).repartition(1, "board_id").write.parquet(src)
    q = stream.extract_stream(stream.arriving(spark, src, 1), out, str(tmp_path / "state"), ("F_Cu", "B_Cu"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).select("board_id", "net").distinct().count() >= 2
