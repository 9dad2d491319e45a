import numpy as np
import pytest
from pyspark.sql import functions as F
from test_connectivity import ellipse, extract, rect

from netloom.plans import jobs, store
from netloom.plans.extract import Extraction

LAYERS = ("F_Cu", "B_Cu")
RUNS = "board_id int, layer string, y int, x0 int, x1 int"


def boards(spark, n=4, extra=()):
    """n boards, of which the last two are alike; ``extra`` runs on top."""
    rows = [(b, *r[1:]) for b in range(1, n + 1) for r in rect("F_Cu", 50, 30, 90, 70 + min(b, n - 1)) + rect("B_Cu", 60, 40, 100, 80)]
    holes = [(b, *r[1:]) for b in range(1, n + 1) for r in ellipse("drill", 65, 45, 85, 65)]
    canvas = spark.createDataFrame([(b, 200, 100) for b in range(1, n + 1)], "board_id int, w int, h int")
    return spark.createDataFrame([*rows, *extra], RUNS), spark.createDataFrame(holes, RUNS), canvas


def digests(runs, canvas, told="x"):
    return {r.board_id: r.digest for r in store.board_digests(runs, canvas, told).collect()}


def test_a_digest_is_what_the_pixels_say(spark):
    runs, _, canvas = boards(spark)
    first = digests(runs, canvas)
    assert len(set(first.values())) == 3 and first[3] == first[4]
    cut = runs.select("board_id", "layer", "y", F.explode(F.array(F.struct("x0", (F.col("x0") + 7).alias("x1")), F.struct((F.col("x0") + 5).alias("x0"), "x1"))).alias("s")).select("board_id", "layer", "y", "s.*")
    assert digests(cut.orderBy(F.desc("y")).repartition(3), canvas) == first
    more = digests(runs.unionByName(spark.createDataFrame([(2, "F_Cu", 3, 4, 5)], RUNS)), canvas)
    assert {b for b in first if more[b] != first[b]} == {2}
    assert not set(digests(runs, canvas.withColumn("w", F.lit(201))).values()) & set(first.values())
    assert not set(digests(runs, canvas, "y").values()) & set(first.values())
    assert len(digests(runs.where("false"), canvas)) == 4


def test_only_new_contents_are_labelled(spark, tmp_path):
    kept = store.NetCache(spark, str(tmp_path / "cache"))
    assert kept.known().count() == 0
    copper, drill, canvas = boards(spark)
    e, n = kept.extract(copper, drill, canvas, LAYERS, "explicit")
    assert n == 3  # two boards are alike
    whole = Extraction(copper, drill, canvas, LAYERS, "explicit")
    rows = lambda df: sorted(map(str, df.collect()))
    for name, df in store.tables_of(whole).items():
        assert rows(store.tables_of(e)[name].select(*df.columns)) == rows(df), name
    assert rows(e.check) == rows(whole.check) and rows(e.net_runs) == rows(whole.net_runs)
    again, n = kept.extract(copper.repartition(5), drill, canvas, LAYERS, "explicit")
    assert n == 0 and rows(again.nets) == rows(whole.nets)
    copper2 = copper.unionByName(spark.createDataFrame([(2, "F_Cu", 3, 4, 5)], RUNS))
    changed, n = kept.extract(copper2, drill, canvas, LAYERS, "explicit")
    assert n == 1 and rows(changed.nets) == rows(Extraction(copper2, drill, canvas, LAYERS, "explicit").nets)
    assert kept.extract(copper, drill, canvas, LAYERS, "never")[1] == 3


def test_a_run_without_a_commit_is_not_read(spark, tmp_path):
    kept = store.NetCache(spark, str(tmp_path / "cache"))
    copper, drill, canvas = boards(spark)
    e, _ = kept.extract(copper, drill, canvas, LAYERS, "explicit")
    want = e.nets.count()
    digest = kept.known().first().digest
    spark.createDataFrame([(digest, "F_Cu", 9, 9)], "digest string, layer string, component int, net int").write.parquet(f"{tmp_path}/cache/nets/run=0-failed")
    assert kept.extract(copper, drill, canvas, LAYERS, "explicit")[0].nets.count() == want


def test_a_run_replaces_its_own_boards(spark, tmp_path):
    out = str(tmp_path)
    copper, drill, canvas = boards(spark)
    jobs.write_extraction(Extraction(copper, drill, canvas, LAYERS, "explicit"), out)
    read = lambda name: {b: sorted(map(str, jobs.table(spark, out, name).where(f"board_id = {b}").collect())) for b in range(1, 5)}
    before = {n: read(n) for n in store.TABLES}
    assert all(before["drills"].values())
    one = "board_id = 2"
    e = Extraction(copper.where(one), drill.where("false"), canvas.where(one), LAYERS, "explicit")
    jobs.write_extraction(e, out)
    after = {n: read(n) for n in store.TABLES}
    assert not after["drills"][2] and not after["contacts"][2] and not after["members"][2] and after["labels"][2] == before["labels"][2]
    assert all(after[n][b] == before[n][b] for n in store.TABLES for b in (1, 3, 4))
    assert {p.name for p in (tmp_path / "json").glob("board_id=*")} == {f"board_id={b}" for b in range(1, 5)}


def test_a_failed_run_leaves_the_old_state(spark, tmp_path):
    out = str(tmp_path)
    copper, drill, canvas = boards(spark)
    jobs.write_extraction(Extraction(copper, drill, canvas, LAYERS, "explicit"), out)
    before = {n: sorted(map(str, jobs.table(spark, out, n).collect())) for n in store.TABLES}
    e = Extraction(copper.where("board_id < 3"), drill.where("false"), canvas.where("board_id < 3"), LAYERS, "explicit")
    e.__dict__["members"] = e.members.withColumn("drill", F.raise_error(F.lit("no")).cast("int")).unionByName(spark.createDataFrame([(1, 1, "F_Cu", 1)], "board_id int, drill int, layer string, component int").withColumn("drill", F.raise_error(F.lit("no")).cast("int")))
    with pytest.raises(Exception, match="no"):
        jobs.write_extraction(e, out)
    assert before == {n: sorted(map(str, jobs.table(spark, out, n).collect())) for n in store.TABLES}


def test_labels_of_another_size_are_refused(spark, tmp_path):
    out = str(tmp_path)
    e = extract(spark, rect("F_Cu", 5, 5, 9, 9) + rect("B_Cu", 5, 5, 9, 9), ellipse("drill", 65, 45, 85, 65), "explicit")
    jobs.write_extraction(e, out)
    assert jobs.load_labels(spark, out, LAYERS, e.canvas).count() > 0
    with pytest.raises(ValueError, match="expected 201 x 100, found 200 x 100"):
        jobs.load_labels(spark, out, LAYERS, e.canvas.withColumn("w", F.lit(201)))
    assert np.all([r.layer in LAYERS for r in jobs.table(spark, out, "labels").collect()])
