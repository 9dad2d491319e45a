import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import components, drills, masks, nets
from netloom.plans.extract import Extraction
from netloom.sources import boards

RUN = "board_id int, layer string, y int, x0 int, x1 int"


def rect(layer, x0, y0, x1, y1, board=1):
    """A rectangle with inclusive corners."""
    return [(board, layer, y, x0, x1 + 1) for y in range(y0, y1 + 1)]


def ellipse(layer, x0, y0, x1, y1, board=1):
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2
    return [(board, layer, y, x, x + 1) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1) if ((x - cx) / rx) ** 2 + ((y - cy) / ry) ** 2 <= 1]


def extract(spark, copper, drill, mode, size=(200, 100), layers=("F_Cu", "B_Cu")):
    run = lambda rows: masks.merge_runs(spark.createDataFrame(rows, RUN))
    canvas = spark.createDataFrame([(1, *size)], "board_id int, w int, h int")
    return Extraction(run(copper), run(drill), canvas, layers, mode)


def test_hole_joins_layers(spark):
    e = extract(spark, rect("F_Cu", 50, 30, 90, 70) + rect("B_Cu", 60, 40, 100, 80), ellipse("drill", 65, 45, 85, 65), "explicit")
    assert {(r.layer, r.component) for r in e.members.collect()} == {("F_Cu", 1), ("B_Cu", 1)}
    assert {r.net for r in e.nets.collect()} == {1}
    b = e.blobs.first()
    assert (b.x0, b.y0, b.x1, b.y1, b.cx, b.cy) == (65, 45, 86, 66, 75.0, 55.0)
    want = spark.createDataFrame([(1, "F_Cu:1", "B_Cu:1"), (1, "F_Cu:1", "F_Cu:1"), (1, "F_Cu:1", "X:9")], "board_id int, start string, end string")
    assert [tuple(r)[3:] for r in nets.explain(e.members, want).collect()] == [(1, "F_Cu:1", 1, "B_Cu:1")]


def test_separate_nets_and_isolated_ids(spark):
    e = extract(spark, rect("F_Cu", 10, 10, 40, 40) + rect("B_Cu", 100, 50, 130, 80) + rect("F_Cu", 150, 5, 160, 15), ellipse("drill", 20, 20, 30, 30) + ellipse("drill", 110, 60, 120, 70), "explicit")
    got = {(r.layer, r.component): r.net for r in e.nets.collect()}
    assert got == {("B_Cu", 1): 1, ("F_Cu", 1): 3, ("F_Cu", 2): 2} or sorted(got.values()) == [1, 2, 3]
    assert got["B_Cu", 1] == 1  # layers count in lexicographic order
    assert e.members.select("drill").distinct().count() == 2


@pytest.mark.parametrize("copper,mode,plated,name,rule", [
    ([], "infer", False, "likely_npth", 3),
    (rect("F_Cu", 0, 0, 79, 79) + rect("B_Cu", 0, 0, 79, 79), "infer", True, "likely_pth", 6),
    (rect("F_Cu", 0, 0, 79, 79) + rect("B_Cu", 0, 0, 79, 79), "explicit", True, "explicit_pth", 2),
    (rect("F_Cu", 0, 0, 79, 79) + rect("B_Cu", 0, 0, 79, 79), "never", False, "explicit_npth", 1),
    ([], "explicit", False, "explicit_pth_no_copper", 2),
    (rect("F_Cu", 40, 35, 70, 45) + rect("B_Cu", 10, 35, 40, 45), "infer", False, "likely_npth", 3),
    (rect("F_Cu", 0, 0, 79, 79), "infer", False, "ambiguous_likely_npth", 5),
])
def test_classification(spark, copper, mode, plated, name, rule):
    d = extract(spark, copper, ellipse("drill", 35, 35, 45, 45), mode, (80, 80)).decisions.first()
    assert (d.plated, d.classification, d.rule) == (plated, name, rule)


def test_weak_contacts_decide_nothing(spark):
    dr = spark.createDataFrame([(1, 1, 5.0)], "board_id int, drill int, radius_px double")
    lim = spark.createDataFrame([(1, 8.0, 20.0)], "board_id int, small_px double, large_px double")
    schema = "board_id int, drill int, layer string, component_ids array<int>, copper_fraction double, pad_ring_fraction double, pad_ring_angular_coverage double, contact string"
    weak = spark.createDataFrame([(1, 1, n, [1], 0.5, 0.9, 0.3, "partial") for n in ("F_Cu", "B_Cu")], schema)
    assert drills.classify(dr, weak, lim, ("F_Cu", "B_Cu")).first().classification == "likely_npth"
    full = spark.createDataFrame([(1, 1, n, [1], 0.9, 0.84, None, "all_around") for n in ("F_Cu", "B_Cu")], schema)
    assert drills.classify(dr, full, lim, ("F_Cu", "B_Cu")).first().plated


def test_split_and_override(spark):
    copper = rect("F_Cu", 12, 12, 28, 28) + rect("B_Cu", 12, 12, 28, 28)
    e = extract(spark, copper, ellipse("drill", 15, 15, 25, 25) + ellipse("drill", 55, 55, 65, 65), "infer", (80, 80))
    at = lambda d: {(r.layer, y) for r in drills.split_masks(e.drill_labelled, d).collect() for y in (r.y,) if r.y in (20, 60)}
    assert at(e.decisions) == {("PTH", 20), ("NPTH", 60)}
    choices = spark.createDataFrame([(1, 1, False), (1, 2, True)], "board_id int, drill int, plated boolean")
    turned = drills.override(e.decisions, choices)
    assert at(turned) == {("NPTH", 20), ("PTH", 60)} and all(r.override for r in turned.collect())


def test_distributed_labels_agree(spark):
    r = random.Random(2)
    rows = [(b, "m", y, x, x + 1) for b in (1, 2) for y in range(20) for x in range(20) if r.random() < 0.55]
    runs = masks.merge_runs(spark.createDataFrame(rows, RUN))
    key = lambda df: sorted(map(tuple, df.select("board_id", "y", "x0", "x1", "component").collect()))
    a = key(components.label(runs))
    assert a == key(components.label_distributed(runs))
    label = {(b, y, x): c for b, y, x0, x1, c in a for x in range(x0, x1)}
    for b, y, x in label:  # equal exactly along 4-neighbours
        for n in ((b, y + 1, x), (b, y, x + 1)):
            assert n not in label or label[n] == label[b, y, x]
    assert components.stats(components.label(runs)).agg(F.sum("area_px")).first()[0] == len(rows)


def test_merge_is_idempotent_over_derived_boards(spark):
    b = boards.derive(spark, "/root/testdata/sf0.001")
    e = Extraction(b.copper, b.drill, b.canvas, boards.COPPER)
    n = e.nets.toPandas()
    assert len(n) == e.components.count()
    for _, g in n.groupby("board_id"):
        assert sorted(set(g.net)) == list(range(1, g.net.max() + 1))
    assert {r.rule for r in e.decisions.collect()} == {3, 5, 6, 7, 9}


def test_check(spark):
    canvas = spark.createDataFrame([(1, 9, 9), (2, 9, 9), (3, 9, 9), (4, 9, 9)], "board_id int, w int, h int")
    net = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2), (2, "a", 1, 1), (3, "a", 1, 1), (3, "a", 2, 2), (3, "b", 1, 3)], "board_id int, layer string, component int, net int")
    st = spark.createDataFrame([(1, "a", 1, 80), (1, "b", 1, 20), (2, "a", 1, 5), (3, "a", 1, 5), (3, "a", 2, 5), (3, "b", 1, 5)], "board_id int, layer string, component int, area_px int")
    got = {r.board_id: (r.n_nets, r.warnings) for r in nets.check(net, st, canvas).collect()}
    assert got == {1: (2, ["one net dominates"]), 2: (1, ["a single net"]), 3: (3, []), 4: (0, ["no nets"])}
