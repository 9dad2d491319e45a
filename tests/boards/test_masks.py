import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from netloom.operators import masks

CANVAS = "board_id int, w int, h int"


def runs_of(spark, grids, layer="m"):
    rows = [(b, layer, int(y), int(x)) for b, g in grids.items() for y, x in np.argwhere(g)]
    return masks.from_pixels(spark.createDataFrame(rows, "board_id int, layer string, y int, x int"))


def grid_of(runs, shape=(8, 10), boards=(1,)):
    out = {b: np.zeros(shape, bool) for b in boards}
    for r in runs.collect():
        assert not out[r.board_id][r.y, r.x0 : r.x1].any() and r.x0 < r.x1
        out[r.board_id][r.y, r.x0 : r.x1] = True
    return out


grids = st.integers(0, 2**32 - 1).map(lambda s: np.random.default_rng(s).random((8, 10)) < 0.4)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(grids, grids, st.integers(-9, 9), st.integers(-11, 11))
def test_algebra_matches_arrays(spark, a, b, dy, dx):
    canvas = spark.createDataFrame([(1, 10, 8)], CANVAS)
    ra, rb = runs_of(spark, {1: a}, "a"), runs_of(spark, {1: b}, "b")
    assert (grid_of(ra)[1] == a).all()
    assert (grid_of(masks.union_layers(ra.unionByName(rb), "u"))[1] == (a | b)).all()
    assert (grid_of(masks.intersect(ra, rb))[1] == (a & b)).all()
    assert (grid_of(masks.punch(ra, rb, canvas))[1] == (a & ~b)).all()
    layers = masks.layer_canvas(canvas, ("a",))
    inverse = masks.complement(ra, layers)
    assert (grid_of(inverse)[1] == ~a).all()
    assert (grid_of(masks.complement(inverse, layers))[1] == a).all()
    want = np.zeros_like(a)
    for y, x in np.argwhere(a):
        if 0 <= y + dy < 8 and 0 <= x + dx < 10:
            want[y + dy, x + dx] = True
    moved = masks.shift(ra, spark.createDataFrame([(1, dy, dx)], "board_id int, dy int, dx int"), canvas)
    assert (grid_of(moved)[1] == want).all()
    fill = masks.fill(ra, layers).first()
    assert fill.area_px == a.sum() and fill.fill == pytest.approx(a.mean())


def test_size_mismatch(spark):
    sizes = spark.createDataFrame([(1, "a", 100, 50), (1, "drill", 120, 50), (2, "a", 5, 5), (2, "b", 5, 5)], "board_id int, layer string, w int, h int")
    assert [r.board_id for r in masks.mismatched(sizes).collect()] == [1]
    from netloom.sources import files

    with pytest.raises(ValueError, match="dimensions differ"):
        files.checked(sizes)
    assert files.checked(sizes.where("board_id = 2")).first().w == 5
