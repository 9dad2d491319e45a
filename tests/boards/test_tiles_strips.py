import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.operators import audit, components

RUNS = "board_id int, layer string, y int, x0 int, x1 int"


def runs_of(board, grid, layer="m"):
    out = []
    for y, row in enumerate(grid):
        edge = np.diff(np.pad(row.astype(np.int8), 1))
        out += [(board, layer, y, int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(1, 14), st.integers(1, 14), st.integers(1, 14))
def test_correlation_counts_pixels(seed, h, w, hh, ww):
    r = np.random.default_rng(seed)
    d, c = (r.random(s) < 0.5 for s in ((h, w), (hh, ww)))
    got = audit.correlation(d.astype(float), c.astype(float))
    for i, j in np.ndindex(*got.shape):
        dy, dx = i - h + 1, j - w + 1
        n = sum(0 <= y + dy < hh and 0 <= x + dx < ww and c[y + dy, x + dx] for y, x in np.argwhere(d))
        assert got[i, j] == n


def brute(d, c, most):
    """Every displacement within ``most``, the first of the best."""
    h, w = d.shape
    best = (0, 0, 0)
    for dy in range(-min(most, h - 1), min(most, h - 1) + 1):
        for dx in range(-min(most, w - 1), min(most, w - 1) + 1):
            a = d[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            n = int((a & c[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]).sum())
            if n > best[0]:
                best = (n, dy, dx)
    return best[1:]


@pytest.mark.parametrize(("most", "tile"), [(500, 1024), (7, 5), (3, 16)])
def test_offsets_by_tiles_equal_trying_all(spark, most, tile):
    r = np.random.default_rng(4)
    boards = {}
    for b in range(5):
        c = r.random((24, 31)) < 0.15
        d = np.roll(c, (b - 2, 2 * b - 3), (0, 1)) & (r.random(c.shape) < 0.6) if b else r.random(c.shape) < 0.1
        boards[b] = d, c
    boards[5] = np.zeros((24, 31), bool), boards[1][1]  # no drill
    boards[6] = boards[1][0], np.zeros((24, 31), bool)  # no copper
    stripe = np.zeros((24, 31), bool)
    stripe[::2] = True
    boards[7] = stripe, stripe  # many displacements tie within a row
    canvas = spark.createDataFrame([(b, 31, 24) for b in boards], "board_id int, w int, h int")
    frame = lambda k: spark.createDataFrame([x for b, v in boards.items() for x in runs_of(b, v[k])], RUNS)
    got = {r.board_id: (r.dy, r.dx) for r in audit.detect_offset(frame(0), frame(1), canvas, most, tile).collect()}
    assert got == {b: brute(d, c, most) for b, (d, c) in boards.items()}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 20), st.floats(0.1, 0.9))
def test_overlaps_of_rows(seed, h, w, share):
    grid = np.random.default_rng(seed).random((h, w)) < share
    rows = runs_of(1, grid)
    y, x0, x1 = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
    got = sorted(zip(*(v.tolist() for v in components.overlapping(y, x0, x1)), strict=True))
    want = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[2] + 1 == b[2] and a[3] < b[4] and b[3] < a[4]]
    assert got == sorted(want)


@pytest.mark.parametrize("strip", [1, 2, 7, 1000])
def test_strips_of_any_height_give_the_same_labels(spark, strip):
    r = np.random.default_rng(strip)
    spiral = np.zeros((40, 40), bool)  # one component that crosses every seam many times
    for k in range(0, 20, 2):
        spiral[k : 40 - k, k] = spiral[k, k : 40 - k] = spiral[39 - k, k : 40 - k] = spiral[k + 2 : 40 - k, 39 - k] = True
        spiral[k + 2, k : k + 2] = True
    rows = runs_of(1, spiral, "a") + runs_of(1, r.random((40, 40)) < 0.55, "b") + runs_of(2, r.random((33, 50)) < 0.6, "a") + [(3, "a", 5, 0, 9)]
    df = spark.createDataFrame(rows, RUNS)
    key = lambda x: sorted(map(tuple, x.select("board_id", "layer", "y", "x0", "x1", "component").collect()))
    assert key(components.label_distributed(df, strip)) == key(components.label(df))
    assert components.label_distributed(df.where("false"), strip).count() == 0
