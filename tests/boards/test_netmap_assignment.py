import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.operators import netmap
from netloom.operators.assignment import Assignment


def doc(body, box="0 0 20 10"):
    return f'<svg viewBox="{box}">{body}</svg>'


def path(d, net=3):
    return f'<path class="x" data-net-id="{net}" data-layer="F" d="{d}"/>'


CASES = {  # data -> (rectangles, whether the rest is odd)
    "M0 0H4V4H0Z": ([(0, 0, 4, 4)], False),
    "M0 0H4V4H0ZM6 6H9V9H6Z ,": ([(0, 0, 4, 4), (6, 6, 9, 9)], False),
    "M0 0H4V4H0ZL5 5M6 6H9V9H6Z": ([(0, 0, 4, 4)], True),
    "M 0 0H 4V 4H 0Z": ([(0, 0, 4, 4)], False),
    " ,M1,2H,5V 6H1Z": ([(1, 2, 5, 6)], False),
    "M0 0 H4V4H0Z": ([], True),
    "M0 0H4V4H0Zx": ([(0, 0, 4, 4)], True),
    "M0 0H4V4H0": ([], True),
    "": ([], False),
    "M0.5 0.49H3.5V2.4H0Z": ([(1, 0, 4, 2)], False),
    "M-3 -3H2V2H0Z": ([(0, 0, 2, 2)], False),
    "M50 50H60V60H0Z": ([(19, 9, 20, 10)], False),
    "M4 4H1V1H4Z": ([(4, 4, 5, 5)], False),
    "MHVHZ": ([(0, 0, 1, 1)], False),
}


def test_the_longest_well_formed_beginning_counts(spark):
    maps = spark.createDataFrame([(i, doc(f'<g data-layer="F">{path(d)}</g>')) for i, d in enumerate(CASES)], "board_id int, svg string")
    got = {i: [] for i in range(len(CASES))}
    for r in netmap.parse_netmap(maps).orderBy("ord").collect():
        got[r.board_id].append((r.x0, r.y0, r.x1, r.y1))
    odd = {r.board_id: r.odd_paths for r in netmap.odd_paths(maps).collect()}
    assert {d: (got[i], bool(odd[i])) for i, d in enumerate(CASES)} == CASES


def test_attributes_groups_and_sizes(spark):
    one = "M0 0H4V4H0Z"
    maps = spark.createDataFrame([
        (1, doc(f"<g class='a' data-layer='F&amp;B'><path d='{one}' data-net-id='7' title=\"a > b\"/><g></g>{path('M4 0H6V1H4Z', 8)}</g>{path(one, 9)}<g data-layer=\"B\">{path(one, 70000)}</g>")),
        (2, doc(f'<g data-layer="F">{path(one)}')),  # never closed
        (3, f'<svg><g data-layer="F">{path(one)}</g></svg>'),  # no size
        (4, doc(f'<g data-layer="F">{path(one, "x")}</g>')),
        (5, doc(f'<g data-layer="F">{path("M2 2H7V7H2Z")}</g>', "0 0 9.6 9.4")),
        (6, None),
    ], "board_id int, svg string")
    rows = [tuple(r) for r in netmap.parse_netmap(maps, shift=1).orderBy("board_id", "ord").drop("ord").collect()]
    assert rows == [(1, "F&amp;B", 7, 0, 0, 2, 2), (1, "F&amp;B", 8, 2, 0, 3, 1), (1, "B", 70000, 0, 0, 2, 2), (5, "F", 3, 1, 1, 3, 3)]
    stats = {r.board_id: (r.paths, r.rects, r.max_net) for r in netmap.netmap_stats(maps).collect()}
    assert stats[2] == stats[3] == stats[4] == stats[6] == (0, 0, 0) and stats[5] == (1, 1, 3)
    assert stats[1] == (3, 3, 70000)


def test_long_paths_are_read_whole(spark):
    d = "".join(f"M{i % 19} {i % 9}H{i % 19 + 1}V{i % 9 + 1}H{i % 19}Z" for i in range(60_000))
    maps = spark.createDataFrame([(1, doc(f'<g data-layer="F">{path(d)}</g>'))], "board_id int, svg string")
    assert tuple(netmap.netmap_stats(maps).first()) == (1, 1, 60_000, 0, 3)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 7), st.integers(1, 3), st.booleans())
def test_assignments_cost_what_trying_all_finds(seed, n, nearest, lattice):
    r = np.random.default_rng(seed)
    p, q = (r.integers(0, 3, (n, 2)).astype(float) if lattice else r.random((n, 2)) for _ in range(2))
    got = Assignment.of_points(p, q, nearest)
    assert sorted(got.of) == list(range(n))
    best = min((sum(float(np.hypot(*(p[i] - q[j]))) for i, j in enumerate(order)) for order in itertools.permutations(range(n))), default=0.0)
    assert got.cost == pytest.approx(best, abs=1e-7) and got.bound == pytest.approx(best, abs=1e-7)


def test_a_dense_board_in_little_memory():
    import tracemalloc

    r = np.random.default_rng(1)
    p = r.random((3000, 2))
    q = (p + r.normal(0, 0.004, p.shape))[r.permutation(3000)]
    q[:40] = [0.5, 0.5]  # a crowd in one place
    tracemalloc.start()
    got = Assignment.of_points(p, q)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000  # all pairs alone would take 72
    tracemalloc.stop()
    assert sorted(got.of) == list(range(3000)) and got.cost - got.bound < 1e-5
