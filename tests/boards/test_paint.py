import random

import numpy as np
from pyspark.sql import functions as F

from netloom.operators import artwork, paint

W, H = 40, 30


def shapes(r, n):
    """SVG elements and, for each, whether it adds and what it covers at a point."""
    out = []
    for _ in range(n):
        add = r.random() < 0.6
        colour = "#fff" if add else "#000"
        kind = r.choice(["circle", "line", "polygon", "rect", "ring", "poly"])
        a = [round(r.uniform(-5, 45), 2) for _ in range(8)]
        if kind == "circle":
            rad = round(r.uniform(2, 9), 2)
            out.append((f'<circle cx="{a[0]}" cy="{a[1]}" r="{rad}" fill="{colour}"/>', add, ("cap", a[0], a[1], a[0], a[1], rad)))
        elif kind == "line":
            width = round(r.uniform(1, 6), 2)
            out.append((f'<line x1="{a[0]}" y1="{a[1]}" x2="{a[2]}" y2="{a[3]}" stroke="{colour}" stroke-width="{width}"/>', add, ("cap", *a[:4], width / 2)))
        elif kind == "rect":
            w, h = round(r.uniform(1, 20), 2), round(r.uniform(1, 20), 2)
            out.append((f'<rect x="{a[0]}" y="{a[1]}" width="{w}" height="{h}" fill="{colour}"/>', add, ("poly", [[(a[0], a[1]), (a[0] + w, a[1]), (a[0] + w, a[1] + h), (a[0], a[1] + h)]])))
        elif kind == "polygon":  # four points in any order: often crosses itself
            pts = [(a[i], a[i + 1]) for i in range(0, 8, 2)]
            out.append((f'<polygon points="{" ".join(f"{x},{y}" for x, y in pts)}" fill="{colour}"/>', add, ("poly", [pts])))
        elif kind == "poly":
            width, pts = round(r.uniform(1, 4), 2), [(a[i], a[i + 1]) for i in range(0, 6, 2)]
            out.append((f'<polyline points="{" ".join(f"{x},{y}" for x, y in pts)}" stroke="{colour}" fill="none" stroke-width="{width}"/>', add, ("caps", [(*p, *q, width / 2) for p, q in zip(pts, pts[1:], strict=False)])))
        else:  # a box with a hole by parity
            x, y, w = int(a[0]), int(a[1]), r.randint(6, 20)
            sub = [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)], [(x + 2, y + 2), (x + w - 2, y + 2), (x + w - 2, y + w - 2), (x + 2, y + w - 2)]]
            d = "".join("M" + "L".join(f"{p} {q}" for p, q in s) + "Z" for s in sub)
            out.append((f'<path d="{d}" fill="{colour}"/>', add, ("poly", sub)))
    return out


def covers(shape, x, y):
    if shape[0] == "caps":
        return any(covers(("cap", *c), x, y) for c in shape[1])
    if shape[0] == "cap":
        _, x1, y1, x2, y2, half = shape
        dx, dy = x2 - x1, y2 - y1
        t = 0 if dx == dy == 0 else max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        return (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2 <= half * half
    n = 0
    for pts in shape[1]:
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (y1 <= y) != (y2 <= y):
                n += x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x
    return n % 2 == 1


def test_masks_equal_asking_every_pixel(spark):
    r = random.Random(11)
    drawn = {b: shapes(r, 3 + b) for b in range(12)}
    doc = lambda els: f'<svg viewBox="0 0 {W} {H}">' + "".join(e[0] for e in els) + "</svg>"
    svgs = spark.createDataFrame([(b, "F_Cu", doc(e)) for b, e in drawn.items()], "board_id int, layer string, svg string")
    got = np.zeros((12, H, W), bool)
    for row in paint.rasterise(svgs).collect():
        assert not got[row.board_id, row.y, row.x0 : row.x1].any()
        got[row.board_id, row.y, row.x0 : row.x1] = True
    want = np.zeros_like(got)
    for b, els in drawn.items():
        for y, x in np.ndindex(H, W):
            for _, add, shape in els:
                if covers(shape, x + 0.5, y + 0.5):
                    want[b, y, x] = add
    assert (got == want).all(), np.argwhere(got != want)[:5]
    assert want.any(axis=(1, 2)).sum() > 8


def test_bands_of_any_height_and_no_shapes(spark):
    r = random.Random(4)
    svg = f'<svg viewBox="0 0 {W} {H}">' + "".join(e[0] for e in shapes(r, 20)) + "</svg>"
    svgs = spark.createDataFrame([(1, "m", svg), (2, "m", f'<svg viewBox="0 0 {W} {H}"></svg>'), (3, "m", "")], "board_id int, layer string, svg string")
    s = paint.spans(artwork.subpaths(artwork.elements(artwork.documents(svgs))))
    rows = [sorted(map(tuple, paint.paint(s, band).collect())) for band in (1, 7, 1000)]
    assert rows[0] == rows[1] == rows[2] and {x[0] for x in rows[0]} == {1}
    assert paint.paint(s.where("false")).count() == 0
    assert s.agg(F.min("x0"), F.max("x1"), F.min("y"), F.max("y")).first()[0] >= 0
