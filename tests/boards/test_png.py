import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.__main__ import main
from netloom.plans import jobs
from netloom.sources import png

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode(px, depth, colour, filters=(0,), palette=None, parts=3, interlaced=0):
    """A PNG of samples (h, w, channels), each row under the next of ``filters``."""
    h, w, _ = px.shape
    step = max(1, depth * CHANNELS[colour] // 8)
    if depth == 16:
        rows = px.astype(">u2").view(np.uint8).reshape(h, -1)
    elif depth == 8:
        rows = px.reshape(h, -1).astype(np.uint8)
    else:
        bits = (px.reshape(h, -1, 1) >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(h, -1)
        rows = np.packbits(bits, axis=1)
    out, above = b"", [0] * rows.shape[1]
    for y, row in enumerate(rows.tolist()):
        kind = filters[y % len(filters)]
        line = []
        for i, v in enumerate(row):
            a, b, c = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append(v - (0, a, b, (a + b) // 2, paeth)[kind] & 255)
        out += bytes([kind, *line])
        above = row
    body = zlib.compress(out)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    cuts = [len(body) * i // parts for i in range(parts + 1)]
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced))
    plte = chunk(b"PLTE", bytes(palette)) if palette else b""
    return png.SIGNATURE + head + plte + b"".join(chunk(b"IDAT", body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) + chunk(b"IEND", b"")


def grey(px, depth, colour, palette=None):
    """What the samples' brightness is, pixel by pixel."""
    out = np.zeros(px.shape[:2], int)
    for y, x in np.ndindex(*out.shape):
        s = [int(v) >> 8 if depth == 16 else int(v) for v in px[y, x]]
        if colour == 3:
            s = list(palette[3 * s[0] : 3 * s[0] + 3])
        elif depth < 8:
            s = [v * 255 // (2**depth - 1) for v in s]
        out[y, x] = (19595 * s[0] + 38470 * s[1] + 7471 * s[2] + 32768) >> 16 if colour in (2, 3, 6) else s[0]
    return out


KINDS = [(d, c) for c, ds in ((0, (1, 2, 4, 8, 16)), (2, (8, 16)), (3, (1, 2, 4, 8)), (4, (8, 16)), (6, (8, 16))) for d in ds]


@settings(max_examples=120, deadline=None)
@given(st.sampled_from(KINDS), st.integers(1, 9), st.integers(1, 19), st.lists(st.integers(0, 4), min_size=1, max_size=5), st.integers(1, 60), st.integers(0, 999))
def test_every_kind_of_picture(kind, h, w, filters, strip, seed):
    depth, colour = kind
    r = np.random.default_rng(seed)
    px = r.integers(0, 2**depth, (h, w, CHANNELS[colour]))
    palette = r.integers(0, 256, 3 * 2**depth).tolist() if colour == 3 else None
    got = list(png.strips(encode(px, depth, colour, filters, palette, parts=1 + seed % 4), strip))
    assert [y for y, _ in got] == list(np.cumsum([0] + [len(s) for _, s in got[:-1]]))
    assert (np.concatenate([s for _, s in got]) == grey(px, depth, colour, palette)).all()


def test_a_large_picture_is_read_in_strips():
    import tracemalloc

    one = lambda kind, d: struct.pack(">I", len(d)) + kind + d + b"crc?"
    side = 30_000  # 900 million pixels
    squeeze = zlib.compressobj(1)
    body = b"".join(squeeze.compress(b"\0" + (b"\xff" if y % 1000 < 2 else b"\0") * (side // 8)) for y in range(side)) + squeeze.flush()
    picture = png.SIGNATURE + one(b"IHDR", struct.pack(">IIBBBBB", side, side, 1, 0, 0, 0, 0)) + one(b"IDAT", body) + one(b"IEND", b"")
    tracemalloc.start()
    n = sum(len(y) for y, _, _ in png.runs_of(png.strips(picture, 1 << 16), 0))
    assert n == 60 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_pictures_that_are_refused():
    px = np.ones((4, 4, 1), int)
    whole = encode(px, 8, 0)
    for bad, why in ((b"GIF89a..", "not a PNG"), (encode(px, 8, 0, interlaced=1), "interlaced"), (whole[:50], "ends at row"), (encode(px, 8, 3), "no palette"), (encode(px, 8, 0).replace(b"IDAT", b"IDAX"), "ends at row 0")):
        with pytest.raises(ValueError, match=why):
            list(png.strips(bad))


def folder(tmp_path, boards):
    for board, layers in boards.items():
        (tmp_path / f"board_id={board}").mkdir()
        for name, px in layers.items():
            (tmp_path / f"board_id={board}" / f"{name}.png").write_bytes(encode(px[:, :, None] * 255, 8, 0, (0, 1, 2, 3, 4)))


def test_required_and_optional_masks(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 2, (12, 20))
    folder(tmp_path, {1: {"F_Cu": a, "B_Cu": a.T.copy().reshape(12, 20), "drill": a * 0, "F_Mask": a, "notes": a}, 2: {"F_Cu": a, "drill": a}})
    with pytest.raises(FileNotFoundError, match="board 2 B_Cu"):
        png.load(spark, str(tmp_path), ("F_Cu", "B_Cu"))
    canvas, runs = png.load(spark, str(tmp_path), ("F_Cu",))
    assert sorted(map(tuple, canvas.collect())) == [(1, 20, 12), (2, 20, 12)]
    held = {(r.board_id, r.layer) for r in runs.select("board_id", "layer").distinct().collect()}
    assert held == {(1, "F_Cu"), (1, "F_Mask"), (2, "F_Cu"), (2, "drill")}
    assert sum(r.x1 - r.x0 for r in runs.where("board_id = 2 AND layer = 'F_Cu'").collect()) == a.sum()
    assert png.load(spark, str(tmp_path), ("F_Cu",), threshold=255)[1].count() == 0
    (tmp_path / "board_id=2/drill.png").write_bytes(encode(a[:5, :, None], 8, 0))
    with pytest.raises(ValueError, match="differ on board 2"):
        png.load(spark, str(tmp_path), ("F_Cu",))


def test_command_line_finds_layers_and_modes_by_board(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    a, b, hole = (np.zeros((60, 80), int) for _ in range(3))
    a[10:40, 10:40], b[20:50, 20:50], hole[28:32, 28:32] = 1, 1, 1
    far = np.roll(hole, 40, axis=1)
    folder(src, {
        1: {"F_Cu": a, "B_Cu": b, "drill": far, "via": hole},  # a via mask of its own connects what it touches
        2: {"F_Cu": a, "In1_Cu": b, "B_Cu": b, "drill": hole, "via": hole},  # the same as the drill mask: inferred
        3: {"F_Cu": a, "B_Cu": b, "drill": hole, "PTH": hole},
        4: {"F_Cu": a, "drill": hole},  # no stack
    })
    assert main(["nets", str(src), "--masks", "--out", out, "--no-auto-invert"]) == 0
    nets = jobs.table(spark, out, "nets").groupBy("board_id").agg({"net": "max", "layer": "count"}).orderBy("board_id").collect()
    assert [(r.board_id, r["max(net)"]) for r in nets] == [(1, 1), (2, 1), (3, 1)]
    rule = {r.board_id: r.classification for r in jobs.table(spark, out, "drills").collect()}
    assert rule[1] == rule[3] == "explicit_pth" and rule[2] == "likely_pth"
    assert {r.layer for r in jobs.table(spark, out, "nets").where("board_id = 2").collect()} == {"F_Cu", "In1_Cu", "B_Cu"}
