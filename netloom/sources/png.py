"""PNG masks as runs, a strip of rows at a time.

Spark reads the files, compressed as they are, from any store that it can read;
a task inflates a strip, undoes the row filters, takes the luma, and gives the
strip's runs on.  Memory is bounded by the compressed file and one strip, not
by the picture.  All colour types and depths are read, alpha is ignored, 16-bit
samples count by their high byte; interlaced pictures are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import masks

#: The file's first bytes, samples a pixel by colour type, and
#: the weights of red, green and blue in 65,536 parts.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
LUMA = (19595, 38470, 7471)

RUNS = "board_id int, layer string, y int, x0 int, x1 int"
OPTIONAL = ("F_Silkscreen", "B_Silkscreen", "F_Mask", "B_Mask")


def chunks(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    if bytes(data[:8]) != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += n + 12


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes without its filter; ``step`` bytes lie between a byte and
    the one to its left that counts."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        whole = np.zeros(-(-len(row) // step) * step, np.uint8)
        whole[: len(row)] = row
        return np.cumsum(whole.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    if kind not in (3, 4):
        raise ValueError(f"no filter {kind}")
    out, up = row.tolist(), above.tolist()  # each byte needs the one before it
    for i, b in enumerate(up):
        a = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = up[i - step] if i >= step else 0
            to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def luma_of(rows: np.ndarray, width: int, depth: int, colour: int, palette: np.ndarray | None) -> np.ndarray:
    """Brightness from 0 to 255 of unfiltered rows."""
    n = SAMPLES[colour]
    if depth == 16:
        px = rows.reshape(len(rows), -1, 2)[:, :, 0]
    elif depth == 8:
        px = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        px = np.zeros(bits.shape[:2], np.uint8)
        for i in range(depth):
            px = px << 1 | bits[:, :, i]
        if colour == 0:
            px = px * np.uint8(255 // ((1 << depth) - 1))
    px = px[:, : width * n].reshape(len(rows), width, n)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        return palette[px[:, :, 0]]
    return px[:, :, 0] if n < 3 else weighted(px[:, :, :3])


def weighted(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.uint32) * np.array(LUMA, np.uint32)).sum(axis=-1) + 32768 >> 16).astype(np.uint8)


def strips(content: bytes, strip_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, brightness) of strips of about ``strip_bytes`` bytes, a row at least."""
    head = palette = None
    inflate, y, held, above = zlib.decompressobj(), 0, b"", None
    for kind, body in chunks(memoryview(content)):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            width, height, depth, colour, _, _, interlaced = head
            if interlaced:
                raise ValueError("interlaced")
            line = -(-width * depth * SAMPLES[colour] // 8)
            step = max(1, depth * SAMPLES[colour] // 8)
            per_strip = max(1, strip_bytes // (line + 1))
            above = np.zeros(line, np.uint8)
        elif kind == b"PLTE":
            rgb = np.frombuffer(body, np.uint8).reshape(-1, 3)
            palette = np.zeros(256, np.uint8)
            palette[: len(rgb)] = weighted(rgb)
        elif kind == b"IDAT":
            rest = body
            while len(rest) or len(held) > line:
                wanted = per_strip * (line + 1) - len(held)
                if wanted > 0 and len(rest):
                    held += inflate.decompress(rest, wanted)
                    rest = inflate.unconsumed_tail
                n = min(len(held) // (line + 1), per_strip, height - y)
                if not n:
                    break
                raw, held = np.frombuffer(held[: n * (line + 1)], np.uint8).reshape(n, line + 1), held[n * (line + 1) :]
                rows = np.empty((n, line), np.uint8)
                for i in range(n):
                    above = rows[i] = unfiltered(raw[i, 0], raw[i, 1:], above, step)
                yield y, luma_of(rows, width, depth, colour, palette)
                y += n
    if head is None or y < head[1]:
        raise ValueError(f"the picture ends at row {y}")


def runs_of(strip: Iterable[tuple[int, np.ndarray]], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, x0, x1) of what is brighter than the threshold."""
    for first, px in strip:
        edge = np.diff(np.pad((px > threshold).astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        yield y + first, x0, x1


def files(spark: SparkSession, path: str) -> DataFrame:
    """(board_id, layer, content) of board_id=N/<layer>.png."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    return found.select(F.regexp_extract("path", r"board_id=(\d+)/", 1).cast("int").alias("board_id"), F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("layer"), "content")


def sizes(pictures: DataFrame) -> DataFrame:
    """(board_id, layer, w, h) from the pictures' heads."""
    side = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return pictures.select("board_id", "layer", side(17).alias("w"), side(21).alias("h"))


def runs(pictures: DataFrame, threshold: int = 0, strip_bytes: int = 1 << 20) -> DataFrame:
    """Runs of pixels brighter than ``threshold``."""

    def run(batches):
        for pdf in batches:
            for board, layer, content in zip(pdf["board_id"], pdf["layer"], pdf["content"], strict=True):
                try:
                    for y, x0, x1 in runs_of(strips(content, strip_bytes), threshold):
                        yield pd.DataFrame({"board_id": board, "layer": layer, "y": y.astype("int32"), "x0": x0.astype("int32"), "x1": x1.astype("int32")})
                except (ValueError, zlib.error, struct.error) as e:
                    raise ValueError(f"{layer}.png of board {board}: {e}") from e

    return pictures.mapInPandas(run, RUNS)


def load(spark: SparkSession, path: str, layers: tuple[str, ...] | None = None, drill: str = "drill", optional: tuple[str, ...] = OPTIONAL, threshold: int = 0) -> tuple[DataFrame, DataFrame]:
    """(canvas, runs) of boards' masks.

    ``layers`` and ``drill`` must be there on every board, ``optional`` ones are
    read where they are, others are left alone; without ``layers`` everything is
    read and nothing is missing.  All masks of a board must have one size.
    """
    pictures = files(spark, path)
    if layers is not None:
        wanted = dict.fromkeys((*layers, drill))
        pictures = pictures.where(F.col("layer").isin(*wanted, *optional))
        need = F.array(*map(F.lit, wanted))
        gap = pictures.groupBy("board_id").agg(F.array_sort(F.array_except(need, F.collect_set("layer"))).alias("gap")).where(F.size("gap") > 0)
        bad = gap.orderBy("board_id").limit(20).collect()
        if bad:
            raise FileNotFoundError("masks not found: " + "; ".join(f"board {r.board_id} {', '.join(r.gap)}" for r in bad))
    size = sizes(pictures)
    bad = masks.mismatched(size).orderBy("board_id").limit(20).collect()
    if bad:
        raise ValueError("mask dimensions differ on board " + ", ".join(str(r.board_id) for r in bad))
    return size.groupBy("board_id").agg(F.max("w").alias("w"), F.max("h").alias("h")), runs(pictures, threshold)
