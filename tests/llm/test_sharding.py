import hashlib
import zlib
from collections import Counter

import pytest

from netloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string, k0 int"
BIG = 2**60


def key(doc_id, text):
    first = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    return first(text or ""), first("" if doc_id is None else str(doc_id))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "x", "y", 7) for d, t in rows], SCHEMA).repartition(parts)


def brute(rows, shards, tolerance):
    """Sorted rows with the shard of each, by trying every boundary."""
    ordered = sorted(rows, key=lambda r: key(*r))
    sizes = [len((t or "").encode()) + 1 for _, t in ordered]
    total, upto = sum(sizes), [0]
    for n in sizes:
        upto.append(upto[-1] + n)
    bits = [f"{a:060b}{b:060b}" for a, b in (key(*r) for r in ordered)]
    ends = []
    for k in range(1, shards):
        target = total * k / shards
        for depth in range(1, 11):
            edges = [0, total] + [upto[i] for i in range(1, len(bits)) if bits[i - 1][: 12 * depth] != bits[i][: 12 * depth]]
            best = min(edges, key=lambda e: (abs(e - target), e))
            if abs(best - target) <= tolerance * total / shards:
                break
        else:
            best = min(upto, key=lambda e: (abs(e - target), e))
        ends.append(best)
    out, slots = [], Counter()
    for (d, t), at in zip(ordered, upto, strict=False):
        s = sum(e <= at for e in ends)
        out.append((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s, slots[s]))
        slots[s] += 1
    return out


def got(df):
    return [(r.doc_id, r["size"], r.text_crc32, r["shard"], r.slot) for r in df.collect()]


ROWS = [(i, f"text {i} " + "é" * (i * 7 % 50)) for i in range(300)]
ROWS += [(BIG + i, "a copy of thirty bytes or so") for i in range(200)]
ROWS += [(None, "without id"), (None, None), (2**53 + 1, ""), (2**53 + 3, "z" * 30_000)]


@pytest.mark.parametrize(("shards", "tolerance", "bucket"), [(8, 0.005, 100_000), (8, 0.3, 5), (3, 0.0, 1), (1, 0.005, 20)])
def test_equals_sorting_and_trying_every_boundary(spark, shards, tolerance, bucket):
    df = sharding.shard(table(spark, ROWS), shards, tolerance, bucket)
    assert sorted(got(df), key=str) == sorted(brute(ROWS, shards, tolerance), key=str)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_copies_part_only_where_bytes_would_be_uneven(spark):
    rows = got(sharding.shard(table(spark, [(i, f"{i:0100d}") for i in range(4000)] + [(i, "same " * 20) for i in range(4000, 7000)]), 8))
    sizes = Counter()
    for _, n, _, s, _ in rows:
        sizes[s] += n
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 0.012 * sum(sizes.values()) / 8
    assert 2 <= len({s for d, _, _, s, _ in rows if d >= 4000}) <= 5
    few = got(sharding.shard(table(spark, [(i, f"{i // 4:0100d}") for i in range(4000)]), 8))
    homes = {}
    for d, _, _, s, _ in few:
        homes.setdefault(d // 4, set()).add(s)
    assert all(len(h) == 1 for h in homes.values())


def test_rows_alike_fill_all_shards_and_slots(spark):
    rows = got(sharding.shard(table(spark, [(None, "again")] * 1600), 8, bucket_rows=50))
    by_shard = {}
    for _, _, _, s, slot in rows:
        by_shard.setdefault(s, []).append(slot)
    assert len(by_shard) == 8 and all(sorted(v) == list(range(200)) for v in by_shard.values())


def test_empty_and_tiny_tables(spark):
    assert got(sharding.shard(table(spark, []))) == []
    assert [r[:3] for r in got(sharding.shard(table(spark, [(5, "x")])))] == [(5, 2, zlib.crc32(b"x"))]
