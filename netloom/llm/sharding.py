"""Histogram sort: documents in shards of nearly equal bytes, exchanged once.

Documents are sorted by a key of three 60-bit parts: a hash of the text, a
hash of the doc_id, and a number of the row.  A shard is a range of that order.
Where the ranges end is found by counting: all partitions count the exact bytes
and rows between candidate boundaries (every value of the key's next 12 bits),
and only the ranges that hold a wanted end are probed again, 12 bits deeper,
until an end lies within ``tolerance`` of a shard's bytes.  The first such depth
counts, and at that depth the nearest boundary.  Boundaries in the first 60
bits fall between groups of equal texts, so copies stay together unless no such
boundary is near enough.  The same counts cut every shard into buckets of a
bounded number of rows, so a slot is a bucket's first slot plus a rank within
the bucket, and rows move once.

The driver gets counts only: at most 4,096 of each range that is probed, which
are at most as many as there are shards and buckets over the bound.

Defined cases: a null text has no bytes and sorts as the empty text; a null
doc_id sorts as an empty one; rows alike in doc_id and text are told apart by
their number and are interchangeable; a document longer than a shard's share
fills one shard; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.storage import stored

#: Bits of a key part, and bits that one round adds to a boundary.
PART, STEP = 60, 12
DEPTHS = 3 * PART // STEP


def _hashed(text: Column) -> Column:
    """The first 60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, PART // 4), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key k0, k1, k2, stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stored(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _hashed(text).alias("k0"),
            _hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k1"),
            F.monotonically_increasing_id().bitwiseAND((1 << PART) - 1).alias("k2"),
        ),
        "sharding",
    )


def _digit(depth: int) -> Column:
    """The key's bits that depth ``depth`` (from 0) adds."""
    part, i = divmod(depth * STEP, PART)
    return F.shiftrightunsigned(F.col(f"k{part}"), PART - STEP - i).bitwiseAND((1 << STEP) - 1).cast("int")


class _Range:
    """A range of the order: its path of digits, bytes and rows in and before it."""

    __slots__ = ("path", "bytes", "rows", "before")

    def __init__(self, path: tuple[int, ...], size: int, rows: int, before: int):
        self.path, self.bytes, self.rows, self.before = path, size, rows, before


def _count(rows: DataFrame, open_: list[_Range], depth: int) -> dict[int, list]:
    """Exact bytes and rows per digit of ``depth``, in each open range."""
    spark = rows.sparkSession
    digits = [_digit(d).alias(f"d{d}") for d in range(depth + 1)]
    keys = [f"d{d}" for d in range(depth)]
    if depth:
        paths = spark.createDataFrame([(i, *r.path) for i, r in enumerate(open_)], "at int, " + ", ".join(f"{k} int" for k in keys))
        inside = rows.select("size", *digits).join(F.broadcast(paths), keys)  # no more paths than open ranges
    else:
        inside = rows.select("size", F.lit(0).alias("at"), *digits)
    out: dict[int, list] = {}
    for r in inside.groupBy("at", f"d{depth}").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        out.setdefault(r[0], []).append((r[1], r[2], r[3]))
    return out


def _nearest(edges: list[int], target: float) -> int:
    i = bisect_left(edges, target)
    return min(edges[max(0, i - 1) : i + 1], key=lambda e: (abs(e - target), e))


def splitters(rows: DataFrame, shards: int, tolerance: float, bucket_rows: int) -> tuple[list[int], list[_Range]]:
    """Byte counts at which shards end (all but the last), and the ranges that
    the search ended with, in order."""
    leaves = [_Range((), 0, 0, 0)]
    ends: dict[int, int] = {}
    open_, depth, total, most = leaves, 0, 0, bucket_rows
    while open_ and depth < DEPTHS:
        counted = _count(rows, open_, depth)
        split = {}
        for i, r in enumerate(open_):
            before, parts = r.before, []
            for digit, size, n in sorted(counted.get(i, [])):
                parts.append(_Range((*r.path, digit), size, n, before))
                before += size
            split[r.path] = parts
        leaves = [p for r in leaves for p in split.get(r.path, [r])]
        if not depth:
            total = sum(r.bytes for r in leaves)
            most = max(bucket_rows, 4 * sum(r.rows for r in leaves) >> STEP)
        depth += 1
        edges = [r.before for r in leaves] + [total]
        wanted = []
        for k in range(1, shards):
            target = total * k / shards
            if k not in ends:
                end = _nearest(edges, target)
                if abs(end - target) <= tolerance * total / shards or depth == DEPTHS:
                    ends[k] = end
                else:
                    wanted.append(target)
        open_ = [r for r in leaves if len(r.path) == depth and r.rows > 1 and (r.rows > most or any(r.before < t < r.before + r.bytes for t in wanted))]
        if not open_:
            for k in range(1, shards):
                ends.setdefault(k, _nearest(edges, total * k / shards))
    return [ends[k] for k in range(1, shards)] if total else [], leaves


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, bucket_rows: int = 1_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``tolerance`` is the part of a shard's bytes by which an end may be off
    before copies are parted for it; ``bucket_rows`` bounds the rows that a
    task ranks (a 1024th of all rows, if that is more).
    """
    rows = keyed(docs)
    ends, leaves = splitters(rows, shards, tolerance, bucket_rows)
    table, firsts = [], [0] * shards
    for r in leaves:
        s = sum(e <= r.before for e in ends)
        table.append((len(r.path), *r.path, *[None] * (DEPTHS - len(r.path)), s, firsts[s]))
        firsts[s] += r.rows
    names = [f"d{d}" for d in range(DEPTHS)]
    known = rows.sparkSession.createDataFrame(table, "depth int, " + ", ".join(f"{d} int" for d in names) + ", s int, first long")
    found = rows.withColumns({d: _digit(i) for i, d in enumerate(names)})
    depths = sorted({t[0] for t in table}) or [1]
    for d in depths:
        at = known.where(F.col("depth") == d).select(*names[:d], F.struct("s", "first").alias(f"at{d}"))
        found = found.join(F.broadcast(at), names[:d], "left")  # as many rows as ranges
    at = F.coalesce(*(F.col(f"at{d}") for d in depths))
    placed = found.select("doc_id", "size", "text_crc32", "k0", "k1", "k2", at.alias("at")).select("*", F.col("at.s").alias("shard"), F.col("at.first").alias("first"))
    order = Window.partitionBy("shard", "first").orderBy("k0", "k1", "k2")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(shards: int = 8, tolerance: float = 0.005) -> str:
    """The same law in DuckDB: edges of every depth, the first depth with one
    near enough, the nearest there; a document's CRC is folded byte by byte."""
    hashed = lambda x: f"CAST('0x' || substr(md5({x}), 1, {PART // 4}) AS BIGINT)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k2 FROM documents),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT] || [0::BIGINT for x in range(8)], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
bytes AS (SELECT *, hex(encode(text)) AS h FROM t),
keyed AS (SELECT doc_id, k2, octet_length(encode(text)) + 1 AS size, {hashed("text")} AS k0, {hashed("coalesce(doc_id::VARCHAR, '')")} AS k1,
  xor(list_reduce([4294967295::BIGINT] || [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) for i in range(length(h) // 2)],
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc_table),
summed AS (SELECT *, sum(size) OVER (ORDER BY k0, k1, k2) AS upto, sum(size) OVER () AS total FROM keyed),
edges AS (SELECT depth, max(upto)::BIGINT AS edge, max(total)::BIGINT AS total FROM summed, range(1, {DEPTHS + 1}) d(depth)
  GROUP BY depth, CASE WHEN depth <= 5 THEN k0 >> (60 - 12 * depth) ELSE k0 END, CASE WHEN depth <= 5 THEN 0 WHEN depth <= 10 THEN k1 >> (120 - 12 * depth) ELSE k1 END, CASE WHEN depth > 10 THEN k2 ELSE 0 END),
offs AS (SELECT k, depth, edge, abs(edge - total * k / {shards}) AS off, abs(edge - total * k / {shards}) <= {tolerance!r} * total / {shards} AS near
  FROM (SELECT depth, edge, total FROM edges UNION ALL SELECT depth, 0, max(total) FROM edges GROUP BY depth), range(1, {shards}) s(k)),
ends AS (SELECT k, arg_min(edge, (CASE WHEN near THEN depth ELSE {DEPTHS} END, off, edge)) AS e FROM offs WHERE near OR depth = {DEPTHS} GROUP BY k),
placed AS (SELECT s.*, (SELECT count(*) FROM ends WHERE e <= s.upto - s.size)::INTEGER AS shard FROM summed s)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k0, k1, k2) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed"""
