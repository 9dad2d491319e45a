"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt to blocks of bounded size.  Within a block every dimension
is a sorted list; for a query the lists are read from the end that its sign
favours.  Each step reads the next stretch of every list, scores the vectors
met for the first time in full, and bounds every vector not met yet by the
inner product of the query with the values reached.  A query stops in a block
once the bound cannot beat its k-th result.  The best k of each block are
merged with a window over (query, block) results.

A block of candidates is dealt once and its lists are built once; the queries
stream by it in batches, so a task holds one block, however many queries there
are.

Components are integers that a double holds exactly.  Inner products are made
in doubles where no sum can pass 2**53, and in Python's integers elsewhere, so
every score and every order is exact; a score beyond 64 bits is returned as
the nearest 64-bit integer, after ranking.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without vec_id; vectors are compared
with vectors of their own length only; rows are told apart by a number, not by
vec_id, so rows that share one are queries and candidates of their own, each
query's list being ranked from 1; equal scores go to the smaller vec_id; fewer candidates than k give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.storage import stored

RESULT = "query_row long, query_id long, vec_id long, row long, score long, place string"


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component, x as double; a double as well."""
    return F.transform(vector, lambda x: floored(x.cast("double") * 1024.0))


def floored(x: Column) -> Column:
    """floor() without a limit: doubles from 2**53 on have no fraction."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


class Lists:
    """A block of vectors with a sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        rows = ids if rows is None else rows
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.x = ids[order], rows[order], vectors[order]  # so that ties go to the smaller id
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, self.order, axis=0)
        self.largest = np.abs(self.x).max(initial=0)

    def best(self, q: np.ndarray, own: int, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, scores, rows) of the k best but the row ``own``, best first."""
        n = len(self.ids)
        if len(q) * self.largest * np.abs(q).max(initial=0) >= 2.0**53:
            return self.best_of_integers(q, own, k)
        rising, used = q > 0, np.flatnonzero(q)
        met, scores, at = np.zeros(n, bool), np.full(n, -np.inf), 0
        met[self.rows == own] = True
        kth = -np.inf
        while at < n and len(used):
            to = min(n, at + step)
            near = np.where(rising[used], 1, 0)
            low, high = self.order[at:to, used[near == 0]], self.order[n - to : n - at, used[near == 1]]
            new = np.zeros(n, bool)
            new[low.ravel()] = True
            new[high.ravel()] = True
            new &= ~met
            rows = np.flatnonzero(new)
            scores[rows] = self.x[rows] @ q
            met |= new
            reached = np.where(rising, self.values[n - to], self.values[to - 1])
            have = int(np.isfinite(scores).sum())
            if have >= k:
                kth = np.partition(scores, n - k)[n - k]
            if kth > float(reached @ q):  # an equal score could still have a smaller id
                break
            at, step = to, 2 * step
        if not len(used):
            scores[~met] = 0
        top = np.argsort(-scores, kind="stable")[:k]  # rows are in the order of ids
        top = top[np.isfinite(scores[top])]
        return self.ids[top], scores[top], self.rows[top]

    def best_of_integers(self, q: np.ndarray, own: int, k: int, step: int = 64) -> tuple[list[int], list[int], list[int]]:
        """best() for numbers whose products doubles can't hold."""
        n, ints = len(self.ids), [int(x) for x in q]
        product = lambda v: sum(a * int(b) for a, b in zip(ints, v, strict=True) if a)
        scores, at = {}, 0
        while at < n:
            to = min(n, at + step)
            for d, a in enumerate(ints):
                for i in self.order[n - to : n - at, d] if a > 0 else self.order[at:to, d]:
                    if i not in scores and self.rows[i] != own:
                        scores[i] = product(self.x[i])
            at = to
            if len(scores) >= k:
                reached = product([self.values[n - to if a > 0 else to - 1, d] for d, a in enumerate(ints)])
                if sorted(scores.values(), reverse=True)[k - 1] > reached:
                    break
        top = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        return [int(self.ids[i]) for i in top], [scores[i] for i in top], [int(self.rows[i]) for i in top]


def long(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, x))


def place(x: int) -> str:
    """Strings in the order of integers of any size."""
    digits = str(abs(x))
    digits = f"{len(digits):04}{digits}"
    return "1" + digits if x >= 0 else "0" + digits.translate(NINES)


NINES = str.maketrans("0123456789", "9876543210")


def search(vectors: DataFrame, k: int = 10, every: int = 100, block: int = 4096) -> DataFrame:
    """The k best of ``vectors(vec_id, embedding)`` for each query row."""
    ok = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # stored, so that a row has the same number as a query and as a candidate
    v = stored(ok.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("v"), F.size("embedding").alias("dim")), "vectors")
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    blocks = max(1, -(-v.count() // block))
    cands = v.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")).withColumn("query", F.lit(False))
    queries = v.where(is_query).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).withColumn("query", F.lit(True))
    keys = ["dim", "b"]
    # a block's candidates come first, then all queries, batch by batch
    ordered = cands.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "query")

    def run(batches):
        at, held, lists = None, [], None
        for pdf in batches:
            for (key, query), part in zip(*runs(pdf)):
                if key != at:
                    at, held, lists = key, [], None
                if not query:
                    held.append(part)
                    continue
                if lists is None:
                    every_one = pd.concat(held) if held else part.iloc[:0]
                    lists = Lists(every_one["vec_id"].to_numpy(), np.array(every_one["v"].tolist(), dtype=float).reshape(len(every_one), key[0]), every_one["row"].to_numpy())
                    held = []
                out = [(own, name, int(i), int(row), long(int(x)), place(int(x))) for own, name, q in zip(part["row"], part["vec_id"], part["v"], strict=True) for i, x, row in zip(*lists.best(np.asarray(q, dtype=float), own, k), strict=True)]
                yield pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "row", "score", "place"]).astype(dict.fromkeys(["query_row", "query_id", "vec_id", "row", "score"], "int64"))

    def runs(pdf):
        """((dim, b), query) of each run of equal rows, and the runs."""
        new = (pdf[[*keys, "query"]] != pdf[[*keys, "query"]].shift()).any(axis=1).to_numpy().nonzero()[0]
        parts = [pdf.iloc[a:b] for a, b in zip(new, [*new[1:], len(pdf)], strict=True)]
        return [((int(p["dim"].iloc[0]), int(p["b"].iloc[0])), bool(p["query"].iloc[0])) for p in parts], parts

    found = ordered.mapInPandas(run, RESULT)
    order = W.partitionBy("query_row").orderBy(F.desc("place"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, every: int = 100) -> str:
    return f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS q, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""
