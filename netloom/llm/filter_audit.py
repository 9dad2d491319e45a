"""How filters interact: what each of several filters removes in every order.

Every document becomes a mask of the filters that it fails.  Documents are
counted by part, mask and labels; only these cells, at most 2**filters a part,
are taken further, in long form: every cell against every step of every order.
A running bit-or over a cell's earlier steps tells whether the document had
gone by then, conditional sums over the cells give a step's counts, and a
window over the steps of one filter in all orders gives its Shapley total.

Copies are told by SHA-256 of the text.  A group of copies is never gathered:
rows are counted by (text, id, part) first, then smallest ids are minima of
these counts.

Defined cases: a null text is the empty text; a null source is the part ''; a
null doc_id is neither smaller nor larger than another, so it never fails the
filter of copies and makes none fail it, and it has no labels; several labels
of one document count as 1 if any is 1; rows that repeat an id and text are
counted each, and none is a copy of the other; filters without a failure give
zeros; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.text import UPPER, let, n_of, words

#: Filter -> whether a text fails it, from its words; COPIES is told apart by ids.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, ws: F.size(ws) < 50,
    "B": lambda text, ws: 100 * F.size(F.array_distinct(ws)) < 65 * F.size(ws),
    "C": lambda text, ws: 100 * n_of(text, UPPER) > 5 * F.length(text),
    "D": lambda text, ws: text.rlike(r"[#$%&*|]"),
}
COPIES = "E"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and the mask of FILTERS of every row; bit i is filter i."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = lambda ws: sum((f(text, ws).cast("int") * (1 << i) for i, f in enumerate(FILTERS.values())), F.lit(0))
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), let(words(text), bits).alias("mask"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just ``mask``."""
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = failures(docs)
    known = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = known.join(flags, "doc_id", "left").na.fill(0, ["good", "toxic"])
    by_text = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # rows of a text: parts by labels
    split = by_text.withColumn("own", F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0)))
    copy = F.lit(1 << len(FILTERS))
    told = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("own")).alias("n"))
    )).alias("c")).select("part", "c.mask", "c.n", (F.col("good") * F.col("c.n")).alias("good"), (F.col("toxic") * F.col("c.n")).alias("toxic"))
    unknown = rows.where("doc_id IS NULL").select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return told.unionByName(unknown).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    names = [*FILTERS, COPIES]
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    long = (
        cells(docs, labels)
        .select("*", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("bit", F.call_function("shiftleft", F.lit(1), F.instr(F.lit("".join(names)), F.col("filter")) - 1))
        .withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    )
    earlier = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.bit_or("failed").over(earlier), F.lit(0))
    marked = long.withColumn("gone", gone > 0).withColumn("fails", F.col("failed") > 0)
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(F.lit(0))).cast("long")
    here = F.col("fails") & ~F.col("gone")
    steps = marked.groupBy("part", "filter_order", "step", "filter").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    upper = f"length(text) - length(translate(text, '{UPPER}', ''))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {{
  'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * ({upper}) > 5 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}} AS m FROM t LEFT JOIN flags USING (doc_id)),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
cells AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, m),
steps AS (SELECT *, filter_order[step] AS f, m[filter_order[step]] AS fails, len(list_filter(range(1, step), lambda i: m[filter_order[i]])) > 0 AS gone FROM cells, orders, range(1, 6) s(step)),
counted AS (SELECT part, filter_order, step::INTEGER AS step, f,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND len(list_filter(map_values(m), lambda v: v)) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted"""
