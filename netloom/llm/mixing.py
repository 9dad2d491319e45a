"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of all words, stopped at ``most``
times its own words; what it cannot take is shared again by weight.  Below
its target a source first runs complete epochs over all its documents; the
rest of the budget is drawn without replacement: each document gets the key
-ln(u) / quality with a reproducible uniform u, keys are sorted within the
source, and documents are taken until the prefix sum of their words reaches
the budget.  The document at the edge is taken in part, so that the source
meets its target exactly (rounded down to a word).

No source is sorted in one task.  In the logarithm of the key no interval is
crowded, whatever the weights are, so keys are cut into bins of one width; the
words of the bins (a small table) say which one holds the edge of a source.
That bin is cut again, into parts of some ``bucket_docs`` documents, and only
the part at the edge is sorted.  What comes out is one key a source, the cut;
every document is then judged by it alone, so texts move to no join.
DataFrame operations only.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own and comes last; documents without id are drawn by their
text; documents that tie at the cut (same key, id and size) share what is left
evenly, rounded down; a source without words has target 0; an empty table
gives an empty result; only doc_id, text and source are read, whatever the
other columns are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.text import SYMBOLS, columns_of, n_of, whole_row, words
from netloom.storage import stored


@dataclass(frozen=True)
class Mix:
    """weights: repeat over the sources in order. most: times a source's words.
    bin: width of a bin of log keys, whose share of a source is at most bin / e.
    bucket_docs: expected documents of a part of a bin, which bounds the only sort."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: int = 3
    seed: str = "mix-1"
    bin: float = 1 / 64
    bucket_docs: int = 4_000


def quality_weight(text: Column) -> Column:
    """1 for text without symbols, falling to 0.05 as symbols fill it."""
    return F.greatest(F.lit(0.05), F.lit(1.0) - 5.0 * n_of(text, SYMBOLS) / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """Reproducible u in (0, 1) from 52 bits of an MD5 digest."""
    name = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(2**52))


def targets(by_source: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target from (source, source_size): one row a source.

    Water filling: with sources ordered by cap / weight, those before the
    water level are at their cap and the others share the rest by weight.
    """
    weight = F.array(*map(F.lit, mix.weights))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ranked = by_source.withColumn("w", F.get(weight, (rank % len(mix.weights)).cast("int"))).withColumn("cap", mix.most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("above", F.col("cap") / F.col("w") >= F.col("level"))
    water = F.min(F.when(F.col("above"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level")))).over(everything)["level"]
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), water * F.col("w")).alias("target"))


def candidates(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size and sampling key of every document, and its ``row``
    where docs has one."""
    u = uniform(F.col("doc_id"), F.col("text"), mix.seed)
    row = [c for c in docs.columns if c == "row"]
    return docs.select(
        "doc_id", "source", *row, F.size(words(F.col("text"))).cast("long").alias("size"),
        (-F.log(u) / quality_weight(F.col("text"))).alias("key"),
    )


def at_budget(sums: DataFrame, place: Column, words_: str, budget: Column) -> DataFrame:
    """The row of each source whose words hold the budget, and ``before``, the
    words of the rows before it."""
    before = W.partitionBy("source").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    summed = sums.withColumn("before", F.coalesce("base", F.lit(0)) + F.coalesce(F.sum(words_).over(before), F.lit(0)))
    return summed.where((F.col("before") <= budget) & (budget < F.col("before") + F.col(words_)))


def cuts(cands: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target, epochs, at, part: one row a source.  After
    ``epochs`` complete passes, documents before ``at`` (key, doc_id, size) are
    taken whole once more, and of those at it ``part`` words each."""
    by_source = stored(cands.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    share = F.least(F.col("target") / F.col("source_size"), F.lit(float(mix.most)))
    plan = targets(by_source, mix).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(share)).otherwise(F.lit(0)).cast("long"))
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    plan = stored(plan.withColumn("budget", F.when(F.col("epochs") >= mix.most, F.lit(0)).otherwise(left)), "plan")
    budgets = plan.select(F.col("source").alias("of"), "budget")

    def inside_of(rows: DataFrame, edge: DataFrame, names: list[str]) -> DataFrame:
        edge = edge.select(*(F.col(c).alias(f"edge_{c}") for c in names), *(c for c in edge.columns if c not in names))
        return rows.join(edge, [F.col(c).eqNullSafe(F.col(f"edge_{c}")) for c in names]).drop(*(f"edge_{c}" for c in names))

    log_key = F.log("key") / mix.bin
    binned = cands.withColumn("bin", F.floor(log_key))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.lit(0).cast("long").alias("base"))
    sums = sums.join(budgets, F.col("source").eqNullSafe(F.col("of")))
    edge = stored(at_budget(sums, F.col("bin"), "words", F.col("budget")).select("source", "bin", "docs", "before", "budget"), "edge")

    inside = inside_of(binned, edge, ["source", "bin"]).withColumn("fine", F.floor((log_key - F.col("bin")) * F.ceil(F.col("docs") / mix.bucket_docs)))
    sums = inside.groupBy("source", "fine").agg(F.sum("size").alias("words"), F.first("before").alias("base"), F.first("budget").alias("budget"))
    part = stored(at_budget(sums, F.col("fine"), "words", F.col("budget")).select("source", "fine", F.col("before").alias("start")), "edge_part")

    tied = inside_of(inside, part, ["source", "fine"]).groupBy("source", "key", "doc_id", "size")
    sums = tied.agg(F.sum("size").alias("words"), F.count("*").alias("copies"), F.first("start").alias("base"), F.first("budget").alias("budget"))
    at = F.struct("key", "doc_id", "size")
    found = at_budget(sums, at, "words", F.col("budget")).select(F.col("source").alias("of"), at.alias("at"), F.expr("(budget - before) div copies").alias("part"))
    return plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "epochs", "at", "part")


def sample(cands: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``cands`` with source_size, target, epochs and part: ``part``
    words of the fractional pass after ``epochs`` complete ones.

    plan: what cuts() gives, one row a source, so Spark may broadcast it by its
    size; where there are too many sources, it joins and splits skewed ones.
    """
    plan = plan.withColumnRenamed("source", "of")
    place = F.struct("key", "doc_id", "size")
    part = F.when(place < F.col("at"), F.col("size")).when(place == F.col("at"), F.col("part")).otherwise(F.lit(0))
    joined = cands.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return joined.select(*cands.columns, "source_size", "target", "epochs", F.coalesce(part, F.lit(0)).cast("long").alias("part"))


def taken(cands: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, part, taken of every candidate."""
    plan = stored(cuts(cands, mix), "cuts")
    return sample(cands, plan).drop("key").withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """What the mix takes of every document."""
    return taken(stored(candidates(docs, mix), "mixing"), mix)


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as rows of ``docs``: a document once for every complete epoch,
    and once more for its part; a part shorter than the document keeps its
    first words.  Every row is judged for itself, so repeated rows, texts that
    share an id and rows without one each have their own takes."""
    plan = stored(cuts(stored(candidates(docs, mix), "mixing"), mix), "cuts")
    rows = docs.select(whole_row(docs).alias("row"), "doc_id", "text", "source")
    got = sample(candidates(rows, mix), plan)
    times = F.concat(F.array_repeat("size", F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    got = got.where("size > 0").select("row", F.explode(times).alias("take"))
    text = F.col("row")["text"]
    kept = F.when(F.col("take") >= F.size(words(text)), text).otherwise(F.array_join(F.slice(words(text), F.lit(1), F.col("take").cast("int")), " "))
    return got.select(*(kept.alias("text") if name == "text" else c for name, c in zip(docs.columns, columns_of("row", docs.columns), strict=True)))


def sample_sql(source: str = "documents", mix: Mix = Mix()) -> str:
    """DuckDB SQL for sample(): ends in table q4_taken (doc_id, size, source_size, target, epochs, part)."""
    ws = ", ".join(map(repr, mix.weights))
    return f"""
q4_size AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')) AS symbols FROM {source}),
q4_key AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE) / greatest(0.05::DOUBLE, 1::DOUBLE - 5::DOUBLE * symbols / greatest(chars, 1)) AS key FROM q4_size),
q4_source AS (SELECT source, sum(size)::BIGINT AS source_size, [{ws}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mix.weights)} + 1]::DOUBLE AS w FROM q4_key GROUP BY source),
q4_cap AS (SELECT *, {mix.most} * source_size AS cap FROM q4_source),
q4_level AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM q4_cap WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q4_water AS (SELECT arg_min(level, cap / w) AS water FROM q4_level WHERE cap / w >= level),
q4_plan AS (SELECT source, source_size, least(cap::DOUBLE, water * w) AS target FROM q4_level, q4_water),
q4_epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, {mix.most}))::BIGINT ELSE 0 END AS epochs FROM q4_plan),
q4_budget AS (SELECT *, CASE WHEN epochs >= {mix.most} THEN 0 ELSE floor(target - epochs * source_size)::BIGINT END AS budget FROM q4_epochs),
q4_tied AS (SELECT source, key, doc_id, size, count(*) AS copies FROM q4_key GROUP BY ALL),
q4_taken AS (SELECT doc_id, t.source, size, source_size, target, epochs, greatest(0, least(size, (budget - coalesce(sum(size * copies) OVER (PARTITION BY t.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // copies))::BIGINT AS part, unnest(range(copies)) AS copy FROM q4_tied t JOIN q4_budget b ON t.source IS NOT DISTINCT FROM b.source)"""


def oracle() -> str:
    return f"WITH {sample_sql()}\nSELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken FROM q4_taken"
