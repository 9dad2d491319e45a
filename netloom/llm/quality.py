"""Quality rules whose cutoffs come with a guarantee.

Each rule is a ratio that grows with badness.  Labelled documents are the
holdout: in every stratum (language), the cutoffs of a rule are tried
from the loosest to the strictest, and the strictest one is kept for which an
exact binomial test still shows that at most ``risk / number of rules`` of the
good documents lie above it.  Testing in that fixed order needs no correction
within a rule; over the strata and rules the level is divided by their number
(Bonferroni).  With probability 1 - ``level`` no stratum then loses more than
``risk`` of its good documents to the rules.  Strata are the languages of the
documents; one with too few good labels to pass any test is not tested, does not
count in the correction and rejects nothing beyond the base rules.

DataFrame operations only.  Words found again are detected by 64-bit hashes
of eight-word windows within one text; the chance of a wrong hit in a text of
n windows is about n * n / 2**65.

Defined cases: a null text has no words (so it fails the base rule); documents
without a language are the stratum "other"; labels without a quality
or without a document are ignored; several labels of one document count once,
as good if any says so; repeated rows are judged alike; with no labels at all
only the base rules reject; an empty table gives an empty result; columns of
the input other than doc_id, text and lang are ignored whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import SYMBOLS, UPPER, WORD_CHAR, columns_of, let, n_of, whole_row, words
from netloom.storage import stored

#: Rule -> its cutoffs, from the loosest to the strictest.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.5, 0.25, 0.1),
    "upper_share": (0.6, 0.5, 0.4, 0.3, 0.2),
    "exclaim_per_word": (1.0, 0.5, 0.25, 0.1),
    "dup_lines_per_line": (0.8, 0.6, 0.4, 0.3),
    "repeat_share": (0.25, 0.2, 0.15),
}
#: The stratum of documents without a language.
OTHER = "other"


@dataclass(frozen=True)
class Risk:
    """At most ``risk`` of a stratum's good documents rejected, at ``level``."""

    risk: float = 0.05
    level: float = 0.05

    @property
    def rule_risk(self) -> float:
        return self.risk / len(RULES)

    @property
    def fewest(self) -> int:
        """Good documents below which a stratum can't pass a test, were it alone."""
        return math.ceil(math.log(self.level / len(RULES)) / math.log1p(-self.rule_risk))

    def test_level(self, strata: int) -> float:
        return self.level / (len(RULES) * max(1, strata))


def repeat_words(ws: Column, k: int = 8) -> Column:
    """Words inside k-word windows that the array holds at least twice."""

    def covered(w: Column) -> Column:
        marked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(marked, lambda s: F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"])))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        step = lambda p: F.transform(p, lambda q, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - q, F.lit(k))))
        return F.aggregate(let(starts, step), F.lit(0), lambda a, b: a + b)

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(1)))
        w = F.transform(at, lambda i: F.xxhash64(F.slice(h, i, k)))
        return let(w, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), covered(v)).otherwise(F.lit(0)))

    return F.when(F.size(ws) <= k, F.lit(0)).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), windows))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the value of each rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    by_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again")))
    by_lines = let(lines, lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("dup")))
    counted = docs.select(
        F.col("doc_id"),
        F.coalesce("lang", F.lit(OTHER)).alias("stratum"),
        by_words.alias("w"), by_lines.alias("l"), F.length(text).alias("chars"), n_of(text, " \t\n\x0b\f\r").alias("blanks"),
        n_of(text, SYMBOLS).alias("symbols"), n_of(text, UPPER).alias("upper"), n_of(text, "!").alias("exclaims"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    long = lambda c: F.col(c).cast("long")
    return counted.select(
        "doc_id", "stratum",
        long("w.n").alias("n_words"), (F.col("chars") - F.col("blanks")).cast("long").alias("word_chars"),
        long("symbols").alias("n_symbols"), long("l.dup").alias("n_dup_lines"), long("w.again").alias("n_repeat_words"),
        ((F.col("w.n") < 20) | (100 * long("w.again") > 30 * long("w.n"))).alias("base_failed"),
        share("symbols", "w.n").alias("symbols_per_word"), share("upper", "chars").alias("upper_share"), share("exclaims", "w.n").alias("exclaim_per_word"),
        share("l.dup", "l.n").alias("dup_lines_per_line"), share("w.again", "w.n").alias("repeat_share"),
    )


#: Below this many, factorials are not replaced by Stirling's series.
FEW = 16


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), p at most a half, summed term by term.

    Only terms within twelve standard deviations (and 40 more) of the mean are
    summed, all others together stay below 1e-30; an array of them grows with the
    square root of n.
    """
    mean = n * F.lit(p)
    reach = 12 * F.sqrt(mean * (1 - p)) + 40
    low = F.floor(mean - reach)
    low = F.when(low < FEW, F.lit(0)).otherwise(low).cast("long")
    high = F.least(k, n, F.ceil(mean + reach)).cast("long")
    # the first term in Loader's form: deviances and errors of Stirling's series, no large terms that cancel
    error = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    deviance = lambda x, m: x * F.log(x / m) + m - x
    x, rest = low.cast("double"), (n - low).cast("double")
    apart = error(n.cast("double")) - error(x) - error(rest) - deviance(x, mean) - deviance(rest, n * F.lit(1 - p)) + F.log(n / (2 * math.pi * x * rest)) / 2
    start = F.when(low == 0, n * math.log1p(-p)).otherwise(apart).cast("double")
    zero = F.struct(start.alias("t"), F.exp(start).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(math.log(p / (1 - p)))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    steps = F.when(high > low, F.sequence(low + 1, F.greatest(high, low + 1))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < low, F.lit(0.0)).otherwise(F.aggregate(steps, zero, add, lambda a: a["s"]))


def certified(feats: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_above for every certified cutoff.

    ``feats`` is what features() gives; at most strata x rules rows return.
    """
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    held = feats.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id").groupBy("doc_id", "stratum").agg(*(F.max(r).alias(r) for r in RULES))
    counts = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)]
    by_stratum = stored(held.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts).where(F.col("n_good") >= risk.fewest), "strata")
    tests = F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("n_above"))
        for r, cs in RULES.items() for i, c in enumerate(cs)
    ))
    tried = by_stratum.select("stratum", "n_good", F.explode(tests).alias("t")).select("stratum", "n_good", "t.*")
    level = risk.test_level(by_stratum.count())
    passed = tried.withColumn("ok", binomial_cdf(F.col("n_above"), F.col("n_good"), risk.rule_risk) <= level)
    # the strictest cutoff before the first that fails: strictness and n_above rise together
    first = passed.groupBy("stratum", "rule", "n_good").agg(
        F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))), F.lit(10**6)).alias("fails_at"),
        F.collect_list(F.struct("step", "cutoff", "n_above")).alias("steps"),
    )
    kept = first.withColumn("best", F.array_max(F.filter("steps", lambda s: s["step"] < F.col("fails_at")))).where("best IS NOT NULL")
    return kept.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"), "n_good", F.col("best.n_above").alias("n_above"))


def verdict(cutoffs: list) -> Column:
    """False where a certified rule of the row's stratum rejects it."""
    bad = F.lit(False)
    for c in cutoffs:
        bad = bad | ((F.col("stratum") == c["stratum"]) & (F.col(c["rule"]) > c["cutoff"]))
    return ~F.col("base_failed") & ~bad


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Features of every document and ``kept``."""
    feats = stored(features(docs), "quality")
    return feats.withColumn("kept", verdict(certified(feats, labels, risk).collect()))


def keep(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with the same columns.

    Rows are stored with their features, so texts are read once and move to no
    join; only numbers meet the labels.
    """
    rows = stored(features(docs.select(whole_row(docs).alias("doc_id"), "text", "lang")).withColumnRenamed("doc_id", "row"), "quality")
    cutoffs = certified(rows.withColumn("doc_id", F.col("row.doc_id")).drop("row"), labels, risk).collect()
    return rows.where(verdict(cutoffs)).select(*columns_of("row", docs.columns))


def feature_sql(source: str = "documents") -> str:
    """DuckDB SQL for features() over the table ``source``."""
    return f"""
q8_text AS (SELECT doc_id, coalesce(lang, '{OTHER}') AS stratum, coalesce(text, '') AS text FROM {source}),
q8_words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, row_number() OVER () AS rid FROM q8_text),
q8_windows AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS win FROM q8_words WHERE len(ws) >= 8),
q8_twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM q8_windows) WHERE n > 1),
q8_again AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS again FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM q8_twice) GROUP BY rid),
q8_feats AS (SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(again, 0) > 30 * len(ws) AS base_failed,
  (length(text) - length(translate(text, '{SYMBOLS}', ''))) / greatest(len(ws), 1)::DOUBLE AS symbols_per_word,
  (length(text) - length(translate(text, '{UPPER}', ''))) / greatest(length(text), 1)::DOUBLE AS upper_share,
  (length(text) - length(translate(text, '!', ''))) / greatest(len(ws), 1)::DOUBLE AS exclaim_per_word,
  (len(ls) - len(list_distinct(ls))) / greatest(len(ls), 1)::DOUBLE AS dup_lines_per_line,
  coalesce(again, 0)::DOUBLE / greatest(len(ws), 1) AS repeat_share
  FROM q8_words LEFT JOIN q8_again USING (rid))"""


def verdict_sql(risk: Risk = Risk()) -> str:
    """DuckDB SQL after feature_sql(): table q8_cut of the certified cutoffs."""
    p = risk.rule_risk
    tests = ", ".join(f"('{r}', {i}, {c!r})" for r, cs in RULES.items() for i, c in enumerate(cs))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    most = ", ".join(f"max({r}) AS {r}" for r in RULES)
    return f"""
q8_good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
q8_held AS (SELECT doc_id, stratum, {most} FROM q8_feats JOIN q8_good USING (doc_id) WHERE NOT base_failed GROUP BY doc_id, stratum),
q8_tests(rule, step, cutoff) AS (VALUES {tests}),
q8_tried AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k FROM q8_held, q8_tests GROUP BY ALL HAVING count(*) >= {risk.fewest}),
q8_level AS (SELECT {risk.level!r} / ({len(RULES)} * greatest(1, count(DISTINCT stratum))) AS level FROM q8_tried),
q8_cdf AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) AS cdf FROM q8_tried),
q8_cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(cdf <= level) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM q8_cdf, q8_level) WHERE ok GROUP BY stratum, rule),
q8_bad AS (SELECT DISTINCT f.doc_id AS bad_id, f.stratum AS bad_stratum FROM q8_feats f JOIN q8_cut c ON f.stratum = c.stratum AND {value.replace("CASE rule", "CASE c.rule")} > c.cutoff)"""


def oracle() -> str:
    cols = "doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, " + ", ".join(RULES)
    return f"WITH {feature_sql()},{verdict_sql()}\nSELECT {cols}, NOT base_failed AND bad_id IS NULL AS kept FROM q8_feats LEFT JOIN q8_bad ON bad_id = doc_id AND bad_stratum = stratum"
