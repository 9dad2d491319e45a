import math
import random

from pyspark.sql import functions as F

from netloom.llm import quality


def binom_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def brute(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(hit))


def test_base_counts_match_brute_force(spark):
    random.seed(3)
    texts = [None, "", " \n\t ", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 30, "l\nl\n\nl\n \n", "é#ß|\x0b\x0c\r<>", "  a b"]
    for _ in range(40):
        texts.append("".join(random.choice(["a ", "b ", "c\n", "d\t", "# "]) for _ in range(random.randint(1, 120))))
    texts.append(" ".join(str(random.randint(0, 10**6)) for _ in range(60_000)))
    df = spark.createDataFrame([(i, t, None, 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: tuple(r)[2:7] for r in quality.features(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial(spark):
    cases = [(0, 10), (3, 10), (10, 10), (5, 1000), (20, 1000), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_cdf(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        assert abs(r.p - binom_cdf(r.k, r.n, 0.01)) < 1e-9


def exact_cdf(k, n, p):
    """By logarithms of factorials: for n beyond what floats of comb() hold."""
    some = range(max(0, int(n * p - 60 * (n * p) ** 0.5)), k + 1)
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in some)


def test_binomial_of_many_sums_only_terms_near_the_mean(spark):
    cases = [(k, 200_000) for k in (0, 1500, 1850, 1900, 2000, 2100, 200_000)] + [(k, 24_000) for k in (100, 190, 240, 300)] + [(9_900_000, 10**9), (2 * 10**8, 10**9), (10**9, 10**9)]
    got = {(r.k, r.n): r.p for r in spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_cdf(F.col("k"), F.col("n"), 0.01)).collect()}
    for k, n in cases[:6] + cases[7:11]:
        want = exact_cdf(k, n, 0.01)
        assert abs(got[k, n] - want) <= 1e-7 * want + 1e-25, (k, n)
    assert got[9_900_000, 10**9] == 0  # 31 standard deviations below the mean
    assert all(abs(got[c] - 1) < 1e-6 for c in ((200_000, 200_000), (2 * 10**8, 10**9), (10**9, 10**9)))


def test_strata_are_the_languages_of_the_labels(spark):
    assert quality.Risk().fewest == 459 and quality.Risk().test_level(2) == 0.005
    rules = list(quality.RULES)
    rows = [(i, lang, False) for i, lang in enumerate(["pt"] * 700 + ["other"] * 700 + ["cs"] * 300)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean").selectExpr("*", *(f"0D AS {r}" for r in rules))
    lab = spark.range(2000).selectExpr("id AS doc_id", "1 AS quality")
    got = {(r.stratum, r.rule): r.cutoff for r in quality.certified(df, lab).collect()}
    assert got == {(s, r): quality.RULES[r][-1] for s in ("pt", "other") for r in rules}  # cs has too few
    docs = spark.createDataFrame([(1, "a", "pt"), (2, "a", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.stratum for r in quality.features(docs).collect()} == {1: "pt", 2: "other"}


def test_cutoffs_follow_the_labels(spark):
    good = "word other thing " * 20
    bad = "w# o# t# " * 20
    docs, labels = [], []
    for i in range(1200):
        docs.append((i, bad if i % 4 == 0 else good, "en" if i < 1100 else None))
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    labels += [(1, 1, 0), (None, 1, 0), (5, None, 0), (99_999, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("text", F.concat_ws(" ", "text", "doc_id"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    uniq = d.selectExpr("doc_id", "lang", "array_join(transform(split(text, ' '), (w, i) -> concat(w, i)), ' ') AS text")
    kept = {r.doc_id: r.kept for r in quality.judge(uniq, lab).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in range(1100))
    assert all(kept[i] for i in range(1100, 1200))  # too few labels in "other": nothing certified
    back = quality.keep(uniq, lab)
    assert back.columns == uniq.columns and {r.doc_id for r in back.collect()} == {i for i, k in kept.items() if k}
    none = quality.judge(uniq, lab.where("false")).where("kept").count()
    assert none == 1200
    assert quality.judge(uniq.where("false"), lab).count() == 0


def test_good_documents_above_stop_the_cutoff(spark):
    rows = [(i, "en", False, 0.3 if i % 20 == 0 else 0.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, symbols_per_word double")
    for r in list(quality.RULES)[1:]:
        df = df.selectExpr("*", f"0D AS {r}")
    lab = spark.range(2000).selectExpr("id AS doc_id", "1 AS quality")
    got = {r.rule: r.cutoff for r in quality.certified(df, lab).collect()}
    assert got["symbols_per_word"] == 0.5  # 5 % of the good lie above 0.25
    assert got["upper_share"] == quality.RULES["upper_share"][-1]
