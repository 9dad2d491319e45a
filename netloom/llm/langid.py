"""Language identification, words first.

A known word is scored by its log frequency in each language.  An unseen word
falls back to character n-grams: the longest n for which at least half of its
n-grams are known, then shorter ones, down to single letters.  A document's
score is the naive Bayes posterior of its best language.

The model is fitted on a bounded sample of labelled rows: about ``per_lang``
documents of each language, or fewer of each where that would be more than
``most_rows`` in all; which ones a hash of the row decides.  Every language is
learnt.  All words of the sample and all their n-grams are kept, so no language
starves another; the sample bounds the model, which may therefore be broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is everything when no labelled row exists; equal scores go to the language
that is first in code-point order; null languages are not learnt; whole texts
are read however long they are; repeated rows are predicted alike; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import columns_of, whole_row
from netloom.storage import stored

UNKNOWN = "und"
#: Runs of letters, and of the number signs that Python counts as word characters too.
RUNS = re.compile(r"[^\W\d_]+")
LONGEST = 4


def letters(text: str) -> list[str]:
    """The words of a text: runs of letters (Unicode's L), in lower case."""
    found = RUNS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]
    return found


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)] or [w]


class Table:
    """Items and one row of log frequencies for each."""

    def __init__(self, at: dict[str, int], counts: np.ndarray):
        self.at = at
        self.logs = self._logs(counts) if at else np.zeros((0, 0))

    def get(self, item: str) -> np.ndarray | None:
        i = self.at.get(item)
        return None if i is None else self.logs[i]

    @staticmethod
    def _logs(m: np.ndarray, smooth: float = 0.5) -> np.ndarray:
        """Log frequencies, less their log sum: what an item says about the language."""
        m = m + smooth
        logs = np.log(m / m.sum(axis=0))
        top = logs.max(axis=1, keepdims=True)
        return logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))


class Model:
    """Log frequencies by language of words and of n-grams."""

    def __init__(self, counts: dict[tuple[str, str], int], most_cached: int = 50_000):
        self.langs = sorted({lang for lang, _ in counts})
        at = {x: i for i, x in enumerate(self.langs)}
        words: dict[str, int] = {}
        rows = [words.setdefault(word, len(words)) for _, word in counts]
        by_word = np.zeros((len(words), len(self.langs)))
        np.add.at(by_word, (rows, [at[lang] for lang, _ in counts]), list(counts.values()))
        self.words, self.grams = Table(words, by_word), []
        for n in range(1, LONGEST + 1):
            found: dict[str, int] = {}
            gram, of = array("q"), array("q")
            for word, i in words.items():
                for g in grams(word, n):
                    gram.append(found.setdefault(g, len(found)))
                    of.append(i)
            gram, of = np.frombuffer(gram, np.int64), np.frombuffer(of, np.int64)
            by_gram = np.zeros((len(found), len(self.langs)))
            for k in range(len(self.langs)):  # a language at a time, to need little memory
                by_gram[:, k] = np.bincount(gram, weights=by_word[of, k], minlength=len(found))
            self.grams.append(Table(found, by_gram))
        self.cache: dict[str, np.ndarray] = {}
        self.most_cached = most_cached

    def word(self, w: str) -> np.ndarray:
        got = self.words.get(w)
        if got is None:
            got = self.cache.get(w)
        if got is None:
            got = self._backoff(w)
            if len(self.cache) >= self.most_cached:
                self.cache.clear()
            self.cache[w] = got
        return got

    def _backoff(self, w: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            all_, table = grams(w, n), self.grams[n - 1]
            known = [table.logs[table.at[g]] for g in all_ if g in table.at]
            if known and 2 * len(known) >= len(all_):
                return np.mean(known, axis=0)
        return np.full(len(self.langs), -math.log(max(1, len(self.langs))))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(letters(text)) if isinstance(text, str) else None
        if not found or not self.langs:
            return UNKNOWN, 0.0
        total = np.array([self.word(w) for w in found]).T @ np.fromiter(found.values(), float, len(found))
        p = np.exp(total - total.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(labelled: DataFrame, per_lang: int = 3000, most_rows: int = 100_000) -> Model:
    """Model of rows (key, text, lang); ``key`` and text only order the sample."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    n = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    each = min(per_lang, most_rows / max(1, n.count()))
    u = F.pmod(F.xxhash64("key", "text", F.lit("langid")), F.lit(10**9)) / 1e9
    drawn = rows.join(n, "lang").where(u < each / F.col("n")).select("lang", "text")

    def run(batches):
        for pdf in batches:
            counts = Counter()
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                counts.update((lang, w) for w in letters(text))
            yield pd.DataFrame([(*k, c) for k, c in counts.items()], columns=["lang", "word", "n"]).astype({"n": "int64"})

    got = drawn.mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return Model(dict(zip(zip(*(got[c].to_pylist() for c in ("lang", "word"))), got["n"].to_pylist(), strict=True)))


def predictor(model: Model):
    """A column function text -> struct<lang_pred, score>.  PySpark broadcasts the
    function with the model in it, whose size is bounded."""
    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run


def fit_documents(docs: DataFrame, **bounds) -> Model:
    """Model of the documents that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"), **bounds)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    p = predictor(model)(F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least this score."""
    p = predictor(model)(F.col("text"))
    judged = docs.select(whole_row(docs).alias("row"), p.alias("p"))
    return judged.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select(*columns_of("row", docs.columns))
