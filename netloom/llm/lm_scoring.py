"""Cross-entropy difference of matched n-gram models.

Target (documents labelled good) and background (all documents) have bigram
models of the same form over one vocabulary: a word follows another with
probability (c(a, b) + s) / (c(a) + s V), V words and a small s for what was
never seen.  The background's counts are scaled to the target's number of
words, so that both models smooth alike.  A document's score is the mean over
its tokens (words and the end) of the target's loss less the background's: the
lower, the more it reads like the target.  A document's own counts are taken
out of both models before it is scored.

The models hold every word and every pair of all documents and are nowhere in
one place.  Losses are sums over pairs and over contexts, here called items,
so an item's losses can be made wherever all of its counts meet:

1. Items that a sample shows to be frequent are counted exactly over all
   documents by partial sums; their counts (at most ``most_hot``) return to
   every task.  Which items these are decides speed, never results.
2. All other items of each document travel once, packed, to the bucket of
   their hash.  A bucket holds every occurrence of its items, counts them and
   gives each document's losses back; buckets hold about ``bucket_words``
   words' items each, however many there are.
3. The parts of each chunk of documents are added.

Words are told apart by 64-bit hashes and items within a bucket by 40 bits:
with 10^8 items in 100 buckets one in a million shares its counts with another.
V, the size of the open vocabulary, is the exact number of distinct hashes and
one, and is the same in both models.  Texts meet the labels by one shuffle of
both, however many labels there are.

Defined cases: null texts and texts without words score null and count 0
tokens; labels without document or quality are ignored; without a good label
the target is uniform over the vocabulary; repeated rows count and score each
for itself; an empty table gives an empty result; whole texts are read; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import as_text
from netloom.storage import stored


@dataclass(frozen=True)
class Models:
    """smooth: what every pair counts beyond its occurrences. most_hot: items
    counted apart from buckets. sample_docs: documents, about, that show which.
    bucket_words: words behind a bucket. chunk: items of a chunk of documents.
    held_words: distinct words that a task keeps before it hands them on."""

    smooth: float = 0.01
    most_hot: int = 100_000
    sample_docs: int = 10_000
    bucket_words: int = 1_500_000
    chunk: int = 600_000
    held_words: int = 1_000_000


def tokens(text) -> list[str]:
    return text.lower().split() if isinstance(text, str) else []


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target (whether the document is labelled good)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    # only ids are hashed in a task, texts stream by; rows without an id have no label and stay where they are
    named = rows.where("doc_id IS NOT NULL").join(good.hint("shuffle_hash"), F.col("doc_id") == F.col("good_id"), "left").select("doc_id", "text", F.col("good_id").isNotNull().alias("target"))
    return stored(named.unionByName(rows.where("doc_id IS NULL").withColumn("target", F.lit(False))), "marked")


class Hashes(dict):
    """Words -> 64-bit hashes; a bounded cache."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        self[word] = h
        return h

    def of(self, text) -> np.ndarray:
        ws = tokens(text)
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


#: Stand for what precedes the first word and follows the last.
START, END = np.uint64(0x5BD1E995), np.uint64(0xC2B2AE35)
ONE, MIX = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def items(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, counts) of a document: odd ones are contexts, even ones pairs."""
    before = np.concatenate([[START], words])
    after = np.concatenate([words, [END]])
    pair = (before ^ (after << np.uint64(29) | after >> np.uint64(35))) * MIX
    pair ^= pair >> np.uint64(32)
    return np.unique(np.concatenate([pair & ~ONE, before | ONE]), return_counts=True)


def losses(keys: np.ndarray, n: np.ndarray, own: np.ndarray, background: np.ndarray, target: np.ndarray, scale: float, smooth: float, words: float):
    """(background's loss, target's less it) that n occurrences of items add.

    background, target: counts in all documents; own: n where the document
    itself is in the target.
    """
    context = (keys & ONE).astype(bool)
    base = np.where(context, smooth * words, smooth)
    sign = np.where(context, n, -n)
    b = sign * np.log(scale * (background - n) + base)
    return b, sign * np.log(target - own + base) - b


def frequent(rows: DataFrame, cfg: Models) -> np.ndarray:
    """Items that a sample of the documents holds most often, ascending."""
    n = rows.count()

    def run(batches):
        made = Hashes()
        for pdf in batches:
            found = [items(ws) for ws in map(made.of, pdf["text"]) if len(ws)]
            if found:
                key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                count = np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)
                often = count > 1
                yield pd.DataFrame({"item": key[often].view(np.int64), "n": count[often]})

    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n))) < cfg.sample_docs).select("text")
    top = drawn.mapInPandas(run, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item").limit(cfg.most_hot)
    return np.sort(top.select("item").toArrow()["item"].to_numpy().astype(np.int64).view(np.uint64))


@dataclass(frozen=True)
class Counts:
    """What every task knows: counts of frequent items and sums of all words."""

    hot: np.ndarray
    background: np.ndarray
    target: np.ndarray
    words: float
    n_background: int
    n_target: int

    @property
    def scale(self) -> float:
        return self.n_target / self.n_background if self.n_target else 1.0


def find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted_, whether it is there) of each key."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


def counted(rows: DataFrame, hot: np.ndarray, cfg: Models) -> Counts:
    """Exact counts of ``hot``, sums over all documents and the number of
    distinct words, in one pass over the texts."""

    def run(batches):
        made, size = Hashes(), len(hot)
        sums = np.zeros((2, size), np.int64)
        n, held, n_held = [0, 0], [], 0
        for pdf in batches:
            for text, target in zip(pdf["text"], pdf["target"], strict=True):
                ws = made.of(text)
                if not len(ws):
                    continue
                key, c = items(ws)
                at, there = find(hot, key)
                sums[0][at[there]] += c[there]
                n[0] += len(ws) + 1
                if target:
                    sums[1][at[there]] += c[there]
                    n[1] += len(ws) + 1
                held.append(np.unique(ws))
                n_held += len(held[-1])
                if n_held > 2 * cfg.held_words:
                    held = [np.unique(np.concatenate(held))]
                    n_held = len(held[0])
                    if n_held > cfg.held_words:
                        yield words(held[0])
                        held, n_held = [], 0
        if held:
            yield words(np.unique(np.concatenate(held)))
        seen = np.flatnonzero(sums[0])
        yield pd.DataFrame({"kind": 0, "at": seen, "background": sums[0][seen], "target": sums[1][seen]})
        yield pd.DataFrame({"kind": 2, "at": [0], "background": [n[0]], "target": [n[1]]})

    words = lambda found: pd.DataFrame({"kind": 1, "at": found.view(np.int64), "background": 0, "target": 0})
    found = stored(rows.select("text", "target").mapInPandas(run, "kind int, at long, background long, target long"), "counted")
    distinct = found.where("kind = 1").select("at").distinct().count()
    got = found.where("kind <> 1").groupBy("kind", "at").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow().to_pandas()  # at most ``most_hot`` rows and one
    out = np.zeros((2, len(hot)), np.int64)
    part = got[got["kind"] == 0]
    out[:, part["at"].to_numpy()] = part[["background", "target"]].to_numpy().T
    n = got[got["kind"] == 2][["background", "target"]].sum()
    return Counts(hot, out[0], out[1], distinct + 1.0, int(n["background"]), int(n["target"]))


PACKED = "bucket int, chunk long, low binary, high binary, doc binary, n binary, targets int, ids binary, b binary, d binary, words binary"
SUMS = "chunk long, doc binary, ids binary, b binary, d binary, words binary"


def packed(rows: DataFrame, counts: Counts, buckets: int, cfg: Models) -> DataFrame:
    """Documents in chunks: one row a chunk with their ids and what frequent
    items add, under a bucket below 0, and one a chunk and bucket with all other
    items of its documents.  Documents of the target come first in a chunk."""

    def run(batches):
        made, part, number = Hashes(), TaskContext.get().partitionId(), 0
        held, n_items = [], 0
        for pdf in batches:
            for doc, text, target in zip(pdf["doc_id"], pdf["text"], pdf["target"], strict=True):
                ws = made.of(text)
                key, n = items(ws) if len(ws) else (ws, ws.astype(np.int64))
                held.append((doc, bool(target), len(ws) and len(ws) + 1, key, n))
                n_items += len(key)
                if n_items >= cfg.chunk or len(held) == 65_535:
                    yield chunk(held, (part << 32) + number)
                    held, n_items, number = [], 0, number + 1
        if held:
            yield chunk(held, (part << 32) + number)

    def chunk(held, name):
        held.sort(key=lambda x: not x[1])
        targets = sum(x[1] for x in held)
        sizes = [len(x[3]) for x in held]
        doc = np.repeat(np.arange(len(held), dtype=np.int64), sizes)
        key = np.concatenate([x[3] for x in held])
        n = np.concatenate([x[4] for x in held])
        at, there = find(counts.hot, key)
        h, k = at[there], n[there]
        b, d = losses(key[there], k, np.where(doc[there] < targets, k, 0), counts.background[h], counts.target[h], counts.scale, cfg.smooth, counts.words)
        sums = [np.bincount(doc[there], weights=x, minlength=len(held)) for x in (b, d)]
        ids = np.array([(0, 1) if x[0] is None else (int(x[0]), 0) for x in held], np.int64)
        words = np.array([x[2] for x in held], np.int64)
        rows = [(-1 - name % buckets, name, b"", b"", b"", b"", targets, ids.tobytes(), sums[0].tobytes(), sums[1].tobytes(), words.tobytes())]
        key, n, doc = key[~there], n[~there], doc[~there]
        more = n > 255
        while more.any():  # a count of more than a byte is sent in parts
            key, doc = np.concatenate([key, key[more]]), np.concatenate([doc, doc[more]])
            n = np.concatenate([np.where(more, n - 255, n), np.full(int(more.sum()), 255)])
            more = n > 255
        bucket = (key >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((doc, bucket))
        key, n, doc, bucket = key[order], n[order], doc[order], bucket[order]
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(key)] if len(key) else []
        low, high = (key & np.uint64(0xFFFFFFFF)).astype("<u4"), ((key >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
        doc, n = doc.astype("<u2"), n.astype(np.uint8)
        for s, e in pairwise(edges):
            rows.append((int(bucket[s]), name, low[s:e].tobytes(), high[s:e].tobytes(), doc[s:e].tobytes(), n[s:e].tobytes(), targets, None, None, None, None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

    return rows.select(*as_text("doc_id"), "text", "target").mapInPandas(run, PACKED)


def scored_buckets(pieces: DataFrame, counts: Counts, cfg: Models) -> DataFrame:
    """Each chunk's losses from every bucket; rows below bucket 0 pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pdf[[c.split()[0] for c in SUMS.split(", ")]]
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        key = join("low", "<u4").astype(np.uint64) | join("high", np.uint8).astype(np.uint64) << np.uint64(32)
        doc, n = join("doc", "<u2").astype(np.int64), join("n", np.uint8).astype(np.int64)
        row = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["n"]])
        of = row << 16 | doc
        # a document's parts of one item are one again
        order = np.lexsort((of, key))
        key, of, n = key[order], of[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]))
        n, key, of = np.add.reduceat(n, first), key[first], of[first]
        own = np.where((of & 0xFFFF) < pdf["targets"].to_numpy()[of >> 16], n, 0)
        _, at = np.unique(key, return_inverse=True)
        background, target = (np.bincount(at, weights=x)[at] for x in (n, own))
        b, d = losses(key, n, own, background, target, counts.scale, cfg.smooth, counts.words)
        groups, at = np.unique(of, return_inverse=True)
        sums = [np.bincount(at, weights=x).astype("<f4") for x in (b, d)]
        docs, rows = (groups & 0xFFFF).astype("<u2"), groups >> 16
        cut = np.searchsorted(rows, np.arange(len(pdf) + 1))
        pick = lambda x: [x[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame({"chunk": pdf["chunk"], "doc": pick(docs), "ids": None, "b": pick(sums[0]), "d": pick(sums[1]), "words": None})

    return pieces.groupBy("bucket").applyInPandas(run, SUMS)


def added(parts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, background_loss, score: the sums of each chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["ids"].notna()].iloc[0]
        ids = np.frombuffer(head["ids"], np.int64).reshape(-1, 2)
        n = np.frombuffer(head["words"], np.int64)
        sums = [np.frombuffer(head[c], np.float64).copy() for c in ("b", "d")]
        rest = pdf[pdf["ids"].isna()]
        doc = np.frombuffer(b"".join(rest["doc"]), "<u2").astype(np.int64)
        for k, c in enumerate(("b", "d")):
            sums[k] += np.bincount(doc, weights=np.frombuffer(b"".join(rest[c]), "<f4"), minlength=len(n))
        mean = [np.where(n > 0, x / np.maximum(n, 1), np.nan) for x in sums]
        return pd.DataFrame({"doc_id": pd.array(np.where(ids[:, 1], 0, ids[:, 0]), "Int64"), "none": ids[:, 1] > 0, "n_tokens": n, "background_loss": mean[0], "score": mean[1]})

    got = parts.groupBy("chunk").applyInPandas(run, "doc_id long, none boolean, n_tokens long, background_loss double, score double")
    known = lambda c: F.when(F.col("n_tokens") > 0, F.col(c)).alias(c)
    return got.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_tokens", known("background_loss"), known("score"))


def scores(docs: DataFrame, labels: DataFrame, cfg: Models = Models()) -> DataFrame:
    """doc_id, n_tokens, background_loss, score of every document, by models of
    every word and pair."""
    rows = marked(docs, labels)
    counts = counted(rows, frequent(rows, cfg), cfg)
    buckets = max(1, -(-counts.n_background // cfg.bucket_words))
    return added(scored_buckets(packed(rows, counts, buckets, cfg), counts, cfg))
