"""Alignment of two tokenizers: which tokens cover the same bytes of a text.

Documents are taken in blocks of a few megabytes.  Token ends are running sums
of byte lengths; ends common to both tokenizers cut the tokens into groups, and
a search among the cuts labels each token with its group.  Overlapping pairs
come from repeating every A token by the number of B tokens it meets.  As both
tokenizers end where a document ends, a block is aligned as one long text.

A block's distinct pairs, each with the number of its documents, are summed
over the corpus in two stages, by (pair, salt) and by pair.  The counts return
to the blocks by a salted join, and each block adds up its documents.  Rows
that move are a block's distinct pairs, not its links.

Defined cases: a null or empty text, and a text whose tokens don't spell it
(one with U+2581, which B reads as a space), have no tokens: zeros and ''; null
doc_ids are kept; repeated rows count as documents of their own; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.packing import IdBytes, byte_letters
from netloom.storage import stored

#: One row a block: its documents, and its distinct pairs with their documents.
DOCS = "array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, pairs: int>>"
BLOCK = f"block bigint, docs {DOCS}, at binary, times binary, codes array<bigint>, held array<int>"
LINKED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
NONE = np.empty(0, np.int64)


class PlainIds(IdBytes):
    """Ids of a byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        self.encode, self.special = whole.encode, None
        back = {c: b for b, c in byte_letters().items()}
        entries = whole.get_vocab()
        self.spelled = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.spelled[i] = bytes(back[ord(c)] for c in entry) if all(ord(c) in back for c in entry) else entry.encode()


class PieceIds(dict):
    """Ids of a piece tokenizer that writes spaces as U+2581 and puts one first.

    A text is taken in parts that begin with spaces: where no piece has a space
    after another character, no merge crosses from one part to the next.
    """

    LONGEST = 64  # characters of a part that is worth keeping

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        super().__init__()
        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.parts = re.compile(" +[^ ]*") if not any(re.search("[^▁]▁", p) for p in pieces) else re.compile(".+", re.DOTALL)
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def __missing__(self, part: str) -> list[int]:
        ids = self.model.encode(part[1:]) if part != " " else [self.model.piece_to_id("▁")]
        if len(part) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[part] = ids
        return ids

    def of(self, spaced: str) -> list[int]:
        """Ids of a text that has the leading space already."""
        out: list[int] = []
        for part in self.parts.findall(spaced):
            out += self[part]
        return out


def links(ends_a: np.ndarray, ends_b: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all overlaps of the A tokens from lo up to hi."""
    starts = ends_a[lo - 1 : hi - 1] if lo else np.concatenate(([0], ends_a[: hi - 1]))
    first = np.searchsorted(ends_b, starts, side="right")
    last = np.searchsorted(ends_b, ends_a[lo:hi], side="left") + 1
    n = last - first
    a = np.repeat(np.arange(lo, hi), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return a, b


class Aligner:
    """Two tokenizers and what a block of texts gives under both."""

    SLICE = 500_000  # A tokens whose links are expanded at a time

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainIds(path_a), PieceIds(path_b)
        self.n_a, self.n_b = len(self.a.spelled), len(self.b.spelled)
        self.bytes_a = np.array([len(x) for x in self.a.spelled], np.int64)
        self.bytes_b = np.array([len(x) for x in self.b.spelled], np.int64)
        # how a token is written: within its group, and as its group's last one
        written = [f"{i}," for i in range(self.n_a)] + [f"{i}|" for i in range(self.n_a)]
        written += [f"{i}," for i in range(self.n_b)] + [f"{i};" for i in range(self.n_b)]
        self.written = np.array(written, object)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return NONE, NONE
        spaced = " " + text
        a, b = np.frombuffer(self.a.of(spaced), "<u4").astype(np.int64), self.b.of(spaced)
        raw = spaced.encode()
        if b"".join(map(self.b.spelled.__getitem__, b)) != raw or b"".join(map(self.a.spelled.__getitem__, a.tolist())) != raw:
            return NONE, NONE
        return a, np.array(b, np.int64)

    def block(self, texts: list[str | None]) -> dict:
        """Columns of a block: by document, and by distinct pair."""
        both = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in both]) if both else NONE for k in (0, 1))
        del both
        ends_a, ends_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], [True] * min(1, len(a))), np.append(group_b[1:] != group_b[:-1], [True] * min(1, len(b)))
        # a group's A tokens, then its B tokens
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = a + self.n_a * last_a
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * self.n_a + b + self.n_b * last_b
        stop = np.cumsum(n_a + n_b)
        digests = []
        for lo, hi in zip((stop - n_a - n_b).tolist(), stop.tolist(), strict=True):
            digests.append(hashlib.sha256("".join(self.written[order[lo:hi]])[:-1].encode()).hexdigest() if hi > lo else "")
        # occurrences by (document, pair)
        doc_of, n_links, keys, times = np.repeat(np.arange(len(texts)), n_a), np.zeros(len(texts), np.int64), [NONE], [NONE]
        for lo in range(0, len(a), self.SLICE):
            i, j = links(ends_a, ends_b, lo, min(len(a), lo + self.SLICE))
            n_links += np.bincount(doc_of[i], minlength=len(texts))
            key, n = np.unique((doc_of[i] * self.n_a + a[i]) * self.n_b + b[j], return_counts=True)
            keys.append(key)
            times.append(n)
        key, n = np.concatenate(keys), np.concatenate(times)
        if len(keys) > 2:  # a document may go on in the next slice
            key, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, weights=n, minlength=len(key)).astype(np.int64)
        doc, code = np.divmod(key, self.n_a * self.n_b)
        codes, at, held = np.unique(code, return_inverse=True, return_counts=True)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of[last_a], minlength=len(texts)), "n_links": n_links, "groups_sha256": digests,
            "pairs": np.bincount(doc, minlength=len(texts)), "at": at, "times": n, "codes": codes, "held": held,
        }


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = 4_000_000) -> DataFrame:
    """Aligned blocks of about ``block_bytes`` of text; a longer text is a block
    of its own.  Stored: the ids of blocks are fixed from here on."""
    docs_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.int32())]))
    types = [pa.int64(), docs_type, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = Aligner(*_paths(path_a, path_b)), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[str | None] = []

        def flush() -> pa.RecordBatch:
            got = aligner.block(texts)
            per_doc = [dict(zip(names, row, strict=True)) for names in [("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")]
                       for row in zip(ids, *(x if isinstance(x, list) else x.tolist() for x in (got[c] for c in names[1:])), strict=True)]
            row = [[number], [per_doc], [packed(got["at"])], [packed(got["times"])], [got["codes"]], [got["held"]]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["block", "docs", "at", "times", "codes", "held"])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= block_bytes or len(ids) >= 20_000:
                    yield flush()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK), "alignment")


def _pairs(aligned: DataFrame, salts: int) -> DataFrame:
    """block, salt and, by distinct pair of it, its place, code and documents."""
    e = aligned.select("block", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.posexplode(F.arrays_zip("codes", "held")).alias("place", "p"))
    return e.select("block", "salt", "place", F.col("p.codes").alias("code"), F.col("p.held").alias("held"))


def pair_counts(aligned: DataFrame, n_b: int, salts: int = 16) -> DataFrame:
    """code, a_id, b_id, n_docs of every linked pair, and whether no other pair
    of its A id is in more documents."""
    summed = _pairs(aligned, salts).groupBy("code", "salt").agg(F.sum("held").alias("n")).groupBy("code").agg(F.sum("n").alias("n_docs"))
    summed = summed.withColumn("a_id", F.floor(F.col("code") / n_b)).withColumn("b_id", F.col("code") % n_b)
    most = summed.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return summed.join(F.broadcast(most), "a_id").withColumn("best", F.col("n_docs") == F.col("most")).drop("most")  # one row an entry of A's vocabulary


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = 4_000_000, salts: int = 16) -> DataFrame:
    """Counts and digest of every document's alignment, and how its links rank
    in the corpus."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=_paths(path_a, path_b)[1]).vocab_size()
    aligned = blocks(docs, path_a, path_b, block_bytes)
    rated = pair_counts(aligned, n_b, salts).select("code", "n_docs", "best").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = _pairs(aligned, salts).join(rated, ["code", "salt"]).select(F.col("block").alias("home"), "place", "n_docs", "best")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add_up(block: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        place = pairs["place"].to_numpy()
        count[place], best[place] = pairs["n_docs"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
        per_doc = block["docs"].combine_chunks().flatten()
        at, times = unpacked(block["at"][0].as_py()), unpacked(block["times"][0].as_py())
        doc = np.repeat(np.arange(len(per_doc)), per_doc.field("pairs").to_numpy())
        sums = []
        for x in (times * best[at], times * count[at]):
            total = np.zeros(len(per_doc), np.int64)
            np.add.at(total, doc, x)  # exact, unlike weights of bincount
            sums.append(total)
        given = {c: per_doc.field(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        given |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table({"doc_id": per_doc.field("doc_id")} | {c: given[c] for c in names})

    left = aligned.select("block", "docs", "at", "times").groupBy("block")
    return left.cogroup(found.groupBy("home")).applyInArrow(add_up, LINKED)
