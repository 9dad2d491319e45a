"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Every document's ids (with an end id) are cut into full windows first; the
rest of each document is one piece that best-fit-decreasing places into the
open window whose remaining capacity fits it most tightly.  A segment tree
over remaining capacities finds that window in O(log window) steps.

Pieces, not texts, are shuffled: the tokenising pass emits a few numbers a
piece.  Pieces are dealt by a hash of the whole row and its number to shards of a fixed
size, each packed on its own, so no task grows with the corpus and
only the last windows of a shard stay partly empty.

Defined cases: a null or empty text is one piece that holds the end id alone;
a null doc_id is packed like any other and keeps its null; repeated rows are
packed once each; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import as_longs, as_text

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"

#: The code points of Unicode's White_Space property.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and marks of which it is certain how the pre-tokenizer sees them;
#: none that a special token's string begins or ends with.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARK = "!-&(-/:;=?@\\[-`{}~"
#: Cuts only where the byte-level pre-tokenizer cuts too: encoding the parts
#: and joining the ids is the same as encoding the text.
PARTS = re.compile(
    f" ?[{LETTER}]+(?![^\\W\\d_]|')| ?[{MARK}]+(?=[{SPACE}{LETTER}]|\\Z)"
    f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


#: A part that the pre-tokenizer keeps whole, so that the model can take it as it is.
WHOLE = re.compile(f" ?(?:[{LETTER}]+|[{MARK}]+)\\Z")


def byte_letters() -> dict[int, int]:
    """Byte -> the code point by which a byte-level vocabulary writes it:
    printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class IdBytes(dict):
    """Part of a text -> its ids as little-endian unsigned 32-bit integers.

    Holds at most ``most`` parts; when full it starts anew, which costs time
    and changes nothing else.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(path)
        self.encode, self.model, self.letters, self.most = whole.encode, whole.model, byte_letters(), most
        special = sorted((t.content for t in whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if WHOLE.match(part):
            written = part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(written)]
        else:
            ids = self.encode(part, add_special_tokens=False).ids
        out = self[part] = array("I", ids).tobytes()
        return out

    def of(self, text: str) -> bytes:
        if self.special is None or self.special.search(text) is None:
            return b"".join(map(self.__getitem__, PARTS.findall(text)))
        # a special token ends the text before it, as it does for the tokenizer
        out = []
        for i, segment in enumerate(self.special.split(text)):
            out += [self[segment]] if i % 2 else map(self.__getitem__, PARTS.findall(segment))
        return b"".join(out)


def tokenised(path: str | None = None):
    """A function text -> id bytes, made on first use in each worker."""
    import public_tokenizers

    return IdBytes(path or public_tokenizers.path("byte_bpe_50k.json")).of


def cut(ids: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's id bytes."""
    n = len(ids) // 4
    for start in range(0, n, window):
        stop = min(n, start + window)
        yield start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree.

    A leaf is a capacity; a node is true if any window below it is open.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.at: list[list] = [[] for _ in range(self.size)]

    def put(self, room: int, what) -> None:
        self.at[room].append(what)
        i = room + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, need: int):
        """(room, window) of the tightest open window with room >= need, or None."""
        some, i = self.some, need + self.size
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):  # up until a right sibling has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        room = i - self.size
        what = self.at[room].pop()
        if not self.at[room]:
            some[i] = 0
            i >>= 1
            while i:
                some[i] = some[2 * i] | some[2 * i + 1]
                i >>= 1
        return room, what


def best_fit_decreasing(lengths, window: int):
    """(sequence, offset) for lengths given in descending order."""
    open_, sequences, out = OpenWindows(window), 0, []
    for n in lengths:
        got = open_.take(n)
        if got is None:
            got = window, sequences
            sequences += 1
        room, s = got
        out.append((s, window - room))
        if room > n:
            open_.put(room - n, s)
    return out


def pieces(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of every document of ``docs(doc_id, text)``."""

    def run(batches):
        of, end = tokenised(tokenizer), array("I", [end_id]).tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = (of(text) if isinstance(text, str) else b"") + end
                rows += [(doc, s, n, crc, len(ids) // 4) for s, n, crc in cut(ids, window)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return as_longs(docs.select(*as_text("doc_id"), F.col("text").cast("string")).mapInPandas(run, PIECES), "doc_id")


def pack(cut_pieces: DataFrame, n_docs: int, window: int = 2048, shard_docs: int = 20_000) -> DataFrame:
    """Places pieces into sequences of at most ``window`` tokens.

    ``shard_docs`` is the expected number of documents behind a shard; it
    bounds a task's memory and decides how many windows stay partly empty.
    """
    shards = max(1, -(-n_docs // shard_docs))
    # the row's number deals out pieces that are alike in everything else
    dealt = cut_pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    # A shard's rows must meet in one task; several shards may share one.
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32").withColumns({"doc_id": as_text("doc_id")[0]})

    def flush(parts, shard):
        pdf = pd.concat(parts, ignore_index=True)
        placed = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = [(shard << 32) + s for s, _ in placed]
        pdf["offset"] = [o for _, o in placed]
        return pdf.drop(columns="shard")

    def run(batches):
        held, at = [], None
        for pdf in batches:
            for shard, part in pdf.groupby("shard", sort=False):
                if held and shard != at:
                    yield flush(held, at)
                    held = []
                at = int(shard)
                held.append(part)
        if held:
            yield flush(held, at)

    return as_longs(ordered.mapInPandas(run, PACKED), "doc_id")


def pack_documents(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, shard_docs: int = 20_000) -> DataFrame:
    """Tokenise, cut and pack every document."""
    return pack(pieces(docs, window, end_id, tokenizer), docs.count(), window, shard_docs)
