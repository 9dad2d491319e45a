"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie.  A node without the wanted child fails over: its
failure link leads to the node that spells what is left after the longest
pieces have been taken off, and how many pieces those are is precomputed.  So
a word of n letters takes O(n) steps, and pieces are counted without being
built.

Defined cases: a null or empty text has no words and no pieces; a word that
the vocabulary cannot cover counts as one unknown piece; repeated rows are
counted alike; whole texts are counted however long; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.packing import PARTS, byte_letters


class Automaton:
    """Trie with failure links. ``inner``: pieces that continue a word, the same
    as the first ones if not given."""

    def __init__(self, pieces: Iterable[str], inner: Iterable[str] | None = None):
        self.next: list[dict[str, int]] = [{}]
        end = [False]

        def insert(root: int, words: Iterable[str]) -> None:
            for w in words:
                at = root
                for c in w:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        end.append(False)
                    at = to
                end[at] = end[at] or at != root

        insert(0, pieces)
        self.inner = 0
        if inner is not None:
            self.inner = len(self.next)
            self.next.append({})
            end.append(False)
            insert(self.inner, inner)
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        todo = deque(dict.fromkeys((0, self.inner)))
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                if end[v]:
                    self.fail[v], self.popped[v] = self.inner, 1
                else:
                    n, z = self.popped[u], self.fail[u]
                    while z >= 0 and c not in self.next[z]:
                        n, z = n + self.popped[z], self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
                todo.append(v)

    def count(self, word: str) -> int:
        """Pieces of a word; 1 for one that can't be covered."""
        next_, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for c in word:
            while (to := next_[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at not in (0, self.inner):
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class Counts(dict):
    """Part of a text -> its pieces; holds at most ``most`` parts."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.automaton, self.letters, self.most = Automaton(vocabulary), byte_letters(), most

    def __missing__(self, part: str) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[part] = self.automaton.count(part.encode().decode("latin-1").translate(self.letters))
        return out


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_parts, n_pieces of every document.

    ``vocabulary``: a byte-level tokenizer file; it covers every byte, so no
    word is unknown.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        counts = Counts(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        for texts in batches:
            rows = []
            for t in texts:
                parts = PARTS.findall(t) if isinstance(t, str) else []
                rows.append((len(parts), sum(map(counts.__getitem__, parts))))
            yield pd.DataFrame(rows, columns=["n_parts", "n_pieces"])

    counted = F.pandas_udf(run, "n_parts long, n_pieces long")(F.col("text"))
    return docs.select("doc_id", counted.alias("c")).select("doc_id", "c.n_parts", "c.n_pieces")
