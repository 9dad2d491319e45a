import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from netloom.llm import alignment
from netloom.llm.packing import byte_letters

SCHEMA = "doc_id long, text string, block string, n_a string"


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {chr(c): bytes([x]) for x, c in byte_letters().items()}

    def both(text):
        """[(id, start, stop)] under A and B, by whole-text encoding."""
        out = []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        said_a = [b"".join(back[c] for c in a.id_to_token(i)) for i in ids_a]
        said_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        for ids, said in ((ids_a, said_a), (ids_b, said_b)):
            if not text or b"".join(said) != (" " + text).encode():
                return [], []
            at, tokens = 0, []
            for i, s in zip(ids, said, strict=True):
                tokens.append((i, at, at := at + len(s)))
            out.append(tokens)
        return out

    return both


def brute(rows, both):
    per_doc, held = [], Counter()
    for _, text in rows:
        a, b = both(text or "")
        pairs = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(t[0]) for t in side if lo < t[2] <= c) for side in (a, b)))
            lo = c
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        per_doc.append((len(a), len(b), len(groups), pairs, digest))
        held.update(set(pairs))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (d, na, nb, ng, len(ps), sum(held[p] == most[p[0]] for p in ps), sum(held[p] for p in ps), digest)
        for (d, _), (na, nb, ng, ps, digest) in zip(rows, per_doc, strict=True)
    ]


def texts():
    dealer = random.Random(5)
    some = ["the", "Überraschung", "naïve", "l'été", "<|endoftext|>", "<s>", "12345", "don't", "  ", "\n\n", "\t", "日本語", "🙂🙃", "x_y", "¿qué?", "é", " ", "﻿", "\x00", "</s>", "<0x41>"]
    return [dealer.choice(["", " "]).join(dealer.choices(some, k=dealer.randint(1, 40))) for _ in range(60)]


ROWS = [(i, t) for i, t in enumerate(texts())]
ROWS += [(None, "the same text"), (2**53 + 1, "the same text"), (2**60 + 3, "the same text"), (2**60 + 3, "the same text")]
ROWS += [(70, None), (71, ""), (72, "a ▁ b"), (73, " "), (74, "word " * 3000), (75, "x" * 500), (76, " led by a space ")]


@pytest.mark.parametrize(("block", "slice_"), [(4_000_000, 500_000), (300, 7)])
def test_equals_pairwise_overlaps(spark, whole, monkeypatch, block, slice_):
    monkeypatch.setattr(alignment.Aligner, "SLICE", slice_)
    rows = ROWS if block > 300 else [r for r in ROWS if r[0] != 74]
    docs = spark.createDataFrame([(*r, "b", "n") for r in rows], SCHEMA).repartition(3)
    df = alignment.align(docs, block_bytes=block, salts=3)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(brute(rows, whole), key=str)


def test_slices_keep_a_document_together(whole):
    aligner = alignment.Aligner(*alignment._paths(None, None))
    texts_ = [t for _, t in ROWS]
    one = aligner.block(texts_)
    aligner.SLICE = 5
    for name, value in aligner.block(texts_).items():
        assert list(value) == list(one[name]), name


def test_counts_of_pairs_are_documents(spark, whole):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS[:20]], "doc_id long, text string").repartition(4)
    aligned = alignment.blocks(docs, block_bytes=200)
    got = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.pair_counts(aligned, 32_000, salts=4).collect()}
    held = Counter()
    for _, t in ROWS[:20]:
        a, b = whole(t)
        held.update({(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]})
    assert {p: n for p, (n, _) in got.items()} == held
    assert all(best == (n == max(m for (x, _), m in held.items() if x == p[0])) for p, (n, best) in got.items())


def test_numbers_survive_packing():
    import numpy as np

    x = np.array([0, 1, 255, 256, 70_000, 2**31], np.int64)
    assert alignment.unpacked(alignment.packed(x)).tolist() == x.tolist()
    assert alignment.unpacked(alignment.packed(x[:0])).tolist() == []


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
