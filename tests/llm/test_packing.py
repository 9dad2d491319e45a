import random
import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netloom.llm import packing

TK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(lengths, window):
    room, out = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            r, i = min(fits)
        else:
            i = len(room)
            room.append(window)
        out.append(room[i])
        room[i] -= n
    return out, len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_matches_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    got = packing.best_fit_decreasing(lengths, 64)
    rooms, n = brute(lengths, 64)
    assert [64 - o for _, o in got] == rooms
    assert len({s for s, _ in got}) == n


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é'sdtlrv 12\n\t!.*…中œß\x1c　_|<>²", max_size=40))
def test_parts_give_the_tokenizers_ids(text):
    assert packing.tokenised()(text) == array("I", TK.encode(text, add_special_tokens=False).ids).tobytes()


def test_special_token_and_full_cache():
    of = packing.IdBytes(public_tokenizers.path("byte_bpe_50k.json"), most=3).of
    text = "one two <|endoftext|> three four five, six  seven"
    assert of(text) == array("I", TK.encode(text, add_special_tokens=False).ids).tobytes()


def test_pack_documents(spark):
    random.seed(1)
    texts = [None, "", "x", "word " * 5000, "word " * 5000] + ["some text " * random.randint(1, 300) for _ in range(60)]
    docs = [(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "null id", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length long")
    rows = packing.pack_documents(df, window=256, shard_docs=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = TK.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted(by[i], key=lambda r: r.start)
        if i == 3:
            assert len(got) == 2 * -(-len(ids) // 256)
            continue
        assert [r.start for r in got] == [k * 256 for k in range(len(got))]
        assert sum(r.length for r in got) == len(ids) and {r.doc_tokens for r in got} == {len(ids)}
        for r in got:
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df).count() == 0
    with pytest.raises(Exception):
        packing.pack_documents(df.drop("text")).count()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\xa0", "\x85", "\u2003", "\n", "a", " word", "'s", "12", "<|", "|>", "é", "!"]), max_size=12))
def test_special_tokens_give_the_tokenizers_ids(pieces):
    text = "".join(pieces)
    assert list(array("I", special_bytes.of(text))) == special_tokenizer.encode(text, add_special_tokens=False).ids


special_path = public_tokenizers.path("byte_bpe_50k.json")
special_bytes, special_tokenizer = packing.IdBytes(special_path), Tokenizer.from_file(special_path)
