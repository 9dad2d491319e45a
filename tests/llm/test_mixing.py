import math

import pytest

from netloom.llm import mixing


def water(sizes, mix):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if t[s] > mix.most * sizes[s]]
        if not over:
            return t | capped
        capped |= {s: mix.most * sizes[s] for s in over}


def test_mix(spark):
    docs = []
    for i in range(600):
        source = "big" if i % 3 == 0 else ["a", "B", "é", None, "tiny"][i % 5] if i % 40 else "rare"
        docs.append((i, None if i % 97 == 0 else "w " * (i % 50), source, 1, 2))
    docs += [docs[7], docs[8]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int, key int")
    mix = mixing.Mix(bucket_docs=50)
    got = mixing.mixed(df, mix).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(df, mix).collect()), key=repr)
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s, *_ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes, mix)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9) for r in mine)
        assert want[s] - 1 <= sum(r.taken for r in mine) <= want[s] + 1e-6
        assert all(r.taken <= 3 * r.size for r in mine)
        epochs = {r.taken // r.size for r in mine if r.size}
        assert max(epochs) - min(epochs) <= 1  # complete epochs first
    rows = mixing.mixed_documents(df, mix)
    assert rows.columns == df.columns
    words = {}
    for r in rows.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in taken.items() if v} == words


def test_quality_weight_moves_the_draw(spark):
    docs = [(i, ("good " if i % 2 else "b#d% ") * 10, "x" if i < 400 else "y") for i in range(800)]
    got = mixing.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string"), mixing.Mix(weights=(1.0, 3.0))).where("source = 'x'").collect()
    good, bad = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "a b", "s")]])
def test_edges(spark, rows):
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert all(r.taken == min(r.target, 3 * r.size) for r in got)


def test_rows_without_an_id_of_their_own_keep_their_texts(spark):
    docs = [(None, f"null{i} " * 9, "s", i) for i in range(6)] + [(1, "one a b", "s", 0), (1, "one c d", "s", 0), (2, "two", "s", 0), (2, "two", "s", 0), (2, "two", "s", 1), (3, "three x", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, take int").repartition(3)
    got = mixing.mixed_documents(df, mixing.Mix(weights=(1.0,)))
    assert got.columns == df.columns
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert {r[1].split()[0] for r in rows if r[0] is None} == {f"null{i}" for i in range(6)}
    assert {r[1] for r in rows if r[0] == 1} == {"one a b", "one c d"}
    assert [r[3] for r in rows if r[0] == 2] == [0, 0, 1]
    taken = sum(r.taken for r in mixing.mixed(df, mixing.Mix(weights=(1.0,))).collect())
    assert sum(len(r[1].split()) for r in rows) == taken
    assert sorted(map(tuple, mixing.mixed_documents(df.repartition(2), mixing.Mix(weights=(1.0,))).collect()), key=repr) == rows


def test_edge_is_cut_to_the_word_whatever_the_weights(spark):
    docs = [(i, ("#w " if i % 2 else "word ") * (1 + i % 7), f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mixed(df, mixing.Mix(bucket_docs=20)).collect()}
    cands = {r.doc_id: r.key for r in mixing.candidates(df).collect()}
    for s in ("s0", "s1", "s2"):  # by hand: sort, then fill
        mine = sorted((r for r in got.values() if r.source == s), key=lambda r: cands[r.doc_id])
        left = math.floor(mine[0].target - mine[0].epochs * mine[0].source_size) if mine[0].epochs < 3 else 0
        for r in mine:
            assert r.part == min(r.size, left)
            left -= r.part


def test_rows_that_tie_share_evenly(spark):
    df = spark.createDataFrame([(None, "a b c", "x")] * 7 + [(1, "w " * 40, "y")], "doc_id long, text string, source string")
    got = mixing.mixed(df, mixing.Mix(weights=(1.0, 3.0))).where("source = 'x'").collect()
    assert len({r.taken for r in got}) == 1 and got[0].target - 7 < sum(r.taken for r in got) <= got[0].target
