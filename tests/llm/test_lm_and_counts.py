import json
import math
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import lm_scoring, token_counts


def greedy(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        v = first if at == 0 else inner
        to = next((e for e in range(len(word), at, -1) if word[at:e] in v), None)
        if to is None:
            return 1
        n, at = n + 1, to
    return n


piece = st.text("abc", min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.sets(piece, max_size=12), st.one_of(st.none(), st.sets(piece, max_size=12)), st.text("abcd", max_size=14))
def test_automaton_is_greedy_longest_match(first, inner, word):
    assert token_counts.Automaton(first, inner).count(word) == greedy(word, first, first if inner is None else inner)


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    letters = token_counts.byte_letters()
    texts = [None, "", "Hello, wörld…  x", "a " * 50_000, "the thinonat\n\nhetiin 123"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_parts int")
    for r in token_counts.token_counts(df).collect():
        parts = token_counts.PARTS.findall(texts[r.doc_id] or "")
        assert r.n_parts == len(parts)
        assert r.n_pieces == sum(greedy(p.encode().decode("latin-1").translate(letters), vocab, vocab) for p in parts)
    assert token_counts.token_counts(df.where("false")).count() == 0


def lm_brute(rows, good, smooth, v):
    """(tokens, background loss, score) by row, from counts of all words and pairs."""
    split = [(t or "").lower().split() for _, t in rows]
    bigrams = [list(zip(["<s>", *ws], [*ws, "</s>"], strict=True)) if ws else [] for ws in split]
    target = [d in good for d, _ in rows]

    def model(which):
        pairs, contexts = Counter(), Counter()
        for i in which:
            pairs.update(bigrams[i])
            contexts.update(a for a, _ in bigrams[i])
        return pairs, contexts

    every, of_target = range(len(rows)), [i for i in range(len(rows)) if target[i]]
    background, good_model = model(every), model(of_target)
    n_b, n_t = sum(background[1].values()), sum(good_model[1].values())
    out = []
    for i in every:
        own = model([i])

        def loss(m, scale, without):
            pairs, contexts = m
            return -sum(math.log((scale * (pairs[p] - without * own[0][p]) + smooth) / (scale * (contexts[p[0]] - without * own[1][p[0]]) + smooth * v)) for p in bigrams[i]) / len(bigrams[i])

        if not bigrams[i]:
            out.append((rows[i][0], 0, None, None))
            continue
        b = loss(background, n_t / n_b if n_t else 1.0, 1)
        out.append((rows[i][0], len(bigrams[i]), b, loss(good_model, 1.0, target[i]) - b))
    return out


def lm_corpus():
    # many words that occur once or twice; what tells the target apart is rare
    docs = [(i, " ".join(f"w{(i * 353 + j * j) % 40_000}" for j in range(300)) + (" rare sign here" if i in (3, 5) else "") + " the end" * (400 if i == 7 else 1)) for i in range(300)]
    docs += [(1000, None), (1001, " \n"), (1002, "Alone"), (1003, docs[5][1]), (None, docs[5][1]), (3, docs[3][1]), (None, None)]
    return docs, [(i, int(i < 20)) for i in range(100)] + [(None, 1), (3, 1), (4, None)]


@pytest.mark.parametrize("cfg,with_labels", [(lm_scoring.Models(), True), (lm_scoring.Models(bucket_words=5000, chunk=20_000, most_hot=50, held_words=500), True), (lm_scoring.Models(most_hot=0), False)])
def test_lm_scores_against_brute_force(spark, cfg, with_labels):
    docs, labels = lm_corpus()
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    known = spark.createDataFrame(labels if with_labels else [], "doc_id long, quality int")
    got = sorted(map(tuple, lm_scoring.scores(df, known, cfg).collect()), key=repr)
    rows = lm_scoring.marked(df, known)
    v = lm_scoring.counted(rows, lm_scoring.frequent(rows, cfg), cfg).words
    assert v == len({w for _, t in docs for w in (t or "").lower().split()}) + 1
    want = sorted(lm_brute(docs, set(range(20)) if with_labels else set(), cfg.smooth, v), key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    by = lambda rows: sorted(rows, key=lambda x: (str(x[0]), x[1], x[2] or 0))
    for g, w in zip(by(got), by(want), strict=True):
        assert (g[3] is None) == (w[3] is None)
        if w[2] is not None:
            assert math.isclose(g[2], w[2], rel_tol=1e-5) and math.isclose(g[3], w[3], rel_tol=1e-4, abs_tol=2e-5)
    assert lm_scoring.scores(df.where("false"), known, cfg).count() == 0


def test_lm_prefers_what_reads_like_the_target(spark):
    docs = [(i, ("good words about gardens " if i % 2 else "bad noise in traffic ") * 5) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in lm_scoring.scores(df, labels).collect()}
    assert all(got[i] < 0 for i in range(1, 40, 2)) and all(got[i] > 0 for i in range(0, 40, 2))
