from collections import Counter
from itertools import permutations

from netloom.llm import filter_audit

FAILS = {
    "A": lambda t, ws: len(ws) < 50,
    "B": lambda t, ws: 100 * len(set(ws)) < 65 * len(ws),
    "C": lambda t, ws: 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
    "D": lambda t, ws: any(c in "#$%&*|" for c in t),
}


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, s in docs:
        ws = [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = {f for f, g in FAILS.items() if g(t or "", ws)}
        if d is not None and d > least[t or ""]:
            fails.add("E")
        rows.append((s or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, removed = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here, gone = [r for r in left if f in r[1]], [r for r in mine if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[f] += len(here)
                out[part, order, step] = [len(left), len(here), len(gone) - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [(i, f"{LONG} {i % 7}", "web") for i in range(30)]
DOCS += [(100 + i, text, s) for i, (text, s) in enumerate([
    (LONG, None), (LONG, ""), (LONG + " #", "web"), ("A" * 9 + LONG, "web"), ("same " * 80, "b"), ("same " * 80, "b"), ("SAME $ " * 80, "c.d"),
    (None, "web"), ("", "web"), ("\t\n ", None), ("x" * 20_000, "b"),
])]
DOCS += [(None, LONG, "web"), (None, None, None), (2**60 + 1, LONG, "b"), (2**60 + 3, LONG, "b"), (2**60 + 3, LONG, "b"), (100, LONG, None)]
LABELS = [(0, 1, 0), (1, 0, 1), (8, 1, 1), (100, None, 1), (100, 1, None), (105, 1, 1), (2**60 + 3, 1, 0), (None, 1, 1), (999, 1, 1)]


def test_equals_applying_the_filters_in_every_order(spark):
    docs = spark.createDataFrame([(*r, 1, "n") for r in DOCS], "doc_id long, text string, source string, n int, mask string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows) and got == brute(DOCS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x", "s")], docs.schema), labels)
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0
