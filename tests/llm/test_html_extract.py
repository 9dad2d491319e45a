import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body class="has-sidebar">
<div id="top-menu"><a href="/">Home</a></div><nav><ul><li><a>x</a><li>y</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
%s
<aside>side</aside><div class="comments"><p>Nice post!</p></div><form><label>Mail</label><input name=q></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("body,want", [
    ("<article><header><h1>Title&amp;</h1></header><p>One <b>two</b>\n three<br>four.<p>Five&nbsp;six &eacute;<ul><li>a<li>b</ul></article>", "Title&\nOne two three four.\nFive six é\na\nb"),
    ("<main><div class=post-content><h2>H</h2><div>d1<div>d2</div>d3</div><p><b>open<p>next</div><div class='share-buttons'>tweet</div></main>", "H\nd1\nd2\nd3\nopen\nnext"),
    ("<div><div class='story'><p>" + "long text " * 30 + "</p><p>tail</p></div></div>", ("long text " * 30).strip() + "\ntail"),
    ("<article>a < b and c<d/> &lt;p&gt; &#x41;&#66;</article>", "a < b and c <p> AB"),
    ("<article></article>", ""),
    ("<div>" + "<a href=x>a rather long link text</a> " * 40 + "</div><div class=c7><p>Short story</p><p>Its <a>end</a></p></div>", "Short story\nIts end"),
    ("<article><p>Text</p><div class=adSlot>buy</div><ol class=commentlist><li>me too</ol><p class=commentary>Kept</p></article>", "Text\nKept"),
    ("<article><p>unclosed", "unclosed"),
])
def test_extract(body, want):
    got = H.extract(PAGE % body if body != "<article><p>unclosed" else "<body><nav>n</nav>" + body)
    assert got == want


def test_degenerate():
    assert H.extract(None) == H.extract("") == H.extract("<>") .replace("<>", "") == ""
    assert H.extract("plain  text") == "plain text"
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert H.extract(deep) == "core"
    assert len(H.extract("<article>" + "<p>" + "w " * 200_000 + "</article>")) == 399_999


def site(i):
    return f"""<body><div><div>Your daily paper</div><div>Weather for today is mild and the sea is calm, with a light wind from the west</div></div>
<div><p>Story {i} {"abc " * (40 + i)}</p><p>Subscribe to read every story we have</p><p>More {i * 7} {"xyz " * 30}</p></div><div>All rights reserved by the daily paper</div></body>"""


def test_wrapper_finds_slots_and_template():
    w = H.induce([site(i) for i in range(5)])
    got = H.extract(site(9), w)
    assert got.split("\n") == [("Story 9 " + "abc " * 49).strip(), ("More 63 " + "xyz " * 30).strip()]
    copies = H.induce([site(1)] * 4)
    assert "Story 1" in H.extract(site(1), copies)


def test_tree_matching_is_maximal():
    a, b = H.parse("<ul><li>1<li>2<li>3</ul><p>x"), H.parse("<ul><li>2<li>3</ul><div>y</div><p>x")
    assert len(H.tree_match(a, b)) == 1 + 1 + 2 + 1


class T:
    def __init__(self, sign, kids=()):
        self.sign, self.kids = sign, list(kids)
        self.key = hash((sign, *(c.key for c in self.kids)))


def most_pairs(a, b):
    """Brute force: every order-keeping choice of pairs of children."""
    if a.sign != b.sign:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max([best(xs[1:], ys)] + [most_pairs(xs[0], ys[j]) + best(xs[1:], ys[j + 1 :]) for j in range(len(ys)) if xs[0].sign == ys[j].sign])

    return 1 + best(a.kids, b.kids)


trees = st.recursive(st.builds(T, st.sampled_from("ab")), lambda kids: st.builds(T, st.sampled_from("ab"), st.lists(kids, max_size=4)), max_leaves=10)


@settings(max_examples=300, deadline=None)
@given(trees, trees)
def test_tree_matching_against_brute_force(a, b):
    a.sign = b.sign = "root"
    pairs = H.tree_match(a, b)
    assert len(pairs) == most_pairs(a, b)
    assert all(x.sign == y.sign for x, y in pairs)
    assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    up = {id(c): t for tree in (a, b) for t in H.preorder(tree) for c in t.kids}
    order = {id(t): i for tree in (a, b) for i, t in enumerate(H.preorder(tree))}
    to = {id(x): y for x, y in pairs}
    for x, y in pairs:
        if x is not a:
            assert to[id(up[id(x)])] is up[id(y)]
    for x, y in pairs:
        for v, w in pairs:
            assert (order[id(x)] < order[id(v)]) == (order[id(y)] < order[id(w)])


def bare(i, copies=False):
    """Furniture in plain elements, without a telling name: menu, notice and
    legal line are the same everywhere, teaser and date differ everywhere."""
    r = random.Random(3 if copies else i)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    story = [say(r.randint(20, 60)) for _ in range(r.randint(1, 9))]
    body = "".join(f"<p>{p}</p>" if k % 3 else f"<h3>{p}</h3><ul><li>{p} x<li>{p} y</ul>" for k, p in enumerate(story))
    want = [x for k, p in enumerate(story) for x in ([p] if k % 3 else [p, f"{p} x", f"{p} y"])]
    menu = "<div><ul><li>Home page of the paper<li>All about the harbour and its ships<li>Weather</ul></div>"
    notice = "<div><p>We would like to tell you that this site keeps what you read</p></div>" if i % 3 else ""
    return f"<html><body>{menu}{notice}<div><span>Read {i} next: {say(4)}</span></div><div><div>{body}<p>Support the paper with a small sum every month</p></div></div><div>Printed by the press of the town, all rights reserved</div></body></html>", "\n".join(want)


def test_the_wrapper_decides_where_names_say_nothing(spark):
    pages = [bare(i) for i in range(60)]
    df = spark.createDataFrame([(i, f"http://bare.example/{i}", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert all(got[i] == want for i, (_, want) in enumerate(pages))
    changed = sum(H.extract(h) != want for h, want in pages)
    print(f"the wrapper changes {changed} of {len(pages)} pages")
    assert changed == len(pages)
    in_memory = H.induce([h for h, _ in pages])
    assert all(H.extract(h, in_memory) == want for h, want in pages)
    assert {H.mark(n, t) for n, t in H.Page(pages[1][0]).texts if t.startswith(("Home", "We would", "Printed", "Support"))} <= {m for _, m in in_memory.template}


def test_copies_of_an_article_are_no_template(spark):
    df = spark.createDataFrame([(i, f"http://copy.example/{i}", bare(i, copies=i % 5 > 0)[0]) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert all(got[i] == bare(i, copies=i % 5 > 0)[1] for i in range(40))


@pytest.mark.parametrize("source,within", [("text<hr>" * 100_000, 5), ('<a "' * 250_000, 5), ("<div>" * 100_000 + "x", 15), ("<p>ab<div>c</div>" * 50_000, 10), ("<div>" * 50_000 + "</span>" * 100_000, 10), ("<nav>menu</nav>" * 60_000, 5)])
def test_long_pages_take_linear_time(source, within):
    began = time.time()
    H.extract(source)
    w = H.induce([source, source + "<p>x y", source + "<p>z" * 3, "<p>w"])
    H.extract(source + "q", w)
    assert time.time() - began < 3 * within


def test_furniture_is_furniture_at_any_depth():
    for depth in (10, 160, 5000):
        assert H.extract("<article>" + "<div>" * depth + "<nav>menu menu</nav><p>core</p>") == "core"


def test_main_text(spark):
    rows = [(i, f"http://site.example/{i}", site(i), "s") for i in range(30)] + [(100, None, "<article>a b</article>", "s"), (101, "http://x/", None, "s"), (102, "", "", "s"), (3, "http://site.example/3", site(3), "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[100].text == "a b" and by[101].text == by[102].text == "" and by[102].n_chars == 0
    for i in range(30):
        assert by[i].text == ("Story %d " % i + "abc " * (40 + i)).strip() + "\n" + (f"More {i * 7} " + "xyz " * 30).strip()
        assert by[i].n_chars == len(by[i].text)
    assert H.main_text(df.where("false")).count() == 0


def layouts(i):
    """Two layouts of one host: every tenth page is of the second; a notice on
    most pages of each, a heading on a few; lengths vary."""
    notice = "<p>This site is read by a great many people every day</p>" if i % 7 else ""
    head = "<h2>Notes from the harbour</h2>" if i % 5 == 0 else ""
    story = f"{head}<p>Story {i} {'abc ' * (40 + i % 30)}</p><p>More {i} {'xyz ' * 30}</p>"
    if i % 10 == 3:
        return f"<body><div class=old><table><tr><td>{story}<p>Printed by the old press of our town{' since long ago' * 3}</p>{notice}</td></tr></table></div></body>"
    return f"<body><div class=new><div class=story>{story}{notice}</div><div>Weather is mild</div></div></body>"


def test_wrappers_count_all_pages_of_every_layout(spark):
    n = 400
    df = spark.createDataFrame([(i, f"http://site.example/{i}", layouts(i)) for i in range(n)] + [(n, "http://site.example/again", layouts(3))], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    for i in range(n):
        want = (["Notes from the harbour"] if i % 5 == 0 else []) + [f"Story {i} {'abc ' * (40 + i % 30)}".strip(), f"More {i} {'xyz ' * 30}".strip()]
        assert got[i].split("\n") == want, i
    assert got[n] == got[3]


def test_sentences_that_articles_share_stay(spark):
    """Three pages, and sixty: a quoted sentence in some articles is no template,
    a notice among all of them is."""
    say = lambda i, n: " ".join(f"word{i}x{j}" for j in range(n))
    def page(i, quote, notice):
        body = f"<h1>{say(i, 4)}</h1><p>{say(i + 100, 30)}</p>" + (f"<p>{quote}</p>" if quote else "") + (f"<p>{notice}</p>" if notice else "") + f"<p>{say(i + 200, 30)}</p>"
        return f"<html><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><article>{body}</article><footer>All rights reserved</footer></body></html>"

    quote, notice = "As the saying goes, every cloud has a silver lining", "Support the paper with a small sum"
    few = [(i, "http://few.org/", page(i, quote if i < 2 else None, None)) for i in range(3)]
    many = [(100 + i, "http://many.org/", page(100 + i, None if i % 3 else quote, notice)) for i in range(60)]
    rows = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(few + many, "page_id long, url string, html string")).collect()}
    assert [quote in rows[i] for i in range(3)] == [True, True, False]
    assert all((quote in rows[100 + i]) == (i % 3 == 0) and notice not in rows[100 + i] for i in range(60))
    assert all(say(i, 4) in rows[i] and "rights" not in rows[i] and "Home" not in rows[i] for i in rows)


def test_pages_of_the_given_table_keep_their_lines(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    alone = {r.page_id: H.extract(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert got == alone
