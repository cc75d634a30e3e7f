"""Top products against brute force; main text of hand-made pages."""

import random

import numpy as np
import pytest

from memgov.llm import metric_tree, wrappers


def brute(rows, every, k):
    usable = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows
              if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max([len(v) for _, v in usable], default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = []
    for at, (i, v) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = sorted((-int(v @ w), j is None, j or 0) for other, (j, w) in enumerate(usable) if other != at)[:k]
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf", [3, 256])
def test_top_products_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(metric_tree, "LEAF", leaf)
    monkeypatch.setattr(metric_tree, "SHARD", 40)
    monkeypatch.setattr(metric_tree, "SAMPLE", 30)
    monkeypatch.setattr(metric_tree, "BLOCK", 3)
    rng = np.random.default_rng(leaf)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(130)]
    rows += [(200 + i, [0.5] * 6) for i in range(50)]  # equal vectors: one crowded pivot
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (20, rows[20][1]), (None, [0.1] * 6),
             (304, []), (305, [0.25])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = [tuple(r) for r in metric_tree.top_products(frame, 5, 7).collect()]
    assert sorted(got, key=str) == brute(rows, 5, 7)


def test_top_products_of_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert metric_tree.top_products(empty).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert metric_tree.top_products(one).count() == 0
    big = spark.createDataFrame([(0, [3e7, 1.0], 1), (1, [-2e7, 4.0], 1), (2, [1e3, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [r["vec_id"] for r in metric_tree.top_products(big).orderBy("rank").collect()][:1] == [2]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/b">Other</a></ul></nav><div class="ad">Buy {n}</div><div id="cookie-notice">We store {n}</div>
<div class="content-wrap"><{tag}><h1>Title&nbsp;{n} &amp; more</h1><p>First   <b>bold {n}<br>next<p>Second {n}
line</p><ul><li>one {n}<li>two</ul><form>Sign up</form><p>Always the same words here.</p><aside>See also {n}</aside>
<div class="comments"><p>Nice {n}</p></div></{tag}></div><footer>&copy; host {n}</footer></body></html>"""


def page(n, tag="article"):
    return PAGE.format(n=n, tag=tag)


def wanted(n):
    return f"Title {n} & more\nFirst bold {n} next\nSecond {n} line\none {n}"


def rows_of(frame):
    return [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in frame.collect()]


def test_pages(spark):
    host = [(i, f"http://a.example/{i}", page(i)) for i in range(8)]
    plain = [(100 + i, f"https://u@B.example:80/{i}", page(i, "div")) for i in range(8)]
    odd = [(200, "http://c.example/", page(200)), (201, None, page(201)), (202, "http://d.example/", None), (203, "http://e.example/", ""),
           (204, "no url", "bare text &lt;b&gt;"), (None, "http://a.example/9", page(9)), (0, "http://a.example/0", page(0)),
           (205, "http://a.example/cut", page(205).split("line</p>")[0]), (206, "http://f.example/", "<div>" * 3000 + "deep"),
           (207, "http://g.example/", "<html><body><nav>x</nav></body></html>"), (208, "http://a.example/long", page("word " * 50_000))]
    frame = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in host + plain + odd], "page_id long, url string, html string, host string, wrapper string")
    got = rows_of(wrappers.extract_text(frame))
    assert len(got) == len(host + plain + odd) and all(n == len(t) for *_, t, n in got)
    text = {i: t for i, _, t, _ in got}
    for i in range(8):
        # "two" and the last paragraph are the same on every page: template
        assert text[i] == wanted(i) and text[100 + i] == wanted(i)
    alone = wanted(200) + "\ntwo\nAlways the same words here."
    assert text[200] == alone and text[201] == alone.replace("200", "201")
    assert text[202] == text[203] == text[207] == "" and text[204] == "bare text <b>" and text[206] == "deep"
    assert text[205] == "Title 205 & more\nFirst bold 205 next\nSecond 205" and text[208].count("word") == 200_000
    assert rows_of(wrappers.extract_text(frame.limit(0))) == []


def texts_of(spark, pages):
    frame = spark.createDataFrame([(i, url, html) for i, (url, html) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrappers.extract_text(frame).orderBy("page_id").collect()]


def test_copies_are_no_template(spark):
    same = "<html><body><article><p>" + "words that all copies share " * 5 + "</p></article></body></html>"
    assert texts_of(spark, [("http://a.example/", same)] * 6) == [("words that all copies share " * 5).strip()] * 6


def story(n):
    return f"<div><div>Story {n} begins here</div><div>and goes on with {n * 7} words</div>"


def test_only_alignment_tells(spark):
    """No names at all: what is menu and what is content follows from the other pages."""
    pages = [("http://a.example/", f"<body><div><div>Home</div><div>About us</div></div>{story(i)}<div>Read us every day</div></div><div>All rights</div>")
             for i in range(12)]
    wanted = [f"Story {i} begins here\nand goes on with {i * 7} words" for i in range(12)]
    assert texts_of(spark, pages) == wanted
    alone = texts_of(spark, pages[3:4])
    assert alone == [wanted[3] + "\nRead us every day"]  # by the mass of text alone


def test_counts_cover_all_pages_of_a_host(spark):
    """A sentence that 8 of 200 pages share is content; one that 195 share is template."""
    pages = [("http://a.example/", f"<article><p>Body {i}</p><p>{'Shared by few' if i < 8 else f'Own end {i}'}</p>"
              f"<p>{f'Odd {i}' if i % 40 == 0 else 'Shared by most'}</p></article>") for i in range(200)]
    wanted = [f"Body {i}\n" + ("Shared by few" if i < 8 else f"Own end {i}") + (f"\nOdd {i}" if i % 40 == 0 else "") for i in range(200)]
    got = texts_of(spark, pages)
    # The reference is one page. If its own last sentence is odd, those of the others stay.
    assert got == wanted or got == [w if i % 40 == 0 else w + "\nShared by most" for i, w in enumerate(wanted)]


def test_two_layouts_of_a_host(spark):
    one = [("http://a.example/", f"<div class='post'><div>News of the day</div><div>Post {i}</div></div>") for i in range(9)]
    two = [("http://a.example/", f"<div class='shop'><div>Offer {i}</div><div>Price {i}</div><div>Order now</div></div>") for i in range(6)]
    rare = [("http://a.example/", "<section><div>Only once</div></section>")]
    assert texts_of(spark, one + two + rare) == [f"Post {i}" for i in range(9)] + [f"Offer {i}\nPrice {i}" for i in range(6)] + ["Only once"]


def test_deep_and_wide_pages(spark):
    deep = "<article><p>Text</p>" + "<div>" * 250 + "<nav>Menu</nav><p>More</p>" + "</div>" * 250 + "</article>"
    tags = ("b", "i", "em", "u", "s", "q")
    wide = ["<article>" + "".join(f"<p>n{i} <{tags[(i * k) % 6]}>of {k}</{tags[(i * k) % 6]}> {'<br>' * (i % (5 + k))}</p>" for i in range(5000)) + "</article>"
            for k in (1, 2)]
    got = texts_of(spark, [("http://a.example/", deep), ("http://b.example/", "<div>" * 20_000 + "deep"),
                           *(("http://c.example/", w) for w in wide), ("http://b.example/", "<div>" * 19_000 + "less")])
    assert got[0] == "Text\nMore" and got[1] == "deep" and got[4] == "less"
    assert [g.count("\n") for g in got[2:4]] == [4999, 4999] and got[2].startswith("n0 of 1\nn1 of 1\n")


def plain_weight(a, b):
    if a.tag != b.tag:
        return 0
    rows = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + plain_weight(x, y))
    return 1 + rows[-1][-1]


def test_tree_matching_equals_the_plain_recursion():
    rng = np.random.default_rng(6)

    def tree(depth):
        node = wrappers.Node(str(rng.choice(list("abc"))) if depth < 4 else "a")
        node.kids = [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []
        return node

    for _ in range(60):
        a, b = tree(4), tree(4)
        a.tag = b.tag = "a"
        wrappers.settle(a)
        wrappers.settle(b)
        assert wrappers.weight(a, b) == plain_weight(a, b) == len(wrappers.match(a, b))


@pytest.mark.parametrize("seed", [1, 2])
def test_children_far_from_the_diagonal_are_matched(seed):
    """Long lists that share a run far from the diagonal are matched as a whole table matches them."""
    rnd = random.Random(seed)
    shared = "".join("<li>" + "<b>x</b>" * rnd.randrange(1, 9) + "</li>" for _ in range(150))
    own = "<li><i>y</i><u>z</u></li>"
    one, other = wrappers.parse(f"<ol>{shared}{own * 350}</ol>"), wrappers.parse(f"<ol><li><s>q</s></li>" + "<li><q>w</q></li>" * 320 + f"{shared}</ol>")
    xs, ys = one.kids[0].kids, other.kids[0].kids
    own_of = {(x.shape, y.shape): wrappers.weight(x, y) for x in {x.shape: x for x in xs}.values() for y in {y.shape: y for y in ys}.values()}
    row = [0] * (len(ys) + 1)
    for x in xs:
        above, row = row, [0]
        for j, y in enumerate(ys, 1):
            row.append(max(row[-1], above[j], above[j - 1] + own_of[x.shape, y.shape]))
    assert wrappers.weight(one, other) == row[-1] + 2 == len(wrappers.match(one, other))
