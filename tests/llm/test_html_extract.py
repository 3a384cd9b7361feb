import random
import re

import pytest

from loomwright.llm import html_extract
from loomwright.llm.html_extract import OTHER, extract, main_text, page_lines, shared_lines


def texts(page):
    return main_text(page_lines(page), [])


def test_blocks_and_references():
    page = "<article><h1>A &amp;amp; B</h1><p>one <b>two</b>three<br>four\n\t five&nbsp;six<p>seven<!-- no <p> --><ul><li>x<li>y &lt;z&gt;</ul>tail</article>"
    assert texts(page) == "A &amp; B\none twothree four five six\nseven\nx\ny <z>\ntail"
    assert texts("") == "" and texts("plain  text") == "plain text" and texts("<p>a<p>b") == "a\nb"
    assert texts('<article><p title="a>b" data-x=\'<p>\'>ok</p><script>var t="</p>";</script><style>p{}</style></article>') == "ok"
    assert texts("<article><p>open <b>bold</article><p>outside") == "open bold"


def test_parts_that_are_no_article():
    page = """<!DOCTYPE html><html><head><title>t</title></head><body class="no-sidebar"><header>Site</header><nav><ul><li><a href=/>m</a></li></ul></nav>
    <div class="cookie-notice">we use cookies</div><main><article><header><h1>Title</h1></header><p>Body <span>text</span>.</p><aside>side</aside>
    <div class='share-buttons'>share</div><form><p>mail</p></form><div class="ad">buy</div><p hidden>no</p><section id="comments"><p>first!</p></section><footer>by</footer></article></main>
    <div class="sidebar"><p>links</p></div><footer>&copy; x</footer></body></html>"""
    assert texts(page) == "Title\nBody text."
    assert texts('<article><p>a <span class="ad">b <span>c</span> d</span> e</p></article>') == "a e"
    assert texts('<body><div class="menu">m</div><div id="content"><p>Text</p></div><div role="contentinfo">c</div></body>') == "Text"


def test_nothing_of_an_article_is_lost():
    assert texts('<article><p>see <a class="related">the other</a> text</p><p class="notice-of-motion">moved</p></article>') == "see the other text\nmoved"
    assert texts("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then <svg><title>i</title><text>S</text></svg></p></article>") == "if x=2 then S"
    assert texts("<article><p>one</p><script>var x = '<b>';<p>two</p></article>") == "one\ntwo"
    assert texts("<article><p>one</p><textarea>mine</textarea><p>two <custom-tag class='share'>and</custom-tag> on</p></article><p>out") == "one\ntwo and on"
    assert texts('<div id="research-search"><p>Body</p></div>') == "Body"
    assert texts('<div class="layout sidebar-left"><nav>m</nav><div id="content"><p>Body of it</p></div><div class="sidebar">links</div></div>') == "Body of it"
    assert texts('<div class="menu"><p>all there is</p></div>') == "all there is"
    assert texts('<article><h2>Story</h2><p>told</p></article><article class="teaser"><p>another</p></article><section class="comments"><article class="comment"><p>first!</p></article></section>') == "Story\ntold"
    assert texts('<article class="post category-advert"><p>x</p></article>') == "x"


def test_alignment_decides_between_articles():
    """A second article that neighbours repeat as it is goes; one with lines of its own stays."""
    page = "<article><h2>Mine</h2><p>own</p><p>shared</p></article><article><h2>Top story</h2><p>read it</p></article>"
    other = page_lines("<article><p>else</p><p>shared</p></article><article><h2>Top story</h2><p>read it</p></article>")[0]
    assert main_text(page_lines(page), [other, other]) == "Mine\nown\nshared"
    assert main_text(page_lines(page), [["x"]]) == "Mine\nown\nshared\nTop story\nread it"


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_alignment_against_the_table():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(15))] for _ in range(2))
        at = shared_lines(a, b)
        assert len(at) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in sorted(at))


def test_alignment_of_long_pages_by_halves(monkeypatch):
    monkeypatch.setattr(html_extract, "_ROW_BITS", 16)
    test_alignment_against_the_table()


def test_differencing_between_nearest_urls(spark):
    def page(i, own):
        return f"<body><p>Home | About</p><p>Breaking: read this</p><div>{own}</div><p>All rights reserved</p></body>"

    rows = [(i, f"https://a.example/{'news' if i % 2 else 'blog'}/{i}", page(i, f"<p>story {i}</p><p>more of {i}</p>")) for i in range(20)]
    rows += [(100, "https://b.example/x", "<p>same</p><p>text</p>"), (101, "https://b.example/y", "<p>same</p><p>text</p>"), (102, None, page(1, "x")), (103, "nonsense", None), (104, "https://c.example/only", page(0, "<p>alone</p>")), (None, "https://d.example/", "<article>z</article>")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string")
    got = {x.page_id: (x.url, x.text, x.n_chars) for x in extract(df).collect()}
    for i in range(20):
        assert got[i] == (rows[i][1], f"story {i}\nmore of {i}", len(f"story {i}\nmore of {i}"))
    assert got[100][1] == got[101][1] == "same\ntext" and got[103] == ("nonsense", "", 0) and got[None][1] == "z"
    assert got[104][1].split("\n") == ["Home | About", "Breaking: read this", "alone", "All rights reserved"]
    assert extract(df.limit(0)).count() == 0 and len(got) == len(rows)


def brute(rows):
    """Whole hosts in one list: two nearest of the four pages around, the table's alignment, line by line."""
    parsed = []
    for i, url, page in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", url or "")
        parsed.append(((m[1].lower() if m else "").encode(), (m[2] if m else "").encode(), i, *page_lines(page or "")))
    parsed.sort()
    out = {}
    for at, (h, p, i, lines, kinds) in enumerate(parsed):
        around = sorted((abs(d), -d, at + d) for d in (-2, -1, 1, 2) if 0 <= at + d < len(parsed) and parsed[at + d][0] == h != b"")
        around = sorted((parsed[x] for _, d, x in sorted(around, key=lambda y: (y[0], -y[1]))), key=lambda x: -html_extract._common(p.decode(), x[1].decode()))[:2]
        gone = set.intersection(*[shared_lines(lines, x[3]) for x in around]) if around else set()
        if any(k > 0 for k in kinds):
            own = {k for n, k in enumerate(kinds) if k > 0 and n not in gone} or {k for k in kinds if k > 0}
            keep = [n for n, k in enumerate(kinds) if k in own]
        else:
            plain = [n for n, k in enumerate(kinds) if k != OTHER]
            keep = [n for n in plain if n not in gone] or plain
        out[i] = "\n".join(lines[n] for n in keep)
    return out


def site(n=160):
    """Pages of three hosts, one of them with half of all; with and without containers, copies, templates by section."""
    r = random.Random(3)
    rows = []
    for i in range(n):
        host, section = r.choice(["big.example", "big.example", "b.example", "c.example"]), r.choice(["news", "blog", "Äh"])
        own = [f"line {r.randrange(900)} of {i // 2 if r.random() < 0.2 else i}" for _ in range(r.randrange(1, 6))]
        top, foot = [f"{host} {section} {k}" for k in range(r.randrange(5))], [f"© {host}"]
        body = "".join(f"<p>{x}</p>" for x in own)
        page = "".join(f"<div>{x}</div>" for x in top) + (f"<article>{body}</article>" if r.random() < 0.3 else body) + "".join(f"<p>{x}</p>" for x in foot)
        rows.append((i, f"https://{host}/{section}/{r.randrange(60)}", page))
    return rows


@pytest.mark.parametrize("partitions", [1, 2, 7, 50])
def test_against_brute_force_in_any_number_of_partitions(spark, partitions):
    rows = site() + [(1000, None, "<p>a"), (1001, "https://only.example/", "<p>a<p>b"), (1002, "nonsense", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    was = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[1], "false")
        spark.conf.set(names[0], str(partitions))
        assert {x.page_id: x.text for x in extract(df).collect()} == brute(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_long_template_and_partition_edges(spark):
    """Ten unmarked template blocks around three of the page's own, two sections, copies; a page or two in each partition."""
    template = {s: [f"{s} line {k}" for k in range(10)] for s in ("news", "blog")}
    html = lambda s, own: "".join(f"<p>{x}</p>" for x in [*template[s][:5], *own, *template[s][5:]])
    rows, want = [], {}
    for i in range(12):
        own = [f"own {i // 2 if i < 2 else i} {k}" for k in range(3)]  # pages 0 and 1 are copies
        s = "news" if i >= 6 else "blog"
        rows.append((i, f"https://a.example/{s}/{i:02}", html(s, own)))
        want[i] = "\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 3, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {x.page_id: x.text for x in extract(df).collect()} == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(
    "inside",
    [
        '<p class="notice">Important body</p>', '<p class="share">Share price rose</p>', '<section id="social-science"><p>Of people</p></section>', '<section id="search-algorithms"><p>Trees</p></section>', '<section class="comment-policy"><p>Be kind</p></section>',
        '<div class="ad-astra">To the stars</div>', '<ul class="menu"><li>Soup of the day</li></ul>', '<figure class="social-graph"><figcaption>Friends</figcaption></figure>', '<div class="alert">Flood expected</div>', '<p class="ad">For sale in 1901</p>',
    ],
)
def test_names_inside_an_article_are_about_its_subject(inside):
    want = re.sub("<[^>]*>", "", inside)
    assert texts(f'<div class="notice">site</div><article><h1>T</h1>{inside}<p>end</p></article>') == f"T\n{want}\nend"
    assert texts(f"<main><h1>T</h1><div>{inside}</div></main>") == f"T\n{want}"


def test_comments_and_buttons_inside_an_article():
    assert texts('<article><p>a</p><ol class="comment-list"><li>b</li></ol><div class="comments"><p>c</p></div><ul><li class="comment">d</li></ul></article>') == "a"
    assert texts("<article><p>press <button>here</button> to go on</p></article>") == "press to go on"


def test_two_articles_none_and_nested():
    assert texts("<article><p>one</p></article><article><p>two</p></article>") == "one\ntwo"
    assert texts('<article><p>one</p><article class="quoted"><p>inner</p></article><p>two</p></article>') == "one\ninner\ntwo"
    assert texts('<main><p>m</p><article><p>a</p></article></main><div class="sidebar">s</div>') == "m\na"
    assert texts('<div class="alert">news</div><div class="story"><p>told</p></div>') == "told"
