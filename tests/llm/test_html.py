"""Operator 4: extraction, boilerplate of hosts, odd pages."""

import random

import numpy as np
import pytest

from quern.llm import html_text
from quern.llm.queries import op4_html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a>Home</a></nav>
<div class="ad">Buy now</div><div class="cookie-notice">Cookies</div><article><h1>Head &amp; line</h1><p>One <b>two</b>
three&nbsp;&#233;.</p><p>Four<br>five</p><form><input><button>Go</button></form><section class="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, row int")
    return {r.page_id: r.text for r in html_text.main_text(df).collect()}


def test_article(spark):
    got = texts(spark, [(1, "http://h.example/1", PAGE), (2, None, None), (3, "", ""), (4, "http://h.example/4", "<p>unclosed <b>bold"), (5, "http://h.example/5", "plain & text &lt;b&gt;")])
    assert got[1] == "Head & line One two three é. Four five"
    assert got[2] == got[3] == "" and got[4] == "unclosed bold" and got[5] == "plain & text <b>"


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SHARD_PAGES", 4)
    rng = random.Random(1)
    own = {k: " ".join(f"w{rng.randrange(9999)}" for _ in range(30)) for k in range(12)}
    menu = "all about this site and its many fine sections"
    rows = [(k, "https://a.example/x", f"<body><div>{menu}</div><div>{own[k]} {menu}</div></body>") for k in own]
    rows += [(100, "https://b.example/x", f"<div>{menu}</div>"), (200, "https://c.example/", f"<div>{own[0]}</div>"), (201, "https://c.example/", f"<div>{own[0]}</div>")]
    got = texts(spark, rows)
    assert all(got[k] == own[k] for k in own)
    assert got[100] == menu and got[200] == got[201] == own[0]


@pytest.mark.parametrize("shard_pages", [4, 1024])
def test_near_equal_pages_without_a_container_keep_their_article(spark, monkeypatch, shard_pages):
    monkeypatch.setattr(html_text, "SHARD_PAGES", shard_pages)
    rng = random.Random(2)
    story = lambda n=60: [f"w{rng.randrange(99999)}" for _ in range(n)]
    own, phrase, menu = story(), "at the end of the day it is", "all about this site and its many fine sections"
    near = {k: " ".join([*own[:k * 5], f"changed{k}", *own[k * 5 + 1 :]]) for k in range(6)}
    rows = [(k, "https://a.example/", f"<body><div class='ad'>{' '.join(story(9))}</div><div>{text}</div></body>") for k, text in near.items()]
    pair = {10 + k: " ".join(own[: 59 + k]) for k in range(2)}
    rows += [(k, "https://b.example/", f"<div class='menu'>menu {k}</div><div>{text}</div>") for k, text in pair.items()]
    other = {20 + k: " ".join(story(30) + [phrase] * (k < 6) + story(30)) for k in range(20)}
    copies = {40 + k: " ".join([*own[:k], f"changed{k}", *own[k + 1 :]]) for k in range(20)}
    rows += [(k, "https://c.example/", f"<div>{menu}</div><div>{text}</div>") for k, text in (other | copies).items()]
    got = texts(spark, rows)
    assert got == near | pair | other | copies


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        x = rng.integers(0, 4, n)
        assert html_text.suffix_array(x).tolist() == sorted(range(n), key=lambda k: x[k:].tolist())


def test_repeated_starts_equal_counting():
    rng = random.Random(4)
    pages = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(9)]
    got = html_text.repeated_starts([np.array(p, dtype=np.uint64) for p in pages], list(range(9)))
    for k, p in enumerate(pages):
        others = {tuple(q[i : i + 5]) for j, q in enumerate(pages) if j != k for i in range(len(q) - 4)}
        assert got[k].tolist() == [i for i in range(len(p) - 4) if tuple(p[i : i + 5]) in others]


def test_query(spark, sf_dir):
    rows = op4_html_text(spark, sf_dir).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) and "<" not in r.text[:1] for r in rows) and sum(r.n_chars > 50 for r in rows) > 40


@pytest.mark.parametrize(("page", "want"), [("<main><p>a</p><header>h</header></main>", "a h"), ("<p>a</p><script>x", "a"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<p title='a>b'>c</p>", "c"), ("<ul><li>x</li><li>y</li></ul>", "x y")])
def test_small_pages(page, want):
    assert " ".join(t for k, t in html_text.blocks_of(page) if k != html_text.FURNITURE) == want


ARTICLE_BLOCK = "<article><p>the whole article stands here</p></article>"
LAYOUTS = [
    f"<html class='no-js ad'><body class='post has-sidebar social'>{ARTICLE_BLOCK}<div class='sidebar'>side</div></body></html>",
    "<main class='with-sidebar'><p>the whole article stands here</p><div class='sidebar'>side</div></main>",
    "<main class='search'><p>the whole article stands here</p></main>",
    f"<div class='content no-ads'>{ARTICLE_BLOCK}</div><div class='no-ads ads'>buy</div>",
    f"<div class='sidebar-layout'><div class='header-fixed'>{ARTICLE_BLOCK}<div class='sidebar'>side</div></div></div>",
    f"<div class='content'>crumbs</div><div id='menu-page'>{ARTICLE_BLOCK}<nav>menu</nav></div>",
    f"{ARTICLE_BLOCK}<section class='comments'><div class='entry'>{'a long comment ' * 30}</div></section>",
    f"<main><p>the whole article stands here</p><div class='related'><article>{'teaser ' * 40}</article></div></main>",
    "<div class='post'><p>the whole article stands here</p></div><div class='sidebar'><article>teaser</article></div>",
    "<div class='entry-content share-enabled'><p>the whole article stands here</p></div>",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_names_of_the_layout_do_not_hide_the_article(page):
    kinds = html_text.blocks_of(page)
    assert [t for k, t in kinds if k == html_text.ARTICLE] == ["the whole article stands here"]
    assert {t for k, t in kinds if k == html_text.UNDECIDED} <= {"crumbs"}


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "</p>" * n, lambda n: "<!a" * n, lambda n: '<a ">x' * n, lambda n: "<a '\">" * n + '"', lambda n: "<div class=ad>" * n + "x", lambda n: "<" * n, lambda n: "<a " * n])
def test_broken_pages_take_linear_time(make):
    import time

    def seconds(n):
        began = time.process_time()
        html_text.blocks_of(make(n))
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.05)


def test_repeats_decide_where_no_name_or_tag_is_known(spark):
    """Boilerplate in elements whose names mean nothing goes by being repeated alone."""
    menu = "home about our people the archive of all years contact us by letter and by telephone"
    rows = [(k, "http://h.org/%d" % k, f"<body><div class='zq1'>{menu}</div><div class='zq2'>{story(k)}</div></body>") for k in range(8)]
    assert texts(spark, rows) == {k: story(k) for k in range(8)}
    assert texts(spark, rows[:2]) == {k: f"{menu} {story(k)}" for k in range(2)}  # two pages are no evidence


def story(k):
    return " ".join(f"s{k}w{i}" for i in range(60))


def test_odd_pages(spark):
    page = "<p>the same page</p>"
    rows = [(1, "http://h.org/a", page)] * 5 + [(2, None, None), (None, "http://h.org/b", ""), (3, "x", "<p>" + "long " * 300_000 + "</p>")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_text.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text[:13], r.n_chars) for r in got.collect()) == [(0, "", 0), *[(1, "the same page", 13)] * 5, (2, "", 0), (3, "long long lon", 1_499_999)]
    assert html_text.main_text(df.limit(0)).count() == 0
