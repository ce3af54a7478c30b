import html
import itertools
import random
import re
import time

import pytest
from dyadlake.llm import html_extract as H
from dyadlake.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> Best site</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<!-- ad --><div class="cookie-notice">We use cookies, click here.</div>
<main><article><h1>The &amp; title</h1><p>First   paragraph,
with <b>bold</b> text and <a href="x">a link</a>.<p>Second one is here &lt;now&gt;, it is longer. And goes on.<br>After a break.</p>
<div class="ad">Buy things!</div><ul><li>A listed point of the article, with words.</li></ul><pre> kept   as is </pre>
<section id="comments"><p>Reader says: great article, thanks a lot for writing it.</p></section></article></main>
<aside><p>Related: something else to read, perhaps.</p></aside><form><p>Sign up</p><input name="q"><button>Go</button><textarea>t</textarea></form><footer>&copy; site</footer></body></html>"""
WANT = "The & title\nFirst paragraph, with bold text and a link.\nSecond one is here <now>, it is longer. And goes on. After a break.\nA listed point of the article, with words.\nkept as is"


def test_article_without_the_rest():
    assert H.extract(PAGE, H.START) == WANT


def test_page_without_semantic_elements():
    body = "".join(f"<p>Paragraph number {i} has a good many words in it, and it ends with a stop.</p>" for i in range(5))
    links = "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(8))
    text = H.extract(f"<body><div>{links}</div><div>{body}</div><div>{links}</div></body>", H.START)
    assert text.split("\n") == [f"Paragraph number {i} has a good many words in it, and it ends with a stop." for i in range(5)]


@pytest.mark.parametrize("seed", range(6))
def test_minimum_cut_against_all_labellings(seed):
    r = random.Random(seed)
    for _ in range(40):
        n = r.randint(1, 8)
        score = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda x: sum((s if s > 0 else 0) if not k else (-s if s < 0 else 0) for s, k in zip(score, x)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, B905, E731
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(H.min_cut(score, edges)) == pytest.approx(best)


def test_smoothness_overrules_a_weak_block():
    assert H.min_cut([3.0, -0.5, 3.0], [(0, 1, 0.7), (1, 2, 0.7)]) == [True, True, True]
    assert H.min_cut([3.0, -4.0, 3.0], [(0, 1, 0.7), (1, 2, 0.7)]) == [True, False, True]


@pytest.mark.parametrize("page", [None, "", "plain", "<p>", "<", "<<<", "</p></div>", "<script>unclosed", "<!-- unclosed", '<a href="unclosed>x', "<p>&#0;&bogus;&amp</p>", "<div>" * 3000 + "deep", "<b>" * 500])
def test_broken_pages_do_not_crash(page):
    assert isinstance(H.extract(page, H.START), str)


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, "old"), (3, "u", "", "old"), (4, "u", "<article>" + "<p>word word.</p>" * 60_000 + "</article>", "old")], "page_id long, url string, html string, TEXT string")
    w = H.train(df)
    rows = sorted(H.main_text(df, w).collect(), key=lambda r: r.page_id)
    assert [r.text for r in rows[:4]] == [WANT, WANT, "", ""] and [r.n_chars for r in rows[:4]] == [len(WANT)] * 2 + [0, 0]
    assert rows[4].text.count("\n") == 59_999
    assert H.main_text(df.limit(0), H.train(df.limit(0))).count() == 0


def test_query_keeps_exactly_the_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op2_html_extraction(spark, small).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1))[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


GOOD = [f"Paragraph number {i} has a good many words in it, and it ends with a stop." for i in range(10)]


def test_every_block_of_a_flat_page_has_its_own_label():
    links = [f'<a href="/{i}">Link number {i}</a>' for i in range(20)]
    page = lambda parts: "<body>" + "".join(f"<p>{x}</p>" for x in parts) + "</body>"
    assert H.extract(page(links + GOOD), H.START).split("\n") == GOOD
    assert H.extract(page(GOOD[:5] + links[:1] + GOOD[5:]), H.START).split("\n") == GOOD


def test_blocks_deep_in_the_tree_are_as_far_apart_as_they_are():
    a, b = H.blocks("<div>" * 100 + "<div><div>a</div></div><div><div>b</div></div>")
    assert H.steps(a.path, b.path) == 4


@pytest.mark.parametrize("seed", range(4))
def test_reduced_cut_is_the_minimum_cut(seed):
    r = random.Random(seed)
    for _ in range(200):
        n = r.randint(1, 12)
        score = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if r.random() < r.choice([0.2, 0.5]) or b == a + 1]
        assert H.reduced_cut(score, edges) == H.min_cut(score, edges)


def test_long_weak_runs_are_cut_in_linear_time():
    nested = "".join(f"<div>{i} some words</div><p>{i}</p>" for i in range(30_000))
    assert isinstance(H.extract(f"<body>{nested}</body>", H.START), str)


def test_a_word_of_a_longer_name_is_not_the_name():
    page = '<body class="has-sidebar"><div class="post"><p>First, a paragraph with some words.</p><div class="tags-intro"><p>The body of it, which is about tags and has words.</p></div></div><div class="site-footer"><p>All of it is ours, and ours alone, they say.</p></div><ul class="comment-list"><li>I like it a lot, thank you for writing it.</li></ul></body>'
    assert H.extract(page, H.START).split("\n") == ["First, a paragraph with some words.", "The body of it, which is about tags and has words."]
    names = {"footer": True, "siteFooter": True, "comment-list": True, "tags-intro": False, "article-header": False, "page-header": True, "sidebar-left": True, "advice": False, "post-comments": True, "admin": False}
    assert {n: H.evidence(f' class="{n}"')[0] for n in names} == names


@pytest.mark.parametrize("page", ["<a " * 100_000, '<a "' * 100_000 + ">", "<a \"'" * 80_000 + ">x", "<script>" * 60_000, "<button>" * 60_000 + "x", "<div>" * 40_000 + "</section>" * 40_000, "<!" * 100_000, "</" * 100_000, "<p class='" * 50_000, "<title>x" * 50_000, "<svg" * 90_000 + ">"])
def test_long_broken_pages_take_linear_time(page):
    began = time.process_time()
    assert isinstance(H.extract(page, H.START), str)
    assert time.process_time() - began < 5


def test_unclosed_quotes_and_elements_lose_no_text():
    assert H.extract('<p>One thing, and more. <a href="x>link</a> then another thing.</p><p>Two things here, you see.</p>', H.START) == "One thing, and more. link then another thing.\nTwo things here, you see."
    assert H.extract("<article><button><p>One thing, and more.</p></article>", H.START) == "One thing, and more."


def test_the_classifier_sees_no_elements_and_holds_without_them(spark, small):
    """Learned from pages that name their parts, tried on their blocks without what names them."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    w = H.train(pages)
    right = total = 0
    for r in pages.collect():
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r.html).replace(' class="ad"', "")
        named, plain = H.blocks(r.html), H.blocks(bare)
        assert [b.text for b in named] == [b.text for b in plain] and not any(b.against or b.favour for b in plain)
        logit = H.features(plain) @ w
        right += sum((v > 0) != b.against for v, b in zip(logit, named, strict=True))
        total += len(named)
    assert right / total > 0.85
