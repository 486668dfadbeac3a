"""Operator 1 against brute force, operator 7 against pages whose text is known and cuts by enumeration."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from threadmill.llm import hnsw
from threadmill.llm.html_text import extract, main_text, minimum_cut


def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(scale=0.4, size=(3000, 16))).astype(np.float32)
    x[500:1500] = x[0]  # one very common vector
    return x


def test_recall_against_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(3000, None, 1), (3100, [0.0] * 16, 1), (3200, [float("nan")] * 16, 1), (3300, [None] * 16, 1), (3400, [1.0, 2.0], 1), (3401, [1.0, 2.5], 1), (None, x[0].tolist(), 1), (3500, [], 1), (3600, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = hnsw.nearest(table, F.col("vec_id") % 100 == 0, shard_rows=400).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {*range(0, 3000, 100), 3400} and [v for _, v, _ in by[3400]] == [3401]
    hit, d64 = 0, x.astype(np.float64)
    for q in range(0, 3000, 100):
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        rows = sorted(by[q])
        assert [r for r, _, _ in rows] == list(range(1, 11)) and len({v for _, v, _ in rows}) == 10
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (r[2], r[1]))
        if q == 500:
            assert [v for _, v, _ in rows] == [0, *range(501, 510)]
        hit += len(set(want.tolist()) & {v for _, v, _ in rows})
    assert hit / 300 >= 0.95


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(table, F.col("vec_id") % 100 == 0).collect() == []


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        costs = [rng.randint(-120, 120) for _ in range(n)]
        edges = {(i, j): rng.randint(1, 90) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        total = lambda keep: sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, keep, strict=True)) + sum(w for (i, j), w in edges.items() if keep[i] != keep[j])  # noqa: B023, E731
        assert total(minimum_cut(costs, edges)) == min(total(k) for k in itertools.product([False, True], repeat=n))


ARTICLE = ["A title", "First paragraph with & and enough words to be read as text by anyone at all.", "Short.", "Another paragraph, long enough to stand for itself among all of the others here."]


def page(before="", after="", inside=""):
    h, *ps = ARTICLE
    body = "".join(f"<p>{p.replace('&', '&amp;')}</p>\n" for p in ps)
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t='</p>'</script></head><body>{before}<article><h1> A\n title</h1>{body}{inside}</article>{after}</body></html>"


def test_boilerplate_goes():
    want = "\n\n".join(ARTICLE)
    around = [
        "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News and many other things</a></ul></nav>", '<div class="ad">Buy this very good thing now, it is better than any other thing.</div>',
        "<header><a href=/>The site's name</a></header>", "<aside><p>A sidebar that is long enough to look like a paragraph of the article itself.</p></aside>", '<div id="cookie-notice">We use cookies on this site to make it better for everyone who visits.</div>',
        "<form><label>Your name</label><input name=x><p>Sign up for our letter with news of everything that we do here.</p></form>", "<footer>&copy; 2020 someone &middot; all rights reserved</footer>", "<!-- a comment <p>with a paragraph</p> --><noscript>Turn it on</noscript>",
    ]
    for extra in around:
        assert main_text(page(before=extra)) == want
        assert main_text(page(after=extra)) == want
    for extra in ('<div class="site-header"><p>The name of the site and its motto, which is long.</p></div>', '<div class="advertBox"><p>Buy now, buy more, buy everything that we have to sell to you.</p></div>'):
        assert main_text(page(before=extra)) == want
    wrapped = page().replace("<body>", '<body class="no-sidebar"><div class="content has-sidebar with-comments">').replace("</body>", "</div></body>")
    assert main_text(wrapped) == want and main_text(wrapped.replace("<article>", "<div>").replace("</article>", "</div>")) == want
    comments = '<section class="comments"><h2>Comments</h2><div class="comment"><p>I read this with joy and want to say that it is all true, every word of it.</p></div></section>'
    assert main_text(page(after=comments)) == want and main_text(page(inside=comments)) == want


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<div></div>") == ""
    assert main_text(page()[: page().index("Another") + 20]).endswith("Another paragraph, l")
    assert main_text("<article><p>One <b>bold<p>two &lt;x&gt; &#233; 1 < 2<br>three<p title='a>b'>four</article>") == "One bold\n\ntwo <x> é 1 < 2 three\n\nfour"
    assert main_text("<p>" * 3000 + "deep text that goes on and on for quite a while, so it counts.") != ""


def test_names_of_wrappers_do_not_cost_the_article():
    """Templates name wrappers after what stands beside or below the article."""
    want, plain = "\n\n".join(ARTICLE), page()
    inner = plain[plain.index("<article>") + 9 : plain.index("</article>")]
    extra = '<nav><a href=/>Home</a></nav><div class="comments"><h3>Comments</h3><p>I read this with joy and want to say that it is all true, every word.</p></div>'
    for tag, name in [("article", "post comments-open"), ("div", "site-content sidebar-right"), ("div", "layout-sidebar"), ("article", "legal-news"), ("div", "search-results-off"), ("form", "aspnetForm"), ("div", "wrapper promo")]:
        for article in (inner, f"<article>{inner}</article>", f"<main>{inner}</main>"):
            wrapped = f'<html><body><{tag} class="{name}">{article}</{tag}>{extra}</body></html>'
            assert main_text(wrapped) == want, (tag, name)
            assert main_text(wrapped.replace(f"</{tag}>{extra}", f"{extra}</{tag}>")) == want, (tag, name)
    for name in ("comment-list", "site-footer", "widget-area sidebar", "cookie-notice", "related-posts"):  # and yet such parts go
        part = f'<div class="{name}"><p>Something else that stands on the page and that is long enough to be a paragraph of it.</p></div>'
        assert main_text(page(after=part)) == want and main_text(page(before=part)) == want


def test_deep_pages_are_read_in_linear_time():
    import time

    for unit in ("<div>x", "<div>x</b>", "<b><div>x</i>", "<ul><div><li>x", "<li><div>x"):
        times = []
        for n in (25_000, 100_000):
            began = time.perf_counter()
            main_text(unit * n)
            times.append(time.perf_counter() - began)
        assert times[1] < 4 and times[1] < 12 * times[0] + 0.5, (unit, times)


def generated_page(rng):
    """A page of random furniture around and inside an article, and the article's blocks."""
    word = lambda: "".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda: "".join(f"<li><a href=/{word()}>{words(1, 3)}</a></li>" for _ in range(rng.randint(3, 8)))
    furniture = [
        lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f'<div class="menu"><ul>{links()}</ul></div>', lambda: f"<header><a href=/>{words(1, 4)}</a><p>{words(3, 9)}</p></header>",
        lambda: f'<aside class="sidebar"><h3>{words(1, 3)}</h3><p>{words(8, 30)}</p><ul>{links()}</ul></aside>', lambda: f'<div class="ad-{word()}">{words(5, 25)}</div>', lambda: f"<footer><p>&copy; {words(4, 20)}</p><ul>{links()}</ul></footer>",
        lambda: f'<div id="cookie-banner"><p>{words(8, 30)}</p><button>{words(1, 2)}</button></div>', lambda: f'<section id="comments"><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{words(5, 60)}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>",
        lambda: f"<form><label>{words(1, 3)}</label><input><p>{words(4, 20)}</p></form>", lambda: f"<script>var {word()} = '<p>{words(3, 9)}</p>'</script><style>.{word()} {{}}</style>", lambda: f'<div class="related-posts"><h4>{words(1, 3)}</h4><ul>{links()}</ul></div>',
    ]
    blocks = [("h1", words(2, 8))] + [(rng.choice(["p"] * 6 + ["h2", "blockquote", "li"]), words(4, 90)) for _ in range(rng.randint(3, 14))]
    body = "".join(f"<ul><li>{t}</li></ul>" if tag == "li" else f"<{tag}>{t}</{tag}>" for tag, t in blocks)
    if rng.random() < 0.5:
        cut = body.index("</h1>") + 5
        body = body[:cut] + rng.choice(furniture[4:])() + body[cut:]
    opener, closer = rng.choice([("<article>", "</article>"), ('<div class="post-body">', "</div>"), ("<main><article>", "</article></main>"), ('<div class="content-with-sidebar">', "</div>"), ('<article class="post comments-open">', "</article>"), ("<div>", "</div>")])
    parts = lambda: "".join(rng.choice(furniture)() for _ in range(rng.randint(0, 4)))
    return f"<html><head><title>{words(2, 5)}</title></head><body>{parts()}{opener}{body}{closer}{parts()}</body></html>", [t for _, t in blocks]


def test_blocks_of_generated_pages():
    """Precision and recall by block over pages of random furniture."""
    rng, right, found, wanted = random.Random(12), 0, 0, 0
    for _ in range(400):
        html, blocks = generated_page(rng)
        got = [b for b in main_text(html).split("\n\n") if b]
        right += len(set(got) & set(blocks))
        found += len(got)
        wanted += len(blocks)
    print(f"precision {right / found:.4f} recall {right / wanted:.4f}")
    assert right / found > 0.97 and right / wanted > 0.97


def test_pages_table(spark):
    rows = [(1, "u", page(), "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", page() * 2, "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and {r["n_chars"] for r in got} >= {0, len("\n\n".join(ARTICLE))}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
