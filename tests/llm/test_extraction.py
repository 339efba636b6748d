import time

import numpy as np

from prismfold.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now, a long line of advert text that goes on.</div>
{body}<footer>&copy; x &middot; y</footer></body></html>"""
ARTICLE = "<article><h1>A  title</h1><p>First <b>bold</b> line &amp; more.<br><p>Second\n line.</p><p>Be.</p></article>"
WANT = "A title\nFirst bold line & more.\nSecond line.\nBe."


def test_article_only():
    assert extraction.main_text(PAGE.format(body=ARTICLE)) == WANT


def test_no_chrome_inside_the_article():
    inside = ARTICLE.replace("<p>Second", '<aside>Related things</aside><div class="comments"><p>Reader says hello to all</p></div><form><p>Mail</p></form><p>Second')
    assert extraction.main_text(PAGE.format(body=inside)) == WANT


def test_without_semantic_elements():
    body = '<div id="wrap"><div><h2>Head</h2><p>' + "Long text here. " * 30 + "</p><p>Tail.</p></div></div>" + '<div class="sidebar"><p>' + "side " * 50 + "</p></div>"
    got = extraction.main_text(PAGE.format(body=body))
    assert got.startswith("Head\nLong text") and got.endswith("\nTail.") and "side" not in got


def test_awkward_pages(spark):
    rows = [(1, "u", PAGE.format(body=ARTICLE), "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "no tags at all", "x"), (5, "u", "<article><p>" + "w " * 200_000, "x"), (6, "u", "<nav>menu</nav>", "x"), (1, "u", PAGE.format(body=ARTICLE), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extraction.digest(extraction.extract(pages)).collect()]
    by = {p: (t, n) for p, t, n in got}
    assert len(got) == 7 and by[1] == (WANT, len(WANT)) and by[2] == by[3] == by[6] == ("", 0) and by[4][0] == "no tags at all" and by[5][1] == 399_999
    assert extraction.extract(pages.limit(0)).count() == 0


def test_class_words_keep_article_text():
    inside = ARTICLE.replace("<p>Be.", '<div class="post-share side-by-side"><p>Real paragraph.</p></div><p class="disclaimer text">A remark.</p><div class="article-header"><p>Sub.</p></div><p>Be.')
    assert extraction.main_text(PAGE.format(body=inside)) == WANT.replace("\nBe.", "\nReal paragraph.\nA remark.\nSub.\nBe.")
    dropped = ARTICLE.replace("<p>Be.", '<div class="cookie-banner">We use.</div><div id="ad_slot-3">Buy.</div><ul class="comments list"><li>Hi</li></ul><div class="site-notice">Note.</div><p>Be.')
    assert extraction.main_text(PAGE.format(body=dropped)) == WANT


def test_clusters_select_the_region():
    """Without content elements and with several, the ratios decide, and sigma and threshold with them."""
    long, links = "A long paragraph of the text itself. " * 12, '<p><a href="#">l</a> <a href="#">m</a> <a href="#">n</a> <a href="#">o</a> <a href="#">p</a> link</p>'
    page = PAGE.format(body=f"<div>{links * 200}</div><div>{f'<p>{long}</p>' * 3}<p>End.</p></div>")
    assert extraction.main_text(page) == "\n".join([long.strip()] * 3 + ["End."])
    assert extraction.main_text(page, sigma=1e6, threshold=0.0) != extraction.main_text(page)
    two = PAGE.format(body=f"<article>{links * 60}</article><article><h2>Head</h2><p>{long}</p><p>End.</p></article>")
    assert extraction.main_text(two) == f"Head\n{long.strip()}\nEnd."
    assert extraction.main_text(two, sigma=1e6, threshold=0.0).startswith("l m n")
    assert extraction.clusters(np.array([True, True, False, True])) == [(0, 2), (3, 4)]


def test_deep_nesting_takes_linear_time():
    began, took = time.time(), []
    for depth in (20_000, 80_000):
        page = "<div>" * depth + "<p>Deep text.</p>" + "<b>x</b></i>" * depth + "</div>" * depth
        assert extraction.main_text(page).startswith("Deep text.")
        took.append(time.time() - began)
        began = time.time()
    assert took[1] < 10 * took[0] + 1


def test_smoothing_keeps_constants():
    assert np.allclose(extraction.smoothed(np.full(9, 3.0), 1.0), 3.0)
