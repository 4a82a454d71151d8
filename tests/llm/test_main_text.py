import random
import time

import pytest

from sqlstrata.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav>
<div class="ad">Buy</div>%s<div id="comments"><p>I liked it, really, very much indeed.</p></div><aside>side</aside><form>in <input></form><footer>&copy; foot</footer></body></html>"""

CASES = [
    ("<article><h1>Title</h1><p>One,\n two &amp; &eacute;&#233;.<p>Three<b>bold</b><br>four</article>", "Title One, two & éé. Threebold four"),
    ("<article><p><b>Unclosed.<br><p>Next.</p></article>", "Unclosed. Next."),
    ("<div class=content><p>First long paragraph, with commas, and so on and on.</p><ul><li>a</li><li>b</li></ul><p>Second paragraph, too, is a long one.</p></div>", "First long paragraph, with commas, and so on and on. a b Second paragraph, too, is a long one."),
    ("<article><p>Text here, good.</p><div class='share'>Share!</div><div class=\"cookie-notice\">Accept</div><section class='comments'><p>Nice, nice, nice.</p></section></article>", "Text here, good."),
    ("<article><p>a<!-- no <p>x</p> -->b</p><script>if (a<b) {}</script><p>1 < 2 & 3</p></article>", "ab 1 < 2 & 3"),
    ("<main><table><tr><td>c1<td>c2<tr><td>c3</table></main>", "c1 c2 c3"),
    ("<article></article>", None),
]


@pytest.mark.parametrize("body,want", CASES)
def test_pages(body, want):
    got = M.Page(PAGE % body).main_text()
    assert got == want if want is not None else "foot" not in got


def test_parts_and_siblings():
    body = "<section><h2>A</h2>" + "<p>Some words, more words, and yet more words of it.</p>" * 3 + "</section><section><h2>B</h2>" + "<p>Other words, other words, and other words again.</p>" * 3 + "</section>"
    got = M.Page(f"<body><article>{body}</article></body>").main_text()
    assert got.startswith("A Some") and "B Other" in got
    assert "B Other" in M.Page(f"<body><div><div>{body}</div></div></body>").main_text()


def test_awkward_sources():
    for source in ["", "<", "<<<>>>", "</p></p>", "<p", "<p title=\"x>y", "<!--", "<script>", "<a href='", "plain text", "<div>" * 3000 + "deep" + "</div>" * 3000, "<p>" + "x, " * 200_000]:
        M.Page(source).main_text()
    assert M.Page("plain text").main_text() == "plain text"
    assert M.Page("<div>" * 3000 + "deep").main_text() == "deep"


def test_rows(spark):
    rows = [(1, "u", PAGE % CASES[0][0], "t"), (1, "u", PAGE % CASES[0][0], "t"), (2, None, None, "t"), (None, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, M.main_texts(df).collect()), key=str)
    want = CASES[0][1]
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert M.main_texts(df.limit(0)).count() == 0


LONG = "<p>A long first paragraph, with commas, and so on, and on, and on.</p><p>A second one, just as long, with commas, and on.</p>"


@pytest.mark.parametrize("body,want", [
    ('<div class="content has-sidebar">%s</div>', 1), ('<div id="main" class="post-with-comments">%s</div>', 1), ('<div class="elementor-widget-wrap">%s</div>', 1),
    ('<div class="content"><p>The <span class="share">market share</span> of it, read <a class="related">this report</a>.</p>%s</div>', 1), ('<div><p class="message">A message.</p>%s</div>', 1),
    ('<form id="aspnet"><h1>Title</h1><div>%s</div></form>', 1), ('<div><div class="text">%s</div><div class="text"><p>Short tail.</p></div></div>', 1),
    ('<div class="widget"><article>%s</article></div>', 1), ('<div class="cookie-notice ad-300x250">%s</div>', 0), ('<ol class="commentList"><li>%s</li></ol>', 0), ('<aside>%s</aside>', 0), ('<div role="search">%s</div>', 0)])
def test_names_do_not_lose_articles(body, want):
    text = M.Page(PAGE % body.replace("%s", LONG)).main_text()
    assert ("A long first" in text and "A second one" in text) == bool(want)
    for part in ["market share", "this report", "A message.", "Short tail."]:
        assert part not in body or part in text
    assert "Buy" not in text and "I liked it" not in text and "foot" not in text


def test_comments_longer_than_the_article():
    body = "<div class=post><p>Short, but the article.</p></div><div class='post-comments'>" + LONG * 9 + "</div>"
    assert M.Page(PAGE % body).main_text() == "Short, but the article."


@pytest.mark.parametrize("source", ["<div>x " * 140_000, "<p><b>x" * 140_000, "<a href='" * 100_000, "<svg><p>x" * 100_000, "<ul><li>" * 120_000, "<p><button>" + "<b>x<div>" * 100_000, "<article><p>x, " * 70_000])
def test_time_is_linear_in_depth(source):
    start = time.time()
    M.Page(source).main_text()
    assert time.time() - start < 15


def test_scores_against_a_walk_for_each_paragraph():
    r = random.Random(5)
    for _ in range(60):
        source = "".join(r.choice(["<div>", "</div>", "<p>", "</p>", "<section>", "</section>", "<a>", "</a>", "<ul><li>", "</ul>", "<h2>t</h2>", "some words, and more. ", "x " * 90, "<td>"]) for _ in range(80))
        page = M.Page(source)
        score, size = {}, {}
        for holder, text, n, linked in page.blocks:
            up = holder
            while up >= 0:
                size[up] = size.get(up, 0) + n
                up = page.parent[up]
            points = 0 if page.tag[holder] == "h2" else (1 + text.count(",") + min(n / 100, 3)) * (n - linked) / n
            up, step = holder if page.tag[holder] in ("div", "section", "#page", "td") else page.parent[holder], 0
            while up >= 0:
                score[up] = score.get(up, 0) + points / [1, 2, 6, 9, 12][min(step, 4)]
                up, step = page.parent[up], step + 1
        got, sizes, _ = page.scores(page.blocks)
        assert got == pytest.approx([score.get(e, 0) for e in range(len(page.tag))]) and sizes == [size.get(e, 0) for e in range(len(page.tag))]
