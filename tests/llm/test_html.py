"""Flow, depth and odd tables of the main text extraction."""

import random
import time

import pytest

from graphlens.llm import html
from tests.llm.cases import CLASHING, write


@pytest.mark.parametrize("scale", [0.02, 0.3, 1.0, 4.0])
def test_flow_equals_an_elimination_along_the_page(scale):
    """The cut of random pulls and edges against a table over the labels of the last places."""
    rng = random.Random(int(scale * 100))
    n = 400
    pull = [rng.uniform(-scale, scale) for _ in range(n)]
    edges = [(i, i + 1, rng.random()) for i in range(n - 1)] + [(i, j, rng.random()) for i in range(n) if (j := i + rng.randrange(2, 8)) < n]
    back = {}
    for i, j, c in edges:
        back.setdefault(j, []).append((i, c))
    best = {(): 0.0}
    for i in range(n):
        now = {}
        for state, cost in best.items():
            for label in (0, 1):
                cut = sum(c for j, c in back.get(i, ()) if state[j - i] != label)
                key = (*state, label)[-7:]
                now[key] = min(now.get(key, 1e9), cost + cut + (max(0.0, pull[i]) if not label else max(0.0, -pull[i])))
        best = now
    flow = html._Flow(list(pull), edges)
    flow.settle()
    side = flow.run()
    cost = sum(max(0.0, p) if i not in side else max(0.0, -p) for i, p in enumerate(pull)) + sum(c for i, j, c in edges if (i in side) != (j in side))
    assert cost == pytest.approx(min(best.values()), abs=1e-6)


def test_a_hundred_thousand_blocks():
    rng = random.Random(3)
    parts = []
    for i in range(100_000):
        parts.append(rng.choice(["<p>x</p>", "<div>some more words here</div>", "<li><a href=q>link words</a>", "<div class=ad>buy this</div>", "<td>1", f"<section><p>A sentence with number {i}.</p></section>"]))
    start = time.time()
    assert len(html.main_text("<body>" + "".join(parts))) > 100_000
    assert time.time() - start < 20


def test_very_deep_pages():
    """What stands beyond any depth is read, in time that grows with the page."""
    deep = "<div>" * 50_000 + "<p>The only sentence of this page, far down.</p>" + "</div><p>and one more sentence after it.</p>" * 50
    start = time.time()
    assert html.main_text(deep).startswith("The only sentence of this page, far down.\nand one more")
    assert time.time() - start < 10


def test_odd_and_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    article = "<article><p>A whole sentence of an article, repeated.</p></article>"
    rows = [(1, "u", article), (1, "u", article), (1, "u", article), (None, None, None), (2, "v", ""), (3, None, "<<<>>>&#0;&#xD800;<"), (None, "w", " \n "), (4, "x", "<p>" * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html.op9_html(spark, write(df.withColumns({c: F.lit(1) for c in CLASHING}), tmp_path, "pages")).collect()
    assert len(out) == len(rows) and [(r["text"], r["n_chars"]) for r in out if r["page_id"] == 1] == [("A whole sentence of an article, repeated.", 41)] * 3
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in out if r["page_id"] in (None, 2, 4))
    assert html.op9_html(spark, write(df.limit(0), tmp_path / "none", "pages")).count() == 0


SENTENCES = ["This is a plain sentence about rivers and the towns that stand on their banks, number %d of the whole article." % i for i in range(5)]


@pytest.mark.parametrize("body", ["", ' class="has-sidebar single"', ' class="overflow-hidden"', ' class="post comments-open"', ' class="no-ads"', ' class="page-sidebar-left nav-open" id=search'])
@pytest.mark.parametrize("around", ["<article>%s</article>", '<div class="entry">%s</div>', "<main>%s</main>", '<div class="content with-sidebar">%s</div>', '<main class="social-studies">%s</main>', '<div class="socialStudies">%s</div>'])
def test_names_of_layouts_hide_nothing(body, around):
    page = f"<html><body{body}><nav><a href=a>Home</a></nav>" + around % "".join(f"<p>{s}</p>" for s in SENTENCES) + '<div class="sidebar"><p>Read also what others wrote about this very topic, all week long.</p></div></body></html>'
    assert html.main_text(page) == "\n".join(SENTENCES)


@pytest.mark.parametrize("name", ["sidebar", "comment-list", "site-footer", "relatedArticles", "cookie-banner", "newsletter signup", "ad", "ad-slot-3", "share-buttons", "left-sidebar", "post-comments", "hidden"])
def test_names_of_boilerplate_still_count(name):
    page = "<body><article>" + "".join(f"<p>{s}</p>" for s in SENTENCES) + f'</article><div class="{name}"><p>A sentence that is none of the article and has quite some words in it, too.</p></div>'
    assert html.main_text(page) == "\n".join(SENTENCES)


def test_a_label_around_nearly_all_text_is_no_sidebar():
    inner = "".join(f"<p>{s}</p>" for s in SENTENCES)
    assert html.main_text(f'<body><h1>Title of it</h1><div class="widget">{inner}</div>') .endswith("\n".join(SENTENCES))
    long_comments = "".join(f"<p>{s}</p>" for s in SENTENCES * 4)
    assert html.main_text(f'<body><div>{inner}</div><div class="comments">{long_comments}</div>') == "\n".join(SENTENCES)


@pytest.mark.parametrize("tag", ["<button>", "<svg><path>", "<select><option>a", "<object>", "<canvas>x"])
def test_unclosed_elements_take_linear_time(tag):
    page = "<body><p>The only sentence of this page, ahead of all.</p>" + tag * 100_000 + "<p>And one more sentence, at the very end of it.</p>"
    start = time.time()
    assert "The only sentence of this page" in html.main_text(page)
    assert time.time() - start < 10


def test_closed_elements_are_skipped():
    page = "<p>One sentence that stays here.</p><svg><text>no<svg>no</svg>no</text></svg><p>Another one <button>no <b>no</b></button>that stays, too.</p><select><option>no</select>"
    assert html.main_text("<body>" + page) == "One sentence that stays here.\nAnother one that stays, too."
