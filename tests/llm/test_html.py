"""Extraction by tag-path ratios on pages whose outline says nothing, and on outlines that mislead."""

import random

import pytest

from fathomark.llm import html

BODY = [f"Sentence {k} of the text, with marks, and long enough to be one." for k in range(6)]
MENU = "<a href=/>Home</a> <a href=/b>About us</a> <a href=/c>Contact</a>"


def prose(rng, n):
    words = [rng.choice(("river", "stone", "light", "of", "and", "under", "moves", "slow", "a", "garden", "window,", "evening.")) for _ in range(n)]
    return (" ".join(words) + ".").capitalize()


def plain_page(rng):
    """A page of div elements with names that tell nothing, and the text of its article."""
    name = lambda: f"class='x{rng.choice('abcdefgh')}{rng.choice('klmn')}'"
    article = [prose(rng, 5)] + [prose(rng, rng.randrange(30, 70)) for _ in range(rng.randrange(3, 6))]
    at = rng.randrange(1, len(article) - 1)
    short = [prose(rng, 4) for _ in range(rng.randrange(3))]
    article[at:at] = short
    inner = f"<h1>{article[0]}</h1>" + "".join(f"<p>{t}</p>" for t in article[1:])
    menus = lambda: f"<div {name()}><ul>" + "".join(f"<li><a href=/{k}>{prose(rng, 2)}</a></li>" for k in range(rng.randrange(3, 9))) + "</ul></div>"
    line = "".join(f"<div {name()}>{prose(rng, rng.randrange(3, 9))}</div>" for _ in range(rng.randrange(1, 25)))
    before, after = menus(), line + menus() if rng.random() < 0.5 else menus() + line
    if rng.random() < 0.5:
        return f"<body>{before}<div class='z'>{inner}</div>{after}</body>", article
    return f"<body><div class='y'>{before}<div class='z'>{inner}</div>{menus()}</div>{after}</body>", article


def test_pages_without_an_outline():
    rng = random.Random(9)
    right = without = 0
    for _ in range(300):
        page, article = plain_page(rng)
        right += html.main_text(page).split("\n\n") == article
        without += html.main_text(page, factor=0.0).split("\n\n") == article
    # with every path taken for content, the outline alone can't tell
    assert right >= 290 and without <= 150, (right, without)


@pytest.mark.parametrize("name", ["x2", "related-work search", "has-sidebar", "comment-on-policy"])
@pytest.mark.parametrize("menu", [MENU, "Home About Contact"])
def test_ratios_choose_the_article(name, menu):
    inner = "".join(f"<p>{t}</p>" for t in BODY)
    page = f"<body><div class='x1'>{menu}</div><div class='{name}'>{inner}</div><div class='x3'>Copyright notice, all.</div></body>"
    assert html.main_text(page).split("\n\n") == BODY


def test_vague_names_within_an_article():
    inner = "".join(f"<p>{t}</p>" for t in BODY)
    page = f"<article>{inner}<section id='comment-on-policy'><h2>Policy</h2><p>A short remark.</p></section><div class='post-comments'><p>I disagree, as a reader.</p></div></article>"
    assert html.main_text(page).split("\n\n") == [*BODY, "Policy", "A short remark."]


def test_article_header_and_page_header():
    inner = "".join(f"<p>{t}</p>" for t in BODY)
    page = f"<body><header><h1>The Site</h1></header><article><header><h1>Title</h1></header>{inner}<footer>Filed under things.</footer></article></body>"
    assert html.main_text(page).split("\n\n") == ["Title", *BODY]
    assert html.main_text(f"<body><h1>Title</h1><div class=q>{inner}</div><div class=r>{MENU}</div></body>").split("\n\n") == ["Title", *BODY]


def test_form_around_a_page():
    inner = "".join(f"<p>{t}</p>" for t in BODY)
    assert html.main_text(f"<form action=x><div>{MENU}</div><div>{inner}</div></form>").split("\n\n") == BODY
    assert html.main_text(f"<div>{inner}<form><p>Your name, please.</p></form></div>").split("\n\n") == BODY


def test_links_alone_are_no_content():
    assert html.main_text(f"<div>{MENU}</div>") == "" and html.main_text("<nav>Go, there.</nav><p>Text, here.</p>") == "Text, here."


def test_repeated_rows_empty_table_and_long_pages(spark):
    page = "<article>" + "".join(f"<p>{t}</p>" for t in BODY) * 500 + "</article>"
    df = spark.createDataFrame([(1, page, "mine"), (1, page, "mine"), (None, "<p></p>", "x")], "page_id long, html string, n_chars string")
    got = html.extract(df)
    assert got.columns == ["page_id", "text", "n_chars"] and sorted(r.n_chars for r in got.collect()) == [0, *[len("\n\n".join(BODY * 500))] * 2]
    assert html.extract(df.limit(0)).count() == 0
