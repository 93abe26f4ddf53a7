"""What stays inside an article, block building against a plain one, and pages without marks."""

import html
import random
import re

import pytest

from lexspark.llm.html_text import lines_of, main_text

TEXT = "words of the text go on " * 12
PROSE = "A part of the article that says at some length what it has to say, in whole sentences, as articles do; and then some more of it."


def page(part: str, tag: str = "article") -> str:
    return f"<body><nav><a href=x>Home</a></nav><{tag}><h1>Head</h1><p>{TEXT}</p>{part}</{tag}><footer>foot</footer></body>"


@pytest.mark.parametrize("name", ["discussion", "related-work", "social-history", "legal-aspects", "search-results", "share-price", "recommended-dose", "tags-and-types", "notice-period", "menu-engineering", "replyRates"])
@pytest.mark.parametrize("attr", ["id", "class"])
def test_parts_of_an_article_are_not_dropped_by_name(name, attr):
    got = main_text(page(f'<section {attr}="{name}"><h2 {attr}="{name}">Part</h2><p>{PROSE}</p><p>Short.</p></section><p>End.</p>'))
    assert got == f"Head\n{TEXT.strip()}\nPart\n{PROSE}\nShort.\nEnd."


@pytest.mark.parametrize("name", ["ad", "ads top", "ad-slot", "comments", "comment-list", "cookie-notice", "newsletter-signup", "sidebar", "adBanner"])
def test_what_is_named_as_a_whole_goes(name):
    assert main_text(page(f'<div class="{name}"><p>{PROSE}</p></div><p>End.</p>')) == f"Head\n{TEXT.strip()}\nEnd."


@pytest.mark.parametrize("name", ["related", "share-buttons", "social links", "tags", "related-posts", "notice"])
def test_names_that_can_be_either_go_without_a_surge(name):
    links = "".join(f"<li><a href={i}>Story {i}</a></li>" for i in range(9))
    assert main_text(page(f'<div class="{name}"><h3>More</h3><p>Some words</p><ul>{links}</ul></div><p>End.</p>')) == f"Head\n{TEXT.strip()}\nEnd."


def test_links_under_a_heading_and_formulas_stay():
    refs = "".join(f"<li><a href={i}>Reference {i}</a></li>" for i in range(8))
    got = main_text(page(f"<p>So <math><mi>E</mi><mo>=</mo><msup><mi>m</mi><mn>2</mn></msup></math> holds.</p><h2>References</h2><ol>{refs}</ol>"))
    assert got.split("\n")[2:] == ["So E=m2 holds.", "References", *[f"Reference {i}" for i in range(8)]]


def plain_blocks(markup: str) -> list[str]:
    """Blocks of well-formed markup of p, div and inline elements, by cutting at the tags of blocks."""
    parts = re.split(r"</?(?:p|div|h2|ul|li)[^>]*>", re.sub(r"<br>", " ", markup))
    return [x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x]


def test_blocks_against_a_plain_builder():
    rnd = random.Random(2)

    def inline(depth=0):
        out = []
        for _ in range(rnd.randint(1, 4)):
            x = rnd.choice(["word ", "a&amp;b ", "x &lt; y\n", "ñ<br>o ", "&#233;t&eacute; "])
            out.append(f"<{t}>{inline(depth + 1)}</{t}>" if depth < 2 and rnd.random() < 0.3 and (t := rnd.choice(["b", "i", "span", "em"])) else x)
        return "".join(out)

    def block(depth=0):
        if depth > 2 or rnd.random() < 0.5:
            return f"<p>{inline()}</p>" if rnd.random() < 0.7 else f"<h2>{inline()}</h2>"
        inner = "".join(block(depth + 1) for _ in range(rnd.randint(1, 4)))
        return f"<div class=x>{inline()}{inner}{inline()}</div>" if rnd.random() < 0.7 else f"<ul><li>{inline()}</li>{inner}</ul>"

    for _ in range(300):
        markup = "".join(block() for _ in range(rnd.randint(1, 5)))
        assert [t for t, _, _ in lines_of(f"<body>{markup}</body>") if t] == plain_blocks(markup)


def test_a_page_of_short_lines_without_marks():
    lines = [f"Short line {i}." for i in range(5)]
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5))
    assert main_text(f"<body><ul>{links}</ul>" + "".join(f"<p>{x}</p>" for x in lines) + "<p>Yes.</p></body>").split("\n") == [*lines, "Yes."]
