"""Broken and very long markup, and the windows against brute force."""

import random
import time

import pytest

from lexspark.llm import html_text
from lexspark.llm.html_text import main_text

TEXT = "words of the text go on " * 12


def test_a_link_that_nothing_closes():
    page = f'<body><article><a name="top"><h1>Head</h1><p>{TEXT}</p></article>'
    assert main_text(page) == f"Head\n{TEXT.strip()}"
    page = f"<body><article><a href=x>Up<h1>Head</h1><p>{TEXT}</p><p>See <a href=y>this</a>.</p></article>"
    assert main_text(page).split("\n")[-3:] == ["Head", TEXT.strip(), "See this."]


def test_quotes():
    assert main_text(f"<main><p title=don't>It's {TEXT}</p><p>isn't</p></main>") == f"It's {TEXT.strip()}\nisn't"
    assert main_text(f'<p title="a > b" class=\'c"d\'>{TEXT}</p>') == TEXT.strip()
    assert main_text(f'<p title="open>{TEXT}</p>').endswith("go on")


@pytest.mark.parametrize("part", ["<a ", "<a href=x>", "<div>", "</p>", '<p title="', "<!-", "<!--", "<script", "<title>", "<![CDATA[", "<li>x", "<b></span>", "&#", "<", "=", "x "])
def test_long_pages_take_linear_time(part):
    """Half a megabyte of one piece: a quadratic scan would take minutes."""
    page = part * ((1 << 19) // len(part))
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


def test_a_megabyte_of_open_tags():
    began = time.process_time()
    main_text("<a " * 349_525)
    assert time.process_time() - began < 3  # under one on an idle machine


def _brute(size, whole):
    """Lines reached from a surge before a dive, each window summed anew."""
    n, kept, at = len(size), set(), 0
    window = lambda i: sum(size[k] for k in range(i, min(n, i + html_text.WINDOW)))
    while at < n:
        if size[at] > 0 and (whole or window(at) >= html_text.SURGE):
            back = at
            while back > 0 and at - back < html_text.WINDOW and size[back - 1] > 0 and back - 1 not in kept:
                back -= 1
                kept.add(back)
            end = next((k for k in range(at, n) if window(k) < html_text.DIVE), n)
            kept |= {k for k in range(at, end) if whole or size[k] > 0}
            at = end
        at += 1
    return [i in kept for i in range(n)]


@pytest.mark.parametrize("whole", [False, True])
def test_zones_against_brute_force(whole):
    rnd = random.Random(8)
    for _ in range(400):
        size = [rnd.choice([0, 0, 3, 9, 20, 39, 41, 60, 120, 400]) for _ in range(rnd.randrange(0, 25))]
        assert html_text.zones(size, whole) == _brute(size, whole)


def test_the_distribution_decides_in_an_article_too():
    menu = "".join(f"<li><a href={i}>Related story {i}</a></li>" for i in range(8))
    page = f"<body><article><h1>Head</h1><p>{TEXT}</p><p>And so.</p><ul>{menu}</ul></article></body>"
    assert main_text(page) == f"Head\n{TEXT.strip()}\nAnd so."


def test_marks_change_little_where_texts_are_long():
    body = f"<h1>Head line of it</h1><p>{TEXT}</p><p>{TEXT}</p>"
    assert main_text(f"<body><article>{body}</article></body>") == main_text(f"<body><div>{body}</div></body>")


def test_raw_elements_and_comments():
    page = f"<main><title>T<p>{TEXT}</p><!-- a > b --><noscript>no</noscript><!--> <script>if (a</b) '</p>'</script ><p>x&lt;y</p><textarea>t</textarea>"
    assert main_text(page) == f"T\n{TEXT.strip()}\nx<y"
