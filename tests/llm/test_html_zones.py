"""Line blocks on pages that mark an article."""

from lexspark.llm.html_text import main_text

BODY = [f"Paragraph {i} of the body has words enough to make the lines around it surge." for i in range(4)]


def test_a_body_outside_the_article_is_kept():
    teasers = "<article><h2>Teaser one</h2></article><article><h2>Teaser two</h2></article>"
    body = "<div class='x'>" + "".join(f"<p>{p}</p>" for p in BODY) + "</div>"
    page = "<body><p><a href=x>Home</a></p>%s%s<p>Short end</p></body>"
    got = main_text(page % (teasers, body)).split("\n")
    assert [x for x in got if x in BODY] == BODY and "Home" not in got
    got = main_text(page % (body, teasers)).split("\n")
    assert [x for x in got if x in BODY] == BODY and "Home" not in got


def test_short_lines_around_an_article_are_left_out():
    page = "<body><p>Site line</p><article>" + "".join(f"<p>{p}</p>" for p in BODY) + "</article><p>Short end</p></body>"
    assert main_text(page).split("\n") == BODY
