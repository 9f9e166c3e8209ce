"""Main text by line-block distribution: containers, thresholds between blocks, pages without telling tags or classes."""

import collections
import random
import re

import pytest

from tagloom.llm.html_main import _regions, main_text

WORDS = "A sentence of the article that has words enough to count as its text."
BODY = f"<h1>Title</h1><p>{WORDS}</p><p>Second.</p>"
WANT = f"Title\n\n{WORDS}\n\nSecond."


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'class="content has-sidebar"', 'class="post comments-open"', 'data-x="hidden"', 'class="wp-block-group social-wrapper"', 'class="content-sidebar-wrap"', 'class="share"'])
def test_layout_containers_keep_their_text(attributes):
    assert main_text(f"<body><nav>Home</nav><div {attributes}>{BODY}</div><footer>x</footer></body>") == WANT
    assert main_text(f"<body><nav>Home</nav><div {attributes}><article>{BODY}</article></div><footer>x</footer></body>") == WANT


def test_paragraphs_with_everyday_class_words():
    for name in ("share price", "related", "social", "search", "alert"):
        assert main_text(f'<body><article>{BODY}<p class="{name}">The price of a share rose.</p></article></body>') == f"{WANT}\n\nThe price of a share rose."
        assert main_text(f'<body><article>{BODY}<p class="{name}"><a href="x">Share this</a></p></article></body>') == WANT


def test_comments_longer_than_the_article():
    comments = "".join(f'<li class="comment"><p>{WORDS} {i} {WORDS}</p></li>' for i in range(20))
    text = "\n\n".join(f"{WORDS} {i}" for i in range(5))
    paragraphs = "".join(f"<p>{WORDS} {i}</p>" for i in range(5))
    for holder in ('<div id="comments">%s</div>', '<section class="comment-list">%s</section>', '<div class="post-comments">%s</div>'):
        assert main_text(f"<body><div>{paragraphs}</div>{holder % comments}</body>") == text
        assert main_text(f"<body><article>{paragraphs}{holder % comments}</article></body>") == text


def test_nothing_but_parts_beside_an_article():
    for part in ("<nav>%s</nav>", "<footer>%s</footer>", "<aside>%s</aside>", '<div class="cookie-notice">%s</div>', "<form>%s</form>", '<div class="footer">%s</div>'):
        assert main_text(f"<body>{part % ('<p>' + WORDS + '</p>')}</body>") == ""
    assert main_text('<ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul>') == ""


def test_form_around_a_page():
    assert main_text(f'<body><form id="f"><div class="top"><input><a href="x">Home</a></div><div>{BODY}<p>{WORDS} And more of it.</p></div></form></body>') == f"{WANT}\n\n{WORDS} And more of it."


def test_regions_are_those_of_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        length = [rng.choice([0, 0, 3, 12, 30, 80]) for _ in range(rng.randint(1, 30))]
        high = [sum(length[i : i + 3]) >= 40 for i in range(len(length))]
        want = {i for i, ok in enumerate(high) if ok}
        got = [set(range(a, b)) for a, b in _regions(length, 40)]
        assert set().union(*got) == want and sum(map(len, got)) == len(want)
        assert all(max(x) + 1 < min(y) for x, y in zip(got, got[1:]))


def test_pages_without_telling_tags_or_classes():
    """Recall and precision in words where every container is a div without attributes."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."
    found, right, want = 0, 0, 0
    for _ in range(200):
        article = [say(rng.randint(4, 9)), *(say(rng.choice([2, 8, 30, 60])) for _ in range(rng.randint(4, 14)))]
        menu = "".join(f'<li><a href="/{i}">{say(1)}</a></li>' for i in range(rng.randint(3, 12)))
        body = f"<h1>{article[0]}</h1>" + "".join(f"<p>{t}</p>" for t in article[1:])
        page = f"<html><body><div><ul>{menu}</ul></div><div>{say(6)}</div><div>{body}</div><div>{say(8)}</div></body></html>"
        text = main_text(page)
        a, b = collections.Counter(" ".join(article).split()), collections.Counter(text.split())
        found, right, want = found + sum(b.values()), right + sum((a & b).values()), want + sum(a.values())
    assert right / want > 0.99 and right / found > 0.97


def test_very_long_and_broken_pages():
    paragraphs = [f"{WORDS} {i}" for i in range(20_000)]
    assert main_text("<body><div>" + "".join(f"<p>{t}" for t in paragraphs)) == "\n\n".join(paragraphs)
    deep = "<div>" * 5000 + f"<p>{WORDS}</p>"
    assert main_text(deep) == WORDS
    assert main_text("<") == "<" and main_text("<p") == "" and re.sub(r"\s", "", main_text("<p>a<b>c</p></i></div>")) == "ac"


SENTENCE = "The council met on Monday and voted for the plan that it had put off twice in the spring. "


def test_words_of_headings_and_sections_in_an_article_take_nothing_out():
    head = lambda tag, name: f'<{tag} id="{name}">The {name} of the day</{tag}>'
    page = f"<html><body><nav><a href=/a>Front</a></nav><article>{head('h2', 'menu')}<p>{SENTENCE * 3}</p>{head('h2', 'navigation')}<p>{SENTENCE * 3}</p>{head('h3', 'banner')}<section id='consent'><p>{SENTENCE * 4}</p></section><section id='comments'><p>{SENTENCE}first!</p></section></article></body></html>"
    got = main_text(page)
    assert all(f"The {x} of the day" in got for x in ("menu", "navigation", "banner")) and got.count("Monday") == 10 and "first!" not in got and "Front" not in got


def test_articles_of_one_size_are_parts_of_one_text():
    parts = "".join(f"<article><p>Part {i}. {SENTENCE * 3}</p></article>" for i in range(3))
    got = main_text(f"<html><body><nav><a href=/a>Front</a></nav>{parts}<footer>All rights</footer></body></html>")
    assert [f"Part {i}" in got for i in range(3)] == [True] * 3 and "Front" not in got and "rights" not in got
    teaser = main_text(f"<html><body><article><p>{SENTENCE * 9}</p></article><article><p>Read on: {SENTENCE}</p></article></body></html>")
    assert "Read on" not in teaser and teaser.count("Monday") == 9
