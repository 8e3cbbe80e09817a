"""Main text: names of classes, odd quotes, and pages put together at random from an article and what surrounds one."""

import random
import time

import pytest

from siftlake.llm import html_text

BODY = "".join(f"<p>Paragraph {i} of the article, with commas, and enough words to count as prose in it.</p>" for i in range(5))
TEXT = " ".join(f"Paragraph {i} of the article, with commas, and enough words to count as prose in it." for i in range(5))
NOISE = "<p>Read this as well, our sidebar says, at some length and with commas, please.</p>"


@pytest.mark.parametrize("name", ["post no-sidebar", "has-sidebar", "with-comments", "layout", "content hasSidebar", "wp-sidebar-none"])
def test_names_that_tell_what_a_page_has(name):
    assert html_text.main_text(f'<body><div class="{name}">{BODY}</div></body>') == TEXT


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "widget siteSidebar", "post-comments", "related-stories", "cookie-notice", "ad"])
def test_names_that_drop(name):
    assert html_text.main_text(f'<body><div class="content">{BODY}</div><div id="{name}">{NOISE}</div></body>') == TEXT


def test_parts_and_containers_of_an_article():
    part = '<div class="story-related-stats"><p>Numbers of the story, as counted, stand in this part of it.</p></div>'
    assert html_text.main_text(f"<article>{BODY}{part}</article>") == TEXT + " Numbers of the story, as counted, stand in this part of it."
    assert html_text.main_text(f'<body><div id="page-sidebar"><h1>Head</h1><div class="text">{BODY}</div></div></body>').endswith(TEXT)
    assert html_text.main_text(f'<body><div data-class="sidebar" data-state="not hidden">{BODY}</div></body>') == TEXT


@pytest.mark.parametrize("tag", ["<p title=it's>", "<p title='it's'>", '<p title="a"b">', "<p class='>", "<p a=b=c d>", "<p title = 'x > y'>"])
def test_odd_quotes(tag):
    odd = "A paragraph behind an odd tag, with a comma, and length enough."
    got = html_text.main_text(f"<article>{BODY}{tag}{odd}</p>{BODY}</article>")
    assert got == f"{TEXT} {odd} {TEXT}"


def test_random_pages():
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["stone", "river, and", "cloud", "over", "green", "town,"]) for _ in range(n))
    around = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{i}>{words(2)}</a></li>' for i in range(8))}</ul></nav>",
        lambda: f'<div class="{rng.choice(["sidebar", "ads", "widget-area", "social-share"])}"><p>{words(30)}</p></div>',
        lambda: f"<footer><p>{words(25)}</p></footer>",
        lambda: f'<section id="comments"><h2>Comments</h2><p>{words(40)}</p><p>{words(40)}</p></section>',
        lambda: f"<form><label>{words(4)}</label><input><button>Go</button></form>",
        lambda: f"<script>var x = '<p>{words(9)}</p>';</script><style>p {{ }}</style><!-- <p>{words(20)}</p> -->",
    ]
    for _ in range(150):
        parts = [words(rng.randrange(25, 60)) for _ in range(rng.randrange(3, 9))]
        open_, close = rng.choice([("<article>", "</article>"), ('<div class="post-body">', "</div>"), ('<main id="content">', "</main>"), ("<div><div>", "</div></div>")])
        end = rng.choice(["</p>", "", "</P>\n"])
        article = open_ + "".join(f"<p>{x.replace('and', rng.choice(['and', '<b>and</b>', 'an&#100;']))}{end}" for x in parts) + close
        before, after = ([rng.choice(around)() for _ in range(rng.randrange(4))] for _ in range(2))
        assert html_text.main_text(f"<html><head><title>T</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>") == " ".join(parts)


def test_html_with_odd_quotes():
    first, second, third = ("part %d, with commas, and of a length that counts as prose here." % i for i in (1, 2, 3))
    whole = f"{first} {second} {third}"
    for tag in ("<p title=it's>", '<p title="He said "hi" there">', '<p class=""x"">', "<p title='it's>", "<p it's>", '<p title="open>', "<p title=a='b>", '<p title = "a > b" lang=en>'):
        for tail in ("", " don't", ' a " quote'):
            page = f"<article><p>{first}</p>{tag}{second}</p><p>{third}{tail}</p></article>"
            if tag in ('<p title="open>', "<p title='it's>") and ('"' in tail or "'" in tail):
                continue  # a later quote may close the value
            assert html_text.main_text(page) == whole + tail, (tag, tail)
    assert html_text.main_text(f'<p title="open>{first} a " quote') == f'{first} a " quote'
    assert html_text.main_text(f"<p>{first} <é {second}") == f"{first} <é {second}"
    assert html_text.main_text(f"<p>{first}<b title='x") == first


PROSE = "What stands in this part of the article is prose, with a comma, and as long as the paragraphs around it are, or longer still."


@pytest.mark.parametrize("tag", ["section id='related-work'", "div class='social-security'", "p id='share-of-votes'", "div class='consent-theory'"])
def test_names_with_words_of_their_own_need_more_than_a_name(tag):
    kind = tag.split()[0]
    inner = PROSE if kind == "p" else f"<p>{PROSE}</p>"
    assert html_text.main_text(f"<article>{BODY}<{tag}>{inner}</{kind}>{BODY}</article>") == f"{TEXT} {PROSE} {TEXT}"
    links = " ".join(f"<a href=/{i}>Another piece of ours, number {i}, that is worth a look</a>" for i in range(6))
    assert html_text.main_text(f"<article>{BODY}<{tag}>{links}</{kind}></article>") == TEXT
    assert html_text.main_text(f"<article>{BODY}<{tag}>Share this</{kind}></article>") == TEXT


@pytest.mark.parametrize("name", ["related-posts", "social-links", "share-buttons", "newsletter-box", "ad", "cookie-message", "comment-list"])
def test_names_of_page_furniture_decide_alone(name):
    assert html_text.main_text(f"<article>{BODY}<div class='{name}'><p>{PROSE}</p></div></article>") == TEXT


def test_inline_elements_keep_their_text():
    page = f"<article>{BODY}<p>We set <math><mi>x</mi> = 2</math> and press <button>Start</button>, <object data=a.svg>a drawing</object> shows it.</p></article>"
    assert html_text.main_text(page) == f"{TEXT} We set x = 2 and press Start, a drawing shows it."
    assert html_text.main_text(f"<article>{BODY}<form><button>Send</button></form><svg><text>no</text></svg></article>") == TEXT


def test_headers_are_dropped_everywhere():
    assert html_text.main_text(f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{BODY}</article>") == TEXT


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</span>" * 50_000, "<b>" * 50_000 + "<div></div>" * 50_000, "<div>" * 50_000 + "<dt>x</dt>" * 50_000, "<p>" + "<b>" * 50_000 + "</i>" * 50_000])
def test_stray_tags_cost_no_walk(page):
    began = time.perf_counter()
    assert html_text.main_text(f"<article>{BODY}</article>{page}").startswith(TEXT)
    assert time.perf_counter() - began < 20


def test_tables_of_pages(spark):
    rows = [(1, "a", f"<article>{BODY}</article>")] * 2 + [(None, None, None), (2, "b", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "'x' AS order")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(frame).collect())
    assert got == sorted([("1", TEXT, len(TEXT))] * 2 + [("None", "", 0), ("2", "", 0)])
    assert html_text.extract(frame.where("false")).count() == 0
