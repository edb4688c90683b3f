"""What names, nested articles and link lists set apart; deep pages in linear time."""

import time

import pytest

from netvigil.llm.html_extract import main_text

BODY = "".join(f"<p>Paragraph {k} of the article, long enough to be text of it.</p>" for k in range(6))
WANT = "\n".join(f"Paragraph {k} of the article, long enough to be text of it." for k in range(6))
JUNK = """comments-section user-comments post-comments comment-thread wp-comments article-comments left-sidebar sidebar-left sidebar2 page-header
top-nav top-bar nav-main navigation-top google-ads adsbygoogle ad-300x250 ad-container-1 sponsored-content cookie-law gdpr-notice related-articles
siteFooter share-buttons newsletter_form""".split()
KEPT = """has-sidebar no-sidebar page-header-fixed comments-open client-side related-work article-body post-content entry-header article-header headers
advice additional sidecar cookiecutter with-comments story-section""".split()


@pytest.mark.parametrize("name", JUNK)
def test_names_of_what_is_apart(name):
    box = f"<div class='x {name}'><p>This is no text of the article, however long it may be, not at all.</p></div>"
    assert main_text(f"<body><article>{BODY}{box}</article></body>") == WANT
    assert main_text(f"<body>{box}<div>{BODY}</div>{box}</body>") == WANT


@pytest.mark.parametrize("name", KEPT)
def test_names_that_say_something_else(name):
    more = f"<div class='{name}'><p>One more paragraph of this article, as long as the others are.</p></div>"
    assert main_text(f"<body><article>{BODY}{more}</article></body>") == WANT + "\nOne more paragraph of this article, as long as the others are."


def test_articles_in_an_article_are_comments():
    nested = "<article><p>First! A reader wrote this comment of some length below the text.</p></article>" * 2
    assert main_text(f"<main><article>{BODY}{nested}</article></main>") == WANT


def test_a_list_of_links_outside_an_article_is_a_menu():
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Section number {k} of this site</a></li>" for k in range(5)) + "</ul>"
    assert main_text(f"<body>{menu}<div>{BODY}</div>{menu}</body>") == WANT
    inside = main_text(f"<article>{BODY}{menu}</article>")
    assert inside.startswith(WANT) and "Section number 4" in inside
    mixed = "<ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a> and what is said about it</li>" for k in range(5)) + "</ul>"
    assert "Link 4 and what is said about it" in main_text(f"<body><div>{BODY}{mixed}</div></body>")


def test_deep_pages_take_linear_time():
    began = time.time()
    assert main_text("<div>" * 40_000 + BODY + "</x></span>" * 40_000) == WANT
    assert time.time() - began < 5
