"""Names of wrappers and headings do not drop the article (operator 9)."""

import pytest

from netvigil.llm import html_extract

BODY = "The harbour was quiet that morning and the boats lay still at their moorings."


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "no-sidebar", "page-header-fixed", "comments-open", "client-side", "sidebar"])
def test_wrapper_names_do_not_drop_the_article(wrapper):
    page = f"<body><div class='{wrapper}'><article><p>{BODY}</p><div class='ad'>Buy now</div></article></div></body>"
    assert html_extract.main_text(page) == BODY
    if wrapper != "sidebar":
        assert html_extract.main_text(page.replace("article", "section")) == BODY


@pytest.mark.parametrize("name", ["related-work", "search", "login"])
def test_heading_ids_do_not_drop_headings(name):
    for head in (f"<h2 id='{name}'>Title</h2>", f"<h2><span id='{name}'>Title</span></h2>"):
        assert html_extract.main_text(f"<article>{head}<p>{BODY}</p></article>") == f"Title\n{BODY}"


@pytest.mark.parametrize("block", ["<div class='ad'>x</div>", "<ul class='share-buttons'><li>x</li></ul>", "<div class='box sidebar'>x</div>", "<div id='site-footer'>x</div>",
                                   "<div class='related'><article>x</article></div>", "<div hidden><p>x</p></div>", "<aside><p>x</p></aside>"])
def test_what_is_named_apart_in_an_article_stays_out(block):
    assert html_extract.main_text(f"<article><p>{BODY}</p>{block}</article>") == BODY


def test_hidden_and_aside_wrappers_keep_their_articles_apart():
    for wrapper in ("<div hidden>", "<aside>"):
        assert html_extract.main_text(f"{wrapper}<article><p>x</p></article></{wrapper[1:4]}{'de>' if 'aside' in wrapper else '>'}<article><p>{BODY}</p></article>") == BODY
