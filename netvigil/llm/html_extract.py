"""Main text of web pages by line-block distribution (operator 9).

Markup is stripped to lines: one per block of the page, in page order, with
character references decoded and white space made single spaces.  What the markup
itself names as apart from the article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) gives lines without length: elements, names of which every word
but those for boxes says so, articles inside an article, and menus known by nothing but
links in their items.  The name of a wrapper around an article says nothing about the
article.  The lengths are summed over sliding windows of ``WINDOW`` lines; a surge is where a
window's sum climbs over the page's threshold, a dive where the sum falls to nothing.
Blocks that stand apart make the dives, so they do not end the article: the text from
the first surge to the dive after the last one is kept, short lines included.  Where
the page marks its article (article, main), it runs over the lines marked so.

Defined results: a null or empty page, and one without text, gives the empty string;
rows that repeat a page_id are extracted each; malformed markup is read as far as it
goes (an unclosed script or comment ends with the page); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from netvigil.llm.common import prepare

WINDOW = 3
#: A surge needs a window of this many code points, or this share of the page's heaviest window.
SURGE_CHARS, SURGE_SHARE = 80, 0.15

# Elements that start a new line of text.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
search section select summary table tbody td tfoot th thead title tr ul""".split())
# Elements whose content is no text of the article.
APART = frozenset("""aside button canvas dialog footer form header head iframe menu nav noscript object select svg
template textarea title""".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that name what is apart from the article.
_WORD = re.compile(r"ads?|adsby\w*|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|gdpr|ccpa|consent|notices?|alerts?|popups?|modal|overlay|"
                   r"newsletters?|subscri\w+|sidebars?|side|aside|nav|navbar|topbar|appbar|navigation|menus?|breadcrumbs?|header|masthead|footer|foot|"
                   r"comments?|commenting|disqus|replies|respond|share|sharing|social|related|recommend\w*|widgets?|pager|pagination|tags|toolbar|"
                   r"complementary|contentinfo|search|login|signup")
#: Words before, behind and between them that only say where, whose or what kind of box it is.
_BOX = frozenset("""site page main global top bottom left right primary secondary wp user users reader readers post posts article articles story google
area bar block box buttons column container content form group inner item items law links list panel policy region row section
slot stories thread unit wrap wrapper zone""".split())
#: A name with one of these in front or behind speaks of a state or of something else ("has-sidebar", "comments-open", "related-work").
_DENIED = frozenset("no not has have with without is hide show enable disable".split())
_STATE = frozenset("open opened closed fixed sticky on off active enabled disabled visible ready loaded work works".split())
#: The head of an article holds its title.
_OWN = frozenset("post posts article articles story entry".split())
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_NUMBERED = re.compile(r"\d+(?:x\d+)?$")


@lru_cache(maxsize=50_000)
def _says_apart(token: str) -> bool:
    """Whether a token of class, id or role names something apart: besides words for boxes all its words do."""
    words = [w for w in (_NUMBERED.sub("", p).lower() for p in _PARTS.split(token)) if w]
    if not words or words[0] in _DENIED or words[-1] in _STATE:
        return False
    if "".join(words) in ("topbar", "navbar"):
        return True
    left = [w for w in words if w not in _BOX]
    if left == ["header"] and _OWN & set(words):
        return False
    return bool(left) and all(_WORD.fullmatch(w) for w in left)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _named_apart(attrs: str, heading: bool) -> bool:
    """Whether a name says so; the ids of headings are made from their text and say nothing."""
    if not attrs or attrs == "/":
        return False
    return any(_says_apart(t) for kind, a, b, c in _ATTR.findall(attrs) if not (heading and kind.lower() == "id")
               for t in html.unescape(a or b or c or "").split())


@dataclass(frozen=True)
class _Open:
    """An open element, with what holds below it for all the elements it stands in."""
    name: str
    flushes: bool
    apart: bool = False
    named: bool = False  # apart by the name of a wrapper only, which an article inside clears
    article: bool = False  # in an article or main element
    nested: bool = False  # in an article element
    heading: bool = False
    item: bool = False  # in a list item
    link: bool = False


#: So many list items in a row that hold a link and nothing else are a menu where no article is around them.
MENU_ITEMS = 3


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, apart, in article) of every block that has text."""
    out: list[tuple[str, bool, bool]] = []
    bare: list[bool] = []  # list items of which all text is a link
    root = _Open("", False)
    open_, count = [root], Counter()
    held: list[tuple[str, bool]] = []

    def flush():
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            top = open_[-1]
            out.append((text, top.apart or top.named, top.article))
            bare.append(top.item and not top.article and all(link or not t.strip() for t, link in held))
        held.clear()

    def close(i: int):
        count.subtract(x.name for x in open_[i:])
        del open_[i:]

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        held.append((page[at:m.start()], open_[-1].link))
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                held.append((html.escape(m.group()[9:].removesuffix("]]>")), open_[-1].link))
            continue
        if name in BLOCKS:
            flush()
        if m.group(1):  # an end tag closes its element and what is open inside it
            if not count[name]:
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    if any(x.flushes for x in open_[i:]):
                        flush()
                    close(i)
                    break
                if open_[i].name in ("article", "main", "body") and name not in ("html", "body", "main"):
                    break  # a stray end tag does not close the article around it
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            at = end.end()  # no text of an article stands in these
            continue
        if name in VOID or m.group(3).rstrip().endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # a new one ends one that is open
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    close(i)
                    break
                if open_[i].name in BLOCKS:
                    break
        up = open_[-1]
        own = name in ("article", "main")
        apart = (name in APART and not (name == "header" and up.article)) or bool(_HIDDEN.search(m.group(3)))
        apart = apart or (name == "article" and up.nested)  # articles in an article are its readers' comments
        heading = up.heading or name in _HEADINGS
        named = not apart and _named_apart(m.group(3), heading)
        if (apart or named) and name not in BLOCKS:
            flush()
        whole = name in ("html", "body", "main") or (name == "article" and not up.nested)
        open_.append(_Open(name, name in BLOCKS or apart or named, up.apart or (apart and not whole),
                           not (own and not up.article) and (up.named or (named and not whole)), up.article or own,
                           up.nested or name == "article", heading, up.item or name == "li", up.link or name == "a"))
        count[name] += 1
    held.append((page[at:], open_[-1].link))
    flush()
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and bare[j]:
            j += 1
        if j - i >= MENU_ITEMS:
            out[i:j] = [(text, True, inside) for text, _, inside in out[i:j]]
        i = max(i + 1, j)
    return out


def main_text(page: str | None) -> str:
    """The kept lines of one whole page, joined by line feeds."""
    lines = lines_of(page or "")
    marked = any(inside and not apart for _, apart, inside in lines)
    # what stands apart, or outside a marked article, has no length in the distribution
    length = [0 if apart or (marked and not inside) else len(text) for text, apart, inside in lines]
    if not any(length):
        return ""
    sums = [sum(length[max(0, i - WINDOW + 1):i + 1]) for i in range(len(length))]
    lo, hi = None, -1
    surge = 0 if marked else min(SURGE_CHARS, SURGE_SHARE * max(sums))
    i = 0
    while i < len(lines):
        if not length[i] or sums[i] < surge:
            i += 1
            continue
        j = i  # to the dive: a window whose sum is nothing
        while j + 1 < len(lines) and (marked or sums[j + 1] > 0):
            j += 1
        if lo is None:
            lo = i
            while lo > 0 and length[lo - 1]:  # short lines that lead up to the surge
                lo -= 1
        hi = j
        i = j + 1
    return "\n".join(lines[k][0] for k in range(lo, hi + 1) if length[k])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    import pyarrow as pa

    prepare(pages.sparkSession)
    src = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
