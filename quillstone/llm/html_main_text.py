"""Main text of web pages by two-pass block rules.

First pass: each block is good, bad or undecided from its markup, link density, length and stop-word density. <article> and <main>
are a prior only: their blocks need less length and fewer stop words, unless the page's only sure text lies outside of them.
Second pass: undecided blocks take the label of the nearest decided neighbour on their side (in or out of an article); without
one, the prior's.
A container whose class, id or role marks boilerplate goes with all it holds, unless it holds the page's article or half of its
sure text: a wrapper such as "page no-sidebar" or "layout has-comments" condemns nothing.

The listed function words are evidence, not a condition. A block of another script than Latin is judged by length and links. Where
blocks without listed words hold more of a page than those with them, the page is in another language, and its function words are
estimated as words of at most three small letters. A page on which nothing is sure keeps all its undecided blocks.

Null and empty html give an empty text; unclosed tags, scripts and comments end with the page; where the quotes of a tag do not
balance, it ends at the next >. A very long page is one row of one task; time grows with its length. An empty table gives an
empty result. Repeated rows give repeated results, ties between neighbours go to the good one; extra columns are not read, whatever
their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

# Frequent function words of the languages covered.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has he in is it its of on or that the this to was were will with not but his her they we you i
    le la les l un une des du de et à au aux en est que qui dans pour par sur avec pas ce se sa son ne il elle
    der die das den dem des ein eine einer eines und in im ist zu von mit sich nicht auf für als auch es an er sie
    el los las y del al que se por con para una su lo como más no es o
    """.split()
)
# Elements whose content is never main text, whatever surrounds it.
DROPPED = frozenset("nav footer aside form button select option textarea label fieldset dialog noscript template iframe object svg canvas audio video map head title menu".split())
# Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class and id words that mark boilerplate: a whole token, or its first or last part ("cookie-notice", "ad_top").
MARKED = frozenset(
    """
    ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget
    widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe signup login
    share sharing social related recommended pagination pager copyright skip hidden complementary contentinfo disclaimer
    """.split()
)
#: The same for reader comments, which may well be longer than the article.
REMARKS = frozenset("comment comments reply replies respond disqus discussion".split())
#: Tokens that only say what a container has or lacks.
NEUTRAL = frozenset("no has have with without is not hide show layout page".split())
SWITCHES = frozenset("off on none enabled disabled open closed".split())
#: Elements that go with all they hold, unless the page's article itself lies inside them.
WRAPPERS = frozenset("form fieldset header".split())
_VALUE = r"(?:=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>\"'])*+"
_RAW = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)\b(?:{_VALUE}|[^>]*)>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag; where its quotes don't balance, it ends at the next >.
_TAG = re.compile(rf"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_VALUE}(?=>)|[^>]*)|[!?][^>]*)>")
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")

#: Letters of scripts that put no spaces between words (Thai to Burmese, Khmer, kana, Han, Hangul): each says about as much as a few others.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
WIDE_MORE = 2.0
#: Thresholds of the first pass.
MAX_LINKS, SHORT, LONG, STOPS_LOW, STOPS_HIGH = 0.4, 70, 200, 0.05, 0.15


def marks(named: str) -> int:
    """What class, id and role say of an element: 0 nothing, 1 boilerplate, 2 reader comments."""
    found = 0
    for token in named.lower().split():
        parts = [x for x in re.split(r"[-_:]+", token) if x]
        if not parts or parts[0] in NEUTRAL or parts[-1] in SWITCHES:
            continue
        for word in (token, parts[0], parts[-1]):
            found = max(found, 2 if word in REMARKS else 1 if word in MARKED else 0)
    return found


def blocks(page: str) -> tuple[list[dict], list[dict]]:
    """(text blocks in page order, condemned containers).

    A block has its text, whether it is a heading or a paragraph, its link share, whether it lies in an article, and the
    innermost condemned container around it (-1: none). A container has the next one around it, what condemned it, and
    whether it holds an article, a main element or a first-level heading.
    """
    page = _RAW.sub(" ", page)
    found: list[dict] = []
    condemned: list[dict] = []
    stack: list[tuple[str, int, bool, int]] = []  # name; innermost condemned container, in an article, condemned inline elements: each with those around
    opened: Counter = Counter()
    text: list[str] = []
    links, heading, para, anchors = 0, False, False, 0
    top = ("", -1, False, 0)

    def close():
        nonlocal links, text
        if text:
            said = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if said:
                found.append({"text": said, "heading": heading, "para": para, "links": min(1.0, links / len(said)), "in": top[1], "article": top[2]})
        text, links = [], 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not top[3]:
            piece = page[at : m.start()]
            text.append(piece)
            if anchors:
                links += len(_SPACE.sub(" ", html.unescape(piece)).strip())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        block = name in BLOCKS
        if block:
            close()
            para = name == "p" and not m[1]
        if m[1]:
            if name == "a":
                anchors = max(0, anchors - 1)
            if opened[name]:
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        break
                top = stack[-1] if stack else ("", -1, False, 0)
            if name in HEADINGS:
                heading = False
        elif name not in VOID and not m[3].endswith("/"):
            if name == "a":
                anchors += 1
                continue
            if name == "p":
                anchors = 0
                continue
            if name in HEADINGS:
                heading = True
                if name == "h1" and top[1] >= 0:
                    condemned[top[1]]["title"] = True
                continue
            told = marks(" ".join("".join(x) for x in _NAMED.findall(m[3]))) if name not in ("html", "body", "main") else 0
            article = name == "main" or name == "article" and told != 2
            if article and top[1] >= 0:
                condemned[top[1]]["main" if name == "main" else "article"] = True
            why = "tag" if name in DROPPED and name not in WRAPPERS else "comments" if told == 2 else "class" if told and name != "article" or name in WRAPPERS and not (name == "header" and top[2]) else ""
            if why:
                condemned.append({"up": top[1], "why": why, "article": False, "main": False, "title": False})
            if block or why:
                top = (name, len(condemned) - 1 if why else top[1], top[2] or article, top[3] + (1 if why and not block else 0))
                stack.append(top)
                opened[name] += 1
    if at < len(page) and not top[3]:
        text.append(re.sub(r"<[^<>]*\Z", "", page[at:]))
    close()
    return found, condemned


def boilerplate(found: list[dict], condemned: list[dict], other: bool = False) -> list[bool]:
    """Of each container, whether it stays condemned: by its own mark or by one around it.

    Its class alone does not condemn a container that holds an article, a main element or half of the page's sure text; reader
    comments must hold a main element, or half of the sure text with the page's title.
    """
    good = [0] * len(condemned)
    total = 0
    for b in found:
        if decide(b, False, other):
            total += len(b["text"])
            if b["in"] >= 0:
                good[b["in"]] += len(b["text"])
    for c in range(len(condemned) - 1, -1, -1):  # inner containers come after outer ones
        own, up = condemned[c], condemned[c]["up"]
        if up >= 0:
            good[up] += good[c]
            for key in ("main", "title", *(["article"] if own["why"] != "comments" else [])):
                condemned[up][key] = condemned[up][key] or own[key]
    out: list[bool] = []
    for c, own in enumerate(condemned):
        most = total > 0 and 2 * good[c] >= total
        saved = {"tag": False, "class": own["main"] or own["article"] or most, "comments": own["main"] or most and own["title"]}[own["why"]]
        out.append(not saved or own["up"] >= 0 and out[own["up"]])
    return out


def weight(text: str) -> float:
    """Length in code points, of which those of scripts without spaces between words count more."""
    return len(text) if text.isascii() else len(text) + WIDE_MORE * len(_WIDE.findall(text))


def other_script(text: str) -> bool:
    """Whether most letters are not Latin."""
    if text.isascii():
        return False
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" and not "\u1e00" <= c <= "\u1eff" for c in letters) > len(letters)


def decide(b: dict, prior: bool, other: bool = False) -> bool | None:
    """First pass, for a block outside of boilerplate: True good, False bad, None undecided.

    prior: articles count as likely main text. other: the page is in a language whose function words are not listed.
    """
    if b["links"] > MAX_LINKS:
        return None if b["para"] else False  # a paragraph that is one link follows its neighbours
    size = weight(b["text"])
    if b["heading"] or size < SHORT:
        return None
    words = b["text"].lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stops < STOPS_LOW and other_script(b["text"]):
        return True if size > LONG else None
    if stops < STOPS_HIGH and other:
        stops = max(stops, sum(len(w) <= 3 and w.isalpha() and w.islower() for w in b["text"].split()) / len(words))
    if prior and b["article"]:
        return True if stops >= STOPS_LOW else None
    if stops >= STOPS_HIGH:
        return True if size > LONG else None
    return None if stops >= STOPS_LOW else False


def other_language(found: list[dict]) -> bool:
    """Whether more text is sure by estimated function words alone than by listed ones."""
    listed = sum(len(b["text"]) for b in found if decide(b, False))
    return sum(len(b["text"]) for b in found if decide(b, False, True)) > 2 * listed


def main_text(page: str | None) -> str:
    """The page's main text: good blocks in page order, joined by a blank line."""
    if not page:
        return ""
    found, condemned = blocks(page)
    other = other_language(found)
    gone = boilerplate(found, condemned, other)
    bad = [b["in"] >= 0 and gone[b["in"]] for b in found]
    plain = {b["article"] for b, x in zip(found, bad, strict=True) if not x and decide(b, False, other)}  # the sides with sure text by density alone
    prior = plain != {False}
    said = [False if x else decide(b, prior, other) for b, x in zip(found, bad, strict=True)]
    final = list(said)
    before, after = _nearest(found, said, range(len(found))), _nearest(found, said, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        if said[i] is None:
            # marked boilerplate says nothing about an article's own short blocks
            near = [j for j in (before[i], after[i]) if j is not None and not (b["article"] and bad[j])]
            if not near:
                final[i] = prior and b["article"]
            elif b["links"] > MAX_LINKS:
                final[i] = all(said[j] for j in near)
            elif b["heading"] and after[i] in near:
                final[i] = said[after[i]]
            else:
                least = min(abs(j - i) for j in near)
                final[i] = any(said[j] for j in near if abs(j - i) == least)
    if not any(final):  # nothing is sure: a page of short or sparse blocks
        final = [x is None and b["links"] <= MAX_LINKS for b, x in zip(found, said, strict=True)]
    return "\n\n".join(b["text"] for b, good in zip(found, final, strict=True) if good)


def _nearest(found: list[dict], said: list, order: range) -> list[int | None]:
    """For each block the last decided one of its side that came before it in the given order: one pass."""
    last: dict[bool, int | None] = {False: None, True: None}
    out: list[int | None] = [None] * len(found)
    for i in order:
        out[i] = last[found[i]["article"]]
        if said[i] is not None:
            last[found[i]["article"]] = i
    return out


def _extract(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_main_text(c: Column) -> Column:
    """Column expression: main text of an html column."""
    return F.pandas_udf(_extract, "string")(F.coalesce(c, F.lit("")))


def html_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text and its code points. Map-only: no shuffle."""
    batches(pages.sparkSession)
    out = pages.select(F.col(id_col), F.col(url_col), extract_main_text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
