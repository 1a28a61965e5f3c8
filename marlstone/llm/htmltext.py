"""Main text of HTML pages from flat text blocks.

A page is cut at its block-level tags. A block is described by its words and link density and those of its neighbours,
by the tag it stands in, and by what its ancestors' tags, classes, ids and roles say they are for. Names count fully where
all their words speak of one purpose ("cookie-notice"), and as a hint where only some do ("related-work") or where the
element is named as main text too. A decision tree, trained on the rule-made labelled table of `labelled_pages`
(`TRAIN_PAGES` pages), tells main text from the rest. The labels there say what a block was made as; names are drawn from
lists of their own, and some blocks have misleading ones or none.

Tags are found in linear time. A quote that is never closed, or only by the next attribute's own, ends its tag at the
first `>`; an element that is left out and never closed, or begins anew before it is closed, holds nothing. Null and empty
pages have empty text, and an empty table gives an empty one. Repeated rows are read each by itself; blocks that score
alike are all kept or all left. Nothing is cut off at any length. Unclosed tags end where their kind begins anew or their
parent ends. Other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import boosting
from marlstone.llm.common import table

TRAIN_PAGES = 600

NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile(r"[>\"']")
#: Elements that are left out with what they hold up to their closing tag; without one, or closed in themselves, they hold nothing.
LEFT_OUT = {t: re.compile(rf"</{t}\s*>", re.I) for t in "noscript template svg iframe object canvas select button audio video textarea title".split()}
#: Elements that hold all up to their closing tag, or to the page's end.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
AGAIN = {t: re.compile(rf"<{t}\b", re.I) for t in LEFT_OUT if t not in ("svg", "object", "template")}
UNQUOTED = re.compile(r"=\s*[^\s\"']*/$")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr input nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Tags that a new one of the group closes.
CLOSES = {t: g for g in (("p", *HEADINGS), ("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in g}

PLACES = ("none", "main", "menu", "header", "footer", "sidebar", "form", "advert", "notice", "comments", "share", "hidden")
BY_TAG = {"article": "main", "main": "main", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "dialog": "notice"}
WORDS = {
    "comments": "comment comments commentlist disqus respond replies reply discussion",
    "advert": "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion adbox adslot",
    "notice": "cookie cookies consent gdpr notice banner alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer dialog toast",
    "share": "share sharing social follow related recommended recommendations",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar pagination pager tabs toolbar",
    "sidebar": "sidebar aside widget widgets complementary rail toc",
    "form": "search login form register",
    "footer": "footer contentinfo copyright legal colophon",
    "header": "header masthead topheader",
    "main": "content article post entry story main maincontent articlebody text",
}
BY_WORD = {w: k for k, ws in reversed(WORDS.items()) for w in ws.split()}
RANK = {k: i for i, k in enumerate(WORDS)}
RIGHTS = re.compile(r"^\W*(?:©|\(c\) |copyright\b)|all rights reserved", re.I)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Words that say nothing of a name's purpose.
PLAIN = frozenset("area b bar block body bottom box btn button buttons col column container desktop el footer form global group head header icon inline inner is item items js large left link links list main menu mobile outer page panel primary right row secondary section site slot small text title top ui unit wrap wrapper".split())
NUMBER = re.compile(r"[a-z]?\d+(?:x\d+)?")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class _Tags:
    """Ends of a page's tags. Every place is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.none_after: dict[str, int] = {}
        self.dead: set[int] = set()

    def find(self, what: str, at: int) -> int:
        if at >= self.none_after.get(what, len(self.page) + 1):
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.none_after[what] = at
        return got

    def end_of(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`, past its `>`; -1 if it has none."""
        first, passed, start = self.find(">", at), [], at
        if first < 0:
            return -1
        while m := STOP.search(self.page, at):
            if m.group() == ">":
                return m.end()
            if m.start() in self.dead:
                break
            passed.append(m.start())
            close = self.find(m.group(), m.end())
            if close < 0:
                at = m.end()
                continue
            inner = self.find(">", m.end())
            if 0 <= inner < close and self.page[close - 1] == "=":  # the quote belongs to another tag's attribute
                return inner + 1
            at = close + 1
        self.dead.update(passed)
        return first + 1 if first >= start else -1


def tags(page: str):
    """(start, end, closing, name, attributes, name of what is left out up to the end or None) of each tag, comment or declaration."""
    at, unclosed, ends = 0, set(), _Tags(page)
    while (start := ends.find("<", at)) >= 0:
        m = NAME.match(page, start)
        if m is None:
            at = start + 1
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                at = close + 3 if close >= 0 else len(page)
            elif page[at : at + 1] in ("!", "?") and (close := ends.find(">", start)) >= 0:
                at = close + 1
            else:
                continue
            yield start, at, "", None, "", None
            continue
        at = ends.end_of(m.end())
        if at < 0:
            return
        name, held, out = m.group(2).lower(), page[m.end() : at - 1], None
        if not m.group(1) and name in RAW:
            close = RAW[name].search(page, at)
            at, out = close.end() if close else len(page), name
        elif not m.group(1) and name in LEFT_OUT:
            out = name
            if name not in unclosed and not (held.endswith("/") and not UNQUOTED.search(held)):
                close = LEFT_OUT[name].search(page, at)
                if close is None:
                    unclosed.add(name)
                elif name not in AGAIN or not AGAIN[name].search(page, at, close.start()):
                    at = close.end()
        yield start, at, m.group(1), name, held, out


def _said(attributes: str) -> tuple[str | None, bool, bool]:
    """What the names of an element speak of, whether a name does so with all its words, and whether one speaks of main text."""
    said, sure, main = None, False, False
    for m in NAMES.finditer(attributes):
        for token in m.group(1).lower().strip("\"'").split():
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=\d)", "-", token)) if w]
            kinds = [BY_WORD[w] for w in words if w in BY_WORD]
            other = [k for k in kinds if k != "main"]
            if other:
                k = min(other, key=RANK.get)
                whole = all(w in BY_WORD or w in PLAIN or NUMBER.fullmatch(w) for w in words)
                if said is None or (whole, -RANK[k]) > (sure, -RANK[said]):
                    said, sure = k, whole
            elif kinds:
                main = True
    return said, sure, main


def place_of(tag: str, attributes: str) -> tuple[str | None, str | None]:
    """What an element says it is for, and what it only hints at."""
    by_tag = BY_TAG.get(tag)
    if not attributes or tag in ("html", "body"):
        return by_tag, None
    if HIDDEN.search(attributes):
        return "hidden", None
    said, sure, main = _said(attributes)
    if said in ("comments", "advert") and sure:
        return said, None
    if by_tag == "main":
        return "main", said
    if by_tag:
        return (said if sure else by_tag), None
    if main:
        return "main", said
    return (said, None) if sure and tag not in ("p", "li", "span") else (None, said)


def blocks(page: str) -> list[tuple[str, int, str, str, bool, bool]]:
    """(text, words in links, place, tag, inside an article, hinted at something else) of each block with text, in page order."""
    out, parts = [], []
    # Each open element knows its tag, the place it is in, whether it is inside an article, and whether a name hints at something else.
    stack: list[tuple[str, str | None, bool, bool]] = []
    held: Counter = Counter()
    link = links = 0
    place, tag_now, inside, hint = "none", "", False, False

    def flush():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, links, place, tag_now, inside, hint))
            parts.clear()
        links = 0

    def look():
        nonlocal place, tag_now, inside, hint
        tag_now, place, inside, hint = stack[-1] if stack else ("", None, False, False)
        place = place or "none"

    def push(tag, own, hinted):
        _, of, within, hints = stack[-1] if stack else ("", None, False, False)
        stack.append((tag, own or of, within or own == "main", bool(hinted) if own else hints or bool(hinted)))
        held[tag] += 1

    def pop(down_to):
        for tag, *_ in stack[down_to:]:
            held[tag] -= 1
        del stack[down_to:]

    def add(text):
        nonlocal links
        parts.append(text)
        if link:
            links += len(text.split())

    end = 0
    for start, after, closing, tag, attributes, gone in tags(page):
        if start > end:
            add(page[end:start])
        end = after
        if gone or tag is None:
            if gone and gone not in ("script", "style", "svg"):
                parts.append(" ")
            continue
        if tag == "a":
            link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag not in INLINE:
            flush()
            link = 0
            if closing:
                if held[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    pop(k)
            elif tag not in VOID:
                group = CLOSES.get(tag)
                if group:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in group:
                            pop(k)
                            break
                        if stack[k][0] not in CLOSES:
                            break
                elif stack and stack[-1][0] in CLOSES["p"]:
                    pop(len(stack) - 1)
                push(tag, *place_of(tag, attributes))
            look()
    if end < len(page):
        add(page[end:])
    flush()
    return out


#: The columns of link densities among the features.
DENSITIES = slice(3, 6)


def features(page_blocks) -> np.ndarray:
    """A row for each block: words and link density of it and its neighbours, its place, its tag, whether the page names
    its main part, whether a name hints at something else, and whether the block speaks of rights. At least one block."""
    n = len(page_blocks)
    words = np.array([len(b[0].split()) for b in page_blocks], float)
    density = np.array([b[1] for b in page_blocks]) / np.maximum(words, 1)
    pad = np.zeros(1)
    around = lambda v: (np.concatenate([pad, v[:-1]]), v, np.concatenate([v[1:], pad]))
    cols = [*around(words), *around(density)]
    cols += [np.array([b[2] == p for b in page_blocks], float) for p in PLACES]
    cols += [np.array([b[3] in HEADINGS for b in page_blocks], float), np.array([b[3] == "li" for b in page_blocks], float), np.array([b[3] == "p" for b in page_blocks], float), np.array([b[4] for b in page_blocks], float)]
    cols.append(np.array([b[0][-1] in ".!?:;\"'»…)”" for b in page_blocks], float))
    cols.append(np.full(n, float(any(b[4] for b in page_blocks))))
    cols.append(np.array([b[5] for b in page_blocks], float))
    cols.append(np.array([bool(RIGHTS.search(b[0])) for b in page_blocks], float))
    return np.stack(cols, axis=1)


#: Names that pages have, for training: what they are for, and some of main text that sound like something else.
SEEN_NAMES = {
    "comments": "comments comment-list commentlist disqus_thread replies comment reader-comments respond discussion",
    "advert": "ad ads ad-slot advert sponsored promo-box adsbygoogle ad-banner-300x250 advertisement billboard outbrain",
    "notice": "cookie-notice cookie-banner gdpr notice newsletter-signup alert-box popup consent-overlay paywall privacy-strip",
    "share": "share social-links sharing related-posts recommended follow-us teaser-row",
    "menu": "nav navbar main-nav navigation menu breadcrumbs topbar pagination site-map-list",
    "sidebar": "sidebar sidebar-left widget widget-2 rail toc widget-area col-extra",
    "form": "search-form login register search contact-box",
    "footer": "footer site-footer copyright legal colophon imprint",
    "header": "header masthead page-header site-header brand-strip",
    "main": "content article post entry story main-content article-body entry-content post-text text copy prose",
}
MISLEADING = ("story widgets-2", "related-work", "footer-note", "article-text share-story", "notice-board-history", "sidebar-story-essay", "content social-study", "header-paragraph", "search-results-discussed", "ad-hoc-analysis", "menu-of-the-day", "promotion-of-health", "comment-on-law", "post entry widget", "legal-history")


def labelled_pages(seed: int = 3, n: int = TRAIN_PAGES):
    """Pages by rule, as lists of (label, html): 1 for main text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "en", "ou", "la", "der", "ti", "on", "re", "que", "st")) for _ in range(rng.randrange(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b))).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{say(1, 4)}</a>'

    def wrap(label, tag, attributes, inner):
        return [(None, f"<{tag}{attributes}>"), *inner, (None, f"</{tag}>")]

    def prose(k):
        out = [(1, f"<h1>{say(2, 9)}</h1>")]
        for _ in range(k):
            kind = rng.random()
            if kind < 0.75:
                out.append((1, f"<p>{say(1, 90)} {link() if rng.random() < 0.2 else ''} {say(2, 30)}</p>"))
            elif kind < 0.85:
                out.append((1, f"<h2>{say(1, 7)}</h2>"))
            elif kind < 0.95:
                out += [(1, f"<li>{say(1, 14)}</li>") for _ in range(3)]
            else:
                out.append((1, f"<blockquote>{say(3, 30)}</blockquote>"))
        return out

    def junk(kind):
        if kind == "menu":
            return [(0, f"<li>{link()}</li>") for _ in range(rng.randrange(2, 9))]
        if kind in ("comments", "notice", "advert", "sidebar", "header", "footer", "hidden"):
            head = [(0, f"<{'h1' if kind == 'header' else 'h3'}>{say(1, 4)}</{'h1' if kind == 'header' else 'h3'}>")] * (rng.random() < 0.4)
            return head + [(0, f"<p>{say(1, 50)} {link() if rng.random() < 0.3 else ''}</p>") for _ in range(rng.randrange(1, 4))]
        return [(0, f"<p>{say(1, 5)}</p>"), (0, f"<li>{link()}</li>")]

    attributes = {k: [f' {rng.choice(("class", "id", "class"))}="{w}"' for w in ws.split()] for k, ws in SEEN_NAMES.items()} | {"hidden": [" hidden", ' style="display:none"']}
    tags = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "notice": "dialog"}
    for i in range(n):
        page = []
        kinds = [k for k in PLACES[2:] if rng.random() < 0.5]
        rng.shuffle(kinds)

        def aside(k):
            if k in tags and rng.random() < 0.5:
                return wrap(0, tags[k], "", junk(k))
            named = "" if rng.random() < 0.05 else rng.choice(attributes[k])
            return wrap(0, rng.choice(("div", "section")), named, junk(k))

        cut = rng.randrange(len(kinds) + 1)
        for k in kinds[:cut]:
            page += aside(k)
        body = prose(rng.randrange(0, 9))
        if rng.random() < 0.4 and len(body) > 2:  # part of it in an element whose name misleads
            at = rng.randrange(1, len(body))
            inner = [(1, f"<p>{say(9, 60)}</p>") for _ in range(rng.randrange(1, 4))]
            body[at:at] = wrap(1, "div", f' class="{rng.choice(MISLEADING)}"', inner) if rng.random() < 0.7 else [(1, f'<p class="{rng.choice(MISLEADING)}">{say(9, 60)}</p>')]
        for k in ("advert", "share", "form", "notice", "comments", "sidebar"):
            if rng.random() < 0.2:
                at = rng.randrange(1, len(body) + 1)
                body[at:at] = aside(k)
        layout = i % 5
        stray = [(0, f"<p>{say(1, 60)}</p>")]
        if layout < 2:
            if rng.random() < 0.4:  # a heading in the article's own header, above a byline
                body = [*wrap(1, "header", "", [body[0], (0, f"<p>{say(2, 7)}</p>")]), *body[1:]]
            page += stray * (rng.random() < 0.4) + wrap(1, rng.choice(("article", "main")), "", body) + stray * (rng.random() < 0.4)
        elif layout < 4:
            page += stray * (rng.random() < 0.4) + wrap(1, "div", rng.choice(attributes["main"]), body) + stray * (rng.random() < 0.4)
        else:  # no names at all: only words and links tell
            page = [(0, f"<li>{link()}</li>") for _ in range(4)] + [(lab, re.sub(r"<(/?)p>", rf"<\1{rng.choice(('p', 'div'))}>", h)) for lab, h in body if lab] + [(0, f"<div>{link()} {link()}</div>")]
            page.append((0, f"<div>{rng.choice(('&copy; 2024', 'Copyright', '©'))} {say(1, 9)}</div>"))
        for k in kinds[cut:]:
            page += aside(k)
        yield page


@lru_cache(maxsize=1)
def model() -> dict:
    x, y = [], []
    for page in labelled_pages():
        found = blocks("".join(h for _, h in page))
        labels = [label for label, _ in page if label is not None]
        if len(found) == len(labels):
            if found:
                x.append(features(found))
                y += labels
    return boosting.fit(np.concatenate(x), np.array(y, float), trees=1, depth=9, rate=1.0, least=4)[0]


#: What may stand in an article and be all links.
TEXT_TAGS = frozenset(("p", "blockquote", "pre", "dd", "dt", "td", "th", "figcaption", *HEADINGS))


def kept(found: list[tuple], tree: dict) -> np.ndarray:
    """Which blocks are main text. A paragraph of an article that only its links speak against is."""
    x = features(found)
    keep = boosting._apply(tree, x) > 0
    again = np.array([not k and b[2] == "main" and b[4] and not b[5] and b[3] in TEXT_TAGS for k, b in zip(keep, found, strict=True)])
    if again.any():
        x[:, DENSITIES] = 0
        keep |= again & (boosting._apply(tree, x) > 0)
    return keep


def main_text(page: str, tree: dict) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b[0] for b, k in zip(found, kept(found, tree), strict=True) if k)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    tree = model()

    def run(frames):
        for b in frames:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [main_text(x, tree) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")


def op5_html(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
