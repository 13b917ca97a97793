"""Main text of web pages.

A page is flattened into text blocks (headings, paragraphs, list items, ...).
Each block is described by its number of words and the share of them inside
links, by the same numbers of its neighbours, by its kind of element, and by
what names of enclosing elements hint at. A decision tree, trained on the
blocks of the labelled pages below, says which blocks are article text.

Every labelled page is learned with its hints, with some and without any: many
pages name nothing, and there the tree must go by words and links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, table

COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "near", "kind", "furniture", "article")
BARE, ITEM, HEADING, PARAGRAPH = range(4)  # kinds of blocks
NEAR = 3  # neighbours on either side among which the longest unlinked block counts
LEAST_LEAF, DEPTH = 10, 8
LONG = 30  # words of a block that could be a paragraph

#: The labelled pages, one per line, as the blocks from top to bottom. A block
#: is its kind (b bare text of a div or cell, i list item, h heading, p
#: paragraph), its number of words, L if all and l if about a third of them are
#: linked, then the hints: - a name that is always page furniture, ~ a name that
#: often is, + inside an article element; * marks article text.
PAGES = """
i1L- i1L- i1L- i1L- b8- h9+* p60+* p45+* p1+* p30+* p70+* b4-
i1L- i2L- i1L- i1L- i1L- b12- h6+* p14+* p2+* p5+* b3-
i2L- i1L- i1L- b20- h12+* p120+* p3+* p80+* p6+* p44+* b10-
i1L- i1L- i1L- i2L- i1L- i1L- b5- h1+* p9+* p33+* p4+* b4-
b2L- i1L- i1L- i3L- h7+* b4+* p90+* i8+* i12+* i6+* p35+* p3L+* i1L+- i1L+- i1L+- h2+- p40+- p25+- p60+- b12l-
i1L- i1L- h4* p40* p55l* h3* p38* i5* i7* i4* p62* b30- h3- i5L- i6L- i4L- b9-
b3L i1L i1L i2L b7 h8* p50* p70* p22* h4* p66* p31* b6
b1L b1L b2L b1L h6* p25* p80* p9* p47* p3* p58* i2L i3L i2L b5
i1L i2L i1L b25l- h9* p100* p48l* p85* b15- p64* p72* i6L i5L i7L i4L b11l
b4 b1L b2L b2L h10* b90* b75* b110* b60l* b4L b6 b3L
b60* b80* b45*
h5* p200*
p20* p25*
h3* p12* p18* p7*
b5L b4L b6L b5L b7L b4L b6L
i1L i1L i2L b3 i3L i2L i1L i4L b4
h3 b4 b3 b6 b2 b4- b3
h2- b30- b5L- i1L- i1L- h8+* p70+* p35+* h3+- p20+- p55+- p18+- b2- b14-
b18- b2L- i1L- i1L- h6+* p15+* h4+* p66+* p41+* p5L+* p52+* b9l- b5-
i1L- i1L- h11* p72* p40* p58* h2- b3- p35- b2- p22- b4- p48- b6-
b3- i2L- i3L- i2L- h7* p44* b28* p61* b19~* p39* b6~ b40- b8-
h5 i4L i6L i5L h7* p51* p77* p33* h3 i5L i7L i6L h2 i3L i2L b7
b2L b2L h6* b2 p45* p88* p1* p29* p2* p63* b2 b7
i1L- i1L- b9- h8+* p1+* p2+* p1+* b3-
i1L- i1L- i1L- b7- h9+* p3+* p150+* p1+* b5-
i1L- i1L- i1L- b6- h12+* b33+* b5+* b61+* i3L+* i4L+* p12L+* b3-
b1L b3L b1L b9 h9* p60* p45* p4* p30* b4
b2L b2L b2L b2L b10 h5* p8* p70* p3* p52* p2* b8
i2L i1L i1L i2L b14 h7* p31* p6* p12* p90* b3
i1L i1L i1L b11 h8* p5* p2* p9* b4
b1L b1L b1L b16 h10* p130* p77* p54* p101* b6l
b2- b1L- h4* p36~* p58~* p70* i3L~ i4L~ i2L~ b5~
h6* p40* p12L p55* p33* p9L p61*
b8 h5* p66* b20L p71* b35L p49* b12
b40- h6* p80* p35* p64* b45- b5- b70- b22-
i1L- i1L- b17- h9+* p52+* b26- p47+* i1+* i2+* i1L+* p33+* b13+- p71+* b3-
b44- h5+* b1+* b55+* b2+* b61+* b1L+* b14+* b35+* i1+* i3+* b7-
p28- h7* p64* p31- p55* p90- p41* p13- b50-
h3- p19- h8* p77* h4- p36- p58* h5- i14- i22- b120-
b75- b60- b33- h9+* p49+* p82+* h2+- p44+- p95+- p17+- p130+-
p8- p15- h6+* h2+* p4+* h3+* p12+* h1+* p3+* b20- p50-
i9- i12- i7- h8* p66* p54* i6- i15- i20l- p38- b16-
b14- b90- h10* b70* b15- b64* b22- b48* b31- b80-
h4+* b3+* b8+* b21+* i7+* b2L+* i2L+* p1L+* b60- b15-
b100- p60- h5- p33- h7+* p20+* p10+* p7+* h4- p80- b40-
h6+* p50+* b20+- p60+* b45+- i2L+- i1L+- h3+- b30+- b70+- i25+- p40+* b6-
h8+* p70+* i3+- i15+- p44+* b9+- b60+- b35+- p20+- b4-
i1L- b6- h5+* p35+* b12+- b3+- i40+- p66+* i60+* b50+* b18+* i12L+- b8l+- b4-
p2+*
p1+* p2+* p1+* p2+* p3+*
p9+* p4+* b2-
b3+* b5+*
p30+* p2+*
h7+* p50+* b2L+~ i4L+~ i5L+~ p60+* p30+~* b4-
p44+* i3L+~ i2L+~ b5L+~ p51+* b1L+~ b2L+~ i9L+~ b3-
h4+* p70+~* p35+~* b40+~* i6L+~ i4L+~ i3L+~ b6-
h9+* p80+* b33+- i18+- b52+- i6+- p25+* p8+* b16+* i5+* b22+- i30+- b3-
b1L b1L b1L h1* b60* b60* b60*
b1L b2L b1L h6* b45* b70* b28* b90* b3 b4L
i1L i1L i2L h7* b60* b60* p3 b5
h4* b60* b60* p3* p4
b1L b1L b2L b1L h9* b33* b120* b41* b18* b64* b6 b2L b2L
b3 b2L b1L b1L b55* b80* b47* b5L b7L b6L b3
h5* b25* b38* h3* b52* b19* b77* b12 b2L b1L
b1L b3L b2L b140* b4
i2L i1L i1L b66* b50* b71* b2
"""

# fixed values: parts of class, id and role names
#: page furniture, if nothing but these and NEUTRAL is in the name
CLEAR = frozenset("nav navbar navigation menu menubar sidebar aside footer masthead topbar toolbar breadcrumb breadcrumbs pagination pager ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing comment comments disqus replies respond widget widgets copyright contentinfo complementary".split())
#: often page furniture, but sections of articles have such names as well
VAGUE = frozenset("header banner search form legal related recommended trending popular social follow warning promotion overlay dialog discussion reply signin recommendations".split())
#: say where or what kind of box something is, and nothing about its content
NEUTRAL = frozenset("site page main primary secondary global local left right top bottom middle center upper lower inner outer wrap wrapper container box block area region zone section panel bar slot unit list item items row col column grid group holder link links button buttons icon icons title label text body head header footer content post posts entry article story user users small large mobile desktop fixed sticky the my id".split())
#: an article, if nothing else is in the name
ARTICLE = frozenset("article main content post entry story body text".split())
_STATES = frozenset("has no with without show hide is js".split())  # what such a name begins with says something about others
_FURNITURE_TAGS = frozenset("nav footer aside form header dialog menu".split())
_ARTICLE_TAGS = frozenset("article main".split())
#: Elements whose content is never text of the page.
_RAW_TAGS = frozenset("script style template svg iframe object textarea select button title".split())
_BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
_KINDS = {t: HEADING for t in "h1 h2 h3 h4 h5 h6".split()} | {t: PARAGRAPH for t in "p pre blockquote".split()} | {"li": ITEM, "dt": ITEM, "dd": ITEM}
#: An element that opens ends the open one of these, up to the list or table they are in.
_SIBLINGS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SCOPES = frozenset("ul ol menu dir table dl".split())
_ENDED = frozenset("p h1 h2 h3 h4 h5 h6".split())  # by any block that opens
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?|<[!?][^>]*+>?", re.S)
_NAMES = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_CLOSE: dict[str, re.Pattern] = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in _RAW_TAGS}

HIDDEN, FURNISH, DOUBT, WITHIN = 8, 4, 2, 1


def _flags(tag: str, attributes: str, inside: int) -> int:
    """What an element's own tag and names say; ``inside``: what holds around it."""
    flags = 0
    if tag in _FURNITURE_TAGS and not (tag == "header" and inside & WITHIN):
        flags |= FURNISH
    if tag in _ARTICLE_TAGS:
        flags |= WITHIN
    if tag == "noscript":
        flags |= DOUBT
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _NAMES.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "style":
                flags |= HIDDEN * (re.search(r"display:none|visibility:hidden", value.lower().replace(" ", "")) is not None)
            elif name in ("hidden", "aria-hidden"):
                flags |= HIDDEN * (name == "hidden" or value.lower() == "true")
            elif tag not in ("html", "body"):
                for one in value.split():
                    parts = _PART.findall(_CAMEL.sub("-", one).lower())
                    if not parts or parts[0] in _STATES:
                        continue
                    if all(p in ARTICLE for p in parts):
                        flags |= WITHIN
                    elif any(p in CLEAR for p in parts):
                        # other words may make it a name for something else, as in ad-hoc
                        plain = all(p in CLEAR or p in VAGUE or p in NEUTRAL or not p.isalpha() for p in parts)
                        flags |= FURNISH if plain else DOUBT
                    elif any(p in VAGUE for p in parts):
                        flags |= DOUBT
    return flags


def blocks(page: str | None) -> list[tuple[str, int, int, int, int]]:
    """(text, words, linked words, kind, flags) of the page's blocks, in order.
    Hidden text is left out, be it a block or a part of one."""
    page = page or ""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # open elements, with kind and flags that hold inside
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    kind, flags, in_link, at = BARE, 0, False, 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                words = len(text.split(" "))
                out.append((text, words, min(words, len(html.unescape(" ".join(linked)).split())), kind, flags & ~HIDDEN))
            pieces.clear()
            linked.clear()

    def pop_through(n: int) -> None:
        nonlocal kind, flags
        for tag, _, _ in stack[n:]:
            opened[tag] -= 1
        del stack[n:]
        _, kind, flags = stack[-1] if stack else ("", BARE, 0)

    def push(tag: str, new_kind: int, new_flags: int) -> None:
        nonlocal kind, flags
        kind, flags = new_kind, new_flags
        stack.append((tag, kind, flags))
        opened[tag] += 1

    def last_open(tags: set[str] | frozenset[str], scopes: frozenset[str] = frozenset()) -> int | None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in tags:
                return n
            if stack[n][0] in scopes:
                return None
        return None

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not flags & HIDDEN:
            pieces.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in _BLOCK_TAGS:
                flush()
                in_link = False
            if opened[tag]:
                pop_through(last_open({tag}))
        elif tag in _RAW_TAGS:
            end = _CLOSE[tag].search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else at if m[3].endswith("/") else len(page)
        elif tag == "a":
            in_link = True
        elif tag == "br":
            pieces.append(" ")
        elif tag in _BLOCK_TAGS:
            flush()
            in_link = False
            if any(opened[t] for t in _ENDED) and (n := last_open(_ENDED, _BLOCK_TAGS - _ENDED)) is not None:
                pop_through(n)
            if tag in _SIBLINGS and any(opened[t] for t in _SIBLINGS[tag]) and (n := last_open(_SIBLINGS[tag], _SCOPES)) is not None:
                pop_through(n)
            if tag != "hr":
                own = _flags(tag, m[3], flags)
                push(tag, _KINDS.get(tag, BARE if tag in _SCOPES or kind != PARAGRAPH else kind), (flags | own) & ~(WITHIN if own & FURNISH and tag in _FURNITURE_TAGS and not flags & WITHIN else 0))
        elif ("hidden" in m[3] or "none" in m[3]) and tag not in _VOID_TAGS and _flags(tag, m[3], flags) & HIDDEN:
            push(tag, kind, flags | HIDDEN)  # an inline element whose text isn't shown
        elif opened[tag]:
            push(tag, kind, flags)  # within a hidden one of its kind
    flush()
    return out


def describe(found: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The columns of ``COLUMNS`` for blocks of (words, share of linked words,
    kind, flags); beyond the ends stand 0. Numbers of words are taken in steps
    of factor two, up to 64: finer ones would only teach chance."""
    n = len(found)
    words, links, kinds, flags = (np.array([b[i] for b in found], float) for i in range(4))
    words = np.minimum(np.floor(np.log2(words + 1)), 6)
    pad = lambda a: np.concatenate([[0.0], a, [0.0]])
    alone = np.concatenate([np.zeros(NEAR), words * (links < 0.5), np.zeros(NEAR)])
    near = np.max([alone[NEAR + d : NEAR + d + n] for d in range(-NEAR, NEAR + 1) if d], axis=0)
    flag = flags.astype(int)
    furniture = np.where(flag & FURNISH, 2.0, np.where(flag & DOUBT, 1.0, 0.0))
    return np.stack([words, links, pad(words)[:-2], pad(links)[:-2], pad(words)[2:], pad(links)[2:], near, kinds, furniture, (flag & WITHIN).astype(float)], axis=1)


_BLOCK = re.compile(r"([bihp])(\d+)([Ll]?)([-~+]*)(\*?)")


def labelled_page(line: str) -> tuple[list[tuple[int, float, int, int]], list[int]]:
    """Blocks and labels of a line of ``PAGES``."""
    found, labels = [], []
    for one in line.split():
        kind, words, link, hints, text = _BLOCK.fullmatch(one).groups()
        flags = (FURNISH if "-" in hints else 0) | (DOUBT if "~" in hints else 0) | (WITHIN if "+" in hints else 0)
        found.append((int(words), {"": 0.0, "l": 0.3, "L": 1.0}[link], "bihp".index(kind), flags))
        labels.append(int(bool(text)))
    return found, labels


def labelled_blocks(pages: str = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Columns and labels of the labelled pages with all hints, without those
    of article elements, and twice with none. Long unlinked furniture that only
    its hints tell from an article is not learned from without them."""
    x, y = [], []
    for line in pages.strip().split("\n"):
        found, labels = labelled_page(line)
        for seen in (~0, ~WITHIN, 0, 0):
            told = [bool(seen or label or not flags or words < LONG or links > 0.2) for (words, links, _, flags), label in zip(found, labels, strict=True)]
            x.append(describe([(*b[:3], b[3] & seen) for b in found])[told])
            y += [label for label, t in zip(labels, told, strict=True) if t]
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A decision tree by Gini impurity: (share of 1,) or (column, cut, lower, upper)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for c in range(x.shape[1]):
        order = np.argsort(x[:, c], kind="stable")
        v, ones = x[order, c], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cuts = np.flatnonzero((v[1:] > v[:-1]) & (n >= LEAST_LEAF) & (len(y) - n >= LEAST_LEAF))
        if len(cuts):
            left, a = cuts + 1.0, ones[cuts].astype(float)
            right, b = len(y) - left, ones[-1] - a
            impurity = a * (left - a) / left + b * (right - b) / right
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0] - 1e-9:
                best = (float(impurity[k]), c, float(v[cuts[k]] + v[cuts[k] + 1]) / 2)
    if best is None:
        return (share,)
    _, c, cut = best
    low = x[:, c] < cut
    return (c, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def is_text(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page)
    if not found:
        return ""
    rows = describe([(words, links / words, kind, flags) for _, words, links, kind, flags in found])
    return "\n\n".join(b[0] for b, row in zip(found, rows.tolist(), strict=True) if is_text(tree, row))


def extract(pages: DataFrame, labelled: str = PAGES) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    A null or empty page, and one without article text, has an empty text.
    Markup that is cut off ends at the end of the page; an unclosed comment,
    script or style takes the rest with it. Repeated rows are extracted each
    by themselves, other columns are ignored.
    """
    modest_batches(pages)
    tree = grow(*labelled_blocks(labelled))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h.as_py(), tree) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
