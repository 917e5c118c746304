"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with its path of block elements from
the root. Per path the text length and the punctuation of its blocks are
aggregated and divided by the number of blocks; both ratios are smoothed along
the page, multiplied and compared with a threshold. Paths above it mark content,
and the elements that hold them give the text, short blocks included. Parts
whose element says that they are no article (menus, adverts, comments and the
like) are left out beforehand. Names and forms count only where the article stands
outside of them: elements that wrap it are kept whatever they are called.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rankforge.llm.common import map_texts, pick

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var img wbr input".split()
)
NEVER = frozenset(
    "head nav footer aside button select option dialog menu svg math canvas object audio video template datalist fieldset legend".split()
) | RAW
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table tbody thead tfoot tr td th caption hgroup address center".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("html body div section article main ul ol dl table tbody thead tfoot nav aside header footer form blockquote td th".split())
KEEP = frozenset("html body main".split())
# Words of class, id and role that name parts other than the article, the plainest of
# them apart; words that only say how a part is laid out or whose it is; and words that
# make of such a name a property of the layout around.
CERTAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored nav navbar navigation menu menus breadcrumb breadcrumbs footer "
    "sidebar widget widgets comment comments commentlist disqus cookie cookies consent gdpr popup modal newsletter pagination pager teaser teasers".split()
)
OTHER_PARTS = CERTAIN | frozenset(
    "banner sponsor promo promotion header masthead topbar foot bottom aside side rail discussion respond reply replies notice notices alert "
    "privacy overlay subscribe subscription signup login register form search social share sharing related recommended recommendations more "
    "toolbar disclaimer legal copyright contentinfo complementary".split()
)
NEUTRAL = frozenset(
    "area bar block body box btn button buttons center col column container entries entry global group holder icons inner item items js left "
    "link links list main outer page pages panel post posts primary reader readers right row secondary section site slot story sub the toggle "
    "top unit user users wrap wrapper article articles".split()
)
HEADINGS = frozenset("header masthead".split())
OWNERS = frozenset("article entry post story".split())
LAYOUT = frozenset("has no non not with without".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class _Element:
    __slots__ = ("tag", "label", "out", "named", "number", "parent", "inline", "path")

    def __init__(self, tag: str, attributes: str, parent: "_Element | None", number: int = 0, kept: frozenset[int] | None = None):
        self.tag, self.parent, self.inline, self.number = tag, parent, tag in INLINE, number
        self.named = tag == "form"
        label, out = tag, tag in NEVER or (tag == "header" and not _within(parent, "article", "main"))
        if attributes.strip():
            for name, *values in NAMES.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("hidden", "aria-hidden"):
                    out |= name == "hidden" or value.lower() == "true"
                    continue
                if name == "class":
                    label = f"{tag}.{'.'.join(value.split())}"
                if tag not in KEEP and not tag.startswith("h"):
                    inside = _within(parent, "article", "main")
                    self.named |= any(_names_other_part(token, name, inside) for token in value.split())
        self.label = label
        out |= self.named and kept is not None and number not in kept
        self.out = out or (parent is not None and parent.out)
        above = parent.path if parent else ""
        self.path = above if self.inline else f"{above}/{label}"


def _names_other_part(token: str, attribute: str, inside: bool) -> bool:
    """Whether a name as a whole means a part other than the article.

    Every word but layout and owner must say so ("footer-links"); a class may hold one
    word of another kind beside a certain one ("comment-text"). So a heading's slug
    ("social-and-legal-history") or "read-more-content" names no other part, and the
    header of an article is the article's.
    """
    words = {w for w in (w.lower() for w in WORDS.findall(token)) if not w.isdigit()}
    other = words & OTHER_PARTS
    if not other or words & LAYOUT or (other <= HEADINGS and (inside or words & OWNERS)):
        return False
    foreign = len(words - OTHER_PARTS - NEUTRAL)
    return not foreign or (foreign == 1 and attribute == "class" and bool(other & CERTAIN))


def _within(element: _Element | None, *tags: str) -> bool:
    while element is not None:
        if element.tag in tags:
            return True
        element = element.parent
    return False


def _close(top: _Element, tags, stop=frozenset()) -> _Element:
    """The stack after closing the nearest of ``tags``, if it is open inside the nearest of ``stop``."""
    at = top
    while at.parent is not None and at.tag not in tags:
        if at.tag in stop:
            return top
        at = at.parent
    return at.parent if at.parent is not None and at.tag in tags else top


def _block(top: _Element) -> _Element:
    while top.inline and top.parent is not None:
        top = top.parent
    return top


def text_blocks(page: str, kept: frozenset[int] | None = frozenset()) -> list[tuple[str, _Element]]:
    """Blocks of text in page order with the element that holds each; other parts of the page are left out.

    Forms and elements named as other parts are left out unless their number is
    in ``kept``; none of them is if ``kept`` is None.
    """
    root = _Element("#root", "", None)
    top, at, n, number = root, 0, len(page), 0
    blocks: list[tuple[str, _Element]] = []
    pieces: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((text, _block(top)))
        pieces.clear()

    for m in iter(TOKEN.scanner(page).search, None):
        if m.start() < at:
            continue  # inside raw text
        if m.start() > at and not top.out:
            piece = page[at : m.start()]
            pieces.append(references.unescape(piece) if "&" in piece else piece)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if tag == "br":
            pieces.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if closing:
            top = _close(top, {tag}, SCOPES if inline or tag in CLOSED_BY_BLOCK else frozenset())
            continue
        if tag in ITEMS:
            top = _close(top, ITEMS[tag], SCOPES - ITEMS[tag] - {"td", "th"} if tag != "tr" else {"table"})
            if tag == "tr":
                top = _close(top, {"tr"}, {"table"})
        elif not inline:
            top = _close(top, CLOSED_BY_BLOCK, SCOPES)
        if tag in VOID or m[0].endswith("/>") and inline:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
            stop = page.find(">", at)
            at = stop + 1 if end and stop >= 0 else n
            continue
        number += 1
        top = _Element(tag, m[3] or m[6] or "", top, number, kept)
    if at < n and not top.out:
        pieces.append(references.unescape(page[at:]))
    flush()
    return [(t, e) for t, e in blocks if not e.out]


def path_scores(blocks: list[tuple[str, _Element]], spread: float = 1.0) -> np.ndarray:
    """Fused and smoothed tag-path ratios, one per block."""
    paths: dict[str, int] = {}
    of = np.array([paths.setdefault(e.path, len(paths)) for _, e in blocks])
    lengths = np.array([len(t) for t, _ in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t, _ in blocks], float)
    count = np.bincount(of)
    radius = int(3 * spread)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / spread) ** 2)
    fused = np.ones(len(blocks))
    for values in (lengths, marks):
        ratio = (np.bincount(of, values) / count)[of]
        smooth = np.convolve(ratio, kernel / kernel.sum(), "full")[radius : radius + len(ratio)]
        fused *= smooth + 1e-3
    # A path has one score: the mean of its blocks.
    return (np.bincount(of, fused) / count)[of]


def _container(element: _Element) -> _Element:
    """The article or main element around a block, or else the nearest element that lays out whole parts."""
    found, at = None, element
    while at is not None:
        if at.tag in ("article", "main"):
            found = at
        at = at.parent
    if found is not None:
        return found
    while element.tag in LEAVES and element.parent is not None:
        element = element.parent
    return element


def _accepted(blocks: list[tuple[str, _Element]]) -> list[tuple[str, _Element]]:
    """Blocks whose path scores at the threshold or above."""
    scores = path_scores(blocks)
    limit = min(float(scores.std()), 0.5 * float(scores.max()))
    return [b for b, s in zip(blocks, scores) if s >= limit]


def _named(element: _Element | None) -> list[int]:
    """Numbers of the forms and of the elements named as other parts around a block, the outermost first."""
    found = []
    while element is not None:
        if element.named:
            found.append(element.number)
        element = element.parent
    return found[::-1]


def _wrappers(blocks: list[tuple[str, _Element]]) -> frozenset[int]:
    """Forms and named elements that hold the article all the same.

    Wanted are the blocks that score among those of articles and main elements
    or, on a page without these, among all blocks with punctuation. A name or a
    form counts as long as wanted text stands outside of such elements;
    otherwise the outermost one with the most wanted text is kept, and so on.
    """
    marked = [b for b in blocks if _within(b[1], "article", "main")]
    wanted = _accepted(marked) if marked else [b for b in _accepted(blocks) if PUNCTUATION.search(b[0])]
    around = [(len(t), _named(e)) for t, e in wanted]
    kept: set[int] = set()
    while around and all(around_block for _, around_block in around):
        amount: dict[int, int] = {}
        for length, (outermost, *_) in around:
            amount[outermost] = amount.get(outermost, 0) + length
        most = max(amount, key=amount.__getitem__)
        kept.add(most)
        around = [(length, [x for x in named if x != most]) for length, named in around]
    return frozenset(kept)


def main_text(page: str | None) -> str:
    """The article of one page; empty if there is none."""
    blocks = text_blocks(page or "", None)
    if any(_named(e) for _, e in blocks):
        blocks = text_blocks(page or "", _wrappers(blocks))
    if not blocks:
        return ""
    holders = {id(_container(e)) for _, e in _accepted(blocks)}

    def inside(e: _Element | None) -> bool:
        while e is not None:
            if id(e) in holders:
                return True
            e = e.parent
        return False

    return " ".join(t for t, e in blocks if inside(e))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: one row per input row, ``key, url, text, n_chars``.

    The whole html is read; a null or empty page, or one without text, gives an
    empty text. Broken markup is read as browsers do: elements left open end
    with what holds them, a ``<`` that opens nothing is text. Null keys and
    repeated rows stay as they are; other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 500):
                part = frame.iloc[a : a + 500]
                texts = [main_text(h) for h in part["_html"].tolist()]
                yield pd.DataFrame(
                    {"_key": part["_key"].array, "_url": part["_url"].array, "text": texts, "n_chars": [len(t) for t in texts]}
                )

    rows = pick(pages, key, url, html).toDF("_key", "_url", "_html")
    return map_texts(rows, key, run, "_url string, text string, n_chars long").withColumnRenamed("_url", url)
