"""Main text of HTML pages by tree scoring.

Each page becomes a small tree of elements with its text in blocks. A paragraph passes points
for its length and commas to its ancestors, less the further up; a container's points are
discounted by its share of link text. The best container is kept, raised to the article around
it, with those of its siblings that score well or read like prose. Names such as sidebar or advert
take an element out if most of the page's prose is elsewhere, or if more of what the page itself
calls its article is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

RAW = "script|style|noscript|template|iframe|svg|textarea|object|canvas|title"
# Inside a tag only a value after "=" is quoted; a "<" outside values ends a tag that was not closed. Every
# character is taken once, so the time is linear in the page whatever its quotes.
INNER = r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<({RAW})(?![\w:-]){INNER}>.*?(?:</\1(?![\w:-])[^<>]*>|\Z)|<(/?)([a-zA-Z][\w:-]*)({INNER})>?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TOLD = re.compile("class|id|role|style|hidden", re.I)

# Names that HTML defines, and words by which pages mark what is not their text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl td th li body html div section article main aside blockquote form select menu details fieldset figure".split())
CONTROLS = frozenset("button select label datalist".split())
NOT_TEXT = frozenset("nav aside footer button select input label dialog menu datalist head".split())
DOUBTED = frozenset("form fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist".split())
UNLIKELY = frozenset(
    """nav navbar navigation menu menubar sidebar side aside rail footer foot header masthead topbar toolbar ad ads adv advert adverts advertisement
    advertising adsense adbox banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay
    newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations trending popular breadcrumb breadcrumbs
    pagination pager widget widgets tags tagcloud skip disclaimer copyright legal""".split()
)
READERS = frozenset("comment comments commentlist disqus respond replies reply".split())
# parts of names that tell what a page has, not what an element is: has-sidebar, share-enabled
HAS_FIRST, HAS_LAST = frozenset("has with without no not is".split()), frozenset("enabled disabled open closed on off visible".split())
# a name of such parts alone, one of the first at least, is the text's own: post-content
OWN, OWN_BESIDE = frozenset("article articlebody content entry main post story".split()), frozenset("body text page blog news inner wrapper container".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|page|post|story|text|blog|news)(?:$|[\s_-])", re.I)


class _Page:
    """Elements as parallel lists; blocks are (element, text, characters of links)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.hint, self.out, self.doubt, self.own = ["#root"], [0], [0], [False], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of links
        stack, pieces, links, in_link = [0], [], 0, 0

        def flush() -> None:
            nonlocal links
            if pieces:
                text = "".join(pieces)
                text = " ".join((unescape(text) if "&" in text else text).split())
                pieces.clear()
                if text:
                    self.blocks.append((next(i for i in reversed(stack) if self.tag[i] in BLOCK or self.tag[i] in CONTROLS or i == 0), text, min(links, len(text))))
            links = 0

        def add(text: str) -> None:
            nonlocal links
            pieces.append(text)
            if in_link:
                links += len(text.strip())

        def pop(to: int) -> None:
            nonlocal in_link
            while len(stack) > to:
                in_link -= self.tag[stack.pop()] == "a"

        last = 0
        for m in TOKEN.finditer(html):
            if m.start() > last:
                add(html[last : m.start()])
            last = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name == "br":
                pieces.append(" ")
                continue
            block, control = name in BLOCK, name in CONTROLS
            if m[2]:
                at = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name), 0)
                if not at or (not block and any(self.tag[i] in BLOCK for i in stack[at:])):
                    continue
                if block or control:
                    flush()
                pop(at)
                continue
            if block or control:
                flush()
            if block:
                # an open paragraph ends at a block; so do items of the same kind
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in CLOSES.get(name, ()) or t == "p":
                        pop(k)
                        break
                    if t in SCOPE and not (name in ("tr", "td", "th", "tbody", "tfoot") and t in ("td", "th")):
                        break
            if name in VOID:
                continue
            hint, out, doubt, own = self._told(name, m[4] or "", stack)
            self.tag.append(name), self.parent.append(stack[-1]), self.hint.append(hint), self.out.append(out or self.out[stack[-1]]), self.doubt.append(doubt), self.own.append(own and not doubt)
            stack.append(len(self.tag) - 1)
            in_link += name == "a"
        if last < len(html):
            add(html[last:])
        flush()

    def _told(self, name: str, attributes: str, stack: list[int]) -> tuple[int, bool, int, bool]:
        """Points that an element's names give it, whether it is no part of the text, how much its names make that
        doubtful, and whether it is called the text itself."""
        hint, out, doubt = (25 if name in ("article", "main") else 0), name in NOT_TEXT, SURE
        own = hint > 0
        if name in DOUBTED and not (name == "header" and any(self.tag[i] in ("article", "main") for i in stack)):
            doubt = DOUBTFUL
        if attributes and TOLD.search(attributes):
            found: dict[str, str] = {}
            for k, a, b, c in ATTRIBUTE.findall(attributes):
                found.setdefault(k.lower(), a or b or c)
            names = f"{found.get('class', '')} {found.get('id', '')}"
            if name not in ("body", "html", "main"):
                doubt = max(doubt, _doubt(names, name))
                if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
                    out = True
            if LIKELY.search(names):
                hint += 15
            if found.get("role", "").lower() in ("main", "article"):
                hint += 25
                own = True
            own = own or (name not in ("body", "html") and any(_own(x) for x in names.lower().split()))
        return hint, out, doubt, own


def _own(name: str) -> bool:
    parts = {p.rstrip("0123456789") for p in re.split(r"[-_]+", name)}
    return bool(parts & OWN) and parts <= OWN | OWN_BESIDE


#: Degrees of doubt: none; left out unless most of the page's prose is in it; left out unless all of it is.
SURE, DOUBTFUL, FROM_READERS = 0, 1, 2
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Share of a page's prose from which an element is not left out for its names, and that from which prose
#: elsewhere, in what the page calls its article, has it left out all the same.
MOST, OWN_LEAST = 0.5, 0.05


def _doubt(names: str, tag: str) -> int:
    """What class and id tell: each name counts by its parts, unless it tells what the page has."""
    out = SURE
    for name in names.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[-_]+", name)]
        if len(parts) > 1 and (parts[0] in HAS_FIRST or parts[-1] in HAS_LAST):
            continue
        if any(p in READERS for p in parts):
            out = FROM_READERS
        elif out == SURE and any(p in UNLIKELY for p in parts) and (tag != "article" or any(p in ("ad", "promo", "related", "sponsor", "sponsored") for p in parts)):
            out = DOUBTFUL
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section article main body td #root center blockquote form fieldset".split())


def _upwards(page: _Page, i: int) -> Iterator[int]:
    """Element ``i`` and its ancestors."""
    while True:
        yield i
        if i == 0:
            return
        i = page.parent[i]


def _leave_out(page: _Page) -> None:
    """Marks the doubtful elements that are no text; parents first, an element inside one goes with it."""
    n = len(page.tag)
    if not any(page.doubt):
        return
    # prose by element, and prose that lies in elements of readers
    prose, outer = [0.0] * n, [0] * n
    # prose whose nearest element that says anything is called the text
    own, called = [0.0] * n, [False] * n
    for i in range(1, n):
        outer[i] = i if page.doubt[i] == FROM_READERS else outer[page.parent[i]]
        called[i] = page.own[i] or (called[page.parent[i]] and not page.doubt[i])
    said = 0.0
    for at, words, links in page.blocks:
        if page.out[at] or len(words) < 25 or page.tag[at] in HEADINGS:
            continue
        weight = len(words) - links
        said += weight if outer[at] else 0
        for i in _upwards(page, at):
            prose[i] += weight
            own[i] += weight if called[at] else 0
    total = prose[0]
    for i in range(1, n):
        if page.out[page.parent[i]]:
            page.out[i] = True
        elif page.doubt[i] == FROM_READERS:
            page.out[i] = page.out[i] or prose[i] < total
        elif page.doubt[i] == DOUBTFUL:
            # readers' words count for nothing here, unless there are no others
            whole = total - said or total
            elsewhere = own[0] - own[i]
            page.out[i] = page.out[i] or prose[i] <= MOST * whole or (elsewhere > own[i] and elsewhere >= OWN_LEAST * whole)


def extract_main_text(html: str | None) -> str:
    """The main text of one page: its blocks in order, joined by line ends; empty if there is none."""
    if not html:
        return ""
    page = _Page(html)
    _leave_out(page)
    blocks = [b for b in page.blocks if not page.out[b[0]]]
    if not blocks:
        return ""
    n = len(page.tag)
    points, text, link = [0.0] * n, [0] * n, [0] * n
    for at, words, links in blocks:
        size = len(words)
        gain = 0.0
        if size >= 25 and page.tag[at] not in HEADINGS:
            gain = (1 + words.count(",") + words.count("、") + min(size / 100, 3)) * (1 - links / size)
        # a block without an element of its own passes its points from the container it lies in
        start = at if page.tag[at] in CONTAINERS else page.parent[at]
        if gain:
            for level, i in enumerate(_upwards(page, start)):
                points[i] += gain / (1, 2, 6, 9, 12)[min(level, 4)]
        for i in _upwards(page, at):
            text[i] += size
            link[i] += links
    scored = [((p + h) * (1 - link[i] / text[i]), i) if text[i] and (p or h) else (0.0, i) for i, (p, h) in enumerate(zip(points, page.hint, strict=True))]
    best = max(scored, key=lambda x: (x[0], -x[1]))
    top = best[1] if best[0] > 0 else 0
    for i in _upwards(page, top):  # the article around the best container
        if i and page.tag[i] in ("article", "main") and not page.out[i]:
            top = i
            if page.tag[i] == "article":
                break
    kept = {top}
    if top and page.tag[top] not in ("main", "body"):
        article = page.tag[top] == "article"
        least = max(10.0, 0.2 * best[0])
        for i in range(1, n):
            if i == top or page.parent[i] != page.parent[top] or page.out[i] or not text[i]:
                continue
            density, tag = link[i] / text[i], page.tag[i]
            if article:  # headings before it, and other articles and sections that score well
                keep = (tag in ("h1", "h2") and i < top and density == 0) or (tag in ("article", "section", "p") and scored[i][0] - page.hint[i] >= 0 and points[i] >= 0.2 * points[top] and density < 0.25)
            else:
                keep = scored[i][0] >= least or (tag in BLOCK and (text[i] > 80 and density < 0.25 or tag in ("p", "h1", "h2", "h3") and density == 0))
            if keep:
                kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or (i > 0 and inside[page.parent[i]])
    # lists that are links all through are menus, unless they are in an article or follow prose of their container
    menu = [False] * n
    items, prose_at, first = [0] * n, [len(blocks)] * n, [len(blocks)] * n
    for k, (at, words, links) in enumerate(blocks):
        items[page.parent[at]] += 1
        for i in _upwards(page, at):
            first[i] = min(first[i], k)
        if len(words) >= 25 and links < 0.5 * len(words) and page.tag[at] not in HEADINGS:
            for i in {at, page.parent[at]}:
                prose_at[i] = min(prose_at[i], k)
    in_article = [False] * n
    for i in range(1, n):
        up = page.parent[i]
        in_article[i] = in_article[up] or page.tag[i] == "article" or (page.own[i] and page.tag[i] != "main")
        alone = not in_article[i] and prose_at[up] > first[i]
        menu[i] = menu[up] or (alone and page.tag[i] in ("ul", "ol") and text[i] > 0 and link[i] >= 0.9 * text[i] and items[i] >= 3)
    return "\n".join(words for at, words, _ in blocks if inside[at] and not menu[at])


def extract_pages(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) instead of the html.

    Cases: null and empty html and pages without main text give an empty text; broken and
    unclosed markup is read as far as it goes; html of any length is read whole; repeated rows
    are extracted each; existing columns text and n_chars are replaced, all others stay.
    """
    pages = pages.drop("text", "n_chars") if html_column not in ("text", "n_chars") else pages
    html = pages.columns.index(html_column)
    keep = [i for i, c in enumerate(pages.columns) if i != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in common.slices(batch, html):
                texts = [extract_main_text(h) for h in rows.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=[*(rows.schema.names[i] for i in keep), "text", "n_chars"])

    rest = pages.drop(html_column).schema
    return pages.mapInArrow(common.lean(run), common.extended(rest, text="string", n_chars="long"))
