"""Main text of web pages by tag-path ratios.

Each text block of a page lies at a root-to-leaf tag path (names of tags with their class and id words). Per path, the length
of its texts without those of links, its punctuation marks and its blocks are summed; from these come two ratios, text and
punctuation per block. Both are smoothed over the neighbouring blocks in page order and fused, with the text ratio itself, to one value per path.

Class and id words only *lower* that value (``HINTS``), and not where their element holds most of the page's text. Paths
that reach the page's threshold are *dense*. The content region is the smallest element that holds all dense
text; its blocks count, but for paths that a class word lowers below the threshold and for lists of bare links; blocks outside the
region count if their path is dense and also occurs within, or if they are the title before it.

Only tags, roles and hidden elements bar text outright (``NEVER``, ``ROLES``): menus, headers, footers, asides, forms,
scripts and styles. An article's own header is part of it.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed, empty ones
left out, and the rest joined in page order by one line feed.

Defined results: null or empty html, or html without content, gives an empty text; broken markup (open paragraphs,
stray end tags, an unclosed comment) is read as browsers do, as far as it concerns blocks; repeated rows repeat; pages of any
length and depth are read whole; an empty table gives an empty table; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm.common import prepare

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
NEVER = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea input label fieldset legend iframe object embed svg math canvas audio video menu dialog title xmp map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
#: Words of class and id that name what is hardly ever content, by the factor that a path's value is lowered with.
STRONG, WEAK = 0.05, 0.35
HINTS = {
    STRONG: frozenset(
        """ad ads adv advert adverts advertisement advertising adbox adslot adsense promo promos promoted promotion sponsor sponsored sponsors
        nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager
        footer colophon sidebar sidebars cookie cookies consent gdpr popup modal newsletter subscribe signup login
        comment comments commentlist disqus reply replies respond""".split()
    ),
    WEAK: frozenset(
        """header masthead topbar banner foot bottombar copyright toc side rail aside widget widgets
        related recommended recommendations trending popular teaser teasers
        notice notices notification notifications alert alerts overlay toast disclaimer subscription register discussion
        share sharing social follow tagcloud form search searchbox skip""".split()
    ),
}
#: First parts of a compound name that say something about what else is there ("with-sidebar").
ABOUT = frozenset("with has no without is".split())
#: Parts of a compound name that void a weak hint ("post-header", "related-work").
OF_CONTENT = frozenset("post entry article content story section chapter work works title".split())
#: The hints that count on an element which names content by its tag.
OF_READERS = frozenset("comment comments reply replies".split())
#: Words that mark an element as the content whatever else its class says.
CONTENT_TAGS = frozenset(("article", "main"))
CLOSES = {  # an open element of the key is closed by a start tag of the value
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "option": frozenset(("option", "optgroup")),
}
#: End tags that an open element of these stops from closing what lies outside.
SCOPE = frozenset("table td th caption body html".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
NAME_SPLIT = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])")
MARKS = re.compile(r"[.,;:!?…。、，！？；：]")
WHITE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*(?:/[^>]*)?>", re.I) for tag in RAW}

#: Blocks on either side that a ratio is smoothed over, and their weights.
SMOOTH = (0.25, 0.5, 0.25)
#: A path is dense from this share of the standard deviation of the values on, and from this share of the largest value that no hint lowers.
THRESHOLD, FLOOR = 0.6, 0.1
#: Paths within an element that the page itself names as content count so many times.
NAMED = 2.0
LEAF_TAGS = frozenset("p li td th dd dt pre blockquote h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element: ``path`` numbers its tag path, ``hint`` is the factor of its own class words, later of all above as well."""

    __slots__ = ("bar", "content", "hint", "link", "parent", "path", "tag")

    def __init__(self, tag: str, parent: int, path: int, bar: bool, content: bool, link: bool, hint: float):
        self.tag, self.parent, self.path, self.bar, self.content, self.link, self.hint = tag, parent, path, bar, content, link, hint


class Page:
    """Elements in page order (a parent stands before its children) and blocks: element, text, characters inside links."""

    __slots__ = ("blocks", "nodes", "paths")

    def __init__(self):
        self.nodes = [Node("", -1, 0, False, False, False, 1.0)]
        self.blocks: list[tuple[int, str, int]] = []
        #: (path above, tag and words) -> number of the path; a path is never spelt out, so depth costs nothing.
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}

    def add(self, tag: str, label: str, parent: int, bar: bool, hint: float) -> int:
        above = self.nodes[parent]
        path = self.paths.setdefault((above.path, f"{tag}.{label}" if label else tag), len(self.paths))
        self.nodes.append(Node(tag, parent, path, above.bar or bar, above.content or tag in CONTENT_TAGS, above.link or tag == "a", hint))
        return len(self.nodes) - 1

    def spelt(self) -> dict[int, str]:
        """Paths in full, for reports and tests."""
        out = {0: ""}
        for (above, label), number in self.paths.items():
            if number:
                out[number] = f"{out[above]}>{label}"
        return out


def _hint(word: str, tag: str) -> float:
    """The factor of one class or id word."""
    parts = word.split("-")
    if len(parts) > 1 and parts[0] in ABOUT:
        return 1.0
    names = {word, *parts}
    if tag in CONTENT_TAGS:
        names &= OF_READERS
    if names & HINTS[STRONG]:
        return STRONG
    return WEAK if names & HINTS[WEAK] and not names & OF_CONTENT else 1.0


def _attributes(tag: str, attributes: str, inside: bool) -> tuple[bool, str, float]:
    """Whether an element is never content, its class and id words for the path, and the factor of these."""
    bar, hint = tag in NEVER and not (tag == "header" and inside), 1.0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return bar, "", hint
    label = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for word in NAME_SPLIT.split(value):
                label.append(word.lower())
                if tag not in ("html", "body"):
                    hint = min(hint, _hint(label[-1], tag))
        elif name == "role":
            bar |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            bar = True
        elif name == "style" and HIDDEN.search(value):
            bar = True
    return bar, ".".join(label), hint


def read(html: str) -> Page:
    """Elements and blocks of a page."""
    page = Page()
    nodes, blocks = page.nodes, page.blocks
    stack = [0]
    parts: list[str] = []
    linked = owner = 0

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = WHITE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                blocks.append((owner, text, linked))
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal owner, linked
        top = nodes[stack[-1]]
        if top.bar:
            return
        depth = len(stack) - 1
        while depth and nodes[stack[depth]].tag in INLINE:
            depth -= 1
        block = stack[depth]
        if block != owner:
            close_block()
            owner = block
        parts.append(text)
        if top.link:
            linked += len(text.strip())

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(entities.unescape(m[0][9:].removesuffix("]]>")).replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            inline = tag in INLINE
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag == tag:
                    if not inline:
                        close_block()
                    del stack[i:]
                    break
                if open_tag in SCOPE and tag not in SCOPE and tag not in ("article", "section", "main", "div"):
                    break
            else:
                if tag == "p":
                    close_block()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            close_block()
            while len(stack) > 1:
                # Inline elements that an open block left behind end with it.
                depth = len(stack) - 1
                while depth > 0 and nodes[stack[depth]].tag in INLINE:
                    depth -= 1
                if depth > 0 and tag in CLOSES.get(nodes[stack[depth]].tag, ()):
                    del stack[depth:]
                else:
                    break
        if tag in VOID:
            continue
        top = stack[-1]
        bar, label, hint = _attributes(tag, m[3], nodes[top].content)
        if m[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else size
            continue
        stack.append(page.add(tag, label, top, bar, hint))
    close_block()
    return page


def path_table(page: Page) -> dict[int, tuple[int, int, int]]:
    """Per tag path with text: characters outside links (a link's own count against them), punctuation marks, blocks."""
    table: dict[int, tuple[int, int, int]] = {}
    for node, text, linked in page.blocks:
        path = page.nodes[node].path
        length, marks, n = table.get(path, (0, 0, 0))
        table[path] = (length + max(0, len(text) - 2 * linked), marks + len(MARKS.findall(text)), n + 1)
    return table


def _smooth(x: np.ndarray) -> np.ndarray:
    wide = np.concatenate([x[:1], x, x[-1:]])
    return SMOOTH[0] * wide[:-2] + SMOOTH[1] * wide[1:-1] + SMOOTH[2] * wide[2:]


def path_values(page: Page) -> dict[int, float]:
    """Per tag path: both ratios smoothed over the blocks in page order and fused; the mean over the path's blocks."""
    table = path_table(page)
    paths = np.array([page.nodes[n].path for n, _, _ in page.blocks])
    # Text per block, but a path of many blocks stands above one of a single block as long: the root of their number.
    length = np.array([table[p][0] / np.sqrt(table[p][2]) for p in paths.tolist()])
    marks = np.array([table[p][1] / table[p][2] + 1.0 for p in paths.tolist()])
    # The path's own ratio stays in: smoothing alone would make a short teaser beside long paragraphs dense.
    fused = np.sqrt(length * _smooth(length) * _smooth(marks))
    names, place = np.unique(paths, return_inverse=True)
    return dict(zip(names.tolist(), (np.bincount(place, fused) / np.bincount(place)).tolist()))


def _spread_hints(page: Page) -> None:
    """Gives each element the product of the hints above it; hints of elements that hold most of the page's text are void."""
    nodes = page.nodes
    own, named = [0] * len(nodes), [0] * len(nodes)
    for node, text, linked in page.blocks:
        size = max(0, len(text) - 2 * linked)
        own[node] += size
        if nodes[node].content:
            named[node] += size
    for i in range(len(nodes) - 1, 0, -1):
        own[nodes[i].parent] += own[i]
        named[nodes[i].parent] += named[i]
    inside = [False] * len(nodes)  # in an element that a hint lowers
    hinted = [False] * len(nodes)  # such an element is within
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = inside[node.parent] or node.hint < 1
    for i in range(len(nodes) - 1, 0, -1):
        hinted[nodes[i].parent] |= hinted[i] or nodes[i].hint < 1
    # The page names its content elsewhere: an article or main that no hinted element holds and that holds none.
    elsewhere = any(n.tag in CONTENT_TAGS and not inside[i] and not hinted[i] for i, n in enumerate(nodes))
    for i, node in enumerate(nodes[1:], 1):
        if node.hint < 1 and 2 * own[i] > own[0] and not elsewhere and 10 * (named[0] - named[i]) <= own[i]:
            node.hint = 1.0
        node.hint *= nodes[node.parent].hint


def menus(page: Page) -> set[int]:
    """Paths of three or more short blocks that are links and hold no punctuation."""
    sums: dict[int, list[int]] = {}
    for node, text, linked in page.blocks:
        x = sums.setdefault(page.nodes[node].path, [0, 0, 0, 0])
        x[0] += 1
        x[1] += len(text)
        x[2] += linked
        x[3] += len(MARKS.findall(text))
    return {p for p, (n, chars, linked, marks) in sums.items() if n >= 3 and 10 * linked >= 9 * chars and chars < 40 * n and 2 * marks < n}


def dense_blocks(page: Page) -> list[bool]:
    """Whether the value of each block's path, lowered by hints, reaches the page's threshold; blocks that are mostly links never do."""
    values = path_values(page)
    plain = np.array([values[page.nodes[n].path] * (NAMED if page.nodes[n].content else 1.0) for n, _, _ in page.blocks])
    lowered = plain * np.array([page.nodes[n].hint for n, _, _ in page.blocks])
    bound = max(THRESHOLD * lowered.std(), FLOOR * plain.max())
    return [bool(v >= bound) and 2 * linked <= len(text) for v, (_, text, linked) in zip(lowered, page.blocks)]


def _region(page: Page, dense: list[bool]) -> int:
    """The smallest element with all dense text; a title that is dense or within an article is not left outside."""
    nodes = page.nodes
    weight, titles = [0] * len(nodes), [0] * len(nodes)
    for (node, text, _), is_dense in zip(page.blocks, dense):
        weight[node] += len(text) * is_dense
        titles[node] += nodes[node].tag in ("h1", "h2") and nodes[node].hint == 1 and (is_dense or nodes[node].content)
    best: list[int] = [0] * len(nodes)  # the child with the most dense text
    for i in range(len(nodes) - 1, 0, -1):
        above = nodes[i].parent
        weight[above] += weight[i]
        titles[above] += titles[i]
        if not best[above] or weight[i] >= weight[best[above]]:
            best[above] = i
    at = 0
    while (below := best[at]) and weight[below] == weight[0] and titles[below] == titles[at] and nodes[below].tag not in LEAF_TAGS:
        at = below
    return at


def main_text(html: str | None) -> str:
    """The selected blocks, joined by line feeds."""
    page = read(html or "")
    if not page.blocks:
        return ""
    _spread_hints(page)
    dense = dense_blocks(page)
    if not any(dense):
        # Nothing but links or what class words name: there's no main text, unless nothing is lowered at all.
        return "\n".join(t for n, t, linked in page.blocks if page.nodes[n].hint == 1 and 2 * linked <= len(t))
    region, frame = _region(page, dense), menus(page)
    within = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        within[i] = i == region or i > 0 and within[node.parent]
    inner = {page.nodes[n].path for n, _, _ in page.blocks if within[n]}
    kept = []
    for (node, text, _), is_dense in zip(page.blocks, dense):
        own = page.nodes[node]
        if own.path in frame and not own.content:
            continue
        if is_dense and own.path in inner or within[node] and own.hint == 1:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. One pass, no shuffle."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
