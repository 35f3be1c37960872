"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its path of block elements from the root.
Per path, text length and punctuation are summed over its blocks and divided by
their number; links count against it.  A path's two ratios are smoothed with those
of the paths under the same parent, fused into one score and compared with the
spread of the page's scores.  Every block of a path that passes is main text.  The
content nodes are the content elements and the parents of the blocks that pass; all
blocks inside them are main text too, and so are the headings beside them.  The
body as the node with most of the text adds its headings, lists and tables only.

Landmarks that are never main text are left out before the ratios: menus, page
headers, footers, sidebars, forms, scripts and styles by element, notices, adverts
and reader comments by the names in their class or id.  A name that states
something (``has-sidebar``, ``comments-open``) names no landmark, and neither does
the class or id of ``article``, ``main`` and elements that carry a content name
(``post``, ``content``) as well: there the ratios decide.  They also decide about an
element with most of the page's text that only a word of its names calls a landmark.
Inline elements are left out where they are hidden or named adverts.

Contract for unusual input: a null or empty page, and one without text, gives the
empty text; unclosed, crossed and stray tags are read as browsers do in the
common cases; a page of any length is read whole; an empty table gives an empty
result; repeated rows give repeated results; other columns are ignored.  Time and memory
grow in proportion to the page, however deep its elements are nested: paths are numbers.
"""

from __future__ import annotations

import html as html_std
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import fresh

# Element names and class words.
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "noframes")
DROPPED = {
    "aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "menu", "nav",
    "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "xmp", "noframes",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var",
}
#: An element that the start of one of these closes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Elements that a closing of open paragraphs and cells does not reach beyond.
SCOPES = {"article", "aside", "body", "div", "dl", "footer", "header", "html", "main", "nav", "ol", "section", "table", "ul"}
CONTENT_ELEMENTS = {"article", "main"}
BOILERPLATE_WORDS = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs",
    "comment", "commentlist", "comments", "consent", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager",
    "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar",
    "topbar", "widget",
}
#: Of these, what readers write, however much of the page it is; and what an inline element is dropped for.
READER_WORDS = {"comment", "commentlist", "comments", "discussion", "disqus", "replies", "respond"}
INLINE_WORDS = {"ad", "ads", "adsbygoogle", "adsense", "advert", "advertisement", "adverts", "promo", "sponsor", "sponsored"}
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story"}
#: Words of names that state something about an element instead of naming it.
STATE_WORDS = {"closed", "disabled", "enabled", "has", "hide", "no", "open", "show", "with", "without"}
BOILERPLATE_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "menu", "navigation", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEPT_IN_BODY = {"blockquote", "dd", "dt", *HEADINGS, "li", "pre", "td", "th"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^>]*(?:>|\Z)",
    re.S,
)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)")
# one attribute after the other, values included, so that no value is read as a name
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_USED_ATTRIBUTES = {"class", "id", "role", "hidden", "aria-hidden"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")


@dataclass
class Paths:
    """Tag paths as numbers: each is a parent's number and a label, parents
    have smaller numbers than their children, 0 is the empty path."""

    parent: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    known: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, parent: int, label: str) -> int:
        found = self.known.setdefault((parent, label), len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent)
            self.label.append(label)
        return found

    def name(self, path: int) -> str:
        """The element's name."""
        return self.label[path].split(".")[0]

    def below(self, tops: set[int]) -> list[bool]:
        """Whether each path is one of ``tops`` or below one."""
        inside: list[bool] = []
        for path, parent in enumerate(self.parent):
            inside.append(path in tops or (path > 0 and inside[parent]))
        return inside

    def above(self, bottoms: set[int]) -> set[int]:
        """These paths and all above them."""
        found = {0}
        for path in bottoms:
            while path not in found:
                found.add(path)
                path = self.parent[path]
        return found


@dataclass
class Block:
    """Text between two block boundaries and where it stands.  ``doubt`` is
    the number of the element around it that only its class or id would drop."""

    path: int
    text: str
    linked: int
    in_content: int
    doubt: int


@dataclass
class Open:
    """An open block element: its path, whether its text counts, and what its
    ancestors and itself say: the innermost content element, the outermost one
    that a name calls content (paths, 0 for none), the doubt."""

    name: str
    path: int
    dropped: bool
    element: int
    named: int
    doubt: int


def attributes(attrs: str) -> dict[str, str]:
    """The attributes that matter here, first of each."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        name = m.group(1).lower()
        if name in _USED_ATTRIBUTES:
            found.setdefault(name, m.group(2) or m.group(3) or m.group(4) or "")
    return found


def names(found: dict[str, str]) -> list[list[str]]:
    """The words of every name in an element's class and id."""
    return [[w.lower() for w in _WORD.findall(name)] for a in ("class", "id") for name in found.get(a, "").split()]


def is_content_name(name: list[str]) -> bool:
    """Whether a name says content.  ``post-comments`` and ``sidebar-content``
    are about the landmark, ``content-sidebar-wrap`` is not."""
    if not CONTENT_WORDS.intersection(name):
        return False
    if STATE_WORDS.intersection(name):
        return True
    return name[-1] not in BOILERPLATE_WORDS and not (name[0] in BOILERPLATE_WORDS and name[-1] in CONTENT_WORDS)


def is_content(name: str, attrs: str) -> bool:
    """Whether an element says that it holds content."""
    if name in CONTENT_ELEMENTS:
        return True
    return name not in ("html", "body") and bool(attrs.strip()) and any(map(is_content_name, names(attributes(attrs))))


def is_boilerplate(name: str, attrs: str, in_content: bool) -> str:
    """Whether an element and all in it is never main text: "surely", "perhaps"
    where only the words of its names say so, or "" if not."""
    if name in DROPPED or (name == "header" and not in_content):
        return "surely"
    if not attrs.strip():
        return ""
    found = attributes(attrs)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "surely"
    if found.get("role", "").lower() in BOILERPLATE_ROLES:
        return "surely"
    if name in ("html", "body") or is_content(name, attrs):
        return ""
    words = {w for n in names(found) if not STATE_WORDS.intersection(n) for w in n}
    if words & READER_WORDS:
        return "surely"
    return "perhaps" if words & BOILERPLATE_WORDS or ("header" in words and not in_content) else ""


def is_inline_boilerplate(attrs: str) -> bool:
    """Whether an inline element is hidden or an advert."""
    if not attrs.strip():
        return False
    found = attributes(attrs)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    return any(INLINE_WORDS.intersection(n) for n in names(found))


def label_of(name: str, attrs: str) -> str:
    """A path label: the element with its first class word, if any."""
    m = re.match(r"\s*([\w-]+)", attributes(attrs).get("class", "")) if attrs.strip() else None
    return f"{name}.{m.group(1)}" if m else name


class Stack:
    """The open block elements, with the places of each name, so that no search
    walks down the stack."""

    def __init__(self) -> None:
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, element: Open) -> None:
        self.places[element.name].append(len(self.open))
        if element.name in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(element)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.open) > place:
            name = self.open.pop().name
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()

    def last(self, *names: str, in_scope: bool) -> int:
        """Place of the last open element of these names, -1 if none."""
        place = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        return -1 if in_scope and self.scopes and place < self.scopes[-1] else place


def blocks(page: str) -> tuple[Paths, list[Block]]:
    """The page's blocks of text outside landmarks, in page order, and the
    paths they stand on.  Takes time in proportion to the page."""
    out: list[Block] = []
    paths, stack = Paths(), Stack()
    text: list[str] = []
    linked, links_open, doubts = 0, 0, 0
    # an inline element that is dropped: its name, how many of it are open, and the place of its block
    muted, muted_open, muted_at = "", 0, 0
    outside = Open("", 0, False, 0, 0, 0)

    def top() -> Open:
        return stack.open[-1] if stack.open else outside

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", html_std.unescape("".join(text))).strip()
        if joined:
            # the innermost content element; without one, the outermost element whose class or id says content
            out.append(Block(top().path, joined, min(linked, len(joined)), top().element or top().named, top().doubt))
        text.clear()
        linked = 0

    def keep(piece: str) -> None:
        nonlocal linked
        if piece and not muted and not top().dropped:
            text.append(piece)
            if links_open:
                linked += len(piece)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            keep(page[at:])
            break
        keep(page[at : m.start()])
        at = m.end()
        tag = m if m.group("name") else _LOOSE.match(m.group())
        if not tag:
            continue
        name = tag.group("name").lower()
        if tag.group("end"):
            if name in INLINE:
                if name == "a":
                    links_open = max(0, links_open - 1)
                if name == muted:
                    muted_open -= 1
                    muted = muted if muted_open else ""
                continue
            if name == "br":
                keep(" ")
                continue
            place = stack.last(name, in_scope=name == "p")
            if place >= 0:
                flush()
                links_open = 0
                stack.cut(place)
                if place < muted_at:
                    muted = ""
            continue
        attrs = tag.group("attrs")
        if name in VOID:
            if name == "hr":
                flush()
            else:
                keep(" " if name in ("br", "wbr", "img") else "")
            continue
        if name in INLINE:
            links_open += name == "a"
            if muted:
                muted_open += name == muted
            elif is_inline_boilerplate(attrs):
                muted, muted_open, muted_at = name, 1, len(stack.open)
            continue
        flush()
        links_open = 0
        # what the start of this element closes
        place = stack.last("p", *CLOSED_BY.get(name, ()), in_scope=True)
        if place >= 0:
            stack.cut(place)
            if place < muted_at:
                muted = ""
        around = top()
        judged = "surely" if around.dropped else is_boilerplate(name, attrs, bool(around.element or around.named))
        if not attrs.rstrip().endswith("/") or name not in ("svg", "path"):
            path, doubt = paths.child(around.path, label_of(name, attrs)), around.doubt
            if judged == "perhaps":
                if doubt:  # within another: that one's blocks may stay, this one's do not
                    judged = "surely"
                else:
                    doubts += 1
                    doubt = doubts
            content = not judged and is_content(name, attrs)
            element = path if content and name in CONTENT_ELEMENTS else around.element
            stack.push(Open(name, path, judged == "surely", element, around.named or (path if content else 0), doubt))
        if name in RAW_TEXT:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    flush()
    return paths, without_doubt(out)


def without_doubt(found: list[Block]) -> list[Block]:
    """The blocks outside elements that only a class or id word would drop.  An
    element of several blocks, or with a content element, that has most of the
    page's text is no landmark, whatever its name, unless there is a content
    element elsewhere."""
    size: dict[int, int] = defaultdict(int)
    parts: dict[int, int] = defaultdict(int)
    for b in found:
        size[b.doubt] += len(b.text) - b.linked
        parts[b.doubt] += 2 if b.in_content else 1
    whole, elsewhere = sum(size.values()), any(b.in_content and not b.doubt for b in found)
    return [b for b in found if not b.doubt or (2 * size[b.doubt] > whole and parts[b.doubt] > 1 and not elsewhere)]


def path_scores(paths: Paths, found: list[Block]) -> dict[int, float]:
    """The fused score of every path."""
    sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(3))
    for b in found:
        # text that is not link text, punctuation, blocks
        sums[b.path] += (len(b.text) - b.linked, len(_PUNCTUATION.findall(b.text)), 1)
    family: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(3))
    for path, s in sums.items():
        family[paths.parent[path]] += s
    out = {}
    for path, s in sums.items():
        around = family[paths.parent[path]]
        own, near = s[:2] / s[2], around[:2] / around[2]
        length, punctuation = (own + near) / 2
        out[path] = float(np.sqrt(length * (1 + punctuation)))
    return out


def main_text(page: str | None) -> str:
    """The main text of a page."""
    paths, found = blocks(page or "")
    if not found:
        return ""
    scores = path_scores(paths, found)
    spread = float(np.std(list(scores.values())))
    passing = {p for p, s in scores.items() if s >= spread}
    # the content node: the content element, else the parent, with most text of passing paths
    weight: dict[tuple[int, bool], int] = defaultdict(int)
    for b in found:
        if b.path in passing:
            key = (b.in_content, True) if b.in_content else (paths.parent[b.path], False)
            weight[key] += len(b.text) - b.linked
    if not weight:
        return " ".join(b.text for b in found)
    node, is_element = max(weight, key=lambda k: (weight[k], k))
    if not is_element:
        # a wrapper that holds nearly all of the text is the better node than one of its parts
        total, own = sum(weight.values()), weight[(node, is_element)]
        under = [0] * len(paths.parent)
        for (path, _), w in weight.items():
            under[path] += w
        for path in range(len(under) - 1, 0, -1):  # children before parents
            under[paths.parent[path]] += under[path]
        wrapper = paths.parent[node]
        while wrapper and own < 0.8 * total:
            if under[wrapper] > 1.2 * own:
                node = wrapper
                break
            wrapper = paths.parent[wrapper]
        parent = paths.parent[node]
        if parent and paths.label[node] in ("div", "section", "td") and paths.name(parent) not in ("body", "html"):
            node = parent  # a nameless wrapper around the paragraphs: its title and lists stand beside it
    # all blocks inside the nodes of the text that passes, the heaviest one included, and inside content elements
    nodes = {p for p, _ in [*weight, (node, is_element)]} | {b.in_content for b in found if b.in_content}
    whole = {p for p in nodes if p and paths.name(p) not in ("body", "html")}
    in_body = not (node and node in whole)
    around, inside, in_node = paths.above(nodes), paths.below(whole), paths.below({node})

    def kept(b: Block) -> bool:
        name = paths.name(b.path)
        if b.path in passing or inside[b.path]:
            return True
        if b.path and name in HEADINGS and paths.parent[b.path] in around:
            return True
        return in_body and in_node[b.path] and name in KEPT_IN_BODY

    return " ".join(b.text for b in found if kept(b))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars`` (code points),
    which replace columns of these names."""
    others = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    raw = fresh(pages, "raw_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(raw).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*others, "text", "n_chars"],
            )

    rows = pages.select(*others, F.col(html_col).cast("string").alias(raw))
    schema = rows.drop(raw).schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
