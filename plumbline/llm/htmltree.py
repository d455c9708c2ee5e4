"""A small tolerant HTML reader: block elements with what stands in them, for the wrapper operator."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import xxhash

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]{0,4096}\"|'[^']{0,4096}'|[\"'])*+)>", re.S)
_CUT = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ATTRIBUTES = ("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style")

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that end an open one of the first kind, unless one of the second kind stands between.
SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "body": ({"head"}, set()),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}),
}
# Elements and marks of what is no article.
DROPPED_TAGS = frozenset("head nav header footer aside form script style title noscript template iframe button select textarea input object svg canvas dialog menu map audio video xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup sidebar sidebars aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs nav navbar "
    "navigation menu menus pagination pager footer foot header masthead topbar toolbar skip".split()
)
KEPT_MARKS = frozenset("article articlebody post entry story main content text body".split())


class Element:
    """An element that makes a block, or an inline one that is dropped by its marks.

    ``parts`` holds texts and elements in page order; the texts of plain inline
    elements are the parent's.  ``chars``, ``links`` (characters inside links) and
    ``digest`` are of all below that isn't dropped.
    """

    __slots__ = ("tag", "key", "dropped", "kept", "parts", "parent", "depth", "link_texts", "chars", "links", "digest")

    def __init__(self, tag: str, key: str, dropped: bool, kept: int, parent: Element | None):
        self.tag, self.key, self.dropped, self.kept, self.parent = tag, key, dropped, kept, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[str | Element] = []
        self.link_texts: set[int] = set()
        self.chars = self.links = self.digest = 0

    def children(self) -> list[Element]:
        return [x for x in self.parts if not isinstance(x, str)]

    def measure(self) -> None:
        h = xxhash.xxh64(self.key.encode())
        for i, part in enumerate(self.parts):
            if isinstance(part, str):
                h.update(part.encode("utf-8", "surrogatepass"))
                n = sum(map(len, part.split()))
                self.chars, self.links = self.chars + n, self.links + (n if i in self.link_texts else 0)
            elif not part.dropped:
                part.measure()
                h.update(part.digest.to_bytes(8, "little"))
                self.chars, self.links = self.chars + part.chars, self.links + part.links
        self.digest = h.intdigest()


def _marks(value: str) -> list[str]:
    """Words of a class or id, lower-cased, camel case apart, digits left out."""
    apart = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    return [w for w in re.split(r"[^a-z]+", apart.lower()) if w]


_SEEN: dict[tuple[str, str], tuple[str, bool, int]] = {}


def _judged(tag: str, written: str) -> tuple[str, bool, int]:
    """Key, whether dropped, and how much an element is marked as the article (2 by its kind, 1 by its class)."""
    if (found := _SEEN.get((tag, written))) is None:
        attributes = {}
        for m in _ATTRIBUTE.finditer(written):
            if (name := m[1].lower()) in _ATTRIBUTES:
                attributes.setdefault(name, m[2] or m[3] or m[4] or "")
        marks = _marks(attributes.get("class", "")) + _marks(attributes.get("id", ""))
        role = attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "").lower())
        main = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
        marked = not main and tag not in ("html", "body") and not DROPPED_MARKS.isdisjoint(marks)
        dropped = tag in DROPPED_TAGS or role in DROPPED_ROLES or bool(hidden) or marked
        found = (".".join([tag, *sorted(set(marks))]), dropped, 2 if main else int(not KEPT_MARKS.isdisjoint(marks)))
        if len(_SEEN) > 10_000:
            _SEEN.clear()
        _SEEN[tag, written] = found
    return found


#: An element deeper than this only divides blocks: what it holds is its parent's.
_DEEPEST = 150


def parse(html: str | None) -> Element:
    """The page's tree.  Unclosed and stray tags are read as browsers read them, in the main."""
    root = at = Element("html", "html", False, 0, None)
    html, pos, end, link = html or "", 0, len(html or ""), 0

    def text(piece: str) -> None:
        if piece:
            if link:
                at.link_texts.add(len(at.parts))
            at.parts.append(unescape(piece) if "&" in piece else piece)

    def up_to(kinds: set[str], fence: set[str]) -> Element | None:
        x = at
        while x is not root and x.tag not in fence:
            if x.tag in kinds:
                return x
            x = x.parent
        return None

    while pos < end:
        m = _TOKEN.search(html, pos)
        if not m:
            cut = _CUT.search(html, pos)
            text(html[pos : cut.start() if cut else end])
            break
        text(html[pos : m.start()])
        pos, tag = m.end(), (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = 0
            if tag not in INLINE or at.tag == tag:
                found = up_to({tag}, {"td", "th"} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else set())
                if found:
                    at, link = found.parent, 0
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, pos)
            pos = close.end() if close else end
            continue
        if tag in ("html", "body") and tag in (at.tag, root.tag if tag == "html" else ""):
            continue
        key, dropped, kept = _judged(tag, m[3])
        if tag == "br":
            text(" ")
        if tag in INLINE and (tag in VOID or not (dropped or at.tag == tag)):
            link = link + 1 if tag == "a" else link
            continue
        if tag in CLOSES_P and (open_p := up_to({"p"}, {"table", "td", "th"})):
            at = open_p.parent
        while tag in SELF_CLOSING and (found := up_to(*SELF_CLOSING[tag])):
            at = found.parent
        made = Element(tag, key, dropped, kept, at)
        at.parts.append(made)
        if tag not in INLINE:
            link = 0
        if tag not in VOID and not m[3].rstrip().endswith("/") and made.depth < _DEEPEST:
            at = made
    root.measure()
    return root


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def blocks(element: Element, left_out: set[int]) -> Iterator[str]:
    """Texts of the blocks in page order, white space single; ``left_out`` has the ``id`` of further elements to drop.

    An article's own header keeps its headings.
    """
    line: list[str] = []
    for part in element.parts:
        if isinstance(part, str):
            line.append(part)
        elif part.tag in INLINE:
            continue
        else:
            if found := " ".join("".join(line).split()):
                yield found
            line = []
            if part.dropped and part.tag == "header":
                yield from headings(part)
            elif not part.dropped and id(part) not in left_out:
                yield from blocks(part, left_out)
    if found := " ".join("".join(line).split()):
        yield found


def headings(element: Element) -> Iterator[str]:
    for part in element.children():
        if part.tag in _HEADINGS and not part.dropped:
            yield from blocks(part, set())
        elif not part.dropped or part.tag == "hgroup":
            yield from headings(part)
