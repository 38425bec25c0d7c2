"""A forgiving reader of HTML: the text blocks of a page with what their markup says of them.

End tags may be missing or stray, tags and references cut off, quotes left open.  A block is the
text between two block-level tags; inline tags join, ``br`` is white space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names of HTML by their part in a page, and words that name page furniture.
RAW = frozenset("script style noscript template iframe noframes noembed textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split())
FURNITURE = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label "
    "map menu nav noscript object optgroup option output progress script search select style svg "
    "template textarea title video".split())
FURNITURE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha "
    "comment comments consent cookie cookies disclaimer disqus footer form gdpr header login "
    "masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion related respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget widgets".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
          "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
          "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
          "tbody": ("tr td th thead tbody tfoot", ("table",)),
          "tfoot": ("tr td th thead tbody tfoot", ("table",))}

_TAG = re.compile(
    r"<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)(?:>|\Z)")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I) for tag in RAW}
#: The stream token that stands for text that markup calls the article.
BREAK = "\x01"


@dataclass
class Block:
    text: str
    level: int  # 2 inside an article, 1 inside the main part, 0 elsewhere
    linked: int  # characters of it inside links
    start: int  # its tokens in the page's stream
    stop: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)  # without what markup calls furniture
    stream: list[str] = field(default_factory=list)  # tags and words outside articles


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _furniture(tag: str, attrs: dict[str, str], inside: int) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" \
            or _HIDDEN.search(attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if tag in ("html", "body"):
        return False
    names = attrs.get("class", "") + " " + attrs.get("id", "")
    words = {w.lower() for w in _WORD.findall(names)}
    if tag in ("h1", "h2", "header") and inside:
        words -= {"header", "banner"}
    return not words.isdisjoint(FURNITURE_WORDS)


def _level(tag: str, attrs: dict[str, str]) -> int:
    if tag == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        return 2
    return int(tag == "main" or attrs.get("role", "").lower() == "main")


class _Stack:
    """Open elements, each with what holds inside it: furniture, level, link."""

    def __init__(self):
        self.rows: list[tuple[str, bool, int, bool, bool, int]] = []
        self.open: Counter = Counter()
        self.dropped, self.level, self.linked = False, 0, False

    def push(self, tag: str, furniture: bool, level: int) -> None:
        self.dropped = self.dropped or furniture
        self.level = max(self.level, level)
        self.linked = self.linked or tag == "a"
        self.rows.append((tag, self.dropped, self.level, self.linked, furniture, level))
        self.open[tag] += 1

    def cut(self, i: int) -> list[tuple]:
        """Close everything from the i-th element on."""
        gone = self.rows[i:]
        del self.rows[i:]
        self.open.subtract(e[0] for e in gone)
        self.dropped, self.level, self.linked = self.rows[-1][1:4] if self.rows else (False, 0, False)
        return gone

    def end(self, tag: str) -> None:
        """An end tag: closes its element; an inline one does not close blocks opened in it."""
        if self.open[tag] <= 0:
            return
        i = len(self.rows) - 1
        crossed = False
        while self.rows[i][0] != tag:
            crossed = crossed or self.rows[i][0] in BLOCK
            i -= 1
        above = self.cut(i)[1:]
        if crossed and tag not in BLOCK:
            for e in above:
                self.push(e[0], e[4], e[5])

    def close(self, names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        """Close the outermost open element of some names that lies within the barrier."""
        if not any(self.open[n] > 0 for n in names):
            return
        found = None
        for i in range(len(self.rows) - 1, -1, -1):
            if self.rows[i][0] in names:
                found = i
            elif self.rows[i][0] in barrier:
                break
        if found is not None:
            self.cut(found)


def read_page(source: str | None) -> Page:
    """The blocks and the token stream of a page; nothing for a null or empty one."""
    page, stack = Page(), _Stack()
    stream, kept = page.stream, []
    linked = first = at = 0
    source = source or ""

    def flush() -> None:
        nonlocal linked, first
        if kept:
            text = " ".join("".join(kept).split())
            if text:
                page.blocks.append(Block(text, stack.level, linked, first, len(stream)))
            kept.clear()
        linked, first = 0, len(stream)

    while at < len(source):
        m = _TAG.search(source, at)
        text = source[at:m.start() if m else len(source)]
        if text:
            text = html.unescape(text) if "&" in text else text
            if not stack.dropped:
                kept.append(text)
                if stack.linked:
                    linked += len("".join(text.split()))
            if not stack.level or stack.dropped:
                stream.extend(text.split())
        if m is None:
            break
        at = m.end()
        end, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if tag == "br":
            if not stack.dropped:
                kept.append(" ")
            continue
        attrs = _attributes(m.group(3)) if m.group(3) and not end else {}
        if tag in BLOCK:
            flush()
            if not end:
                if tag not in ("html", "body", "head", "option", "optgroup"):
                    stack.close(("p",), ("td", "th", "button", "caption", "table"))
                if tag in CLOSES:
                    stack.close(tuple(CLOSES[tag][0].split()), CLOSES[tag][1])
                if tag not in ("html", "head"):
                    stack.close(("head",), ())
        if not stack.level or stack.dropped:
            stream.append("</" + tag if end else
                          "<" + tag + "." + ".".join(attrs.get("class", "").split()))
        elif stream and stream[-1] != BREAK:
            stream.append(BREAK)
        if end:
            stack.end(tag)
        elif tag in RAW:
            close = _END[tag].search(source, at)
            at = close.start() if close else len(source)
            stop = source.find(">", at)
            at = len(source) if stop < 0 else stop + 1
        elif tag not in VOID and (tag in BLOCK or not (m.group(3) or "").rstrip().endswith("/")):
            stack.push(tag, _furniture(tag, attrs, stack.level), _level(tag, attrs))
        if not kept:
            first = len(stream)
    flush()
    return page
