"""A linear scanner of HTML: tags, raw elements, comments and the blocks of text between them.

Every step looks for a fixed string from where it stands and goes on behind what it found, so a page
takes time in proportion to its length whatever is left open. Inside a raw element only its own end
tag counts; an open comment or a raw element that never ends takes the rest of the page.
"""

from __future__ import annotations

import hashlib
import html
import re

# Fixed values of HTML: elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe noembed noframes template".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = RAW | set("nav footer aside form head button select option datalist svg math canvas object audio video dialog menu input label".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these kinds first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "li", "dd", "dt", "tbody", "thead", "tfoot", "caption", "summary"}
#: Words that name what isn't main text. A class, id or role names it if all its words are among these
#: and those below, which say nothing by themselves.
NOISE = set("ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
PLAIN = set("area bar block body bottom box button buttons center column container content empty footer form global group header holder inner items item js left link links list main module outer page panel post primary region right row secondary section side site slot small text title top user unit wrap wrapper widgets".split())
#: Elements that hold running text: a class says nothing about them.
TEXTUAL = HEADINGS | {"p", "pre", "blockquote"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STYLE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_STOP = re.compile("[>\"']")


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Ahead:
    """Where the next fixed string is. What one search has passed isn't searched again."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def find(self, what: str, at: int) -> int:
        since, found = self.known.get(what, (len(self.page) + 1, -1))
        if since > at or 0 <= found < at:
            found = self.page.find(what, at)
            self.known[what] = (at, found)
        return found


def _tag_end(page: str, at: int, ahead: _Ahead) -> int:
    """The place of the ``>`` that ends a tag, past quoted values; -1 if there is none. A quote opens
    a value only behind an equals sign, and not if the tag would never end then."""
    first = ahead.find(">", at)
    while first >= 0:
        m = _STOP.search(page, at)
        if not m:
            break
        if m[0] == ">":
            return m.start()
        opens = page[max(0, m.start() - 8) : m.start()].rstrip().endswith("=")
        end = ahead.find(m[0], m.end()) if opens else -1
        at = end + 1 if end >= 0 else m.end()
    return first


def tokens(page: str):
    """``(start, end, close, name, attributes)`` of every tag; comments, declarations and raw text
    come as tags without a name."""
    at, ahead, raw_ends = 0, _Ahead(page), {}
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = ahead.find("-->", start + 2)
            end = len(page) if end < 0 else end + 3
            yield start, end, False, "", ""
            at = end
            continue
        if page.startswith(("<!", "<?"), start):
            end = ahead.find(">", start)
            end = len(page) if end < 0 else end + 1
            yield start, end, False, "", ""
            at = end
            continue
        close = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + close)
        if not name:
            at = start + 1
            continue
        tag = name[0]
        cut = tag.find("<")  # a tag that was never closed before the next one
        end = _tag_end(page, name.end(), ahead) if cut < 0 else -1
        if end < 0:
            if ahead.find(">", start) < 0:  # no tag ends any more: what follows is one open tag
                yield start, len(page), close, "", ""
                return
            at = start + 1
            continue
        tag = tag.lower()
        yield start, end + 1, close, tag, page[name.end() : end]
        at = end + 1
        if not close and tag in RAW:
            where = raw_ends.get(tag, -2)
            if where == -2 or 0 <= where < at:
                m = _END[tag].search(page, at)
                where = raw_ends[tag] = m.start() if m else -1
            if where < 0:
                yield at, len(page), False, "", ""
                return
            end = ahead.find(">", where)
            yield at, len(page) if end < 0 else end + 1, True, tag, ""
            at = len(page) if end < 0 else end + 1


def names_noise(value: str) -> bool:
    """Whether a class, id or role holds a name that is made of words for noise."""
    for name in value.split():
        words = set(_WORD.findall(_CAMEL.sub("-", name).lower()))
        if words & NOISE and words <= NOISE | PLAIN:
            return True
    return False


class Node:
    """An open or closed element: its tag, the digests of its path and of its presentation, and its
    parent; ``noise`` and ``main`` are inherited."""

    __slots__ = ("tag", "path", "parent", "noise", "main", "style")

    def __init__(self, tag: str, path: int, parent: Node | None, noise: bool, main: bool, style: int):
        self.tag, self.path, self.parent, self.noise, self.main, self.style = tag, path, parent, noise, main, style


class Block:
    """The text of one block, the node that holds it, and whether it lies in the main element."""

    __slots__ = ("parts", "node", "main", "text", "content")

    def __init__(self, node: Node, main: bool):
        self.parts, self.node, self.main = [], node, main

    def close(self) -> bool:
        self.text = " ".join(html.unescape("".join(self.parts)).split())
        self.content = digest(self.text)
        return bool(self.text)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    root = Node("", 0, None, False, False, 0)
    stack, holders, opened = [root], [root], {}
    block: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal block
        if block is None:
            if not text.strip():
                return
            block = Block(holders[-1], stack[-1].main)
            out.append(block)
        block.parts.append(text)

    def pop() -> None:
        node = stack.pop()
        holders.pop()
        opened[node.tag] -= 1

    for start, end, close, tag, attributes in tokens(page):
        if start > at and not stack[-1].noise:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if close:
            if opened.get(tag):
                ends = tag in BLOCKS
                while stack[-1].tag != tag:
                    ends = ends or stack[-1].tag in BLOCKS
                    pop()
                if ends or stack[-1].noise != stack[-2].noise:
                    block = None
                pop()
            continue
        if tag in BLOCKS:
            block = None
            if tag in CLOSES_P and opened.get("p"):
                k = len(stack) - 1
                while stack[k].tag not in BLOCKS:
                    k -= 1
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
            if tag in CLOSES and stack[-1].tag in CLOSES[tag]:
                pop()
        if tag in VOID:
            continue
        top = stack[-1]
        look = {a.lower(): x or y or z or "" for a, x, y, z in _STYLE.findall(attributes)} if attributes else {}
        label = tag + "".join(f"[{k}={v.lower()}]" for k, v in sorted(look.items()))
        named = tag not in TEXTUAL and tag not in ("html", "body", "article", "main") and any(map(names_noise, look.values()))
        known = tag in DROPPED or (tag == "header" and not top.main) or named
        if attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        counts = tag in BLOCKS or bool(look)
        node = Node(tag, digest(f"{top.path}/{label}") if counts else top.path, top if counts else top.parent, top.noise or known, top.main or tag in ("article", "main"), digest(label) if counts else top.style)
        stack.append(node)
        holders.append(node if tag in BLOCKS else holders[-1])
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page) and not stack[-1].noise:
        add(page[at:])
    return [b for b in out if b.close()]
