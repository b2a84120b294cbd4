"""Documents as trees that can be changed and written again: parsed as XML, else as HTML with whatever it leaves open closed."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser
from xml.parsers import expat

from vellum.sources import encodings
from vellum.sources.elements import VOID

#: Entities within entities, and how many times its length a document may grow by them.
DEPTH, GROWTH = 4, 10
# Elements that end an open one of the same or a related kind where HTML leaves end tags out.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Blocks, before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
# Names of drawings that have capitals.
SVG_NAMES = {n.lower(): n for n in "viewBox preserveAspectRatio linearGradient radialGradient clipPath textPath foreignObject gradientUnits gradientTransform patternUnits clipPathUnits startOffset baseFrequency stdDeviation feGaussianBlur feOffset feBlend feColorMatrix".split()}


class Node:
    """An element: `tag`, `attrs`, and `children`, which are elements and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, children: list | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None
        for c in children or []:
            self.add(c)

    def add(self, child, at: int | None = None):
        if isinstance(child, Node):
            child.parent = self
        self.children.insert(len(self.children) if at is None else at, child)
        return child

    def walk(self) -> Iterator[Node]:
        """The element and all below it, in document order."""
        open_ = [self]
        while open_:
            node = open_.pop()
            yield node
            open_ += [c for c in reversed(node.children) if isinstance(c, Node)]

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                open_ += reversed(x.children)
        return "".join(out)

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def place(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def drop(self, keep: bool = False) -> None:
        """Takes the element out; with `keep` what is in it takes its place."""
        at, parent = self.place(), self.parent
        parent.children[at : at + 1] = self.children if keep else []
        for c in self.children if keep else ():
            if isinstance(c, Node):
                c.parent = parent

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def style(self, declarations: str) -> None:
        """Adds declarations in front of those that the element has, which thus outrank them."""
        own = self.attrs.get("style", "").strip().rstrip(";")
        self.attrs["style"] = "; ".join(x for x in (declarations, own) if x)


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        names = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        node = self.at
        while node is not self.root and names and node.tag not in ("table", "ul", "ol", "dl", "div", "section", "body"):
            if node.tag in names:
                self.at = node.parent
            node = node.parent
        made = self.at.add(Node(tag, {k: v if v is not None else "" for k, v in attrs}))
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.add(data)


def expanded(text: str) -> str:
    """A document with the entities that it declares itself put in; external ones, deep nesting and great growth are refused
    by leaving the reference as it is."""
    found = re.search(r"<!DOCTYPE[^\[>]*\[(.*?)\]\s*>", text, re.S | re.I)
    if not found:
        return text
    own = dict(re.findall(r"""<!ENTITY\s+([\w.-]+)\s+"([^"]*)"\s*>""", found.group(1)))
    whole = {}
    for name in own:
        value = own[name]
        for _ in range(DEPTH):
            value = re.sub(r"&([\w.-]+);", lambda m: own.get(m.group(1), m.group(0)), value)
            if len(value) > GROWTH * len(text):
                break
        if not any(f"&{n};" in value for n in own) and len(value) <= GROWTH * len(text):
            whole[name] = value
    body = text[found.end() :]
    grown = re.sub(r"&([\w.-]+);", lambda m: whole.get(m.group(1), m.group(0)), body)
    if len(grown) > GROWTH * len(text):
        grown = body
    return text[: found.start()] + "<!DOCTYPE html>" + grown


def _xml(text: str) -> Node:
    root = Node("")
    at = [root]
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(tag, attrs):
        at.append(at[-1].add(Node(tag, dict(attrs))))

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: at.pop()
    parser.CharacterDataHandler = lambda data: at[-1].add(data)
    parser.Parse(text.encode("utf-8"), True)
    return root


def parse(data: bytes | str | None) -> tuple[Node, str]:
    """(root, mode): the mode is `xml` where the document is well-formed, else `html`. The root has no name; what isn't an
    element in a document (types, instructions, comments) is left out, and sheets that instructions name become links."""
    text = data if isinstance(data, str) else encodings.read_text(data)[0] or ""
    sheets = re.findall(r'<\?xml-stylesheet[^?]*href\s*=\s*"([^"]+)"', text)
    text = expanded(text)
    numbered = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: f"&#{name2codepoint[m.group(1)]};" if m.group(1) in name2codepoint and m.group(1) not in ("amp", "lt", "gt", "quot") else m.group(0), text)
    try:
        root, mode = _xml(re.sub(r"<\?xml[^>]*\?>", "", numbered, count=1).strip()), "xml"
    except (expat.ExpatError, ValueError):
        reader = _Html()
        reader.feed(re.sub(r"<\?.*?\?>", "", text, flags=re.S))
        reader.close()
        root, mode = reader.root, "html"
    for node in root.walk():
        if node.tag == "svg":
            for inner in node.walk():
                inner.tag = SVG_NAMES.get(inner.tag, inner.tag)
                inner.attrs = {SVG_NAMES.get(k, k): v for k, v in inner.attrs.items()}
    head = root.first("head")
    for href in sheets if head else ():
        head.add(Node("link", {"rel": "stylesheet", "type": "text/css", "href": href}))
    return root, mode


def serialise(node: Node) -> str:
    """The tree as XML that HTML readers take too: elements without content that may have some are written with both tags."""
    out: list[str] = []
    open_: list = [node]
    while open_:
        x = open_.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(html.escape(x, quote=False))
        elif not x.tag:
            open_ += reversed(x.children)
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items())
            if x.tag in VOID and not x.children:
                out.append(f"<{x.tag}{attrs}/>")
            else:
                out.append(f"<{x.tag}{attrs}>")
                open_.append((f"</{x.tag}>",))
                open_ += reversed(x.children)
    return "".join(out)


def is_declared_html(data: bytes | None, media_type: str | None = None) -> bool:
    """Whether a document says of itself that it is HTML and not XML."""
    head = (data or b"")[:1024].lower()
    return media_type == "text/html" or (b"<?xml" not in head and b"http://www.w3.org/1999/xhtml" not in head)


def srcset(value: str) -> list[tuple[str, str]]:
    """(address, descriptor) of the candidates of a `srcset`; an address may hold commas, though not at its end."""
    out, rest = [], value.strip()
    while rest:
        rest = rest.lstrip(" \t\n\r\f,")
        if not rest:
            break
        url, _, rest = rest.partition(" ") if " " in rest else (rest, "", "")
        if url.endswith(","):
            out.append((url.rstrip(","), ""))
            continue
        depth, cut = 0, len(rest)
        for i, c in enumerate(rest):
            depth += (c == "(") - (c == ")")
            if c == "," and depth <= 0:
                cut = i
                break
        out.append((url, rest[:cut].strip()))
        rest = rest[cut + 1 :]
    return out


def references(data: bytes | str | None) -> list[str]:
    """Whatever a text may refer to, read loosely: addresses in attributes, candidates of pictures, `url()` and imports."""
    text = data if isinstance(data, str) else (data or b"").decode("utf-8", "replace")
    found = [html.unescape(a or b) for a, b in re.findall(r"""(?:href|src|poster|data|altimg)\s*=\s*(?:"([^"]*)"|'([^']*)')""", text, re.I)]
    for a, b in re.findall(r"""srcset\s*=\s*(?:"([^"]*)"|'([^']*)')""", text, re.I):
        found += [u for u, _ in srcset(html.unescape(a or b))]
    found += [u.strip() for u in re.findall(r"""url\(\s*["']?([^"')]+)""", text, re.I)] + re.findall(r"""@import\s+["']([^"']+)""", text, re.I)
    return list(dict.fromkeys(u for u in found if u))
