"""Repairs of documents: presentational markup, stray attributes, misplaced content, skeletons, dead references, spans, marks.

Each step takes a tree and what is known of the book (`Known`), changes the tree and gives the names of what it did, one
for each change. `rewritten` runs steps over documents in batches; a document whose text a step must not touch comes out as
it was if a character was lost on the way.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.sources import encodings, trees
from vellum.sources.trees import Node

# Sizes of the `font` element, and the sizes and families that elements without a meaning stood for.
FONT_SIZES = {"1": "x-small", "2": "small", "3": "medium", "4": "large", "5": "x-large", "6": "xx-large", "7": "xxx-large"}
DEAD = {"center": "text-align: center", "tt": "font-family: monospace", "big": "font-size: larger", "strike": "text-decoration: line-through", "font": "", "basefont": "", "blink": "", "marquee": "", "nobr": "white-space: nowrap"}
# Attributes that any element may have, those of some elements, and beginnings that are let through.
GLOBAL = frozenset("id class style title lang dir hidden tabindex accesskey role draggable translate contenteditable spellcheck itemid itemprop itemref itemscope itemtype xml:lang xmlns".split())
OWN = {
    "a": "href rel type download hreflang target ping", "img": "src alt width height srcset sizes loading usemap ismap", "link": "rel href type media sizes hreflang", "meta": "name content charset http-equiv property", "td": "colspan rowspan headers",
    "th": "colspan rowspan headers scope abbr", "col": "span", "colgroup": "span", "ol": "start type reversed", "li": "value", "blockquote": "cite", "q": "cite", "audio": "src controls loop autoplay preload muted", "video": "src controls loop autoplay preload muted poster width height",
    "source": "src srcset type media sizes", "script": "src type defer async", "style": "type media", "object": "data type width height name", "iframe": "src width height name", "time": "datetime", "html": "prefix version", "svg": "*", "math": "*", "input": "*", "form": "*", "track": "*", "area": "*", "map": "name", "param": "*", "data": "value", "del": "cite datetime", "ins": "cite datetime",
}
LET_THROUGH = ("data-", "aria-", "epub:", "xml:", "xmlns", "on", "ssml:", "xlink:")
# What a head may hold, and what a table may.
HEAD = frozenset("title meta link base style script noscript template".split())
TABLE = frozenset("caption colgroup col thead tbody tfoot tr script template".split())
BLOCKS = frozenset("p div ul ol dl table blockquote section article h1 h2 h3 h4 h5 h6 pre figure hr".split())
INLINE = frozenset("span b i em strong a small sup sub u cite code".split())


@dataclass
class Known:
    """What a document's step may know: its path, files of the book, ids by file, classes that sheets style, and choices."""

    path: str = ""
    files: frozenset[str] = frozenset()
    ids: dict[str, frozenset[str]] = field(default_factory=dict)
    inert: frozenset[str] = frozenset()
    title: str = ""
    language: str = "en"
    strict: bool = False
    scripts: bool = True


def _length(value: str) -> str:
    value = value.strip()
    return f"{value}px" if re.fullmatch(r"\d+(\.\d+)?", value) else value


def modernised(root: Node, known: Known) -> list[str]:
    """Presentational attributes become declarations; elements without a meaning become spans or blocks, or go if nothing is left of them."""
    done = []
    for node in list(root.walk()):
        says = []
        for name, make in (
            ("align", lambda v: f"float: {v}" if node.tag in ("img", "table") and v in ("left", "right") else f"text-align: {v}"), ("valign", lambda v: f"vertical-align: {v}"), ("bgcolor", lambda v: f"background-color: {v}"),
            ("hspace", lambda v: f"margin-left: {_length(v)}; margin-right: {_length(v)}"), ("vspace", lambda v: f"margin-top: {_length(v)}; margin-bottom: {_length(v)}"), ("nowrap", lambda v: "white-space: nowrap"),
            ("border", lambda v: f"border: {_length(v)} solid" if v.strip("0") else "border: 0"), ("cellspacing", lambda v: f"border-spacing: {_length(v)}"),
        ):
            if name in node.attrs and node.tag not in ("svg", "math", ""):
                says.append(make(node.attrs.pop(name).strip().lower()))
        if node.tag not in ("img", "svg", "video", "iframe", "object", "canvas", "math", "source", ""):
            says += [f"{n}: {_length(node.attrs.pop(n))}" for n in ("width", "height") if n in node.attrs]
        elif node.tag == "img":
            says += [f"{n}: {node.attrs.pop(n)}" for n in ("width", "height") if not re.fullmatch(r"\d*", node.attrs.get(n, ""))]
        if node.tag == "font":
            size = node.attrs.pop("size", "").lstrip("+")
            says += [x for x in (f"color: {node.attrs.pop('color')}" if "color" in node.attrs else "", f"font-family: {node.attrs.pop('face')}" if "face" in node.attrs else "", f"font-size: {FONT_SIZES[size]}" if size in FONT_SIZES else "") if x]
        if node.tag in DEAD:
            says += [DEAD[node.tag]] if DEAD[node.tag] else []
            done.append(f"element:{node.tag}")
            node.tag = "div" if node.tag == "center" else "span"
            if says:
                node.style("; ".join(says))
            elif not node.attrs:
                node.drop(keep=True)
        elif says:
            node.style("; ".join(says))
            done.append("attribute")
    return done


def swept(root: Node, known: Known) -> list[str]:
    """Attributes that neither all elements nor this one may have go; a break's `clear` and a rule's `size` are kept as style."""
    done = []
    for node in root.walk():
        if node.tag in ("", "svg", "math") or any(a.tag in ("svg", "math") for a in node.above()):
            continue
        own = OWN.get(node.tag, "").split()
        if node.tag == "br" and "clear" in node.attrs:
            value = node.attrs.pop("clear").lower()
            node.style(f"clear: {'both' if value == 'all' else value}")
        if node.tag == "hr" and "size" in node.attrs:
            node.style(f"height: {_length(node.attrs.pop('size'))}")
        for name in [n for n in node.attrs if own != ["*"] and n not in GLOBAL and n not in own and not n.startswith(LET_THROUGH)]:
            del node.attrs[name]
            done.append(f"attribute:{name}")
    return done


def put_in_place(root: Node, known: Known) -> list[str]:
    """What a head or a table can't hold moves to where it belongs; neighbouring loose columns get a group."""
    done = []
    head, body = root.first("head"), root.first("body")
    if head is not None and body is not None:
        stray = [c for c in head.children if (c.tag not in HEAD if isinstance(c, Node) else c.strip())]
        for k, c in enumerate(stray):
            head.children.remove(c)
            body.add(c, k)
            done.append("from-head")
    for table in [n for n in root.walk() if n.tag == "table"]:
        for c in [c for c in table.children if (c.tag not in TABLE if isinstance(c, Node) else c.strip())]:
            table.children.remove(c)
            table.parent.add(c, table.place())
            done.append("from-table")
        i = 0
        while i < len(table.children):
            run = [c for c in table.children[i:] if not (isinstance(c, str) and not c.strip())]
            if isinstance(table.children[i], Node) and table.children[i].tag == "col":
                columns = []
                for c in run:
                    if not (isinstance(c, Node) and c.tag == "col"):
                        break
                    columns.append(c)
                for c in columns:
                    table.children.remove(c)
                table.add(Node("colgroup", children=columns), i)
                done.append("column-group")
            i += 1
    return done


def skeleton(root: Node, known: Known) -> list[str]:
    """A document has a root with a language, a head with one encoding and a title that says something, and a body."""
    done = []
    page = root.first("html")
    if page is None:
        page = Node("html", {"xmlns": "http://www.w3.org/1999/xhtml"}, root.children)
        root.children = [page]
        page.parent = root
        done.append("root")
    body = next((c for c in page.children if isinstance(c, Node) and c.tag == "body"), None)
    head = next((c for c in page.children if isinstance(c, Node) and c.tag == "head"), None)
    if body is None:
        loose = [c for c in page.children if c is not head]
        page.children = [head] if head is not None else []
        body = page.add(Node("body", children=loose))
        done.append("body")
    if head is None:
        head = page.add(Node("head"), 0)
        done.append("head")
    if not (page.attrs.get("lang") or page.attrs.get("xml:lang")):
        done.append("language")
    language = page.attrs.get("xml:lang") or page.attrs.get("lang") or known.language
    page.attrs["lang"] = page.attrs["xml:lang"] = language
    sets = [n for n in head.walk() if n.tag == "meta" and ("charset" in n.attrs or n.attrs.get("http-equiv", "").lower() == "content-type")]
    if len(sets) != 1 or sets[0].attrs != {"charset": "utf-8"}:
        for n in sets:
            n.drop()
        head.add(Node("meta", {"charset": "utf-8"}), 0)
        done.append("encoding")
    title = next((c for c in head.children if isinstance(c, Node) and c.tag == "title"), None)
    if title is None or not title.text().strip():
        heading = body.first("h1", "h2", "h3")
        name = (" ".join(heading.text().split()) if heading is not None else "") or known.title or posixpath.basename(known.path).rpartition(".")[0].replace("-", " ") or "Untitled"
        if title is not None:
            title.drop()
        head.add(Node("title", children=[name]))
        done.append("title")
    return done


def _target(known: Known, href: str) -> tuple[str | None, str]:
    path, _, fragment = href.partition("#")
    if re.match(r"[a-z][a-z0-9+.-]*:|//", href, re.I):
        return None, fragment
    return posixpath.normpath(posixpath.join(posixpath.dirname(known.path), path)) if path else known.path, fragment


def neutralised(root: Node, known: Known) -> list[str]:
    """Under `strict`, references to files that aren't there: links keep their text, other elements go, a picture with its image,
    and dead candidates of an image are left out."""
    done = []
    if not known.strict:
        return done
    dead = lambda href: (t := _target(known, href)[0]) is not None and t not in known.files and t != known.path
    for node in list(root.walk()):
        if node.parent is None:
            continue
        if "srcset" in node.attrs:
            kept = [(u, d) for u, d in trees.srcset(node.attrs["srcset"]) if not dead(u)]
            if len(kept) < len(trees.srcset(node.attrs["srcset"])):
                done.append("candidate")
                node.attrs["srcset"] = ", ".join(f"{u} {d}".strip() for u, d in kept)
                if not kept:
                    del node.attrs["srcset"]
        name = next((n for n in ("href", "src", "data") if n in node.attrs), None)
        if name is None or not dead(node.attrs[name]):
            continue
        if node.tag in ("a", "area") or node.tag == "link" and node.attrs.get("rel") != "stylesheet":
            del node.attrs[name]
            done.append("link")
        else:
            (node.parent if node.tag == "img" and node.parent.tag == "picture" else node).drop()
            done.append(f"element:{node.tag}")
    return done


def unresolved(root: Node, known: Known) -> list[tuple[str, str, str]]:
    """(file, fragment, text) of links into documents that don't have the anchor: a person's to decide, and left as they are."""
    out = []
    for node in root.walk():
        if node.tag == "a" and "#" in node.attrs.get("href", ""):
            path, fragment = _target(known, node.attrs["href"])
            if path in known.ids and fragment and fragment not in known.ids[path]:
                out.append((path, fragment, " ".join(node.text().split())))
    return out


def anchors(root: Node) -> list[str]:
    """Ids of a document and the older names of links, in order and once each."""
    return list(dict.fromkeys(x for n in root.walk() for x in (n.attrs.get("id"), n.attrs.get("name") if n.tag == "a" else None) if x))


def unwrapped(root: Node, known: Known) -> list[str]:
    """Spans of which every class is styled by nothing that shows go; bare spans without any class stay."""
    done = []
    for node in list(root.walk()):
        if node.tag == "span" and node.classes() and set(node.attrs) == {"class"} and known.inert.issuperset(node.classes()):
            node.drop(keep=True)
            done.append("span")
    return done


def blocks_in_inline(root: Node, known: Known) -> list[str]:
    """An inline element with a block in it is displayed as an inline block."""
    done = []
    for node in root.walk():
        if node.tag in INLINE - {"a"} and any(isinstance(c, Node) and c.tag in BLOCKS for c in node.children) and "display" not in node.attrs.get("style", ""):
            node.style("display: inline-block")
            done.append("inline-block")
    return done


def pictures_centred(root: Node, known: Known) -> list[str]:
    """A paragraph that holds a picture and nothing else is centred unless something says where it goes."""
    done = []
    for node in root.walk():
        inside = [c for c in node.children if not (isinstance(c, str) and not c.strip())]
        if node.tag == "p" and len(inside) == 1 and isinstance(inside[0], Node) and inside[0].tag == "img" and not re.search("text-(align|indent)|float", node.attrs.get("style", "")) and not node.classes():
            node.style("text-align: center; text-indent: 0")
            done.append("centred")
    return done


def described(root: Node, known: Known) -> list[str]:
    """Images without a description get an empty one, which claims nothing; the cover's is the book's title."""
    done = []
    for node in root.walk():
        if node.tag == "img" and "alt" not in node.attrs:
            cover = "cover" in posixpath.basename(node.attrs.get("src", "")).lower()
            node.attrs["alt"] = known.title if cover else ""
            done.append("cover" if cover else "empty")
    return done


def without_scripts(root: Node, known: Known) -> list[str]:
    """Scripts and the attributes that call them go where they aren't wanted."""
    done = []
    for node in list(root.walk()) if not known.scripts else ():
        if node.tag == "script":
            node.drop()
            done.append("script")
        for name in [n for n in node.attrs if re.fullmatch("on[a-z]+", n)]:
            del node.attrs[name]
            done.append("handler")
    return done


def ids_renamed(root: Node, known: Known) -> list[str]:
    """Ids that XML can't have are mended, and of equal ones the first keeps its name."""
    done, taken = [], set()
    for node in root.walk():
        old = node.attrs.get("id")
        if old is None:
            continue
        new = re.sub(r"[^\w.-]", "-", old.strip()) or "id"
        new = new if re.match(r"[^\W\d]", new) else f"id-{new}"
        base, k = new, 2
        while new in taken:
            new, k = f"{base}-{k}", k + 1
        taken.add(new)
        if new != old:
            node.attrs["id"] = new
            done.append("id")
    return done


def census(root: Node) -> tuple[set[str], set[str], bool]:
    """(classes, ids, scripted) that a document uses."""
    nodes = list(root.walk())
    return {c for n in nodes for c in n.classes()}, {n.attrs["id"] for n in nodes if "id" in n.attrs}, any(n.tag == "script" for n in nodes)


def older_markup(root: Node) -> list[str]:
    """Elements and attributes of older HTML that new books can't have, each once, in order of name."""
    return sorted({n.tag for n in root.walk() if n.tag in DEAD} | {f"@{a}" for n in root.walk() for a in n.attrs if a in ("align", "valign", "bgcolor", "border", "hspace", "vspace", "face") and n.tag})


STEPS: dict[str, Callable[[Node, Known], list[str]]] = {
    "place": put_in_place, "modernise": modernised, "sweep": swept, "skeleton": skeleton, "ids": ids_renamed, "neutralise": neutralised, "unwrap": unwrapped, "blocks": blocks_in_inline, "pictures": pictures_centred, "alt": described, "scripts": without_scripts,
}
#: Steps that may take text out or add some.
CHANGES_TEXT = frozenset({"skeleton", "neutralise", "scripts"})


def rewrite(data: bytes | str | None, known: Known, steps: list[str]) -> tuple[str, str, dict[str, int], bool]:
    """(text, mode, changes by step, reverted) of one document."""
    root, mode = trees.parse(data)
    before, done = root.text(), {}
    for name in steps:
        if n := len(STEPS[name](root, known)):
            done[name] = n
    after = root.text()
    if not CHANGES_TEXT.intersection(done) and encodings.first_lost("".join(before.split()), "".join(after.split())) >= 0 and sorted("".join(before.split())) != sorted("".join(after.split())):
        return data if isinstance(data, str) else (data or b"").decode("utf-8", "replace"), mode, {}, True
    return trees.serialise(root), mode, done, False


def rewritten(documents: DataFrame, steps: list[str] | None = None, carry: list[str] | None = None, data_col: str = "data", **known) -> DataFrame:
    """The carried columns with `data` (the document), `mode`, `changes` (by step) and `reverted`. Rows are independent; a
    null document is an empty one. Batches are as large as the documents in them."""
    chosen = list(STEPS) if steps is None else steps
    kept = documents.select(*(carry or []), data_col)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("data", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("changes", T.MapType(T.StringType(), T.IntegerType())), T.StructField("reverted", T.BooleanType())])
    n, kinds = len(carry or []), (pa.string(), pa.string(), pa.map_(pa.string(), pa.int32()), pa.bool_())
    facts = Known(**known)

    def run(batches):
        for batch in batches:
            made = [rewrite(x, facts, chosen) for x in batch.column(n).to_pylist()]
            columns = [pa.array([list(m[i].items()) if i == 2 else m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns], names=schema.names)

    return kept.mapInArrow(run, schema)


