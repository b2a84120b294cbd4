"""Repairs of style sheets: what nothing uses, what no reader knows, what is written twice, dead addresses, names of classes.

A sheet is text with the places of its rules; each step gives a new text and the names of what it did, and is taken back
where the rules that are left are not what was there but for what the step took out (`same_but_for`).
"""

from __future__ import annotations

import posixpath
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.sources import batches, stylesheets

# Properties that set several at once, by the beginning of the names of those.
SHORTHANDS = {
    "margin": ["margin-"], "padding": ["padding-"], "border": ["border-"], "border-top": ["border-top-"], "border-right": ["border-right-"], "border-bottom": ["border-bottom-"], "border-left": ["border-left-"], "font": ["font-", "line-height"],
    "background": ["background-"], "list-style": ["list-style-"], "outline": ["outline-"], "columns": ["column-"], "text-decoration": ["text-decoration-"], "flex": ["flex-"], "transition": ["transition-"], "animation": ["animation-"],
}
# Well-known families by the general one they belong to, and words in a family's name that tell it.
FAMILIES = {"serif": ["times", "times new roman", "georgia", "garamond", "palatino", "book antiqua", "cambria", "minion pro", "charis sil"], "sans-serif": ["arial", "helvetica", "verdana", "tahoma", "calibri", "trebuchet ms", "open sans", "myriad pro"], "monospace": ["courier", "courier new", "consolas", "monaco", "menlo", "lucida console"], "cursive": ["comic sans ms", "brush script mt"], "fantasy": ["impact", "papyrus"]}
GENERIC = frozenset("serif sans-serif monospace cursive fantasy system-ui inherit initial unset".split())
# Elements by what a class on them is about.
ROLES = {
    "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl dt dd", "table": "table thead tbody tfoot tr td th caption col colgroup", "picture": "img svg image figure picture", "ornament": "hr", "base": "body html",
    "emphasis": "span em strong b i u a sup sub small code cite q abbr", "paragraph": "p div section blockquote article aside header footer span em strong b i u a",
}
FACE = frozenset("font-family font-size font-style font-weight font-variant color line-height".split())
# What breaks are called by readers from before the newer names.
BREAKS = {"break-before": "page-break-before", "break-after": "page-break-after", "break-inside": "page-break-inside"}
VENDOR = re.compile(r"^-(webkit|moz|ms|o|khtml)-|^(mso-|oeb-)")
OUT_OF_FLOW = frozenset(("absolute", "fixed", "sticky"))


@dataclass
class Known:
    """What a sheet's steps may know: its path, names that documents use, files, moved files, properties, and choices."""

    path: str = ""
    classes: frozenset[str] = frozenset()
    ids: frozenset[str] = frozenset()
    files: frozenset[str] = frozenset()
    moved: dict[str, str] = field(default_factory=dict)
    properties: frozenset[str] = frozenset()
    renamed: dict[str, str] = field(default_factory=dict)
    scripted: bool = False
    strict: bool = False
    legacy: bool = False
    ordinary: bool = True


@lru_cache(maxsize=16)
def rules(text: str) -> tuple[tuple[str, tuple[str, ...], int, int, str], ...]:
    """The rules of a sheet; every step asks for them, most leave the sheet as it was."""
    return tuple(stylesheets.blocks(text))


@lru_cache(maxsize=16)
def _model(text: str) -> Counter:
    """The declarations of a sheet as a bag: condition, selector, property, value, importance."""
    return Counter((around, selector, prop, value, important) for prelude, around, _, _, body in rules(text) for selector in ([prelude] if prelude.startswith("@") else stylesheets._split(prelude, ",")) for prop, value, important in stylesheets.declarations(body))


def model(text: str) -> Counter:
    return Counter(_model(text))


def same_but_for(before: str, after: str, removed: Counter | None = None) -> bool:
    """Whether a sheet declares what it did, but for some declarations that were taken out on purpose."""
    was, now = _model(before), _model(after)
    return not now - was and (removed is None or was - now == removed)


@lru_cache(maxsize=16)
def is_sound(text: str) -> bool:
    """Whether every bracket and brace that is open outside strings and comments is shut again, in order."""
    open_ = []
    for m in stylesheets.TOKEN.finditer(text):
        t = m.group()
        if t in "{(":
            open_.append(t)
        elif t in "})" and (not open_ or open_.pop() + t not in ("{}", "()")):
            return False
    return not open_


def branches(selector: str) -> list[str]:
    return [b.strip() for b in stylesheets._split(selector, ",") if b.strip()]


def names_nothing(selector: str, classes: frozenset[str], ids: frozenset[str]) -> bool:
    """Whether every branch of a selector needs a class or an id that the book doesn't have. Attributes, pseudo-classes and `*`
    may always be met."""

    def dead(branch: str) -> bool:
        if re.search(r"[\[:*]", branch):
            return False
        return any(c not in classes for c in re.findall(r"\.([\w-]+)", branch)) or any(i not in ids for i in re.findall(r"#([\w-]+)", branch))

    return not selector.startswith("@") and all(map(dead, branches(selector)))


def unreachable(text: str, known: Known) -> tuple[str, list[str]]:
    """Rules that name nothing in the book go, unless scripts might add names."""
    gone = [] if known.scripted else [(start, stop, prelude) for prelude, _, start, stop, _ in rules(text) if names_nothing(prelude, known.classes, known.ids)]
    return stylesheets.without(text, [(a, b) for a, b, _ in gone]), [p for _, _, p in gone]


def share_unreachable(text: str, known: Known) -> float:
    """The share of a sheet's characters in rules that name nothing in the book."""
    dead = sum(stop - start for prelude, _, start, stop, _ in rules(text) if names_nothing(prelude, known.classes, known.ids))
    return dead / len(text) if text else 0.0


def _blocks_rewritten(text: str, change: Callable[[str, list[tuple[str, str, bool]]], list[tuple[str, str, bool]]]) -> str:
    """The sheet with the declarations of each block replaced by what `change` makes of them; untouched blocks stay as they are."""
    out, at = [], 0
    for prelude, _, start, stop, body in rules(text):
        old = list(stylesheets.declarations(body))
        new = change(prelude, old)
        if new != old:
            inside = text.index("{", start) + 1
            end = stop - 1 if text[stop - 1 : stop] == "}" else stop
            out += [text[at:inside], " ", "; ".join(f"{p}: {v}{' !important' if i else ''}" for p, v, i in new), " "]
            at = end
    return "".join([*out, text[at:]])


def _dropping(test: Callable[[str, str, str], bool]) -> Callable[[str, Known], tuple[str, list[str]]]:
    def step(text: str, known: Known) -> tuple[str, list[str]]:
        gone: list[str] = []

        def change(prelude, old):
            kept = [d for d in old if not test(prelude, d[0], d[1], known)]
            gone.extend(d[0] for d in old if d not in kept)
            return kept

        return _blocks_rewritten(text, change), gone

    return step


#: Properties that only one maker's readers know, under `strict`.
vendor = _dropping(lambda _, p, v, k: k.strict and bool(VENDOR.match(p)))
#: Properties that are on no list, where a list is given; custom ones stay.
unknown = _dropping(lambda s, p, v, k: bool(k.properties) and p not in k.properties and not p.startswith("--") and not VENDOR.match(p) and not s.startswith("@"))
#: Directions that say what holds anyway.
direction = _dropping(lambda _, p, v, k: (p, v.lower()) in (("direction", "ltr"), ("unicode-bidi", "normal")))
#: Positions out of the flow of the text, under `strict`.
positions = _dropping(lambda _, p, v, k: k.strict and p == "position" and v.lower() in OUT_OF_FLOW)
#: What one maker's layout program left, and names of pages, unless an older reader is served.
plumbing = _dropping(lambda s, p, v, k: (p.startswith("adobe-") and not k.legacy) or (p == "page" and not s.startswith("@")))


def emphasis(text: str, known: Known) -> tuple[str, list[str]]:
    """`regular`, which is no style or weight, becomes `normal`, if the sheet sets no emphasis that this would take away."""
    every = [d for _, _, _, _, body in rules(text) for d in stylesheets.declarations(body)]
    wrong = [p for p, v, _ in every if p in ("font-style", "font-weight") and v.lower() == "regular"]
    if not wrong or any(p in ("font-style", "font-weight") and v.lower() in ("italic", "oblique", "bold", "bolder") for p, v, _ in every):
        return text, []
    return _blocks_rewritten(text, lambda _, old: [(p, "normal" if p in ("font-style", "font-weight") and v.lower() == "regular" else v, i) for p, v, i in old]), wrong


def repeated(text: str, known: Known) -> tuple[str, list[str]]:
    """Of a block's declarations of one property the last important one stays, else the last."""
    gone: list[str] = []

    def change(_, old):
        winner = {}
        for k, (p, _v, i) in enumerate(old):
            if p not in winner or i or not old[winner[p]][2]:
                winner[p] = k
        gone.extend(p for k, (p, _v, _i) in enumerate(old) if winner[p] != k)
        return [d for k, d in enumerate(old) if winner[d[0]] == k]

    return _blocks_rewritten(text, change), gone


def covers(short: str, prop: str) -> bool:
    """Whether one property sets another."""
    return any(prop.startswith(start) for start in SHORTHANDS.get(short, ()))


def overridden(text: str, known: Known) -> tuple[str, list[str]]:
    """Declarations that a later shorthand of the same block and importance resets."""
    gone: list[str] = []

    def change(_, old):
        lost = [any(covers(q, p) and j >= i for q, _w, j in old[k + 1 :]) for k, (p, _v, i) in enumerate(old)]
        gone.extend(d[0] for d, x in zip(old, lost, strict=True) if x)
        return [d for d, x in zip(old, lost, strict=True) if not x]

    return _blocks_rewritten(text, change), gone


def conflict(some: dict[str, str], other: dict[str, str]) -> bool:
    """Whether two sets of declarations say different things of one property, or one a shorthand of what the other sets."""
    return any(p in other and other[p] != v for p, v in some.items()) or any(covers(a, b) or covers(b, a) for a in some for b in other if a != b)


def merged(text: str, known: Known) -> tuple[str, list[str]]:
    """Rules with one selector and condition become the last of them, unless a rule between them says otherwise of what would move."""
    every, done, spans, put = rules(text), [], [], {}
    last = {}
    for k, (prelude, around, *_rest) in enumerate(every):
        if not prelude.startswith("@"):
            last[prelude, around] = k
    for k, (prelude, around, start, stop, body) in enumerate(every):
        to = last.get((prelude, around))
        if to is None or to == k:
            continue
        own = {p: v for p, v, _ in stylesheets.declarations(body)}
        between = [{p: v for p, v, _ in stylesheets.declarations(b)} for p2, _, _, _, b in every[k + 1 : to] if p2 != prelude]
        if any(conflict(own, x) for x in between):
            continue
        spans.append((start, stop))
        put.setdefault(to, []).extend(stylesheets.declarations(body))
        done.append(prelude)
    out, at = [], 0
    for k, (_prelude, _, start, stop, body) in enumerate(every):
        if (start, stop) in spans:
            out.append(text[at:start])
            at = stop
        elif k in put:
            inside = text.index("{", start) + 1
            out += [text[at:inside], " ", "; ".join(f"{p}: {v}{' !important' if i else ''}" for p, v, i in [*put[k], *stylesheets.declarations(body)]), " "]
            at = stop - 1
    return "".join([*out, text[at:]]), done


def _urls(text: str, change: Callable[[str], str | None]) -> tuple[str, list[str]]:
    done: list[str] = []

    def one(m: re.Match) -> str:
        new = change(m.group(2).strip())
        if new is None or new == m.group(2).strip():
            return m.group(0)
        done.append(m.group(2))
        return f"url({m.group(1)}{new}{m.group(1)})" if new else "none"

    return re.sub(r"""url\(\s*(["']?)([^"')]*)\1\s*\)""", one, text, flags=re.I), done


def _is_remote(url: str) -> bool:
    return bool(re.match(r"[a-z][a-z0-9+.-]*:|//|#", url, re.I))


def moved_urls(text: str, known: Known) -> tuple[str, list[str]]:
    """Addresses of files that moved are those of their new places, as seen from where the sheet is now."""
    now = known.moved.get(known.path, known.path)

    def change(url):
        path, _, fragment = url.partition("#")
        target = posixpath.normpath(posixpath.join(posixpath.dirname(known.path), path))
        if _is_remote(url) or (target not in known.moved and now == known.path):
            return None
        return posixpath.relpath(known.moved.get(target, target), posixpath.dirname(now) or ".") + (f"#{fragment}" if fragment else "")

    return _urls(text, change)


def dead_urls(text: str, known: Known) -> tuple[str, list[str]]:
    """Addresses of files that aren't there: a list loses the candidate, a font's declaration goes with its last one, and any
    other value becomes `none`. A sheet that this would break stays as it is."""
    dead = lambda url: not _is_remote(url) and bool(url) and posixpath.normpath(posixpath.join(posixpath.dirname(known.path), url.partition("#")[0])) not in known.files
    done: list[str] = []

    def change(_, old):
        out = []
        for p, v, i in old:
            parts = stylesheets._split(v, ",")
            bad = [x for x in parts if any(dead(u.strip()) for u in re.findall(r"""url\(\s*["']?([^"')]*)""", x))]
            done.extend(bad)
            if not bad:
                out.append((p, v, i))
            elif p in ("src", "background-image", "background", "cursor") and len(bad) < len(parts):
                out.append((p, ",".join(x for x in parts if x not in bad).strip(), i))
            elif p != "src":
                out.append((p, _urls(v, lambda u: "" if dead(u) else None)[0], i))
        return out

    new = _blocks_rewritten(text, change)
    return (new, done) if is_sound(new) or not is_sound(text) else (text, [])


def without_imports(text: str, known: Known | None = None) -> tuple[str, list[str]]:
    """The sheet without imports from elsewhere; those of the book stay."""
    found = re.findall(r"""@import\s+(?:url\(\s*)?["']?((?:[a-z]+:)?//[^"')\s;]+)[^;]*;""", text, re.I)
    return re.sub(r"""@import\s+(?:url\(\s*)?["']?(?:[a-z]+:)?//[^;]*;""", "", text, flags=re.I), found


def breaks_mirrored(text: str, known: Known | None = None) -> tuple[str, list[str]]:
    """Newer names of page breaks get the older ones beside them, once."""
    done: list[str] = []

    def change(_, old):
        have = {p for p, _v, _i in old}
        out = []
        for p, v, i in old:
            if p in BREAKS and BREAKS[p] not in have and v.lower() in ("page", "always", "avoid", "avoid-page", "auto", "left", "right"):
                out.append((BREAKS[p], {"page": "always", "avoid-page": "avoid"}.get(v.lower(), v), i))
                done.append(p)
            out.append((p, v, i))
        return out

    return _blocks_rewritten(text, change), done


def general_family(family: str, embedded: dict[str, str] | None = None) -> str | None:
    """The general family of a font: what its file says, else what is well known, else none."""
    name = family.strip(" \"'").lower()
    return (embedded or {}).get(name) or next((g for g, names in FAMILIES.items() if name in names), None)


def stacks_ended(text: str, known: Known, embedded: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """Lists of fonts without a general family at their end get that of their first font, where it is known."""
    done: list[str] = []

    def change(prelude, old):
        out = []
        for p, v, i in old:
            names = [x.strip() for x in stylesheets._split(v, ",")]
            general = general_family(names[0], embedded)
            if p == "font-family" and not prelude.startswith("@") and names[-1].lower() not in GENERIC and general:
                v = f"{v}, {general}"
                done.append(names[0])
            out.append((p, v, i))
        return out

    return _blocks_rewritten(text, change), done


def embedded_families(text: str) -> list[tuple[str, str]]:
    """(family, address) of the fonts that a sheet brings along."""
    out = []
    for prelude, _, _, _, body in rules(text):
        if prelude.lower().startswith("@font-face"):
            own = {p: v for p, v, _ in stylesheets.declarations(body)}
            out += [(own.get("font-family", "").strip(" \"'"), u.strip()) for u in re.findall(r"""url\(\s*["']?([^"')]*)""", own.get("src", ""))]
    return out


def sizes_relative(text: str, known: Known | None = None) -> tuple[str, list[str]]:
    """Absolute sizes of fonts become relative to the reader's own, unless the sheet pins the root's size."""
    pinned = any(re.search(r"(^|[\s,])(html|:root)$", p.strip()) and any(d[0] in ("font-size", "font") for d in stylesheets.declarations(body)) for p, _, _, _, body in rules(text))
    done: list[str] = []

    def change(_, old):
        out = []
        for p, v, i in old:
            m = re.fullmatch(r"(\d*\.?\d+)\s*(px|pt)", v.strip(), re.I)
            if p == "font-size" and m:
                size = float(m.group(1)) * (4 / 3 if m.group(2).lower() == "pt" else 1) / 16
                v = f"{round(size, 4):g}rem"
                done.append(p)
            out.append((p, v, i))
        return out

    return (text, []) if pinned else (_blocks_rewritten(text, change), done)


def classes_renamed(text: str, known: Known) -> tuple[str, list[str]]:
    """Classes under their new names, in selectors alone."""
    out, at, done = [], 0, []
    for prelude, _, start, _, _ in rules(text):
        end = text.index("{", start)
        new = re.sub(r"\.([\w-]+)", lambda m: f".{known.renamed.get(m.group(1), m.group(1))}", text[start:end])
        if new != text[start:end] and not prelude.startswith("@"):
            out += [text[at:start], new]
            at = end
            done.append(prelude)
    return "".join([*out, text[at:]]), done


def role(tags: set[str], properties: set[str], declarations: list[tuple[str, str]] = ()) -> str:
    """What a class is about, by the elements that carry it in the book and, for blocks, by what it declares."""
    of = {k: set(v.split()) for k, v in ROLES.items()}
    if not tags:
        return "other"
    if tags & of["heading"] and tags <= of["heading"] | {"span"}:
        return "heading"
    for name in ("list", "table", "picture", "ornament", "base", "emphasis"):
        if tags <= of[name]:
            return name
    if not tags <= of["paragraph"]:
        return "other"
    if properties and properties <= {"text-align"}:
        return "alignment"
    if properties and properties <= FACE:
        return "face"
    return "other" if any(_like_heading(p, v) for p, v in declarations) else "paragraph"


def _like_heading(prop: str, value: str) -> bool:
    value = value.strip().lower()
    size = re.fullmatch(r"([\d.]+)\s*(em|rem|%)", value)
    return (
        (prop == "font-weight" and value in ("bold", "bolder", "600", "700", "800", "900")) or (prop == "text-transform" and value == "uppercase")
        or (prop == "font-size" and (value in ("large", "x-large", "xx-large", "xxx-large") or bool(size) and float(size.group(1)) / (100 if size.group(2) == "%" else 1) >= 1.3))
    )


def unshielded(text: str, known: Known | None = None) -> tuple[str, list[str]]:
    """The sheet without the marks that hid it from readers of another age."""
    new = re.sub(r"<!--|-->|<!\[CDATA\[|\]\]>|/\*\s*\*/", "", text)
    return new, ["shield"] if new != text else []


def without_noise(text: str, known: Known | None = None) -> tuple[str, list[str]]:
    """The sheet without rules that declare nothing and without semicolons that end nothing."""
    empty = [(a, b) for p, _, a, b, body in rules(text) if not list(stylesheets.declarations(body)) and not re.search(r"\S", re.sub(r"/\*.*?\*/|;", "", body, flags=re.S)) and not p.startswith("@")]
    new = re.sub(r";(\s*;)+", ";", stylesheets.without(text, empty))
    return new, ["empty"] * len(empty)


def readable(text: str) -> str:
    """The sheet with a line for each declaration, rules parted by a blank line."""
    out = []
    for prelude, around, _, _, body in rules(text):
        lines = [f"  {p}: {v}{' !important' if i else ''};" for p, v, i in stylesheets.declarations(body)]
        rule = "\n".join([f"{prelude} {{", *lines, "}"])
        for holder in reversed(around):
            rule = f"{holder} {{\n{rule}\n}}"
        out.append(rule)
    return "\n\n".join(out) + ("\n" if out else "")


STEPS: dict[str, Callable[[str, Known], tuple[str, list[str]]]] = {
    "shields": unshielded, "imports": without_imports, "vendor": vendor, "unknown": unknown, "emphasis": emphasis, "direction": direction, "positions": positions, "plumbing": plumbing, "noise": without_noise, "repeated": repeated, "overridden": overridden,
    "merged": merged, "unreachable": unreachable, "dead-urls": dead_urls, "moved-urls": moved_urls, "stacks": stacks_ended, "sizes": sizes_relative, "breaks": breaks_mirrored, "renamed": classes_renamed,
}
#: Steps that only take declarations out or move them; the others put new ones in.
TAKES_OUT = frozenset({"shields", "vendor", "unknown", "direction", "positions", "plumbing", "noise", "repeated", "overridden", "merged", "unreachable"})


def mend(text: str | None, known: Known, steps: list[str] | None = None) -> tuple[str, dict[str, int]]:
    """(text, changes by step) of a sheet; a step that breaks it, or adds what it may only take out, is passed over."""
    text, done = text or "", {}
    for name in STEPS if steps is None else steps:
        new, found = STEPS[name](text, known)
        if found and (is_sound(new) or not is_sound(text)) and (name not in TAKES_OUT or name == "shields" or same_but_for(text, new)):
            text, done[name] = new, len(found)
    return text, done


def mended(sheets: DataFrame, carry: list[str], text_col: str = "css", steps: list[str] | None = None, **known) -> DataFrame:
    """The carried columns with `css` and `changes` (by step). Rows are independent; a null sheet is an empty one. Sheets are
    dealt to all tasks, and one that a batch holds many times, as books of one maker do, is mended once."""
    kept = batches.spread(sheets.select(*carry, text_col))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("css", T.StringType()), T.StructField("changes", T.MapType(T.StringType(), T.IntegerType()))])
    facts, n = Known(**known), len(carry)

    def run(arrived):
        for batch in arrived:
            once: dict[str | None, tuple[str, dict[str, int]]] = {}
            made = [once[x] if x in once else once.setdefault(x, mend(x, facts, steps)) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array([m[0] for m in made], pa.string()), pa.array([list(m[1].items()) for m in made], pa.map_(pa.string(), pa.int32()))], names=schema.names)

    return kept.mapInArrow(run, schema)
