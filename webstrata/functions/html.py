"""What needs a parsed page: one Arrow function that reads each page once and returns all its signals.

The parser is the standard library's, with the rules a browser applies to void
elements and unclosed paragraphs. A page that is null gives empty signals.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content, elements dropped from main content, and those never shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILERPLATE = {"nav", "header", "footer", "aside", "script", "style", "noscript"}
UNSEEN = {"script", "style", "template", "noscript"}
# Inline styles that hide an element.
HIDING = ["display:none", "visibility:hidden", "left:-9999", "top:-9999", "right:-9999", "text-indent:-9999", "clip:rect(0,0,0,0)", "clip:rect(0px,0px,0px,0px)", "clip-path:inset(100%)", "clip-path:circle(0)"]
HIDING_ZERO = re.compile(r"(?:opacity|font-size|width|height):0(?:px|em|rem|%)?(?:;|!|$)")
MAX_OBJECTS, MAX_PAIRS, MAX_DEPTH = 500, 2000, 6
# Leaves that stand for the object they are in, the first that is there.
COLLAPSING = ["name", "value", "ratingvalue", "price", "url"]
#: Sources of field values, the first counts most.
SOURCES = ["json_ld_fields", "og", "meta", "microdata", "pairs"]


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def raw(self) -> list[str]:
        """All text as it stands."""
        return [c for n in self.walk() for c in n.children if isinstance(c, str)]

    def texts(self, skip: set[str] = frozenset()) -> list[str]:
        """Stripped pieces of text, in document order, outside elements named in `skip`."""
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if piece := item.strip():
                    out.append(piece)
            elif item.tag not in skip:
                stack.extend(reversed(item.children))
        return out


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root
        self.comments = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        names: dict[str, str] = {}
        for k, v in attrs:
            names.setdefault(k, v or "")
        node = Node(tag, names, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.comments += 1


def parse(html: str) -> tuple[Node, int]:
    """The tree and the number of comments. Markup that the parser can't go on with ends the tree there."""
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except (AssertionError, ValueError):
        pass
    return b.root, b.comments


def style_hides(style: str) -> bool:
    s = re.sub(r"\s+", "", style.lower())
    return any(m in s for m in HIDING) or HIDING_ZERO.search(s) is not None


def strip_hidden(root: Node, comments: int) -> int:
    """Takes out what no visitor sees; how many elements and comments that were."""
    removed, stack = comments, [root]
    while stack:
        node = stack.pop()
        keep: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node) and (c.tag in UNSEEN or "hidden" in c.attrs or c.attrs.get("aria-hidden", "").lower() == "true" or style_hides(c.attrs.get("style", ""))):
                removed += 1
            else:
                keep.append(c)
                if isinstance(c, Node):
                    stack.append(c)
        node.children = keep
    return removed


def _first(root: Node, *tests) -> Node | None:
    for t in tests:
        for n in root.walk():
            if t(n):
                return n
    return None


def main_text(root: Node) -> str:
    """Text of the first likely main element, without navigation and the like, a line for each piece."""
    cls = lambda n: n.attrs.get("class", "").split()
    node = _first(
        root,
        lambda n: n.tag == "article",
        lambda n: n.tag == "main",
        lambda n: n.tag == "div" and n.attrs.get("role") == "main",
        lambda n: n.tag == "div" and "content" in cls(n),
        lambda n: n.tag == "div" and n.attrs.get("id") == "content",
        lambda n: n.tag == "body",
    )
    return "\n".join((node or root).texts(BOILERPLATE))


def dense_text(root: Node) -> str:
    """Text of the blocks that hold more words than link words; the first tier's stand-in."""
    return "\n".join(own for _, own in _dense_blocks(root))


def _dense_blocks(root: Node) -> Iterator[tuple[Node, str]]:
    for n in root.walk():
        if n.tag in ("p", "li", "blockquote", "pre", "h1", "h2", "h3", "td"):
            p = n.parent
            while p is not None and p.tag not in BOILERPLATE:
                p = p.parent
            if p is not None:
                continue
            own = " ".join(t.strip() for c in n.children for t in ([c] if isinstance(c, str) else c.texts({"p", "li", "blockquote", *BOILERPLATE})) if t.strip())
            links = sum(len(" ".join(a.texts()).split()) for a in n.walk() if a.tag == "a")
            if own and len(own.split()) > 2 * links:
                yield n, own


def dense_markdown(root: Node) -> str:
    """The blocks of :func:`dense_text` as markdown: headings, list items, quotes, code, links."""
    out = []
    for n, own in _dense_blocks(root):
        if n.tag == "pre":
            out.append(f"```\n{''.join(n.raw()).strip()}\n```")
            continue
        text = " ".join(_inline(n)) or own
        out.append({"li": "- ", "blockquote": "> "}.get(n.tag, "#" * int(n.tag[1]) + " " if re.fullmatch("h[1-6]", n.tag) else "") + text)
    return "\n\n".join(out)


def _inline(node: Node) -> list[str]:
    """Pieces of a block's text: links and strong words marked, inner blocks left out."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if c.strip():
                out.append(" ".join(c.split()))
            continue
        inner = " ".join(c.texts(BOILERPLATE))
        if c.tag in BOILERPLATE or c.tag in ("p", "li", "blockquote") or not inner:
            continue
        if c.tag == "a" and c.attrs.get("href"):
            out.append(f"[{inner}]({c.attrs['href'].strip()})")
        elif c.tag in ("b", "strong"):
            out.append(f"**{inner}**")
        elif c.tag in ("i", "em"):
            out.append(f"*{inner}*")
        else:
            stack.extend(reversed(c.children))
    return out


def facts(root: Node, objects: list[dict], og: dict[str, str], meta: dict[str, str]) -> dict[str, str | None]:
    """Author, date, site name and language of a page: from its metas first, then from JSON-LD, then from its markup."""
    low = {k.lower(): v for k, v in meta.items()}
    ld = flatten(objects)
    pick = lambda *xs: next((x.strip() for x in xs if x and x.strip()), None)
    time, page = _first(root, lambda n: n.tag == "time" and n.attrs.get("datetime")), _first(root, lambda n: n.tag == "html")
    date = pick(low.get("article:published_time"), og.get("article:published_time"), og.get("published_time"), low.get("date"), low.get("dc.date"), ld.get("datepublished"), ld.get("datecreated"), time.attrs["datetime"] if time else None)
    day = re.match(r"\d{4}-\d{2}-\d{2}", date or "")
    return {
        "author": pick(low.get("author"), og.get("article:author"), ld.get("author.name"), ld.get("author")),
        "date": day[0] if day else date,
        "sitename": pick(og.get("site_name"), og.get("og:site_name"), ld.get("publisher.name"), ld.get("publisher")),
        "language": pick(page.attrs.get("lang") if page else None, low.get("content-language"), ld.get("inlanguage")),
    }


def json_ld(root: Node) -> list[dict]:
    """Objects of all ld+json scripts: lone, listed or in a graph; what isn't JSON is passed over."""
    out: list[dict] = []
    for n in root.walk():
        if n.tag == "script" and "ld+json" in n.attrs.get("type", "").lower():
            try:
                data = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except (ValueError, RecursionError, MemoryError):  # markup of a foreign page must not end the job
                continue
            for x in data if isinstance(data, list) else [data]:
                graph = x.get("@graph") if isinstance(x, dict) else None
                out += [g for g in (graph if isinstance(graph, list) else [x]) if isinstance(g, dict)]
    return out[:MAX_OBJECTS]


def flatten(objects: list[dict]) -> dict[str, str | None]:
    """Dotted keys of all leaves in lower case, the first of each; a list counts by its first element.

    An object with one of the leaves COLLAPSING is its parent key's value too. Keys with
    @ are left out, and what is nested deeper than MAX_DEPTH.
    """
    out: dict[str, str | None] = {}
    simple = lambda v: not isinstance(v, (dict, list))
    work = [("", o, 0) for o in reversed(objects)]
    while work:
        name, value, depth = work.pop()
        if simple(value):
            if name:
                out.setdefault(name, value if value is None or isinstance(value, str) else json.dumps(value))
        elif isinstance(value, list):
            # a list in a list has no value
            if value and not isinstance(value[0], list):
                work.append((name, value[0], depth))
        elif depth <= MAX_DEPTH:
            below = []
            for k, v in value.items():
                if k.startswith("@"):
                    continue
                dotted = f"{name}.{k.lower()}" if name else k.lower()
                if isinstance(v, dict):
                    named = {x.lower(): y for x, y in reversed(v.items())}
                    leaf = next((named[x] for x in COLLAPSING if x in named), {})
                    if simple(leaf):
                        below.append((dotted, leaf, depth + 1))
                below.append((dotted, v, depth + 1))
            work += reversed(below)
    return out


def metas(root: Node) -> tuple[dict[str, str], dict[str, str]]:
    """(open graph, other) properties: the whole name after its first colon, its last and its first part."""
    og: dict[str, str] = {}
    meta: dict[str, str] = {}
    for n in root.walk():
        if n.tag != "meta" or "content" not in n.attrs:
            continue
        prop, name, value = n.attrs.get("property", "").strip(), n.attrs.get("name", "").strip(), n.attrs["content"].strip()
        if not value:
            continue
        full = prop or name
        if not full:
            continue
        social = prop.lower().startswith("og:") or ":" in prop
        into = og if social else meta
        tail = full.split(":", 1)[1] if ":" in full else full
        for key in (tail, tail.split(":")[-1], tail.split(":")[0]):
            into.setdefault(key, value)
    return og, meta


def microdata(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in root.walk():
        if name := n.attrs.get("itemprop", "").strip():
            value = n.attrs["content"].strip() if "content" in n.attrs else " ".join(n.texts())
            if value:
                out.setdefault(name, value)
    return out


def label_pairs(root: Node) -> dict[str, str]:
    """dt with dd, th with td of a row, label with its control."""
    out: dict[str, str] = {}
    by_id = {n.attrs["id"]: n for n in root.walk() if "id" in n.attrs}

    def add(k: str, v: str) -> None:
        if k and v and len(out) < MAX_PAIRS:
            out.setdefault(k, v)

    for n in root.walk():
        kids = [c for c in n.children if isinstance(c, Node)]
        if n.tag == "dl":
            key = None
            for c in kids:
                if c.tag == "dt":
                    key = " ".join(c.texts()).rstrip(":").strip()
                elif c.tag == "dd" and key is not None:
                    add(key, " ".join(c.texts()))
                    key = None
        elif n.tag == "tr":
            ths, tds = [c for c in kids if c.tag == "th"], [c for c in kids if c.tag == "td"]
            if len(ths) == 1 and tds:
                add(" ".join(ths[0].texts()).rstrip(":").strip(), " ".join(tds[0].texts()))
        elif n.tag == "label":
            control = by_id.get(n.attrs.get("for", "")) or next((c for c in n.walk() if c.tag in ("input", "select", "textarea")), None)
            if control is not None:
                add(" ".join(n.texts()).rstrip(":").strip(), control.attrs.get("value", "").strip() or " ".join(control.texts()))
    return out


NEXT_WORDS = ("next", "older", "more", "load more", "show more", "›", "»")


def next_link(root: Node, words: tuple[str, ...] = NEXT_WORDS) -> str | None:
    """The target of rel=next, else of the first link whose label or text holds one of the words."""
    links = [n for n in root.walk() if n.tag in ("a", "link") and n.attrs.get("href")]
    for n in links:
        if "next" in n.attrs.get("rel", "").lower().split():
            return n.attrs["href"]
    for n in links:
        if n.tag == "a":
            said = f"{n.attrs.get('aria-label', '')} {' '.join(n.texts())}".lower()
            if any(w in said for w in words):
                return n.attrs["href"]
    return None


def interactive(root: Node, most: int = 100) -> list[dict[str, str]]:
    """Elements one can act on: role and name, in document order."""
    roles = {"a": "link", "button": "button", "select": "combobox", "textarea": "textbox", "input": "textbox"}
    out = []
    for n in root.walk():
        role = n.attrs.get("role") or roles.get(n.tag)
        if role and not (n.tag == "a" and "href" not in n.attrs) and n.attrs.get("type") != "hidden":
            if n.tag == "input":
                role = {"checkbox": "checkbox", "radio": "radio", "submit": "button", "button": "button"}.get(n.attrs.get("type", "text"), role)
            name = n.attrs.get("aria-label") or " ".join(n.texts()) or n.attrs.get("placeholder") or n.attrs.get("title") or n.attrs.get("name") or ""
            out.append({"role": role, "name": name[:200]})
        if len(out) >= most:
            break
    return out


def search_results(html: str) -> list[dict[str, str]]:
    """Results of a result page: a block with a link and heading, its target, and the text beside them."""
    out = []
    root, _ = parse(html)
    for n in root.walk():
        classes = n.attrs.get("class", "").split()
        if n.tag == "div" and ({"g", "result"} & set(classes)):
            link = _first(n, lambda x: x.tag == "a" and x.attrs.get("href"))
            if link is None:
                continue
            head = _first(n, lambda x: x.tag in ("h2", "h3")) or link
            snippet = _first(n, lambda x: any("snippet" in c or c == "VwiC3b" for c in x.attrs.get("class", "").split()))
            out.append({"title": " ".join(head.texts()), "url": link.attrs["href"], "snippet": " ".join(snippet.texts()) if snippet else ""})
    return out


def sitemap_locations(xml: str, most: int = 1000) -> tuple[list[str], bool]:
    """Locations of a site map, unescaped and trimmed, and whether it is an index of site maps."""
    found = (entities.unescape(m).strip() for m in re.findall(r"(?is)<loc\b[^>]*>(.*?)</loc\s*>", xml))
    return [x for x in found if x][:most], re.search(r"(?i)<sitemapindex", xml) is not None


def join_url(base: str, href: str) -> str:
    try:
        return urljoin(base, href).split("#", 1)[0]
    except ValueError:
        return ""


SIGNALS = "title string, description string, author string, main string, dense string, markdown string, date string, sitename string, language string, raw string, json_ld array<string>, json_ld_fields map<string,string>, og map<string,string>, meta map<string,string>, microdata map<string,string>, pairs map<string,string>, fields array<struct<rank:int,place:int,name:string,value:string>>, next_href string, hidden_removed int, visible_main string, elements array<struct<role:string,name:string>>"


def _dumped(value: dict) -> str | None:
    try:
        return json.dumps(value, ensure_ascii=False)
    except (RecursionError, MemoryError):
        return None


def named_fields(out: dict) -> list[dict]:
    """(rank of the source, place, name, value) of all signals; of names of one source that normalise alike the last value stays, at the first place."""
    rows = []
    for rank, source in enumerate(SOURCES):
        kept: dict[str, dict] = {}
        for place, (key, value) in enumerate(out[source]):
            name = re.sub(r"\s+", " ", re.sub(r"[_\-.]+", " ", key.strip(" ").lower()), flags=re.ASCII).strip(" ")
            kept.setdefault(name, {"rank": rank, "place": place, "name": name})["value"] = value
        rows += kept.values()
    return rows


def signals(html: str | None) -> dict:
    """All that the operators ask of a page."""
    root, comments = parse(html or "")
    og, meta = metas(root)
    title = _first(root, lambda n: n.tag == "title")
    objects = json_ld(root)
    low = {k.lower(): v for k, v in meta.items()}
    out = {
        "title": " ".join(title.texts()) if title else None,
        "description": low.get("description"),
        **facts(root, objects, og, meta),
        "main": main_text(root),
        "dense": dense_text(root),
        "markdown": dense_markdown(root),
        "raw": "\n".join(root.texts({"script", "style", "noscript"})),
        "json_ld": [x for x in map(_dumped, objects) if x],
        "json_ld_fields": list(flatten(objects).items()),
        "og": list(og.items()),
        "meta": list(meta.items()),
        "microdata": list(microdata(root).items()),
        "pairs": list(label_pairs(root).items()),
        "next_href": next_link(root),
        "elements": interactive(root),
    }
    out["fields"] = named_fields(out)
    out["hidden_removed"] = strip_hidden(root, comments)
    out["visible_main"] = main_text(root)
    return out


def with_signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with one more column `signals`; each page is parsed once."""

    @F.arrow_udf(f"struct<{re.sub(r"(\w) (string|array|map|int)", r"\1:\2", SIGNALS)}>")
    def read(col: pa.Array) -> pa.Array:
        kind = pa.struct(
            [(k, pa.string()) for k in ("title", "description", "author", "main", "dense", "markdown", "date", "sitename", "language", "raw")]
            + [("json_ld", pa.list_(pa.string()))]
            + [(k, pa.map_(pa.string(), pa.string())) for k in ("json_ld_fields", "og", "meta", "microdata", "pairs")]
            + [("fields", pa.list_(pa.struct([("rank", pa.int32()), ("place", pa.int32()), ("name", pa.string()), ("value", pa.string())])))]
            + [("next_href", pa.string()), ("hidden_removed", pa.int32()), ("visible_main", pa.string()), ("elements", pa.list_(pa.struct([("role", pa.string()), ("name", pa.string())])))]
        )
        return pa.array([signals(x) for x in col.to_pylist()], kind)

    return pages.withColumn("signals", read(F.col(f"`{html}`")))


def pick_tier(s, least: int = 50):
    """(text, method): the dense text if long enough, else the main text if long enough, else all text."""
    return (
        F.when(F.length(s["dense"]) >= least, s["dense"]).when(F.length(s["main"]) >= least, s["main"]).otherwise(s["raw"]),
        F.when(F.length(s["dense"]) >= least, "density").when(F.length(s["main"]) >= least, "main").otherwise("raw"),
    )


def resolved(base: Column, href: Column) -> Column:
    """The absolute URL of a reference, without fragment, dot segments resolved."""

    @F.arrow_udf("string")
    def join(base: pa.Array, href: pa.Array) -> pa.Array:
        return pa.array([join_url(b, h) if b is not None and h is not None else None for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True)], pa.string())

    return join(base, href)
