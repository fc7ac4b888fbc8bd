"""HTML to elements: text blocks and tables, by the standard library's parser and recovery rules of our own."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.schemas import ROWS

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag closes before it: tags that may be left open, and how far up they are looked for.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
RAW = frozenset({"script", "style"})
#: Tags without signs of other tags within them, and those of them that read the same wherever they stand. Pages of others are left to the library's parser.
TAG = re.compile(r"(</?[a-zA-Z][^<>]*>)")
PLAIN_TAG = re.compile(r"""</[a-zA-Z][a-zA-Z0-9]*\s*>|<[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'=`/]+))?)*\s*/?>""")


class Node:
    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def tags(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def hidden(self) -> bool:
        return "style" in self.attrs and "display:none" in self.attrs["style"].replace(" ", "").lower()


_CLOSED_BY = {tag: CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set()) for tag in {*CLOSES, *BLOCKS}}


class _Events(HTMLParser):
    """What a tag says by itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.said: list[tuple[str, str, dict[str, str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.said.append(("open", tag, {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.said.append(("whole", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self.said.append(("end", tag, {}))

    def handle_data(self, data: str) -> None:
        self.said.append(("data", data, {}))


@lru_cache(1 << 14)
def _event(tag: str) -> tuple[str, str, dict[str, str]] | None:
    """What the library's parser makes of a tag; None if that may depend on what is around it."""
    if not PLAIN_TAG.fullmatch(tag):
        return None
    events = _Events()
    events.feed(tag)
    events.close()
    what, name, _ = events.said[0] if len(events.said) == 1 else ("data", "", {})
    return None if what == "data" or (what != "end" and name in HTMLParser.CDATA_CONTENT_ELEMENTS) else events.said[0]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)
        self.tables: list[Node] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open(tag, {k: v or "" for k, v in attrs})

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "br":
            self.at.children.append(" ")
            return
        if closes := _CLOSED_BY.get(tag):
            node, scope = self.at, SCOPES.get(tag, frozenset())
            while node.parent is not None and node.name not in scope and node.name != "table":
                if node.name in closes:
                    self.at = node.parent
                node = node.parent
        child = Node(tag, attrs, self.at)
        self.at.children.append(child)
        if tag == "table":
            self.tables.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.whole(tag, {k: v or "" for k, v in attrs})

    def whole(self, tag: str, attrs: dict[str, str]) -> None:
        before = self.at
        self.open(tag, attrs)
        if self.at is not before and self.at.name == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.name != tag:
            if node.name == "table" and tag not in ("body", "html"):
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.name not in RAW:
            self.at.children.append(data)


def _plain(html: str) -> _Builder | None:
    """A page of plain tags, most of which many pages share, so that each is read once; None if there is anything else, such as comments or scripts."""
    parts = TAG.split(html)
    events = [_event(t) for t in parts[1::2]]
    if None in events or any("<" in t for t in parts[::2]):
        return None
    builder = _Builder()
    for text, event in zip(parts[::2], [*events, None]):
        if text:
            builder.handle_data(unescape(text) if "&" in text else text)
        if event is not None:
            what, name, attrs = event
            if what == "open":
                builder.open(name, attrs)
            elif what == "end":
                builder.handle_endtag(name)
            else:
                builder.whole(name, attrs)
    return builder


def _read(html: str) -> _Builder:
    builder = _plain(html)
    if builder is None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
    return builder


def parse(html: str) -> Node:
    return _read(html).root


#: Set apart for walks without recursion: pages may be nested thousands deep.
def _walk(node: Node) -> Iterator[Node | str]:
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        yield x
        if isinstance(x, Node):
            todo += [c for c in reversed(x.children) if not (isinstance(c, Node) and c.name.startswith("xbrli:"))]


def _texts(node: Node) -> list[str]:
    """The texts that _walk() comes to."""
    out, todo = [], node.children[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.name.startswith("xbrli:"):
            todo += x.children[::-1]
    return out


def strings(node: Node) -> list[str]:
    return [s for x in _texts(node) if (s := x.strip())]


def _markup(node: Node) -> tuple:
    """What tells siblings apart: name, attributes and content, without recursion."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            out.append((x.name, tuple(sorted(x.attrs.items()))))
            todo += [None, *reversed(x.children)]
        else:
            out.append(x)
    return tuple(out)


def _places(parent: Node) -> dict[int, str]:
    """The step to each child tag, worked out for all of them at once: of several of one name each has its number from 0; those that are alike share the first one's."""
    same: dict[str, list[Node]] = {}
    for c in parent.tags():
        same.setdefault(c.name, []).append(c)
    out = {}
    for name, nodes in same.items():
        if len(nodes) == 1:
            out[id(nodes[0])] = f"/{name}"
            continue
        # Those that already differ in their attributes or children's names and texts need no look at all that is in them.
        looks = [(tuple(sorted(c.attrs.items())), *(x.name if isinstance(x, Node) else (x,) for x in c.children)) for c in nodes]
        twice = {x for x, n in Counter(looks).items() if n > 1}
        first: dict[tuple, int] = {}
        for k, (c, look) in enumerate(zip(nodes, looks)):
            out[id(c)] = f"/{name}[{first.setdefault(_markup(c), k) if look in twice else k}]"
    return out


def path(node: Node, known: dict[int, dict[int, str]] | None = None) -> str:
    """The path of names from the root. known: the steps below nodes that were met before."""
    known, parts = {} if known is None else known, []
    while node.parent is not None:
        if id(node.parent) not in known:
            known[id(node.parent)] = _places(node.parent)
        parts.append(known[id(node.parent)][id(node)])
        node = node.parent
    return "".join(reversed(parts))


def table_rows(table: Node) -> list[dict]:
    """Rows of a table: those of its head, its body, then loose ones. Hidden cells are left out; a column span that is a number counts."""

    def row(kind: str, tr: Node) -> dict:
        cells = [c for c in tr.tags() if not c.hidden()]
        return {"row_type": kind, "values": [{"val": "".join(_texts(c)), "colspan": int(c.attrs["colspan"]) if c.attrs.get("colspan", "").isdecimal() else 1} for c in cells]}

    out = []
    for part, kind in (("thead", "header"), ("tbody", "body")):
        first = next((t for t in table.tags() if t.name == part), None)
        if first is not None:
            out += [row(kind, x) for x in _walk(first) if isinstance(x, Node) and x.name == "tr"]
    return out + [row("body", x) for x in table.tags() if x.name == "tr"]


def elements(html: str) -> list[dict]:
    """Text and table elements. A part without tables is one text; one with tables is taken child by child, its loose text behind them."""
    read = _read(html)
    root, with_table = read.root, set()
    for x in read.tables:
        above, up = [], x.parent
        while up is not None and id(up) not in with_table and not up.name.startswith("xbrli:"):
            above.append(id(up))
            up = up.parent
        if up is None or id(up) in with_table:  # else it is in a part that is left out
            with_table.update(above)
    out: list[dict] = []
    known: dict[int, dict[int, str]] = {}
    todo: list[tuple[Node, str | None]] = [(root, None)]
    while todo:
        node, loose = todo.pop()
        if loose is not None:
            out.append({"el_type": "text", "text": loose, "xpath": path(node, known), "rows": None})
        elif node.name == "table":
            out.append({"el_type": "table", "text": None, "xpath": path(node, known), "rows": table_rows(node)})
        elif node.hidden():
            continue
        elif id(node) in with_table:
            rest = [c.strip() for c in node.children if isinstance(c, str) and c.strip()]
            todo += [(node, t) for t in reversed(rest)]
            todo += [(c, None) for c in reversed(node.tags()) if not c.name.startswith("xbrli:")]
        elif text := " ".join(strings(node)):
            out.append({"el_type": "text", "text": text, "xpath": path(node, known), "rows": None})
    return [e | {"element_index": i} for i, e in enumerate(out)]


_FIELDS = "element_index int, el_type string, text string, xpath string"
_ARROW = [("element_index", pa.int32()), ("el_type", pa.string()), ("text", pa.string()), ("xpath", pa.string())]


def _rows_array(found: list[dict]) -> pa.Array:
    """The elements' rows, column by column."""

    def ends(sizes: Iterator[int]) -> list[int]:
        return list(accumulate(sizes, initial=0))

    tables = [e["rows"] for e in found]
    rows = [r for t in tables if t for r in t]
    cells = [c for r in rows for c in r["values"]]
    values = pa.StructArray.from_arrays([pa.array([c["val"] for c in cells], pa.string()), pa.array([c["colspan"] for c in cells], pa.int32())], ["val", "colspan"])
    values = pa.ListArray.from_arrays(pa.array(ends(len(r["values"]) for r in rows), pa.int32()), values)
    structs = pa.StructArray.from_arrays([pa.array([r["row_type"] for r in rows], pa.string()), values], ["row_type", "values"])
    return pa.ListArray.from_arrays(pa.array(ends(len(t or ()) for t in tables), pa.int32()), structs, mask=pa.array([t is None for t in tables], pa.bool_()))


def extract(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Elements of pages: id_col, element_index, el_type, text, xpath, rows. Null pages have none; bytes are read as UTF-8."""
    html = F.col(html_col)
    rows = pages.select(F.col(id_col).alias("_id"), (F.decode(html, "UTF-8") if pages.schema[html_col].dataType.typeName() == "binary" else html).alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for i, page in enumerate(batch.column("_h")):
                if (text := page.as_py()) is not None:
                    es = elements(text)
                    found += es
                    owner += [i] * len(es)
            ids = batch.column("_id").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([e[n] for e in found], t) for n, t in _ARROW), _rows_array(found)], ["_id", *(n for n, _ in _ARROW), "rows"])

    out = rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {_FIELDS}, rows {ROWS}")
    return out.withColumnRenamed("_id", id_col)


def convert(files: DataFrame) -> DataFrame:
    """Elements of HTML files as the document loader gives them."""
    return extract(files, "source_identifier", "content").withColumn("source_type", F.lit("html"))


def register() -> None:
    from docloom.sources.documents import register_converter

    register_converter("html", convert)


register()
