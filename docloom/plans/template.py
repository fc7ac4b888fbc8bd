"""Templates: what is asked of documents. Plain driver-side values; small frames of them are joined to the data."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from docloom.schemas import TYPES


@dataclass(frozen=True)
class Item:
    """A question, or a piece of meta information."""

    title: str
    type: str
    id: str | None = None
    values: tuple[str, ...] = ()
    info: str = ""
    example: str | None = None
    keywords: str | None = None
    default: str | None = None
    args: str | None = None
    model: str | None = None
    search: str = "vector"
    meta: tuple[Item, ...] = ()

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type!r}")
        if self.type in ("list", "multi") and not self.values:
            raise ValueError(f"{self.title}: a choice needs values")

    def arguments(self) -> dict | None:
        """The custom arguments, if they are a JSON object."""
        try:
            out = json.loads(self.args) if self.args else None
        except ValueError:
            return None
        return out if isinstance(out, dict) else None


@dataclass(frozen=True)
class Bucket:
    id: str
    caption: str
    description: str | None = None
    parent: str | None = None
    order: int = 0
    multiplier: float = 1
    method: str = "SUM"


@dataclass(frozen=True)
class Mapping:
    id: str
    caption: str
    buckets: tuple[Bucket, ...]


@dataclass(frozen=True)
class Table:
    """A kind of table to detect."""

    title: str
    keywords: str = ""
    id: str | None = None
    info: str = ""
    best_in_proximity: bool = False
    collapse: bool = False
    mapping: Mapping | None = None
    model: str | None = None
    mapping_model: str | None = None
    search: str = "vector"
    meta: tuple[Item, ...] = ()


@dataclass(frozen=True)
class Template:
    questions: tuple[Item, ...] = ()
    tables: tuple[Table, ...] = ()
    id: str | None = None
    title: str = "template"
    description: str = ""
    settings: dict = field(default_factory=dict, hash=False)

    @property
    def meta(self) -> tuple[Item, ...]:
        """All meta items, each once, in the order in which they come up."""
        return tuple({m.id: m for x in (*self.tables, *self.questions) for m in x.meta}.values())

    def with_model(self, model: str) -> Template:
        """A copy whose items all use one model; tables map rows with it if they have a mapping."""
        ask = lambda q: replace(q, model=model, meta=tuple(replace(m, model=model) for m in q.meta))
        tables = tuple(replace(t, model=model, mapping_model=model if t.mapping else t.mapping_model, meta=tuple(replace(m, model=model) for m in t.meta)) for t in self.tables)
        return replace(self, questions=tuple(map(ask, self.questions)), tables=tables)

    def with_truth(self) -> Template:
        """A copy that is answered from assigned values."""
        return self.with_model("assigned")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def items_frame(self, spark: SparkSession) -> DataFrame:
        """Questions and meta items: id, title, type, values, default, meta_ids."""
        rows = [(x.id, x.title, x.type, list(x.values), x.default, [m.id for m in x.meta]) for x in (*self.questions, *self.meta)]
        return spark.createDataFrame(rows, "id string, title string, type string, values array<string>, default string, meta_ids array<string>")

    def detection(self) -> dict[str, dict]:
        return {t.id: {"best": t.best_in_proximity, "collapse": t.collapse} for t in self.tables}

    def models(self) -> dict[str | None, list[Item]]:
        """Questions by their model; a question without one is refused."""
        out: dict[str | None, list[Item]] = {}
        for q in self.questions:
            if q.model is None:
                raise ValueError(f"{q.title}: no model")
            out.setdefault(q.model, []).append(q)
        return out


def create_template(questions: list[Item] | None = None, tables: list[Table] | None = None, title: str = "template") -> Template:
    """A template whose items without an id get one of their kind and number in it; one meta item used twice stays one."""
    count: Counter[str] = Counter()
    known: dict[Item, Item] = {}

    def named(x, kind: str):
        if x.id is None:
            count[kind] += 1
            x = replace(x, id=f"{kind}{count[kind]}")
        return x

    def metas(x):
        return replace(x, meta=tuple(known.setdefault(m, named(m, "meta")) for m in x.meta))

    return Template(tuple(metas(named(q, "question")) for q in questions or []), tuple(metas(named(t, "table")) for t in tables or []), title=title)


def from_json(text: str) -> Template:
    """A template from to_json()'s text; unknown fields and types are refused."""
    d = json.loads(text)
    item = lambda x: Item(**{k: v for k, v in x.items() if k not in ("values", "meta")}, values=tuple(x.get("values", ())), meta=tuple(map(item, x.get("meta", ()))))

    def table(x: dict) -> Table:
        m = x.get("mapping")
        mapping = Mapping(m["id"], m["caption"], tuple(Bucket(**b) for b in m["buckets"])) if m else None
        return Table(**{k: v for k, v in x.items() if k not in ("mapping", "meta")}, mapping=mapping, meta=tuple(map(item, x.get("meta", ()))))

    return Template(tuple(map(item, d.get("questions", ()))), tuple(map(table, d.get("tables", ()))), d.get("id"), d.get("title", "template"), d.get("description", ""), d.get("settings", {}))
