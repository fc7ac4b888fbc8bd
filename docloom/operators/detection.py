"""From detected tables to output columns: merging, choosing and aligning.

locations: source_identifier, detected_class, element_index, prob, partial_prob, seq (the order of predictions).
elements: source_identifier, element_index, el_type, text. Merging and choosing depend on the order of what came before, so they run
document by document in Python, on the few numbers that describe its locations; distances come from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.neighbours import DOC, IDX, in_order
from docloom.schemas import BETWEEN_PROB, CLOSE_DISTANCE, MERGE_DISTANCE, MERGE_PARTIAL, MERGE_PROB, UNIQUE_DISTANCE


@dataclass
class Group:
    """Locations of one class that form one table. Distances are measured from the one it was begun with."""

    cls: str
    collapse: bool
    parts: list[dict] = field(default_factory=list)

    @property
    def base(self) -> dict:
        return self.parts[0]

    @property
    def prob(self) -> float:
        return sum(p["prob"] for p in self.parts) / len(self.parts) if self.parts else 0

    def closest(self, index: int) -> dict:
        return min(self.parts, key=lambda p: abs(p["element_index"] - index))


def distance(a: dict, b: dict, without: list[dict] = ()) -> int:
    """Characters strictly between two locations, less those of ``without``."""
    a, b = sorted((a, b), key=lambda p: p["element_index"])
    if a["element_index"] == b["element_index"]:
        return 0
    inner = {p["element_index"]: p["own"] for p in without if a["element_index"] < p["element_index"] < b["element_index"]}
    return b["before"] - a["before"] - a["own"] - sum(inner.values())


def _merge(groups: list[Group], by_index: dict[int, float]) -> list[Group]:
    """Each group, from the last on, becomes part of the one before it if both look like parts of one table."""
    groups = list(groups)
    for k in range(len(groups) - 1, 0, -1):
        mine = groups[k].base
        other = groups[k - 1].closest(mine["element_index"])
        low, high = sorted((mine["element_index"], other["element_index"]))
        if mine["prob"] < MERGE_PROB or min(mine["partial_prob"], other["partial_prob"]) < MERGE_PARTIAL:
            continue
        if any(low < i < high and p > BETWEEN_PROB for i, p in by_index.items()):
            continue
        if distance(mine, other) > MERGE_DISTANCE and mine["prob"] < 2:
            continue
        groups[k - 1].parts += groups.pop(k).parts
    return groups


def _best_nearby(groups: list[Group]) -> list[Group]:
    """Of two groups close to each other the less likely one goes, the later one of equals."""
    gone = set()
    for j in range(len(groups)):
        for k in range(j + 1, len(groups)):
            if distance(groups[j].base, groups[k].base, groups[j].parts + groups[k].parts) <= CLOSE_DISTANCE:
                gone.add(j if groups[j].prob < groups[k].prob else k)
    return [g for k, g in enumerate(groups) if k not in gone]


def _best_set(groups: list[Group], unique: list[str]) -> list[Group]:
    """Of the classes that occur once the set with the best probabilities, then the shortest distances; groups of other classes stay.

    Sets are put together greedily from the closest pairs on; a pair may complete several. No complete set: none of these classes.
    """
    at = [k for k, g in enumerate(groups) if g.cls in unique]
    pairs = sorted(((distance(groups[j].base, groups[k].base, groups[j].parts + groups[k].parts), j, k) for x, j in enumerate(at) for k in at[x + 1 :]), key=lambda p: p[0])
    sets: list[dict] = [{"dist": 0, "of": dict.fromkeys(unique)}]
    for dist, j, k in pairs:
        a, b = groups[j], groups[k]
        if dist >= UNIQUE_DISTANCE and not a.prob == b.prob == 2:
            break
        fitting = [s for s in sets if a.cls != b.cls and s["of"][a.cls] in (None, j) and s["of"][b.cls] in (None, k)]
        if not fitting:
            fitting = [{"dist": 0, "of": dict.fromkeys(unique)}]
            sets += fitting
        for s in fitting:
            s["of"] |= {a.cls: j, b.cls: k}
            s["dist"] += dist
    full = [s for s in sets if None not in s["of"].values()]
    chosen = set(min(full, key=lambda s: (-sum(groups[k].prob for k in s["of"].values()), s["dist"]))["of"].values()) if full else set()
    return [g for k, g in enumerate(groups) if g.cls not in unique or k in chosen]


def group_locations(locations: list[dict], items: dict[str, dict]) -> list[Group]:
    """All steps for one document. items: by class "best" (one in proximity) and "collapse"."""
    locations = [p for p in sorted(locations, key=lambda p: p["seq"]) if p["detected_class"] in items]
    by_class: dict[str, list[Group]] = {}
    for p in locations:
        by_class.setdefault(p["detected_class"], []).append(Group(p["detected_class"], items[p["detected_class"]]["collapse"], [p]))
    by_index = {p["element_index"]: p["prob"] for p in locations}
    out: list[Group] = []
    for cls, groups in by_class.items():
        groups = _merge(groups, by_index)
        out += _best_nearby(groups) if items[cls]["best"] else groups
    unique = [c for c, x in items.items() if x["best"]]
    return _best_set(out, unique) if len(unique) > 1 else out


def assemble(locations: DataFrame, elements: DataFrame, items: dict[str, dict]) -> DataFrame:
    """One row for each location that is kept: source_identifier, group_id, detected_class, element_index, part, collapse, prob (of the group)."""
    own = F.coalesce(F.length("text"), F.lit(0))
    before = F.sum(own).over(in_order()) - own
    at = elements.select(DOC, IDX, own.cast("bigint").alias("own"), before.cast("bigint").alias("before"))
    rows = locations.join(at, [DOC, IDX]).select(DOC, "detected_class", F.col(IDX).cast("int").alias(IDX), F.col("prob").cast("double").alias("prob"), F.col("partial_prob").cast("double").alias("partial_prob"), F.col("seq").cast("bigint").alias("seq"), "own", "before")

    def run(table: pa.Table) -> pa.Table:
        doc = table.column(DOC)[0].as_py()
        out = []
        for g, group in enumerate(group_locations(table.to_pylist(), items)):
            for k, p in enumerate(sorted(group.parts, key=lambda p: p["element_index"])):
                out.append({DOC: doc, "group_id": g, "detected_class": group.cls, IDX: p["element_index"], "part": k, "collapse": group.collapse, "prob": group.prob})
        return pa.Table.from_pylist(out, schema=pa.schema([(DOC, pa.string()), ("group_id", pa.int32()), ("detected_class", pa.string()), (IDX, pa.int32()), ("part", pa.int32()), ("collapse", pa.bool_()), ("prob", pa.float64())]))

    return rows.groupBy(DOC).applyInArrow(run, f"{DOC} string, group_id int, detected_class string, {IDX} int, part int, collapse boolean, prob double")


def _mean(values: list) -> float:
    known = [abs(float(v)) for v in values if v is not None]
    return sum(known) / len(known) if known else 0.0


def align(parts: list[dict], collapse: bool) -> list[dict]:
    """Columns of one group. parts, in order: element_index, captions, columns (original number, and a value for each line item), means (of the columns over all rows).

    The first table's columns go from left to right. A later one with another number of columns is put where its first
    columns, or else its last ones, differ less in their means from those that are there. Columns get the items of all parts; missing values are null.
    """
    placed: dict[int, dict] = {}
    for k, part in enumerate(parts):
        last = None
        for local, col in enumerate(part["columns"]):
            if last is not None:
                at = last + 1
            elif k > 0 and len(part["columns"]) != len(placed):
                mine = part["means"]
                theirs = [_mean([v for values in c["values"].values() for v in values]) for c in placed.values()]
                n = min(len(mine), len(theirs))
                left = sum(abs(mine[i] - theirs[i]) for i in range(n))
                right = sum(abs(mine[-1 - i] - theirs[-1 - i]) for i in range(n))
                if left < right:
                    at = 0
                elif len(mine) > len(theirs):
                    placed, at = {key + 1: c for key, c in placed.items()}, 0
                else:
                    at = local + len(theirs) - len(mine)
            else:
                at = local
            last = at
            column = placed.setdefault(at, {"original": col["col"], "element_index": part["element_index"], "values": {}})
            column["values"][k] = col["values"]
    out = []
    for at, c in placed.items():
        pairs = [(caption, value) for k, part in enumerate(parts) for caption, value in zip(part["captions"], c["values"].get(k, [None] * len(part["captions"])))]
        out.append({"col_idx": at, "original": c["original"], "element_index": c["element_index"], "pairs": pairs})
    if collapse:
        for k in range(len(out) - 1, 0, -1):
            a, b = out[k - 1]["pairs"], out[k]["pairs"]
            if len(a) == len(b) and [p[0] for p in a] == [p[0] for p in b] and all(x[1] is None or y[1] is None for x, y in zip(a, b)):
                out[k - 1]["pairs"] = [(x[0], y[1] if x[1] is None else x[1]) for x, y in zip(a, b)]
                out.pop(k)
    return out


def output_columns(groups: DataFrame, structured: DataFrame) -> DataFrame:
    """The columns of assembled groups: source_identifier, group_id, detected_class, col_idx, original_col, element_index, pairs (line_item, value).

    structured: structured tables with source_identifier and element_index. Locations that are no tables have no columns.
    """
    values = F.transform("numeric_cols", lambda c, k: F.struct(c.alias("col"), F.transform("line_items", lambda i: F.get(i["values"], k)).alias("values")))
    means = F.transform("numeric_cols", lambda c: F.coalesce(F.aggregate(F.filter(F.transform("grid", lambda r: F.get(r, c)["num"]), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + F.abs(v).cast("double")) / F.nullif(F.size(F.filter("grid", lambda r: F.get(r, c)["num"].isNotNull())), F.lit(0)), F.lit(0.0)))
    tables = structured.select(DOC, IDX, F.transform("line_items", lambda i: i["caption"]).alias("captions"), values.alias("columns"), means.alias("means"))
    part = F.struct("part", IDX, "detected_class", "collapse", "captions", "columns", "means")
    rows = groups.join(tables, [DOC, IDX]).groupBy(DOC, "group_id").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    widths = F.array_distinct(F.transform("_parts", lambda p: F.size(p["columns"])))
    # Of parts that all have as many columns each goes where it stands, which takes no search; such groups need no Python.
    alike = (F.size(widths) == 1) & ~F.get("_parts", F.lit(0))["collapse"]

    def pairs(k: Column) -> Column:
        return F.flatten(F.transform("_parts", lambda p: F.zip_with(p["captions"], F.get(p["columns"], k)["values"], lambda x, v: F.struct(x.alias("line_item"), v.cast("decimal(38,10)").alias("value")))))

    head = F.get("_parts", F.lit(0))
    column = lambda c, k: F.struct(k.alias("col_idx"), c["col"].cast("int").alias("original_col"), pairs(k).alias("pairs"))
    straight = rows.where(alike).select(DOC, "group_id", head["detected_class"].alias("detected_class"), head[IDX].cast("int").alias(IDX), F.explode_outer(F.transform(head["columns"], column)).alias("_c")).where("_c is not null")
    straight = straight.select(DOC, F.col("group_id").cast("int").alias("group_id"), "detected_class", "_c.col_idx", "_c.original_col", IDX, "_c.pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("line_item", pa.string()), ("value", pa.decimal128(38, 10))])
        schema = pa.schema([(DOC, pa.string()), ("group_id", pa.int32()), ("detected_class", pa.string()), ("col_idx", pa.int32()), ("original_col", pa.int32()), (IDX, pa.int32()), ("pairs", pa.list_(pair))])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = row["_parts"]
                for c in align(parts, parts[0]["collapse"]):
                    out.append({DOC: row[DOC], "group_id": row["group_id"], "detected_class": parts[0]["detected_class"], "col_idx": c["col_idx"], "original_col": c["original"], IDX: c["element_index"], "pairs": [{"line_item": x, "value": v} for x, v in c["pairs"]]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    searched = rows.where(~alike).mapInArrow(run, f"{DOC} string, group_id int, detected_class string, col_idx int, original_col int, {IDX} int, pairs array<struct<line_item:string,value:decimal(38,10)>>")
    return straight.unionByName(searched)


def best_in_proximity(groups: DataFrame, distances: DataFrame, close: int = CLOSE_DISTANCE) -> DataFrame:
    """The joined form for groups of one part: groups (source_identifier, detected_class, k, prob) without those that a closer, likelier one outdoes. distances: source_identifier, detected_class, k, kk, distance with k < kk."""
    near = distances.where(F.col("distance") <= close)
    p = groups.select(DOC, "detected_class", F.col("k").alias("_k"), "prob")
    both = near.join(p.withColumnRenamed("_k", "k").withColumnRenamed("prob", "pa"), [DOC, "detected_class", "k"]).join(p.withColumnRenamed("_k", "kk").withColumnRenamed("prob", "pb"), [DOC, "detected_class", "kk"])
    gone = both.select(DOC, "detected_class", F.when(F.col("pa") < F.col("pb"), F.col("k")).otherwise(F.col("kk")).alias("k")).distinct()
    return groups.join(gone, [DOC, "detected_class", "k"], "left_anti")
