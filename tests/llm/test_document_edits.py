"""Versions of whole tables, and rows with one id."""

from __future__ import annotations

from itertools import zip_longest

from docloom.llm import merkle
from docloom.llm.queries import op1_document_edits, revised
from tests.llm.util import docs


def differences(x, y):
    """Places at which lists differ, with the entries; of lists of different length what they have in common at the ends is set aside."""
    pre = suf = 0
    if len(x) != len(y):
        while pre < min(len(x), len(y)) and x[pre] == y[pre]:
            pre += 1
        while suf < min(len(x), len(y)) - pre and x[-1 - suf] == y[-1 - suf]:
            suf += 1
    rest = zip_longest(x[pre : len(x) - suf], y[pre : len(y) - suf])
    return [(pre + k, u, v, "added" if u is None else "removed" if v is None else "changed") for k, (u, v) in enumerate(rest) if u != v]


def plain(i, a, b):
    if a is None or b is None:
        return {(i, None, None, "added" if a is None else "removed")}
    split = lambda t, by: [] if t is None else t.split(by)
    return {(i, s, p, change) for s, x, y, _ in differences(a.split("\n\n"), b.split("\n\n")) for p, _, _, change in differences(split(x, "\n"), split(y, "\n"))}


def test_what_is_put_in_is_one_edit(spark):
    text = "\n\n".join(f"a{k}\nb{k}\nc{k}" for k in range(9))
    new = {1: "new\n" + text, 2: text.replace("b4\n", "b4\nx\ny\n"), 3: text.replace("a4\nb4\nc4\n\n", ""), 4: "s\n\n" + text, 5: text.replace("b4\n", "").replace("c8", "z")}
    got = {tuple(r) for r in merkle.edits(docs(spark, [(i, text) for i in new]), docs(spark, list(new.items()))).collect()}
    assert got == set().union(*(plain(i, text, t) for i, t in new.items()))
    assert got == {(1, 0, 0, "added"), (2, 4, 2, "added"), (2, 4, 3, "added"), *((3, 4, p, "removed") for p in range(3)), (4, 0, 0, "added"), (5, 4, 1, "removed"), (5, 8, 2, "changed")}


def test_the_query_finds_every_edit(spark, data_dir):
    d = spark.read.parquet(f"{data_dir}/documents.parquet")
    a, b = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (d, revised(d)))
    want = set().union(*(plain(i, a.get(i), b.get(i)) for i in a.keys() | b.keys() if a.get(i) != b.get(i)))
    rows = op1_document_edits(spark, data_dir).collect()
    assert {x[3] for x in want} == {"added", "removed", "changed"} and {(r.doc_id, r.section, r.paragraph, r.change) for r in rows} == want
    roots = [{r.doc_id: r.root for r in merkle.fingerprints(x).collect()} for x in (d, revised(d))]
    assert all((r.old_root, r.new_root) == (roots[0].get(r.doc_id), roots[1].get(r.doc_id)) for r in rows)


def test_rows_with_one_id_are_all_compared(spark):
    old = docs(spark, [(1, "a"), (1, "b\nc"), (1, "z"), (2, "x"), (2, "x"), (None, "n")])
    new = docs(spark, [(1, "a"), (1, "b\nd"), (1, "z"), (2, "x"), (None, "m")])
    got = {tuple(r) for r in merkle.edits(old, new).collect()}
    assert got == {(1, 0, 1, "changed"), (2, None, None, "removed"), (None, 0, 0, "changed")}
