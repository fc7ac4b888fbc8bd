"""Exact dedup against plain grouping of whole texts."""

from __future__ import annotations

import random

import numpy as np

from docloom.llm import exact_dedup
from tests.llm.util import SCHEMA, docs


def brute(rows):
    """doc_id -> smallest id of an equal text, for all but the smallest."""
    by = {}
    for i, text in rows:
        if text is not None:
            by.setdefault(text, []).append(i)
    key = lambda i: (i is None, i or 0)
    out = set()
    for ids in by.values():
        first = min(ids, key=key)
        out |= {(i, first) for i in ids if i != first}
    return out


def test_duplicates_like_brute_force(spark):
    rng = random.Random(5)
    texts = ["", "a", "word " * 2000, *(" ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(1, 400))) for _ in range(20))]
    rows = [(i, rng.choice(texts)) for i in range(120)] + [(500, None), (501, None)]
    got = {tuple(r) for r in exact_dedup.duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_dedup_keeps_one_row_of_each_text_and_all_columns(spark):
    rows = [(3, "x y"), (1, "x y"), (1, "x y"), (2, "z"), (None, "z"), (7, None), (7, None), (8, ""), (9, "")]
    out = exact_dedup.dedup(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "x y"), (2, "z"), (7, None), (7, None), (8, "")], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicates(empty).count() == 0
    assert exact_dedup.dedup(empty).count() == 0


def test_clashing_extra_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a", "p", 5), (2, "a", "q", 6)], "doc_id bigint, text string, _k string, _keep int")
    assert [tuple(r) for r in exact_dedup.dedup(df).collect()] == [(1, "a", "p", 5)]


def test_colliding_digests_are_told_apart_by_content(spark):
    """With a digest of one byte many chunks collide; verification must still give the exact groups."""
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdef ", k=rng.randint(3000, 9000))) for _ in range(12)]
    rows = [(i, pool[i % 12]) for i in range(30)]
    got = {(r._id, r._keep_id) for r in exact_dedup.copies(docs(spark, rows), digest=_weak).where("not _keep").collect()}
    assert got == brute(rows)


def _weak(chunk) -> bytes:
    return bytes([len(chunk) % 2])


def test_chunks_cover_texts_and_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 40_000, dtype=np.uint8)
    moved = np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), body])
    cut = lambda d: [bytes(d[a:b]) for a, b in zip(*(lambda e: (e[:-1], e[1:]))(exact_dedup.cut_points(d, np.array([0, len(d)]))[0]))]
    a, b = cut(body), cut(moved)
    assert b"".join(a) == body.tobytes() and b"".join(b) == moved.tobytes()
    assert len(set(a) & set(b)) >= len(a) - 2  # all but those at the edit


def test_long_chunks_are_cut_at_multiples():
    data = np.full(200_000, 97, np.uint8)
    edges, _ = exact_dedup.cut_points(data, np.array([0, len(data)]))
    assert np.diff(edges).max() <= exact_dedup.MAX_CHUNK
