"""Tables that share numbers: sets are told by numbers, each pair is met once."""

from __future__ import annotations

from random import Random

from docloom.operators import mapping as M


def _some(spark, seed):
    draw = Random(seed)
    rows = [(k, [draw.randrange(12) for _ in range(draw.randrange(4))]) for k in range(60)]
    return rows, spark.createDataFrame(rows, "id long, keys array<long>")


def test_pairs_with_and_without_a_second_frame(spark):
    (rows, a), (rows2, b) = _some(spark, 1), _some(spark, 2)
    pairs = lambda x, y: sorted((i, j, n) for i, k in x for j, m in y if (n := len({*k} & {*m})))
    rows_of = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows_of(M.number_overlap(a, b)) == pairs(rows, rows2)
    assert rows_of(M.number_overlap(a)) == [p for p in pairs(rows, rows) if p[0] < p[1]]


def test_sets_are_moved_as_numbers(spark):
    plan = M.number_overlap(_some(spark, 1)[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_sa#" in plan and "L <= _sb#" in plan  # of two sets, which are told by numbers, one pair is counted
