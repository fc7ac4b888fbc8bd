"""Texts in which one anchor comes again and again: few windows, no match lost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docloom.llm import fm_index
from docloom.llm.common import shingles
from tests.llm.test_brute_force import brute_repeats
from tests.llm.util import docs


def _texts(rng: random.Random) -> list[list[str]]:
    """Sorted words, runs of one word and repeated phrases of many lengths, with other words between them."""
    out = []
    for i in range(40):
        w: list[str] = []
        for _ in range(rng.randint(1, 4)):
            phrase = [f"p{rng.randrange(3)}" for _ in range(rng.choice([1, 1, 2, 3, 7, 12, 13, 14, 24, 25, 26, 30]))]
            w += phrase * rng.randint(1, 200 // len(phrase)) + [f"x{rng.randrange(2000)}" for _ in range(rng.randint(0, 5))]
        out.append(sorted(w) if i % 4 == 0 else w)
    return out


def test_runs_of_one_word_have_few_windows():
    words = np.repeat(np.array([7, 8, 9], np.uint64), [3000, 500, 40])
    pos = fm_index.anchors(words, np.array([0, len(words)]))[1]
    w = fm_index.MIN_WORDS - fm_index.GRAM + 1
    # One for every place of a run before; now one in w, and what lies where runs meet.
    assert len(pos) < len(words) / w + 6 * w
    assert np.diff(pos).max() <= w


@pytest.mark.parametrize(("least", "gram"), [(50, 25), (12, 5), (6, 3)])
def test_each_match_still_holds_an_anchor_of_its_smallest_hash(least, gram):
    w = least - gram + 1
    for i, text in enumerate(_texts(random.Random(least))):
        words = np.unique(text, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        _, pos, h = fm_index.anchors(words, np.array([0, len(words)]), least, gram)
        grams = shingles(words, gram)
        kept = dict(zip(pos.tolist(), h.tolist()))
        for k in range(len(words) - least + 1):
            assert int(grams[k : k + w].min()) in {kept[p] for p in range(k, k + w) if p in kept}, (i, k)


@pytest.mark.parametrize(("least", "gram", "shard", "part"), [(50, 25, 1 << 18, 1 << 21), (12, 5, 200, 300)])
def test_repeats_in_periodic_texts_like_brute_force(spark, least, gram, shard, part):
    rows = [(i, " ".join(w)) for i, w in enumerate(_texts(random.Random(7 + least)))]
    got = {(r.doc_id, r.start_word, r.end_word) for r in fm_index.repeats(docs(spark, rows), least=least, gram=gram, shard_words=shard, part_words=part).collect()}
    assert got == brute_repeats(rows, least)


def test_a_search_ends_where_nothing_long_enough_can_come():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1000, 80).astype(np.uint64)
    b = np.concatenate([a[:40], [np.uint64(5000)], a[41:]])
    index = fm_index.FmIndex(np.concatenate([a, b]), np.array([0, 80, 160]), np.array([1, 2]))
    steps = []
    rank = index.matrix.occurrences
    index.matrix.occurrences = lambda c, i: steps.append(len(c)) or rank(c, i)
    begin, end, doc = np.array([0]), np.array([80]), index.document(np.array([1]))
    assert not len(index.matches(index.symbols, begin, end, doc, 50)[0])
    assert len(steps) < 60
    s, x, y = index.matches(index.symbols, begin, end, doc, 39)
    assert sorted(zip(x.tolist(), y.tolist())) == [(0, 40), (41, 80)] and not s.any()
