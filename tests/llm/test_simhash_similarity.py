"""Near copies are those of similar word pairs, however the fingerprints fall."""

from __future__ import annotations

import random

import numpy as np

from docloom.llm import simhash
from tests.llm.util import docs


def _couples(rng, n, shared, own):
    """Pairs of texts with so many words in common at their beginning and so many of their own behind."""
    rows = []
    for g in range(n):
        common = [f"c{rng.randrange(10**6)}" for _ in range(shared)]
        rows += [(2 * g + k, " ".join(common + [f"o{rng.randrange(10**6)}" for _ in range(own)])) for k in (0, 1)]
    return rows


def test_documents_that_share_only_some_lines_stay(spark):
    rng = random.Random(21)
    # 61 of 99 word pairs each in common: a similarity of 0.45, for which 72 differing bits are the mean
    assert simhash.near_duplicates(docs(spark, _couples(rng, 60, 62, 38))).count() == 0


def test_similar_documents_go(spark):
    rng = random.Random(22)
    # 81 of 99: a similarity of 0.69; some of these differ in more than 59 bits
    got = {(r.doc_id, r.keep_doc_id) for r in simhash.near_duplicates(docs(spark, _couples(rng, 60, 82, 18))).collect()}
    assert got <= {(2 * g + 1, 2 * g) for g in range(60)} and len(got) >= 54


def test_ties_fall_to_either_side():
    rng = np.random.default_rng(23)
    grams = simhash.mix(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    prints = simhash.fingerprints(grams, np.arange(0, 4001, 2))
    assert abs(np.unpackbits(prints, axis=1).mean() - 0.5) < 0.01
