"""Hashing, counting and fingerprints against versions in plain Python that share no code with them, and the values of defined cases."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from docloom.llm import exact_dedup, fm_index, langid, license_scan, merkle, mixing, sentencepiece_codec, simhash
from docloom.llm.common import text_of
from docloom.llm.queries import TOKENIZERS
from tests.llm.test_edges import LONG, labels, nasty
from tests.llm.util import docs

M64 = (1 << 64) - 1
K1, K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


# --- language ID ----------------------------------------------------------------------------------------------------


def plain_grams(text: str) -> list[int]:
    """Bucket numbers of all 1- to 3-grams with a letter."""
    chars = [ord(c) if "a" <= c <= "z" or ord(c) >= 0xAA else 32 for c in text.lower()]
    out = []
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            if any(c != 32 for c in chars[i : i + n]):
                h = 0
                for c in chars[i : i + n]:
                    h = (h ^ c) * K1 & M64
                    h ^= h >> 31
                out.append((h * K2 & M64) >> 64 - 15)
    return out


TEXTS = [("Der Hund läuft über 3 Straßen.", "de"), ("Zwei Katzen, 漢字!", "de"), ("The dog runs; it's 5 o'clock", "en"), ("a", "en"), ("12 ?!", "en"), ("", "en")]


def test_training_counts_like_a_plain_recount(spark):
    rows = [(i, t, la, "w") for i, (t, la) in enumerate(TEXTS)] + [(9, None, "en", "w"), (10, "unlabelled", None, "w")]
    langs, matrix = langid.train(docs(spark, rows))
    counts = {la: Counter(g for t, x in TEXTS if x == la for g in plain_grams(t)) for la in ("de", "en")}
    assert langs == ["de", "en"] and matrix.shape == (langid.BUCKETS, 2)
    for j, la in enumerate(langs):
        total = sum(counts[la].values()) + langid.ALPHA * langid.BUCKETS
        want = np.full(langid.BUCKETS, math.log(langid.ALPHA / total))
        for b, n in counts[la].items():
            want[b] = math.log((langid.ALPHA + n) / total)
        assert np.allclose(matrix[:, j], want, atol=1e-5)


def test_scores_like_a_plain_recount(spark):
    rows = [(i, t, la, "w") for i, (t, la) in enumerate(TEXTS)]
    model = langid.train(docs(spark, rows))
    mean, deviation = langid.expected(model[1])
    for r in langid.identify(docs(spark, rows), model).collect():
        grams = plain_grams(TEXTS[r.doc_id][0])
        sums = [sum(float(model[1][g, j]) for g in grams) for j in range(2)]
        best = max(range(2), key=lambda j: (sums[j], -j))
        posterior = 1 / sum(math.exp(s - sums[best]) for s in sums) if grams else 0
        n = max(1, len(grams))
        ok = bool(grams) and posterior >= langid.MIN_POSTERIOR and sums[best] / n >= mean[best] - langid.MARGIN - langid.DEVIATIONS * deviation[best] / math.sqrt(n)
        assert abs(r.posterior - posterior) < 1e-6 and r.predicted == (model[0][best] if ok else "und") and r.accepted == ok


# --- SimHash --------------------------------------------------------------------------------------------------------


def _mix(h: int) -> int:
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


def _word(w: bytes) -> int:
    h = len(w) * K2 & M64
    for i in range(0, max(len(w), 1), 8):
        h = (h ^ int.from_bytes(w[i : i + 8], "little")) * K1 & M64
        h ^= h >> 29
    return _mix(h)


def plain_print(text: str) -> int | None:
    """The 256 bits of a text, as one number."""
    words = [_word(w) for w in text.encode().split()]
    if not words:
        return None
    pairs = {_mix((a * K1 + b) & M64) for a, b in zip(words, words[1:])} or {_mix(words[0])}
    out = 0
    for w in range(4):
        seed = _mix((w + 1) * K1 & M64)
        hashes, tie = [_mix(p ^ seed) for p in pairs], _mix(min(pairs) ^ seed)
        for b in range(64):
            ones = sum(h >> b & 1 for h in hashes)
            if 2 * ones > len(pairs) or 2 * ones == len(pairs) and tie >> b & 1:
                out |= 1 << 64 * w + b
    return out


def test_fingerprints_like_a_plain_recount():
    rng = random.Random(7)
    texts = ["", " \n", "one", "two words", "ä ö longer-than-eight-bytes x", "same " * 40] + [" ".join(f"w{rng.randrange(50)}" * rng.randint(1, 4) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    has, prints, _ = simhash.signatures(*text_of(pa.array(texts)))
    assert [int.from_bytes(p.tobytes(), "little") if h else None for h, p in zip(has, prints)] == [plain_print(t) for t in texts]


# --- defined cases --------------------------------------------------------------------------------------------------


def test_defined_values(spark):
    """Rows of test_edges: 1 twice, 2 null, 3 empty, 4 and 8 one very long text, two without id (one null), 5 white space, 6 twice with different texts."""
    d = nasty(spark, True)
    prints = merkle.fingerprints(d).collect()
    assert len(prints) == 12 and len({r.root for r in prints if r.doc_id in (4, 8)}) == 1
    assert {(r.root, r.n_sections, r.n_paragraphs) for r in prints if r.doc_id == 2} == {(None, 0, 0)} and {(r.n_sections, r.n_paragraphs) for r in prints if r.doc_id == 3} == {(1, 1)}
    told = langid.identify(d).collect()
    assert {r.predicted for r in told if r.doc_id in (2, 3, 5)} == {"und"} and {r.posterior for r in told if r.doc_id in (2, 3, 5)} == {0.0} and len(told) == 12
    taken = mixing.mix(d, labels(spark)).collect()
    assert sum(r.doc_id == 1 for r in taken) % 2 == 0 and {r.n_tokens for r in taken if r.doc_id in (2, 3, 5)} <= {0} and {r.source for r in taken} <= {None, "web", "books"}
    pieces = {(r.doc_id, r.n_pieces if r.pieces is None else len(r.pieces), r.round_trip) for r in sentencepiece_codec.encode(d, MODEL).collect() if r.doc_id in (2, 3)}
    assert pieces == {(2, None, None), (3, 0, True)}
    # One of the repeated rows stays without being named; the long text's second copy goes.
    assert [tuple(r) for r in simhash.near_duplicates(d).collect()] == [(8, 4)]
    assert [tuple(r) for r in exact_dedup.duplicates(d).collect()] == [(8, 4)]
    assert exact_dedup.dedup(d).count() == 10 and simhash.dedup(d).count() == 10
    n = len(LONG.split())
    assert sorted(tuple(r) for r in fm_index.repeats(d).collect()) == [(4, 0, n, n), (8, 0, n, n)]
    assert license_scan.scan(d).count() == 0


def test_ties_are_broken_by_id(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(7, words), (3, words + " end"), (5, words), (None, words), (3, words)]
    assert sorted(((r.doc_id, r.keep_doc_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=str) == sorted([(5, 3), (7, 3), (None, 3), (3, 3)], key=str)
    assert {(r.doc_id, r.start_word, r.end_word) for r in fm_index.repeats(docs(spark, rows)).collect()} == {(i, 0, 120) for i in (3, 5, 7, None)}
