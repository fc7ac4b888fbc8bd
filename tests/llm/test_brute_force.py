"""Operators that SQL can't express, against plain versions on small fixtures."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from docloom.llm import fm_index, langid, license_scan, merkle, mixing, sentencepiece_codec, simhash
from docloom.llm.common import text_of
from docloom.llm.queries import TOKENIZERS
from tests.llm.util import docs

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def _words(rng, n, size=60):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# --- SentencePiece --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return sentencepiece_codec.Codec(sentencepiece_codec.tables(f.read()))


def test_pieces_like_the_library(codec, spark, data_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    made = ["", " ", "  a  b ", "aaaaaaaaaaaaaaaaaaaaaaaaa", "Ünïcödé 漢字 \U0001f600", "x\n\ny\tz", "....!!!???", "http://a.b/c?d=e&f", "▁a▁b", "".join(rng.choices("ab cd\n", k=3000))]
    made += ["".join(rng.choices("etaoin shrdlu", k=rng.randint(1, 60))) for _ in range(300)]
    made += ["a" * 5000, "".join(rng.choices("abcdefgh", k=5000)), "漢字" * 300, "\U0001f600" * 300]
    texts = made + [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("text").collect()]
    for t in texts:
        ids = codec.encode(t)
        assert ids == sp.encode(t), t[:80]
        assert codec.decode(ids) == t.replace("▁", " ")


def test_slices_and_nulls_like_single_texts(codec):
    rng = random.Random(5)
    texts = ["".join(rng.choices("etaoin shrdlu,.\n漢é", k=rng.randint(0, 200))) for _ in range(200)] + [None, "", "x"]
    pieces, count, same = sentencepiece_codec.encode_batch(codec, pa.array(texts, pa.string()))
    want = [None if t is None else codec.encode(t) for t in texts]
    assert pieces.to_pylist() == want and count.to_pylist() == [None if w is None else len(w) for w in want]
    assert same.to_pylist() == [None if t is None else True for t in texts]
    assert sentencepiece_codec.decode_batch(codec, pieces).to_pylist() == texts
    strange = pa.array([b"a\xffb", b"ok"]).cast(pa.binary())
    text = pa.Array.from_buffers(pa.string(), 2, strange.buffers())
    assert sentencepiece_codec.encode_batch(codec, text)[2].to_pylist() == [False, True]


def test_compatible_pairs_like_merging(codec, spark):
    """What undoing merges says about two pieces, against merging their joint text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(6)
    whole = np.flatnonzero((codec.length == 1) | (codec.left != np.arange(codec.n)))
    a, b = rng.choice(whole, 4000), rng.choice(whole, 4000)
    rank = {sp.id_to_piece(int(i)): sp.get_score(int(i)) for i in codec.id}
    got = codec.compatible(a.astype(np.int32), b.astype(np.int32))
    for x, y, g in zip(a, b, got):
        l, r = sp.id_to_piece(int(codec.id[x])), sp.id_to_piece(int(codec.id[y]))
        assert g == (sentencepiece_codec._merge(rank, l + r, []) == [l, r])


def test_round_trip_of_the_query(spark, data_dir):
    out = sentencepiece_codec.encode(spark.read.parquet(f"{data_dir}/documents.parquet"), MODEL)
    assert out.where("not round_trip").count() == 0
    back = sentencepiece_codec.decode(out, MODEL)
    src = spark.read.parquet(f"{data_dir}/documents.parquet").selectExpr("doc_id", "text as original")
    assert back.join(src, "doc_id").where("text <> original").count() == 0


# --- SimHash --------------------------------------------------------------------------------------------------------


def test_bit_sliced_comparison_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (5, 32), dtype=np.uint8)
    prints = base[rng.integers(0, 5, 300)] ^ (rng.random((300, 32)) < 0.25).astype(np.uint8) * rng.integers(0, 256, (300, 32), dtype=np.uint8)
    n = len(prints)
    for radius in (0, 31, 72, 255):
        i, j = simhash.close_pairs(prints, np.zeros(n, np.int64), np.full(n, n), radius)
        got = set(zip(i.tolist(), j.tolist()))
        want = {(a, b) for a, b in itertools.combinations(range(n), 2) if int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= radius}
        assert got == want


def _near_fixture(rng):
    rows = []
    for g in range(30):
        base = [f"g{g}v{rng.randrange(4000)}" for _ in range(rng.choice([40, 120, 400]))]
        rows.append((g * 10, " ".join(base)))
        for k in range(1, rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((g * 10 + k, " ".join(w)))
    return rows


def _prints(rows):
    data, offsets = text_of(pa.array([t for _, t in rows]))
    has, prints, _ = simhash.signatures(data, offsets)
    return {i: p for (i, t), p, h in zip(rows, prints, has) if h}


def brute_near(rows, radius=simhash.RADIUS):
    """id -> smallest id of its component, by all pairs."""
    p = _prints(rows)
    root = {i: i for i in p}
    for a, b in itertools.combinations(sorted(p), 2):
        if int(np.bitwise_count(p[a] ^ p[b]).sum()) <= radius:
            x, y = root[a], root[b]
            for k in root:
                if root[k] in (x, y):
                    root[k] = min(x, y)
    return root


def test_near_duplicates_against_all_pairs(spark):
    rows = _near_fixture(random.Random(4))
    got = {(r.doc_id, r.keep_doc_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    want = {(i, r) for i, r in brute_near(rows).items() if i != r}
    assert want and got <= want
    assert len(got) >= 0.9 * len(want)


def test_recall_on_the_documents(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    want = {i for i, r in brute_near(rows).items() if i != r}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_near_dedup_of_tiles(spark, monkeypatch):
    """Keys of more rows than a tile has give the same groups."""
    rows = _near_fixture(random.Random(4)) + [(1000 + i, "one shared beginning of words " * 3 + f"t{i}") for i in range(40)]
    whole = {tuple(r) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    monkeypatch.setattr(simhash, "TILE_ROWS", 4)
    assert {tuple(r) for r in simhash.near_duplicates(docs(spark, rows)).collect()} == whole


# --- substrings -----------------------------------------------------------------------------------------------------


def brute_repeats(rows, least):
    names = {(i, t): (t or "").split() for i, t in rows if t is not None}
    grams = {}
    for d, w in names.items():
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(d)
    out = set()
    for d, w in names.items():
        covered = np.zeros(len(w) + 1, bool)
        for k in range(len(w) - least + 1):
            if len(grams[tuple(w[k : k + least])]) > 1:
                covered[k : k + least] = True
        # neighbours that only touch are one run, too
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int)])))
        out |= {(d[0], int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])}
    return out


@pytest.mark.parametrize(("least", "gram", "shard", "part"), [(50, 25, 1 << 18, 1 << 21), (12, 5, 200, 300), (6, 3, 64, 64)])
def test_repeats_like_brute_force(spark, least, gram, shard, part):
    rng = random.Random(least)
    shared = [_words(rng, rng.randint(least, 3 * least), 10_000) for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += _words(rng, rng.randint(0, least), 10_000)
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randint(0, len(s) // 2)
                w += s[a : rng.randint(a, len(s))] if rng.random() < 0.5 else s
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, rows[1][1]), (102, None), (103, ""), (104, " ".join(["same"] * 500)), (105, " ".join(["same"] * 300)), (106, " ".join(_words(rng, 200, 2)))]
    got = {(r.doc_id, r.start_word, r.end_word) for r in fm_index.repeats(docs(spark, rows), least=least, gram=gram, shard_words=shard, part_words=part).collect()}
    assert got == brute_repeats(rows, least)


def test_repeats_of_the_documents(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    split = __import__("re").compile("[ \t\n\r\x0b\x0c]+").split
    rows = [(i, " ".join(x for x in split(t) if x)) for i, t in rows]
    got = {(r.doc_id, r.start_word, r.end_word) for r in fm_index.repeats(docs(spark, rows)).collect()}
    assert got == brute_repeats(rows, fm_index.MIN_WORDS)


def test_backward_search_counts_like_a_scan():
    rng = np.random.default_rng(9)
    words = rng.integers(0, 5, 400).astype(np.uint64)
    index = fm_index.FmIndex(words, np.array([0, 150, 400]), np.array([1, 2]))
    for n in (1, 2, 4):
        for k in range(0, 300, 17):
            lo, hi = np.array([0]), np.array([index.n])
            for c in index.number(words[k : k + n])[::-1]:
                sym = np.array([c])
                lo, hi = index.start[c] + index.matrix.occurrences(sym, lo), index.start[c] + index.matrix.occurrences(sym, hi)
            want = sum((words[j : j + n] == words[k : k + n]).all() and not j < 150 < j + n for j in range(400 - n + 1))
            got = int(hi[0] - lo[0])
            if not k < 150 < k + n:
                assert got == want


# --- licences -------------------------------------------------------------------------------------------------------


def test_license_spans(spark, data_dir):
    rng = random.Random(8)
    mit = license_scan.TEMPLATES["mit"]
    changed = mit.split()
    changed[10] = "whatever"
    del changed[20]
    changed.insert(40, "extra")
    filler = " ".join(_words(rng, 300))
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler}\n{' '.join(changed)}\n{filler}"), (3, filler), (4, " ".join(mit.split()[:20])), (5, f"{mit} {filler} {mit}"), (6, "ALL RIGHTS RESERVED."), (7, "all rights were reserved")]
    got = {}
    for r in license_scan.scan(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    n = len(license_scan._words(mit))
    assert [(r.license, r.start_word, r.end_word, r.coverage) for r in got[1]] == [("mit", 300, 300 + n, 1.0)]
    assert [r.license for r in got[2]] == ["mit"] and 0.9 < got[2][0].coverage < 1
    assert 3 not in got and 4 not in got and 7 not in got
    assert sorted((r.license, r.start_word) for r in got[5]) == [("mit", 0), ("mit", n + 300)]
    assert [(r.license, r.start_word, r.end_word) for r in got[6]] == [("all-rights-reserved", 0, 3)]


def _common(x, y):
    """Length of the longest common subsequence, plainly."""
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for k, b in enumerate(y, 1):
            last, row[k] = row[k], last + 1 if a == b else max(row[k], row[k - 1])
    return row[-1]


def test_license_scan_like_brute_force(spark, data_dir):
    """Whatever a search of whole texts finds, without votes or diagonals, is found, in the table's documents and in made ones; and whatever is found is one, by a plain comparison."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").where("doc_id % 7 = 0 or lower(text) like '%licen%'").select("doc_id", "text").collect()]
    names = sorted(license_scan.TEMPLATES)
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += _words(rng, rng.choice([0, 0, 1, 2, 5, 40]), 10**6)
            w = license_scan.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 8])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = [f"x{rng.randrange(10**6)}"] * rng.choice([0, 1])
            parts += w
        rows.append((10**6 + i, " ".join(parts)))
    got = {}
    for r in license_scan.scan(docs(spark, rows)).collect():
        got.setdefault((r.doc_id, r.license), []).append((r.start_word, r.end_word, r.matched))
    checked = 0
    for i, text in rows:
        w = license_scan._words(text)
        for name, t in license_scan.TEMPLATES.items():
            t, mine = license_scan._words(t), got.pop((i, name), [])
            for x, y, n in license_scan.occurrences(w, t):
                assert any(a < y and x < b and m >= n for a, b, m in mine), (i, name, x, y)
                checked += 1
            for (x, y, n), after in itertools.zip_longest(sorted(mine), sorted(mine)[1:]):
                assert _common(w[x:y], t) >= n >= license_scan.MIN_WORDS * len(t) and y - x <= license_scan.LONGEST * len(t) + license_scan.SLACK
                assert after is None or y <= after[0]
    assert checked > 150 and not got


def test_every_one_of_many_occurrences_is_reported(spark):
    notice = "Released under the MIT License"
    rows = [(1, "All rights reserved. " * 2), (2, "All rights reserved. " * 50), (3, "All rights reserved by " * 30), (4, "Released under an MIT License"), (5, f"{notice} " * 40), (6, license_scan.TEMPLATES["mit-whole"] + " " + license_scan.TEMPLATES["mit-whole"])]
    got = license_scan.scan(docs(spark, rows)).collect()
    count = lambda i, name: sum(r.doc_id == i and r.license == name for r in got)
    assert [count(i, "all-rights-reserved") for i in (1, 2, 3)] == [2, 50, 30]
    assert (count(4, "mit-notice"), count(5, "mit-notice"), count(6, "mit-whole"), count(6, "mit")) == (1, 40, 2, 2)
    assert {r.spdx_id for r in got if r.doc_id == 6} == {"MIT"}


# --- language ID ----------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no data")
    d = spark.read.parquet(path)
    model = langid.train(d.where("doc_id % 2 = 0"))
    held = d.where("doc_id % 2 = 1 and lang is not null and length(text) > 100").selectExpr("doc_id", "lang", "text")
    out = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id")
    n, right = out.count(), out.where("predicted = lang").count()
    assert n > 200 and right >= 0.95 * n


def test_scores_like_a_plain_sum(spark):
    rows = [(1, "Der Hund läuft.", "de", "w"), (2, "The dog runs.", "en", "w"), (3, "123 !?", "en", "w"), (4, None, "en", "w"), (5, "", "de", "w")]
    d = docs(spark, rows)
    langs, matrix = langid.train(d)
    assert langs == ["de", "en"] and np.allclose(np.exp(matrix.astype(float)).sum(axis=0), 1, atol=1e-3)
    out = {r.doc_id: r for r in langid.identify(d, (langs, matrix)).collect()}
    for i, text in ((1, "der hund läuft."), (2, "the dog runs.")):
        data = np.frombuffer(text.encode(), np.uint8)
        feats, _ = langid.features(data, np.array([0, len(data)]))
        sums = [sum(float(matrix[x, j]) for f in feats for x in f) for j in range(2)]
        p = [math.exp(s - max(sums)) for s in sums]
        assert out[i].predicted == langs[int(np.argmax(sums))] and abs(out[i].posterior - max(p) / sum(p)) < 1e-6
    assert [out[i].predicted for i in (3, 4, 5)] == ["und"] * 3 and not out[3].accepted


# --- mixing and fingerprints ----------------------------------------------------------------------------------------


def brute_mix(spark, rows, labels, weights=None, budget=None):
    """(doc_id, source, epoch, tokens) of every copy, by sorting each source as a whole."""
    from pyspark.sql import functions as F

    u = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "i bigint").select("i", mixing.uniform(F.col("i"))).collect()}
    have = {}
    for _, t, _, s in rows:
        have[s] = have.get(s, 0) + len((t or "").split())
    w = weights or {s: math.floor(math.sqrt(n)) for s, n in have.items()}
    total = budget if budget is not None else sum(have.values())
    weight_sum = sum(w.get(s, 0) for s in have)
    out = []
    for s, n in have.items():
        want = total * w.get(s, 0) // weight_sum if weight_sum else 0
        epochs, rest = divmod(want, n) if n else (1, 0)
        mine = [(-math.log(u[i]) / mixing.QUALITY[labels.get(i)], i, len((t or "").split())) for i, t, _, x in rows if x == s]
        for k, i, size in mine:
            before = sum(z for a, b, z in mine if (a, b) <= (k, i))
            out += [(i, s, e, size) for e in range(epochs + (before <= rest and rest > 0 or (before <= rest and n == 0) or before == 0 <= rest and n > 0))]
    return out


def test_mixing_like_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(_words(rng, rng.randint(1, 80))), "en", rng.choice(["a", "a", "a", "b", "c"])) for i in range(200)]
    labels = {i: rng.choice([0, 1]) for i in range(0, 200, 3)}
    table = spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id bigint, quality int, toxic int")
    for weights, budget in ((None, None), ({"a": 1, "b": 3}, 9000), ({"a": 5, "b": 1, "c": 1}, 1000)):
        got = [tuple(r) for r in mixing.mix(docs(spark, rows), table, weights, budget).collect()]
        assert sorted(got) == sorted(brute_mix(spark, rows, labels, weights, budget))
        spread = mixing.mixed(docs(spark, rows), table, weights, budget)
        assert sorted(r.doc_id for r in spread.collect()) == sorted(r[0] for r in got)


def test_edits_are_located(spark):
    old = docs(spark, [(1, "a\nb\n\nc\nd\n\ne"), (2, "same"), (3, "gone"), (5, "p\nq")])
    new = docs(spark, [(1, "a\nb\n\nc\nX\n\ne"), (2, "same"), (4, "new"), (5, "p\nq\nr")])
    got = sorted((tuple(r) for r in merkle.edits(old, new).collect()), key=str)
    assert got == sorted([(1, 1, 1, "changed"), (3, None, None, "removed"), (4, None, None, "added"), (5, 0, 2, "added")], key=str)
    roots = {r.doc_id: r.root for r in merkle.fingerprints(docs(spark, [(1, "a\n\nb"), (2, "a\nb"), (3, "a\n\nb"), (4, None), (5, "")])).collect()}
    assert roots[1] == roots[3] and len({roots[1], roots[2], roots[4], roots[5]}) == 4
