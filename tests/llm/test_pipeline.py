"""The pipeline against a plain version of all its stages."""

from __future__ import annotations

import sentencepiece

import corpus_pipeline
from docloom.llm import langid
from docloom.llm.queries import TOKENIZERS
from tests.llm.test_brute_force import brute_mix, brute_near


def test_pipeline_like_brute_force(spark, data_dir):
    d = spark.read.parquet(f"{data_dir}/documents.parquet")
    known = {r.doc_id for r in langid.identify(d).collect() if r.accepted}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in d.collect() if r.doc_id in known]
    assert 0 < len(rows) < d.count() or len(rows) == d.count()
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1], r)
    rows = list(first.values())
    root = brute_near([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if root.get(r[0], r[0]) == r[0]]
    labels = {}
    for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    text = {r[0]: r[1] for r in rows}
    want = sorted((i, tuple(sp.encode(text[i]))) for i, *_ in brute_mix(spark, rows, labels))
    got = sorted((r.doc_id, tuple(r.pieces)) for r in corpus_pipeline.run(spark, data_dir).collect())
    assert got == want


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
