"""The pipeline's stages on the smallest test tables, each held against its operator's own decisions."""

import os

import pytest

import corpus_pipeline
from tablelens.llm import decontaminate, quality, sentencepiece_sampling, simhash, toxicity
from tablelens.llm.common import stable, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    expected = [
        lambda d: [r.doc_id for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).collect() if r.score < 0.5],
        lambda d: [r.doc_id for r in quality.judge_quality(d, quality.fit_lines(d, labels)).collect() if r.kept],
        lambda d: [r.doc_id for r in simhash.near_duplicates(d).collect() if r.doc_id == r.component_id],
        lambda d: [r.doc_id for r in decontaminate.find_benchmark(d, bench).collect() if not r.n_hit]]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        kept = stable(stage(spark, docs, SF))
        assert kept.columns == table(spark, SF, "documents").columns, name
        assert ids(kept) == sorted(want(docs)), name
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({r.doc_id for r in last}) == ids(docs)
    vocab = sentencepiece_sampling.vocabulary(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(sentencepiece_sampling.decode_pieces(r.ids, vocab) == texts[r.doc_id] for r in last)
