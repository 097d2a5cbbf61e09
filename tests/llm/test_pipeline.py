"""The pipeline over the smallest test table: each stage against brute force on what the one before kept."""

import hashlib
import re
import struct

import public_tokenizers
import pytest

import corpus_pipeline
from quern.llm import byte_bpe, near_dedup, quality_classifier
from quern.llm.shared import cut, documents
from tests.llm.test_operators import planned_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of the table, and of each stage."""
    docs = documents(spark, SF)
    out = {"": (docs.columns, docs.collect())}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        out[name] = (docs.columns, docs.collect())
    return out


def test_filters(spark, stages):
    assert [stages[s][0] for s in ("quality", "exact", "near", "mix")] == [stages[""][0]] * 4
    model = quality_classifier.fitted(spark, SF)
    scores = dict(zip([r.doc_id for r in stages[""][1]], model.scores(quality_classifier.counted([r.text for r in stages[""][1]], quality_classifier.Features())), strict=True))
    good = {r.doc_id: r.text for r in stages[""][1] if scores[r.doc_id] >= quality_classifier.CUT}
    assert {r.doc_id: r.text for r in stages["quality"][1]} == good and 0 < len(good) < len(scores)
    first: dict[str, int] = {}
    for d in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", good[d] or ""), d)
    assert sorted(r.doc_id for r in stages["exact"][1]) == sorted(first.values())
    classes = near_dedup.brute_force([(r.doc_id, r.text) for r in stages["exact"][1]])
    assert sorted(r.doc_id for r in stages["near"][1]) == sorted(set(classes.values())) and len(set(classes.values())) < len(classes)


def test_mix_and_encode(stages):
    sizes, taken = {}, {}
    for table, out in ((stages["near"][1], sizes), (stages["mix"][1], taken)):
        for r in table:
            out[r.source] = out.get(r.source, 0) + len((r.text or "").split())
    targets = planned_targets(sizes)
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in targets.items())
    ranks = byte_bpe.ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    own = pytest.importorskip("tiktoken").Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(r.text.encode()).hexdigest()) for r in stages["mix"][1] for ids in [own.encode_ordinary(r.text)])
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in stages["encode"][1]) == want
    assert all(r.n_tokens * 4 == len(r.ids) > 0 for r in stages["encode"][1])


def test_run(spark, stages):
    again = corpus_pipeline.run(spark, SF)
    assert again.columns == stages["encode"][0] and sorted((r.doc_id, bytes(r.ids)) for r in again.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in stages["encode"][1])
