"""The pipeline, stage by stage against brute force on each stage's own input."""

from __future__ import annotations

import collections
import hashlib

import pytest
from llm_helpers import expected_cuts, expected_links, expected_targets

import corpus_pipeline
from tidegrid.llm import rules

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, given, tmp_path_factory):
    """Rows before the first stage and after each, written and read as a run does it."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [("documents", docs.collect(), docs.columns)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out.append((name, docs.collect(), docs.columns))
    return out


def words(text):
    return (text or "").encode().split()


def test_columns(stages):
    documents = stages[0][2]
    for name, _, columns in stages[1:-1]:
        assert columns == documents, name
    assert stages[-1][2] == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert [name for name, *_ in stages[1:]] == [name for name, _ in corpus_pipeline.STAGES]


def test_rules_stage(spark, stages):
    before, after = stages[0][1], stages[1][1]
    assert set(after) <= set(before) and len(set(after)) == len(after)
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    long = [r for r in before if len(words(r.text)) >= rules.LEAST_WORDS]
    assert all(r.doc_id not in kept for r in before if len(words(r.text)) < rules.LEAST_WORDS)
    good = [r.doc_id in kept for r in long if labels.get(r.doc_id) == 1]
    bad = [r.doc_id in kept for r in long if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_near_duplicates_stage(stages):
    before, after = stages[1][1], stages[2][1]
    groups = {eval(line)[1] for line in expected_links(before)}  # noqa: S307 - reprs of numbers
    assert sorted(r.doc_id for r in after) == sorted(groups)
    assert set(after) <= set(before)


def test_passages_stage(stages):
    before, after = stages[2][1], stages[3][1]
    digest = lambda r: hashlib.sha256(b" ".join(words(r.text))).hexdigest()
    want = {eval(line)[0]: eval(line)[1:] for line in expected_cuts(before)}  # noqa: S307
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        n, removed, sha = want[r.doc_id]
        assert digest(r) == sha and len(words(r.text)) == n - removed
        if not removed:
            assert r.text == texts[r.doc_id]
        else:
            assert r.n_chars == len(r.text)


def test_mix_stage(stages):
    before, after = stages[3][1], stages[4][1]
    copies = collections.Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        n = len(words(r.text))
        sizes[r.source] += n
        taken[r.source] += n * copies[r]
        largest[r.source] = max(largest[r.source], n)
    for source, target in expected_targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1


def test_token_stage(stages):
    tokenizers = pytest.importorskip("tokenizers")
    from tidegrid.llm.common import tokenizer_path

    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    before, after = stages[4][1], stages[5][1]
    want = collections.Counter(
        (r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in before
    )
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in after) == want
    for r in after:
        back = library.decode(r.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_run_equals_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert collections.Counter(map(repr, rows)) == collections.Counter(map(repr, stages[-1][1]))
