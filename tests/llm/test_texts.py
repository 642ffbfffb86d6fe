"""BPE, quality rules and repeated passages against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from llm_helpers import clash, expected_cuts, sentence
from pyspark.sql import functions as F

from tidegrid.llm import bpe, rules, substrings
from tidegrid.llm.common import tokenizer_path

SIGNS = "aabcdeéßŁΣσςİ ﬁ́  'sx0123½²Ⅷ!@#<|>\x00\x1c\x85中文字\U0001f642‍\t\n"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    found = tokenizers.Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_equals_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ["", "<|startoftext|>a<|endoftext|>", "<|startof", "I'LL don't 'S", "a" * 5000]
    ours = bpe.Bpe(bpe.read_spec(tokenizer_path()))
    for text, theirs in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(text) == theirs.ids, repr(text)
        back = library.decode(theirs.ids, skip_special_tokens=False)
        assert ours.decode(theirs.ids) == back
        assert ours.written(text) == (len(theirs.ids), " ".join(map(str, theirs.ids)), back)


def test_bpe_on_documents(library, given, edge, none):
    for docs in (given, edge):
        rows = bpe.encode_decode(docs.withColumn("kept_text", F.col("text")), tokenizer_path()).collect()
        assert len(rows) == docs.count()
        for r in rows:
            ids = library.encode(r.kept_text or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids) == (len(ids), ids)
            assert r.ids_sha256 == sha(" ".join(map(str, ids)))
            assert r.decoded == library.decode(ids, skip_special_tokens=False)
            assert r.decoded_sha256 == sha(r.decoded)
    assert bpe.encode_decode(none, tokenizer_path()).count() == 0
    named = bpe.encode_decode(clash(edge, "ids", "extra"), tokenizer_path(), results=("ids",))
    assert named.columns == ["doc_id", "lang", "source", "n_chars", "extra", "ids"]


def base_figures(text: str | None) -> tuple:
    words = [w.decode() for w in (text or "").encode().split()]
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\f\r")]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_base_figures(given, edge, labels):
    for docs in (given, edge):
        marked, good = rules.labelled_good(docs, labels)
        rows = rules.judge(docs, rules.corpus_ratios(marked, good)).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert tuple(r.rules[c] for c in FIGURES) == base_figures(r.text), r
            assert r.rules.kept == (not r.rules.base_failed and r.rules.mean_ratio >= rules.THRESHOLD)


def test_rules_reject_what_the_target_lacks(spark, given):
    """A text of signs goes, a plain one stays; ratios match a count by hand."""
    good = [(i, sentence(60, 40 * i), "en", "a") for i in range(40)]
    bad = [(100 + i, " ".join(w + "***" for w in sentence(60, 40 * i).split()), "en", "a") for i in range(10)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    ratios = rules.corpus_ratios(docs, F.col("doc_id") < 30, buckets=512)
    values = ratios.first().ratios
    assert len(values) == 512
    rows = rules.judge(docs, ratios, buckets=512).collect()
    kept = {r.doc_id for r in rows if r.rules.kept}
    assert kept == {i for i, *_ in good}


def test_rules_trust_every_good_label(spark):
    """However many labels there are, and however many ids are broadcast at once."""
    docs = spark.createDataFrame(
        [(i, sentence(30, 40 * i) + " !" * (i % 3)) for i in range(60)] + [(None, "no id here")],
        "doc_id long, text string",
    )
    # 30,000 good ids, 40 of them of documents; the greatest label of an id counts.
    labels = spark.range(20, 30_020).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    labels = labels.unionByName(spark.createDataFrame([(25, 0), (3, 0), (None, 1)], "doc_id long, quality int"))
    expected = rules.corpus_ratios(docs, F.col("doc_id") >= 20, buckets=512).first().ratios
    marked, good = rules.labelled_good(docs, labels)
    assert rules.corpus_ratios(marked, good, buckets=512).first().ratios == expected
    for block in (rules.BLOCK_IDS, 11_000):
        assert rules.trusted_ratios(docs, labels, buckets=512, block=block).first().ratios == expected


def test_rules_edges(edge, none, labels):
    marked, good = rules.labelled_good(none, labels)
    assert rules.judge(none, rules.corpus_ratios(marked, good)).count() == 0
    assert set(rules.corpus_ratios(marked, good, buckets=16).first().ratios) == {0.0}
    docs = clash(edge, "rules", "bucket", "_rule_one", "ratios")
    marked, good = rules.labelled_good(docs, labels)
    rows = rules.judge(docs, rules.corpus_ratios(marked, good)).collect()
    assert rows[0]["_rule_one"] == "own _rule_one" and len(rows) == edge.count()


def test_repeated_passages(given, edge):
    for docs in (given, edge):
        for with_text in (True, False):
            rows = substrings.remove_repeats(docs, with_text=with_text).collect()
            got = sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in rows)
            assert got == expected_cuts(docs.collect())
        for r in substrings.remove_repeats(docs).collect():
            assert sha(" ".join(w.decode() for w in (r.kept_text or "").encode().split())) == r.kept_sha256


def test_repeated_passage_edges(edge, none):
    assert substrings.remove_repeats(none).count() == 0
    docs = clash(edge, "N_Words", "slice", "a", "o_k", "s_k", "own0", "_sub_order", "_sub_one", "_sub_starts", "_sub_first", "_sub_copy")
    rows = substrings.remove_repeats(docs).collect()
    assert {r.a for r in rows} == {"own a"} and all(isinstance(r.n_words, int) for r in rows)


def test_repeated_passages_by_a_split_sketch(given, edge, none):
    """Sixteen parts of 2 ** 18 counters a row, owned by tasks, give the same rows."""
    for docs in (given, edge):
        cut = substrings.remove_repeats(docs, most_width=0, split_width=18)
        got = sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in cut.collect())
        assert got == expected_cuts(docs.collect())
    assert substrings.remove_repeats(none, most_width=0).count() == 0


def test_split_sketch_gives_few_false_alarms(given):
    import numpy as np
    import pyarrow as pa

    docs = given.filter("text IS NOT NULL").select("text", "doc_id", F.xxhash64("text").alias("one"))
    rows = docs.collect()
    bounds, _, anchors, inside = substrings._numbered(pa.array([r.text for r in rows]))
    row = np.searchsorted(bounds, np.arange(len(anchors)), "right") - 1
    holders = collections.defaultdict(set)
    for a, r, i in zip(anchors.view(np.int64).tolist(), row.tolist(), inside.tolist()):
        if i:
            holders[a].add((rows[r].doc_id, rows[r].one))
    true = {(*doc, a) for a, docs in holders.items() if len(docs) > 1 for doc in docs}
    # Three counters a row for an anchor; in production there are some seven.
    parts = -(-3 * len(holders) // (1 << 10))
    spread = docs.repartition(8)
    told = {tuple(r) for r in substrings.split_estimates(spread, "text", "doc_id", "one", parts, 10).collect()}
    assert parts > 1 and true and true <= told
    assert len(told - true) < 0.05 * sum(len(docs) for docs in holders.values())


def test_sketch_never_underestimates(given):
    import numpy as np
    import pyarrow as pa

    width = substrings.sketch_width(given, "text")
    bits = np.frombuffer(substrings.repeated_anchors(given, "text", width), np.uint8)
    texts = pa.array([r.text for r in given.select("text").collect()])
    bounds, _, anchors, inside = substrings._numbered(texts)
    row = np.searchsorted(bounds, np.arange(len(anchors)), "right") - 1
    seen = collections.defaultdict(set)
    for a, r, i in zip(anchors.tolist(), row.tolist(), inside.tolist()):
        if i:
            seen[a].add(r)
    repeated = np.array([a for a, rows in seen.items() if len(rows) > 1], np.uint64)
    assert len(repeated) and substrings._estimated(bits, repeated, width).all()
    single = np.array([a for a, rows in seen.items() if len(rows) == 1], np.uint64)
    assert substrings._estimated(bits, single, width).mean() < 0.05


