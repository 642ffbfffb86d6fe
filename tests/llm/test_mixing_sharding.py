from __future__ import annotations

import collections
import zlib

import pytest

from llm_helpers import clash, expected_targets, rows_by
from tidegrid.llm import mixing, sharding


def check_mix(rows, boundary):
    sizes = collections.Counter()
    taken = collections.Counter()
    largest = collections.Counter()
    for r in rows:
        assert r.mix.size == len((r.text or "").encode().split())
        sizes[r.source] += r.mix.size
        taken[r.source] += r.mix.taken
        largest[r.source] = max(largest[r.source], r.mix.size)
        assert 0 <= r.mix.taken <= 3 * r.mix.size
        if boundary == "whole":
            assert r.mix.taken == r.mix.copies * r.mix.size
    targets = expected_targets(sizes)
    for r in rows:
        assert r.mix.source_size == sizes[r.source]
        assert r.mix.target == pytest.approx(targets[r.source], abs=1e-6)
    for s, t in targets.items():
        slack = 1 if boundary == "cut" else largest[s] / 2 + 1
        assert abs(taken[s] - t) <= slack, (s, taken[s], t)


@pytest.mark.parametrize("boundary", ["cut", "whole"])
def test_mix(given, edge, boundary):
    for docs in (given, edge):
        rows = mixing.mix(docs, boundary=boundary).collect()
        assert len(rows) == docs.count()
        check_mix(rows, boundary)
        again = mixing.mix(docs.repartition(3), boundary=boundary).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mix_epochs_come_first(spark):
    """Every document of a source that is short of words is taken as often as all the others, or once more."""
    docs = spark.createDataFrame(
        [(i, "w " * 10, "a") for i in range(20)] + [(100 + i, "w " * 10, "b") for i in range(80)],
        "doc_id long, text string, source string",
    )
    rows = mixing.mix(docs).collect()
    copies = {r.mix.copies for r in rows if r.source == "a"}
    assert copies == {3}
    assert {r.mix.copies for r in rows if r.source == "b"} <= {0, 1}


def test_mix_prefers_quality(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(
        [(i, "w " * 5, "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string"
    )
    good = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)
    rows = mixing.mix(docs, weights=(1.0, 3.0), quality=good).collect()
    taken = collections.Counter(r.doc_id % 2 for r in rows if r.source == "a" and r.mix.taken)
    assert taken[0] / 1000 > 2 * taken[1] / 2000  # of 1000 even and 2000 odd ids


def test_mix_edges(none, edge):
    assert mixing.mix(none).count() == 0
    assert mixing.repeat_taken(mixing.mix(none)).count() == 0
    rows = mixing.mix(clash(edge, "mix", "size", "target", *[f"_mix_{c}" for c in mixing.OWN])).collect()
    assert rows[0]["size"] == "own size" and rows[0]["_mix_size"] == "own _mix_size"
    check_mix(rows, "cut")
    with pytest.raises(ValueError):
        mixing.mix(edge, boundary="other")


def test_repeat_taken(given):
    mixed = mixing.mix(given)
    sums = collections.Counter()
    for r in mixed.collect():
        sums[r.doc_id] += r.mix.taken
    repeated = mixing.repeat_taken(mixed)
    assert repeated.columns == given.columns
    words = collections.Counter()
    for r in repeated.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert +words == +sums


def check_shards(rows, docs, shards):
    assert len(rows) == docs.count()
    slots = collections.defaultdict(list)
    for r in rows:
        data = (r.text or "").encode()
        assert (r.placed.size, r.placed.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.placed.position == r.placed.slot * shards + r.placed.shard
        slots[r.placed.shard].append(r.placed.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(given, edge, shards):
    for docs in (given, edge):
        rows = sharding.shard_rows(docs, shards).collect()
        check_shards(rows, docs, shards)
        again = sharding.shard_rows(docs.repartition(5), shards).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 50, 97, 1000):
        df = sharding.permute(spark.range(n).withColumnRenamed("id", "x"), "x", n, 5, "y")
        assert sorted(r.y for r in df.collect()) == list(range(n))
    far = sharding.permute(spark.range(1000).withColumnRenamed("id", "x"), "x", 1000, 5, "y").orderBy("x")
    moved = [r.y for r in far.collect()]
    assert sum(abs(a - b) == 1 for a, b in zip(moved, moved[1:])) < 20


def test_shard_edges(none, edge):
    assert sharding.shard_rows(none).count() == 0
    docs = clash(edge, "placed", "row", "shard", *[f"_shard_{c}" for c in sharding.OWN])
    rows = sharding.shard_rows(docs).collect()
    assert rows_by(rows, "shard") == {"own shard"}
    check_shards(rows, docs, 16)
    with pytest.raises(ValueError):
        sharding.shard_rows(edge, 0)
