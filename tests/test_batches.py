import pytest
from helpers import assert_close, frame, rows, to_pandas

from tidegrid.sinks import batches
from tidegrid.streaming import live


def small(spark, *values):
    return frame(spark, rows([(s, v, 1.0) for s, v in values]))


def shown(spark, path, prefer="existing"):
    return list(to_pandas(batches.read_batches(spark, path, prefer=prefer)).m0)


def test_batches_merge_on_read_and_compact(spark, tmp_path):
    path = str(tmp_path / "table")
    assert batches.read_batches(spark, path) is None and not batches.compact(spark, path)
    assert batches.append_batch(small(spark, (0, 1), (1, 2)), path, "a", 0, {"newest": "5"})
    assert batches.append_batch(small(spark, (1, 20), (2, 3)), path, "b", 0, {"newest": "4"})
    assert not batches.append_batch(small(spark, (9, 9)), path, "a", 0)  # sent again
    assert shown(spark, path) == [1, 2, 3] and shown(spark, path, "new") == [1, 20, 3]
    files = {p.name for p in (tmp_path / "table" / "batches").iterdir()}
    assert batches.compact(spark, path) and not batches.compact(spark, path)
    # Readers of the state before still find its files.
    assert {p.name for p in (tmp_path / "table" / "batches").iterdir()} == files
    assert not batches.append_batch(small(spark, (9, 9)), path, "b", 0)  # folded by now
    assert batches.append_batch(small(spark, (0, 10), (3, 4)), path, "b", 1)
    assert shown(spark, path) == [1, 2, 3, 4]
    assert max(int(f["newest"]) for f in batches.batch_facts(spark, path) if "newest" in f) == 5
    assert batches.compact(spark, path)
    assert files.isdisjoint(p.name for p in (tmp_path / "table" / "batches").iterdir())
    assert shown(spark, path) == [1, 2, 3, 4]
    assert batches.read_all(spark, path).count() == 4
    with pytest.raises(ValueError, match="prefer"):
        batches.read_batches(spark, path, prefer="other")


def test_a_batch_counts_once_committed(spark, tmp_path):
    """What broke off before its commit is not read, and is written over."""
    path = str(tmp_path / "table")
    batches.append_batch(small(spark, (0, 1)), path, "a", 0)
    small(spark, (5, 5)).write.parquet(f"{path}/batches/a-{1:012d}")
    assert shown(spark, path) == [1]
    assert batches.append_batch(small(spark, (6, 6)), path, "a", 1)
    assert shown(spark, path) == [1, 6]


def test_a_failing_batch_leaves_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "table")
    batches.append_batch(small(spark, (0, 1)), path, "a", 0)
    broken = small(spark, (5, 5)).withColumn("m0", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        batches.append_batch(broken, path, "a", 1)
    assert shown(spark, path) == [1]
    assert batches.append_batch(small(spark, (1, 2)), path, "a", 1) and shown(spark, path) == [1, 2]


def test_micro_batches_write_only_their_rows(spark, tmp_path):
    path, log, source = (str(tmp_path / n) for n in ("table", "log", "source"))
    for i in range(5):
        df = small(spark, (0, 10 + i), (i, i))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        live.stream_upsert(stream, path, log, compact_every=3).awaitTermination()
    assert shown(spark, path) == [10, 1, 2, 3, 4]
    kept = [spark.read.parquet(str(f)).count() for f in (tmp_path / "table" / "batches").iterdir()]
    assert kept and max(kept) == 2
    assert_close(to_pandas(live.read_upserts(spark, path)).m1, [1.0] * 5)


def test_windows_divide_a_day():
    assert live.bucket_label("15min") == "900000000 microseconds"
    with pytest.raises(ValueError, match="divide"):
        live.bucket_label("7min")
    assert live.lateness_micros("2 hours") == live.lateness_micros("120min") == 7_200_000_000
