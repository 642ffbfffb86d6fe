"""Exact quantiles per group, also for groups far bigger than one task.

Small groups use Spark's ``percentile``. It keeps every distinct value of a
group in one place, so for a big group the value range is narrowed instead:
count values per equal-width range (a hash aggregate combined map-side, at most
``BINS`` rows per wanted rank), keep the range holding the rank, repeat. Each
range remembers the smallest and largest value seen, so the search ends when
they meet. No step gathers a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.keys import broadcast_if_small, needs_slices, null_safe_join
from tidegrid.session import cut_lineage

BINS = 4096


def _melt(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(*group, F.explode(entries).alias("_e"))
        .select(*group, "_e.column", "_e.value")
        .filter(F.col("value").isNotNull())
    )


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    split: bool | None = None,
    bins: int = BINS,
) -> DataFrame:
    """Rows ``(group…, column, quantiles)``: linear interpolation between ranks.

    Columns without any value in a group give no row.
    """
    if needs_slices(df, group, split):
        # Every pass reads the values again: compute them once.
        kept = cut_lineage(df.select(*group, *columns), "values")
        return _by_narrowing(_melt(kept, group, columns), [*group, "column"], list(probs), bins)
    wide = df.groupBy(*group).agg(
        *[F.percentile(F.col(c).cast("double"), list(probs)).alias(f"_q{i}") for i, c in enumerate(columns)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("quantiles"))
            for i, c in enumerate(columns)
        ]
    )
    return (
        wide.select(*group, F.explode(entries).alias("_e"))
        .select(*group, "_e.column", "_e.quantiles")
        .filter(F.col("quantiles").isNotNull())
    )


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of an equal-width range; never decreasing in ``value``. Halves avoid overflow."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.floor(share * bins).cast("int")).otherwise(F.lit(0))


def _by_narrowing(values: DataFrame, part: list[str], probs: list[float], bins: int) -> DataFrame:
    # Infinite values lie at the ends whatever the range; the search is among the finite ones.
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    bounds = values.groupBy(*part).agg(
        F.min(finite).alias("low"),
        F.max(finite).alias("high"),
        F.count("value").alias("n"),
        F.count_if(F.col("value") == float("-inf")).alias("below"),
        F.count_if(F.col("value") == float("inf")).alias("above"),
    )
    # The two ranks around each quantile, counted from 0.
    exact_rank = F.lit(None)
    wanted = []
    for p in probs:
        exact_rank = (F.col("n") - 1) * F.lit(float(p))
        wanted += [F.floor(exact_rank).cast("long"), F.ceil(exact_rank).cast("long")]
    search = cut_lineage(
        bounds.select(
            *part,
            "n",
            "low",
            "high",
            "below",
            "above",
            F.explode(F.array_distinct(F.array(*wanted))).alias("rank"),
        ),
        "ranks",
    )
    low_end, high_end = F.col("rank") < F.col("below"), F.col("rank") >= F.col("n") - F.col("above")
    at_end = (
        F.when(low_end, F.lit(float("-inf"))).when(high_end, F.lit(float("inf"))).otherwise(F.col("low"))
    )
    found = search.filter(low_end | high_end | F.expr("low = high")).select(
        *part, "n", "rank", at_end.alias("value")
    )
    opened = search.filter(~low_end & ~high_end & F.expr("low < high")).drop("above")
    pieces = [found]
    while not opened.isEmpty():
        ranges = opened.select(*part, "low", "high", "below", "n").distinct()
        hits = null_safe_join(values, broadcast_if_small(ranges), part).filter(
            F.col("value").between(F.col("low"), F.col("high"))
        )
        histogram = (
            hits.withColumn("_bin", _bin_of(F.col("value"), F.col("low"), F.col("high"), bins))
            .groupBy(*part, "low", "high", "below", "n", "_bin")
            .agg(
                F.count(F.lit(1)).alias("_in"),
                F.min("value").alias("_low"),
                F.max("value").alias("_high"),
            )
        )
        run = Window.partitionBy(*part, "low", "high").orderBy("_bin").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        placed = histogram.withColumn("_upto", F.col("below") + F.sum("_in").over(run))
        narrowed = (
            null_safe_join(
                placed, opened.select(*part, "low", "high", "rank"), [*part, "low", "high"]
            )
            .filter(
                (F.col("rank") < F.col("_upto"))
                & (F.col("rank") >= F.col("_upto") - F.col("_in"))
            )
            .select(
                *part,
                "n",
                F.col("_low").alias("low"),
                F.col("_high").alias("high"),
                (F.col("_upto") - F.col("_in")).alias("below"),
                "rank",
            )
        )
        narrowed = cut_lineage(narrowed, "ranks")
        pieces.append(
            narrowed.filter("low = high").select(*part, "n", "rank", F.col("low").alias("value"))
        )
        opened = narrowed.filter("low < high")
    found = pieces[0]
    for piece in pieces[1:]:
        found = found.unionByName(piece)
    at_rank = found.groupBy(*part, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")
    )

    def quantile(p: float) -> Column:
        rank = (F.col("n") - 1) * F.lit(float(p))
        low = F.element_at("_at", F.floor(rank).cast("long"))
        high = F.element_at("_at", F.ceil(rank).cast("long"))
        return F.when(low == high, low).otherwise(
            low * (F.ceil(rank) - rank) + high * (rank - F.floor(rank))
        )

    return at_rank.select(*part, F.array(*[quantile(p) for p in probs]).alias("quantiles"))
