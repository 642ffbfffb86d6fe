"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key divided by its quality weight
(Efraimidis and Spirakis); within a source documents come in order of their keys.
A source that must give more words than it has first gives complete epochs, then
the documents at the head of that order until the rest of its budget is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import SPACE, WORD, free_name, settle, tag, with_struct

# Quality weights are held within these bounds, which keeps key buckets even.
LEAST_WEIGHT, MOST_WEIGHT = 0.25, 1.0

# Buckets of a source: each is ordered in one task.
LEAST_BUCKETS, ROWS_PER_BUCKET = 512, 200_000
# What is worked out beside a row's own columns.
OWN = ("size", "group", "key", "bucket", "before", "ahead", "source_size", "target")


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cleanliness(text: Column) -> Column:
    """Default quality weight: the share of characters that are no symbols."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    return 1.0 - symbols / F.greatest(F.length(text), F.lit(1))


def source_targets(sources: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """Adds ``target`` to a table of one row per source (``source``, ``source_size``).

    Weights repeat over the sources by code point, null last. All sources share the
    total size by weight, none above ``limit`` times its own size: the level at which
    sources fill up is found by ordering them by ``limit * size / weight``.
    """
    whole = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn(
        "weight", F.get(cycle, ((F.row_number().over(whole) - 1) % len(weights)))
    ).withColumn("cap", F.col("source_size") * limit)
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    done, open_ = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (
        F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(done), F.lit(0.0))
    ) / F.sum("weight").over(open_)
    levels = ranked.withColumn("level", level)
    # Full sources head the order; the first that is not full sets the level for the rest.
    unfilled = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("_at", "level"))
    levels = levels.withColumn("_at", F.row_number().over(fill))
    common = F.min(unfilled).over(every)["level"]
    return levels.withColumn(
        "target", F.coalesce(F.least(F.col("cap"), common * F.col("weight")), F.col("cap"))
    ).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    limit: float = 3.0,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    boundary: str = "cut",
    seed: int = 20,
    buckets: int | None = None,
    out: str = "mix",
) -> DataFrame:
    """Every row of ``docs`` with a struct ``out``: size, source_size, target, copies, taken.

    ``copies`` is how often the mix holds the document, ``taken`` how many of its words.
    With ``boundary="cut"`` the last document of a budget gives only the words that still
    fit, so a source's words equal its target rounded; with ``"whole"`` that document is
    taken if this brings the sum nearer to the target, and every copy is complete.

    Within a source documents are put into ``buckets`` by key (512, or one for every
    ``ROWS_PER_BUCKET`` rows of ``docs`` if these are more); only bucket sums are
    ordered as a whole, and each bucket's documents among themselves, so no task holds
    a source. The bucket bounds are quantiles of exponentials, so that buckets are even
    for any weights within 0.25 and 1; other ``quality`` values are clamped to these.

    Null texts, and texts without words, have size 0 and take nothing. A null source is a
    source of its own, last in order. Rows equal in id and text are interchangeable. An
    empty table gives an empty table; an existing column ``out`` is replaced.
    """
    if boundary not in ("cut", "whole"):
        raise ValueError(f"boundary must be 'cut' or 'whole', not {boundary!r}")
    if buckets is None:
        buckets = max(LEAST_BUCKETS, docs.count() // ROWS_PER_BUCKET)
    text = F.col(text_col)
    weight = quality if quality is not None else cleanliness(text)
    weight = F.least(F.greatest(F.coalesce(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text), 11)
    key = -F.log((drawn + 0.5) / float(2**53)) / weight
    fields = {c: free_name(docs, f"_mix_{c}") for c in OWN}
    size, group, at, bucket = (F.col(fields[c]) for c in ("size", "group", "key", "bucket"))
    share = 1.0 - (F.exp(-at) + F.exp(-at / 2) + F.exp(-at / 4)) / 3
    keyed = (
        docs.withColumn(fields["size"], word_count(text))
        .withColumn(fields["group"], tag(source_col))
        .withColumn(fields["key"], key)
        .withColumn(
            fields["bucket"], F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        )
    )
    sums = settle(
        keyed.groupBy(group.alias("g"), bucket.alias("b")).agg(F.sum(size).alias("bucket_size")),
        "mix-buckets",
    )
    source = F.when(F.col("g") != "n", F.expr("substring(g, 2)"))
    sources = source_targets(
        sums.groupBy("g").agg(F.sum("bucket_size").alias("source_size")).select(
            source.alias("source"), "source_size"
        ),
        weights,
        limit,
    ).select(tag("source").alias("g"), "source_size", "target")
    earlier = W.partitionBy("g").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    plan = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(
        sources, "g"
    )
    plan = plan.select(
        F.col("g").alias(fields["group"]),
        F.col("b").alias(fields["bucket"]),
        *[F.col(c).alias(fields[c]) for c in ("ahead", "source_size", "target")],
    )
    ahead, source_size, target = (F.col(fields[c]) for c in ("ahead", "source_size", "target"))
    order = W.partitionBy(group, bucket).orderBy(at, F.col(id_col).cast("string"), size)
    before = ahead + F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)) - size
    placed = keyed.join(plan, [fields["group"], fields["bucket"]]).withColumn(fields["before"], before)
    epochs = F.when(source_size > 0, F.floor(target / source_size)).otherwise(F.lit(0)).cast("long")
    rest = F.round(target - epochs * source_size).cast("long")
    if boundary == "cut":
        part = F.least(size, F.greatest(F.lit(0), rest - F.col(fields["before"])))
        copies = epochs + F.when(part > 0, F.lit(1)).otherwise(F.lit(0))
    else:
        chosen = (size > 0) & (F.col(fields["before"]) + size / 2 <= rest)
        part = F.when(chosen, size).otherwise(F.lit(0))
        copies = epochs + chosen.cast("long")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    return with_struct(
        placed,
        out,
        size=size,
        source_size=source_size,
        target=target,
        copies=F.when(size > 0, copies).otherwise(F.lit(0)).cast("long"),
        taken=(epochs * size + part).cast("long"),
    ).select(*[F.col(f"`{c}`") for c in kept], out)


def repeat_taken(mixed: DataFrame, out: str = "mix", text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as it was taken, its struct dropped.

    The last copy of a document that was cut keeps its first words, joined by one space.
    """
    size, taken, copies = (F.col(f"{out}.{c}") for c in ("size", "taken", "copies"))
    repeats = free_name(mixed, "_mix_copy")
    rows = mixed.filter(copies > 0).withColumn(
        repeats, F.explode(F.sequence(F.lit(1).cast("long"), copies))
    )
    last = (F.col(repeats) == copies) & (taken < copies * size)
    words = F.filter(F.split(F.col(text_col), SPACE), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), (taken - (copies - 1) * size).cast("int")), " ")
    columns = [c for c in mixed.columns if c not in (out, repeats)]
    return rows.withColumn(text_col, F.when(last, cut).otherwise(F.col(text_col))).select(
        *[F.col(f"`{c}`") for c in columns]
    )
