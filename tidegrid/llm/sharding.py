"""Sharding by a Feistel permutation of global row numbers.

Rows get numbers 0 .. n-1 in an order that only their contents decide; a keyed
permutation of these numbers is the shuffle. Position p lies in shard p mod k at
slot p div k, so a row's place can be computed from its number and found from its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import free_name, settle, utf8, with_struct

ROUNDS = 8
TRIED = 65_536

# Buckets number their rows in one task each; their counts are broadcast, two numbers a bucket.
LEAST_BUCKETS, ROWS_PER_BUCKET = 1024, 200_000
# What is worked out beside a row's own columns.
OWN = ("bucket", "crc", "size", "row", "at", "ahead")


def sides(rows: int) -> tuple[int, int]:
    """Two near-equal sides of a rectangle that holds ``rows`` cells and very few more.

    Of ``TRIED`` lengths from the square root on, that which leaves the fewest cells spare.
    """
    root = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    a = min(range(root, root + min(TRIED, root)), key=lambda side: side * -(-rows // side) - rows)
    return a, max(1, -(-rows // a))


def _rounds(number: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over a number below a * b: halves modulo a and modulo b."""
    start = F.struct(F.floor(number / F.lit(b)).cast("long").alias("l"), (number % b).alias("r"))

    def step(state: Column, i: Column) -> Column:
        left = F.pmod(state["l"] + F.pmod(F.xxhash64(F.lit(seed), i, state["r"]), F.lit(a)), F.lit(a))
        right = F.pmod(state["r"] + F.pmod(F.xxhash64(F.lit(seed), i, state["l"]), F.lit(b)), F.lit(b))
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, state["l"]).otherwise(left).cast("long").alias("l"),
            F.when(odd, right).otherwise(state["r"]).cast("long").alias("r"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"]
    )


def permute(df: DataFrame, number: str, rows: int, seed: int, out: str) -> DataFrame:
    """Adds ``out``, a permutation of ``number`` (0 .. rows-1).

    The network permutes a rectangle slightly larger than ``rows``; numbers that leave
    the range walk their cycle until they are back, at most as many steps as the
    rectangle has spare cells, so the walk is complete and at most that many rows take it.
    """
    a, b = sides(rows)
    once = df.withColumn(out, _rounds(F.col(number), a, b, seed))
    spare = a * b - rows
    if spare <= 0:
        return once
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(spare)),
        F.col(out),
        lambda x, _: F.when(x < rows, x).otherwise(_rounds(x, a, b, seed)),
    )
    return once.withColumn(out, F.when(F.col(out) < rows, F.col(out)).otherwise(walked))


def shard_rows(
    docs: DataFrame,
    shards: int = 16,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 30,
    buckets: int | None = None,
    out: str = "placed",
) -> DataFrame:
    """Every row with a struct ``out``: size, text_crc32, row, position, shard, slot.

    Sizes are UTF-8 bytes plus 1. Row counts of shards differ by at most one and slots run
    from 0 without gaps. Row numbers are given per hash bucket of (id, text): bucket counts
    (1,024 buckets, or one for every ``ROWS_PER_BUCKET`` rows if these are more) are summed first, then each bucket numbers its own rows, so there is no global sort.

    A null text has no bytes (size 1, crc32 0); null ids come first in their bucket. Rows
    equal in id and text get different numbers, in any order. An empty table gives an empty
    table; an existing column ``out`` is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if buckets is None:
        buckets = max(LEAST_BUCKETS, docs.count() // ROWS_PER_BUCKET)
    names = {c: free_name(docs, f"_shard_{c}") for c in OWN}
    bucket, crc, size = (F.col(names[c]) for c in ("bucket", "crc", "size"))
    keyed = (
        docs.withColumn(names["crc"], F.crc32(utf8(text_col)))
        .withColumn(names["size"], (F.octet_length(utf8(text_col)) + 1).cast("long"))
        .withColumn(
            names["bucket"],
            F.pmod(F.xxhash64(F.col(id_col).cast("string"), crc, size), F.lit(buckets)).cast("int"),
        )
    )
    counts = settle(keyed.groupBy(bucket.alias("b")).count(), "shard-buckets")
    rows = counts.agg(F.sum("count")).first()[0] or 0
    earlier = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select(
        F.col("b").alias(names["bucket"]),
        F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(names["ahead"]),
    )
    inside = W.partitionBy(bucket).orderBy(F.col(id_col), crc, size)
    # At most ``buckets`` rows of two numbers.
    numbered = keyed.join(F.broadcast(offsets), names["bucket"]).withColumn(
        names["row"], (F.col(names["ahead"]) + F.row_number().over(inside) - 1).cast("long")
    )
    placed = permute(numbered, names["row"], rows, seed, names["at"])
    at = F.col(names["at"])
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    return with_struct(
        placed,
        out,
        size=size,
        text_crc32=crc,
        row=F.col(names["row"]),
        position=at,
        shard=(at % shards).cast("int"),
        slot=F.floor(at / F.lit(shards)).cast("long"),
    ).select(*[F.col(f"`{c}`") for c in kept], out)
