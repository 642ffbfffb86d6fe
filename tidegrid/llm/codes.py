"""Compression of vectors to codes by product quantization over integer components.

Vectors are kept in blocks. A block has a dictionary of the distinct integers of each
dimension, and its vectors as codes into these dictionaries. To find nearest entries, the
squared differences of all dictionary values to all entries are tabulated once a block;
the distance of a part is a gather from these tables by code and a sum over dimensions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.keys import null_safe_join
from tidegrid.llm.common import settle

SCALE = 256
# Vectors of a block: a code then fits 16 bits, and a block's distances 4 MB.
BLOCK = 8_192
# A label with more than this part of all rows is hot: there are fewer than so many of them.
HOT = 1_000


class Codebooks(NamedTuple):
    """The entries of each part, as integers, and where parts begin in a vector."""

    parts: list[np.ndarray]  # per part: entries x width
    starts: list[int]

    def text(self) -> str:
        return ",".join(str(int(x)) for part in self.parts for x in part.reshape(-1))

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def most(width: int) -> int:
    """Integers are held within plus and minus this, so that a vector's error fits a long."""
    return math.isqrt(2**62 // max(1, width)) // 2


def _integers(values: np.ndarray) -> np.ndarray:
    bound = most(values.shape[1])
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


def _usable(vector: str) -> Column:
    """Whether a vector is there, with finite components only."""
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0)


def _blocks(kept: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors: ids, labels, the values of each dimension, and codes by dimension."""
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)),
            T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)),
            T.StructField("values", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("codes", T.BinaryType()),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(begin, BLOCK)
                flat = piece.column("vector").flatten().to_numpy(zero_copy_only=False)
                numbers = _integers(flat.reshape(piece.num_rows, width))
                values, codes = [], np.empty((width, piece.num_rows), "<u2")
                for d in range(width):
                    distinct, codes[d] = np.unique(numbers[:, d], return_inverse=True)
                    values.append(distinct)
                ends = pa.array([0, piece.num_rows], pa.int32())
                inner = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()),
                    pa.array(np.concatenate(values)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(ends, piece.column("id")),
                        pa.ListArray.from_arrays(ends, piece.column("label")),
                        pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), inner),
                        pa.array([codes.tobytes()], pa.binary()),
                    ],
                    ["ids", "labels", "values", "codes"],
                )

    return kept.mapInArrow(build, schema)


def _nearest(values: list, codes: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """For each part (rows) and vector (columns): the nearest entry, and its squared distance."""
    n = codes.shape[1]
    best = np.empty((len(books.parts), n), np.int64)
    distance = np.empty_like(best)
    for p, (entries, start) in enumerate(zip(books.parts, books.starts)):
        total = np.zeros((n, len(entries)), np.int64)
        for j in range(entries.shape[1]):
            table = (np.asarray(values[start + j])[:, None] - entries[None, :, j]) ** 2
            total += table[codes[start + j]]
        best[p] = total.argmin(axis=1)  # the first of equal ones
        distance[p] = total[np.arange(n), best[p]]
    return best, distance


def _read(batch: pa.RecordBatch, i: int) -> tuple[list, np.ndarray]:
    values = [v.values.to_numpy() for v in batch.column("values")[i]]
    codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u2").reshape(len(values), -1)
    return values, codes


def _moved(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floored mean of the parts nearest to it; entries without any stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in books.parts]
        for batch in batches:
            for i in range(batch.num_rows):
                values, codes = _read(batch, i)
                best, _ = _nearest(values, codes, books)
                for p, start in enumerate(books.starts):
                    for j in range(totals[p].shape[1] - 1):
                        np.add.at(totals[p][:, j], best[p], values[start + j][codes[start + j]])
                    totals[p][:, -1] += np.bincount(best[p], minlength=len(totals[p]))
        for p, total in enumerate(totals):
            part, entry, at = (x.reshape(-1) for x in np.indices((1, *total.shape)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part + p, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()),
                 pa.array(total.reshape(-1))],
                ["part", "entry", "at", "total"],
            )

    parts = blocks.select("values", "codes").mapInArrow(sums, "part int, entry int, at int, total long")
    # As many rows as the codebooks have numbers, and one more for each entry.
    found = parts.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()
    totals = {(r.part, r.entry, r.at): r.total for r in found}
    moved = []
    for p, entries in enumerate(books.parts):
        new = entries.copy()
        for e in range(len(entries)):
            n = totals.get((p, e, entries.shape[1]), 0)
            if n:
                new[e] = [totals[p, e, j] // n for j in range(entries.shape[1])]
        moved.append(new)
    return Codebooks(moved, books.starts)


def compress(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
) -> tuple[DataFrame, Codebooks]:
    """The codes of all usable vectors (id, label, code, error, label_error), and the codebooks.

    Components become ``floor(256 x)``, vectors are cut into ``parts`` consecutive parts,
    equal ones where the width allows. A part's codebook starts as that part of the
    ``entries`` vectors of smallest id; each round moves entries to the floored mean of
    their parts. ``code`` has two hex digits a part; ``error`` sums the squared distances.
    ``label_error`` sums the errors of equal labels, nulls being equal.

    Rows without a vector, or with a null or infinite component or a NaN, are left out, and
    so are empty vectors and those of another width than the most frequent one (the greater
    of equally frequent ones): codebooks have one width. Integers beyond ``most(width)``
    (2 ** 27 for 64 components) are held there. Of equal ids the lesser vector comes first,
    null ids come last; repeated rows count as often as they occur. An empty table gives an
    empty table and no entries. Other columns are not kept.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    usable = vectors.filter(_usable(f"`{vector_col}`")).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector")
    )
    widths = usable.groupBy(F.size("vector").alias("width")).count()
    common = widths.orderBy(F.desc("count"), F.desc("width")).first()
    width = common.width if common else 0
    kept = usable.filter(F.size("vector") == width)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    bounds = [width * p // parts for p in range(parts + 1)]
    first = _integers(np.array([r.vector for r in seeds], np.float64).reshape(len(seeds), width))
    books = Codebooks([first[:, a:b] for a, b in zip(bounds, bounds[1:])], bounds[:-1])
    result = T.StructType(
        [
            T.StructField(id_col, kept.schema["id"].dataType),
            T.StructField("label_key", kept.schema["label"].dataType),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )
    if not seeds:
        empty = vectors.sparkSession.createDataFrame([], result).withColumnRenamed("label_key", label_col)
        return empty.withColumn("label_error", F.lit(None).cast("long")), books
    blocks = settle(_blocks(kept, width), "vector-blocks")
    for _ in range(rounds):
        books = _moved(blocks, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                best, distance = _nearest(*_read(batch, i), books)
                digits = best.T.astype(np.uint8).tobytes().hex()
                step = 2 * len(books.parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[i].values,
                        batch.column("labels")[i].values,
                        pa.array([digits[k : k + step] for k in range(0, len(digits), step)], pa.string()),
                        pa.array(distance.sum(axis=0)),
                    ],
                    result.names,
                )

    coded = settle(blocks.mapInArrow(encode, result), "vector-codes")
    return _with_label_error(coded).withColumnRenamed("label_key", label_col), books


def _with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error`` beside every row; hot labels by a broadcast of fewer than ``HOT`` rows, the others joined."""
    sums = settle(
        coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("label_rows")),
        "vector-labels",
    )
    rows = sums.agg(F.sum("label_rows")).first()[0] or 0
    hot = F.col("label_rows") * HOT > rows
    common = sums.filter(hot).withColumn("found", F.lit(True)).drop("label_rows")
    near = null_safe_join(coded, F.broadcast(common), ["label_key"], "left")
    columns = [*coded.columns, "label_error"]
    rest = null_safe_join(near.filter("found IS NULL").select(*coded.columns), sums.filter(~hot), ["label_key"])
    return near.filter("found").select(*columns).union(rest.select(*columns))
