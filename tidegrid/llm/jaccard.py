"""A join of documents on the Jaccard similarity of their word n-grams.

Texts with equal n-gram sets form one class. Class representatives meet in MinHash bands;
pairs that meet are compared hash by hash, and a pair is dropped as soon as the posterior
probability of reaching the threshold falls below a tolerance. The rest are verified
exactly. A pair belongs to the first band in which it meets, so it is seen once.

Pairs live only inside a task, where they are counted; tables hold documents, classes and
one link per document and bucket. Large buckets are split into blocks, and every pair of
blocks is a task's share of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm import hashing
from tidegrid.llm.common import free_name, settle
from tidegrid.llm.components import components

WORDS, THRESHOLD = 5, 0.8
# 32 bands of 5: a pair at similarity 0.8 meets in none with probability 3e-6.
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
STEP = 32  # hashes compared before each look at the posterior
TOLERANCE = 1e-6
BLOCK = 512  # classes of a bucket in one block
PAIRS = 200_000  # pairs compared at once
LAST = (1 << 63) - 1  # a null id comes after all others

_RANDOM = np.random.default_rng(50)
_TIMES = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n hashes, how many must agree for the pair to stay: P(similarity >= threshold) >= tolerance.

    The posterior is that of a uniform prior, Beta(agreed + 1, n - agreed + 1).
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    above = x >= threshold
    least = {}
    for n in range(STEP, HASHES + 1, STEP):
        for agreed in range(n + 1):
            log = agreed * np.log(x) + (n - agreed) * np.log1p(-x)
            weight = np.exp(log - log.max())
            if weight[above].sum() / weight.sum() >= tolerance:
                least[n] = agreed
                break
    return least


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and their bounds.

    A text of fewer than ``n`` words has one n-gram of all its words; one without words none.
    """
    bounds, words = hashing.split_words(texts)
    hashes = hashing.word_hashes(words)[0]
    grams = hashing.windows(hashes, n)
    sets = []
    for begin, end in zip(bounds[:-1], bounds[1:]):
        if end - begin >= n:
            sets.append(np.unique(grams[begin : end - n + 1]))
        elif end > begin:
            sets.append(hashing.windows(hashes[begin:end], int(end - begin)))
        else:
            sets.append(hashes[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)])


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each hash function; rows of sets without n-grams are 0."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    if len(full) == 0:
        return out
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    for k in range(HASHES):
        value = x * _TIMES[k] + _PLUS[k]
        value ^= value >> np.uint32(15)
        out[full, k] = np.minimum.reduceat(value, bounds[full]).astype(np.uint16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key per band, different bands having different keys."""
    parts = sig.reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(BAND_ROWS):
        key = hashing.mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def set_names(grams: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """16 bytes that name an n-gram set; none for a set without n-grams."""
    sums = []
    for salt in (1, 2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mixed(grams + np.uint64(salt)))])
        sums.append(total[bounds[1:]] - total[bounds[:-1]])
    names = np.ascontiguousarray(np.stack(sums, 1).astype(">u8"))
    return [names[i].tobytes() if bounds[i + 1] > bounds[i] else None for i in range(len(names))]


class Tiles:
    """Consecutive rows of one tile each, with the pairs that belong to it."""

    def __init__(self, least: dict[int, int]):
        self.least = least

    def pairs(self, sig: np.ndarray, block: np.ndarray, tile: tuple[int, int], band: int):
        """Pairs of rows that the posterior keeps and that meet in no earlier band."""
        left, right = (np.flatnonzero(block == t) for t in tile)
        chunk = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), chunk):
            a = np.repeat(left[at : at + chunk], len(right))
            b = np.tile(right, len(left[at : at + chunk]))
            if tile[0] == tile[1]:
                a, b = a[a < b], b[a < b]
            agreed = np.zeros(len(a), np.int32)
            for n in range(STEP, HASHES + 1, STEP):
                agreed += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(1, dtype=np.int32)
                keep = agreed >= self.least[n]
                a, b, agreed = a[keep], b[keep], agreed[keep]
                if len(a) == 0:
                    break
            if len(a):
                same = (sig[a, : band * BAND_ROWS] == sig[b, : band * BAND_ROWS]).reshape(len(a), band, BAND_ROWS)
                first = ~same.all(2).any(1)
                if first.any():
                    yield a[first], b[first]


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of these pairs of sets, exactly."""
    if len(a) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)])
    # Many pairs of few sets: a matrix product over the n-grams that occur more than once.
    grams, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    row, column = row[keep], number[code[keep]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    for begin in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (begin, begin + width))
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - begin] = 1
        total += dense @ dense.T
    return total[a, b].astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows of one tile at a time, from batches in which tiles are consecutive."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _bytes_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


TILE = ["key", "i", "j"]


def link_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, text_hash, group_id, group_hash, n_links and n_copies.

    Two documents are linked if the Jaccard similarity of their sets of distinct five-word
    n-grams is at least ``threshold``. ``n_links`` is the number of other documents linked to
    this one, ``n_copies`` that of documents with the same n-gram set, itself included, and
    ``group_id`` the least id of its connected component. ``text_hash`` (xxhash64 of the
    text) tells rows of one id apart; ``group_hash`` is that of the group's least row.

    A pair is lost with probability below 1e-5 at the threshold (bands and posterior), less
    above it; pairs below the threshold are never linked. Null and empty texts link to
    nothing and are groups of their own, ids null or not; null ids count as the greatest.
    Repeated rows are copies of each other. An empty table gives an empty table. Other
    columns are left out.
    """
    least = least_matches(threshold, tolerance)
    given = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("o"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("h"),
        F.monotonically_increasing_id().alias("r"),
        F.col(text_col).cast("string").alias("t"),
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, 3):
                grams, bounds = shingle_sets(piece.column(3))
                sig = signatures(grams, bounds)
                keys = band_keys(sig)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), hashing.signed(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        piece.column(1),
                        piece.column(2),
                        pa.array(set_names(grams, bounds), pa.binary()),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        lists,
                    ],
                    ["o", "h", "r", "node", "size", "sig", "bands"],
                )

    signed = settle(
        given.mapInArrow(sign, "o long, h long, r long, node binary, size int, sig binary, bands array<long>"),
        "jaccard-signed",
    )
    some = signed.filter("node IS NOT NULL")
    classes = settle(
        some.groupBy("node").agg(
            F.min(F.struct("o", "h", "r")).alias("first"), F.count("*").alias("copies")
        ).select(
            F.col("node").alias("node_k"),
            "copies",
            F.struct("first.o", "first.h").alias("rep"),
            F.col("first.r").alias("rep_r"),
        ),
        "jaccard-classes",
    )
    # One signed row per class, found by its row number.
    reps = some.join(classes, (some["r"] == classes["rep_r"]) & (some["node"] == classes["node_k"])).drop(
        "node_k", "rep", "rep_r"
    )
    reps = settle(reps, "jaccard-reps")
    banded = reps.select("node", F.posexplode("bands").alias("band", "key"))
    busy = settle(
        banded.groupBy(F.col("key").alias("key_k")).agg(F.count("*").alias("n")).filter("n > 1"),
        "jaccard-buckets",
    )
    members = banded.join(busy, F.col("key") == F.col("key_k")).drop("key_k")
    # Blocks of a bucket: one for most, so that a tile never has more than two blocks' rows.
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "band", "node", "block",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
    )
    small = reps.select(F.col("node").alias("node_k"), "sig", "copies", "size", "o", "h")
    rows = tiled.join(small, F.col("node") == F.col("node_k")).drop("node_k")

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(least)
        for group in _groups(batches, TILE):
            sig = _bytes_matrix(group.column("sig"))
            where = group.column("block").to_numpy()
            tile = (group.column("i")[0].as_py(), group.column("j")[0].as_py())
            alive = np.zeros(len(where), bool)
            for a, b in tiles.pairs(sig, where, tile, group.column("band")[0].as_py()):
                alive[a] = alive[b] = True
            if alive.any():
                for part in group.filter(pa.array(alive)).combine_chunks().to_batches():
                    yield part

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*[F.col(c) for c in TILE]).sortWithinPartitions(*TILE)

    columns = ["key", "i", "j", "band", "block", "node", "sig", "copies", "size", "o", "h"]
    wide = rows.select(*columns)
    alive = settle(dealt(wide).mapInArrow(survivors, wide.schema), "jaccard-alive")

    wanted = alive.select(F.col("node").alias("node_k"), F.col("o").alias("o_k"), F.col("h").alias("h_k")).distinct()
    texts = given.join(wanted, (F.col("o") == F.col("o_k")) & (F.col("h") == F.col("h_k")))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, 0):
                grams, bounds = shingle_sets(piece.column(0))
                data = [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1), pa.array(data, pa.binary())], ["node_k", "grams"]
                )

    sets = settle(
        texts.select("t", "node_k").mapInArrow(shingles, "node_k binary, grams binary").dropDuplicates(["node_k"]),
        "jaccard-sets",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(least)
        for group in _groups(batches, TILE):
            sig = _bytes_matrix(group.column("sig"))
            where = group.column("block").to_numpy()
            copies = group.column("copies").to_numpy()
            nodes = group.column("node").to_pylist()
            sets_ = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
            sizes = np.array([len(s) for s in sets_])
            tile = (group.column("i")[0].as_py(), group.column("j")[0].as_py())
            links = np.zeros(len(nodes), np.int64)
            parent = np.arange(len(nodes))

            def top(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for a, b in tiles.pairs(sig, where, tile, group.column("band")[0].as_py()):
                common = intersections(sets_, a, b)
                # In whole numbers, so that a pair exactly at the threshold is linked.
                enough = common * 1_000_000 >= round(threshold * 1_000_000) * (sizes[a] + sizes[b] - common)
                a, b = a[enough], b[enough]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for x, y in zip(a, b):
                    x, y = top(x), top(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            linked = np.flatnonzero(links)
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([nodes[x] for x in linked], pa.binary()),
                        pa.array(links[linked]),
                        pa.array([nodes[top(x)] for x in linked], pa.binary()),
                    ],
                    ["u", "links", "v"],
                )

    full = alive.join(sets, alive["node"] == sets["node_k"]).drop("node_k", "size", "o", "h")
    linked = settle(dealt(full).mapInArrow(verify, "u binary, links long, v binary"), "jaccard-links")
    counts = linked.groupBy(F.col("u").alias("node_k")).agg(F.sum("links").alias("links"))
    roots = components(linked.select("u", "v"))
    about = classes.join(counts, "node_k", "left").join(
        roots.select(F.col("node").alias("node_k"), "root"), "node_k", "left"
    )
    about = about.withColumn("root", F.coalesce("root", "node_k"))
    least_id = about.groupBy(F.col("root").alias("root_k")).agg(F.min("rep").alias("least"))
    about = settle(
        about.join(least_id, F.col("root") == F.col("root_k")).select(
            "node_k", "copies", "links", F.col("least.o").alias("group_id"), F.col("least.h").alias("group_hash")
        ),
        "jaccard-groups",
    )
    joined = signed.select("o", "h", "node").join(about, F.col("node") == F.col("node_k"), "left")

    def back(c: str):
        return F.when(F.col(c) != LAST, F.col(c))

    return joined.select(
        back("o").alias(id_col),
        F.col("h").alias("text_hash"),
        # Text without words is in no class, and a group of its own.
        F.when(F.col("group_id").isNull(), back("o")).otherwise(back("group_id")).alias("group_id"),
        F.coalesce("group_hash", "h").alias("group_hash"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the least id, null being the greatest.

    Of several texts under that id the one of least hash stays, of rows equal in id and
    text one. Texts without words are groups of their own.
    """
    groups = link_documents(docs, id_col=id_col, text_col=text_col)
    o, h, n, ok, hk = (free_name(docs, f"_one_{c}") for c in ("o", "h", "n", "ok", "hk"))
    least = F.col(id_col).eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("group_hash"))
    keepers = (
        groups.filter(least)
        .select(F.coalesce(F.col(id_col), F.lit(LAST)).alias(ok), F.col("text_hash").alias(hk))
        .distinct()
    )
    keyed = docs.withColumn(o, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn(
        h, F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    )
    kept = keyed.join(keepers, (F.col(o) == F.col(ok)) & (F.col(h) == F.col(hk))).drop(ok, hk)
    order = W.partitionBy(o, h).orderBy(F.lit(1))
    return kept.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).drop(o, h, n)
