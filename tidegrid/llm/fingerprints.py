"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at every step the current character and the step decide
whether the walk stays or moves on, so each character is written for a random number of
steps. Two texts that differ by few edits fall out of step at an edit and, by the shared
randomness, soon into step again; their edit distance becomes a Hamming distance of what
was written (Chakraborty, Goldenberg and Koucky). Steps are sampled by octaves, as many
from each, so a fingerprint covers texts of any length and nearby lengths compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.keys import broadcast_if_small
from tidegrid.llm import hashing, jaccard
from tidegrid.llm.common import free_name, settle
from tidegrid.llm.components import components

# Steps repeat their random bits after PERIOD; characters share CLASSES rows of bits.
PERIOD, CLASSES = 1 << 12, 256
SAMPLES = 32  # of each octave of steps
FIRST = 3  # steps below 2 ** FIRST are one octave
GRAM = 4  # a sample writes the characters from the walk's place on
# One sign for six bits of a sample; "." where the walk had ended.
SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
SIGN_BYTES = np.frombuffer(SIGNS.encode(), np.uint8)
TEXTS = 512  # walked side by side
ALONE = 64  # fewer texts than that are walked one by one


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stay[class * PERIOD + step]: steps that a character holds the walk from this step on."""
    rng = np.random.default_rng(100)
    moves = rng.integers(0, 2, (CLASSES, 2 * PERIOD), dtype=np.uint8)
    moves[:, PERIOD:] = moves[:, :PERIOD]
    stay = np.empty((CLASSES, PERIOD), np.uint8)
    nearest = np.full(CLASSES, 1, np.int32)
    for step in range(2 * PERIOD - 1, -1, -1):
        nearest = np.where(moves[:, step] == 1, 1, nearest + 1)
        if step < PERIOD:
            stay[:, step] = nearest
    return stay.ravel(), rng.integers(1, 1 << 62, 4, dtype=np.int64).astype(np.uint64)


STAY, SALT = _tables()
STAY_BYTES = STAY.tobytes()


def sampled_steps(octaves: int) -> np.ndarray:
    """Fixed sample steps, SAMPLES for each octave, ascending within it."""
    rows = []
    for k in range(octaves):
        low, high = (0, 1 << FIRST) if k == 0 else (1 << (FIRST + k - 1), 1 << (FIRST + k))
        rng = np.random.default_rng([101, k])
        rows.append(np.sort(rng.integers(low, high, SAMPLES)))
    return np.concatenate(rows)


STEPS = sampled_steps(40)
WEIGHTS = np.concatenate([[1 << FIRST], [1 << (FIRST + k - 1) for k in range(1, 40)]]).astype(float)


def _walk(texts: list[np.ndarray], begins: list[int] | None = None) -> list[np.ndarray]:
    """The step at which the walk reaches each character, and the step at which it ends.

    ``begins`` are the steps at which the walks reach the first characters, 0 without it.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    steps = np.zeros(starts[-1], np.int32)
    flat = np.zeros(starts[-1], np.int32)
    now = np.zeros(len(order), np.int32)
    for row, i in enumerate(order):
        flat[starts[row] : starts[row] + sizes[row]] = (texts[i] % CLASSES) * PERIOD
        now[row] = begins[i] if begins else 0
    base = starts[:-1]
    steps[base] = now
    # Character by character over all texts that are that long, the longest first, while
    # there are enough of them to be worth a call of numpy.
    together = int(sizes[ALONE - 1]) if len(order) >= ALONE else 0
    alive = np.searchsorted(-sizes, -np.arange(together), "left")
    for at in range(together):
        n = alive[at]
        place = base[:n] + at
        now = now[:n]
        now = now + STAY[flat[place] + (now & (PERIOD - 1))]
        steps[place + 1] = now
    for row in range(min(len(order), ALONE)):
        first, last = starts[row] + together, starts[row] + sizes[row]
        if first < last:
            steps[first + 1 : last + 1] = _walk_alone(flat[first:last].tolist(), int(steps[first]))
    out: list[np.ndarray] = [steps] * len(texts)
    for row, i in enumerate(order):
        out[i] = steps[starts[row] : starts[row + 1]]
    return out


def _walk_alone(rows: list[int], now: int) -> list[int]:
    """The steps after each character of one text, of which ``rows`` are the places in STAY."""
    stay, mask, out = STAY_BYTES, PERIOD - 1, []
    for row in rows:
        now += stay[row + (now & mask)]
        out.append(now)
    return out


def _signs(texts: list[np.ndarray], walks: list[np.ndarray]) -> list[str]:
    """The fingerprints: for each sample the sign of the gram at the walk's place."""
    wanted, places = [], []
    for steps in walks:
        end = int(steps[-1])
        octaves = 1 + max(0, (end - 1).bit_length() - FIRST) if end else 0
        wanted.append(STEPS[: octaves * SAMPLES])
        places.append(np.searchsorted(steps, wanted[-1], "right") - 1)
    counts = np.array([len(w) for w in wanted], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.repeat([int(steps[-1]) for steps in walks], counts)
    inside = np.concatenate(wanted) < ends
    # Texts lie one after the other, each followed by the zeros that a gram may reach into.
    gap = np.zeros(GRAM, np.int32)
    flat = np.concatenate([part for text in texts for part in (text, gap)]).astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum(sizes + GRAM)])[:-1]
    place = np.minimum(np.concatenate(places), np.repeat(sizes - 1, counts)) + np.repeat(begins, counts)
    value = np.full(len(place), SALT[0])
    for k in range(GRAM):
        value = (value ^ flat[place + k]) * (SALT[1] | np.uint64(1))
        value ^= value >> np.uint64(29)
    signs = np.where(inside, SIGN_BYTES[(value >> np.uint64(40)) & np.uint64(63)], np.uint8(46)).tobytes().decode()
    cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [signs[low:high] for low, high in zip(cuts[:-1], cuts[1:])]


def codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def fingerprints(texts: list[str | None]) -> list[str]:
    """Fingerprints of whole texts; a null text is empty, an empty text has the empty one."""
    out = []
    for begin in range(0, len(texts), TEXTS):
        parts = [codes(t) for t in texts[begin : begin + TEXTS]]
        out += _signs(parts, _walk(parts))
    return out


def likeness(a: str, b: str) -> float:
    """Share of the steps on which two walks agree, estimated from the samples, 0 to 1.

    Samples of an octave stand for its steps; those at which both walks had ended count for
    neither. Two empty fingerprints are alike.
    """
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    if size == 0:
        return 1.0
    x, y = (np.frombuffer(s.ljust(size, ".").encode(), np.uint8) for s in (a, b))
    weight = np.repeat(WEIGHTS[: size // SAMPLES], SAMPLES)
    counted = (x != 46) | (y != 46)
    return float(weight[counted & (x == y)].sum() / max(weight[counted].sum(), 1.0))


def with_next(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 65536
) -> DataFrame:
    """Rows (bucket, id, text, guest) in which each document's successor is the row after it.

    Documents come by descending id, null last; after the last comes the first. Ids are cut
    into ranges; each range also gets, as its last row, a guest: the first document of the
    next range. So ranges are read independently of each other, in order within.
    """
    ids = docs.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    low, high, rows = ids[0] or 0, ids[1] or 0, ids[2]
    parts = max(1, min(buckets, rows // 64))
    width = max(1, -(-(high - low + 1) // parts))
    # Range 0 holds the greatest ids; nulls are in a range of their own at the end.
    place = F.coalesce(F.floor((F.lit(high) - F.col(id_col)) / F.lit(width)).cast("int"), F.lit(parts))
    rows_ = docs.select(
        place.alias("bucket"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    # At most ``buckets`` + 1 rows: the first id of every range that is in use.
    used = rows_.groupBy("bucket").agg(F.max("id").alias("first_id"))
    ranges = W.orderBy("bucket")
    whole = ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    hosts = used.select(
        F.col("bucket").alias("home"),
        "first_id",
        F.coalesce(F.lag("bucket").over(ranges), F.last("bucket").over(whole)).alias("host"),
    )
    first = rows_.join(
        F.broadcast(hosts), (F.col("bucket") == F.col("home")) & F.col("id").eqNullSafe(F.col("first_id"))
    )
    # Of several rows with that id the first in order is the guest.
    guests = first.groupBy("host").agg(F.first("id").alias("id"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return (
        rows_.withColumn("guest", F.lit(False))
        .union(guests.select(F.col("host").alias("bucket"), "id", "text", F.lit(True).alias("guest")))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "guest", *order)
    )


FIELDS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 65536
) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses.

    The edited text has its last third (rounded down) replaced by as many of the first code
    points of the next document by descending id, or by all it has.

    A null text is empty; equal texts have equal fingerprints. Rows with one id come in the
    order of their texts; null ids come last. A single document is its own successor. An
    empty table gives an empty table. Other columns are left out.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {FIELDS}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            for begin in range(0, len(frame), TEXTS):
                part = frame.iloc[begin : begin + TEXTS]
                part = part if held is None else pd.concat([held, part], ignore_index=True)
                # The last row waits for the row after it; a range's last row is its guest.
                held = part.iloc[-1:]
                yield _compared(part, id_col)

    return with_next(docs, id_col=id_col, text_col=text_col, buckets=buckets).mapInPandas(run, schema)


def _compared(part: pd.DataFrame, id_col: str) -> pd.DataFrame:
    """Results of all rows but the last and the guests, each compared with the row after it."""
    texts = [t if isinstance(t, str) else "" for t in part["text"]]
    guest = part["guest"].to_numpy()
    own = [i for i in range(len(texts) - 1) if not guest[i]]
    parts = [codes(t) for t in texts]
    walks = _walk(parts)
    prints = _signs(parts, walks)
    # An edited text's walk is its document's up to the edit, and goes on from there.
    kept = [len(parts[i]) - len(parts[i]) // 3 for i in own]
    given = [parts[i + 1][: len(parts[i]) // 3] for i in own]
    ends = _walk(given, [int(walks[i][k]) for i, k in zip(own, kept)])
    edited = [texts[i][:k] + texts[i + 1][: len(texts[i]) // 3] for i, k in zip(own, kept)]
    changed = _signs(
        [np.concatenate([parts[i][:k], g]) for i, k, g in zip(own, kept, given)],
        [np.concatenate([walks[i][:k], e]) for i, k, e in zip(own, kept, ends)],
    ) if own else []
    return pd.DataFrame(
        {
            id_col: part["id"].iloc[own].to_numpy() if own else part["id"].iloc[:0].to_numpy(),
            "n_chars": [len(texts[i]) for i in own],
            "edited_sha256": [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
            "fingerprint": [prints[i] for i in own],
            "edited_fingerprint": changed,
            "near_edited": [likeness(prints[i], c) for i, c in zip(own, changed)],
            "near_next": [likeness(prints[i], prints[i + 1]) for i in own],
        }
    )


# A band is so many samples of one octave; each octave has BANDS, of the last OCTAVES of a walk,
# which hold most of its steps. Where samples differ independently a pair at the least likeness
# shares one of 24 bands of five with probability 1 - (1 - 0.8 ** 5) ** 24 > 0.9999, and
# one of 16, where its walks end in neighbouring octaves, with 0.998.
BAND, BANDS, OCTAVES = 5, 8, 3
BAND_PLACES = np.array([np.sort(np.random.default_rng([102, b]).permutation(SAMPLES)[:BAND]) for b in range(BANDS)])
LEAST_SIGNS = 3  # signs of a band at which the walk had not ended
LEAST_LIKENESS = 0.8
BLOCK = 512
TILE = ["key", "i", "j"]


def band_keys(prints: list[str]) -> list[np.ndarray]:
    """Hashes of each fingerprint's bands; bands at which the walk had mostly ended are left out."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(prints)
    sizes = np.array([len(p) for p in prints])
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        table = np.frombuffer("".join(prints[i] for i in rows).encode(), np.uint8).reshape(len(rows), size)
        octaves = range(max(0, size // SAMPLES - OCTAVES), size // SAMPLES)
        # One row of places a band, over all its octaves.
        places = np.concatenate([BAND_PLACES + octave * SAMPLES for octave in octaves])
        names = np.array([octave * BANDS + b for octave in octaves for b in range(BANDS)], np.uint64)
        signs = table[:, places]
        value = np.broadcast_to(hashing.mixed(names + np.uint64(1)), signs.shape[:2])
        for k in range(BAND):
            value = hashing.mixed(value ^ signs[:, :, k].astype(np.uint64))
        usable = (signs != 46).sum(2) >= LEAST_SIGNS
        for i, keys, good in zip(rows, value, usable):
            out[i] = np.unique(keys[good])
    return out


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with the keys of their bands as a last column."""
    for batch in batches:
        keys = band_keys(batch.column("print").to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
        lists = pa.ListArray.from_arrays(pa.array(ends), hashing.signed(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Documents of a tile, each with the first one of those that it is connected to within the tile.

    Each is compared with all later ones that are not connected to it yet: a group of near
    copies is settled by its first one.
    """
    for group in jaccard._groups(batches, TILE):
        nodes, prints = group.column("node").to_pylist(), group.column("print").to_pylist()
        size = max(map(len, prints))
        table = np.frombuffer("".join(p.ljust(size, ".") for p in prints).encode(), np.uint8).reshape(len(prints), size)
        weight = np.repeat(WEIGHTS[: size // SAMPLES], SAMPLES)
        ended = table == 46
        root = np.arange(len(nodes))
        for i in range(len(nodes) - 1):
            others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            if len(others) == 0:
                continue
            counted = ~(ended[i] & ended[others])
            alike = ((table[others] == table[i]) & counted) @ weight
            for j in others[alike >= least * np.maximum(counted @ weight, 1.0)]:
                low, high = sorted((root[i], root[j]))
                if low != high:
                    root[root == high] = low
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        if len(linked):
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[x] for x in linked], pa.binary()), pa.array([nodes[root[x]] for x in linked], pa.binary())],
                ["u", "v"],
            )


def group_prints(
    prints: DataFrame, *, id_col: str = "doc_id", print_col: str = "fingerprint", least: float = LEAST_LIKENESS,
    block: int = BLOCK,
) -> DataFrame:
    """Every row of ``prints`` with ``group_id``: rows linked by likeness of their fingerprints.

    Equal fingerprints are one class. Classes that share a band of sampled signs are compared,
    all with all, in blocks that bound a task; a link is a likeness of at least ``least``.
    Groups are connected components, named by their least id, null being the greatest.
    Empty fingerprints are groups of their own. ``group_id`` replaces a column of that name.
    """
    node, kept = free_name(prints, "_near_node"), [c for c in prints.columns if c.lower() != "group_id"]
    own = F.col(f"`{print_col}`")
    named = prints.withColumn(node, F.unhex(F.md5(F.encode(own, "UTF-8"))))
    distinct = prints.filter(own != "").groupBy(own.alias("print")).agg(
        F.min(F.col(f"`{id_col}`").cast("long")).alias("least"), F.count("*").alias("rows")
    )
    distinct = distinct.select(F.unhex(F.md5(F.encode("print", "UTF-8"))).alias("node"), "print", "least", "rows")
    classes = settle(
        distinct.mapInArrow(_with_keys, "node binary, print string, least long, rows long, keys array<long>"), "near-classes"
    )
    banded = classes.select("node", F.explode("keys").alias("key"))
    busy = settle(banded.groupBy(F.col("key").alias("key_k")).agg(F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    members = banded.join(busy, F.col("key") == F.col("key_k"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    tiled = (
        members.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    wide = tiled.join(classes.select(F.col("node").alias("node_k"), "print"), F.col("node") == F.col("node_k"))
    dealt = wide.select(*TILE, "node", "print").repartition(*TILE).sortWithinPartitions(*TILE)
    linked = settle(dealt.mapInArrow(lambda b: _links(b, least), "u binary, v binary"), "near-links")
    roots = components(linked).select(F.col("node").alias("node_k"), "root")
    about = classes.select("node", "least", "rows").join(roots, F.col("node") == F.col("node_k"), "left")
    about = about.withColumn("root", F.coalesce("root", "node"))
    first = about.groupBy(F.col("root").alias("root_k")).agg(F.min("least").alias("group_id"))
    # Single documents that name their group need no row here: few are looked up.
    shared = about.join(first, F.col("root") == F.col("root_k")).filter("rows > 1 OR group_id IS DISTINCT FROM least")
    found, at = free_name(prints, "_near_found"), free_name(prints, "_near_at")
    groups = settle(
        shared.select(F.col("node").alias(at), F.struct("group_id").alias(found)), "near-groups"
    )
    # Beyond the bound rows are shuffled, prints and all, when the shuffle of the texts is gone.
    joined = named.join(broadcast_if_small(groups), F.col(node) == F.col(at), "left")
    group = F.when((own == "") | F.col(found).isNull(), F.col(f"`{id_col}`")).otherwise(F.col(found)["group_id"])
    return joined.select(*[F.col(f"`{c}`") for c in kept], group.cast("long").alias("group_id"))


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_LIKENESS, block: int = BLOCK
) -> DataFrame:
    """id and group_id of every document: ``group_prints`` of the fingerprints of whole texts.

    Null and empty texts are groups of their own. Repeated rows are rows of one group. An
    empty table gives an empty table. Other columns are left out.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "print": fingerprints(texts)})

    prints = settle(given.mapInPandas(run, "id long, print string"), "fingerprints")
    grouped = group_prints(prints, id_col="id", print_col="print", least=least, block=block)
    return grouped.select(F.col("id").alias(id_col), "group_id")
