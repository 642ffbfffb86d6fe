"""Removal of passages repeated across documents, found by a count-min prefilter.

A window of 50 words is represented by its anchor, the least hash of the 24-word grams
in it. Equal windows have equal anchors, so a window that occurs in two documents has an
anchor that occurs twice. The first pass counts anchors in count-min sketches, one per
partition, which merge by slices; estimates never fall below true counts. The second
pass keeps the documents that hold an anchor estimated twice, and only windows on such
anchors are grouped exactly, by 128-bit hashes. False alarms cost work, never results.

The merged sketch is broadcast as long as it fits. Beyond that it is split by hash: a task
owns a slice of the anchors, counts them and answers for them, so the counters grow with
the corpus and the share of false alarms stays what it was.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm import hashing
from tidegrid.llm.common import schema_with, settle, settle_by
from tidegrid.session import delete_paths

WINDOW, GRAM = 50, 24
# Rows of 2 ** width counters, merged in slices of 2 ** SLICE. After the merge one bit per
# counter tells whether it reached two. The width follows the corpus; up to MOST_WIDTH (100 MB
# in all) the sketch is broadcast, beyond it parts of 2 ** SPLIT counters a row are owned by tasks.
ROWS, SLICE, MOST_WIDTH, SPLIT = 3, 22, 28, 25
BYTES_PER_COUNTER = 13  # of text; some 90 bytes have one anchor
ANCHORS_PER_ROW = 512  # sent at once, so that a batch of rows stays small
LAST = (1 << 63) - 1  # a null id comes after all others
ADDED = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of the window at each start."""
    grams = hashing.windows(hashes, GRAM)
    span, size, least = WINDOW - GRAM + 1, 1, grams
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:]) if len(least) > size else least[:0]
        size *= 2
    rest = span - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if len(least) > rest else least[:0]


def _places(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    return (hashing.mixed(anchors + np.uint64(row + 1)) >> np.uint64(64 - width)).astype(np.int64)


def sketch_width(docs: DataFrame, text_col: str) -> int:
    """Such that some seven counters stand for an anchor, whatever the size of the corpus."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 1
    return max(SLICE, math.ceil(math.log2(max(1, total / BYTES_PER_COUNTER))))


def _numbered(text: pa.Array):
    bounds, words = hashing.split_words(text)
    hashes = hashing.word_hashes(words)
    anchors = _anchors(hashes[0])
    return bounds, hashes, anchors, hashing.within(bounds, WINDOW, len(anchors))


def repeated_anchors(docs: DataFrame, text_col: str, width: int) -> bytes:
    """The merged sketch: for each counter, one bit that says whether it reached two."""
    per_row = 1 << (width - SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, 0):
                bounds, _, anchors, inside = _numbered(piece.column(0))
                # Neighbouring windows on one anchor count once within a document.
                first = inside.copy()
                first[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1]
                begins = bounds[:-1]
                begins = begins[begins < len(first)]
                first[begins] |= inside[begins]
                chosen = anchors[first]
                for row in range(ROWS):
                    places, counts = np.unique(_places(chosen, row, width), return_counts=True)
                    cuts = np.searchsorted(places, np.arange(per_row) << SLICE)
                    ends = np.append(cuts[1:], len(places))
                    keep = np.flatnonzero(ends > cuts)
                    low = (places & ((1 << SLICE) - 1)).astype(np.uint32) * 2 + (counts > 1)
                    low = low.astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row * per_row + keep, pa.int32()),
                            pa.array([low[cuts[i] : ends[i]].tobytes() for i in keep], pa.binary()),
                        ],
                        ["slice", "counts"],
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done():
            bits = np.packbits(twice).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([bits], pa.binary())], ["slice", "counts"]
            )

        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != at:
                    if at is not None:
                        yield done()
                    at = number
                    once, twice = np.zeros(1 << SLICE, bool), np.zeros(1 << SLICE, bool)
                low = np.frombuffer(data.as_buffer(), "<u4")
                places = low >> 1
                twice[places[once[places] | (low & 1).astype(bool)]] = True
                once[places] = True
        if at is not None:
            yield done()

    slices = ROWS * per_row
    parts = docs.select(F.col(text_col)).mapInArrow(count, "slice int, counts binary")
    merged = (
        parts.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, counts binary")
    )
    bits = bytearray(slices << (SLICE - 3))
    size = 1 << (SLICE - 3)
    for number, data in merged.collect():  # as many rows as slices
        bits[number * size : (number + 1) * size] = data
    return bytes(bits)


def _estimated(bits: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
    """Whether every row of the sketch counted these anchors twice."""
    twice = np.ones(len(anchors), bool)
    for row in range(ROWS):
        places = _places(anchors, row, width) + (row << width)
        twice &= (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
    return twice


def split_estimates(docs: DataFrame, text: str, order: str, one: str, slices: int, width: int = SPLIT) -> DataFrame:
    """Rows (o, s, anchor): a document's order and hash, and its anchors estimated to occur twice.

    Each piece of the input counts its anchors once and asks for those it holds in one document
    only; the others occur twice for certain and need no answer. So a hot anchor sends one count
    and one question per piece. Rows of a slice arrive counts first, and stream by.
    """

    def owner(x: np.ndarray) -> np.ndarray:
        return ((hashing.mixed(x) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)

    def cut(kind: int, part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
        turn = np.argsort(part, kind="stable")
        part, columns = part[turn], [c[turn] for c in columns]
        begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for begin, end in zip(begins, [*begins[1:], len(part)]):
            for at in range(begin, end, ANCHORS_PER_ROW):
                some = slice(at, min(end, at + ANCHORS_PER_ROW))
                yield int(part[begin]), kind, *[c[some].tobytes() for c in columns]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, 0):
                bounds, _, anchors, inside = _numbered(piece.column(0))
                starts = np.flatnonzero(inside)
                row, anchor = np.searchsorted(bounds, starts, "right") - 1, anchors[starts]
                turn = np.lexsort((row, anchor))
                row, anchor = row[turn], anchor[turn]
                new = np.ones(len(row), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                row, anchor = row[new], anchor[new]
                again = anchor[1:] == anchor[:-1]
                first, known = np.ones(len(row), bool), np.zeros(len(row), bool)
                first[1:] = ~again
                known[1:] |= again
                known[:-1] |= again
                o, s = (piece.column(i).to_numpy().astype(np.int64)[row] for i in (1, 2))
                none, part = np.zeros(0, np.int64), owner(anchor)
                rows = [(p, k, a, b"", b"") for p, k, a in cut(0, part[first], [anchor[first]])]
                rows += cut(1, part[~known], [anchor[~known], o[~known], s[~known]])
                # Known ones only pass by: spread by document, not by anchor.
                rows += cut(2, owner(s.view(np.uint64))[known], [anchor[known], o[known], s[known]])
                columns = list(zip(*rows)) if rows else [none] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                    ["slice", "kind", "anchors", "o", "s"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            numbers, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for number, kind, *data in zip(numbers, kinds, *(batch.column(i) for i in (2, 3, 4))):
                anchor, o, s = (np.frombuffer(d.as_buffer(), t) for d, t in zip(data, ("<u8", "<i8", "<i8")))
                if number != at:
                    at = number
                    once, twice = np.zeros((ROWS, 1 << width), bool), np.zeros((ROWS, 1 << width), bool)
                chosen = np.ones(len(anchor), bool)
                for row in range(ROWS if kind < 2 else 0):
                    places = _places(anchor, row, width)
                    if kind == 0:
                        places, counts = np.unique(places, return_counts=True)
                        twice[row, places[once[row, places] | (counts > 1)]] = True
                        once[row, places] = True
                    else:
                        chosen &= twice[row, places]
                if kind:
                    for held, values in zip(found, (o, s, anchor.view(np.int64))):
                        held.append(values[chosen])
            columns = [np.concatenate(held) if held else np.zeros(0, np.int64) for held in found]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["o_k", "s_k", "anchor"])

    sent = docs.select(text, order, one).mapInArrow(send, "slice int, kind int, anchors binary, o binary, s binary")
    return (
        sent.repartition(slices, "slice")
        .sortWithinPartitions("slice", "kind")
        .mapInArrow(answer, "o_k long, s_k long, anchor long")
    )


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    with_text: bool = True,
    most_width: int = MOST_WIDTH,
    split_width: int = SPLIT,
) -> DataFrame:
    """Columns ``keep`` of ``docs``, then n_words, n_removed, kept_sha256 and kept_text.

    A word goes if a window of 50 consecutive words over it also starts in a document with
    a smaller id; windows are judged on the input. ``kept_text`` is the text itself where
    nothing goes, else the words that stay joined by one space; ``kept_sha256`` is always
    of these words joined by one space. Without ``with_text``, ``kept_text`` is null for
    documents in which no repeated anchor was found.

    A null text has no words. A null id counts as the greatest. Rows with one id are one
    document to each other: what repeats only among them stays. An empty table gives an
    empty table. Kept columns named like a result are dropped in favour of the result.

    A sketch wider than 2 ** ``most_width`` counters a row is split into parts of
    2 ** ``split_width``; the result is the same.
    """
    spark = docs.sparkSession
    names = [part.split(" ")[0] for part in ADDED.split(", ")]
    shown = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    # Own columns travel under numbers, so that no name of theirs meets one used here.
    kept = [f"own{i}" for i in range(len(shown))]
    width = sketch_width(docs, text_col)
    split = width > most_width
    sketch = None if split else spark.sparkContext.broadcast(repeated_anchors(docs, text_col, width))
    inner = "_sub_order long, _sub_one long, _sub_two long, _sub_hit int, _sub_n long, _sub_sha string, _sub_text string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if split else np.frombuffer(sketch.value, np.uint8)
        at_text, at_id = len(kept), len(kept) + 1
        for batch in batches:
            for piece in hashing.slices(batch, at_text):
                text = piece.column(at_text)
                bounds, words = hashing.split_words(text)
                hashes = hashing.word_hashes(words)
                anchors = _anchors(hashes[0])
                inside = hashing.within(bounds, WINDOW, len(anchors))
                twice = np.zeros(len(hashes[0]) + 1, np.int64)
                # A split sketch answers later; till then every window may be a repeat.
                twice[: len(anchors)] = inside if split else inside & _estimated(bits, anchors, width)
                total = np.concatenate([[0], np.cumsum(twice)])
                hit = total[bounds[1:]] > total[bounds[:-1]]
                sums = _sequence_hashes(hashes, bounds)
                texts = text.to_pylist()
                shas = [_digest(b" ".join((t or "").encode().split())) for t in texts]
                shown = [t if with_text or h else None for h, t in zip(hit, texts)]
                columns = [piece.column(i) for i in range(len(kept))] + [
                    piece.column(at_id),
                    hashing.signed(sums[0]),
                    hashing.signed(sums[1]),
                    pa.array(hit.astype(np.int32)),
                    pa.array(np.diff(bounds)),
                    pa.array(shas, pa.string()),
                    pa.array(shown, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *(p.split(" ")[0] for p in inner.split(", "))])

    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_sub_order")
    given = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(shown, kept)], F.col(text_col).alias("_sub_given"), order)
    scanned, stored = settle_by(given.mapInArrow(scan, schema_with(given, kept, inner)), "_sub_hit", "repeats-scan")

    key = ["_sub_one", "_sub_two"]
    hit = scanned.filter("_sub_hit = 1")
    # Equal word sequences: only the smallest id's windows need a look, all others go whole.
    firsts = settle(
        hit.groupBy(*[F.col(c).alias(f"{c}_k") for c in key])
        .agg(F.min("_sub_order").alias("_sub_first"), F.max("_sub_order").alias("_sub_last"))
        .filter("_sub_first < _sub_last")
        .drop("_sub_last"),
        "repeats-firsts",
    )
    same = [hit[c] == firsts[f"{c}_k"] for c in key]
    marked = hit.join(firsts, same, "left").drop(*[f"{c}_k" for c in key])
    marked = settle(
        marked.withColumn("_sub_copy", F.coalesce(F.col("_sub_order") > F.col("_sub_first"), F.lit(False)))
        .drop("_sub_first", "_sub_two", "_sub_hit")
        .withColumn("_sub_text", F.when(~F.col("_sub_copy"), F.col("_sub_text"))),
        "repeats-marked",
    )
    # These rows are in ``marked`` now; only the others are read again.
    delete_paths(spark, [f"{stored}/_sub_hit=1"])
    looked = marked.filter("NOT _sub_copy")
    # Without the copies most anchors occur once: count again, over these documents only.
    second, asked = None, looked.select("_sub_text", "_sub_order", "_sub_one")
    if split:
        parts = 1 << max(0, width - split_width)
        told = split_estimates(looked, "_sub_text", "_sub_order", "_sub_one", parts, split_width)
        told = told.groupBy("o_k", "s_k").agg(F.collect_set("anchor").alias("_sub_told"))
        named = (F.col("_sub_order") == F.col("o_k")) & (F.col("_sub_one") == F.col("s_k"))
        asked = asked.join(told, named).drop("o_k", "s_k")
    else:
        second = spark.sparkContext.broadcast(repeated_anchors(looked, "_sub_text", width))

    def repeated(piece: pa.RecordBatch, anchors: np.ndarray, row: np.ndarray) -> np.ndarray:
        if not split:
            return _estimated(np.frombuffer(second.value, np.uint8), anchors, width)
        told = piece.column(3)
        owner = np.repeat(np.arange(len(told)), np.diff(told.offsets.to_numpy()))
        held = np.ascontiguousarray(told.flatten().to_numpy()).view(np.uint64)
        ours, theirs = (
            hashing.mixed(a ^ hashing.mixed(r.astype(np.uint64) + np.uint64(1))) for a, r in ((anchors, row), (held, owner))
        )
        return np.isin(ours, theirs)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, 0, 2 * hashing.SLICE_BYTES):
                bounds, hashes, anchors, inside = _numbered(piece.column(0))
                starts = np.flatnonzero(inside)
                row = np.searchsorted(bounds, starts, "right") - 1
                twice = repeated(piece, anchors[starts], row)
                starts, row = starts[twice], row[twice]
                a, b = (hashing.windows(h, WINDOW)[starts] for h in hashes)
                order = piece.column(1).to_numpy()[row]
                # Of equal windows here only those of the smallest id can be first anywhere:
                # the others are repeats for certain and need not travel.
                turn = np.lexsort((order, b, a))
                new = np.ones(len(turn), bool)
                new[1:] = (a[turn][1:] != a[turn][:-1]) | (b[turn][1:] != b[turn][:-1])
                least = order[turn][np.flatnonzero(new)][np.cumsum(new) - 1] if len(turn) else order
                sure = np.zeros(len(turn), bool)
                sure[turn] = order[turn] > least
                hide = pa.array(sure)
                none = pa.scalar(None, pa.int64())
                columns = [pc.if_else(hide, none, hashing.signed(h)) for h in (a, b)]
                one = piece.column(2).take(pa.array(row))
                place = pa.array(starts - bounds[row], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(order), one, place, hide], ["a", "b", "o", "s", "at", "sure"]
                )

    found = settle(
        asked.mapInArrow(
            spots, "a long, b long, o long, s long, at int, sure boolean"
        ),
        "repeats-windows",
    )
    # One row per window and piece of the input at most, so no window gathers many rows.
    first_of = F.min("o").over(W.partitionBy("a", "b"))
    later = (
        found.filter("NOT sure").withColumn("lo", first_of).filter("o > lo").select("o", "s", "at")
        .union(found.filter("sure").select("o", "s", "at"))
    )
    spans = later.groupBy(F.col("o").alias("o_k"), F.col("s").alias("s_k")).agg(
        F.collect_set("at").alias("_sub_starts")
    )
    joined = looked.join(
        spans, (F.col("_sub_order") == F.col("o_k")) & (F.col("_sub_one") == F.col("s_k")), "left"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column(len(kept)), batch.column(len(kept) + 1)
            rows = [_cut(t.as_py() or "", s) for t, s in zip(texts, starts)]
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [
                pa.array([r[i] for r in rows], t)
                for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))
            ]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *(p.split(" ")[0] for p in ADDED.split(", "))])

    own = [F.col(f"`{c}`") for c in kept]
    cut = joined.select(*own, "_sub_text", "_sub_starts").mapInArrow(finish, schema_with(given, kept, ADDED))

    def whole(rows: DataFrame, removed: str, sha: Column, text: Column) -> DataFrame:
        return rows.select(
            *own,
            F.col("_sub_n").alias("n_words"),
            F.expr(removed).cast("long").alias("n_removed"),
            sha.alias("kept_sha256"),
            text.alias("kept_text"),
        )

    untouched = whole(scanned.filter("_sub_hit = 0"), "0", F.col("_sub_sha"), F.col("_sub_text"))
    copies = whole(marked.filter("_sub_copy"), "_sub_n", F.lit(_digest(b"")), F.lit(""))
    return untouched.union(copies).union(cut).toDF(*shown, *names)


def _sequence_hashes(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """128 bits for each text's whole word sequence."""
    out = []
    place = np.arange(len(hashes[0])) - np.repeat(bounds[:-1], np.diff(bounds))
    weight = hashing.mixed(place.astype(np.uint64) + np.uint64(1))
    for h in hashes:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mixed(h ^ weight))])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out


def _cut(text: str, starts: pa.ListScalar) -> tuple[int, int, str, str]:
    """Words, words removed, digest of the rest, and the rest, given where repeated windows start."""
    words = text.encode().split()
    n = len(words)
    gone = np.zeros(n + 1, np.int64)
    if starts.is_valid:
        at = starts.values.to_numpy()
        np.add.at(gone, at, 1)
        np.subtract.at(gone, at + WINDOW, 1)
        gone = np.cumsum(gone)
    removed = int((gone[:n] > 0).sum())
    if not removed:
        return n, 0, _digest(b" ".join(words)), text
    rest = b" ".join([w for w, g in zip(words, gone) if not g])
    return n, removed, _digest(rest), rest.decode()
