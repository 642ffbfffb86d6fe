"""A quality classifier on random-indexing word vectors.

Every token has a sparse random index vector; a token's word vector is the sum of the index
vectors of its neighbours over the whole corpus. Tokens are hashed into a fixed number of
rows, so the vectors of all partitions add up to one table of fixed size. A document is the
mean vector of its words and that of their forms; a two-layer network maps it to a logit,
and a temperature fitted on rows kept out of its training calibrates the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import hashing
from tidegrid.llm.common import least_hashed, schema_with, settle

ROWS, DIMS, NONZERO = 1 << 14, 64, 2
REACH = 2  # neighbours on each side
SLICES = 16
GROUP = 512  # tasks whose sums are added up before those of all groups are
FEATURES = 2 * DIMS + 2
HIDDEN = 32
# The network is fitted on at most so many labelled rows, those of least hash.
TRAINING_ROWS = 20_000
EPOCHS = 60

_RANDOM = np.random.default_rng(20)
INDEX_AT = _RANDOM.integers(0, DIMS, (ROWS, NONZERO), dtype=np.int64)
INDEX_SIGN = _RANDOM.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))
_LETTERS = re.compile(r"[^\W\d_]+")


def _row(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) % (ROWS - 1) + 1  # row 0 is for none


def word_rows(word: str) -> tuple[int, int, int]:
    """Rows of a word's letters, of its form (case and other signs), and of its form where repeated."""
    letters = "".join(_LETTERS.findall(word))
    rest = _LETTERS.sub("", word)
    case = "-" if not letters else "U" if letters.isupper() and len(letters) > 1 else (
        "T" if letters.istitle() else "l" if letters.islower() else "m"
    )
    signs = re.sub(r"\d", "0", rest)
    form = f"\x01{case}{signs}"
    return (_row(letters.lower()) if letters else 0), _row(form), _row(form + "\x02")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the texts' words, and for every word its letters' row and its form's row."""
    bounds, words = hashing.split_words(texts)
    if len(words) == 0:
        return bounds, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    table = np.array([word_rows(w) for w in coded.dictionary.to_pylist()], np.int64)
    code = coded.indices.to_numpy()
    again = np.zeros(len(code), bool)
    again[1:] = code[1:] == code[:-1]
    begins = bounds[:-1]
    again[begins[begins < len(code)]] = False
    return bounds, table[code, 0], np.where(again, table[code, 2], table[code, 1])


def word_vectors(docs: DataFrame, text_col: str = "text", group: int = GROUP) -> np.ndarray:
    """The table of all rows' vectors, of unit length, from every text. 4 MB for any corpus.

    Sums of ``group`` input tasks are added slice by slice, then those of the groups, so
    no task reads the sums of a whole corpus. They are whole numbers: any order gives the same.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIMS)
        for batch in batches:
            for piece in hashing.slices(batch, 0, 2_000_000):
                bounds, letters, forms = tokens(piece.column(0))
                text = np.repeat(np.arange(len(bounds) - 1), 2 * np.diff(bounds))
                line = np.stack([letters, forms], 1).ravel()
                for gap in range(1, REACH + 1):
                    a, b = line[:-gap], line[gap:]
                    same = (text[:-gap] == text[gap:]) & (a > 0) & (b > 0)
                    a, b = a[same], b[same]
                    for own, other in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(
                                own * DIMS + INDEX_AT[other, k], INDEX_SIGN[other, k], ROWS * DIMS
                            )
        parts = total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())],
            ["slice", "sums"],
        )

    def merge(batches: Iterator[pa.RecordBatch], given: type = np.float64) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most SLICES of 512 KB
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), given).astype(np.float64)
                sums[number] = sums[number] + part if number in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            ["slice", "sums"],
        )

    schema = "slice int, sums binary"
    counted = docs.select(F.col(text_col)).mapInArrow(count, schema)
    grouped = (
        counted.withColumn("group", F.floor(F.spark_partition_id() / group))
        .repartition("group", "slice")
        .drop("group")
        .mapInArrow(lambda batches: merge(batches, np.float32), schema)
    )
    merged = grouped.repartition(SLICES, "slice").mapInArrow(merge, schema)
    total = np.zeros((SLICES, ROWS * DIMS // SLICES))
    for number, data in merged.collect():  # SLICES rows, 8 MB in all
        total[number] = np.frombuffer(data, np.float64)
    total = total.reshape(ROWS, DIMS)
    total -= total.sum(0) / max(1.0, np.abs(total).sum()) * np.abs(total).sum(1, keepdims=True)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of each text's words and forms, its length and the share of its commonest form."""
    bounds, letters, forms = tokens(texts)
    out = np.zeros((len(bounds) - 1, FEATURES), np.float32)
    for i, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:])):
        if end > begin:
            out[i, :DIMS] = vectors[letters[begin:end]].mean(0)
            out[i, DIMS : 2 * DIMS] = vectors[forms[begin:end]].mean(0)
            out[i, -2] = np.log1p(end - begin)
            out[i, -1] = np.bincount(forms[begin:end]).max() / (end - begin)
    return out


@dataclass
class Network:
    """Two layers on standardised features, and the temperature of the logit."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.first + self.first_bias) @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x) / self.temperature, -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 21, epochs: int = EPOCHS) -> Network:
    """The network by Adam on nine tenths of the rows, its temperature on the rest.

    Without rows, or with rows of one label only, the score is their smoothed share alone.
    """
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64).reshape(-1, FEATURES)
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(
        x.mean(0) if len(x) else np.zeros(FEATURES),
        np.maximum(x.std(0), 1e-3) if len(x) else np.ones(FEATURES),
        rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)),
        np.zeros(HIDDEN),
        np.zeros(HIDDEN),
        float(np.log(share / (1 - share))),
    )
    if len(y) < 10 or y.min() == y.max():
        return net
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 10)
    tune, train = order[:cut], order[cut:]
    net.second = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    weights = [net.first, net.first_bias, net.second, np.array([net.second_bias])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step, batch = 0, min(256, len(train))
    rounds = max(epochs, 1500 // max(1, len(train) // batch))
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            z = (x[rows] - net.mean) / net.scale
            hidden = np.tanh(z @ weights[0] + weights[1])
            logit = np.clip(hidden @ weights[2] + weights[3][0], -30, 30)
            error = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            back = error[:, None] * weights[2] * (1 - hidden**2)
            grads = [z.T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * weights[i]
                m, v = moments[i]
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.999 * v + 0.001 * g * g
                weights[i] -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.first, net.first_bias, net.second = weights[:3]
    net.second_bias = float(weights[3][0])
    logit = net.logits(x[tune])
    grid = np.geomspace(0.5, 8, 60)
    losses = [np.mean(np.logaddexp(0, np.where(y[tune] == 1, -1, 1) * logit / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train: Column | None = None,
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) of every document.

    Word vectors come from all texts, labels only from rows of ``labels`` that ``train``
    keeps (all by default) and whose id occurs in ``docs``; of several labels of one id the
    greatest counts, of several documents of one id any one. Nothing but the text enters a score.

    Null and empty texts have zero features and a score like any other. Null ids have no
    label. Repeated rows get equal scores. An empty table gives an empty table; without
    labels every score is 0.5. Other columns are left out.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, 1):
                rows = pooled(piece.column(1), vectors.value)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], [id_col, "_features"]
                )

    given = docs.select(F.col(id_col), F.col(text_col))
    features = settle(given.mapInArrow(pool, schema_with(docs, [id_col], "_features binary")), "quality-features")
    kept = labels if train is None else labels.filter(train)
    known = kept.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(
        F.max(label_col).alias("_label")
    )
    chosen = least_hashed(settle(known, "quality-labels"), F.col("_label_id"), training_rows, 22)
    sample = features.join(F.broadcast(chosen), F.col(id_col) == F.col("_label_id"))
    sample = sample.dropDuplicates(["_label_id"]).select("_features", "_label", "_label_id")
    sample = sample.orderBy("_label_id").toArrow()
    x = np.frombuffer(b"".join(sample.column("_features").to_pylist()), np.float32).reshape(-1, FEATURES)
    net = fit(x, sample.column("_label").to_numpy().astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(net.probabilities(x.astype(np.float64)))], [id_col, "score"]
            )

    return features.mapInArrow(score, schema_with(docs, [id_col], "score double"))
