"""Language-model scores by prediction by partial matching over bytes.

Training counts every byte after each context of up to five bytes, over all training
documents. A byte that a context has not seen is reached by escapes to shorter contexts,
whose counts exclude what the longer one has seen (method C). All contexts are kept in
tables; as the model is fixed once trained, every escape chain is summed beforehand. The
most frequent contexts become the nodes of a trie, whose rows hold the log probability of
all symbols, and the most frequent grams a list: both are looked up byte by byte. What is
in neither is joined with the tables, so the bounds of trie and list change no score.
A word unigram model with add-one smoothing is scored beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm import hashing
from tidegrid.llm.common import frequent, schema_with, settle

ORDER = 5
SYMBOLS = 257  # bytes and the end of the text
END = 256
# Bounds of what each task holds: trie nodes (67 MB of tables), grams (8 MB) and words (10 MB).
NODES = 32_768
COMMON_GRAMS = 1 << 19
COMMON_WORDS = 1 << 19
# Texts of about so many bytes are scored at once.
SCORED_BYTES = 1_000_000


@dataclass
class Trie:
    """``longer[node, byte]``: the node whose context has that older byte before it, or -1."""

    longer: np.ndarray
    logp: np.ndarray

    def score(self, stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of the symbols at these places, and whether it is that of all contexts.

        It is where the node is ORDER symbols deep; elsewhere a longer context may exist.
        """
        node = np.zeros(len(at), np.int32)
        on = np.arange(len(at))
        for back in range(1, ORDER + 1):
            found = self.longer[node[on], stream[at[on] - back]]
            more = found >= 0
            on = on[more]
            if len(on) == 0:
                break
            node[on] = found[more]
        whole = np.zeros(len(at), bool)
        whole[on] = True
        return self.logp[node, stream[at]], whole


def gram_keys(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER + 1 symbols that end at these places, as one number each."""
    key = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        key = key * SYMBOLS + stream[at - back]
    return key


def byte_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, each after ORDER end signs and before one; bounds of each; places to predict."""
    raw = pc.fill_null(texts.cast(pa.string()), "").cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = raw.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    begins = np.concatenate([[0], np.cumsum(sizes + ORDER + 1)])
    stream = np.full(begins[-1], END, np.int32)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * (ORDER + 1) + ORDER, sizes)
    stream[place] = flat
    predicted = np.ones(len(stream), bool)
    for back in range(ORDER):
        predicted[begins[:-1] + back] = False
    return stream, begins, np.flatnonzero(predicted)


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case of A to Z only."""
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))


def training_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """Counts over the training documents: rows of (word, gram, n), one of word and gram null.

    A gram is ORDER + 1 symbols as one number, the predicted symbol last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, 0):
                text = piece.column(0)
                stream, _, at = byte_stream(text)
                grams, counts = np.unique(gram_keys(stream, at), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["word", "gram", "n"]
                )
                _, words = hashing.split_words(lowered(text))
                tally = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays(
                    [tally.field(0), pa.nulls(len(tally), pa.int64()), tally.field(1)], ["word", "gram", "n"]
                )

    counts = docs.filter(train).select(F.col(text_col)).mapInArrow(run, "word string, gram long, n long")
    return settle(counts.groupBy("word", "gram").agg(F.sum("n").alias("n")), "ppm-counts")


def _suffixes(grams: DataFrame, *kept: str) -> DataFrame:
    """For every gram its symbol after each of its contexts, the empty one and those up to ORDER."""
    every = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("order")
    power = F.pow(F.lit(float(SYMBOLS)), F.col("order")).cast("long")
    return grams.select("gram", *kept, every).select(
        "order",
        (F.expr(f"gram div {SYMBOLS}") % power).alias("context"),
        (F.col("gram") % SYMBOLS).cast("int").alias("symbol"),
        *kept,
    )


def symbol_counts(counts: DataFrame) -> DataFrame:
    """Rows (order, context, symbol, n) of every context, from the grams' counts."""
    wide = _suffixes(counts.filter("gram IS NOT NULL").select("gram", "n"), "n")
    return settle(wide.groupBy("order", "context", "symbol").agg(F.sum("n").alias("n")), "ppm-contexts")


def trie_of(counts: DataFrame, nodes: int = NODES) -> Trie:
    """The trie of the ``nodes`` most frequent contexts and their symbols, from the grams' counts."""
    return _trie(symbol_counts(counts), nodes)


def _trie(symbols: DataFrame, nodes: int) -> Trie:
    """What comes to the driver is bounded by ``nodes`` times the number of symbols.

    A context comes with its suffixes, which are at least as frequent.
    """
    contexts = symbols.groupBy("order", "context").agg(F.sum("n").alias("total"))
    chosen = frequent(contexts, "total", nodes).select("order", "context")
    table = symbols.join(F.broadcast(chosen), ["order", "context"]).toArrow()
    order, context, symbol, n = (
        table.column(c).to_numpy().astype(np.int64) for c in ("order", "context", "symbol", "n")
    )
    return _build(order, context, symbol, n)


def _build(order: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Trie:
    span = SYMBOLS**ORDER
    keys, node = np.unique(order * span + context, return_inverse=True)
    if len(keys) == 0 or keys[0] != 0:  # nothing was learnt: only the root
        keys, node = np.zeros(1, np.int64), np.zeros(0, np.int64)
        symbol, n = symbol[:0], n[:0]
    count = np.zeros((len(keys), SYMBOLS))
    np.add.at(count, (node, symbol), n)
    seen = count > 0
    longer = np.full((len(keys), SYMBOLS), -1, np.int32)
    orders, contexts = keys // span, keys % span
    # lower[u, s]: log probability of s below node u, with all that u has seen excluded.
    lower = np.zeros((len(keys), SYMBOLS), np.float32)
    logp = np.zeros((len(keys), SYMBOLS), np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        lower[0] = -np.log(max(1, SYMBOLS - int(seen[0].sum())))
        for k in range(ORDER + 1):
            all_own = np.flatnonzero(orders == k)
            # A thousand at a time, so that little is held besides the tables.
            for own in np.array_split(all_own, 1 + len(all_own) // 1000):
                if k:
                    up = np.searchsorted(keys, (k - 1) * span + contexts[own] % SYMBOLS ** (k - 1))
                    longer[up, contexts[own] // SYMBOLS ** (k - 1)] = own
                    left = np.where(seen[own], 0, count[up])
                    total, kinds = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
                    escape = np.where(kinds > 0, np.log(kinds / (total + kinds)), 0.0)
                    lower[own] = np.where(left > 0, np.log(left / (total + kinds)), escape + lower[up])
                total, kinds = count[own].sum(1, keepdims=True), seen[own].sum(1, keepdims=True)
                escape = np.where(kinds > 0, np.log(kinds / (total + kinds)), 0.0)
                value = np.where(seen[own], np.log(count[own] / (total + kinds)), escape + lower[own])
                logp[own] = value / np.log(10)
    return Trie(longer, logp)


def seen_grams(symbols: DataFrame) -> DataFrame:
    """Rows (gram, n, logp) of all grams of the training documents: no escape is needed."""
    whole = W.partitionBy("context")  # at most SYMBOLS rows
    top = symbols.filter(F.col("order") == ORDER).select(
        (F.col("context") * SYMBOLS + F.col("symbol")).alias("gram"),
        "n",
        (F.sum("n").over(whole) + F.count("*").over(whole)).alias("mass"),
    )
    return settle(top.select("gram", "n", F.log10(F.col("n") / F.col("mass")).alias("logp")), "ppm-grams")


def _known(levels: DataFrame, table: DataFrame, on: list[str], low: int) -> DataFrame:
    """A left join in which the few contexts up to ``low``, where all grams meet, are broadcast."""
    few, many = F.col("order") <= low, F.col("order") > low
    return (
        levels.filter(few)
        .join(F.broadcast(table.filter(few)), on, "left")
        .unionByName(levels.filter(many).join(table.filter(many), on, "left"))
    )


def unseen_grams(grams: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (gram, logp) of distinct grams, none of them in the training documents.

    A context's symbols are among those of its suffixes, so what an escape excludes is what
    the next longer context has seen. ``covered`` is how often its suffix saw these: the
    counts of a suffix are the sums of those of the contexts one symbol longer.
    """
    power = F.pow(F.lit(float(SYMBOLS)), F.greatest(F.col("order") - 1, F.lit(0))).cast("long")
    parent = W.partitionBy("order", F.col("context") % power, "symbol")  # at most SYMBOLS rows
    stats = (
        symbols.withColumn("up", F.sum("n").over(parent))
        .groupBy("order", "context")
        .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("up").alias("covered"))
    )
    named = grams.withColumn("of", F.col("gram"))
    levels = _known(_suffixes(named, "of"), symbols, ["order", "context", "symbol"], 1)
    levels = _known(levels, stats, ["order", "context"], 2)
    wide = levels.groupBy("of").agg(
        *[
            F.max(F.when(F.col("order") == k, F.col(c))).alias(f"{c}{k}")
            for k in range(ORDER + 1)
            for c in ("n", "total", "kinds", "covered")
        ]
    )

    def log_ratio(part: Column, whole: Column) -> Column:
        return F.ln(part.cast("double")) - F.ln(whole.cast("double"))

    zero = F.lit(0.0)
    for k in range(ORDER + 1):
        n, total, kinds, covered = (F.col(f"{c}{k}") for c in ("n", "total", "kinds", "covered"))
        # low: below this context, without what it has seen. logp: from this context on.
        if k == 0:
            known = F.coalesce(kinds, F.lit(0))
            low = -F.ln(F.greatest(F.lit(SYMBOLS) - known, F.lit(1)).cast("double"))
            shorter = low
        else:
            up = F.col(f"n{k - 1}")
            left_kinds = F.col(f"kinds{k - 1}") - kinds
            mass = F.col(f"total{k - 1}") - covered + left_kinds
            escape = F.when(left_kinds > 0, log_ratio(left_kinds, mass)).otherwise(zero)
            low = F.when(up.isNotNull(), log_ratio(up, mass)).otherwise(escape + F.col(f"low{k - 1}"))
            shorter = F.col(f"logp{k - 1}")
        wide = wide.withColumn(f"low{k}", low)
        wide = wide.withColumn(
            f"logp{k}",
            F.when(total.isNull(), shorter)
            .when(n.isNotNull(), log_ratio(n, total + kinds))
            .otherwise(log_ratio(kinds, total + kinds) + F.col(f"low{k}")),
        )
    return wide.select(F.col("of").alias("gram"), (F.col(f"logp{ORDER}") / math.log(10)).alias("logp"))


def _listed(
    rows: int, row: np.ndarray, item: np.ndarray, values: pa.Array, names: list[str]
) -> pa.ListArray:
    """For each row its distinct items, as numbers of ``values``, with how often each occurs."""
    kinds = len(values) + 1
    pair, times = np.unique(row * kinds + item, return_counts=True)
    cuts = np.searchsorted(pair // kinds, np.arange(rows + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([values.take(pa.array(pair % kinds)), pa.array(times)], names)
    return pa.ListArray.from_arrays(pa.array(cuts), items)


def score(
    docs: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    nodes: int = NODES,
    common: int = COMMON_WORDS,
    common_grams: int = COMMON_GRAMS,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from the rows that ``train`` marks and scores all rows. ``score`` is the
    log10 probability of the text's bytes and its end; ``base_score`` that of its words
    (A to Z lowered) and one end, by add-one counts of all training words.

    Counts of the ``common`` most frequent words go to every task; the other words of each
    document are joined with their counts, so both give the same exact sums. Likewise the
    ``nodes`` most frequent contexts and the ``common_grams`` most frequent grams go to every
    task, and the other grams of each document are joined with the table of all contexts.

    A null text is empty: one token, the end. Without training rows all words are unknown
    and bytes are uniform. Repeated rows are scored each for itself; an empty table gives an
    empty table. Other columns are left out.
    """
    spark = docs.sparkSession
    counts = training_counts(docs, text_col, F.coalesce(train, F.lit(False)))
    words = counts.filter("word IS NOT NULL").select("word", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("gram") % SYMBOLS == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_train, kinds = totals[0] + ends, totals[1] + (ends > 0)
    known = frequent(words, "n", common).toArrow().combine_chunks()
    symbols = symbol_counts(counts)
    seen = seen_grams(symbols)
    listed = frequent(seen, "n", common_grams).select("gram", "logp").toArrow()
    grams, logs = listed.column("gram").to_numpy(), listed.column("logp").to_numpy()
    order = np.argsort(grams)
    model = spark.sparkContext.broadcast(
        (
            _trie(symbols, nodes),
            # The last is greater than every gram.
            np.append(grams[order], np.iinfo(np.int64).max),
            np.append(logs[order], 0.0),
            pa.array(known.column("word").to_pylist(), pa.string()),
            known.column("n").to_numpy().astype(np.float64),
        )
    )
    below = float(np.log10(n_train + kinds + 1))
    end_log = float(np.log10(ends + 1))
    added = (
        "_ppm_row long, _ppm_train boolean, n_tokens long, _ppm_known long, _ppm_sum double, score double, "
        "_ppm_rare array<struct<word:string,times:long>>, _ppm_grams array<struct<gram:long,times:long>>"
    )
    names = [f.name for f in T.StructType.fromDDL(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gram_list, gram_logs, common_words, common_counts = model.value
        logs = np.append(np.log10(common_counts + 1), 0.0)
        for batch in batches:
            for piece in hashing.slices(batch, 3, SCORED_BYTES):
                text = piece.column(3)
                stream, begins, at = byte_stream(text)
                logp, whole = trie.score(stream, at)
                rest = np.flatnonzero(~whole)
                kinds, kind = np.unique(gram_keys(stream, at[rest]), return_inverse=True)
                place = np.searchsorted(gram_list, kinds)
                hit = gram_list[place] == kinds
                logp = logp.astype(np.float64)
                logp[rest] = np.where(hit, gram_logs[place], 0.0)[kind]
                away = np.flatnonzero(~hit[kind])
                row = np.searchsorted(begins, at[rest[away]], "right") - 1
                rare_grams = _listed(piece.num_rows, row, kind[away], pa.array(kinds), ["gram", "times"])
                by_place = np.zeros(len(stream) + 1)
                by_place[at + 1] = logp
                sums = np.cumsum(by_place)
                scores = sums[begins[1:]] - sums[begins[:-1]]
                bounds, tokens = hashing.split_words(lowered(text))
                coded = tokens.dictionary_encode()
                found = pc.index_in(coded.dictionary, common_words).fill_null(-1).to_numpy(zero_copy_only=False)
                word = coded.indices.to_numpy()
                place = found[word] if len(word) else np.zeros(0, np.int64)
                hits = np.concatenate([[0], np.cumsum(place >= 0)])
                value = np.concatenate([[0.0], np.cumsum(logs[place])])
                rare = np.flatnonzero(place < 0)
                row = np.searchsorted(bounds, rare, "right") - 1
                rare_words = _listed(piece.num_rows, row, word[rare], coded.dictionary, ["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        piece.column(1),
                        piece.column(2),
                        pa.array(np.diff(bounds) + 1),
                        pa.array(hits[bounds[1:]] - hits[bounds[:-1]]),
                        pa.array(value[bounds[1:]] - value[bounds[:-1]]),
                        pa.array(scores),
                        rare_words,
                        rare_grams,
                    ],
                    [id_col, *names],
                )

    given = docs.select(
        F.col(id_col),
        F.monotonically_increasing_id().alias("_ppm_row"),
        F.coalesce(train, F.lit(False)).alias("_ppm_train"),
        F.col(text_col),
    )
    # Written once, so that row numbers stay what they are.
    scored = settle(given.mapInArrow(run, schema_with(docs, [id_col], added)), "ppm-scores")
    rare = scored.select("_ppm_row", F.inline("_ppm_rare")).join(words, "word")
    sums = rare.groupBy(F.col("_ppm_row").alias("_ppm_at")).agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("value")
    )
    joined = scored.drop("_ppm_rare", "_ppm_grams").join(sums, F.col("_ppm_row") == F.col("_ppm_at"), "left")
    # All grams of training documents are in the table.
    asked = scored.select("_ppm_row", "_ppm_train", F.inline("_ppm_grams"))
    new = asked.filter(~F.col("_ppm_train")).select("gram").distinct().join(seen, "gram", "left_anti")
    every = seen.select("gram", "logp").unionByName(unseen_grams(settle(new, "ppm-new-grams"), symbols))
    more = asked.join(every, "gram").groupBy(F.col("_ppm_row").alias("_ppm_of")).agg(
        F.sum(F.col("times") * F.col("logp")).alias("_ppm_more")
    )
    joined = joined.join(more, F.col("_ppm_row") == F.col("_ppm_of"), "left")
    zero = F.lit(0)
    return joined.select(
        F.col(id_col),
        "n_tokens",
        (F.col("_ppm_known") + F.coalesce("more", zero) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (
            F.col("_ppm_sum") + F.coalesce("value", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(below)
        ).alias("base_score"),
        (F.col("score") + F.coalesce("_ppm_more", F.lit(0.0))).alias("score"),
    )
