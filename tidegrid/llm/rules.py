"""Quality rules: base limits and a likelihood ratio between a trusted and the raw corpus.

Words, word pairs and runs of signs are hashed into buckets. Two multinomials over the buckets, one of
trusted documents and one of the whole corpus, give each bucket a log ratio; a document's
verdict is the mean ratio of its n-grams against a fixed threshold, without sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.keys import BROADCAST_CELLS, broadcast_if_small
from tidegrid.llm.common import SPACE, free_name, settle, with_struct

WINDOW = 8  # words of a repeated window
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words within repeated windows
SIGN_RUN = r"[^\p{L}\p{N}\s]+"
SYMBOLS = r"[#*$%&|<>]"
WHITE = " \t\n\x0b\f\r"

BUCKETS = 1 << 15
SMOOTHING = 1.0
THRESHOLD = -0.3
# Ids of trusted documents that are broadcast at once; more are taken in blocks.
BLOCK_IDS = BROADCAST_CELLS // 2


def _words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _tail(array: Column, skip: int, length: Column) -> Column:
    return F.slice(array, F.lit(skip + 1), F.greatest(length, F.lit(0)))


def _paired(array: Column, gap: int) -> Column:
    """Hashes of elements ``gap`` apart."""
    n = F.size(array) - gap
    return F.zip_with(_tail(array, 0, n), _tail(array, gap, n), lambda a, b: F.xxhash64(a, b))


def _grams(df: DataFrame, text_col: str, stem: str) -> tuple[DataFrame, str, str, str]:
    """Adds the hashes of words, of word pairs and of runs of signs."""
    one, two, signs = (free_name(df, f"{stem}_{c}") for c in ("one", "two", "signs"))
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SIGN_RUN), F.lit(0))
    df = df.withColumn(signs, F.transform(runs, lambda r: F.xxhash64(r)))
    df = df.withColumn(one, F.transform(_words(F.col(text_col)), lambda w: F.xxhash64(w)))
    return df.withColumn(two, _paired(F.col(one), 1)), one, two, signs


def corpus_ratios(
    docs: DataFrame, trusted: Column, *, text_col: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """One row, ``ratios``: the log ratio of every bucket, from all documents.

    ``trusted`` marks the documents of the target multinomial. Both multinomials are
    smoothed by one count per bucket, and raw counts leave out one occurrence, the judged
    one: what only its own document has says nothing. Without any n-gram all ratios are 0.
    """
    return _ratios(_bucket_counts(docs, trusted, text_col, buckets), buckets)


def _bucket_counts(docs: DataFrame, trusted: Column, text_col: str, buckets: int) -> DataFrame:
    """Rows (bucket, raw, target): n-grams of all documents and of the trusted ones."""
    mark = free_name(docs, "_rule_trusted")
    rows = docs.withColumn(mark, F.coalesce(trusted, F.lit(False)))
    rows, one, two, signs = _grams(rows, text_col, "_rule")
    return (
        rows.select(mark, F.explode(F.concat(one, two, signs)).alias("gram"))
        .select(
            F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket"),
            F.col(mark).cast("long").alias("hit"),
        )
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("hit").alias("target"))
    )


def _ratios(counts: DataFrame, buckets: int) -> DataFrame:
    # At most ``buckets`` rows, whatever the corpus.
    table = F.array_sort(F.collect_list(F.struct("bucket", "raw", "target")))
    sums = counts.agg(
        table.alias("seen"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("target"),
    )
    shift = F.log((F.col("target") + SMOOTHING * buckets) / (F.col("raw") + SMOOTHING * buckets))
    # Buckets without n-grams have the ratio of two pure smoothing counts.
    return sums.select("seen", shift.alias("shift")).select(
        F.expr(
            f"""transform(
                  array_sort(concat(
                    transform(seen, s -> struct(s.bucket AS bucket,
                      ln((s.target + {SMOOTHING}D) / (s.raw - 1 + {SMOOTHING}D)) - shift AS ratio)),
                    transform(array_except(sequence(0, {buckets - 1}), transform(seen, s -> s.bucket)),
                      b -> struct(b AS bucket, -shift AS ratio)))),
                  s -> s.ratio)"""
        ).alias("ratios")
    )


def _covered(sorted_starts: Column) -> Column:
    """Words within windows that begin at these places, ascending."""
    n = F.size(sorted_starts)
    steps = F.zip_with(
        _tail(sorted_starts, 0, n - 1),
        _tail(sorted_starts, 1, n - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    return F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)


def _repeated(windows: Column) -> Column:
    """Number of words in windows that occur more than once. Only for texts that have such."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    # Neighbours in hash order: a window repeats if it equals the one before or after it.
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(_tail(placed, 0, n - 1), lambda s: s["h"]))
    after = F.concat(F.transform(_tail(placed, 1, n - 1), lambda s: s["h"]), F.array(F.lit(None).cast("bigint")))
    flagged = F.zip_with(
        F.zip_with(
            placed,
            before,
            lambda s, h: F.struct(s["i"].alias("i"), s["h"].alias("h"), s["h"].eqNullSafe(h).alias("f")),
        ),
        after,
        lambda s, h: F.when(s["f"] | s["h"].eqNullSafe(h), s["i"]),
    )
    return _covered(F.array_sort(F.array_compact(flagged)))


def judge(
    docs: DataFrame,
    ratios: DataFrame,
    *,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    out: str = "rules",
) -> DataFrame:
    """Every row of ``docs`` with a struct ``out``: the base figures, mean_ratio and kept.

    Repeated windows are compared by 64-bit hashes within one text. ``kept`` is false where
    a base limit fails, else whether the mean ratio reaches ``threshold``. Null and empty
    texts have no words and fail the base limits; each row is judged by itself, so repeated
    rows and ties get equal verdicts. An empty table gives an empty table; an existing
    column ``out`` is replaced. The result may be filtered on: figures are computed once.
    """
    rows, one, two, signs = _grams(docs, text_col, "_rule")
    four, eight, table, words = (
        free_name(docs, f"_rule_{c}") for c in ("four", "eight", "table", "words")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.withColumn(four, _paired(F.col(two), 2)).withColumn(eight, _paired(F.col(four), 4))
    rows = rows.withColumn(table, ratios.scalar())
    n = F.size(F.col(one)).cast("long")
    has_repeats = F.size(F.array_distinct(F.col(eight))) < F.size(F.col(eight))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    total = F.aggregate(
        F.concat(one, two, signs),
        F.lit(0.0),
        lambda sum_, g: sum_ + F.get(F.col(table), F.pmod(g, F.lit(buckets)).cast("int")),
    )
    figures, lined, summed = (free_name(docs, f"_rule_{c}") for c in ("fig", "lines", "sum"))
    rows = rows.withColumn(lined, lines).withColumn(summed, total)
    rows = with_struct(
        rows,
        figures,
        n_words=n,
        word_chars=F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        n_symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size(lined) - F.size(F.array_distinct(lined))).cast("long"),
        n_repeat_words=F.when(has_repeats, _repeated(F.col(eight))).otherwise(F.lit(0)).cast("long"),
        mean_ratio=F.col(summed) / F.greatest(F.size(one) + F.size(two) + F.size(signs), F.lit(1)),
    )
    f = F.col(figures)
    failed = (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    verdict = F.struct(
        *[f[c].alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_ratio"
        )],
        failed.alias("base_failed"),
        (~failed & (f["mean_ratio"] >= threshold)).alias("kept"),
    )
    # A generated column: filters on it stay above the figures, which are computed once.
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.explode_outer(F.array(verdict)).alias(out))


def _good_ids(labels: DataFrame, key: str) -> DataFrame:
    """Every id that ``labels`` calls good: of several labels of one id the greatest counts."""
    return (
        labels.groupBy(F.col("doc_id").alias(key))
        .agg(F.max("quality").alias("q"))
        .filter((F.col("q") == 1) & F.col(key).isNotNull())
        .select(key)
    )


def labelled_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, Column]:
    """``docs`` with a mark for the trusted documents: all that ``labels`` calls good.

    A null id is never trusted. Beyond BLOCK_IDS ids Spark moves the texts to join them;
    ``trusted_ratios`` does without.
    """
    mark, key = free_name(docs, "_rule_good"), free_name(docs, "_rule_id")
    good = settle(_good_ids(labels, key), "rule-good").withColumn(mark, F.lit(True))
    joined = docs.join(broadcast_if_small(good), docs[id_col] == F.col(key), "left").drop(key)
    return joined, F.col(mark)


def trusted_ratios(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    block: int = BLOCK_IDS,
) -> DataFrame:
    """``corpus_ratios`` with every document as target that ``labels`` calls good.

    Documents and ids are taken in as many parts, by hash of the id, as make about ``block``
    ids each: these are broadcast, so no text is moved. Every part reads all texts, but
    counts its own only.
    """
    mark, key = free_name(docs, "_rule_good"), free_name(docs, "_rule_id")
    good = settle(_good_ids(labels, key), "rule-good")
    parts = max(1, -(-good.count() // block))

    def part(of: DataFrame, column: str, number: int) -> DataFrame:
        if parts == 1:
            return of
        return of.filter(F.pmod(F.xxhash64(F.lit(60), F.col(column).cast("string")), F.lit(parts)) == number)

    counts = None
    for number in range(parts):
        own = F.broadcast(part(good, key, number).withColumn(mark, F.lit(True)))
        rows = part(docs, id_col, number)
        marked = rows.join(own, rows[id_col] == F.col(key), "left").drop(key)
        counted = _bucket_counts(marked, F.col(mark), text_col, buckets)
        if parts > 1:
            # At most ``buckets`` rows; one part's ids at a time are in memory.
            counted = settle(counted, "rule-counts")
        counts = counted if counts is None else counts.unionByName(counted)
    if parts > 1:
        counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    return _ratios(counts, buckets)
