"""License scans by ordered signature rules, in Spark's own functions only.

A text's words stand each between two blanks of their own, so that matches never share a
blank and positions follow from counting blanks. A rule is tried only on texts that hold
its keyword. A found span goes if a span of equal or higher priority contains it; of equal
spans the one of higher priority, then of the earlier rule, stays.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.license_rules import LEVELS, RULES, Rule

# What separates words once A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULE = "array<struct<number:int,label:string,priority:int,score:double,keyword:string,pattern:string,base:boolean>>"
SPAN = "array<struct<first:int,last:int,priority:int,number:int,label:string,score:double,base:boolean>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_apart(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, each between two blanks; one blank if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    core = F.trim(F.regexp_replace(low, GAPS, "  "))
    return _let(core, lambda c: F.when(c == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), c, F.lit(" "))))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """The spans at which one rule matches, as word numbers from 0."""
    start = F.struct(F.lit(0).alias("blanks"), F.array().cast(SPAN).alias("spans"))
    gaps = F.transform(F.split(words, rule["pattern"], -1), _blanks)
    hits = F.transform(F.regexp_extract_all(words, rule["pattern"], 0), _blanks)

    def add(state: Column, pair: Column) -> Column:
        first = (state["blanks"] + pair["gap"]) / 2
        after = state["blanks"] + pair["gap"] + pair["hit"]
        span = F.struct(
            first.cast("int").alias("first"),
            (after / 2 - 1).cast("int").alias("last"),
            rule["priority"].alias("priority"),
            rule["number"].alias("number"),
            rule["label"].alias("label"),
            rule["score"].alias("score"),
            rule["base"].alias("base"),
        )
        return F.struct(after.alias("blanks"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return _let(
        hits,
        lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(
            F.aggregate(
                F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit")),
                start,
                add,
                lambda state: state["spans"],
            )
        ),
    )


def _outermost(spans: Column) -> Column:
    """The spans that no span of equal or higher priority contains, from left to right."""
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["first"].alias("first"), (-s["last"]).alias("end"), (-s["priority"]).alias("rank"),
                s["number"].alias("number"), s.alias("span"),
            ),
        )
    )
    # Whoever starts no later has been seen: the farthest end of each priority decides.
    none = F.array(*[F.lit(-1) for _ in range(LEVELS)])
    start = F.struct(none.alias("ends"), F.array().cast(SPAN).alias("kept"))

    def add(state: Column, item: Column) -> Column:
        span, ends = item["span"], state["ends"]
        above = F.array_max(F.slice(ends, span["priority"] + 1, LEVELS))
        return F.when(above >= span["last"], state).otherwise(
            F.struct(
                F.transform(
                    ends,
                    lambda end, i: F.when(i == span["priority"], F.greatest(end, span["last"])).otherwise(end),
                ).alias("ends"),
                F.concat(state["kept"], F.array(span)).alias("kept"),
            )
        )

    return F.aggregate(ordered, start, add, lambda state: state["kept"])


def _rule_array(rules: Sequence[Rule]) -> Column:
    """The rules as one constant; Spark folds it."""
    return F.from_json(F.lit(json.dumps([r._asdict() for r in rules])), RULE)


def scan_text(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """What the rules find in one text: a struct of n_words, base (array of spans) and spans."""
    keys = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])

    def searched(words: Column) -> Column:
        n_words = (_blanks(words) / 2).cast("long")
        present = F.array_intersect(F.split(words, " +"), keys)

        def found(held: Column) -> Column:
            tried = F.filter(_rule_array(rules), lambda r: F.array_contains(held, r["keyword"]))
            return F.when(F.size(held) == 0, F.array().cast(SPAN)).otherwise(
                F.flatten(F.transform(tried, lambda r: _places(words, r)))
            )

        return _let(
            _let(present, found),
            lambda spans: F.struct(
                n_words.alias("n_words"),
                F.filter(spans, lambda s: s["base"]).alias("base"),
                _outermost(spans).alias("spans"),
            ),
        )

    return _let(words_apart(text), searched)


def scan(docs: DataFrame, *, text_col: str = "text", out: str = "licenses", rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rows of ``docs`` with a struct ``out`` of what the rules find in the whole text.

    n_words; n_base (places of base phrases, overlapped or not), first_word and last_word
    (their least and greatest start, null without any); base_labels and labels (distinct, in
    code-point order, comma-joined; base labels always stay); score (of the surest span
    that stays, base spans included; 0 without any); spans (array of first and last word,
    priority, rule number, label, score, base), those that stay.

    A null or empty text has no words and no spans. Repeated rows are scanned each. An
    empty table gives an empty table. A column named like ``out`` is replaced. Work grows
    with the text; for a text of n spans, lists of spans are copied n times.
    """
    facts = scan_text(F.col(f"`{text_col}`"), rules)

    def digest(found: Column) -> Column:
        base, spans = found["base"], found["spans"]
        starts = F.transform(base, lambda s: s["first"].cast("long"))
        own = F.transform(base, lambda s: s["label"])
        named = F.concat(own, F.transform(spans, lambda s: s["label"]))
        sure = F.transform(F.concat(base, spans), lambda s: s["score"])
        return F.struct(
            found["n_words"].alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("labels"),
            F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
            spans.alias("spans"),
        )

    kept = docs.drop(out)
    # A generated column: filters on it stay above, so that nothing is computed twice.
    return kept.select("*", F.explode_outer(F.array(_let(facts, digest))).alias(out))
