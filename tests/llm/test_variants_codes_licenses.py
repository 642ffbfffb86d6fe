from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import clash
from tidegrid.llm import codes, licenses, spelling
from tidegrid.llm.license_rules import BASE, RULES, keyword, parse

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- spelling variants -----------------------------------------------------------


def counted(rows, damage=199):
    words = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(
        repr((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None)) for w, n in words.items()
    )


def invented(seed, n):
    """Words of few letters, so that many are near, in texts of their own frequencies."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    base += ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "Straßen", "strassen", "ÀÀÀÀÀÀ", "àààààà"]
    rows = []
    for i in range(n):
        picked = [w for w in base for _ in range(int(rng.paretovariate(0.7))) if rng.random() < 0.3]
        # One form leads to the next, three steps to the root.
        chain = [w for w, k in (("chainaaa", 512), ("chainaab", 64), ("chainabb", 8), ("chainbbb", 1)) for _ in range(k)]
        rows.append((i if rng.random() < 0.9 else None, " ".join(picked[:4000] + chain)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, seed):
    rows = invented(seed, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.variant_groups(docs, damage=7).collect()
    want = expected_variants(counted(rows, 7))
    assert len(want) > 100
    assert sorted(repr(tuple(r)) for r in found) == want
    assert {r.word: r.root for r in found}["chainbbb"] == "chainaaa"


def test_variants_edges(spark, edge, none):
    assert spelling.variant_groups(none).count() == 0
    own = clash(edge, "word", "n", "form", "run", "key", "h")
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    found = spelling.variant_groups(own).collect()
    assert sorted(repr(tuple(r)) for r in found) == expected_variants(counted(rows))


def test_pivots():
    assert spelling.choose_pivots([0, 1, 2], [1, 0, 5]) == (0, 2)
    assert spelling.choose_pivots([0, 1, 3, 4, 7], [9, 2, 4, 3, 3]) == (1, 4)
    with pytest.raises(ValueError):
        spelling.choose_pivots([3, 4], [1, 1])
    rng = random.Random(3)
    for _ in range(200):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        costs = [rng.randint(1, 9) for _ in places]
        cost = dict(zip(places, costs))
        pairs = [(a, b) for a in places for b in places if b >= a + 2]
        a, b = spelling.choose_pivots(places, costs)
        assert cost[a] + cost[b] == min(cost[x] + cost[y] for x, y in pairs)


# --- vector codes ----------------------------------------------------------------


def expected_codes(rows, parts=16, entries=64, rounds=2):
    """Plain squared differences, vector by vector."""
    kept = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) if kept else 0
    cuts = [width * p // parts for p in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(cuts, cuts[1:])]

    def nearest(vector, p):
        piece = vector[cuts[p] : cuts[p + 1]]
        return min((sum((x - y) ** 2 for x, y in zip(piece, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(v, p)[1]].append(v[cuts[p] : cuts[p + 1]])
            new.append(
                [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if groups[k] else e for k, e in enumerate(books[p])]
            )
        books = new
    out, by_label = [], collections.Counter()
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] += out[-1][-1]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(repr((*r, by_label[r[1]])) for r in out), hashlib.sha256(text.encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, width, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, width)], int(i) % 5) for i in range(n)]
    rows += [(3, rows[3][1], None), (3, rows[7][1], None), (None, rows[9][1], 1), rows[11]]
    return rows


@pytest.mark.parametrize(("n", "width"), [(150, 32), (20, 16), (90, 37), (70, 5)])
def test_codes_against_plain_distances(spark, n, width):
    rows = vectors(n, width)
    unusable = [(1000, None, 1), (1001, [1.0, None] * (width // 2) + [0.0] * (width % 2), 1), (-5, [float("nan")] * width, 2)]
    unusable += [(-6, [float("inf")] + [0.0] * (width - 1), 2), (-7, [], 2), (-8, [0.5] * (width + 1), 2)]
    df = spark.createDataFrame(rows + unusable, SCHEMA).repartition(5)
    coded, books = codes.compress(clash(df, "code", "error", "id", "vector", "values"))
    want, digest = expected_codes(rows)
    assert sorted(repr(tuple(r)) for r in coded.collect()) == want
    assert books.digest() == digest


def test_codes_of_blocks_and_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 7)
    monkeypatch.setattr(codes, "HOT", 3)
    rows = [(i, v, None if i and i % 2 else i) for i, v, _ in vectors(120, 16, 4)]
    coded, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    want, digest = expected_codes(rows)
    assert sorted(repr(tuple(r)) for r in coded.collect()) == want
    assert books.digest() == digest


def test_codes_edges(spark):
    coded, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    huge = spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], SCHEMA)
    rows = codes.compress(huge)[0].collect()
    assert [r.error for r in rows] == [0, 0]
    with pytest.raises(ValueError):
        codes.compress(huge, entries=257)


# --- license scans ---------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def places(words, rule):
    """Where a rule matches, searched from each word on, by joining one word more at a time."""
    found, at = [], 0
    regex = re.compile(rule.pattern)
    text = "".join(f" {w} " for w in words)
    starts = {}
    offset = 0
    for i, w in enumerate(words):
        starts[offset] = i
        offset += len(w) + 2
    starts[offset] = len(words)
    while m := regex.search(text, at):
        found.append((starts[m.start()], starts[m.end()] - 1))
        at = m.end()
    return found


def expected_scan(text, rules=RULES):
    words = words_of(text)
    spans = [(*p, r) for r in rules for p in places(words, r)]
    kept = []
    for a, b, r in spans:
        hidden = any(
            x <= a and b <= y and o.priority >= r.priority and (x < a or y > b or (-o.priority, o.number) < (-r.priority, r.number))
            for x, y, o in spans
        )
        if not hidden:
            kept.append((a, b, r))
    base = [s for s in spans if s[2].base]
    starts = [s[0] for s in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({s[2].label for s in base})),
        ",".join(sorted({s[2].label for s in base + kept})),
        max((s[2].score for s in base + kept), default=0.0),
        sorted((a, b, r.number) for a, b, r in kept),
    )


LICENSED = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); CC-BY-NC, cc by nc 4.0",
    "under the mit license under the mit license UNDER THE MIT LICENSE",
    "This work is licensed under the GNU General Public License, version 3 or later. All rights reserved.",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software",
    "gplgpl mité license é licensed under",
    "Creative Commons Attribution-NonCommercial-ShareAlike; creative commons attribution noncommercial",
    "the mit license " * 300,
    "mit Ünder the MIT licenseé Tous droits réservés",
    "cc by nc cc by nc nd cc by",
]


def shown(row):
    r = row.licenses
    spans = sorted((s.first, s.last, s.number) for s in r.spans)
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, spans)


def test_scan_against_all_rules(spark, edge):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(extra)
    rows = licenses.scan(clash(docs, "words", "spans", "n_words", "Licenses")).collect()
    assert len(rows) == docs.count() and rows[0].words == "own words" and rows[0].n_words == "own n_words"
    for r in rows:
        assert shown(r) == expected_scan(r.text), (r.text or "")[:80]
    assert any(r.licenses.labels != r.licenses.base_labels for r in rows)


def test_scan_tells_versions_apart(spark):
    def labels(text):
        df = spark.createDataFrame([(text,)], "text string")
        return licenses.scan(df).first().licenses.labels

    assert labels("GNU Lesser General Public License version 2.1") == "lgpl-2.1"
    assert labels("licensed under the Apache License, Version 2.0") == "apache-2,apache-2.0"
    assert labels("creativecommons.org/licenses/by-sa/4.0/") == "cc-by-sa-4.0"
    assert labels("the modified BSD license") == "bsd-3-clause"


def test_scan_reads_no_rule_without_its_keyword():
    assert len(RULES) > 200 and [r.label for r in RULES[:3]] == [label for label, _ in BASE]
    for rule in RULES:
        assert rule.pattern.startswith(" ") and rule.pattern.endswith(" ")
        re.compile(rule.pattern)
    assert keyword("(?:the )?lgpl") == "lgpl"
    assert keyword("share ?alike gpl(?: 3)?") == "gpl"
    assert keyword("the mit licen[cs]e 2 0 deriv(?:s|atives)?") == "the"
    with pytest.raises(ValueError):
        keyword("(?:a|b) c?")
    assert parse("x 1 0.5 some words")[-1].keyword == "words"


def test_scan_edges(none, spark):
    assert licenses.scan(none).count() == 0
    plan = licenses.scan(spark.createDataFrame([("x",)], "text string")).filter("licenses.n_base > 0")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace") == 1  # a filter does not repeat the scan


def test_scan_uses_no_python(spark):
    plan = licenses.scan(spark.createDataFrame([("x",)], "text string"))
    assert "Python" not in plan._jdf.queryExecution().toString() and F is not None
