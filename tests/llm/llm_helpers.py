from __future__ import annotations

import collections
import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST = (1 << 63) - 1

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def sentence(n: int, start: int = 0) -> str:
    return " ".join(f"word{(start + i) * 7919 % 9973}" for i in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, and copies that differ a little."""
    long = sentence(9000, 50)
    base = sentence(120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n\x0b\f\r ", "en", None, 7),
        (4, base, "en", "a", len(base)),
        (5, base, "en", "b", len(base)),
        (6, " ".join(near), "en", "b", 0),
        (7, long, "de", "b", len(long)),
        (7, long, "de", "b", len(long)),
        (8, "ÄÖ ß   \U0001f642 é Σς", "de", None, 10),
        (None, base, "en", "c", 1),
        (None, None, None, None, None),
        (9, "one two three", "en", "c", 13),
        (9, "one two three four", "en", "c", 18),
        (10, sentence(80, 20) + "\n" + sentence(60, 3000), "en", "a", 1),
        (-11, sentence(70, 3000), "en", "a", 1),
        (12, "x " * 40 + "\n\nx x\nx x", "en", "a", 1),
        (13, "<|endoftext|> don't stop<|startoftext|>", "en", "a", 1),
    ]


def clash(df, *names):
    """``df`` with extra columns under names that an operator uses itself."""
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def rows_by(rows, name):
    return {r[name] for r in rows}


# --- brute force --------------------------------------------------------------------


def grams(text):
    words = (text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected_links(rows):
    sets = [grams(r.text) for r in rows]
    order = [LAST if r.doc_id is None else r.doc_id for r in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in holders[g] if j != i)
        for j, n in common.items():
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), LAST), order[i])
    groups = [least[top(i)] for i in range(len(rows))]
    return sorted(
        repr((r.doc_id, None if g == LAST else g, n)) for r, g, n in zip(rows, groups, links)
    )


def expected_cuts(rows):
    """(n_words, n_removed, digest) by row, with a null id as the greatest."""
    order = lambda r: (1 << 63) - 1 if r.doc_id is None else r.doc_id
    least: dict = {}
    for r in rows:
        words = (r.text or "").encode().split()
        for i in range(len(words) - 49):
            w = tuple(words[i : i + 50])
            least[w] = min(least.get(w, order(r)), order(r))
    out = []
    for r in rows:
        words = (r.text or "").encode().split()
        gone = set()
        for i in range(len(words) - 49):
            if least[tuple(words[i : i + 50])] < order(r):
                gone.update(range(i, i + 50))
        rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((r.doc_id, len(words), len(gone), hashlib.sha256(rest).hexdigest()))
    return sorted(map(repr, out))


def expected_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    left = float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > limit * sizes[s]}
        if not full:
            return {**target, **share}
        for s in full:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= full
    return target
