"""Near duplicates, fingerprints, language model, classifier and archive."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import LAST, clash, expected_links, sentence
from pyspark.sql import functions as F

from tidegrid.llm import classifier, fingerprints, jaccard, ppm, warc
from tidegrid.llm.common import residue
from tidegrid.llm.components import components


# --- n-gram Jaccard join -------------------------------------------------------------


def near_copies(n, size=200):
    """One text in ``n`` versions, each with another word changed."""
    base = sentence(size).split(" ")
    return [
        (i, " ".join(base[: 5 + i % (size - 10)] + [f"new{i}"] + base[6 + i % (size - 10) :])) for i in range(n)
    ]


def test_links(spark, given, edge):
    versions = spark.createDataFrame(near_copies(90), "doc_id long, text string")
    for docs, block in ((given, 512), (edge, 512), (versions, 16)):
        rows = jaccard.link_documents(docs, block=block).collect()
        got = sorted(repr((r.doc_id, r.group_id, r.n_links)) for r in rows)
        assert got == expected_links(docs.select("doc_id", "text").collect())
    assert {r.n_links for r in rows} == {89}


def test_keep_one(spark, edge, given, none):
    base = sentence(160).split(" ")
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (30, 50, 70)]
    rows = [(None, t) for t in near] + [(7, t + " x") for t in near[:2]] + [(8, sentence(90, 400))] * 2
    alike = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("o", "h", "node", "O_K", "h_k", "_one_o", "_one_ok", "_one_hk", "group_id", "group_hash")
    for docs in (edge, given, alike):
        kept = jaccard.keep_one(clash(docs, *names))
        assert kept.columns == [*docs.columns, *names]
        groups = jaccard.link_documents(docs).collect()
        least = {(r.group_id, r.group_hash) for r in groups}
        seen = {(r.doc_id, r.text_hash) for r in groups}
        assert least <= seen
        assert sorted(map(repr, ((r.doc_id,) for r in kept.collect()))) == sorted(repr((i,)) for i, _ in least)
    assert {r.doc_id for r in kept.collect()} == {7, 8} and kept.count() == 2
    assert jaccard.keep_one(none).count() == 0
    assert jaccard.link_documents(none).count() == 0


def test_posterior_drops_little():
    least = jaccard.least_matches()
    assert sorted(least) == [32, 64, 96, 128, 160]
    for n, agreed in least.items():
        lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(agreed))
        assert lost < 1e-5


def test_intersections_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 100).astype(np.uint64)) for _ in range(30)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    dense = jaccard.intersections(sets, a, b)
    assert dense.tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert jaccard.intersections(sets, a[:5], b[:5]).tolist() == dense[:5].tolist()


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (250, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 300: 200, 250: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- fingerprints --------------------------------------------------------------------


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    out = []
    for i, r in enumerate(order):
        text, after = r.text or "", order[(i + 1) % len(order)].text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        out.append(repr((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())))
    return sorted(out)


def test_edits_and_likeness(given, edge):
    for docs in (given, edge):
        rows = fingerprints.compare_with_next(clash(docs, "bucket", "guest"), buckets=5).collect()
        assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in rows) == expected_edits(docs.collect())
        prints = collections.defaultdict(set)
        texts = {(r.doc_id, len(r.text or "")): r.text or "" for r in docs.collect()}
        for r in rows:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            prints[texts[(r.doc_id, r.n_chars)]].add(r.fingerprint)
        assert all(len(p) == 1 for p in prints.values())
    long = [r for r in fingerprints.compare_with_next(given).collect() if r.n_chars > 600]
    assert 0.55 < np.mean([r.near_edited for r in long]) < 0.8
    assert np.median([r.near_next for r in long]) < 0.05


def test_likeness_follows_edits():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghij klmnop"), 4000))
    changed = list(text)
    for at in sorted(rng.integers(0, 4000, 20), reverse=True):
        changed[at : at + 1] = ["zz"] if at % 2 else []
    far = "".join(rng.choice(list("abcdefghij klmnop"), 4000))
    own, near, other = fingerprints.fingerprints([text, "".join(changed), far])
    assert fingerprints.likeness(own, own) == 1
    assert fingerprints.likeness(own, near) > 0.5 > fingerprints.likeness(own, other) + 0.3


def test_walk_is_the_same_alone_and_together():
    texts = ["", "a", "abc" * 50, None, "x" * 3000, "\U0001f642é"]
    together = fingerprints.fingerprints(texts)
    assert together == [fingerprints.fingerprints([t])[0] for t in texts]
    assert together[0] == together[3] == "" and fingerprints.likeness("", "") == 1


def edited(text, rng, edits):
    out = list(text)
    for at in sorted(rng.integers(0, len(out), edits).tolist(), reverse=True):
        out[at : at + 1] = [["zz"], [], ["q"]][at % 3]
    return "".join(out)


def expected_print_groups(rows, least):
    """Connected components of all pairs of fingerprints, without bands."""
    prints = fingerprints.fingerprints([r[1] for r in rows])
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if prints[i] and prints[j] and fingerprints.likeness(prints[i], prints[j]) >= least:
                top[max(find(i), find(j))] = min(find(i), find(j))
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(LAST if r[0] is None else r[0])
    groups = [min(ids[find(i)]) for i in range(len(rows))]
    return [None if g == LAST else g for g in groups]


@pytest.mark.parametrize("block", [512, 16])
def test_print_groups_miss_few_links(spark, given, block):
    """Against all pairs: nothing is linked that should not be, and at least nine tenths of the links are found."""
    rng = np.random.default_rng(8)
    rows = [(r.doc_id, r.text) for r in given.collect()]
    letters = list("abcdefghij klmnop")
    for k in range(40):
        text = "".join(rng.choice(letters, int(rng.integers(200, 6000))))
        rows += [(10_000 + 100 * k + c, edited(text, rng, int(rng.integers(0, 1 + len(text) // 150)))) for c in range(4)]
    base = "".join(rng.choice(letters, 1500))
    rows += [(20_000 + c, base[:-1] + letters[c % 17] + str(c)) for c in range(60)]
    rows += [(None, base), (None, None), (30_000, ""), (30_001, None), (5, base + "!"), (5, base + "?")]
    found = fingerprints.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = collections.Counter((i, g) for (i, _), g in zip(rows, expected_print_groups(rows, fingerprints.LEAST_LIKENESS)))
    got = collections.Counter((r.doc_id, r.group_id) for r in found)
    assert sum(got.values()) == len(rows)
    linked = {k: n for k, n in want.items() if k[0] != k[1]}
    assert sum(linked.values()) > 100
    hits = sum(min(n, got[k]) for k, n in linked.items())
    assert hits >= 0.9 * sum(linked.values())
    assert got[(20_059, 5)] == 1 and got[(None, 5)] == 1 and got[(None, None)] == 1 and got[(30_000, 30_000)] == 1
    # What bands miss can only split groups, never join unlike ones.
    joined = {(i, g) for (i, g) in got if i != g}
    assert len(joined - set(want)) <= 0.1 * len(joined)


def naive_walk(text):
    """The walk step by step: the place in the text at each step until it ends."""
    rng = np.random.default_rng(100)
    moves = rng.integers(0, 2, (fingerprints.CLASSES, 2 * fingerprints.PERIOD), dtype=np.uint8)
    places, at, step = [], 0, 0
    while at < len(text):
        places.append(at)
        at += int(moves[ord(text[at]) % fingerprints.CLASSES, step % fingerprints.PERIOD])
        step += 1
    return places


def test_walk_against_single_steps():
    for text in ("a", "hello world " * 30, "\U0001f642é" * 700, "aaaaab" * 1000):
        places = naive_walk(text)
        (steps,) = fingerprints._walk([fingerprints.codes(text)])
        assert steps[-1] == len(places)
        assert [int(np.searchsorted(steps, s, "right") - 1) for s in range(len(places))] == places
        (print_,) = fingerprints.fingerprints([text])
        wanted = fingerprints.STEPS[: len(print_)]
        assert [c == "." for c in print_] == [s >= len(places) for s in wanted.tolist()]


def test_fingerprint_edges(none, spark):
    assert fingerprints.compare_with_next(none).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    row = fingerprints.compare_with_next(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1
    groups = fingerprints.near_groups(
        spark.createDataFrame(
            [(1, "a" * 50 + sentence(90)), (2, "a" * 50 + sentence(90) + "!"), (3, sentence(90, 4000)), (4, None)],
            "doc_id long, text string",
        )
    )
    assert {r.doc_id: r.group_id for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


# --- language model ------------------------------------------------------------------


def expected_base(rows, trained):
    def tokens(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]

    count = collections.Counter()
    for r in rows:
        if trained(r):
            count.update(tokens(r.text))
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
        yield r.doc_id, len(own), sum(count[t] > 0 for t in own), n, round(base, 5)


@pytest.mark.parametrize("common", [20, 1 << 19])
def test_base_scores(given, edge, common):
    for docs in (given, edge):
        train = residue("doc_id", 7) != 2
        got = [
            (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
            for r in ppm.score(docs, train, common=common, nodes=500).collect()
        ]
        text = lambda r: "" if r.doc_id is None else str(r.doc_id)
        theirs = list(expected_base(docs.collect(), lambda r: zlib.crc32(text(r).encode()) % 7 != 2))
        assert len(got) == len(theirs)
        for a, b in zip(sorted(got, key=repr), sorted(theirs, key=repr)):
            assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-4


def by_hand(texts, order):
    """Prediction by partial matching, symbol by symbol, with method C and exclusion."""
    table = collections.defaultdict(collections.Counter)

    def symbols(text):
        return [ppm.END] * order + list(text.encode()) + [ppm.END]

    for t in texts:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                table[tuple(s[i - k : i])][s[i]] += 1

    def score(text):
        s, total = symbols(text), 0.0
        for i in range(order, len(s)):
            gone: set = set()
            for k in range(order, -1, -1):
                seen = table.get(tuple(s[i - k : i]))
                if seen is None:
                    continue
                left = {x: n for x, n in seen.items() if x not in gone}
                if left:
                    mass = sum(left.values()) + len(left)
                    if s[i] in left:
                        total += math.log10(left[s[i]] / mass)
                        break
                    total += math.log10(len(left) / mass)
                gone |= set(seen)
            else:
                total += math.log10(1 / (ppm.SYMBOLS - len(gone)))
        return total

    return score


def test_ppm_equals_hand_count(spark):
    texts = ["abracadabra", "abc abc abd", "", "zéro été", "abra" * 5]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate([*texts, "cadabra zzz", None, "été\x00"])], "doc_id long, text string"
    )
    score = by_hand(texts, ppm.ORDER)
    for r in ppm.score(docs, F.col("doc_id") < 5).join(docs, "doc_id").collect():
        assert r.score == pytest.approx(score(r.text or ""), abs=1e-4), r.text


@pytest.mark.parametrize("nodes, common_grams", [(0, 0), (1, 5), (40, 20), (0, 1 << 20)])
def test_ppm_bounds_change_no_score(spark, nodes, common_grams):
    """Every context counts, whatever goes to each task."""
    texts = ["abracadabra", "abc abc abd", "", "zéro été", "abra" * 5, "the rarest of rare contexts"]
    more = [*texts, "cadabra zzz", None, "été\x00", "contexts of the rarest brac"]
    docs = spark.createDataFrame([*enumerate(more), (20, "rare zéro abd")], "doc_id long, text string")
    expected = by_hand(texts, ppm.ORDER)
    scored = ppm.score(docs, F.col("doc_id") < len(texts), nodes=nodes, common_grams=common_grams)
    rows = scored.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.score == pytest.approx(expected(r.text or ""), abs=1e-4), r.text


def test_ppm_rows_are_distributions(given):
    trie = ppm.trie_of(ppm.training_counts(given, "text", F.lit(True)), nodes=300)
    assert np.abs((10.0 ** trie.logp.astype(float)).sum(1) - 1).max() < 1e-5
    assert 100 < len(trie.logp) <= 300


def test_ppm_prefers_its_language(given):
    rows = ppm.score(given, F.lit(True)).collect()
    sizes = {r.doc_id: len(r.text.encode()) + 1 for r in given.collect()}
    bits = -sum(r.score for r in rows) * math.log2(10) / sum(sizes[r.doc_id] for r in rows)
    assert bits < 3


def test_ppm_edges(none, edge):
    assert ppm.score(none, F.lit(True)).count() == 0
    rows = ppm.score(clash(edge, "n", "word", "gram"), F.lit(False)).collect()
    assert len(rows) == edge.count() and {r.n_known for r in rows} == {0}
    for r in rows:
        assert r.base_score == pytest.approx(0.0)  # N + V + 1 is 1 when nothing was learnt


# --- classifier ----------------------------------------------------------------------


def test_classifier_learns(spark):
    rows = []
    for i in range(600):
        words = sentence(40, 37 * i).split()
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if i % 3 == 0 else " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    held = residue("doc_id", 3) == 1
    scored = classifier.score_quality(docs, labels, train=~held).filter(held).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in scored]
    assert len(scored) > 100 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in scored)


def test_classifier_edges(edge, none, labels, given):
    assert classifier.score_quality(none, labels).count() == 0
    rows = classifier.score_quality(clash(edge, "score", "slice"), labels).collect()
    assert len(rows) == edge.count()
    repeated = [r.score for r in rows if r.doc_id == 7]
    assert repeated[0] == repeated[1]
    unlabelled = classifier.score_quality(given, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_temperature_is_fitted():
    """On fresh rows calibrated probabilities lose less than those of the bare logit."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, classifier.FEATURES))
    y = (rng.random(6000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = classifier.fit(x[:3000], y[:3000], epochs=20)
    own = net.temperature

    def loss(t):
        net.temperature = t
        p = net.probabilities(x[3000:])
        return -np.log(np.where(y[3000:] == 1, p, 1 - p)).mean()

    assert own != 1 and loss(own) < loss(1.0)


# --- archive -------------------------------------------------------------------------


def pages(spark):
    big, other = "<p>é</p>" * 200, "y" * 1000
    return spark.createDataFrame(
        [
            (1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (5, "http://a/5", big),
            (2, "http://b\r\nX: y", other), (4, "u", "small"), (6, "u", "small"), (7, "u", None),
            (8, "u", ""), (None, "u", other), (9, "u", "z" * 999),
        ],
        "page_id long, url string, html string",
    )


def test_archive(spark):
    given = pages(spark)
    path = warc.write_archive(clash(given, "address", "sha1", "header"), warc.fresh_archive(spark))
    rows = warc.read_archive(spark, path).collect()
    assert len(rows) == given.count()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds[(1, "revisit", 5)] == kinds[(3, "revisit", 5)] == 1
    assert kinds[(5, "response", None)] == 2
    assert kinds[(2, "response", None)] == kinds[(None, "revisit", 2)] == 1
    assert {k for k in kinds if k[0] in (4, 6, 7, 8, 9)} == {(i, "response", None) for i in (4, 6, 7, 8, 9)}
    bodies = {r.page_id: (r.html or "").encode() for r in given.collect()}
    for r in rows:
        body = bodies[r.page_id]
        assert (r.payload, r.payload_bytes) == (body, len(body))
        assert r.payload_digest == r.header_digest == hashlib.sha1(body).hexdigest()
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(block) - 4
        stored = b"" if r.record_type == "revisit" else body
        assert block == warc.HTTP_HEAD.encode() + stored + b"\r\n\r\n"
    assert spark.read.parquet(f"{path}/payloads").count() == len(set(bodies.values()))


def test_archive_finds_damage(spark):
    path = warc.write_archive(pages(spark), warc.fresh_archive(spark))
    damaged = warc.fresh_archive(spark)
    spark.read.parquet(f"{path}/records").write.parquet(f"{damaged}/records")
    spark.read.parquet(f"{path}/payloads").withColumn(
        "payload", F.concat("payload", F.lit(b"!"))
    ).write.parquet(f"{damaged}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, damaged).collect()


def test_empty_archive(spark):
    path = warc.write_archive(pages(spark).limit(0), warc.fresh_archive(spark))
    assert warc.read_archive(spark, path).count() == 0


def test_texts_of_both_layouts():
    """Arrow slices give the same streams as whole arrays."""
    texts = pa.array(["ab", None, "", "é x"])
    whole = ppm.byte_stream(texts)
    part = ppm.byte_stream(texts.slice(2))
    assert whole[0][whole[1][2] :].tolist() == part[0].tolist()


def test_word_vectors_against_a_count_by_hand(spark, edge):
    """Sums of neighbours' index vectors, word by word; the same however tasks are grouped."""
    c = classifier
    rows = [(i, "Alpha beta, beta  GAMMA-7 " * (i % 3) + sentence(20, 9 * i) + " !!") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    docs = docs.unionByName(edge.filter("length(text) < 2000 OR text IS NULL").select("doc_id", "text"))
    total = np.zeros((c.ROWS, c.DIMS))
    for row in docs.collect():
        line, before = [], None
        for word in (w.decode() for w in (row.text or "").encode().split()):
            letters, form, again = c.word_rows(word)
            line += [letters, again if word == before else form]
            before = word
        for i, own in enumerate(line):
            for j in range(max(0, i - c.REACH), min(len(line), i + c.REACH + 1)):
                if i != j and own and line[j]:
                    for k in range(c.NONZERO):
                        total[own, c.INDEX_AT[line[j], k]] += c.INDEX_SIGN[line[j], k]
    mean = total.sum(0) / np.abs(total).sum()
    total -= np.abs(total).sum(1, keepdims=True) * mean
    expected = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    for group in (1, 4, c.GROUP):
        assert np.allclose(c.word_vectors(docs, group=group), expected, atol=1e-6)

    texts = ["Alpha beta, beta GAMMA-7", None, "", "!! !! !!"]
    got = c.pooled(pa.array(texts), expected.astype(np.float32))
    for text, features in zip(texts, got):
        words = (text or "").split()
        pairs = [c.word_rows(w) for w in words]
        forms = [p[2] if i and words[i] == words[i - 1] else p[1] for i, p in enumerate(pairs)]
        want = np.zeros(c.FEATURES)
        if words:
            want[: c.DIMS] = np.mean([expected[p[0]] for p in pairs], 0)
            want[c.DIMS : 2 * c.DIMS] = np.mean([expected[f] for f in forms], 0)
            want[-2], want[-1] = np.log1p(len(words)), max(forms.count(f) for f in forms) / len(forms)
        assert np.allclose(features, want, atol=1e-5)
