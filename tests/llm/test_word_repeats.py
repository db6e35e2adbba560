"""Repeated word spans against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from codeloom.llm import word_repeats

SCHEMA = "doc_id long, text string, r string, sha double, spans int"  # with clashing columns


def made(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, None) for i, t in rows], SCHEMA)


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) of each row; ids that are null count as largest."""
    order = lambda i: (i is None, i or 0)
    tokens = [(i, (t or "").encode().split()) for i, t in rows]
    least = defaultdict(lambda: (True, 1))
    for i, w in tokens:
        for p in range(len(w) - window + 1):
            least[tuple(w[p : p + window])] = min(least[tuple(w[p : p + window])], order(i))
    out = []
    for i, w in tokens:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < order(i):
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, window, letters", [(1, 6, "ab"), (2, 15, "ab"), (3, 50, "abcdefgh"), (4, 20, "a")])
def test_equals_brute_force(spark, seed, window, letters):
    rng = random.Random(seed)
    passages = [[rng.choice(letters) for _ in range(rng.randrange(window, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        w: list[str] = []
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "x"
            w += p[rng.randrange(len(p) // 2) :] + [rng.choice(letters) for _ in range(rng.randrange(window))]
        rows.append((rng.randrange(50), rng.choice([" ", "\t", " \n "]).join(w)))
    assert got(word_repeats.remove_repeated_words(made(spark, rows), window=window)) == brute(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    word = "y" * 3000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "z " + long + "  z"), (5, "z " + long + "  z"), (None, long), (None, long + " q"), (6, "a b c"), (7, "a b c")]
    rows += [(8, " ".join([word + "1"] * 80)), (9, " ".join([word + "2"] * 80)), (10, " ".join([word + "2"] * 60)), (-3, " ".join([word + "1"] * 50)), (11, "é " * 60), (12, "é " * 60)]
    assert got(word_repeats.remove_repeated_words(made(spark, rows))) == brute(rows, 50)
    assert word_repeats.remove_repeated_words(made(spark, [])).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"w{i % 90}" for i in range(400))
    rows = [(3, text)] * 600 + [(4, text + " end")] * 600 + [(5, "begin " + text)]
    found = got(word_repeats.remove_repeated_words(made(spark, rows)))
    assert found == brute(rows, 50)


def test_paths_are_compacted(spark):
    """Two documents share one span: it is one path, however many contexts it crosses."""
    shared = " ".join(f"s{i}" for i in range(500))
    docs = made(spark, [(1, "a " + shared + " b"), (2, "c " + shared + " d"), (3, "e f g")])
    own = docs.selectExpr("doc_id", "doc_id as doc", "xxhash64(text) as r", "text")
    word_repeats.ship(spark)
    sample = word_repeats.saved(word_repeats._sample(own, 50), "sample")
    graph = word_repeats._graph(sample, own, 50)
    assert graph.select("path").distinct().count() == 1
    found = word_repeats._occurrences(sample, graph).orderBy("doc").collect()
    assert [(r.doc, r.begin, r.n, r.repeat) for r in found] == [(1, 1, 451, False), (2, 1, 451, True)]


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(word_repeats.remove_repeated_words(docs)) == brute(rows, 50)
