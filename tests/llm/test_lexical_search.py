"""TPUT search against scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from codeloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    texts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    sizes = [sum(c.values()) for _, c in texts]
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(texts, sizes):
            m = 50 + (50 * n * len(texts)) // sum(sizes)
            w = {t: math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in c}
            scores.append((-sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in w), i is None, i or 0))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frames(spark, docs, items):
    one = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, h1 string")
    return one, spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, item string")


@pytest.mark.parametrize("seed, most, block", [(1, 1 << 20, 8192), (2, 1 << 20, 16), (3, 40, 64)])
def test_equals_brute_force(spark, monkeypatch, seed, most, block):
    """Also with small blocks, and with more terms and pairs than are sent at a time."""
    monkeypatch.setattr(lexical_search, "MOST", most)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('aBc')}{i}" for i in range(80)]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 79)] for _ in range(n))
    docs = [(rng.randrange(1000), draw(rng.randrange(60))) for _ in range(400)]
    docs += [(None, draw(9)), (None, None), (7, ""), (8, "..,;"), (9, vocabulary[3] * 400), (10, draw(20_000))] + [(11, "a0 a1 zz")] * 3
    items = [(i, draw(rng.randrange(1, 25))) for i in range(12)] + [(50, None), (51, "?"), (52, "never seen"), (None, draw(5)), (3, draw(4)), (60, "É é É")]
    docs += [(20, "é"), (21, "É")]
    found = got(lexical_search.search(*frames(spark, docs, items), k=5))
    assert found == brute(docs, items, 5)


def test_empty_tables(spark):
    assert lexical_search.search(*frames(spark, [], [(1, "a")])).count() == 0
    assert lexical_search.search(*frames(spark, [(1, "a")], [])).count() == 0
    assert lexical_search.search(*frames(spark, [(1, None)], [(1, None)])).count() == 0


def test_one_term_in_all_documents(spark):
    docs = [(i, "a " + "b " * (i % 7)) for i in range(300)]
    items = [(1, "a"), (2, "a b c")]
    assert got(lexical_search.search(*frames(spark, docs, items), k=50)) == brute(docs, items, 50)
