"""Corpus operators against brute force on small fixtures, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

from codeloom.llm import exact_dedup, minhash_dedup, mixing, packing, quality, queries, suffix_dedup, token_counts, topk, url_filter, vocabulary, warc
from codeloom.llm._common import shared_folder

DIR = "/root/testdata/sf0.001"
JSON = queries.tokenizer_path("json")
TEXT = "doc_id long, text string, lang string, component_id string, score double"  # with clashing columns


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", None) for i, t in rows], TEXT)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(name, spark, duck):
    found = queries.queries()[name](spark, DIR).toPandas()
    wanted = duck(DIR).sql(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "abc"), (6, "A B c d"), (6, "A B c d"), (None, "a b c"), (7, "x" * 70_000), (8, "x " * 35_000)]


def test_repeated_rows_do_not_slow_suffix_dedup(spark):
    """Rows that repeat id and text cost as much as others."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(4000))
    begun = time.time()
    got = suffix_dedup.remove_repeats(docs(spark, [(1, text)] * 2000 + [(2, text[1000:] + "end")])).collect()
    assert time.time() - begun < 60
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 4000, 4000)] * 2000 + [(2, 3003, 3000)]


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_groups(none).count() == 0
    assert minhash_dedup.near_groups(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert quality.classify(none, labels).count() == 0
    assert mixing.mix(none, labels, JSON).count() == 0
    assert token_counts.count_tokens(none, JSON).count() == 0
    assert packing.pack(none, JSON).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages).count() == 0
    assert warc.read_archives(spark, warc.write_archives(pages, shared_folder(spark, "warc"))).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0").count() == 0


@pytest.mark.parametrize("hash_bits", [64, 2])
def test_exact_dedup(spark, hash_bits):
    got = exact_dedup.exact_groups(docs(spark, ODD), capacity=2, hash_bits=hash_bits).collect()
    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in ODD]
    assert len(got) == len(ODD)
    for r in got:
        n = {s for i, _, s in norm if i == r.doc_id and hashlib.sha256(s.encode()).hexdigest() == r.text_sha256}
        group = [x for x in norm if x[2] == n.copy().pop()]
        best = max(group, key=lambda x: (len(x[1]), -(x[0] if x[0] is not None else 1 << 62)))[0]
        assert (r.keep_id, r.group_size, r.kept) == (best, len(group), r.doc_id == best)


def test_the_directory_decides_where_texts_are_compared(spark):
    index, rows = exact_dedup.build_index(docs(spark, [(i, f"t {i % 40}") for i in range(200)]), capacity=4)
    found = index.collect()
    assert len(found) == 40 and len({r.bucket for r in found}) > 8 and all(r.chain == 1 and r.group_size == 5 for r in found)
    assert max(Counter(r.bucket for r in found).values()) <= 4
    bounds = {}
    for r in found:
        bounds.setdefault(r.bucket, []).append(r.hash % (1 << 64))
    ranges = sorted((min(h), max(h)) for h in bounds.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # a bucket owns one range of keys
    assert {(r.bucket, r.hash) for r in rows.collect()} == {(r.bucket, r.hash) for r in found}
    chained, _ = exact_dedup.build_index(docs(spark, [(i, f"t {i}") for i in range(30)]), capacity=4, hash_bits=2)
    chains = {}
    for r in chained.collect():
        chains.setdefault(r.hash, []).append(r.chain)
    assert len(chains) <= 4 and all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values())


@pytest.mark.parametrize("hash_bits", [64, 1])
def test_hot_hashes_have_several_owners(spark, hash_bits):
    rows = [(i, f"t {i % 3}") for i in range(90)] + [(i, f"u {i}") for i in range(100, 120)]
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(3), capacity=4, hash_bits=hash_bits, hot=7).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 3 if i < 90 else i, 30 if i < 90 else 1) for i, _ in rows}


def test_owner_tasks_compare_texts_in_the_buckets_of_the_directory(spark, monkeypatch):
    """Without the directory, one task owns all texts."""
    rows = docs(spark, [(i, f"t {i % 400}") for i in range(800)])

    def owners():
        made = {}
        monkeypatch.setattr(exact_dedup, "saved", lambda df, name: made.setdefault(name, saved_(df.withColumn("task", spark_partition_id()), name)) if name == "owned" else saved_(df, name))
        exact_dedup.build_index(rows, capacity=8)
        found = made["owned"].select("bucket", "task").distinct().collect()
        assert len({r.bucket for r in found}) == len(found)  # a bucket has one owner
        return len({r.task for r in found})

    from pyspark.sql.functions import spark_partition_id

    saved_ = exact_dedup.saved
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert owners() > 4
        monkeypatch.setattr(exact_dedup, "grow_directory", lambda counts, bits, capacity: [0] * (1 << bits))
        assert owners() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_directory_doubles_only_overfull_buckets():
    slots = exact_dedup.grow_directory({0: 5, 1: 5, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1}, 3, 5)
    assert slots == [0, 1, 2, 2, 3, 3, 3, 3]
    assert exact_dedup.grow_directory({}, 3, 5) == [0]


def near_brute(rows, width, per_cent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_dedup(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [r for r in ODD if r[0] is not None and r[0] < 7]
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    got = minhash_dedup.near_groups(docs(spark, rows), width=3, per_cent=85, bands=16).collect()
    want = near_brute(rows, 3, 85)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash_dedup.near_groups(docs(spark, ODD)).count() == len(ODD)


def test_long_structured_words_do_not_collide(spark):
    a = "ab"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {a} y z"), (2, f"x {b} y z"), (3, a), (4, b)]
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_groups(docs(spark, rows), width=3, per_cent=85, bands=16).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_pruning_keeps_what_the_bound_allows():
    fewest = minhash_dedup.fewest_matches(0.85, 1e-6, 64)
    assert sorted(fewest) == [16, 32, 48, 64] and list(fewest.values()) == sorted(fewest.values()) and fewest[64] < 0.85 * 64


def test_suffix_dedup(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocabulary, k=150)) for _ in range(3)]
    rows = [(901, None), (902, ""), (903, "a" * 1500), (904, "ab" * 300), (905, "é漢" * 300 + "x" * 399)]
    for i in range(80):
        t = " ".join(rng.choices(vocabulary, k=rng.randrange(100)))
        for p in rng.sample(passages, rng.randrange(3)):
            a = rng.choice([0, 100])
            t += p[a : a + rng.choice([399, 400, 401, 500])] + " ".join(rng.choices(vocabulary, k=rng.randrange(40)))
        rows.append((i, t))
    rows.append((950, rows[20][1]))
    seen = Counter(b[k : k + 400] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - 399))
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                covered[k : k + 400] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~covered])
        want[i] = (len(b), int(covered.sum()), int((np.diff(np.append(False, covered).astype(int)) == 1).sum()), hashlib.sha256(rest).hexdigest())
    for bucket in (4096, 3):
        got = suffix_dedup.remove_repeats(docs(spark, rows), bucket=bucket).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    wide = [(i, " ".join(rng.choices(vocabulary, k=40)) + passages[0][:600] + " ".join(rng.choices(vocabulary, k=40))) for i in range(40)]
    short = suffix_dedup.remove_repeats(docs(spark, wide), bucket=2).collect()  # every range down to single places
    assert sorted(map(tuple, short)) == sorted(map(tuple, suffix_dedup.remove_repeats(docs(spark, wide)).collect()))
    twice = suffix_dedup.remove_repeats(docs(spark, [(1, "q" * 10 + "".join(map(str, range(200)))), (1, "q" * 10 + "".join(map(str, range(200))))])).collect()
    assert [r.n_removed for r in twice] == [500, 500]


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.NET/x", "http://net/", "http://xnet/", "http://a.net?x", "http://w.Example.NET/en/1", "http://w.example.net/de/1", "http://example.com/de/", "http://b.org/fr/x?y://z", "x://y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [got[i].rule for i in range(12)] == [None, None, None, "net/", "net/", None, None, "example.net/en/", "net/", "example.com/de/", "org/fr/", None]
    assert (got[0].host, got[0].path, got[3].host, got[6].path, got[10].path) == ("", "", "a.net", "", "/fr/x")
    assert all(r.verdict in ("allow", "block") for r in got.values()) and got[7].verdict == "allow" and got[8].verdict == "block"


def test_templates(spark):
    rules = (url_filter.Rule("block", "a.com", "/de/"), url_filter.Rule("allow", "a.com", "/fr/"), url_filter.Rule("block", "a.com", "/x/1"), url_filter.Rule("block", "b.com", "/p/q/r/1"), url_filter.Rule("allow", "c.com", "/k"))
    urls = [f"http://a.com/de/{i}" for i in range(10)] + [f"http://a.com/fr/{i}" for i in range(10)] + [f"http://a.com/en/{i}" for i in range(10)]
    urls += [f"http://a.com/x/1{i}" for i in range(9)] + ["http://a.com/x/2", "http://a.com/x/3.html"]
    urls += [f"http://b.com/p/q/r/1{i}" for i in range(9)] + ["http://b.com/p/q/r/2", "http://b.com/p/q/s/2", "http://b.com/p"]
    urls += [f"http://c.com/u/{w}/post" for w in "abcdefghijkl"] + ["http://c.com/k/z"]
    urls += [None, "http://d.com/" + "a/" * 5000, "http://d.com/" + "9" * 100_000, urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)] + [(None, "http://a.com/en/5", "y", 2.0)], "page_id long, url string, template string, score double")
    got = url_filter.filter_urls(pages, rules=rules).collect()
    assert len(got) == len(urls) + 1
    of = {urls[r.page_id]: r for r in got if r.page_id is not None}
    assert all(of[f"http://a.com/en/{i}"].verdict == "allow" for i in range(10))  # labels of /de/ don't leak
    assert of["http://a.com/en/5"].template == "/en/{n}" and of["http://a.com/de/5"].template == "/de/{n}"
    assert of["http://a.com/x/2"].rule is None and of["http://a.com/x/2"].verdict == "block"  # /x/{n} is what rules block
    assert of["http://a.com/x/3.html"].verdict == "allow"
    assert of["http://b.com/p/q/r/2"].verdict == "block" and of["http://b.com/p/q/s/2"].verdict == "allow"  # the fourth level counts
    assert of["http://c.com/u/a/post"].template == "/u/{v}/post" and of["http://c.com/k/z"].template == "/k/z"
    alike = [url_filter.Rule("block", "e.com", f"/{x}/") for x in "st"]
    pages = spark.createDataFrame([(i, f"http://e.com/{'stu'[i % 3]}/{i}") for i in range(60)], "page_id long, url string")
    found = {r.path[1]: r.template for r in url_filter.filter_urls(pages, rules=tuple(alike)).collect()}
    assert found == {"s": "/*/{n}", "t": "/*/{n}", "u": "/u/{n}"}


def test_templates_learn_from_other_hosts(spark):
    """Rules on some hosts judge the same template on others, unless hosts disagree."""
    rules = (url_filter.Rule("block", "bad.net", "/"), url_filter.Rule("allow", "bad.net", "/en/"), url_filter.Rule("allow", "good.org", "/fr/"))
    urls = [f"http://{h}.bad.net/{x}/{i}" for h in "abc" for x in ("de", "en", "fr") for i in range(12)] + [f"http://{h}.good.org/fr/{i}" for h in "abc" for i in range(12)]
    asked = [f"http://{h}/{x}/5" for h in ("new.com", "a.good.org") for x in ("de", "en", "fr", "es")]
    pages = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    found = {urls[r.page_id] if r.page_id < len(urls) else asked[r.page_id - len(urls)]: r for r in url_filter.filter_urls(pages, rules=rules).collect()}
    assert {u: found[u].verdict for u in asked if found[u].rule is None} == {
        "http://new.com/de/5": "block", "http://new.com/en/5": "allow", "http://new.com/fr/5": "allow", "http://new.com/es/5": "allow",
        "http://a.good.org/de/5": "block", "http://a.good.org/en/5": "allow", "http://a.good.org/es/5": "allow",
    }


def test_some_pages_without_a_rule_are_rejected(spark):
    found = url_filter.filter_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).filter("rule is null")
    counts = Counter()
    for r in found.groupBy("verdict", "template").count().collect():
        counts[r.verdict, r.template] += r["count"]
    print(counts)
    assert counts["block", "/es/{n}"] > 50 and counts["allow", "/es/{n}"] == 0  # all rules on /es/ block it
    assert counts["block", "/en/{n}"] == 0 and counts["allow", "/en/{n}"] > 50  # rules allow it


def test_quality_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) / len(held) > 0.93
    odd = quality.classify(docs(spark, ODD), spark.createDataFrame([(4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(odd) == len(ODD) and all(r.score == pytest.approx(0.5) for r in odd)


LONG = [(50, " " * 2_000_000), (51, "x" * 2_000_000), (52, "=" * 300_000), (53, "\n" * 300_000 + "a"), (54, "ab'll  " * 40_000)]


def test_token_counts_and_prefixes(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = [*ODD, *LONG, (20, "a<|endoftext|>b  <|endoftext|>"), (21, "don't é漢🙂 \x1c\u00a0 12"), *((r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())]
    true = [(i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    got = token_counts.count_tokens(docs(spark, rows), JSON).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((*x, x[2] > 512) for x in true)
    known, rng = vocabulary.Vocabulary(JSON), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "don't", "'s", "é", "漢", "🙂", "<|endoftext|>", "1", "22", "!", "the", "\t", "\u00a0", "'re", "_", "'ll", "'", "\x1c", "\x85", "\u0301"]
    for k in range(600):
        text = "".join(rng.choices(parts if k % 2 else [p for p in parts if p.isascii()], k=rng.randrange(12)))
        steps = known.prefix_steps(text).tobytes()
        counts = [len(library.encode(text[:c], add_special_tokens=False).ids) for c in range(len(text) + 1)]
        assert [token_counts.tokens_before(steps, c) for c in range(len(text) + 1)] == counts
        budget = rng.randrange(8)
        assert token_counts.longest_within(steps, budget) == max(c for c, n in enumerate(counts) if n <= budget)


def test_stored_prefix_arrays_answer_budgets(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = [r for r in ODD if r[0] is not None and r[0] < 6] + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(40).collect()]
    stored = token_counts.prefix_counts(docs(spark, rows), JSON)
    text = dict(rows)
    for r in token_counts.over_budget(stored, 100).collect():
        t = text[r.doc_id] or ""
        count = lambda c: len(library.encode(t[:c], add_special_tokens=False).ids)  # noqa: B023, E731
        assert len(r.steps) == 2 * len(t) and r.n_tokens == count(len(t)) and r.over_limit == (r.n_tokens > 100)
        assert count(r.cut) <= 100 and all(count(c) > 100 for c in range(r.cut + 1, min(len(t), r.cut + 30) + 1))


def test_what_a_worker_remembers_changes_nothing():
    small, large = vocabulary.Vocabulary(JSON, most=2_000), vocabulary.Vocabulary(JSON)
    texts = ["one two  three\n\nfour" * 9, "five six" * 40, "é漢 " * 50, ""]
    for a, b, t in zip(small.encode(texts), large.encode(texts), texts):
        assert a.tolist() == b.tolist()
        assert small.prefix_steps(t).tolist() == large.prefix_steps(t).tolist()


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = [r for r in ODD if r[0] is not None and r[0] != 6] + LONG + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + [(30, "x<|endoftext|>y")]
    pieces = packing.pack(docs(spark, rows).coalesce(2), JSON, block_tokens=20_000).toPandas()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for i, own in pieces.sort_values("start").groupby("doc_id"):
        assert np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist() == ids[i]
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and set(own.doc_tokens) == {len(ids[i])}
    assert set(pieces.doc_id) == set(ids)
    short = 0
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        total = int(own.length.sum())
        assert total <= 2048 and total & (total - 1) == 0
        short += total < 2048
    assert short <= 11 * 2  # only the last ids of a task
    assert packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]), JSON).count() >= 4


def test_balance_against_the_stated_rule():
    rng = random.Random(4)
    for _ in range(40):
        lengths = [rng.choice([0, 1, 3, 7, 7, 20, 31]) for _ in range(rng.randrange(12))]
        rooms = [32] * (sum(lengths) // 32)
        placed, rest = packing.balance(lengths, rooms, quadratic=1 / 32)
        free, cost, left, want = list(rooms), [0.0] * len(rooms), list(lengths), []
        for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            while left[piece] and any(free):
                able = [k for k, f in enumerate(free) if f >= left[piece]] or [k for k, f in enumerate(free) if f]
                k = min(able, key=lambda k: cost[k])
                n = min(left[piece], free[k])
                want.append((piece, lengths[piece] - left[piece], n, k, 32 - free[k]))
                free[k], left[piece], cost[k] = free[k] - n, left[piece] - n, cost[k] + n + n * n / 32
        assert (placed, rest) == (want, left) and not any(free)


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 600
    pages = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", long + "WARC/1.1\r\n\r\n"), (2, "u", long), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(df, shared_folder(spark, "warc"), records_per_file=2)).collect()
    assert len(got) == len(pages)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes == len(long.encode())) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert all(r.record_type == "response" for r in got if r.page_id in (3, 4, 5, 6))
    assert {r.page_id: r.payload_digest for r in got}[5] == hashlib.sha1(b"").hexdigest()


def test_warc_files_are_bounded_and_records_have_fresh_headers(spark):
    import gzip
    import io
    import pathlib

    copies = [(i, "u", "c" * 1500) for i in range(40)]
    pages = [*copies, *((100 + i, "u", f"{i} " * 400) for i in range(30)), (200, "u", "L" * 3_000_000), (201, "u", "M" * 40_000), (201, "u", "M" * 40_000), (None, "u", "N" * 2000), (None, "u", "N" * 2000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, size int")
    folder = warc.write_archives(df, shared_folder(spark, "warc"), file_bytes=1 << 18, records_per_file=64)
    records = []
    for f in pathlib.Path(folder.removeprefix("file://")).glob("*.gz"):
        own = list(warc.parse_records(io.BufferedReader(io.BytesIO(gzip.decompress(f.read_bytes())))))
        assert len(own) == 1 or sum(len(b) for _, b in own) <= (1 << 18) + 400 * len(own)
        records += own
    assert len(records) == len(pages)
    ids = Counter(h["warc-record-id"] for h, _ in records)
    assert max(ids.values()) == 2 and sum(n > 1 for n in ids.values()) == 1  # the repeated row of page 201
    revisits = [(h, b) for h, b in records if h["warc-type"] == "revisit"]
    assert len(revisits) == 39 and {h["warc-refers-to"] for h, _ in revisits} <= set(ids)
    target = {h["warc-record-id"]: h for h, _ in records}
    assert {target[h["warc-refers-to"]]["x-page-id"] for h, _ in revisits} == {"39"}
    assert all(h["warc-date"] >= "2025" for h, _ in records)
    assert sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to or -1) for r in warc.read_archives(spark, folder).collect()) == sorted((p[0] if p[0] is not None else -1, "revisit" if p[0] is not None and p[0] < 39 else "response", 39 if p[0] is not None and p[0] < 39 else -1) for p in pages)


def test_top_k_odd_rows(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (None, [2.0, 2.0]), (1, [1.0]), (2, [1.0, 0.0, 5.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [None, 1.0]), (5, [])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, score string")
    got = topk.top_k(df, "vec_id % 100 = 0", k=20).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == 14  # two queries, each against the seven other rows
    first = [(None, 2 << 20), (1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (3, 1 << 20), (5, 0), (100, 0)]
    second = [(None, 2 << 20), (1, 0), (2, 0), (3, 0), (3, 0), (5, 0), (100, 0)]
    assert sorted(by[100], key=str) == sorted(first + second, key=str)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(30)]
    rows += [(900, None), (1000, [float("nan")] * 8), (1100, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, "vec_id % 100 = 0", rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    live = {i: np.floor(1024 * np.array(v, "float64")).astype(int) for i, v in rows[:430]}
    for q in (0, 100, 200, 300, 400):
        best = sorted(((-int(live[q] @ v), i) for i, v in live.items() if i != q))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 100, 200, 300, 400}


def test_mixing_meets_targets(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = mixing.mix(d, labels, JSON).toPandas()
    total = got.n_tokens.sum()
    assert (got.rate >= 0).all() and len(got) == d.count()
    from tokenizers import Tokenizer

    library, text = Tokenizer.from_file(JSON), d.toPandas().set_index("doc_id").text
    assert got.n_tokens.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in text[got.doc_id]]
    for k, share in mixing.TARGETS.items():
        assert abs((got.rate * got.n_tokens * got[k]).sum() / total - share) < 0.005
    assert mixing.mix(docs(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int"), JSON).count() == len(ODD)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    names = spark.read.parquet(f"{DIR}/documents.parquet").columns
    current = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [current.count()]
    for k, (_, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in current.select("doc_id", "text").collect()} if k < 4 else {}
        out = stage(spark, current, DIR)
        if k == 4:
            break
        assert out.columns == names
        path = shared_folder(spark, "stage")
        out.write.parquet(path)
        current = spark.read.parquet(path)
        after = {r.doc_id for r in current.select("doc_id").collect()}
        kept.append(len(after))
        if k == 1:
            groups = {}
            for i, t in before.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
            assert after == {min(g)[1] for g in groups.values()}
        if k == 2:
            assert after == {c for _, c in near_brute(list(before.items()), 5, 80).values()}
    assert kept[:4] == sorted(kept[:4], reverse=True) and kept[1] < kept[0]
    assert P.run(spark, DIR).count() > 0


def test_quality_mixing_and_packing_stages_against_their_models(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    d, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in d.collect()}
    model = quality.train(d, labels)

    def score(m, text):  # one text, from the definition of the features
        b = (text or "").encode()
        grams = sorted({int(quality.hashed(np.frombuffer(b[i : i + 4], np.uint8))[0]) for i in range(len(b) - 3)})
        v = m.ratio[grams].astype(float)
        n = float(np.sqrt(v @ v))
        margin = (float(v @ m.weight[grams]) / n if n else 0.0) + m.bias
        return 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -50, 50)))

    want = {i for i, t in texts.items() if score(model, t) >= 0.5}
    good = P.good_quality(spark, d, DIR)
    assert {r.doc_id for r in good.collect()} == want
    saved = shared_folder(spark, "good")
    good.write.parquet(saved)
    good = spark.read.parquet(saved)
    library = Tokenizer.from_file(JSON)
    models = mixing.domain_models(good, labels)
    names = sorted(want)
    p = np.array([[score(m, texts[i]) for m in models] for i in names]) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    n = np.array([len(library.encode(texts[i], add_special_tokens=False).ids) for i in names], float)
    table = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "n_tokens long, high double, low double, toxic double")
    rate = mixing.solve(table, P.TARGETS).rates(p)[0]
    times = Counter(r.doc_id for r in P.mixed(spark, good, DIR).collect())
    assert sum(abs(times[i] - r) >= 1.01 for i, r in zip(names, rate)) == 0  # a rate's floor or ceiling
    packed = P.packed(spark, good, DIR).toPandas()
    for i, own in packed.sort_values("start").groupby("doc_id"):
        assert np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist() == [*library.encode(texts[i], add_special_tokens=False).ids, 1]
    assert set(packed.doc_id) == want


def test_ids_and_counts_against_the_library():
    from tokenizers import Tokenizer

    library, vocab, rng = Tokenizer.from_file(JSON), vocabulary.Vocabulary(JSON), random.Random(5)
    parts = [*"abzQ  \n\t'srtvemdl09٣ß漢é\u0085\u3000\x1c\x0b.,<|>_-\x00😀", *vocab.special, "'re", "endoftext", " the"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + [" " * 3000, "x" * 3000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in vocab.encode(texts)] == want
    assert vocab.counts(texts) == [len(w) for w in want]
    small = vocabulary.Vocabulary(JSON, most=1000)  # forgets all the time
    assert [small.counts([t])[0] for t in texts[:300]] == [len(w) for w in want[:300]]


def test_mixing_a_domain_without_text_leaves_the_other_shares(spark):
    rng = np.random.default_rng(2)
    toxic = rng.uniform(0.05, 0.9, 400)
    table = spark.createDataFrame([(100, float(1 - t), 0.0, float(t)) for t in toxic], "n_tokens long, high double, low double, toxic double")
    with pytest.warns(UserWarning, match="not met"):
        found = mixing.solve(table, {"high": 0.6, "low": 0.02, "toxic": 0.38})
    assert found.shares["high"] == pytest.approx(0.6, abs=2e-3)
    assert found.shares["toxic"] == pytest.approx(0.38, abs=2e-3)


def test_hinge_dual_against_projected_gradient():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(1, 8), replace=False)).astype(np.int32) for _ in range(30)]
    y, ratio = np.where(rng.random(30) < 0.4, 1.0, -1.0), np.zeros(1 << 18)
    ratio[:12] = rng.normal(size=12)
    w, bias = quality.descend(rows, y, ratio, 1.0, 5000, least=1e-9)
    x = np.zeros((30, 13))
    for i, g in enumerate(rows):
        x[i, g] = ratio[g] / np.linalg.norm(ratio[g])
    x[:, 12] = 1
    most = np.where(y > 0, 15 / (y > 0).sum(), 15 / (y < 0).sum())
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a = np.zeros(30)
    for _ in range(200_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.eigvalsh(q)[-1], 0, most) if _ == 0 else np.clip(a - (q @ a - 1) / top, 0, most)
        top = np.linalg.eigvalsh(q)[-1] if _ == 0 else top
    want = (a * y) @ x
    loss = lambda v: v @ v / 2 + (most * np.maximum(0, 1 - y * (x @ v))).sum()
    found = np.append(w[:12], bias)
    assert np.abs(found - want).max() < 1e-4 and loss(found) <= loss(want) + 1e-6


def test_mixing_equals_the_closed_least_squares_solution(spark):
    """Where no rate is at its bound, the rates of least squared distance from 1 that meet the targets are 1 + p.x."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([4, 3, 2], 400)
    n = rng.integers(1, 50, 400)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, high double, low double, toxic double")
    t = np.array([0.46, 0.32, 0.22])
    moments = (p * n[:, None]).T @ p / n.sum()
    want = 1 + p @ np.linalg.solve(moments, t - n @ p / n.sum())
    assert want.min() > 0.2
    descent = mixing.solve(table, dict(zip(mixing.DOMAINS, t)), tolerance=1e-7)
    assert len(descent.gaps) <= 10 and np.abs(descent.rates(p)[0] - want).max() < 1e-2
    assert np.abs(np.array([descent.shares[d] for d in mixing.DOMAINS]) - t).max() <= 1e-7


def test_labelled_sample_is_bounded(spark):
    rows = [(1, "a" * 100)] * 50 + [(2, "b" * 300), (3, "c" * 20), (4, "d" * 10)]
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (9, 0), (None, 1)], "doc_id long, y int")
    got = quality.labelled_sample(docs(spark, rows), marks, 100)
    assert [r.doc_id for r, _ in got] == [1, 2, 3]  # one of each id
    assert [r.doc_id for r, _ in quality.labelled_sample(docs(spark, rows), marks, 100, sample_bytes=150)] == [1, 3]
    assert len(quality.labelled_sample(docs(spark, rows), marks, 2)) <= 2


CLASHING = "doc_id long, text string, _kept_id string, __text string, score double, __score double, n_words long, high double, rate double, __copy int, c0 string, c1 array<int>, hash long, keep_id long, kept boolean, component_id long, sig binary"


def test_stages_with_clashing_columns_nulls_and_repeats(spark):
    import corpus_pipeline as P

    good = spark.read.parquet(f"{DIR}/documents.parquet").filter("length(text) > 300").orderBy("doc_id").limit(20).collect()
    rows = [(r.doc_id, r.text) for r in good] + [(good[0].doc_id, good[0].text), (900, None), (901, ""), (902, " \n"), (None, "no id " * 40), (None, None), (903, "word " * 300_000)]
    more = ("k", "t", 0.5, 0.5, 1, 0.1, 2.0, 3, "x", [1, 2], 7, 8, True, 9, b"s")
    table = spark.createDataFrame([(*r, *more) for r in rows], CLASHING)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, table, DIR)
        assert out.schema.simpleString() == table.schema.simpleString(), name
        found = out.collect()
        assert {(r.doc_id, r.text) for r in found} <= set(rows), name
        assert all(tuple(r)[2:] == (*more[:-1], bytearray(b"s")) for r in found), name
        assert stage(spark, table.limit(0), DIR).collect() == [], name
    assert P.STAGES[-1][1](spark, table, DIR).filter("doc_id is null").select("doc_tokens").distinct().count() == 2


def test_stages_leave_one_row_of_repeated_and_null_ids(spark):
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "z")
    rows = [(7, a)] * 5 + [(7, b), (8, b), (None, c), (None, c), (9, c), (None, a), (None, "d e f"), (None, "d e f"), (10, None), (7, a + " ")]
    exact = [(r.doc_id, r.text) for r in P.no_copies(spark, docs(spark, rows), DIR).collect()]
    assert sorted(exact, key=str) == sorted([(7, a + " "), (7, b), (9, c), (None, "d e f"), (10, None)], key=str)
    rows = [(7, a)] * 5 + [(7, b), (8, b), (None, c), (None, c), (9, c), (None, near), (6, near), (None, "d e f"), (None, "d e f")]
    left = [(r.doc_id, r.text) for r in P.no_near_copies(spark, docs(spark, rows), DIR).collect()]
    assert sorted(left, key=str) == sorted([(6, near), (7, b), (9, c), (None, "d e f")], key=str)


def test_mixing_meets_targets_far_from_the_shares(spark):
    rng = np.random.default_rng(5)
    kind = rng.choice(3, 3000, p=[0.02, 0.97, 0.01])
    p = np.full((3000, 3), 0.1) + 0.7 * np.eye(3)[kind] + 0.01 * rng.random((3000, 3))
    p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(1, 300, 3000)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, high double, low double, toxic double")
    targets = {"high": 0.5, "low": 0.3, "toxic": 0.2}
    descent = mixing.solve(table, targets, steps=10)
    rate = descent.rates(p)[0]
    found = (n * rate) @ p / n.sum()
    assert (rate >= 0).all() and rate.max() > 4 and np.abs(found - [targets[d] for d in mixing.DOMAINS]).max() <= 1.1e-3
    assert descent.residual <= 1e-3
    with pytest.warns(UserWarning, match="not met"):
        assert mixing.solve(table, {"high": 0.95, "low": 0.05, "toxic": 0.0}, steps=5).residual > 0.01


def test_pieces_that_go_to_the_library_together():
    from codeloom.llm.queries import tokenizer_path
    from codeloom.llm.vocabulary import Vocabulary

    known = Vocabulary(tokenizer_path("json"))
    mark = known.mark
    texts = ["", mark, f"a{mark[:-1]}", f"{mark}{mark} x", f"{mark[:-1]}{mark}", " " * 5000, "x" * 3000, "can't 'll  \n\n z", "　a   b", mark[:5], "w" + "ü" * 300]
    wanted = [known.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert known.counts(texts) == [len(x) for x in wanted] and not known.ids
    assert [x.tolist() for x in known.encode(texts)] == wanted and not known.sizes
    small = Vocabulary(tokenizer_path("json"), most=2000)  # forgets all the time
    small.mark = None  # each piece by itself
    assert small.counts(texts) == [len(x) for x in wanted] and [x.tolist() for x in small.encode(texts)] == wanted


def test_pieces_of_sure_characters_go_to_the_model_alone():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    every = "".join(chr(i) for i in range(1, 1 << 16) if not 0xD800 <= i < 0xE000)
    texts = ["Plain words, naïve ones; 12 and  they'll\n\nstay \xff\x00", "Grüße " * 3, "x" * 200, "", "é" * 256]
    known = vocabulary.Vocabulary(JSON)
    assert known.split.two_byte(every) == known.split.full(every) and known.units.two_byte(every) == known.units.full(every)
    known.library = known.split.full = None  # the whole tokenizer, and the slower splitter, aren't asked
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert known.counts(texts) == [len(x) for x in wanted] == known.counts(texts)
    assert [x.tolist() for x in known.encode(texts)] == wanted
