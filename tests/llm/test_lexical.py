"""Ranked lexical search against brute force; the accumulator limit at work."""

import math
import random
import re
from collections import Counter

import numpy as np

from gridframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item_id, text in items:
        found = []
        for doc_id, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * total) // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        found = sorted(found)[:k]
        out.update((item_id, n, None if null else doc_id, -score) for n, (score, null, doc_id) in enumerate(found, 1))
    return out


def check(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical.search(d, spark.createDataFrame(items, "item_id long, text string"), **kw).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, items, kw.get("k", 20))


def zipf(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return " ".join(rnd.choices(words, [1 / (i + 1) for i in range(vocabulary)], k=n))


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    docs = [(i, zipf(i, rnd.choice([3, 20, 120]))) for i in range(400)]
    items = [(i, zipf(1000 + i, 15)) for i in range(20)]
    check(spark, docs, items)
    check(spark, docs, items, k=3, block_docs=16)


def test_slices_of_queries(spark):
    docs = [(i, zipf(i, 30)) for i in range(60)]
    check(spark, docs, [(i, zipf(500 + i, 12)) for i in range(30)], slice_bytes=400)


def test_odd_rows(spark):
    docs = [(1, "Ünder_score É a"), (2, "ünder a A"), (None, "a b c"), (4, None), (5, ""), (6, "..."), (7, "a b c"), (7, "a b c"),
            (8, "b " * 200_000), (9, "日本 语 a"), (9, "x\x00y-z")]
    items = [(1, "a A É"), (2, None), (3, ""), (None, "b b c"), (5, "b c b"), (5, "b c b"), (6, "nowhere"), (7, "日本 y x")]
    check(spark, docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, item long, `x.y` int")
    items = spark.createDataFrame([(1, "a", 3)], "item_id long, text string, rank int")
    assert [r.doc_id for r in lexical.search(docs, items).collect()] == [1]  # ln((2N+2)/(2df+1)) > 0 even for a term in all
    assert lexical.search(docs.where("false"), items).collect() == []
    out = lexical.search(docs, items.where("false"))
    assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_are_limited():
    """A common last term makes no accumulators once the rare ones filled the best k."""
    n = 1000
    docs = np.concatenate([np.arange(30), np.arange(n)])
    block = lexical.Block(np.full(n, 50), np.array([0, 1]), np.array([30, n]), docs, np.ones(len(docs), np.int64), n, 50 * n)
    found, scores, made = lexical.score_block(block, [(0, 5000), (1, 10)], 20, 0)
    assert made == 30 and found.tolist() == list(range(30)) and len(set(scores.tolist())) == 1
    assert lexical.score_block(block, [(0, 5000), (1, 10)], 40, 0)[2] == n  # fewer than k: all are needed
    assert lexical.score_block(block, [(0, 5000), (1, 10)], 20, 10 ** 12)[2] == 0  # nothing reaches the earlier best
