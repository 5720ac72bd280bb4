"""Exact duplicates by tree-merge: several rounds, ties, nulls, odd tables against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridframe.llm import exact_dedup

BLANK = {ord(c): None for c in "\t\n\x0b\x0c\r "}


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(BLANK), []).append((doc_id, text or ""))
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha = hashlib.sha256(bare.encode()).hexdigest()
        out += [(doc_id, best[0], len(members), sha) for doc_id, _ in members]
    return Counter(out)


def check(spark, rows, partitions, run_rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = exact_dedup.exact_duplicates(docs, run_rows=run_rows).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == {r.text_sha256 for r in got} and set(kept.values()) <= {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("partitions,run_rows", [(1, 100_000), (7, 50), (30, 1)])
def test_rounds_match_brute_force(spark, partitions, run_rows):
    rnd = random.Random(partitions)
    rows = []
    for i in range(300):
        base = "hot text" if i % 3 == 0 else f"text {rnd.randrange(60)} é日😀"
        rows.append((i, "".join(c + rnd.choice(["", "", " ", "\t", "\r\n", "\x0b\x0c"]) for c in base)))
    check(spark, rows, partitions, run_rows)


def test_nulls_repeats_and_ties(spark):
    big = np.iinfo(np.int64).max
    rows = [(5, "a b"), (4, "ab "), (3, "ab"), (None, "a  b"), (None, "x"), (None, "x"), (7, "x"), (big, "y"), (None, "y"),
            (1, None), (2, ""), (8, " \n"), (9, "z"), (9, "z"), (9, "other"), (10, "\xa0"), (11, "w" * 300_000), (12, "w " * 300_000)]
    check(spark, rows, 5, 2)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = exact_dedup.exact_duplicates(empty)
    assert out.collect() == [] and out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    docs = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "a ", 5, 6, 7)], "`doc_id` long, text string, node long, `a.b` int, part int")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True)}


def test_colliding_digests_are_refused():
    fields = {"bytes": np.array([1, 2]), "chars": np.array([1, 2]), "ids": np.array([1, 2]), "rows": np.array([0, 1]), "n": np.array([1, 1])}
    with pytest.raises(ValueError):
        exact_dedup.Run.merged(np.zeros(64, np.uint8), fields)


def test_equal_first_words_are_told_apart():
    digests = np.zeros((3, 32), np.uint8)
    digests[0, 31], digests[2, 31] = 2, 2
    digests[1, 31] = 1
    fields = {k: np.array([1, 1, 1]) for k in ("bytes", "chars", "n")} | {"ids": np.array([3, 2, 1]), "rows": np.arange(3)}
    made, place = exact_dedup.Run.merged(digests.ravel(), fields)
    assert place.tolist() == [1, 0, 1] and made.fields["ids"].tolist() == [2, 1] and made.fields["n"].tolist() == [1, 2]
