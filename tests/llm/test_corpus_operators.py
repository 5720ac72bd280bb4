"""Near-duplicates, decontamination, top-k, LM scores and the pipeline against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.llm import components, decontaminate, lm_score, near_dup, topk
from gridframe.llm import text as T

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


# --- near-duplicates -----------------------------------------------------------

def multiset(text):
    w = words_of(text)
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 0.0


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, t, multiset(t)) for i, t in rows]
    for k, (i, t, a) in enumerate(sets):
        for j, u, b in sets[:k]:
            if t is not None and t == u or similarity(a, b) >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    for change in (10, 60, 150):
        a = rng.integers(0, 40, 400)
        b = a.copy()
        b[rng.choice(400, change, replace=False)] = rng.integers(0, 40, change)
        parts = [np.unique(x, return_counts=True) for x in (a, b)]
        doc = np.concatenate([np.full(len(u), k) for k, (u, _) in enumerate(parts)])
        h = T.mix64(np.concatenate([u for u, _ in parts]).astype(np.uint64)).view(np.int64)
        s = near_dup.signatures(doc, h, np.concatenate([c for _, c in parts]), 2, 4096)
        ca, cb = Counter(a.tolist()), Counter(b.tolist())
        assert abs((s[0] == s[1]).mean() - similarity(ca, cb)) < 0.03


def planted(n_base=12, seed=4):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    rows, i = [], 0
    for b in range(n_base):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 40, 200]))]
        for _ in range(40 if b == 0 else 4):
            copy = list(base)
            if len(copy) > 30 and rnd.random() < 0.8:
                for _ in range(rnd.choice([1, 2, 4])):
                    copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = planted()
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_group_without_original(spark):
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rnd.sample(range(200), 3):
            copy[at] = f"x{rnd.randrange(10 ** 9)}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_shared_differences(spark, monkeypatch):
    """Members that share a difference with many get a bucket of their own instead of being paired."""
    rnd = random.Random(3)
    base, passage = [f"w{i}" for i in range(200)], [f"p{i}" for i in range(22)]
    rows = []
    for i in range(70):
        copy = base[:90] + passage + base[112:] if i % 3 else list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            copy[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near_dup, "SHARERS", 4)
    paired, split = [], []
    links, buckets = near_dup._near_links, near_dup._split
    monkeypatch.setattr(near_dup, "_near_links", lambda near, prefix, sharers: (
        paired.append(sharers.agg(F.max("n")).first()[0] or 0), links(near, prefix, sharers))[1])
    monkeypatch.setattr(near_dup, "_split", lambda *a: (split.append(buckets(*a).count()), buckets(*a))[1])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(rows)
    assert max(paired) <= 4 and max(split) > 4


def test_near_duplicates_common_differences_make_no_candidates(spark):
    """Members that share some differences, but too few for a link, are not paired."""
    common = list(range(1, 9))
    rows = [(0, 2 + i, False, 100, 56.44, common + [1000 + 16 * (i // 2) + k for k in range(16)]) for i in range(40)]
    rows.append((0, 100, False, 100, 50.5, common + list(range(5000, 5016))))  # easily linked: the others' prefixes grow
    near = spark.createDataFrame(rows, "pivot long, m long, linked boolean, size int, least double, delta array<long>").coalesce(2)
    _, prefix = near_dup._prefixes(near, None)
    sharers = near_dup._sharers(prefix)
    wanted = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and len({*a[5]} & {*b[5]}) >= a[4] + b[4] - 100}
    assert len(wanted) == 60
    assert {tuple(sorted(r)) for r in near_dup._near_links(near, prefix, sharers).collect()} == wanted
    assert near_dup._candidates(prefix, sharers).count() == len(wanted)  # before, all pairs that share one unit of their prefixes


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c"), (1, None), (2, None), (3, ""), (4, ""), (5, "one two"), (6, "One, two!"), (7, "..."), (8, "!!!"),
            (9, "rose " * 50_000), (10, "rose " * 50_001), (11, "same row here"), (11, "same row here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("units", F.lit(1)).withColumn("bucket", F.lit(2))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 9, 11: 11}
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (20, 10), (10, 30), (30, 20)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10}


# --- decontamination -----------------------------------------------------------

def brute_align(a, b):
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b, 1):
            new.append(max(0.0, row[j - 1] + (1.0 if x == y else -0.5), row[j] - 0.5, new[j - 1] - 0.5))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    a, b = [rng.integers(0, 4, n) for n in (1, 5, 17, 30)], [rng.integers(0, 4, n) for n in (9, 3, 25, 40)]
    got, _ = decontaminate.align(a, b)
    assert np.allclose(got, [brute_align(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)])


def test_decontamination_finds_copies_only(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("nopqrstuvwxyz") for _ in range(rnd.randint(2, 6))) for _ in range(2000)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, make(n)) for i, n in enumerate([20, 35, 60, 250, 3])]
    docs, want = [], set()
    for i, w in items:
        edited = [x for k, x in enumerate(w) if k % 9 != 8] if len(w) > 5 else w
        swapped = [rnd.choice(vocabulary) if k % 7 == 6 else x for k, x in enumerate(w)]
        for copy in ([w, edited, swapped] if len(w) > 5 else [w]):
            docs.append((len(docs), " ".join(make(70) + copy + make(300))))
            want.add((docs[-1][0], i))
    docs += [(1000 + k, " ".join(make(400))) for k in range(20)]
    docs += [(2000, " ".join(make(50) + items[1][1][:8] + make(50))), (3000, None), (3001, ""), (None, " ".join(items[0][1]))]
    hot = [(5000 + k, " ".join(make(5) + items[2][1] + make(5))) for k in range(60)]  # a passage of a third of all rows
    want |= {(d, 2) for d, _ in hot}
    df = spark.createDataFrame(docs + hot, "doc_id long, text string").withColumn("item_id", F.lit(7)).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["score"] == 1.0 for r in got if r["doc_id"] >= 5000)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_recall_of_edited_copies(spark):
    """Copies with 15-30 % of their words replaced, against full alignment of all pairs."""
    rnd = random.Random(4)
    items, docs, want = [], [], Counter()
    for n in (12, 16, 24, 48, 96):
        for _ in range(120):
            w = [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
            copy = [f"x{rnd.randrange(10 ** 6)}" if rnd.random() < p else x for p in [rnd.uniform(0.15, 0.3)] for x in w]
            around = [f"y{rnd.randrange(10 ** 6)}" for _ in range(60)]
            items.append((len(items), " ".join(w)))
            docs.append((len(docs), " ".join(around[:30] + copy + around[30:])))
            if brute_align(w, copy) >= decontaminate.THRESHOLD * n:
                want[n] += 1
    sizes = [len(t.split()) for _, t in items]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["doc_id"] == r["item_id"] for r in got)
    found = Counter(sizes[r["item_id"]] for r in got)
    assert all(want[n] >= 90 and found[n] >= 0.97 * want[n] for n in want), (found, want)


def test_decontamination_by_tiny_items(spark):
    """An item of one or two words marks a document of these words only."""
    docs = [(1, "the"), (2, "The!"), (3, "the end"), (4, "the end of the story"), (5, "end the"), (6, None), (7, "")]
    items = [(1, "the"), (2, "The end."), (3, ""), (4, None)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got} == {(1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0)}


# --- top-k -----------------------------------------------------------------------

def brute_top(rows, queries, k):
    out = set()
    for q, a in queries:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(b) == len(a))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 330)] + [(500, [0.0] * 6), (600, [1.0, 2.0])]
    odd = [(700, None), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(3)
    vectors = topk.integer_vectors(df)
    kept = [(r["vec_id"], list(r["v"])) for r in vectors.collect()]
    assert len(kept) == len(rows)
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()
    assert {tuple(r) for r in got} == brute_top(kept, [x for x in kept if x[0] % 100 == 0], 10)
    assert topk.top_k(vectors.limit(0), vectors).count() == 0
    few = topk.top_k(vectors.where("vec_id < 4"), vectors.where("vec_id = 0"))
    assert few.count() == 3


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-3, 4, (2000, 2))
    vectors[:30] *= 1000
    block = topk.Block(np.arange(2000), vectors)
    touched = []
    block.lists = type("Seen", (), {"__getitem__": lambda self, at, lists=block.lists: touched.append(1) or lists[at]})()
    block.top(5000, np.array([3, 2]), 10)
    assert len(touched) < 2000 / topk.STEP / 4


# --- LM scores -------------------------------------------------------------------

def brute_scores(rows, order=3, backoff=0.4):
    docs = [words_of(t) for _, t in rows]
    grams = lambda w, m: [tuple(w[i:i + m]) for i in range(len(w) - m + 1)]
    total = [Counter(g for w in docs for g in grams(w, m)) for m in range(1, order + 1)]
    n_words, out = sum(map(len, docs)), []
    for (i, _), w in zip(rows, docs, strict=True):
        own = [Counter(grams(w, m)) for m in range(1, order + 1)]
        count = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for k, x in enumerate(w):
            penalty = 0.0
            for m in range(min(order - 1, k), -1, -1):
                g = tuple(w[k - m:k + 1])
                if m == 0:
                    score += penalty + math.log(max(count(g), 0.5) / max(n_words - len(w), 1))
                elif count(g) > 0:
                    score += penalty + math.log(count(g) / count(g[:-1]))
                    break
                else:
                    penalty += math.log(backoff)
        out.append((i, len(w), round(score, 4)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "bucket"), [(300_000, 1_500_000), (40, 25)])
def test_lm_scores_equal_brute_force(spark, chunk, bucket):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("ab cd ef gh ij".split()) for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "unseen words only"), (103, "ab cd ef " * 400), (104, "twice the same"), (104, "twice the same"), (None, "ab cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).repartition(3)
    got = lm_score.backoff_scores(df, chunk_words=chunk, bucket_grams=bucket).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["log_score"]) for r in got), key=str)
    want = sorted(brute_scores(rows), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-3)
    assert lm_score.backoff_scores(df.limit(0)).count() == 0


def test_alike_numbers_are_told_apart(spark):
    words = [f"w{i}" for i in range(5000)]
    hashes = np.array([r["h"][0] for r in spark.createDataFrame([(w,) for w in words], "text string").select(T.word_hashes("text").alias("h")).collect()])
    top = T.word_grams(hashes, np.arange(5001), 1)[0].view(np.uint64) >> np.uint64(64 - 21)
    order = np.argsort(top, kind="stable")
    at = np.flatnonzero(np.diff(top[order]) == 0)[0]
    pair = [words[order[at]], words[order[at + 1]]]  # equal in their first 21 bits
    got = lm_score.backoff_scores(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect()
    assert [r["log_score"] for r in got] == [round(math.log(0.5), 6)] * 2


def test_sorted_runs_round_trip():
    x = np.unique(np.random.default_rng(0).integers(0, 2 ** 63, 1000).astype(np.uint64))
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(x)) == x).all()
    assert (lm_score.unpack_counts(lm_score.pack_counts(np.array([1, 2 ** 32 - 1, 7]))) == [1, 2 ** 32 - 1, 7]).all()


# --- pipeline ---------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "ein text ohne nummer und der die das", None, None, None), (10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "", "en", None, 0)],
                                docs.schema)
    now = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert 0 < len(rows) <= now.count()
        if name == "near_dup":
            texts = [(r["doc_id"], r["text"]) for r in now.collect() if r["doc_id"] is not None]
            assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(set(brute_classes(texts).values()))
        now = spark.createDataFrame(rows, docs.schema)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_counts_have_no_cap():
    x = np.array([1, 2 ** 32 + 5, 2 ** 52, 0])
    assert lm_score.unpack_counts(lm_score.pack_counts(x)).tolist() == x.tolist()
    assert len(lm_score.pack_counts(x[:1])) == 2 and lm_score.unpack_counts(lm_score.pack_counts(x[:0])).tolist() == []
    import pyarrow as pa

    keys = [lm_score.pack_sorted(np.array(k, np.uint64)) for k in ([3, 9], [9])]
    table = pa.table({"chunk": [0, 1], "bucket": [0, 0], "keys": keys, "counts": [lm_score.pack_counts(np.array(c)) for c in ([1, 2 ** 33], [2 ** 33])]})
    answers = [lm_score.unpack_counts(r).tolist() for r in lm_score._totals(table).column("totals").to_pylist()]
    assert answers == [[1, 2 ** 34], [2 ** 34]]


def test_requests_are_entropy_coded():
    """A gram's number takes little more than the bits that its neighbours leave open, its count little more than nothing."""
    rng = np.random.default_rng(4)
    for n, top in ((20_000, 2 ** 56), (20_000, 2 ** 63), (3, 2 ** 20), (1, 1)):
        x = np.unique(rng.integers(0, top, n).astype(np.uint64))
        raw = lm_score.pack_sorted(x)
        assert (lm_score.unpack_sorted(raw) == x).all()
        assert n < 100 or len(raw) < n * (np.log2(top / n) + 2.2) / 8
    assert lm_score.unpack_sorted(lm_score.pack_sorted(x[:0])).tolist() == []
    counts = np.where(rng.random(20_000) < 0.1, rng.integers(2, 300, 20_000), 1)
    raw = lm_score.pack_counts(counts)
    assert lm_score.unpack_counts(raw).tolist() == counts.tolist() and len(raw) < 10_000
