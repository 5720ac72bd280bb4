"""Language-model scores by stupid backoff over the whole corpus' n-gram counts.

Every document is scored by the counts of all *other* documents: its own
occurrences are taken off, so a copy of nothing scores low and repeated text
scores high.

1. Documents are dealt into chunks by a hash. A chunk counts its word n-grams of
   all orders and sends each distinct one, once, to the count table partition
   (bucket) of its hash: the pre-aggregated side of a relational count.
2. A bucket adds up the counts of its n-grams over all chunks and answers every
   chunk in the chunk's own order.
3. A chunk's documents meet the answers in an equi-join on the chunk; each
   n-gram occurrence gets its count and every document sums its words' scores.

A request is a sorted run of n-gram numbers, stored as byte planes of the
differences: the low planes are noise and stay, the high ones and the counts are
entropy-coded, which the shuffle's own compression does not do. The numbers are the
full 64-bit hashes of the n-grams. Chunks and buckets are sized from the
corpus: memory stays bounded and the shuffles grow with the corpus. A frequent
n-gram is one entry per chunk, so no bucket is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import text as T
from gridframe.session import ship_package

ORDER = 3
BACKOFF = 0.4
#: words of a chunk, n-grams of a bucket: what one group holds in memory
CHUNK_WORDS = 1_600_000
BUCKET_GRAMS = 1_500_000


ZSTD = pa.Codec("zstd", 1)


def pack_sorted(x: np.ndarray) -> bytes:
    """A rising run of 64-bit numbers as byte planes of its differences: the number of
    low planes that are kept as they are, the length, these planes, the others coded."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    low = max(0, int(x[-1]) // len(x)).bit_length() - 1 >> 3 if len(x) and x[-1] >= len(x) else 0
    return bytes([low]) + len(x).to_bytes(8, "little") + planes[:low].tobytes() + ZSTD.compress(planes[low:].tobytes(), asbytes=True)


def unpack_sorted(raw: bytes) -> np.ndarray:
    low, n = raw[0], int.from_bytes(raw[1:9], "little")
    coded = ZSTD.decompress(raw[9 + low * n:], (8 - low) * n, asbytes=True) if n else b""
    planes = np.frombuffer(raw[9:9 + low * n] + coded, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as byte planes, as many as the largest needs, after their number; 128
    more and the length tell that the planes are coded."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, int(x.max(initial=0)).bit_length() + 7 >> 3)
    plain = planes[:used].tobytes()
    coded = ZSTD.compress(plain, asbytes=True)
    if len(coded) + 8 < len(plain):
        return bytes([used + 128]) + len(x).to_bytes(8, "little") + coded
    return bytes([used]) + plain


def unpack_counts(raw: bytes) -> np.ndarray:
    used, plain = raw[0] & 127, raw[1:]
    if raw[0] & 128:
        plain = ZSTD.decompress(raw[9:], used * int.from_bytes(raw[1:9], "little"), asbytes=True)
    planes = np.frombuffer(plain, np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


class Grams:
    """The n-grams of a chunk: per order the number, document and position of every
    occurrence, and the chunk's distinct numbers, bucket by bucket."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, order: int, buckets: int):
        self.order = order
        keys, counts, self.index, self.docs, self.places, known = [], [], [], [], [], 0
        for m in range(1, order + 1):  # orders have different numbers; one at a time, since a chunk is large
            h, doc, pos = T.word_grams(words, offsets, m)
            own, at, times = np.unique(h.view(np.uint64), return_inverse=True, return_counts=True)
            keys.append(own)
            counts.append(times.astype(np.int32))
            self.index.append((at + known).astype(np.int32))
            self.docs.append(doc.astype(np.int32))
            self.places.append(pos.astype(np.int32))
            known += len(own)
            del h, doc, pos, own, at, times
        keys, self.counts = np.concatenate(keys), np.concatenate(counts)
        bucket = (keys % np.uint64(buckets)).astype(np.int32)
        self.by_bucket = np.lexsort((keys, bucket))  # rising numbers inside a bucket
        self.keys, self.bucket = keys[self.by_bucket], bucket[self.by_bucket]
        self.cuts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)


def _requests(order: int, buckets: int):
    def run(key, table):
        g = Grams(*T.list_parts(table.column("words")), order, buckets)
        counts = g.counts[g.by_bucket]
        rows = [(int(g.bucket[a]), pack_sorted(g.keys[a:b] // np.uint64(buckets)), pack_counts(counts[a:b]))
                for a, b in zip(g.cuts[:-1], g.cuts[1:], strict=True)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _totals(table):
    """Counts over all chunks for every request of a bucket, in its order."""
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack_counts(c) for c in table.column("counts").to_pylist()])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    np.add.at(total, at, counts)
    total = total[at]
    cuts = np.cumsum([0, *map(len, keys)])
    answers = [pack_counts(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "totals": pa.array(answers, pa.binary())})


def _scores(order: int, buckets: int, corpus_words: int, backoff: float):
    def run(docs, answers):
        words, offsets = T.list_parts(docs.column("words"))
        lengths = np.diff(offsets)
        g = Grams(words, offsets, order, buckets)
        answers = answers.sort_by("bucket")
        total = np.empty(len(g.keys), np.int64)
        if len(g.keys):
            total[g.by_bucket] = np.concatenate([unpack_counts(x) for x in answers.column("totals").to_pylist()])
        # counts of the other documents, for every occurrence of every order
        others = []
        for m in range(order):
            at = g.index[m]
            pair, inverse, own = np.unique(g.docs[m] * np.int64(len(g.keys) + 1) + at, return_inverse=True, return_counts=True)
            others.append(np.maximum(total[at] - own[inverse], 0))
        # occurrence of order m that ends at word i begins at i - m + 1
        begins = [np.cumsum(np.maximum(lengths - m, 0)) - np.maximum(lengths - m, 0) for m in range(order)]
        doc, place = g.docs[0], g.places[0]
        rest = np.maximum(corpus_words - lengths, 1)[doc]
        best = np.log(np.maximum(others[0], 0.5) / rest)  # words of no other row: half an occurrence
        for m in range(1, order):
            best = best + np.log(backoff)
            enough = place >= m
            here = begins[m][doc[enough]] + place[enough] - m
            before = begins[m - 1][doc[enough]] + place[enough] - m
            top, under = others[m][here], others[m - 1][before]
            seen = top > 0
            at = np.flatnonzero(enough)
            best[at[seen]] = np.log(top[seen] / np.maximum(under[seen], top[seen]))
            best[~enough] -= np.log(backoff)  # no longer context there: nothing is backed off
        sums = np.bincount(doc, best, len(lengths)).astype(np.float64)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(lengths.astype(np.int64)),
                         "log_score": pa.array(np.round(sums, 6)), "score": pa.array(np.round(sums / np.maximum(lengths, 1), 6))})

    return run


def backoff_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                   backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """(doc_id, n_words, log_score, score) of every row: the sum and the mean, over
    the words, of the natural logarithm of the stupid-backoff score
    S(w | context) = c(context w) / c(context), or ``backoff`` times the score with
    a shorter context if the n-gram occurs in no other row. Counts are those of
    all other rows; a word in no other row counts half.

    * null, empty or word-less texts: 0 words, log_score and score 0;
    * null ids: scored like others; repeated rows count for one another;
    * very long texts: every n-gram counts; a row is never split;
    * empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.size(T.words("text"))).alias("n")).first()["n"] or 0
    grams = max(1, total * order)
    chunks, buckets = max(1, -(-total // chunk_words)), max(1, -(-grams // bucket_grams))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")
    hashed = dealt.repartition("chunk").select("chunk", "doc_id", T.word_hashes("text").alias("words"))
    requests = hashed.groupBy("chunk").applyInArrow(_requests(order, buckets), "bucket int, chunk int, keys binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(_totals, "chunk int, bucket int, totals binary")
    return hashed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scores(order, buckets, int(total), backoff), "doc_id long, n_words long, log_score double, score double")
