"""Ranked lexical search, a term at a time with a limited set of accumulators.

1. One pass over the documents makes blocks: the postings (document, count) of every
   query term, by term, with the lengths of the block's documents. Statistics over
   all documents (documents with terms, words, documents per term) are sums over
   the blocks.
2. Every block answers every query. Terms are taken rarest first; each adds its
   weighted impact to the accumulators of its documents. Once the best that the
   remaining terms can add is below the k-th partial score, no new accumulator is
   made; those that exist are updated to the end, so their scores are exact. The
   k-th score of a task's earlier blocks counts as well, so later blocks may start
   without making any.
3. The best of every block are ranked per query.

The query set is taken in slices of bounded size, whose terms and weights every
task gets. Blocks are bounded in documents and postings. A term that every document
holds is one posting list per block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.llm import text as T
from gridframe.session import ship_package

K = 20
BLOCK_DOCS = 16_384
BLOCK_HITS = 2_000_000
#: bytes of query texts whose terms are sent to all tasks at once
SLICE_BYTES = 16 << 20
#: ASCII letters lower-cased; every other ASCII character but digits separates
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BLOCK = ("n_docs long, n_words long, doc_ids array<long>, lengths array<long>, terms array<long>, dfs array<long>, "
         "docs array<long>, counts array<long>")


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (raw or b"").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(numbers: dict[bytes, int], block_docs: int, block_hits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.get
        ids, lengths, hits, words, full, held = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
            flat = np.array([t for h in hits for t in h], np.int64)
            key, count = np.unique((flat << 32) | owner, return_counts=True)
            term, df = np.unique(key >> 32, return_counts=True)
            cols = [[full], [words], [ids], [lengths], [term], [df], [key & 0xFFFFFFFF], [count]]
            types = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                              names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(raw.as_py())
                if not found:
                    continue
                full += 1
                words += len(found)
                mine = [t for t in map(get, found) if t is not None]
                if mine:
                    ids.append(doc_id)
                    lengths.append(len(found))
                    hits.append(mine)
                    held += len(mine)
                if len(ids) >= block_docs or held >= block_hits:
                    yield close()
                    ids, lengths, hits, words, full, held = [], [], [], 0, 0, 0
        if full:
            yield close()

    return run


class Block:
    """A block's postings as impacts: per term its documents and what one query
    occurrence of weight 1 adds to each."""

    def __init__(self, lengths, terms, dfs, docs, counts, n_docs: int, n_words: int):
        self.size = len(lengths)
        damping = 12 * (100 - 25 + (25 * lengths * n_docs) // n_words)
        impact = (1_000_000_000 * counts) // (1000 * counts + damping[docs])
        ends = np.cumsum(dfs)
        self.lists = {int(t): (docs[b - d:b], impact[b - d:b]) for t, d, b in zip(terms, dfs, ends, strict=True)}
        self.most = {t: int(x.max()) for t, (_, x) in self.lists.items()}


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th best score; 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def score_block(block: Block, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, accumulators made) of one query, (term, weight) rarest first.

    Exact for every document that may be among the ``k`` best and reaches ``floor``."""
    query = [(t, w) for t, w in query if t in block.lists]
    bounds = np.array([w * block.most[t] for t, w in query], np.int64)
    rest = np.cumsum(bounds[::-1])[::-1]  # most that a document can get from this term on
    total, has, open_ = np.zeros(block.size, np.int64), np.zeros(block.size, bool), True
    for i, (t, w) in enumerate(query):
        docs, impact = block.lists[t]
        if open_:
            open_ = rest[i] >= floor and rest[i] >= kth(total[has], k)
        if open_:
            has[docs] = True
        else:
            old = has[docs]
            docs, impact = docs[old], impact[old]
        total[docs] += w * impact
    found = np.flatnonzero(has & (total > 0) & (total >= floor))
    return found, total[found], int(has.sum())


def _score(queries: list[tuple[int, list[tuple[int, int]]]], n_docs: int, n_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {row: np.zeros(0, np.int64) for row, _ in queries}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(batch.num_rows):
                one = table.slice(i, 1)
                parts = {c: T.list_parts(one.column(c))[0] for c in ("lengths", "terms", "dfs", "docs", "counts")}
                ids = one.column("doc_ids")[0].as_py()
                order_id = np.array([np.iinfo(np.int64).max if x is None else x for x in ids], np.int64)
                no_id = np.array([x is None for x in ids], bool)
                block = Block(**parts, n_docs=n_docs, n_words=n_words)
                out: list[list] = [[], [], []]
                for row, query in queries:
                    docs, scores, _ = score_block(block, query, k, kth(best[row], k))
                    top = np.lexsort((order_id[docs], no_id[docs], -scores))[:k]
                    best[row] = np.sort(np.concatenate([best[row], scores[top]]))[-k:]
                    out[0] += [row] * len(top)
                    out[1] += [ids[d] for d in docs[top]]
                    out[2] += scores[top].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["item", "doc_id", "score"])

    return run


def _search(docs: DataFrame, items: list, k: int, block_docs: int, block_hits: int) -> DataFrame:
    """Rank all documents for one slice of items, rows (item, raw text)."""
    spark = docs.sparkSession
    counted = [(row, Counter(terms(bytes(raw)))) for row, raw in items]
    numbers = {t: n for n, t in enumerate(sorted({t for _, c in counted for t in c}))}
    blocks = T.reliable(docs.mapInArrow(_blocks(numbers, block_docs, block_hits), BLOCK))
    n_docs, n_words = (x or 0 for x in blocks.agg(F.sum("n_docs"), F.sum("n_words")).first())
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x"))
    df = {r[0]: r[1] for r in pairs.groupBy("x.terms").agg(F.sum("x.dfs")).collect()}  # one row per query term at most
    queries = []
    for row, count in counted:
        known = sorted((df[numbers[t]], numbers[t], n) for t, n in count.items() if numbers[t] in df)
        queries.append((row, [(t, n * weight(n_docs, d)) for d, t, n in known]))
    found = blocks.where(F.size("doc_ids") > 0).select("doc_ids", "lengths", "terms", "dfs", "docs", "counts").mapInArrow(
        _score(queries, n_docs, n_words, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS,
           block_hits: int = BLOCK_HITS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item row with
    a score above 0, best first, ties by ascending id.

    * null, empty or term-less texts: such documents are not counted or found, such items find nothing;
    * null document ids: ranked like others, after all ids in a tie; null item ids stay null;
    * repeated document rows are ranked one by one, repeated item rows each get their own ranks;
    * very long texts: all terms count; empty tables: no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    asked = T.reliable(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("raw"))
                       .where("raw IS NOT NULL").withColumn("item", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.length("raw") + 64)).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    found = None
    for s in range(slices):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == s).select("item", "raw").collect()
        one = _search(rows, part, k, block_docs, block_hits)
        found = one if found is None else found.union(one)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
