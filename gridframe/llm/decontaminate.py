"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

1. Test items are cut into segments (long items only) and their word n-grams
   are the possible seeds. A bitmap of bounded size over the seeds' hashes goes
   to the tasks.
2. One pass over the documents counts, per seed, the documents that hold it.
   Every n-gram of a short segment is a seed. Of every two neighbouring n-grams
   of a longer one the rarer is, so a stretch of n + 1 words copied word by word
   always holds one.
3. A second pass cuts out the passages around seeds. They meet the items in an
   equi-join on the seed. Hits of one passage and segment whose diagonals lie
   close become one candidate.
4. Candidates are aligned by Smith-Waterman over words, so substituted, dropped
   and added words cost a little and do not end the alignment. The score is the
   alignment's, divided by that of the segment with itself.

A seed that a third of all documents hold is still a seed if its neighbours are
as frequent: nothing is dropped for being common, and the seed side of the join
is small, so a hot seed is split by Spark's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.llm import text as T
from gridframe.session import ship_package

GRAM = 3
#: every n-gram of a segment of up to so many words is a seed
SHORT = 24
#: words of a segment, and of its step; items up to the first length are one segment
SEGMENT, STEP = 96, 48
#: a passage reaches so many words beyond its seeds, and is cut after so many
REACH = 112
LONGEST = 1024
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: least part of a segment's own score that counts as a copy
THRESHOLD = 0.5
#: bits of the bitmap of seeds, by their number: at least and at most (32 MB), and per seed
LEAST_BITS, MOST_BITS, BITS_PER_SEED = 1 << 24, 1 << 28, 16


def item_segments(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, segment, words) of all test items that have a word."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), T.word_hashes(F.col(text_col)).alias("w")).where(
        F.col("item_id").isNotNull() & (F.size("w") > 0))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - F.lit(SEGMENT)) / F.lit(STEP))).cast("int")
    return rows.select("item_id", F.explode(F.sequence(F.lit(0), last)).alias("segment"), "w").select(
        "item_id", "segment", F.slice("w", F.col("segment") * STEP + 1, SEGMENT).alias("words")).distinct()


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = T.list_parts(batch.column(2))
        gram, row, at = T.word_grams(flat, offsets, GRAM)
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)),
             pa.array((np.diff(offsets) <= SHORT)[row])], names=["gram", "item_id", "segment", "at", "short"])


def seeds_of(segments: DataFrame) -> DataFrame:
    """(gram, item_id, segment, at, short): every n-gram of every segment."""
    return segments.mapInArrow(_item_grams, "gram long, item_id long, segment int, at int, short boolean")


def _hits(flat: np.ndarray, offsets: np.ndarray, bitmap: np.ndarray):
    """(document, position, gram) of the n-grams whose bit is set."""
    gram, doc, pos = T.word_grams(flat, offsets, GRAM)
    bit = gram.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    hit = np.flatnonzero((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
    return doc[hit], pos[hit], gram[hit]


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of the seeds' hashes, of a power of two between the bounds. With more
    seeds than the upper bound allows for, more hits go to the join, none is lost."""
    n = BITS_PER_SEED * grams.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << n.bit_length()))
    words = grams.select(F.col("gram").bitwiseAND(F.lit(bits - 1)).alias("bit")).distinct().select(
        F.expr("bit div 32").alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("one")).groupBy(
        "word").agg(F.sum("one").alias("bits")).toArrow()
    out = np.zeros(bits // 32, "<u4")
    out[np.asarray(words.column("word").combine_chunks())] = np.asarray(words.column("bits").combine_chunks()).astype("<u4")
    return out.view(np.uint8)


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, T.BATCH_ROWS):
                flat, offsets = T.list_parts(batch.slice(lo, T.BATCH_ROWS).column(0))
                doc, _, gram = _hits(flat, offsets, shared.value)
                if len(doc):
                    pairs = np.unique(np.stack([gram, doc], 1), axis=0)
                    gram, n = np.unique(pairs[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


def _passages(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, T.BATCH_ROWS):
                part = batch.slice(lo, T.BATCH_ROWS)
                flat, offsets = T.list_parts(part.column(2))
                doc, pos, gram = _hits(flat, offsets, shared.value)
                if not len(doc):
                    continue
                ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > REACH)
                run_of = np.cumsum(fresh)
                run_begin = pos[np.flatnonzero(fresh)][run_of - 1]
                fresh |= np.concatenate([[False], ((pos - run_begin)[1:] // LONGEST) != ((pos - run_begin)[:-1] // LONGEST)])
                heads = np.flatnonzero(fresh)
                tails = np.concatenate([heads[1:], [len(doc)]])
                out: list[list] = [[], [], [], [], [], []]
                for a, b in zip(heads, tails, strict=True):
                    d = doc[a]
                    begin = max(0, int(pos[a]) - REACH)
                    end = min(int(offsets[d + 1] - offsets[d]), int(pos[b - 1]) + REACH)
                    for col, v in zip(out, (ids[d], keys[d], begin, flat[offsets[d] + begin:offsets[d] + end], gram[a:b], (pos[a:b] - begin).astype(np.int32)), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int64())),
                     pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int32()))],
                    names=["doc_id", "k", "begin", "words", "grams", "places"])

    return run


def align(queries: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman (best score, end in the target) of every pair, all pairs at
    once, row by row. Gaps along the target are a running maximum."""
    n, height, width = len(queries), max(map(len, queries)), max(map(len, targets))
    q = np.zeros((n, height), np.int64)
    t = np.zeros((n, width), np.int64)
    q_ok, t_ok = np.zeros((n, height), bool), np.zeros((n, width), bool)
    for i, (a, b) in enumerate(zip(queries, targets, strict=True)):
        q[i, :len(a)], t[i, :len(b)], q_ok[i, :len(a)], t_ok[i, :len(b)] = a, b, True, True
    slope = (GAP * np.arange(width + 1)).astype(np.float32)
    row = np.zeros((n, width + 1), np.float32)
    best, end = np.zeros(n, np.float32), np.zeros(n, np.int64)
    for j in range(height):
        same = (t == q[:, j:j + 1]) & t_ok & q_ok[:, j:j + 1]
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, np.float32(MATCH), np.float32(MISMATCH)), row[:, 1:] + np.float32(GAP))
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new - slope, axis=1) + slope
        np.maximum(row, 0, out=row)
        row[~q_ok[:, j]] = 0
        top = row.max(1)
        better = top > best
        end[better] = row[better].argmax(1)
        best = np.maximum(best, top)
    return best, end


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate's segment against its stretch of the passage."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            rows = part.to_pydict()
            queries, targets = [], []
            for item, passage, low, high in zip(rows["item_words"], rows["words"], rows["low"], rows["high"], strict=True):
                slack = len(item) // 4 + 4
                a = max(0, low - slack)
                queries.append(np.array(item, np.int64))
                targets.append(np.array(passage[a:high + len(item) + slack], np.int64))
            best, _ = align(queries, targets)
            share = best / np.array([MATCH * len(x) for x in queries])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("item_id"), part.column("segment"), pa.array(np.round(share.astype(np.float64), 4)),
                 pa.array((np.array(rows["begin"]) + np.array(rows["low"])).astype(np.int64))],
                names=["doc_id", "item_id", "segment", "score", "place"])


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, place): the pairs of a document and a test item of
    which it holds an exact or edited copy, with the best alignment's score (1: a
    whole, exact copy) and about where it begins, in words.

    * null ids and null, empty or word-less texts match nothing;
    * items of fewer than n words mark documents of the same words and nothing else;
    * repeated rows: one row per pair of ids; ties: the first place;
    * very long texts are cut into passages, long items into segments;
    * empty tables: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    segments = T.reliable(item_segments(items, id_col=item_col, text_col=item_text_col))
    grams = T.reliable(seeds_of(segments))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("k"),
                       T.word_hashes(F.col(text_col)).alias("words")).where(F.col("doc_id").isNotNull())
    possible = spark.sparkContext.broadcast(_bitmap(grams))
    held = texts.select("words").mapInArrow(_counts(possible), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df"))
    rated = grams.where("not short").join(held, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    around = Window.partitionBy("item_id", "segment").orderBy("at")  # at most SEGMENT rows
    before, after = F.lag("df").over(around), F.lead("df").over(around)
    # the rarer of two neighbours, the first of equals, and whatever has no neighbour
    seeds = T.reliable(rated.select("gram", "item_id", "segment", "at", "df", before.alias("b"), after.alias("a")).where(
        (F.col("b").isNull() & F.col("a").isNull()) | (F.col("df") < F.col("b")) | (F.col("df") <= F.col("a"))).select(
        "gram", "item_id", "segment", "at").union(grams.where("short").select("gram", "item_id", "segment", "at")))
    rare = spark.sparkContext.broadcast(_bitmap(seeds))
    passages = T.reliable(texts.mapInArrow(
        _passages(rare), "doc_id long, k long, begin long, words array<long>, grams array<long>, places array<int>"))
    met = passages.select("doc_id", "k", "begin", F.explode(F.arrays_zip("grams", "places")).alias("g")).select(
        "doc_id", "k", "begin", F.col("g.grams").alias("gram"), F.col("g.places").alias("place")).join(seeds, "gram")
    # hits whose diagonals differ by less than a few words are one candidate
    spots = met.select("doc_id", "k", "begin", "item_id", "segment", (F.col("place") - F.col("at")).alias("diagonal")).groupBy(
        "doc_id", "k", "begin", "item_id", "segment", F.floor(F.col("diagonal") / 32).alias("near")).agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    one = passages.select("doc_id", "k", "begin", "words").dropDuplicates(["doc_id", "k", "begin"])
    pairs = spots.join(segments.withColumnRenamed("words", "item_words"), ["item_id", "segment"]).join(one, ["doc_id", "k", "begin"]).select(
        "doc_id", "item_id", "segment", "begin", "low", "high", "item_words", "words")
    scored = pairs.mapInArrow(_aligned, "doc_id long, item_id long, segment int, score double, place long")
    tiny = segments.where(F.size("words") < GRAM).select("item_id", "words").join(
        texts.where((F.size("words") > 0) & (F.size("words") < GRAM)), "words").select(
        "doc_id", "item_id", F.lit(0).alias("segment"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("place"))
    return scored.union(tiny).where(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", (-F.col("place")).alias("p"))).alias("top")).select(
        "doc_id", "item_id", F.col("top.score").alias("score"), F.greatest(F.lit(0), -F.col("top.p")).alias("place"))
