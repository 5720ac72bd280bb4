"""Alignment of two tokenizers by inverted pair bitmaps.

Two tokenizers cut the same bytes. A token of A and a token of B are linked if
their byte ranges overlap; places where both end cut a text into groups.

1. Every task encodes its texts and makes blocks of documents. A block is an
   inverted index: per pair of linked ids the bitmap of its documents, compressed
   (a sorted list of 16-bit numbers if few, else bits), and *multiplicity planes*,
   bit by bit the number of links of the pair in each of its documents. Bitmaps
   of a task's batches are OR-merged into the block.
2. A pair's documents are the popcounts of its bitmaps, summed over the blocks:
   blocks share no document, so that is the popcount of their union. Per id of A
   the highest count is marked.
3. The counts are joined back to the blocks that asked, and a block's postings
   hand them to its documents: per document the sum over its links.

Only pair counts and answers are rows, one per pair and block, never one per
pair and document. A pair that all documents hold is one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import text as T
from gridframe.llm import tokens
from gridframe.session import scratch_path, ship_package

#: documents of a block have 16-bit numbers
BLOCK_DOCS = 1 << 15
BLOCK_ENTRIES = 2_000_000
#: bytes of text that are linked at once
STEP_BYTES = 1 << 20

_DOC = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "hashes array<string>, pairs array<long>, dfs array<long>, few binary, many binary, planes array<binary>")


def segments(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of every stretch between neighbouring token ends, which are
    the overlapping occurrence pairs, and the ends that both share."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    ends = both[~again]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), both[again]


class Linker:
    """Tokens, groups and links of a few texts at a time."""

    def __init__(self, byte_path: str | None, piece_path: str | None):
        self.a, self.b = tokens.byte_bpe(byte_path), tokens.piece_model(piece_path)
        if self.a.size * self.b.size >= 1 << 47:
            raise ValueError("the two vocabularies are too large for 47-bit pair numbers")
        self.len_a = np.array([len(x) for x in self.a.token_bytes])
        self.len_b = np.array([len(x) for x in self.b.token_bytes])
        self.bytes_a, self.bytes_b = pa.array(self.a.token_bytes, pa.binary()), pa.array(self.b.token_bytes, pa.binary())
        self.names = pa.array([f"{i}{s}".encode() for i in range(max(self.a.size, self.b.size)) for s in (",", "|", ";", "")], pa.binary())

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        if not len(ids):
            return memoryview(b""), np.zeros(1, np.int32)
        taken = table.take(pa.array(ids))
        ends = np.asarray(pa.Array.from_buffers(pa.int32(), len(ids) + 1, [None, taken.buffers()[1]], offset=taken.offset))
        return memoryview(taken.buffers()[2] or b"").cast("B"), ends

    def _lossless(self, ids: np.ndarray, counts: np.ndarray, table: pa.Array, raw: list[bytes]) -> np.ndarray:
        """Do the tokens of each text join to its bytes?"""
        data, ends = self._joined(table, ids)
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
        return np.array([data[x:y] == r for x, y, r in zip(cuts[:-1], cuts[1:], raw, strict=True)], bool)

    def link(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """(counts per text, group hashes, pair number and text of every link)."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        of_a = [self.a.encode(" " + t) if t else np.zeros(0, np.uint32) for t in texts]
        of_b = self.b.encode([t or "" for t in texts])
        ca, cb = np.array([len(x) for x in of_a]), np.array([len(x) for x in of_b])
        ia = np.concatenate(of_a).astype(np.int64)
        ib = np.fromiter((i for x in of_b for i in x), np.int64, int(cb.sum()))
        ok = self._lossless(ia, ca, self.bytes_a, raw) & self._lossless(ib, cb, self.bytes_b, raw)
        ia, ib = ia[np.repeat(ok, ca)], ib[np.repeat(ok, cb)]
        ca, cb = ca * ok, cb * ok
        ends_a, ends_b = np.cumsum(self.len_a[ia]), np.cumsum(self.len_b[ib])  # texts end to end
        doc_a = np.repeat(np.arange(len(texts)), ca)
        sa, sb, shared = segments(ends_a, ends_b)
        last_a = np.searchsorted(ends_a, shared)
        counts = {"n_a": ca, "n_b": cb, "n_groups": np.bincount(doc_a[last_a], minlength=len(texts)),
                  "n_links": np.bincount(doc_a[sa], minlength=len(texts))}
        return counts, self._hashes(ia, ib, ca, cb, ends_a, ends_b, shared), ia[sa] * self.b.size + ib[sb], doc_a[sa]

    def _hashes(self, ia, ib, ca, cb, ends_a, ends_b, shared) -> list[str]:
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        after_a, after_b = np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1  # tokens up to each group's end
        before_b = np.concatenate([[0], after_b])
        order = np.empty(len(ia) + len(ib), np.int64)
        mark_a, mark_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        mark_a[after_a - 1], mark_b[after_b - 1] = 1, 2
        mark_b[(np.cumsum(cb) - 1)[cb > 0]] = 3
        order[np.arange(len(ia)) + before_b[group_a]] = ia * 4 + mark_a
        order[np.arange(len(ib)) + after_a[group_b]] = ib * 4 + mark_b
        data, ends = self._joined(self.names, order)
        cuts = ends[np.concatenate([[0], np.cumsum(ca + cb)])]
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_postings(keys: np.ndarray, n_docs: int) -> dict:
    """Compressed bitmaps and planes of sorted (pair << 16 | document) occurrences."""
    entry, links = np.unique(keys, return_counts=True)
    pairs, dfs = np.unique(entry >> 16, return_counts=True)
    docs = (entry & 0xFFFF).astype("<u2")
    dense = dfs * 16 > n_docs
    many = np.repeat(dense, dfs)
    bits = np.zeros((int(dense.sum()), n_docs), bool)
    bits[np.repeat(np.arange(len(bits)), dfs[dense]), docs[many]] = True
    planes, rest = [], links
    while rest.any():
        planes.append(np.packbits((rest & 1).astype(bool)).tobytes())
        rest = rest >> 1
    return {"pairs": pairs, "dfs": dfs, "few": docs[~many].tobytes(), "many": np.packbits(bits, axis=1).tobytes(), "planes": planes}


def decode_postings(dfs: np.ndarray, few: bytes, many: bytes, planes: list[bytes], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, links) of every entry, in the order of the pairs."""
    dense = dfs * 16 > n_docs
    docs = np.empty(int(dfs.sum()), np.int64)
    at = np.repeat(dense, dfs)
    docs[~at] = np.frombuffer(few, "<u2")
    if dense.any():
        bits = np.unpackbits(np.frombuffer(many, np.uint8).reshape(int(dense.sum()), -1), axis=1, count=n_docs)
        docs[at] = np.nonzero(bits)[1]
    links = np.zeros(len(docs), np.int64)
    for p, raw in enumerate(planes):
        links |= np.unpackbits(np.frombuffer(raw, np.uint8), count=len(docs)).astype(np.int64) << p
    return docs, links


def _blocks(byte_path, piece_path, block_docs: int, block_entries: int, step_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, part, seq = Linker(byte_path, piece_path), 0, 0
        ids, texts, size = [], [], 0
        done_ids, done, hashes, keys, held = [], {k: [] for k in _DOC}, [], [], 0

        def step() -> None:
            nonlocal ids, texts, size, held
            counts, sha, pair, doc = linker.link(texts)
            keys.append(np.sort((pair << 16) | (doc + len(done_ids))))
            held += len(pair)
            for k in _DOC:
                done[k].append(counts[k])
            hashes.extend(sha)
            done_ids.extend(ids)
            ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal done_ids, done, hashes, keys, held, seq
            row = {"block": (part << 32) | seq, "doc_ids": done_ids, **{k: np.concatenate(v) for k, v in done.items()}, "hashes": hashes,
                   **encode_postings(np.concatenate(keys), len(done_ids))}
            done_ids, done, hashes, keys, held, seq = [], {k: [] for k in _DOC}, [], [], 0, seq + 1
            kind = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
                    "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
            fields = [f.split() for f in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([row[n]], kind[t]) for n, t in fields], names=[n for n, _ in fields])

        for batch in batches:
            for doc_id, text, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, part = text.as_py(), p
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size >= step_bytes or len(ids) + len(done_ids) >= block_docs:
                    step()
                if held >= block_entries or len(done_ids) >= block_docs:
                    yield close()
        if ids:
            step()
        if done_ids:
            yield close()

    return run


def _scored(key, blocks, answers):
    """Sums of a block's links over the counts of their pairs, per document."""
    answers = answers.sort_by("pair")
    count = np.asarray(answers.column("n").combine_chunks()).astype(np.int64)
    best = np.asarray(answers.column("best").combine_chunks().cast(pa.int8())).astype(np.int64)
    n_docs = len(blocks.column("doc_ids")[0])
    dfs = T.list_parts(blocks.column("dfs"))[0].astype(np.int64)
    docs, links = decode_postings(dfs, blocks.column("few")[0].as_py(), blocks.column("many")[0].as_py(),
                                  blocks.column("planes")[0].as_py(), n_docs)
    pair = np.repeat(np.arange(len(dfs)), dfs)
    sums, bests = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    np.add.at(sums, docs, links * count[pair])
    np.add.at(bests, docs, links * best[pair])
    flat = {c: blocks.column(c).combine_chunks().flatten() for c in ("doc_ids", "hashes", *_DOC)}
    return pa.table({"doc_id": flat["doc_ids"], **{k: flat[k] for k in _DOC}, "n_best": pa.array(bests),
                     "count_sum": pa.array(sums), "groups_sha256": flat["hashes"]})


def pair_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", byte_path: str | None = None,
                piece_path: str | None = None, block_docs: int = BLOCK_DOCS, block_entries: int = BLOCK_ENTRIES,
                step_bytes: int = STEP_BYTES) -> DataFrame:
    """The blocks of the corpus, written to the shared folder and read back."""
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block holds 1 to 65536 documents")
    spark = docs.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "pair-blocks")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long"))
    rows.mapInArrow(_blocks(byte_path, piece_path, block_docs, block_entries, step_bytes), BLOCK).write.option(
        "compression", "zstd").parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(pair, id_a, id_b, n, best): documents of every pair, and is it the most of its id of A."""
    asked = blocks.select(F.explode(F.arrays_zip("pairs", "dfs")).alias("x"))
    counts = T.reliable(asked.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.dfs").alias("n")).select(
        "pair", F.expr(f"pair div {int(size_b)}").alias("id_a"), (F.col("pair") % size_b).alias("id_b"), "n"))
    most = counts.groupBy("id_a").agg(F.max("n").alias("most"))
    return counts.join(most, "id_a").select("pair", "id_a", "id_b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(docs: DataFrame, *, piece_path: str | None = None, **options) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    * null and empty texts, and texts that a tokenizer does not give back byte by
      byte: no tokens, zeros and an empty hash;
    * null ids: like others; repeated rows: each is a document of its own and counts;
    * very long texts: encoded whole; empty table: no rows; other columns are not read.
    """
    blocks = pair_blocks(docs, piece_path=piece_path, **options)
    counts = pair_counts(blocks, tokens.piece_model(piece_path).size)
    asked = blocks.select(F.col("block").alias("at"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select("at", "pair", "n", "best")
    return blocks.groupBy("block").cogroup(answers.groupBy("at")).applyInArrow(
        _scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
