"""Packing by concatenate and cut.

All documents, each followed by an end id, form one long run of token ids that
is cut into fixed windows. Two passes:

1. every partition tokenises its texts and writes the ids once, with each
   document's start inside the partition (a running sum), to a table in the
   shared folder. The token totals per partition, one number each, are summed
   up to global partition offsets.
2. the stored ids, shifted by their partition's offset, are cut at the window
   bounds. Every document emits its boundary records (pieces) by itself, so no
   row moves between tasks and no window is gathered anywhere.

Ids are those of the byte-level BPE file, as ``Tokenizer.encode`` of the
``tokenizers`` library gives them (see ``tokens.ByteBpe``); an added token of the
file in a text (as ``<|endoftext|>``) gets its own id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import tokens
from gridframe.session import scratch_path, ship_package

WINDOW = 2048
END_ID = 1


def _binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of numbers laid end to end, as one Arrow array of their bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _tokenise(tokenizer_path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.byte_bpe(tokenizer_path, added_tokens=True)
        # two bytes an id where they suffice: half the table
        kind = np.dtype("<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4")
        end, start = np.array([end_id], np.uint32), 0
        for batch in batches:
            parts, lengths = [], np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "")
                parts += [ids, end]
                lengths[i] = len(ids) + 1
            starts = start + np.cumsum(lengths) - lengths
            start += int(lengths.sum())
            stored = _binary(np.concatenate([end[:0], *parts]).astype(kind), lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(starts), pa.array(lengths), stored],
                                             names=["doc_id", "part", "part_start", "doc_tokens", "ids"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for doc_id, begin, n, raw in zip(*cols, strict=True):
                ids = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                view = memoryview(ids)
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, window)
                    length = min(window - offset, n - at)
                    for col, v in zip(out, (doc_id, at, length, zlib.crc32(view[4 * at:4 * (at + length)]), n, sequence, offset), strict=True):
                        col.append(v)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def token_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass 1: (doc_id, part, part_start, doc_tokens, ids binary), written to the
    shared folder and read back. ``ids`` are little-endian, two bytes each
    where the vocabulary has at most 65536, else four."""
    spark = docs.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "packing-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.spark_partition_id().alias("part"))
    rows.mapInArrow(_tokenise(tokenizer_path, end_id),
                    "doc_id long, part int, part_start long, doc_tokens long, ids binary").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """(part, part_offset): where each partition begins in the whole run. One row
    per partition of pass 1, so the prefix sum over them is small."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total")).collect()
    rows, running = [], 0
    for part, total in sorted((r[0], r[1]) for r in totals):
        rows.append((part, running))
        running += total
    return tokens.sparkSession.createDataFrame(rows, "part int, part_offset long")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Boundary records of the packed windows, one per piece of a document:
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every window but the last is full, so nothing is padded elsewhere.

    * null text: as empty; an empty document is its end id alone;
    * null id: packed like any other, with a null ``doc_id``;
    * repeated rows: each is packed;
    * very long texts: cut over as many windows as they need;
    * empty table: no rows. Other columns are not read, whatever their names.
    """
    tokens = token_table(docs, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path, end_id=end_id)
    placed = tokens.join(F.broadcast(partition_offsets(tokens)), "part").select(
        "doc_id", (F.col("part_offset") + F.col("part_start")).alias("begin"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                           "sequence_id long, offset long")
