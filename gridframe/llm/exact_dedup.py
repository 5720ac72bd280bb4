"""Exact duplicates by a tree-merge of sorted digest runs.

Texts are equal if they are the same after their ASCII white space is deleted.

1. Every task turns its rows into *runs*: the distinct SHA-256 digests of its
   normalised texts, sorted, each with the row that would stay and the number of
   rows. A run holds at most ``run_rows`` rows.
2. Runs are exchanged in binomial rounds. In a round a node cuts its run at the
   next four bits of the digest and hands one part to each node of its group of
   ``FAN_IN``; every node merges the sorted parts it gets, keeping per digest the
   row that stays. Groups widen and digest ranges narrow at the same rate, so
   there are as many nodes after a round as before and none holds more than its
   share. After the last round a node has one digest range of the whole corpus.
3. The answers (row that stays, rows in all) go back the same way, each to the
   parts that held the digest, down to the runs and their rows.

A text that a third of all rows share is one entry per run on every level, up and
down, so no node is hot. Equal digests are verified at every merge by the
normalised lengths; a mismatch fails the job. Levels are checkpointed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import text as T
from gridframe.session import ship_package

WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: bits of the digest that a round decides; the fan-in is two to this power
ROUND_BITS = 4
FAN_IN = 1 << ROUND_BITS
RUN_ROWS = 200_000
#: marks a row without an id, so that it stays only if no row with an id does
NO_ID = 1 << 62

ENTRY = "digests binary, bytes array<long>, chars array<long>, ids array<long>, rows array<long>, n array<long>"
ANSWER = "at long, digit long, keep_ids array<long>, keep_rows array<long>, totals array<long>"
_ANSWERS = ("keep_ids", "keep_rows", "totals")
_FIELDS = ("bytes", "chars", "ids", "rows", "n")


class Run:
    """Sorted distinct digests with, per digest: bytes of the normalised text, code
    points, id and number of the row that stays, and the count of rows."""

    def __init__(self, digests: np.ndarray, fields: dict[str, np.ndarray]):
        self.digests, self.fields = digests, fields

    @staticmethod
    def merged(digests: np.ndarray, fields: dict[str, np.ndarray]) -> tuple[Run, np.ndarray]:
        """The run of several sorted parts laid end to end, and each entry's place in it.

        The stable sort finds the sorted parts and merges them."""
        words = digests.reshape(-1, 32).view(">u8").astype(np.uint64)
        order = np.argsort(words[:, 0], kind="stable")
        head = words[order]
        same_head = head[1:, 0] == head[:-1, 0]
        same = same_head & (head[1:] == head[:-1]).all(1)
        if (same_head & ~same).any():  # different digests with equal first words
            order = np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
            head = words[order]
            same = (head[1:] == head[:-1]).all(1)
        group = np.zeros(len(order), np.int64)
        group[1:] = np.cumsum(~same)
        place = np.empty(len(order), np.int64)
        place[order] = group
        best = np.lexsort((fields["rows"], fields["ids"], -fields["chars"], place))
        first = np.ones(len(best), bool)
        first[1:] = place[best][1:] != place[best][:-1]
        keep = best[first]
        if (fields["bytes"] != fields["bytes"][keep][place]).any():
            raise ValueError("texts of different lengths share a SHA-256 digest")
        out = {k: fields[k][keep] for k in ("bytes", "chars", "ids", "rows")}
        out["n"] = np.zeros(len(keep), np.int64)
        np.add.at(out["n"], place, fields["n"])
        return Run(digests.reshape(-1, 32)[keep], out), place

    def part(self, a: int, b: int) -> tuple:
        return (self.digests[a:b].tobytes(), *[self.fields[k][a:b] for k in _FIELDS])


def _table(columns: dict[str, list], keys: dict[str, pa.DataType]) -> pa.Table:
    types = {**keys, "digests": pa.binary(), "doc_ids": pa.list_(pa.int64()), "places": pa.list_(pa.int64()),
             **{k: pa.list_(pa.int64()) for k in (*_FIELDS, *_ANSWERS)}}
    return pa.table({k: pa.array(v, types[k]) for k, v in columns.items()})


def _flat(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {k: T.list_parts(table.column(k))[0].astype(np.int64) for k in names}


def _entries(table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    raw = b"".join(table.column("digests").to_pylist())
    return np.frombuffer(raw, np.uint8), _flat(table, _FIELDS)


def _leaves(run_rows: int):
    """Rows to runs: (part, seq, doc_ids, places) of the rows and the run's entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, sizes, chars, seq, part = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            m = len(ids)
            number = np.arange(m, dtype=np.int64) + (np.int64(part) << 31) + seq * run_rows
            null = np.array([i is None for i in ids])
            fields = {"bytes": np.array(sizes, np.int64), "chars": np.array(chars, np.int64),
                      "ids": np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64),
                      "rows": number + null * NO_ID, "n": np.ones(m, np.int64)}
            made, place = Run.merged(np.frombuffer(b"".join(digests), np.uint8), fields)
            entry = made.part(0, len(made.digests))
            cols = {"part": [part], "seq": [seq], "doc_ids": [ids], "places": [place]}
            cols |= {k: [v] for k, v in zip(("digests", *_FIELDS), entry, strict=True)}
            return _table(cols, {"part": pa.int64(), "seq": pa.int64()}).combine_chunks().to_batches()[0]

        for batch in batches:
            for doc_id, raw, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, part = raw.as_py() or b"", p
                text = raw.translate(None, WHITE_SPACE)
                ids.append(doc_id)
                digests.append(hashlib.sha256(text).digest())
                sizes.append(len(text))
                chars.append(len(raw.decode("utf-8", "replace")))
                if len(ids) == run_rows:
                    yield close()
                    ids, digests, sizes, chars, seq = [], [], [], [], seq + 1
        if ids:
            yield close()

    return run


def _cut(level: int):
    """Cut runs of a level at the next digest bits: (parent, node, digit) and entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(batch.num_rows):
                row = table.slice(i, 1)
                node = row.column("node")[0].as_py()
                whole = Run(*_entries(row))
                whole.digests = whole.digests.reshape(-1, 32)
                prefix = whole.digests[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - ROUND_BITS * (level + 1))
                digits = (prefix & np.uint64(FAN_IN - 1)).astype(np.int64)
                ends = np.searchsorted(digits, np.arange(FAN_IN + 1))
                cols: dict[str, list] = {k: [] for k in ("parent", "node", "digit", "digests", *_FIELDS)}
                group, mine = node >> (ROUND_BITS * level), node & ((1 << ROUND_BITS * level) - 1)
                for d in np.flatnonzero(np.diff(ends)):
                    parent = ((group // FAN_IN) << (ROUND_BITS * (level + 1))) | (mine * FAN_IN + int(d))
                    for k, v in zip(cols, (parent, node, int(d), *whole.part(ends[d], ends[d + 1])), strict=True):
                        cols[k].append(v)
                yield from _table(cols, {"parent": pa.int64(), "node": pa.int64(), "digit": pa.int64()}).combine_chunks().to_batches()

    return run


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("node", "ascending"), ("digit", "ascending")])


def _merge(key, table):
    made, _ = Run.merged(*_entries(_in_order(table)))
    cols = {"node": [key[0].as_py()], **{k: [v] for k, v in zip(("digests", *_FIELDS), made.part(0, len(made.digests)), strict=True)}}
    return _table(cols, {"node": pa.int64()})


def _answer_parts(key, parts, answers):
    """A node's answers, cut up again for the parts it was merged from."""
    parts = _in_order(parts)
    _, place = Run.merged(*_entries(parts))
    answer = _flat(answers.sort_by("digit"), _ANSWERS)
    ends = np.cumsum([0, *[len(x) // 32 for x in parts.column("digests").to_pylist()]])
    cols = {"at": parts.column("node").to_pylist(), "digit": parts.column("digit").to_pylist()}
    for k in _ANSWERS:
        cols[k] = [answer[k][place[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return _table(cols, {"at": pa.int64(), "digit": pa.int64()})


def _rows(run_rows: int):
    def run(key, leaf, answers):
        answer = _flat(answers.sort_by("digit"), _ANSWERS)
        place = _flat(leaf, ("places",))["places"]
        ids = leaf.column("doc_ids").combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        number = np.arange(len(place)) + (leaf.column("part")[0].as_py() << 31) + leaf.column("seq")[0].as_py() * run_rows
        digests = np.frombuffer(leaf.column("digests")[0].as_py(), np.uint8).reshape(-1, 32)
        sha = pa.array([d.tobytes().hex() for d in digests])
        keep, rows = answer["keep_ids"][place], answer["keep_rows"][place]
        return pa.table({"doc_id": ids, "keep_id": pa.array(keep, mask=rows >= NO_ID), "group_size": pa.array(answer["totals"][place]),
                         "kept": pa.array((rows & (NO_ID - 1)) == number), "text_sha256": sha.take(pa.array(place))})

    return run


def _numbered(leaves: DataFrame) -> DataFrame:
    """Number the runs without gaps (one count per task goes through the driver)."""
    counts = sorted(tuple(r) for r in leaves.groupBy("part").count().collect())
    bases, total = [], 0
    for part, count in counts:
        bases.append((part, total))
        total += count
    base = leaves.sparkSession.createDataFrame(bases, "part long, base long")
    return leaves.join(F.broadcast(base), "part").withColumn("node", F.col("base") + F.col("seq")).drop("base")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row. Of the rows with
    equal texts the one with the most code points stays, then the least id.

    * null text: as empty; empty and blank texts are one group;
    * null ids: like others, but after all ids in a tie; ``keep_id`` is null if such a row stays;
    * repeated rows: each counts, exactly one row of a group has ``kept``;
    * very long texts: hashed whole; empty table: no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"),
                       F.spark_partition_id().cast("long"))
    leaves = T.reliable(rows.mapInArrow(_leaves(run_rows), f"part long, seq long, doc_ids array<long>, places array<long>, {ENTRY}"))
    leaves = _numbered(leaves)
    runs, rounds = leaves.select("node", "digests", *_FIELDS), 0
    n_runs = leaves.count()
    parts = []
    while FAN_IN ** rounds < n_runs:
        parts.append(T.reliable(runs.mapInArrow(_cut(rounds), f"parent long, node long, digit long, {ENTRY}")))
        runs = parts[-1].groupBy("parent").applyInArrow(_merge, f"node long, {ENTRY}")
        rounds += 1
    answers = runs.select(F.col("node").alias("at"), F.lit(0).cast("long").alias("digit"), F.col("ids").alias("keep_ids"),
                          F.col("rows").alias("keep_rows"), F.col("n").alias("totals"))
    for level in reversed(parts):
        answers = level.groupBy("parent").cogroup(answers.groupBy("at")).applyInArrow(_answer_parts, ANSWER)
    return leaves.groupBy("node").cogroup(answers.groupBy("at")).applyInArrow(
        _rows(run_rows), "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
