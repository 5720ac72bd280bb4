"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers, floor(scale * x). The table is dealt into blocks; a
task holds its block's components as one sorted list per dimension. For every
query the lists are read in step, each from the end that its query component
favours: a vector met for the first time is scored in full, and the bound is
the sum, over the dimensions, of the query component times the value at the
reading depth. No unread vector of the block can beat the bound, so reading
stops when it cannot beat the query's k-th best score, or when all vectors of the
block have been met. A query's best k of
every block meet in a partial and a final ranking.

Queries travel in blocks of fixed size to every block of vectors, so neither
side is ever whole in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.llm import text as T
from gridframe.session import ship_package

K = 10
SCALE = 1024
#: vectors of a block, queries of a query block, list entries read in the first step (each next step reads twice as many)
BLOCK, QUERY_BLOCK, STEP = 1024, 512, 8


def integer_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part: not null, with no
    null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


class Block:
    """A block of vectors with its sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")  # rising values
        self.sorted = np.take_along_axis(self.vectors, self.lists, axis=0)

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The block's best k (score, id) for a query, ties to the smaller id, among
        rows of another id."""
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        if not len(used):  # every score is 0: the smallest ids
            ids = self.ids[self.ids != query_id][:k]
            return [(0, int(i)) for i in ids]
        up = query[used] > 0
        seen = np.zeros(n, bool)
        best: list[tuple[int, int]] = []
        depth, step, unmet = 0, STEP, n
        while unmet:
            end, step = min(n, depth + step), 2 * step
            at = np.arange(depth, end)
            rows = np.where(up[None, :], n - 1 - at[:, None], at[:, None])
            met = self.lists[rows, used[None, :]].ravel()
            met = np.unique(met[~seen[met]])
            seen[met] = True
            unmet -= len(met)
            scores = self.vectors[met] @ query
            if len(met) > k:  # the k-th best of these bounds what can matter
                keep = np.flatnonzero(scores >= np.partition(scores, len(met) - k - 1)[len(met) - k - 1])
                met, scores = met[keep], scores[keep]
            best = sorted(best + [(-int(s), int(i)) for s, i in zip(scores, self.ids[met], strict=True) if i != query_id])[:k]
            depth = end
            if len(best) == k:
                last = np.where(up, n - end, end - 1)
                bound = int((self.sorted[last, used] * query[used]).sum())
                if bound < -best[-1][0]:  # an equal score could still have a smaller id
                    break
        return [(-s, i) for s, i in best]


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        for dims in sorted(set(pc.list_value_length(table.column("v")).to_pylist())):
            part = table.filter(pc.equal(pc.list_value_length(table.column("v")), dims))
            values, _ = T.list_parts(part.column("v"))
            matrix = values.reshape(part.num_rows, dims)
            ids, is_query = np.asarray(part.column("vec_id")), np.asarray(part.column("is_query"))
            if is_query.all() or not is_query.any():
                continue
            block = Block(ids[~is_query], matrix[~is_query])
            for query_id, query in zip(ids[is_query].tolist(), matrix[is_query], strict=True):
                for score, vec_id in block.top(query_id, query, k):
                    for col, v in zip(out, (query_id, vec_id, score), strict=True):
                        col.append(v)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best k rows of another id.

    Both tables are (vec_id, v array<long>), see ``integer_vectors``.

    * vectors of another length than the query's have no inner product with it;
    * ties go to the smaller vec_id; fewer candidates than k: all of them;
    * repeated rows: of one id, the largest vector stands, as query and candidate;
    * an empty table gives no rows; other columns are not read;
    * products that exceed 64 bits wrap around.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = T.reliable(vectors.groupBy("vec_id").agg(F.max("v").alias("v")))
    asked = T.reliable(queries.groupBy("vec_id").agg(F.max("v").alias("v")))
    n_blocks, n_query_blocks = (max(1, -(-d.count() // size)) for d, size in ((rows, BLOCK), (asked, QUERY_BLOCK)))
    part, query_part = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks))
    candidates = rows.select("vec_id", "v", F.lit(False).alias("is_query"), part.cast("int").alias("block"),
                             F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("query_block"))
    placed = asked.select("vec_id", "v", F.lit(True).alias("is_query"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), query_part.cast("int").alias("query_block"))
    local = candidates.union(placed).groupBy("block", "query_block").applyInArrow(
        _search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
