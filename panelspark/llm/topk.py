"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each block of candidates has one sorted list for every dimension, read from the end that the query's sign favours, deeper
step by step. After each step the entries read give every candidate a lower bound (unread entries at their list's far end)
and an upper bound (unread entries where reading stands); candidates whose upper bound lies below the k-th lower bound of
the query cannot qualify and are dropped. A query stops reading once the bounds of all its remaining candidates meet:
these are their scores. No vector is ever looked up out of the order of the lists.

Bounds of a group of queries are matrix products of the lists' read parts, over candidates that some query still keeps.

Defined results: vectors that are null, empty, of another length than most, or that hold null or non-finite components take
no part; ties go to the smaller id; rows with a repeated id are candidates of their own,
and a query id given more than once asks with the least of its vectors; rows with a null id take no
part; a query is no candidate of itself (no row with its id is); other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of candidates, and of queries where both sides are dealt: 64 dimensions of 8 bytes make 4 MB.
BLOCK = 8_192
#: Queries whose bounds are held at once.
GROUP = 256
#: Numbers (8 bytes each) of all queries together that may be sent to every task; more are dealt in blocks.
BROADCAST_NUMBERS = 1 << 22
#: Shares of each list after which bounds are looked at; the last step reads to the end.
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id and v (floor of scale times each component) of the vectors that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))


def read_lists(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int, trace: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (id, best ids, their scores) among one block of candidates. trace gets (depth, queries still reading)."""
    n = len(ids)
    lists = np.sort(block, axis=0)  # lists[:, d] read downwards or upwards is dimension d's sorted list
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    alive = ids[None, :] != query_ids[:, None]
    scores = np.full(alive.shape, -np.inf)
    reading, rows = np.arange(len(queries)), np.arange(n)
    for share in DEPTHS:
        depth = max(1, int(n * share))
        if depth <= k and share < 1:
            continue
        if trace is not None:
            trace.append((depth, len(reading)))
        part, u, d = block[rows], up[reading], down[reading]
        if depth < n:
            top, bottom = lists[n - depth], lists[depth - 1]  # where reading stands, for either sign
            read_up, read_down = part >= top, part <= bottom
            low = u @ np.where(read_up, part, lists[0]).T + d @ np.where(read_down, part, lists[-1]).T
            high = u @ np.where(read_up, part, top).T + d @ np.where(read_down, part, bottom).T
        else:
            low = high = (u + d) @ part.T
        kept = alive[np.ix_(reading, rows)]
        if len(rows) > k:
            floor = np.partition(np.where(kept, low, -np.inf), len(rows) - k, axis=1)[:, len(rows) - k]
            kept &= high >= floor[:, None]
        alive[np.ix_(reading, rows)] = kept
        done = ~(kept & (low < high)).any(axis=1)
        scores[np.ix_(reading[done], rows)] = np.where(kept[done], low[done], -np.inf)
        reading = reading[~done]
        if not len(reading):
            break
        rows = rows[kept[~done].any(axis=0)]
    for q, own in enumerate(query_ids):
        found = np.flatnonzero(scores[q] > -np.inf)
        best = found[np.lexsort((ids[found], -scores[q, found]))[:k]]
        yield int(own), ids[best], scores[q, best]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _found(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> pa.Table:
    found = [x for at in range(0, len(queries), GROUP) for x in read_lists(query_ids[at : at + GROUP], queries[at : at + GROUP], ids, block, k)]
    counts = [len(i) for _, i, _ in found]
    columns = [np.repeat(np.asarray([q for q, _, _ in found], dtype=np.int64), counts), np.concatenate([i for _, i, _ in found]).astype(np.int64), np.concatenate([s for _, _, s in found]).astype(np.int64)]
    return pa.table(columns, names=["query_id", "vec_id", "score"])


def _against_all(query_ids: np.ndarray, queries: np.ndarray, width: int, k: int):
    """Blocks of whatever candidates a task has, against the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            yield from _found(query_ids, queries, table.column("id").to_numpy(), _matrix(table.column("v"), width), k).to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield from block()
        if held and sum(b.num_rows for b in held):
            yield from block()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries its k highest integer inner products in vectors.

    Queries of a proven size go to every task, and candidates stay where they are. More queries are dealt, as candidates
    are, in blocks of one size by a hash of the id; every pair of blocks is one key, so a task holds two blocks. Either way
    k rows for each query and block go on to the merge.
    """
    candidates = quantised(vectors, id_column, vector_column, scale)
    asked = quantised(queries, id_column, vector_column, scale)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    counts = candidates.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    out = "query_id long, vec_id long, score long"
    if counts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = counts["width"]
    candidates, asked = candidates.where(F.size("v") == width), asked.where(F.size("v") == width)
    n_asked = asked.count()
    if n_asked * width <= BROADCAST_NUMBERS:
        held = asked.orderBy("id").toArrow()
        found = _against_all(held.column("id").to_numpy(), _matrix(held.column("v"), width), width, k)
        partial = candidates.mapInArrow(found, out)
    else:
        c_blocks, q_blocks = -(-counts["count"] // BLOCK), -(-n_asked // BLOCK)
        to = lambda frame, own, mine, others, name: frame.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(name))
        dealt_c, dealt_q = to(candidates, "c", c_blocks, q_blocks, "q"), to(asked, "q", q_blocks, c_blocks, "c")

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
            return _found(right.column("id").to_numpy(), _matrix(right.column("v"), width), left.column("id").to_numpy(), _matrix(left.column("v"), width), k)

        partial = dealt_c.groupBy("c", "q").cogroup(dealt_q.groupBy("c", "q")).applyInArrow(compare, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
