"""Comparing within buckets: rows dealt by key, hot buckets cut into blocks, links reduced to a spanning forest.

A bucket's members are compared anchors against all members. A bucket of more than BLOCK rows is cut into blocks, and each
pair of blocks is a key of its own, so no task holds more than two blocks, however large a bucket is. What leaves a
bucket is at most one link for each member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import broadcast_below
from panelspark.llm.components import forest

BLOCK = 8_192
ESTIMATE = 64
#: Pairs that are compared in one array operation; more than that in a bucket are walked from member to member.
PAIRS = 1 << 20
#: Hot buckets (24 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (bucket, node, home, ...) dealt by key and sorted by it in each partition.

    The key is the bucket; if any bucket is hot it is (bucket, part), and keys hold about two blocks at most.

    Rows of a hot bucket go to every pair of blocks where they are needed; home then says on which side they stand. Sizes
    are estimated from one node in ESTIMATE; an estimate only chooses the number of blocks, never whether rows meet.
    """
    estimated = rows.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(ESTIMATE)) == 0)
    sizes = estimated.groupBy(F.col("bucket").alias("h_bucket")).agg(F.count("*").alias("h_rows"))
    blocks = F.ceil(F.col("h_rows") * ESTIMATE / block).cast("int").alias("h_blocks")
    hot = sizes.where(F.col("h_rows") * ESTIMATE > block).select("h_bucket", blocks)
    if hot.isEmpty():
        return rows.repartition("bucket").sortWithinPartitions("bucket")
    rows = rows.join(broadcast_below(hot, BROADCAST_ROWS), F.col("bucket") == F.col("h_bucket"), "left")
    own = F.pmod(F.xxhash64("node"), F.col("h_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("h_blocks") - 1)
    pair = lambda part, home: F.struct(part.cast("int").alias("part"), home.alias("home"))
    as_home = F.when(F.col("home"), F.transform(others, lambda j: pair(own * F.col("h_blocks") + j, F.lit(True)))).otherwise(F.array().cast("array<struct<part:int,home:boolean>>"))
    as_other = F.transform(others, lambda i: pair(i * F.col("h_blocks") + own, F.lit(False)))
    places = F.when(F.col("h_blocks").isNull(), F.array(pair(F.lit(0), F.col("home")))).otherwise(F.concat(as_home, as_other))
    kept = [c for c in rows.columns if c not in ("home", "h_bucket", "h_blocks")]
    return rows.select(*kept, F.inline(places)).repartition("bucket", "part").sortWithinPartitions("bucket", "part")


def _walk(homes: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component of each member of one large bucket: each member, once reached, looks at those not yet reached.

    A home looks at every member, another member at homes only; so each link that the bucket must see is looked at while
    one of its ends is still unreached, or joins two members that are reached already.
    """
    n = len(homes)
    label, free = np.full(n, -1), np.ones(n, dtype=bool)
    for start in np.flatnonzero(homes):
        if not free[start]:
            continue
        free[start], label[start], queue = False, start, [start]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(free if homes[at] else free & homes)
            found = rest[near(np.full(len(rest), at), rest)]
            free[found], label[found] = False, start
            queue.extend(found.tolist())
    left = label < 0
    label[left] = np.flatnonzero(left)
    return label


def bucket_links(starts: np.ndarray, homes: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: int = PAIRS) -> np.ndarray:
    """For rows sorted by key, the first row that each row is linked to within its key (itself, if none).

    starts has each key's first row and, last, the number of rows; near(i, j) says which pairs of rows are linked. A key of
    more than `pairs` pairs is walked.
    """
    n = int(starts[-1])
    label = np.arange(n)
    first, sizes = starts[:-1], np.diff(starts)
    n_homes = np.add.reduceat(homes.astype(np.int64), first) if n else np.zeros(0, np.int64)
    work = n_homes * sizes
    for k in np.flatnonzero(work > pairs):
        lo, hi = first[k], first[k] + sizes[k]
        label[lo:hi] = lo + _walk(homes[lo:hi], lambda i, j, lo=lo: near(i + lo, j + lo))
    small = np.flatnonzero((work <= pairs) & (n_homes > 0) & (sizes > 1))
    cuts = np.searchsorted(np.cumsum(work[small]), np.arange(PAIRS, int(work[small].sum()) + PAIRS, PAIRS))
    found_a, found_b = [], []
    for keys in np.split(small, np.unique(cuts)):
        if not len(keys):
            continue
        members = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in keys]) if len(keys) < 64 else _ranges(first[keys], sizes[keys])
        of = np.repeat(np.arange(len(keys)), sizes[keys])
        is_home = homes[members]
        a, key = members[is_home], of[is_home]
        width = sizes[keys][key]
        i, j = np.repeat(a, width), _ranges(first[keys][key], width)
        keep = (i < j) | (~homes[j] & (i != j))
        i, j = i[keep], j[keep]
        linked = near(i, j)
        found_a.append(i[linked])
        found_b.append(j[linked])
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        touched, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        if len(touched):
            label[touched] = touched[forest(len(touched), back[: len(a)], back[len(a) :])]
    return label


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] numbers), first[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - first, sizes)


def by_key(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole keys (bucket, or bucket and part) of a partition sorted by key, many at a time, with each key's first row."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        bucket = table.column("bucket").to_numpy()
        change = bucket[1:] != bucket[:-1]
        if "part" in table.column_names:
            part = table.column("part").to_numpy()
            change |= part[1:] != part[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1]) if len(bucket) else np.zeros(0, np.int64)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = cut(table)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), np.append(starts[:-1], last)
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(cut(table), table.num_rows)
