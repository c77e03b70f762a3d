"""SimHash near-duplicates by anchor-point covering.

A fingerprint's bits are dealt into parts whose thresholds add up so that two fingerprints within `distance` bits agree
to a part's threshold in at least one part. In each part the words of a Hamming code are the anchors (further bits of the
part are free): every point lies within covering radius 1 of an anchor. A fingerprint is replicated to every anchor
within radius plus threshold; at each anchor, those within the radius are compared with all that came. So no link
between different fingerprints is lost, and no anchor is a cap. The parts are wider for larger corpora.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; rows with
equal fingerprints are one point, whatever their ids, so repeated rows and groups of copies cost nothing; a row with a null
doc_id links like any other and reports the smallest doc_id that its component holds (null if it holds none); ties do not
arise; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.buckets import bucket_links, by_key, dealt
from panelspark.llm.common import materialise, modest_batches, number_batches, rows_of, text_or_empty
from panelspark.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text: a bit is set if more than half of the shingle hashes set it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _fingerprints(names: list[str], shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = np.asarray([fingerprint(t, shingle, seed) for t in batch.column(len(names)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.int64())], [*names, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp (the fingerprint's bits as a signed long) of the text of every row of docs."""
    modest_batches(docs.sparkSession)
    kept = docs.select(*keep)
    rows = docs.select(*keep, text_or_empty().alias("fp_text"))
    return rows.mapInArrow(_fingerprints(list(keep), shingle, seed), kept.schema.add("fp", "long"))


class Part(NamedTuple):
    """Bits low .. low + width - 1; a Hamming code of 2**order - 1 of them; the threshold within the part."""

    low: int
    width: int
    order: int
    threshold: int

    @property
    def anchors(self) -> int:
        return 2 ** (self.width - self.order)

    @property
    def replicas(self) -> int:
        return len(_patterns(self.width, self.threshold))


#: Ways to deal 64 bits. In each, the thresholds plus one add up to DISTANCE + 1.
PLANS = (
    (Part(0, 23, 4, 1), Part(23, 23, 4, 1), Part(46, 18, 4, 0)),
    (Part(0, 31, 5, 2), Part(31, 33, 5, 1)),
)


def choose_plan(n: int) -> tuple[Part, ...]:
    """The plan of least work for n fingerprints: replicas to deal (about 3 us each) and pairs to compare (2 ns each)."""
    return min(PLANS, key=lambda plan: sum(3e-6 * n * p.replicas + 2e-9 * n * n * p.replicas / p.anchors for p in plan))


@lru_cache(maxsize=16)
def _patterns(width: int, weight: int) -> np.ndarray:
    """All masks of at most weight bits."""
    return np.asarray([sum(1 << b for b in bits) for w in range(weight + 1) for bits in combinations(range(width), w)], dtype=np.uint64)


@lru_cache(maxsize=4)
def _syndromes(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and the high 16 bits of a word: the exclusive or of the places (from 1) of its set bits."""
    length = 2**order - 1
    tables = []
    for low in (0, 16):
        table = np.zeros(1 << 16, dtype=np.uint8)
        for bit in range(16):
            if low + bit < length:
                table[1 << bit : 1 << (bit + 1)] = table[: 1 << bit] ^ (low + bit + 1)
            else:
                table[1 << bit : 1 << (bit + 1)] = table[: 1 << bit]
        tables.append(table)
    return tables[0], tables[1]


def nearest_anchor(points: np.ndarray, part: Part) -> np.ndarray:
    """The anchor within radius 1 of each point of a part: Hamming decoding, the free bits kept."""
    low, high = _syndromes(part.order)
    syndrome = low[points & np.uint64(0xFFFF)] ^ high[(points >> np.uint64(16)) & np.uint64(0xFFFF)]
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))
    return points ^ flip


def anchors(fp: np.ndarray, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for each fingerprint and each anchor within radius plus threshold of its part.

    An anchor that near is the nearest anchor of some point within the threshold, so those points are decoded.
    """
    points = (fp >> np.uint64(part.low)) & np.uint64((1 << part.width) - 1)
    every = np.sort(nearest_anchor(points[:, None] ^ _patterns(part.width, part.threshold)[None, :], part), axis=1)
    new = np.ones(every.shape, dtype=bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    row, column = np.nonzero(new)
    anchor = every[row, column]
    return row, anchor, anchor == nearest_anchor(points, part)[row]


def _replicate(plan: tuple[Part, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2_000):
            fp, node = batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()
            for number, part in enumerate(plan):
                row, anchor, home = anchors(fp, part)
                bucket = (anchor | np.uint64(number << 48)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node[row]), pa.array(fp[row].view(np.int64)), pa.array(home)], ["bucket", "node", "fp", "home"])

    return run


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_key(batches):
            fp = table.column("fp").to_numpy().view(np.uint64)
            node, home = table.column("node").to_numpy(), table.column("home").to_numpy()
            label = bucket_links(starts, home, lambda i, j, fp=fp: np.bitwise_count(fp[i] ^ fp[j]) <= distance)
            pairs = np.stack([node, node[label]], axis=1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def near_links(points: DataFrame, plan: tuple[Part, ...], distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the nodes of points (node, fp), one point for each fingerprint, that connect all within distance."""
    if sum(p.threshold + 1 for p in plan) <= distance:
        raise ValueError("the parts' thresholds do not cover the distance")
    rows = points.select("node", "fp").mapInArrow(_replicate(plan), "bucket long, node long, fp long, home boolean")
    rows = materialise(rows, "anchors")
    rows = dealt(rows)
    return rows.select("bucket", *(c for c in rows.columns if c == "part"), "node", "fp", "home").mapInArrow(_compare(distance), "a long, b long")


def linked_fingerprints(points: DataFrame, distance: int = DISTANCE, plan: tuple[Part, ...] | None = None) -> DataFrame:
    """node (a fingerprint) and component (the smallest one reachable) for each of points (fp, each once) that has a link."""
    plan = plan or choose_plan(points.count())
    with number_batches(points.sparkSession):
        links = materialise(near_links(points.select(F.col("fp").alias("node"), "fp"), plan, distance), "links")
    return connected_components(links)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, plan: tuple[Part, ...] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row of docs."""
    prints = materialise(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, seed), "fingerprints")
    # Copies fall together map-side; from here on a point is a fingerprint, ids come back at the end.
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    parts = linked_fingerprints(points, distance, plan)
    least = parts.join(points, F.col("node") == F.col("fp")).groupBy(F.col("component").alias("l_component")).agg(F.min("first_id").alias("least_id"))
    parts = parts.join(least, F.col("component") == F.col("l_component")).select("node", "least_id")
    points = points.join(parts, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("p_fp"), F.coalesce("least_id", "first_id").alias("component_id"))
    found = prints.join(points, prints["fp"] == points["p_fp"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
