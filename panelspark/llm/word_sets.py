"""Links between texts whose sets of five-word shingles are alike: MinHash bands bring them together, the exact Jaccard decides.

Texts of fewer than five words have no shingles and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.buckets import bucket_links, by_key, dealt
from panelspark.llm.common import discard, materialise, modest_batches, number_batches, rows_of
from panelspark.llm.lines import HASH_BITS, PAIR, _crowded, _mix, alike, row_bits

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**20 = 0.99997.
BANDS, ROWS = 20, 4
_SALTS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the text's shingles; words as SimHash splits them."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    found = {xxhash.xxh64_intdigest(b" ".join(words[k : k + SHINGLE])) >> (64 - HASH_BITS) for k in range(len(words) - SHINGLE + 1)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """A bucket for each band of one text's shingles."""
    least = np.full(len(_SALTS), ~np.uint64(0))
    for at in range(0, len(hashes), 4_096):
        least = np.minimum(least, _mix(hashes[at : at + 4_096, None] ^ _SALTS[None, :]).min(axis=0))
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return h.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        nodes, found = [], []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hashes = shingles(text)
            if len(hashes):
                nodes.append(node)
                found.append(buckets(hashes))
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(nodes, BANDS)), pa.array([True] * (len(nodes) * BANDS))], ["bucket", "node", "home"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in by_key(batches, 2_000):
        bits = row_bits(table.num_rows)
        sets = [np.unique(shingles(t) >> np.uint64(HASH_BITS - bits)) for t in table.column("text").to_pylist()]
        keys = np.concatenate([(np.uint64(k) << np.uint64(bits)) | s for k, s in enumerate(sets)])
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        label = bucket_links(starts, table.column("home").to_numpy(), alike(keys, bounds, bits, SIMILARITY), pairs=64)
        digest, moved = table.column("digest").combine_chunks(), np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([digest.take(pa.array(moved)), digest.take(pa.array(label[moved]))], ["a", "b"])


def word_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) between digests that connect all alike texts of texts (digest, text; each digest once) which share a band."""
    modest_batches(texts.sparkSession)
    named = texts.select(F.xxhash64("digest").alias("node"), "text")
    bands = materialise(named.mapInArrow(_bands, "bucket long, node long, home boolean"), "text-bands")
    dealt_rows = dealt(bands)
    crowded = dealt_rows.select("bucket", "node", *(("part", "home") if "part" in dealt_rows.columns else ())).mapInArrow(_crowded, "bucket long, part int, node long, home boolean")
    with number_batches(texts.sparkSession):
        crowded = materialise(crowded, "text-crowded")
    pairs = F.col("part") == PAIR
    members = crowded.where(~pairs).unionByName(crowded.where(pairs).distinct())
    # Nodes only say which texts are fetched; should two texts share one, both are fetched and compared.
    fetched = texts.select(F.xxhash64("digest").alias("t_node"), "digest", "text")
    members = members.join(fetched, F.col("node") == F.col("t_node")).select("bucket", "part", "home", "digest", "text")
    members = members.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    links = materialise(members.mapInArrow(_verify, "a binary, b binary"), "text-links")
    discard(bands, crowded)
    return links
