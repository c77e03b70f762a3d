"""Fuzzy line dedup by MinHash: of all lines that are alike, one stays in one document.

Lines that are not blank are first counted by a 128-bit digest, so exact copies of any length go. Distinct lines of at
least MIN_CHARS characters also get a signature of one-permutation MinHash over character shingles; bands of it put alike
lines into common buckets; within a bucket the exact Jaccard similarity of the shingle sets decides; distributed union-find
joins what is alike. Of each component the line stays that comes first by smallest doc_id, in that document, at its first
place. Everything else goes, and each text is put together from what is left.

Defined results: a null text stays null; blank lines always stay; lines of fewer than MIN_CHARS characters (white space at
the ends aside) are alike only if they are equal; an emptied document stays with an empty text. Every row is a document of
its own: rows that share a doc_id, or have none, are told apart by what they hold, and of rows alike in all that one keeps
a shared line; rows without a doc_id come after all others. Every column of the input is kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.buckets import bucket_links, by_key, dealt
from panelspark.llm.common import broadcast_below, discard, materialise, modest_batches, number_batches, numbered, rows_of
from panelspark.llm.components import connected_components

SHINGLE, SIMILARITY, MIN_CHARS = 7, 0.8, 20
#: At a similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**10 = 0.995; at 0.85, 0.9993.
BANDS, ROWS = 10, 4
BINS = BANDS * ROWS
PAIR = -1
#: Lines that share a bucket (8 bytes each) and may be broadcast when their texts are fetched.
BROADCAST_ROWS = 1_000_000
_EMPTY = np.uint32(0xFFFFFFFF)


def line_digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def line_keys(text: str) -> list[tuple[str, bytes | None]]:
    """(line, digest of its stripped form) for each line; None for blank lines."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        out.append((line, line_digest(bare) if bare else None))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_FACTOR, _MOST = 0x9E3779B97F4A7C15, 1 << 16


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**bits."""
    both = []
    for base in (_FACTOR % (1 << bits), pow(_FACTOR, -1, 1 << bits)):
        power = np.full(_MOST, base, dtype=f"<u{bits // 8}")
        power[0] = 1
        both.append(np.cumprod(power, dtype=power.dtype))
    return both[0], both[1]


def _windows(points: np.ndarray, bits: int) -> np.ndarray:
    """A hash of every SHINGLE code points in a row: differences of one running sum, scaled back."""
    up, down = _powers(bits)
    out = []
    for at in range(0, len(points) - SHINGLE + 1, _MOST - SHINGLE):
        part = points[at : at + _MOST]
        running = np.zeros(len(part) + 1, dtype=up.dtype)
        np.cumsum(part * down[: len(part)], out=running[1:], dtype=up.dtype)
        out.append(((running[SHINGLE:] - running[:-SHINGLE]) * up[: len(part) - SHINGLE + 1])[: _MOST - SHINGLE])
    return np.concatenate(out)


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined lines, the line of each, and whether a window that starts there stays in its line."""
    joined = "\n".join(lines) + "\n" * (SHINGLE + 1)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.asarray([len(x) + 1 for x in lines], dtype=np.int64)
    owner = np.repeat(np.arange(len(lines) + 1), np.append(lengths, SHINGLE + 1))[: len(points)]
    n = len(points) - SHINGLE
    return points, owner[:n], owner[:n] == owner[SHINGLE : SHINGLE + n]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, line, valid) for every window over the joined lines; windows that leave their line are not valid."""
    points, owner, valid = _points(lines)
    return _mix(_windows(points, 64))[: len(owner)], owner, valid


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash: the least hash in each of BINS bins; an empty bin borrows from bins in a fixed order."""
    points, owner, valid = _points(lines)
    h = _windows(points, 32)[: len(owner)]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    bins = ((h >> np.uint32(16)) * np.uint32(BINS)) >> np.uint32(16)
    values = np.where(valid, ((h ^ (h >> np.uint32(13))) * np.uint32(0x7FEB352D)) & np.uint32(0xFFFFFFFE), _EMPTY)
    out = np.full((len(lines) + 1) * BINS, _EMPTY, dtype=np.uint32)
    np.minimum.at(out, owner * BINS + bins, values)
    out = out.reshape(-1, BINS)[: len(lines)]
    full = out.copy()
    row, column = np.nonzero(out == _EMPTY)
    for step in range(1, 64 * BINS):
        if not len(row):
            break
        lender = (_mix((column.astype(np.uint64) << np.uint64(20)) + np.uint64(step)) % np.uint64(BINS)).astype(np.int64)
        found = full[row, lender]
        out[row, column] = found
        left = found == _EMPTY
        row, column = row[left], column[left]
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each band of each signature."""
    h = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::ROWS].astype(np.uint64) + np.uint64(k + 1))
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line of each document, once. Bands are null for lines under MIN_CHARS, and where this task has lately
    given the same line's."""
    names = ["doc_id", "occ", "digest", *(f"b{k}" for k in range(BANDS))]
    given: set[bytes] = set()
    for batch in rows_of(batches, 256):
        ids, occs, digests, fresh, texts = [], [], [], [], []
        for doc_id, occ, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "occ", "text")), strict=True):
            seen = set()
            for line, digest in line_keys(text):
                if digest is not None and digest not in seen:
                    seen.add(digest)
                    ids.append(doc_id)
                    occs.append(occ)
                    digests.append(digest)
                    bare = line.strip()
                    fresh.append(len(bare) >= MIN_CHARS and digest not in given)
                    if fresh[-1]:
                        given.add(digest)
                        texts.append(bare)
        if ids:
            mask = np.asarray(fresh, dtype=bool)
            bands = np.zeros((len(ids), BANDS), dtype=np.int32)
            if texts:
                bands[mask] = band_hashes(signatures(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(occs, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(bands[:, k].copy(), mask=~mask) for k in range(BANDS))], names)
        if len(given) > 100_000:
            given.clear()


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key (bucket, part) has another row. A key of two rows is renamed after its pair (part PAIR), so that a
    pair that meets in many bands is one key."""
    for table, starts in by_key(batches, 200_000):
        sizes = np.diff(starts)
        bucket, node = (table.column(c).to_numpy().copy() for c in ("bucket", "node"))
        split = "part" in table.column_names
        part = table.column("part").to_numpy().copy() if split else np.zeros(len(node), dtype=np.int32)
        home = table.column("home").to_numpy().copy() if split else np.ones(len(node), dtype=bool)
        first = starts[:-1][sizes == 2]
        a, b = node[first].view(np.uint64), node[first + 1].view(np.uint64)
        pair = _mix(np.minimum(a, b) * np.uint64(_FACTOR) + _mix(np.maximum(a, b))).view(np.int64)
        for row in (first, first + 1):
            bucket[row], part[row], home[row] = pair, PAIR, True
        keep = np.repeat(sizes > 1, sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (bucket, part, node, home)], ["bucket", "part", "node", "home"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        digests, texts = [], []
        for text in batch.column("text").to_pylist():
            for line, digest in line_keys(text):
                bare = line.strip()
                if digest is not None and len(bare) >= MIN_CHARS:
                    digests.append(digest)
                    texts.append(bare)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.string())], ["digest", "line"])


#: Shingle hashes of a batch are kept as (row, so many bits of the hash) in one sorted array; fewer in a batch of more than 65,535 rows.
HASH_BITS = 48


def row_bits(rows: int) -> int:
    """Bits left for a hash beside the number of a row."""
    return min(HASH_BITS, 64 - (rows + 1).bit_length())


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted distinct (row, hash) keys of the lines' shingles, where each row's begin, and the bits of a hash."""
    h, owner, valid = shingle_hashes(lines)
    bits = row_bits(len(lines))
    keys = np.sort((owner[valid].astype(np.uint64) << np.uint64(bits)) | (h[valid] >> np.uint64(64 - bits)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys, np.searchsorted(keys, np.arange(len(lines) + 1, dtype=np.uint64) << np.uint64(bits)), bits


def alike(keys: np.ndarray, bounds: np.ndarray, bits: int, similarity: float, bands: np.ndarray | None = None, band: np.ndarray | None = None):
    """near(i, j): the exact Jaccard similarity of rows' shingle sets reaches similarity.

    bands has each row's band hashes and band the one whose bucket the row stands in (-1 for a pair's own key): a pair that
    shares an earlier band is compared in that bucket, and left alone here.
    """
    sizes = np.diff(bounds)
    low = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 65_536):
            a, b = i[at : at + 65_536], j[at : at + 65_536]
            may = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
            if bands is not None:
                may &= (band[a] < 0) | ((bands[a] == bands[b]).argmax(axis=1) == band[a])
            some = np.flatnonzero(may)
            for part in np.array_split(some, 1 + int(sizes[b[some]].sum()) // 2_000_000):
                if len(part):
                    out[at + part] = _compare(a[part], b[part])
        return out

    def _compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width = sizes[b]
        ends = np.cumsum(width)
        flat = keys[np.arange(int(ends[-1])) - np.repeat(ends - width - bounds[b], width)]
        asked = (np.repeat(a, width).astype(np.uint64) << np.uint64(bits)) | (flat & low)
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        common = np.add.reduceat((keys[place] == asked).astype(np.int64), ends - width)
        return common >= similarity * (sizes[a] + width - common)

    return near


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_key(batches, 8_000):
            bands = np.stack([table.column(f"b{k}").to_numpy() for k in range(BANDS)], axis=1)
            keys, bounds, bits = shingle_sets(table.column("line").to_pylist())
            band = np.where(table.column("part").to_numpy() == PAIR, -1, table.column("bucket").to_numpy() >> 32)
            near = alike(keys, bounds, bits, similarity, bands, band)
            label = bucket_links(starts, table.column("home").to_numpy(), near, pairs=64)
            moved = np.flatnonzero(label != np.arange(len(label)))
            digests = table.column("digest").combine_chunks()
            yield pa.RecordBatch.from_arrays([digests.take(pa.array(moved)), digests.take(pa.array(label[moved]))], ["a", "b"])

    return run


def line_links(lines: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between digests of lines that connect all alike lines which share a bucket."""
    names = [f"b{k}" for k in range(BANDS)]
    distinct = lines.groupBy("digest").agg(*(F.min(b).alias(b) for b in names)).where("b0 IS NOT NULL")
    bucket = F.array(*(F.lit(k << 32).cast("long").bitwiseOR(F.col(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) for k, b in enumerate(names)))
    rows = distinct.select(F.xxhash64("digest").alias("node"), F.explode(bucket).alias("bucket"), F.lit(True).alias("home"))
    rows = dealt(rows)
    crowded = rows.select("bucket", "node", *(("part", "home") if "part" in rows.columns else ())).mapInArrow(_crowded, "bucket long, part int, node long, home boolean")
    with number_batches(lines.sparkSession):
        crowded = materialise(crowded, "crowded")
    pairs = F.col("part") == PAIR
    members = crowded.where(~pairs).unionByName(crowded.where(pairs).distinct())
    # Nodes only say which lines' texts are fetched; should two lines share one, both are fetched and compared.
    wanted = materialise(crowded.select(F.col("node").alias("w_node")).distinct(), "wanted")
    texts = docs.select("text").where("text IS NOT NULL").mapInArrow(_texts, "digest binary, line string")
    texts = texts.withColumn("t_node", F.xxhash64("digest")).join(broadcast_below(wanted, BROADCAST_ROWS), F.col("t_node") == F.col("w_node"), "left_semi")
    texts = texts.groupBy("t_node", "digest").agg(F.first("line").alias("line"))
    marks = lines.join(broadcast_below(wanted, BROADCAST_ROWS), F.xxhash64("digest") == F.col("w_node"), "left_semi")
    marks = marks.groupBy(F.col("digest").alias("m_digest")).agg(*(F.min(b).alias(b) for b in names))
    members = members.join(texts, F.col("node") == F.col("t_node")).join(marks, F.col("digest") == F.col("m_digest"))
    members = members.select("bucket", "part", "home", "digest", "line", *names)
    members = members.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    links = materialise(members.mapInArrow(_verify(similarity), "a binary, b binary"), "line-links")
    discard(crowded, wanted)
    return links


def line_decisions(lines: DataFrame, links: DataFrame, shared_ids: bool) -> DataFrame:
    """d_digest, keep_doc, keep_occ and keeps for each line that has a copy or a like: whether it stays, and in which document."""
    if shared_ids:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "occ"))
        counted = lines.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
        counted = counted.select("digest", "n", F.col("first")["doc_id"].alias("first_doc"), F.col("first")["occ"].alias("first_occ"))
    else:
        counted = lines.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).withColumn("first_occ", F.lit(0).cast("long"))
    parts = connected_components(links)
    named = counted.join(parts, F.col("digest") == F.col("node"), "left").where("n > 1 OR component IS NOT NULL")
    named = named.select("digest", "first_doc", "first_occ", F.coalesce("component", "digest").alias("component"))
    first = F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "first_occ", "digest"))["digest"].alias("stays")
    best = named.groupBy(F.col("component").alias("b_component")).agg(first)
    named = named.join(best, F.col("component") == F.col("b_component"))
    kept = (F.col("digest") == F.col("stays")).alias("keeps")
    return materialise(named.select(F.col("digest").alias("d_digest"), F.col("first_doc").alias("keep_doc"), F.col("first_occ").alias("keep_occ"), kept), "line-decisions")


def _rebuild(names: list[str], report: bool):
    at_text, at_gone = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(at_text).to_pylist(), batch.column(at_gone).to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    n_lines.append(0)
                    n_dropped.append(0)
                    continue
                seen, kept, n = set(gone or ()), [], 0
                for line, digest in line_keys(text):
                    n += 1
                    if digest is None or digest not in seen:
                        kept.append(line)
                        if digest is not None:
                            seen.add(digest)
                texts.append(text if len(kept) == n else "\n".join(kept))
                n_lines.append(n)
                n_dropped.append(n - len(kept))
            columns = list(batch.columns[:at_gone])
            columns[at_text] = pa.array(texts, pa.string())
            counts = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if report else []
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*names, *(("n_lines", "n_dropped") if report else ())])

    return run


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, report: bool = True) -> DataFrame:
    """The rows and columns of docs, text without the lines that go, and, for a report, n_lines and n_dropped (in the place of any such)."""
    modest_batches(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    if report:
        docs = docs.drop("n_lines", "n_dropped")
    names = list(docs.columns)
    rows, shared_ids = numbered(docs)
    source = rows.select(F.col("n_key").alias("doc_id"), F.col("n_occ").alias("occ"), F.col("row")["text"].alias("text"))
    lines = source.where("text IS NOT NULL").mapInArrow(_lines, "doc_id long, occ long, digest binary, " + ", ".join(f"b{k} int" for k in range(BANDS)))
    lines = materialise(lines, "lines")
    links = line_links(lines, source, similarity)
    decisions = line_decisions(lines, links, shared_ids)
    gone = lines.select("doc_id", "occ", "digest").join(decisions, F.col("digest") == F.col("d_digest"))
    gone = gone.where(~(F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("occ") == F.col("keep_occ"))))
    gone = gone.groupBy(F.col("doc_id").alias("g_doc"), F.col("occ").alias("g_occ")).agg(F.collect_set("digest").alias("g_digests"))
    gone = materialise(gone, "lines-gone")
    discard(lines, links, decisions)
    # Each row travels as one value, so its column names cannot clash with those of the join; texts need no sorting for it.
    fresh = next(n for n in ("gone", *(f"gone_{k}" for k in range(len(names)))) if n not in names)
    same = F.col("n_key").eqNullSafe(F.col("g_doc")) & (F.col("n_occ") == F.col("g_occ"))
    joined = rows.join(gone.hint("shuffle_hash"), same, "left").select("row", "g_digests").select("row.*", F.col("g_digests").alias(fresh))
    schema = docs.select("*").schema
    if report:
        schema = schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_rebuild(names, report), schema)
