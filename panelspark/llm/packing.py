"""Best-fit packing planned on the histogram of piece lengths.

Documents become token pieces; the plan sees only how many pieces have each length (at most `capacity` numbers, whatever
the corpus), places them best-fit, longest first, in whole runs of equal sequences, and yields slots; each piece then takes
the slot of its rank among the pieces of its length.

Defined results: a null text packs as the empty text (its end token alone); a text of more than capacity tokens, however
long, is cut into pieces of capacity tokens, none dropped, and only its first piece may be shorter; repeated rows are each
packed; rows with a null doc_id keep it; ties of rank go by doc_id, piece and content; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm import tokenizer
from panelspark.llm.common import materialise, modest_batches, rows_of, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length are ranked in so many salted groups, so that a very common length is not one task's work.
SALTS = 512
#: So many planned runs (48 bytes each) may be broadcast; more are joined by length and by steps of so many ranks.
BROADCAST_ROWS, RANKS = 200_000, 4_096


def _pieces(tokenizer_path: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            out: tuple[list, ...] = ([], [], [], [], [])
            found = tokenizer.packed(tokenizer_path, batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids += end
                # A remainder comes first: every piece after the first is full.
                for piece, stop in enumerate(range((len(ids) // 4 - 1) % capacity + 1, len(ids) // 4 + 1, capacity)):
                    start = max(stop - capacity, 0)
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row for each piece of at most capacity tokens of each document and its end token."""
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return docs.mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECES)


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, first sequence, offset).

    Open sequences are kept as runs of equal fill. A length goes to the fullest runs that it still fits, a whole run at a
    time, and opens new sequences only when no run has room. The work depends on the lengths present, not on the counts.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    rooms: list[int] = []
    plan, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            # Best fit stays in a sequence while it has room: whole sequences take `each` pieces, a last one the rest.
            each = room // length
            used, each = (min(n, left // each), each) if left >= each else (1, left)
            for k in range(each):
                plan.append((length, rank, used, first, capacity - room + k * length))
                rank += used
            left -= used * each
            put(room - each * length, first, used)
            if used < n:
                put(room, first + used, n - used)
    return plan


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank, from 0 without gaps among pieces of a length, by salted counts and ranks within each salt."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    return ranked.withColumn("rank", F.col("base") + F.col("within")).drop("b_length", "b_salt", "base", "within", "salt")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    slots = spark.createDataFrame(plan, "s_length long, first_rank long, n long, first_sequence long, offset long")
    ranked = _ranked(pieces)
    at = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    if len(plan) > BROADCAST_ROWS:
        step = lambda c: F.floor(c / F.lit(RANKS))
        slots = materialise(slots, "slots").withColumn("s_step", F.explode(F.sequence(step(F.col("first_rank")), step(F.col("first_rank") + F.col("n") - 1))))
        placed = ranked.join(slots, at & (step(F.col("rank")) == F.col("s_step")))
    else:
        placed = ranked.join(F.broadcast(slots), at)
    sequence = (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset")
