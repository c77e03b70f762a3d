"""WARC archives with revisit resolution.

Headers alone (id, digest, size) are shuffled by payload digest to find, for each repeated payload, the record that keeps
it; every other record becomes a revisit with a fresh header and no payload. The few repeated digests then go to where the
pages are, so payloads are not shuffled. Archives are written by Spark's own writer (gzip, one member a file), so a lost
task's files are never seen; a file's records are bounded by bytes. Reading parses records by Content-Length and joins
revisits to the responses they name.

Defined results: a null html is an empty payload; payloads below min_bytes are never revisits; of equal payloads all rows
with the smallest page_id are responses (revisits name one of them); rows with a null page_id revisit, unless no row of the
payload has a page_id; each record has an id of its own, also where a page_id repeats; payloads may have up to 2 GB; other
columns are ignored; an empty table writes archives of no record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import broadcast_below, materialise, numbered, text_or_empty

MIN_BYTES = 100
#: Payloads of up to so many bytes are written so many to a file: 256 MB a file at most, but for larger single payloads.
SIZES = ((1 << 16, 4_096), (1 << 20, 256), (1 << 24, 16), (1 << 31, 1))
#: Repeated digests (100 bytes each) that may be broadcast; beyond, rows of a digest are dealt to so many salts.
REPEATED_DIGESTS, SALTS = 500_000, 64
#: Fixed value: the profile that the WARC 1.1 standard names for revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
READ_BYTES = 1 << 22


def _utf8_length(name: str):
    return F.octet_length(name).cast("long")


def _record_id(page_id, occ):
    """A record's id: the page's, and what tells it from other rows of that page_id."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.when(occ != 0, F.concat(F.lit(":"), F.hex(occ))).otherwise(""), F.lit(">"))


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds record_id, payload_bytes, payload_digest, record_type, refers_to and refers_to_id to pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows, _ = numbered(pages, "page_id", ("html", "url"))
    rows = rows.select("row.*", "n_occ")
    rows = rows.withColumns({"payload_bytes": _utf8_length("html"), "payload_digest": F.sha2(F.encode("html", "UTF-8"), 256), "record_id": _record_id(F.col("page_id"), F.col("n_occ"))})
    headers = rows.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n_occ", "record_id").alias("header"))
    repeated = headers.groupBy(F.col("payload_digest").alias("r_digest")).agg(F.min("header").alias("r"), F.count("*").alias("r_n")).where("r_n > 1 AND NOT r.none")
    repeated = materialise(repeated.select("r_digest", F.col("r")["page_id"].alias("r_page"), F.col("r")["record_id"].alias("r_record")), "repeated-payloads")
    same = F.col("payload_digest") == F.col("r_digest")
    small = broadcast_below(repeated, REPEATED_DIGESTS)
    if small is repeated:  # too many to send around: rows of a hot digest are spread over salts, each of which has the digest once
        repeated = repeated.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(repeated, same & (F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int") == F.col("r_salt")), "left").drop("r_salt")
    else:
        rows = rows.join(small, same, "left")
    revisit = F.col("r_record").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("r_page"))
    kind = F.when(revisit, "revisit").otherwise("response").alias("record_type")
    refers = (F.when(revisit, F.col("r_page")).alias("refers_to"), F.when(revisit, F.col("r_record")).alias("refers_to_id"))
    return rows.select("record_id", "page_id", "url", "html", "payload_bytes", "payload_digest", kind, *refers)


def write_archives(resolved: DataFrame, path: str, date: str | None = None, sizes: tuple[tuple[int, int], ...] = SIZES, records_per_file: int | None = None) -> None:
    """Writes one WARC 1.1 record for each row of resolve_revisits(), dated now if no date is given; files lie in a folder for each class of size."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.translate(F.coalesce(F.col("url"), F.lit("")), "\r\n", "")
    now = F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    length = F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        line("WARC-Date", F.lit(date) if date else now),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.col("refers_to_id")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.when(revisit, "").otherwise(F.col("html"))).alias("value")
    number = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 1, -1, -1):
        number = F.when(F.col("payload_bytes") <= sizes[k][0], F.lit(k)).otherwise(number)
    present = sorted(r["k"] for r in resolved.select(number.alias("k")).distinct().collect())
    for k in present or [0]:
        rows = resolved.where(number == k) if len(present) > 1 else resolved
        writer = rows.select(record).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        writer.option("maxRecordsPerFile", min(sizes[k][1], records_per_file or sizes[k][1])).text(f"{path}/class-{k}")


def _chunks(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive, unpacked a few MB at a time."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    member, rest = zlib.decompressobj(31), content
    while True:
        data = member.decompress(rest, READ_BYTES)
        if data:
            yield data
        if member.eof:
            if not member.unused_data:
                return
            member, rest = zlib.decompressobj(31), member.unused_data
        else:
            rest = member.unconsumed_tail
            if not rest and not data:
                raise ValueError("an archive ends inside a gzip member")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, found by Content-Length, so a payload may hold any bytes."""
    chunks, data = _chunks(content), bytearray()

    def fill(need: int) -> bool:
        while len(data) < need:
            more = next(chunks, None)
            if more is None:
                return False
            data.extend(more)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not fill(len(data) + 1):
                if data.strip():
                    raise ValueError("an archive ends inside a record header")
                return
        version, *lines = data[:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        length = int(headers["Content-Length"])
        if not fill(end + 4 + length + 4):
            raise ValueError("an archive ends inside a record")
        yield headers, bytes(data[end + 4 : end + 4 + length])
        del data[: end + 4 + length + 4]


def _page(record_id: str | None) -> int | None:
    name = record_id[len("<urn:page:") : -1].split(":")[0] if record_id else "none"
    return None if name == "none" else int(name)


def _parse(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for h, block in parse_records(batch.column("content")[i].as_py()):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = h["WARC-Type"] == "response"
                    if response and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} does not match its digest")
                    payload = block if response and with_payload else None
                    rows.append((h["WARC-Record-ID"], _page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], _page(h.get("WARC-Refers-To")), h.get("WARC-Refers-To"), len(block) if response else int(h["WARC-Payload-Length"]), digest, payload))
                    held += len(payload or b"")
                    if len(rows) == 256 or held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return parse


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below path; a response's payload is checked against its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_parse(with_payload), RECORDS)


def resolve_payloads(records: DataFrame) -> DataFrame:
    """Records with the payload of each revisit taken from the response that it names; only responses that are named travel."""
    named = records.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("n_id")).distinct()
    originals = records.where("record_type = 'response'").join(named, F.col("record_id") == F.col("n_id"), "left_semi")
    originals = originals.select(F.col("record_id").alias("o_id"), F.col("payload_digest").alias("o_digest"), F.col("payload").alias("o_payload"))
    revisits = records.where("record_type = 'revisit'").join(originals, (F.col("refers_to_id") == F.col("o_id")) & (F.col("payload_digest") == F.col("o_digest")), "left")
    columns = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return records.where("record_type = 'response'").select(*columns, "payload").unionByName(revisits.select(*columns, F.col("o_payload").alias("payload")))
