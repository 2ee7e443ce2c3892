"""WARC archives whose records are compressed one by one with a Zstandard dictionary.

An archive opens with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard
frame; every record follows as a frame of its own, so that one record can be read by its offset.
The dictionary is trained on pieces of `PART` bytes at most, `SAMPLE` bytes in all: the beginnings of records evenly spaced over the
archive, and where these are few, pieces spread over the records, so that neither large nor few records go without one.

Equal payloads of `LEAST` bytes or more are kept once: the row with the largest id is the response, the
others become revisit records, which name it. The digests (of full payloads) are computed beside the
rows, the largest id of each digest by an aggregate that combines before it shuffles; no group of
copies meets in one task (`plan`).

A task that writes an archive takes the rows of its partition and cuts a new archive after `TARGET`
bytes. Files have names fixed by their content, and appear by renaming: a task that runs twice leaves
the same files. The list of archives is a table in the shared folder.

Edge cases: a null html is an empty payload; a null url is written as an empty target; rows with equal ids
are kept as so many records (of equal payloads of one id, the largest, all are responses); a null id
counts as the smallest of its copies (copies without any id are all responses) and is read back as null; an empty table makes no archives and no
rows; other columns aren't archived.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, shared_path, stored, tidy
from .files import Store

MAGIC = 0x184D2A5D
LEAST, SAMPLE, DICTIONARY, TARGET, LEVEL, PIECE, PART = 1000, 1 << 20, 1 << 16, 64 << 20, 3, 1 << 13, 1 << 12
#: Digests that may be broadcast (some 60 bytes each); and the share of rows that makes a digest hot beyond that.
SMALL, SHARE = 500_000, 10_000
EPOCH = "1970-01-01T00:00:00Z"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to of every row.

    Rows with their html meet the few digests that have copies. These are broadcast where they are counted to be `SMALL`. Beyond that the
    digests of a `SHARE`th of all rows or more, at most so many, are broadcast, and only the others are joined by digest: rows of a hot
    payload stay where they are.
    """
    data = F.coalesce(named(pages, "html"), F.lit(""))
    rows = pages.select(named(pages, "page_id").alias("page_id"), named(pages, "url").alias("url"), data.alias("html"), F.sha1(data.cast("binary")).alias("digest"), F.octet_length(data).alias("n"))
    big = F.col("n") >= LEAST
    # counting beside the maximum leaves only digests that have copies for the join: usually few
    groups = stored(rows.filter(big).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("digest").alias("d"), "last", "copies"), "copies")
    few = groups.limit(SMALL + 1).count() <= SMALL
    hot = groups if few else groups.filter(F.col("copies") * SHARE >= groups.agg(F.sum("copies")).first()[0])
    again = rows.join(F.broadcast(hot.select("d", "last")), (F.col("digest") == F.col("d")) & big, "left")
    if not few:
        cold = groups.join(F.broadcast(hot.select("d")), "d", "left_anti").select(F.col("d").alias("e"), F.col("last").alias("other"))
        # rows that can't match get keys of their own, so that they are dealt evenly
        key = F.when(big & F.col("d").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest")))
        again = again.withColumn("key", key).join(cold, F.col("key") == F.col("e"), "left").withColumn("last", F.coalesce("last", "other")).withColumn("d", F.coalesce("d", "e"))
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return again.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but like all records its digest and full length."""
    body = b"" if kind == "revisit" else payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Full-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parts(records: list[bytes]) -> list[bytes]:
    """What the dictionary is trained on."""
    step = -(-sum(min(len(r), PART) for r in records) // SAMPLE) or 1
    some = [r[:PART] for r in records[::step]]
    if len(some) >= 16:
        return some
    size = max(64, min(PART, sum(map(len, records)) // 64))
    starts = [(r, i) for r in records for i in range(0, len(r), size)]
    return [r[i : i + size] for r, i in starts[:: max(1, len(starts) * size // SAMPLE)]]


def pack(records: list[bytes]) -> bytes:
    """One archive: the dictionary in a skippable frame, then each record as a frame."""
    import zstandard

    some = parts(records)
    lead, coder = b"", None
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, some)) // 8)), some)
        lead = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    except zstandard.ZstdError:  # too little or too uniform to train on
        lead = b""
    coder = coder or zstandard.ZstdCompressor(level=LEVEL)
    return struct.pack("<II", MAGIC, len(lead)) + lead + b"".join(coder.compress(r) for r in records)


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    import zstandard

    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start")
    lead, at = data[8 : 8 + n], 8 + n
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(lead))) if lead else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(view):
        one, out = decoder.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a record")
            piece = view[at : at + PIECE]
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives into the shared folder; returns (archive, records, bytes), one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held, size = Store(folder), [], 0

        def flush() -> pa.RecordBatch:
            data = pack(held)
            name = f"{hashlib.sha256(data).hexdigest()[:32]}.warc.zst"
            store.write(name, data)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            for start in range(0, len(batch), 64):  # few pages at a time become Python strings
                some = batch.slice(start, 64)
                for row in zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")), strict=True):
                    one = record(row[0], row[1], row[2].encode(), *row[3:])
                    held.append(one)
                    size += len(one)
                    if size >= TARGET:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return stored(plan(pages).mapInArrow(tidy(run), "archive string, records long, bytes long"), "warc-list")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Reads archives back, one row for each record; the payload digest is checked against responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                for fields, payload in map(parse, unpack(store.read(name))):
                    digest, revisit = fields["WARC-Payload-Digest"].partition(":")[2], fields["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"a payload in {name} doesn't have its digest")
                    rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), int(fields["WARC-Full-Payload-Length"])))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    # one archive (or few) to a task: its list is short, its bytes aren't
    n = max(1, archives.count())
    return archives.select("archive").repartition(min(n, 4096)).mapInArrow(tidy(run), "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long, full_length long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "full_length")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive(pages: DataFrame) -> DataFrame:
    """Archives a table of pages in a new shared folder and reads it back: revisits carry no payload."""
    folder = shared_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
