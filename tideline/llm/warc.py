"""A dictionary-compressed WARC writer and its reader.

Each archive is one file: a skippable frame that holds the Zstandard dictionary, then one frame a
record, so that a record can be read without the ones before it; the first is a warcinfo record. The
dictionary is built from a bounded sample of the records, spread over all pages by their hashes, and
embedded in every archive. Pages with equal payloads of at least `least` bytes are stored once, by the
largest page_id; the others become revisit records that name the record they repeat.

Spark shuffles the pages once, to the tasks that write; a task streams its pages into files of bounded
size, whose names hold the attempt. The manifest, which Spark commits, lists the files of the attempts
that counted; the reader opens those alone, so that tasks that were lost or ran twice do no harm.

Defined cases: a null html is an empty payload; a null url gets a urn and is read back as null; a url
that is no URI is written as one that is, beside its own text; a page without page_id is written
without one; among equal payloads that all lack a page_id every one is a response; rows that repeat the
largest page_id are all responses and share a record id; an empty table writes no records. Extra
columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small

#: The magic number of the skippable frame that holds a dictionary; that of a plain dictionary.
SKIPPABLE, DICTIONARY = 0x184D2A5D, 0xEC30A437

#: Payloads shorter than this are always stored.
LEAST = 1000

#: Records sampled for the dictionary, bytes of a payload that may be among them, bytes of the dictionary; the sample's bytes for each of its.
SAMPLED, SAMPLED_BYTES, DICTIONARY_BYTES, RATIO = 400, 64 << 10, 32 << 10, 32

#: Bytes of a file beyond which a task begins another.
FILE_BYTES = 64 << 20

#: The profile of revisits; what names a scheme.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")

#: Copies of a duplicate's entry, so that a payload which many pages share is no hot key.
SALTS = 64

DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def payloads(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, size of every page."""
    payload: Column = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def decide(pages: DataFrame, least: int = LEAST, html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, size, record_type, refers_to of every page."""
    rows = payloads(pages, html)
    shared = (
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("kept"))
        .where("n > 1 and kept is not null")
        .select(F.col("digest").alias("d"), "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    revisits = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        "size",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("kept")).alias("refers_to"),
    )


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def warc(kind: str, name: str, content: str, block: bytes, *more: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def info(file: str) -> bytes:
    """The warcinfo record of an archive."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>"
    return warc("warcinfo", name, "application/warc-fields", b"software: tideline\r\nformat: WARC File Format 1.1\r\n", f"WARC-Filename: {file}")


def record(page_id, url, payload: bytes, digest: str, size: int, record_type: str, refers_to) -> bytes:
    """One WARC record; a revisit has the headers of the payload but not the payload."""
    own = "" if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%")
    target = f"urn:page:{page_id}" if url is None else own if SCHEME.match(own) else f"unknown:{own}"
    # what no page needs to be found again: its id, and its url where the URI does not show it
    kept = [] if page_id is None else [f"X-Page-Id: {page_id}"]
    kept += [f"X-Page-Url: {quote(url, safe='')}"] if url is not None and url != target else ["X-Page-Url-Missing: true"] if url is None else []
    if refers_to is not None:
        kept += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    name = record_id(page_id, digest) if record_type == "response" and page_id is not None else record_id(f"{page_id} {target} {record_type}", digest)
    digested = f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"
    return warc(record_type, name, "application/http; msgtype=response", block, f"WARC-Target-URI: {target}", *kept, digested)


def parse(data: bytes) -> dict | None:
    """What `record` was given; payload_bytes and payload_digest of a response come from its payload. None for other records."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size, stored = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Type"] == "response"
    if stored and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that it names")
    url = unquote(fields["X-Page-Url"], errors="surrogateescape") if "X-Page-Url" in fields else fields["WARC-Target-URI"]
    return {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "url": None if "X-Page-Url-Missing" in fields else url,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if stored else None,
    }


def train(records: list[bytes]) -> bytes:
    """A dictionary from sampled records, small beside them; raw content where they are too few to train on."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // RATIO))
    try:
        return zstandard.train_dictionary(size, records, k=200, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size] or b"WARC/1.1\r\n"


def frames(records: Iterator[bytes], words: bytes, level: int = 3) -> Iterator[bytes]:
    """The leading frame with the dictionary, then a frame for each record."""
    yield struct.pack("<II", SKIPPABLE, len(words)) + words
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words))
    yield from map(packer.compress, records)


def unframe(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    data = memoryview(data)
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + n])))
    rest = data[8 + n :]
    while rest:
        one = unpacker.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


COLUMNS = ("page_id", "url", "payload", "digest", "size", "record_type", "refers_to")


def dictionary(rows: DataFrame, most: int = SAMPLED) -> bytes:
    """A dictionary from at most so many records, spread over the rows of payloads() by hashes; always the same ones."""
    turn = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40))
    share = min(1.0, 2.0 * (most + 20) / max(1, rows.count()))
    few = rows.withColumn("turn", turn).where((F.col("turn") < int(share * (1 << 40))) & (F.col("size") <= SAMPLED_BYTES))
    found = few.orderBy("turn", "page_id", "url", "digest").limit(most).select(*COLUMNS[:5]).collect()
    return train([record(**r.asDict() | {"payload": bytes(r["payload"]), "record_type": "response", "refers_to": None}) for r in found])


def write_archives(pages: DataFrame, folder: str, words: bytes | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes decide()'s rows as archives into folder (a URI), with a dictionary; returns file, records and bytes of each."""
    words = words or dictionary(pages)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        row, part = next(rows, None), 0
        while row is not None:
            name, count, size = f"part-{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}.warc.zst", 0, 0

            def some() -> Iterator[bytes]:
                nonlocal row, count
                yield info(name)
                while row is not None and (size < file_bytes or not count):
                    yield record(**row)
                    row, count = next(rows, None), count + 1

            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:  # not once more, by its ending
                for frame in frames(some(), words):
                    size += out.write(frame)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})
            part += 1

    manifest = pages.select(*COLUMNS).mapInArrow(store, MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a folder's archives that its manifest names; payload is null for revisits and where payloads is false."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for one in unframe(data.as_buffer()):
                    got = parse(one)
                    if got:
                        rows.append(got | ({} if payloads else {"payload": None}))
                        held += len(one)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    named = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(named) if small(named) else named, "file", "left_semi")
    return files.select("content").mapInArrow(load, READ)


def archive(pages: DataFrame) -> DataFrame:
    """Writes an archive of pages to the shared folder and reads it back, one row a page."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(decide(pages), folder, dictionary(payloads(pages)))
    return read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
