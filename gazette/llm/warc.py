"""WARC archives compressed record by record with a Zstandard dictionary, and their reader.

Each partition writes one archive: a leading skippable frame (magic 0x184D2A5D) with
a dictionary built from its own first records, then every record as a frame of its
own. A finished archive is renamed into place, so a repeated task replaces it whole. Pages with
equal payloads are found on digests alone; payloads of pages that only revisit another
never move, and payloads in general move only where a fixed-size filter cannot tell.

Defined cases. Null html: empty payload. Null page_id: a response that nothing refers
to. Rows that repeat the smallest page_id of a payload: a response each. Null url: no
target URI. Empty table: no archive, empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import key_filter, mark_possible
from gazette.sinks.files import put_in_place
from gazette.staging import new_path, small_batches, stage

MAGIC = 0x184D2A5D
#: The dictionary: its size, and how many records and bytes it is built from at most.
DICTIONARY, SAMPLES, SAMPLE_BYTES = 16_384, 200, 2_000_000
#: Bytes of a record that the dictionary is trained on; records themselves are always whole.
SAMPLED = 20_000
#: Shorter payloads are always stored.
LEAST_REVISIT = 100
LEVEL, DATE = 3, "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record where refers_to is given; the HTTP head keeps the payload's full length."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""]
    block = b"\r\n".join(head) + (payload or b"" if refers_to is None else b"")
    name = "none" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str, int | None, int, str]:
    """page_id, type, refers_to, payload length and digest of a record; a stored payload is checked against both."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda x: None if x == "none" else int(x)
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return page(fields["WARC-Record-ID"][10:-1]), fields["WARC-Type"], None if refers is None else page(refers[10:-1]), size, digest


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where these are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterator[bytes]) -> int:
    """Writes the skippable frame and one frame for each record; returns how many."""
    first: list[bytes] = []
    held = 0
    for r in records:
        first.append(r)
        held += len(r)
        if len(first) >= SAMPLES or held >= SAMPLE_BYTES:
            break
    built = dictionary([x[:SAMPLED] for x in first])
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(built.as_bytes())
    out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
    built.precompute_compress(level=LEVEL)
    squeeze, n = zstandard.ZstdCompressor(level=LEVEL, dict_data=built), 0
    for part in (first, records):
        for r in part:
            out.write(squeeze.compress(r))
            n += 1
    return n


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, read piece by piece."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary in a leading skippable frame")
    built = zstandard.ZstdDecompressor().decompress(source.read(size))
    kind = zstandard.DICT_TYPE_AUTO if built[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(built, dict_type=kind))
    data = source.read(1 << 20)
    while data:
        frame, parts = opener.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or source.read(1 << 20)
                break
            data = source.read(1 << 20)
            if not data:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                columns = [b.column(c) for c in ("page_id", "url", "html", "size", "digest", "refers_to")]
                for row in zip(*columns):
                    page, url, html, size, digest, refers = (x.as_py() for x in row)
                    yield record(page, url, html, size, digest, refers)

        todo = records()
        head = next(todo, None)
        if head is None:
            return

        def all_records() -> Iterator[bytes]:
            yield head
            yield from todo

        context = TaskContext.get()
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        final, own = f"{base}/part-{context.partitionId():06d}.warc.zst", f"{base}/.part-{context.taskAttemptId()}.tmp"
        with store.open_output_stream(own, compression=None) as out:
            n = write_archive(out, all_records())
        size = store.get_file_info(own).size
        put_in_place(store, own, final)
        yield pa.RecordBatch.from_arrays([pa.array([final.removeprefix(base + "/")]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary; null in revisits), size, digest, refers_to: what is to be written."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    whole = whole.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    narrow = whole.select("page_id", "url", "size", "digest").where(f"size >= {LEAST_REVISIT}")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first").drop("last")
    firsts = stage(firsts, "warc-firsts")  # read by an exchange of its own, so that a hot digest's rows can be split
    revisits = stage(narrow.join(firsts, "digest").where("page_id > first").select("page_id", "url", "size", "digest", F.col("first").alias("refers_to")), "warc-revisits")
    key = F.concat_ws(":", "page_id", "digest")
    bitmap = stage(key_filter(revisits.select(key.alias("key")), "key"), "warc-filter")
    marked = mark_possible(whole.withColumn("key", key), bitmap, "key", "near")
    stay = marked.where("near").join(revisits.select(key.alias("key")).distinct(), "key", "left_anti")
    columns = ["page_id", "url", "html", "size", "digest"]
    responses = marked.where("not near").select(*columns).unionByName(stay.select(*columns)).withColumn("refers_to", F.lit(None).cast("long"))
    return responses.unionByName(revisits.withColumn("html", F.lit(None).cast("binary")))


def write_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives; file, records, bytes of each. folder must be one that all machines share, and new."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    small_batches(spark)
    written = stage(plan_records(pages).mapInArrow(_write(folder), "file string, records long, bytes long"), "warc-manifest")
    return written.select(F.concat(F.lit(folder + "/"), "file").alias("file"), "records", "bytes")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    for b in batches:
        for uri in b.column("file").to_pylist():
            store, path = pyarrow.fs.FileSystem.from_uri(uri)
            found = []
            with store.open_input_stream(path, compression=None) as source:
                for r in read_archive(source):
                    found.append(parse(r))
                    if len(found) >= 2000:
                        yield rows(found)
                        found = []
            if found:
                yield rows(found)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives named in column file."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = manifest.select("file").repartition(n).mapInArrow(_read, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
