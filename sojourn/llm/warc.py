"""WARC archives of Zstandard frames with a dictionary, and their reader.

Pages are written to archives of bounded size. Each archive trains a dictionary on its first records and embeds it in a
leading skippable frame; then each record is a frame of its own, so any record can be read from its offset. Of equal
payloads one page (the largest id) is a ``response`` record, and the others are ``revisit`` records that refer to it.

Archives lie in a folder that all executors share; names are unique for each task attempt, and only the archives that a
finished attempt has reported are read, so a lost executor costs a retry and leaves nothing in the result.

Null html is an empty payload. Pages with a null id are responses. Repeated rows of the largest id are responses each. A null
url is written as ``urn:x-none``. A payload of any length is one record. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.words import sliced
from sojourn.operators.staging import ensure_checkpoint_dir, staged_table

#: Fixed values of the formats: magic number of the dictionary's frame, profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
TRAINING_BYTES = 1 << 20
LEVEL = 3


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    name = "" if page is None else str(page)
    uri = (url or "urn:x-none").replace("\r", "%0D").replace("\n", "%0A")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{RECORD_ID}{name}>"),
            ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>"), ("WARC-Profile", REVISIT)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the samples, empty where they are too few or too short for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, steps=1, accel=4).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """Writes one archive; ``sink`` is any binary stream."""

    def __init__(self, sink, dictionary: bytes):
        import zstandard

        self.sink, self.written = sink, 0
        given = None
        if dictionary:
            sink.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
            given = zstandard.ZstdCompressionDict(dictionary)
            given.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=given)

    def add(self, body: bytes) -> None:
        self.sink.write(self.compressor.compress(body))
        self.written += len(body)


def records(source):
    """``(headers, block)`` of each record of an archive stream."""
    import zstandard

    head, given = source.read(8), None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        given = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0]))
        rest = source
    else:
        rest = _Joined(head, source)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=given).stream_reader(rest, read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            headers[key] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


class _Joined:
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int = -1) -> bytes:
        if self.head:
            head, self.head = self.head, b""
            return head
        return self.rest.read(n)


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """``(page, digest, refers_to)`` of the pages whose payload a page of larger id has too."""
    body = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.filter(F.octet_length(body) >= least).select("page", F.unhex(F.sha1(body)).alias("digest"))
    first = digests.groupBy("digest").agg(F.max("page").alias("refers_to"), F.min("page").alias("least")).filter("least < refers_to")
    return digests.join(first.select("digest", "refers_to"), "digest").filter("page < refers_to").distinct()


def write(pages: DataFrame, folder: str, *, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
          archive_bytes: int = ARCHIVE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns ``(path, records, dictionary_bytes)`` of each. ``folder``: a URI that executors share."""
    own = pages.select(F.col(id).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    twice = revisits(own, least).withColumnRenamed("page", "twin").withColumnRenamed("digest", "d")
    body = F.coalesce(F.col("html"), F.lit(""))
    marked = own.join(twice, (own.page == F.col("twin")) & (F.unhex(F.sha1(body)) == F.col("d")), "left")
    marked = marked.select("page", "url", "html", "refers_to")

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        archive = sink = path = None
        waiting, size, count, trained = [], 0, 0, 0

        def start():
            nonlocal archive, sink, path, trained
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            sink = files.open_output_stream(path)
            dictionary = dictionary_of(waiting, dictionary_bytes)
            archive, trained = Archive(sink, dictionary), len(dictionary)
            for x in waiting:
                archive.add(x)
            waiting.clear()

        def close():
            nonlocal archive, size, count
            sink.close()
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [count], "dictionary_bytes": [trained]})
            archive, size, count = None, 0, 0
            return row

        for batch in batches:
            for part in sliced(batch, "html"):
                for page, target, text, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    x = record(page, target, (text or "").encode(), refers, date)
                    size, count = size + len(x), count + 1
                    if archive:
                        archive.add(x)
                    else:
                        waiting.append(x)
                        if size >= TRAINING_BYTES:
                            start()
                    if archive and size >= archive_bytes:
                        yield close()
        if waiting:
            start()
        if archive:
            yield close()

    return staged_table(marked.mapInArrow(run, "path string, records bigint, dictionary_bytes bigint"))


def read(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """The records of archives that ``write`` has reported; payloads of responses are checked against their digests."""

    def run(batches):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def page(uri: str) -> int | None:
            return int(n) if (n := uri.strip("<>").removeprefix(RECORD_ID)) else None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path) as source:
                    for h, block in records(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{h['WARC-Record-ID']} in {path}: the payload does not match its digest")
                        rows.append((page(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind,
                                     page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, digest, size, payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    spread = archives.select("path").repartition("path")
    return spread.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string,"
                                  " payload_bytes bigint, payload binary")


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, as a URI that exists."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder if ":" in folder.split("/")[0] else f"file://{folder}"
