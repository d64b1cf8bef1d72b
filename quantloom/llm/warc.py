"""WARC archives as .warc.zst: each record a Zstandard frame of its own, all with a dictionary in a leading skippable frame.

An archive file is written by one task from one partition, under a name given by the partition, and renamed when
complete: a task that runs again replaces its file with the same records. Its dictionary is trained on its own first
records. The reader needs nothing but the file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import shared

#: Magic of the skippable frame that holds a dictionary.
DICT_FRAME = 0x184D2A5D
DICT_BYTES = 64 << 10
#: Payload of the first records of a file that its dictionary is trained on.
TRAIN_BYTES = 4 << 20
LEVEL = 3


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for some records, or None if they are too few or too small to train one."""
    size = min(DICT_BYTES, sum(map(len, records)) // 8)
    if len(records) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, records)
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes records to an open file. The first ones are held back until there are enough to train the dictionary."""

    def __init__(self, out: BinaryIO, level: int = LEVEL, train_bytes: int = TRAIN_BYTES):
        self.out, self.level, self.train_bytes = out, level, train_bytes
        self.held: list[bytes] | None = []
        self.size = 0

    def write(self, record: bytes) -> None:
        if self.held is None:
            self.out.write(self.frames.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.train_bytes:
            self._start()

    def _start(self) -> None:
        trained = _train(self.held)
        if trained is not None:
            raw = trained.as_bytes()
            self.out.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
        self.frames = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_content_size=True, write_checksum=True)
        held, self.held = self.held, None
        for record in held:
            self.write(record)

    def close(self) -> None:
        if self.held is not None:
            self._start()


def record(uri: str | None, kind: str, payload: bytes, payload_digest: str, fields: dict[str, str]) -> bytes:
    """A WARC/1.1 record; a revisit has the headers only."""
    body = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, payload_digest + repr(sorted(fields.items())) + str(uri))}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": (uri or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "Content-Type": "text/html; charset=utf-8",
        **fields,
        "Content-Length": str(len(body)),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an archive, in order."""
    trained, start = None, 0
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICT_FRAME:
            trained, start = zstandard.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    source = io.BytesIO(content)
    source.seek(start)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(source, read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        body = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, body


_WRITTEN = "file string, records long"


def _write_partition(path: str, level: int, train_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(path)
        context, n = TaskContext.get(), 0
        name = f"{top}/part-{context.partitionId():06d}.warc.zst"
        unfinished = f"{top}/.{uuid.uuid4().hex}.tmp"
        out = writer = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if writer is None:
                    out = store.open_output_stream(unfinished)
                    writer = Writer(out, level, train_bytes)
                payload = (html or "").encode()
                fields = {} if page_id is None else {"X-Page-Id": str(page_id)}
                if refers_to is not None:
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": f"page:{refers_to}", "X-Payload-Bytes": str(len(payload))}
                writer.write(record(url, "response" if refers_to is None else "revisit", payload, digest(payload), fields))
                n += 1
        if writer is not None:
            writer.close()
            out.close()
            store.move(unfinished, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return write


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, level: int = LEVEL, train_bytes: int = TRAIN_BYTES) -> int:
    """Writes a record per row of `pages` (page_id, url, html) to archives in a new folder `path`; returns their number.

    Of rows with equal payloads of at least `min_bytes` bytes those of the largest page_id are responses and the others
    revisits of it. Null html is an empty payload; a null page_id is below all others. Rows that repeat the largest
    id, or all ids of a payload if they are null, are responses each. Other columns do not matter.

    Payloads are compared by their SHA-1, which only the ids follow. The pages themselves are shuffled once at most, to
    meet the ids of revisits; each partition of that join, or of the scan if it is a broadcast, becomes an archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    ids = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    last = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    revisits = ids.join(last.drop("n"), "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("sha", F.col("page_id").alias("of"), "refers_to")
    joined = rows.join(revisits, (rows["sha"] == revisits["sha"]) & rows["page_id"].eqNullSafe(revisits["of"]), "left").select("page_id", "url", "html", "refers_to")
    store, top = fs.FileSystem.from_uri(path)
    store.create_dir(top)
    return joined.mapInArrow(_write_partition(path, level, train_bytes), _WRITTEN).agg(F.sum("records")).first()[0] or 0


_RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below `path`: page_id, url, record_type, payload (null for revisits), payload_bytes,
    payload_digest and refers_to. The digest of a response is computed from what was read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()), strict=True)))
        for batch in batches:
            for content in batch["content"]:
                out, size = [], 0
                for head, body in read_records(content.as_py()):
                    page, refers, revisit = head.get("X-Page-Id"), head.get("WARC-Refers-To-Target-URI"), head["WARC-Type"] == "revisit"
                    length = int(head["X-Payload-Bytes"]) if revisit else len(body)
                    sha = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(body)
                    out.append((page and int(page), head["WARC-Target-URI"], head["WARC-Type"], None if revisit else body, length, sha, int(refers.removeprefix("page:")) if refers else None))
                    size += len(body)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(parse, _RECORDS)


def op1_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    path = shared.folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
