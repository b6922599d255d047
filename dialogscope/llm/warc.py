"""Operator 6: WARC archives with dictionary compression, written and read by Spark tasks.

Writing: the payload's SHA-256 groups equal payloads (one pre-aggregated row per digest crosses the shuffle, so a payload
that a third of all pages share costs one row per task); the smallest page_id of a group is its response, the
others are revisits without payload.  Each task writes files ``*.warc.zst``: a Zstandard dictionary built from the
file's first records, embedded in a leading skippable frame, then every record compressed as a frame of its own
with that dictionary, so that any record can be read alone.  Samples are short records whole and evenly spaced pieces of long ones; where they are too
few or too alike to train on, they are the dictionary themselves (raw content), so that every archive begins with its frame.  A file is closed at ``FILE_BYTES``.  File names hold the task attempt, and only
the files listed by successful attempts (the manifest, a reliable checkpoint) count, so a lost executor leaves no harm but an unlisted file.

Reading: one row per file; tasks stream the file's frames and check every payload against its digest.

Files go to the given folder, by default one in the shared checkpoint folder, through pyarrow's file systems (local, HDFS, S3, GCS; see
``common.file_system`` for their names).  They stay until the caller removes the folder.

Defined results: null html is an empty payload, null urls are left out of the record.  A null page_id never is
a group's response unless all its ids are null (then all are responses); rows that repeat the smallest page_id with the same html are all responses.
An empty table has an empty manifest and gives no rows.  Further columns of the input, whatever their names, are ignored.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.config import scratch_path
from dialogscope.llm.common import cut, file_system, own_exchange, spread, table

FILE_BYTES = 64 << 20
SAMPLE_RECORDS = 1_000
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
PIECES, PIECE_BYTES = 16, 4 << 10
LEVEL = 3
# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # the pages carry no time of capture
LINE, END = b"\r\n", b"\r\n\r\n"


# --- records --------------------------------------------------------------------------------

def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'unknown' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, revisits=None, is_revisit: bool = False) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with none."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP_HEAD if is_revisit else HTTP_HEAD + payload
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.translate({10: "%0A", 13: "%0D"})))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if is_revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(revisits)), ("X-Refers-To-Page-ID", str(revisits))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + LINE.join(f"{k}: {v}".encode() for k, v in head) + END + block + END


def parsed(data: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    payload = rest[:int(fields["Content-Length"])].partition(END)[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                                              or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not fit its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": number("X-Payload-Length"),
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def samples_of(data: bytes) -> list[bytes]:
    """A short record whole, or evenly spaced pieces of a long one."""
    if len(data) <= PIECES * PIECE_BYTES:
        return [data]
    return [data[at:at + PIECE_BYTES] for at in (k * (len(data) - PIECE_BYTES) // (PIECES - 1) for k in range(PIECES))]


def dictionary_of(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the samples, or made of them where they don't suffice for training."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveFile:
    """Writes one archive: the first records are held back to train the dictionary."""

    def __init__(self, system, path: str):
        self.system, self.path = system, path
        self.held, self.size, self.n, self.offset = [], 0, 0, 0
        self.out = self.compressor = None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.n += 1
        if self.compressor:
            self._put(self.compressor.compress(data))
        else:
            self.held.append(data)
            if len(self.held) >= SAMPLE_RECORDS or self.size >= SAMPLE_BYTES:
                self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def _begin(self) -> None:
        self.out = self.system.open_output_stream(self.path, compression=None)
        dictionary = dictionary_of([s for data in self.held for s in samples_of(data)])
        raw = dictionary.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        for data in self.held:
            self._put(self.compressor.compress(data))
        self.held = []

    def close(self) -> int:
        if not self.compressor:
            self._begin()
        self.out.close()
        return self.offset


def records_of(stream) -> Iterator[bytes]:
    """The records of an archive, one by one; ``stream`` needs only read(n)."""
    data, dictionary = stream.read(8), None
    if len(data) == 8 and struct.unpack("<II", data)[0] == DICTIONARY_FRAME:
        dictionary = zstandard.ZstdCompressionDict(_all(stream, struct.unpack("<II", data)[1]))
        data = b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(1 << 20)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(1 << 20)):
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def _all(stream, n: int) -> bytes:
    parts = []
    while n and (part := stream.read(n)):
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


# --- Spark ----------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, revisits, is_revisit): who holds the payload and who refers to it."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha2(F.col("payload").cast("binary"), 256)))
    shared = (rows.where(F.octet_length("payload") >= min_bytes).groupBy(F.col("digest").alias("of"), own_exchange("digest"))
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"))
    met = rows.join(shared, rows.digest == shared.of, "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "url", "payload", F.when(is_revisit, F.col("first")).alias("revisits"), is_revisit.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) rows as archives; returns the manifest (file, n_records, n_bytes)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        task, n, current, done = TaskContext.get(), 0, None, []
        for batch in batches:
            for at in range(0, len(batch), 64):
                for r in batch.slice(at, 64).to_pylist():
                    if current is None:
                        current = ArchiveFile(system, f"{root}/{task.partitionId():05d}-{task.taskAttemptId()}-{n:04d}.warc.zst")
                        n += 1
                    current.add(record(r["page_id"], r["url"], r["payload"].encode(), r["revisits"], r["is_revisit"]))
                    if current.size >= FILE_BYTES:
                        done.append((current.path, current.n, current.close()))
                        current = None
        if current:
            done.append((current.path, current.n, current.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], ["file", "n_records", "n_bytes"])

    found = cut(with_revisits(pages, min_bytes).mapInArrow(write, "file string, n_records bigint, n_bytes bigint"))
    return found.withColumn("folder", F.lit(folder))


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and, if asked for, the payload as binary (a revisit has an empty one)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                system, _ = file_system(f["folder"])
                held, size = [], 0
                with system.open_input_stream(f["file"], compression=None, buffer_size=1 << 20) as stream:
                    for r in map(parsed, records_of(stream)):
                        held.append(r)
                        size += len(r["payload"]) if payload else 0
                        if len(held) >= 2_000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in kinds.items()], list(kinds))
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in kinds.items()], list(kinds))

    schema = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
              + (", payload binary" if payload else ""))
    files = manifest.select("folder", "file").repartition(spread(manifest), "file")
    return files.mapInArrow(read, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(sha1(h), 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
