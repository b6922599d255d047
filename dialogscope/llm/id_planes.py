"""Operator 12: token ids as files of compressed bit or byte planes.

File format (all numbers little-endian):

* head: ``MAGIC``, then kind of planes (0 bytes, 1 bits) and ids per chunk as u32;
* chunks of ``CHUNK`` ids each (the last may be shorter), cut without regard to documents.  A chunk's 32-bit ids are transposed: plane k holds
  byte k (or bit k) of every id, and each plane is a Zstandard frame of its own; a plane of zeros only is left out;
* index, one Zstandard frame: each chunk's offset and the length of each of its planes (0: left out), then each document's id, a
  mark where that id is null, and its number of ids;
* tail: the index's offset and length, the numbers of chunks and documents as u64, ``MAGIC``.

So any span of ids is read by opening only the chunks that it touches (``PlaneFile.ids``).

Writing: documents are range-partitioned and sorted by doc_id (equal ids by the text's hash; the input partition is the last key, so
that a document repeated without end is spread over tasks too), encoded, and written by the same task, file after file.  The manifest, a
reliable checkpoint with one row per file, lists the files of successful task attempts only, with the ids before each file in its
partition; the partitions' totals are summed up over one row per partition.

Encoding: the runs between white space of a Latin text are remembered; a run that is not is cut into words that the
tokenizers library's model encodes.  Any other text goes to the library whole.

Defined results: null and empty texts are documents of the end id alone.  Null doc_ids come first.  Repeated doc_ids are documents
of their own, in a defined order if their texts differ.  An empty table has an empty manifest and gives no rows.  Of the input only
doc_id and text are read, so further columns, whatever their names, don't matter.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialogscope.config import scratch_path
from dialogscope.llm.common import cut, file_system, spread, strings, table
from dialogscope.llm.wordbpe import Memo, WordVocabulary

CHUNK = 1 << 16
FILE_IDS = 1 << 24
FILE_DOCS = 1 << 20
LEVEL = 3
RUNS = 400_000
WORDS = 150_000
END_ID = 1
PLANES = {"byte": (0, 4), "bit": (1, 32)}
# Fixed values of the format.
MAGIC = b"IDPLANE1"
HEAD, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")


# --- encoding -------------------------------------------------------------------------------

class LibraryEncoder:
    """Ids as the tokenizers library gives them, without added special tokens, truncation or padding."""

    def __init__(self, path: str):
        self.path = path
        self.vocabulary = WordVocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.by_run, self.by_word = Memo(self._run, RUNS), Memo(self._word, WORDS)

    def __reduce__(self):
        return LibraryEncoder, (self.path,)

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(self.vocabulary.spelled(word))], "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.by_word.__getitem__, self.vocabulary.run_words(run)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        runs = self.vocabulary.runs(text) if text else []
        if runs is not None:
            return b"".join(map(self.by_run.__getitem__, runs))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# --- file format ----------------------------------------------------------------------------

def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of 32-bit ids, lowest first; a plane of zeros is empty."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    used = (int(ids.max(initial=0)).bit_length() + 7) // 8
    planes = rows[:, :used].T
    if kind == "bit":
        planes = np.packbits(np.unpackbits(np.ascontiguousarray(planes.T), axis=1, bitorder="little").T, axis=1, bitorder="little") if used else planes
    made = [p.tobytes() if p.any() else b"" for p in planes]
    return made + [b""] * (PLANES[kind][1] - len(made))


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids back from their planes."""
    if kind == "byte":
        rows = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                rows[:, k] = np.frombuffer(plane, np.uint8)
        return rows.view("<u4").ravel()
    bits = np.zeros((n, 32), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    """Writes one file; ``out`` needs only write(bytes)."""

    def __init__(self, out, kind: str = "byte", chunk: int = CHUNK):
        self.out, self.kind, self.chunk = out, kind, chunk
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.n_held, self.offset = [], 0, 0
        self.chunks, self.docs, self.n_ids = [], [], 0
        self._put(HEAD.pack(MAGIC, PLANES[kind][0], chunk))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, n))
        self.n_ids += n
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= self.chunk:
            ids = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(ids) // self.chunk * self.chunk
            for at in range(0, whole, self.chunk):
                self._chunk(ids[at:at + self.chunk])
            self.held, self.n_held = [ids[whole:].tobytes()], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        at, lengths = self.offset, []
        for plane in planes_of(ids, self.kind):
            packed = self.packer.compress(plane) if plane else b""
            lengths.append(len(packed))
            self._put(packed)
        self.chunks.append((at, *lengths))

    def close(self) -> int:
        """Write the last chunk and the index; returns the file's size."""
        if self.n_held:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        index = self.packer.compress(np.array(self.chunks, "<u8").tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
                                     + np.array([d is None for d, _ in self.docs], np.uint8).tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes())
        at = self.offset
        self._put(index)
        self._put(TAIL.pack(at, len(index), len(self.chunks), len(self.docs), MAGIC))
        return self.offset


class PlaneFile:
    """Reads one file; ``source`` needs seek and read."""

    def __init__(self, source):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        if end < HEAD.size + TAIL.size:
            raise ValueError("not a file of id planes")
        at, length, n_chunks, n_docs, magic = TAIL.unpack(self._at(end - TAIL.size, TAIL.size))
        head, kind, self.chunk = HEAD.unpack(self._at(0, HEAD.size))
        if (head, magic) != (MAGIC, MAGIC):
            raise ValueError("not a file of id planes")
        self.kind = next(k for k, (number, _) in PLANES.items() if number == kind)
        index = self.unpacker.decompress(self._at(at, length))
        width = 1 + PLANES[self.kind][1]
        self.chunks = np.frombuffer(index, "<u8", n_chunks * width).reshape(n_chunks, width)
        place = n_chunks * width * 8
        ids = np.frombuffer(index, "<i8", n_docs, place)
        null = np.frombuffer(index, np.uint8, n_docs, place + 8 * n_docs)
        self.sizes = np.frombuffer(index, "<u8", n_docs, place + 9 * n_docs).astype(np.int64)
        self.doc_ids = [None if no else i for i, no in zip(ids.tolist(), null.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.n_ids = int(self.starts[-1])
        self.last = (-1, None)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the file ends too early")
        return data

    def _chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            place, *lengths = self.chunks[k].tolist()
            data, planes, at = self._at(place, sum(lengths)), [], 0
            for length in lengths:
                planes.append(self.unpacker.decompress(data[at:at + length]) if length else b"")
                at += length
            self.last = (k, ids_of(planes, min(self.chunk, self.n_ids - k * self.chunk), self.kind))
        return self.last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file on; only the chunks that hold them are read."""
        parts = []
        for k in range(start // self.chunk, -(-(start + n) // self.chunk) if n else 0):
            first = k * self.chunk
            parts.append(self._chunk(k)[max(0, start - first):start + n - first])
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place in the file, ids) in order."""
        for doc_id, start, n in zip(self.doc_ids, self.starts.tolist(), self.sizes.tolist()):
            yield doc_id, start, self.ids(start, n)


# --- Spark ----------------------------------------------------------------------------------

def write_ids(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, folder: str | None = None, planes: str = "byte") -> DataFrame:
    """Encode and write (doc_id, text) rows; returns the manifest (folder, file, part, file_no, n_docs, n_ids, n_bytes, start).

    The files stay in ``folder`` (by default a new one in the shared scratch folder) until the caller removes it.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "id-planes")
    shared, end = spark.sparkContext.broadcast(LibraryEncoder(vocabulary_path)), np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = shared.value, TaskContext.get()
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        done, writer, before = [], None, 0

        def finish() -> None:
            nonlocal writer, before
            size = writer.close()
            writer.out.close()
            done.append((f"{root}/{name}", task.partitionId(), len(done), len(writer.docs), writer.n_ids, size, before))
            before, writer = before + writer.n_ids, None

        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), strings(some.column(1))):
                    if writer is None:
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.ids"
                        writer = PlaneWriter(system.open_output_stream(f"{root}/{name}", compression=None), planes)
                    writer.add(doc_id, encoder.encode(text) + end)
                    if writer.n_ids >= FILE_IDS or len(writer.docs) >= FILE_DOCS:
                        finish()
        if writer:
            finish()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)],
                                         ["file", "part", "file_no", "n_docs", "n_ids", "n_bytes", "before"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "origin": F.spark_partition_id()})
    order = ["doc_id", "hash", "origin"]
    found = cut(keyed.repartitionByRange(spread(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
                .mapInArrow(write, "file string, part int, file_no int, n_docs bigint, n_ids bigint, n_bytes bigint, before bigint"))
    parts = found.groupBy("part").agg(F.sum("n_ids").alias("total"))  # one row per range partition
    starts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    return (found.join(starts, "part").select(F.lit(folder).alias("folder"), "file", "part", "file_no", "n_docs", "n_ids", "n_bytes",
                                              (F.col("first") + F.col("before")).alias("start")))


def _read(made, names: list[str], kinds: list[pa.DataType], step: int = 4 << 20):
    """One row per document, by ``made(doc_id, start, ids)``, for every file of a manifest; a batch holds about ``step`` ids."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                system, _ = file_system(f["folder"])
                with system.open_input_file(f["file"]) as source:
                    rows, size = [], 0
                    for doc_id, place, ids in PlaneFile(source).documents():
                        rows.append(made(doc_id, f["start"] + place, ids))
                        size += len(ids)
                        if size >= step or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    return read


def _files(manifest: DataFrame) -> DataFrame:
    return manifest.select("folder", "file", "start").repartition(spread(manifest), "file")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the manifest's files; ids: four little-endian bytes each."""
    read = _read(lambda doc_id, start, ids: (doc_id, start, len(ids), ids.tobytes()), ["doc_id", "start", "n_tokens", "ids"],
                 [pa.int64(), pa.int64(), pa.int64(), pa.binary()])
    return _files(manifest).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the files; the ids don't leave the task."""
    read = _read(lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), ["doc_id", "start", "n_tokens", "ids_crc32"],
                 [pa.int64()] * 4)
    return _files(manifest).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_sequences(manifest: DataFrame, length: int) -> DataFrame:
    """(sequence, ids): the ids of all documents as one row of sequences of ``length`` ids, the last maybe shorter, by the chunk index.

    Each file is asked for the spans that begin in it; what a span lacks is the head of the next files, found by their starts.
    """
    total = manifest.agg(F.sum("n_ids")).first()[0] or 0
    spans = (manifest.where("n_ids > 0").select("folder", "file", "start", "n_ids", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n_ids") - 1) / length))).alias("sequence"))
             .repartition(spread(manifest), "file", "sequence"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, opened = [], (None, None, None)
            for r in sorted(batch.to_pylist(), key=lambda r: (r["file"], r["sequence"])):
                if opened[0] != r["file"]:
                    if opened[2]:
                        opened[2].close()
                    source = file_system(r["folder"])[0].open_input_file(r["file"])
                    opened = (r["file"], PlaneFile(source), source)
                first = max(r["start"], r["sequence"] * length)
                last = min(r["start"] + r["n_ids"], (r["sequence"] + 1) * length, total)
                rows.append((r["sequence"], first, opened[1].ids(first - r["start"], last - first).tobytes()))
            if opened[2]:
                opened[2].close()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["sequence", "at", "ids"])

    parts = spans.mapInArrow(read, "sequence bigint, at bigint, ids binary")
    joined = parts.groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))  # at most ``length`` ids
    return joined.select("sequence", F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def op12_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_digests(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
