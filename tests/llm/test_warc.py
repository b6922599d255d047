"""WARC archives: exact round trips, the file format, revisits, and DuckDB."""

import base64
import hashlib
import io
import os
import random
import struct
from collections import defaultdict

import pytest
import zstandard

from dialogscope.llm import warc
from tests.llm.oracle import SF, same_as_sql


class Memory:
    def __init__(self):
        self.files = {}

    def open_output_stream(self, path, compression=None):
        out = io.BytesIO()
        out.close = lambda: self.files.__setitem__(path, out.getvalue())
        return out


def archive(records):
    memory = Memory()
    f = warc.ArchiveFile(memory, "x")
    for r in records:
        f.add(r)
    assert f.close() == len(memory.files["x"])
    return memory.files["x"]


def page(k):
    pick = random.Random(k)
    return ("<html><body>" + " ".join(pick.choices(["<p>", "</p>", "river", "stone", "Größe", "\r\n\r\n", "paper"], k=pick.randint(0, 400)))).encode()


def test_file_begins_with_the_dictionary_and_each_record_is_a_frame():
    records = [warc.record(k, f"http://a.example/{k}", page(k)) for k in range(1500)]
    data = archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
    assert dictionary.dict_id()
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[8 + size:], read_across_frames=False)
    assert first == records[0]
    assert list(warc.records_of(io.BytesIO(data))) == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) < plain


def framed(data):
    """The records of an archive, each read alone with the dictionary of the leading frame."""
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    reader, out, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])), [], 8 + size
    while at < len(data):
        frame = reader.decompressobj()
        out.append(frame.decompress(data[at:]))
        at = len(data) - len(frame.unused_data)
    return out


@pytest.mark.parametrize("payloads", [[b"tiny"], [b"tiny"] * 3, [b""], [os.urandom(5_000_000)], [os.urandom(1000) * 2000 for _ in range(3)],
                                      [b"<p>river</p>" * 80_000 for _ in range(5)], [b"x" * 9] * 2000])
def test_every_archive_has_its_dictionary(payloads):
    records = [warc.record(k, None, p) for k, p in enumerate(payloads)]
    data = archive(records)
    assert framed(data) == records
    assert list(warc.records_of(io.BytesIO(data))) == records


def test_folders_of_other_systems():
    from dialogscope.llm.common import arrow_name, file_system

    assert arrow_name("s3a://bucket/some/folder") == arrow_name("s3n://bucket/some/folder") == "s3://bucket/some/folder"
    assert arrow_name("dbfs:/tmp/x") == "file:///dbfs/tmp/x" and arrow_name("hdfs://host:1/x") == "hdfs://host:1/x"
    assert file_system("file:///tmp/x")[1] == "/tmp/x"


def test_damage_is_noticed():
    good = warc.record(1, "u", b"payload")
    assert warc.parsed(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    data = archive([warc.record(k, "u", page(k)) for k in range(50)])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_of(io.BytesIO(data[:-3])))


def brute(rows, min_bytes=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((x for x in groups[p] if x is not None), default=None) if len(groups[p]) > 1 and len(p) >= min_bytes else None
        again = first is not None and i != first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_edge_cases(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rows = [(k, f"http://a.example/{k}", page(k % 300).decode()) for k in range(500)]
    rows += [(1000, None, None), (1001, "u\r\nX: y", ""), (1002, "u", None), (None, "u", page(5).decode()), (None, "u", "only null ids"), (None, "u", "only null ids"),
             (3, "again", page(3).decode()), (1003, "long", "x\r\n\r\n" * 300_000), (1004, "ünï", "\x00 日本")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, digest int").repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/warc")
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    assert manifest.count() > 3 and all(os.path.getsize(r.file) == r.n_bytes for r in manifest.collect())
    got = warc.read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    want = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in want for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id in (1000, 1001)} == {None, "u%0D%0AX: y"}


def test_smaller_payloads_are_all_responses(spark):
    rows = [(k, "u", "same" if k < 4 else "same but longer") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, min_bytes=10), payload=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows, 10)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_duckdb(spark):
    assert len(same_as_sql(spark, warc.op6_warc, warc.OP6_SQL)) == 250
