"""Id planes: round trips of the format, and files against the tokenizers library."""

import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dialogscope.llm import id_planes
from tests.llm.oracle import SF

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=70), st.sampled_from(["byte", "bit"]))
def test_planes_round_trip(ids, kind):
    ids = np.array(ids, "<u4")
    planes = id_planes.planes_of(ids, kind)
    assert len(planes) == id_planes.PLANES[kind][1]
    assert id_planes.ids_of(planes, len(ids), kind).tolist() == ids.tolist()


def test_planes_are_what_they_are_called():
    ids = np.array([0x0102, 0xFF03, 5], "<u4")
    assert id_planes.planes_of(ids, "byte") == [b"\x02\x03\x05", b"\x01\xff\x00", b"", b""]
    bits = id_planes.planes_of(ids, "bit")
    assert bits[0] == bytes([0b110]) and bits[1] == bytes([0b011]) and bits[2] == bytes([0b100]) and bits[8] == bytes([0b011]) and bits[16:] == [b""] * 16


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_file_round_trip_and_spans(kind, chunk):
    chance = np.random.default_rng(0)
    docs = [(None if k == 3 else k * (-1) ** k, chance.integers(0, [300, 2 ** 32, 1][k % 3], int(chance.integers(0, 90)), dtype=np.uint64).astype("<u4")) for k in range(40)]
    out = io.BytesIO()
    writer = id_planes.PlaneWriter(out, kind, chunk)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    assert writer.close() == len(out.getvalue())
    read = id_planes.PlaneFile(io.BytesIO(out.getvalue()))
    every = np.concatenate([ids for _, ids in docs])
    assert [(i, ids.tolist()) for i, _, ids in read.documents()] == [(i, ids.tolist()) for i, ids in docs]
    for start, n in [(0, 0), (0, len(every)), (5, 1), (len(every) - 3, 3), (17, 130)]:
        assert read.ids(start, n).tolist() == every[start:start + n].tolist()


def test_a_span_reads_only_its_chunks():
    out = io.BytesIO()
    writer = id_planes.PlaneWriter(out, "byte", 100)
    writer.add(1, np.arange(5000, dtype="<u4").tobytes())
    writer.close()

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            data = super().read(n)
            self.got += len(data)
            return data

    source = Counted(out.getvalue())
    read = id_planes.PlaneFile(source)
    source.got = 0
    assert read.ids(2450, 60).tolist() == list(range(2450, 2510))
    assert source.got <= sum(read.chunks[24:26, 1:].sum(axis=1).tolist())


def test_empty_file_and_broken_files():
    out = io.BytesIO()
    id_planes.PlaneWriter(out).close()
    assert list(id_planes.PlaneFile(io.BytesIO(out.getvalue())).documents()) == []
    for broken in (b"", out.getvalue()[:-1], b"x" * 200):
        with pytest.raises(ValueError):
            id_planes.PlaneFile(io.BytesIO(broken))


def wanted(rows):
    library, place, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, place, len(ids), ids.tobytes()))
        place += len(ids)
    return out


ROWS = [(5, "The quick brown fox, 42 times!"), (2, None), (3, ""), (-7, "naïve café œuvre ½ İstanbul"), (11, "日本語のテキスト and emoji 😀"), (12, "<|endoftext|> inside <|startoftext|>"),
        (13, "x" * 3000), (14, " \n\t "), (20, "word " * 50_000), (None, "no id"), (21, "é combining ẞ"), (22, "'S 'LL don't"), (23, "\x00\x1c\x85 controls")]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_against_the_library(spark, monkeypatch, kind, tmp_path):
    monkeypatch.setattr(id_planes, "FILE_IDS", 40_000)
    docs = spark.createDataFrame([(i, t, 0, "s", 1.0) for i, t in ROWS], "doc_id long, text string, START int, ids string, n_tokens double").repartition(5)
    manifest = id_planes.write_ids(docs, VOCABULARY, folder=f"file://{tmp_path}/ids", planes=kind)
    want = wanted(ROWS)
    got = sorted(id_planes.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    digests = sorted(id_planes.read_digests(manifest).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in digests] == [(d, s, n, zlib.crc32(i)) for d, s, n, i in want]
    every = b"".join(i for *_, i in want)
    found = sorted(id_planes.read_sequences(manifest, 1000).collect(), key=lambda r: r.sequence)
    assert b"".join(bytes(r.ids) for r in found) == every
    assert [r.sequence for r in found] == list(range(-(-len(every) // 4000))) and all(len(r.ids) == 4000 for r in found[:-1])
    assert len(os.listdir(tmp_path / "ids")) == manifest.count()


def test_repeated_documents_are_spread(spark, tmp_path):
    rows = [(1, "the same text")] * 400 + [(1, "another")] * 5 + [(0, "first"), (2, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    manifest = id_planes.write_ids(docs, VOCABULARY, folder=f"file://{tmp_path}/ids")
    got = sorted(id_planes.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [0] + [1] * 405 + [2]
    texts = [bytes(r.ids) for r in got]
    assert sum(a != b for a, b in zip(texts[1:], texts[2:-1])) == 1  # equal texts stand together
    assert max(r.n_docs for r in manifest.collect()) < 300


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    manifest = id_planes.write_ids(empty, VOCABULARY)
    assert id_planes.read_ids(manifest).collect() == [] and id_planes.read_digests(manifest).collect() == [] and id_planes.read_sequences(manifest, 10).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_against_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in id_planes.op12_id_planes(spark, SF).collect())
    assert got == [(s, d, n, zlib.crc32(i)) for d, s, n, i in wanted(rows)]
