"""Every stage of the pipeline against a plain version of its decision, on the given tables and on edge rows."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from dialogscope.llm import langid, simhash
from tests.llm.oracle import SF
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_line_dedup import walk
from tests.llm.test_simhash import brute_classes

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def stages(spark, docs, folder):
    """The input and the output rows of each stage."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        yield name, docs, docs.collect(), out, out.collect()
        docs = out


@pytest.mark.parametrize("edge", [False, True])
def test_stages(spark, tmp_path, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    if edge:
        docs = docs.limit(300).withColumn("lang_prediction", F.lit("x")).withColumn("print", F.lit(1)).withColumn("kept", F.lit("k"))
        text = docs.first().text
        more = [(None, text, "en"), (None, "short text here", None), (90_000, None, "en"), (90_001, "", "de"), (90_002, "1 2 3", None),
                (90_003, text, None), (90_003, text, None), (90_004, "word " * 30_000, "en"), (90_005, f"a b {items[0][1]} c", None)]
        docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    seen = {}
    for name, before, rows, after, kept in stages(spark, docs, tmp_path):
        seen[name] = rows, kept
        if name != "bpe_encoding":
            assert after.columns == before.columns and after.dtypes == before.dtypes
    pairs = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=repr)

    rows, kept = seen["language_id"]
    judged = {(r.doc_id, r.text): r.p for r in docs.select("doc_id", "text", langid.predictions(
        spark, langid.fit(langid.training_rows(docs)), docs.text).alias("p")).collect()}
    assert pairs(kept) == pairs(r for r in rows if judged[r.doc_id, r.text].lang_pred != "und" and judged[r.doc_id, r.text].score >= 0.3)
    assert len(kept) >= 0.99 * len([r for r in rows if r.text])

    rows, kept = seen["line_dedup"]
    want = sorted(((i, t if n else None) for i, _, n, t in walk([(r.doc_id, r.text) for r in rows])), key=repr)
    texts = {(r.doc_id, r.text) for r in rows}
    assert sorted(((r.doc_id, None if (r.doc_id, r.text) in texts else r.text) for r in kept), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in kept if r.n_chars is not None)

    rows, kept = seen["simhash_near_dedup"]
    label = brute_classes([simhash.fingerprint(r.text) for r in rows], 3)
    first = {}
    for r, c in zip(rows, label):
        if r.doc_id is not None:
            first[c] = min(first.get(c, r.doc_id), r.doc_id)
    assert pairs(kept) == pairs(r for r, c in zip(rows, label) if r.doc_id is None or r.doc_id == first[c])

    rows, kept = seen["benchmark_decontamination"]
    bad = brute_items([(k, r.text) for k, r in enumerate(rows)], items)
    assert pairs(kept) == pairs(r for k, r in enumerate(rows) if k not in {d for d, _ in bad})
    assert len(kept) < len(rows)

    rows, kept = seen["bpe_encoding"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), raw, hashlib.sha256(raw).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in kept), key=repr) == sorted(want, key=repr)


def test_run_is_registered_and_returns_the_last_stage(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    got = corpus_pipeline.run(spark, SF.replace("0.01", "0.001"))
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
