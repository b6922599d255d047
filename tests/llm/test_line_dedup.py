"""Line dedup against DuckDB and against a plain walk over the lines."""

import hashlib
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dialogscope.llm import line_dedup
from tests.llm.oracle import SF, same_as_sql

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def walk(rows):
    """(n_lines, n_dropped, kept text) for each (doc_id, text)."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    low = lambda i: float("-inf") if i is None else i
    gone = {k: max(v, key=low) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cases():
    pick = random.Random(5)
    common = [f"{'Line É ' * 6}number {k} of the shared lines" for k in range(6)] + ["x" * 39, "é" * 40, "z" * 41]
    rows = [(i, "\n".join(pick.choice([*common, "  " + pick.choice(common).upper() + "\t\x0b", "short", "", f"{'own ' * 12}{pick.random()}"])
                          for _ in range(pick.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n" + common[0]), (None, common[0] + "\n" + common[1]), (None, "no"),
             (7, rows[7][1]), (7, common[2] + "\nother"), (200, "\n".join([common[3]] * 300 + ["tail"] + [common[4]] * 200)),
             (201, "\n".join(f"{'line ' * 10}{k}" for k in range(3000)) + "\n" + common[3]), (-5, common[0])]
    return rows


def test_matches_a_walk_over_edge_cases(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, print string, n_dropped int, hash int")
    met = line_dedup.without_repeats(docs, line_dedup.keep_bitmaps(docs))
    got = [(r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in met.collect()]
    assert sorted(got, key=repr) == sorted(walk(rows), key=repr)
    assert any(r[2] > 100 for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.without_repeats(docs, line_dedup.keep_bitmaps(docs)).count() == 0


def test_bitmaps_are_sparse_words(spark):
    line = "a line that several of the documents hold in the same words"
    docs = spark.createDataFrame([(i, "\n" * 200 + line) for i in range(6)], "doc_id long, text string")
    rows = line_dedup.keep_bitmaps(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_dropped, [tuple(w) for w in r.words]) for r in rows] == [(i, 1, [(3, 1 << 8)]) for i in range(5)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = line_dedup.without_repeats(docs, line_dedup.keep_bitmaps(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_duckdb(spark):
    rows = same_as_sql(spark, line_dedup.op4_line_dedup, line_dedup.OP4_SQL)
    assert len(rows) == 1000
    empty = hashlib.sha256(b"").hexdigest()
    assert spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0] == empty
