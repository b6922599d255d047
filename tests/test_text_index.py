"""The trigram index against full scans; bucketed joins and read quality by their plans and counts."""

import re

import pytest
from pyspark.sql import functions as F

from dialogscope.operators import text_index
from dialogscope.plans import stores
from dialogscope.sources import bindings as B
from dialogscope.sources import quality, tables
from dialogscope.sources import skeleton_sources as SK
from dialogscope.sources.bucketed import BucketedTable, of_months
from tests.test_entry import SF

TEXTS = ["The quick brown fox", "THE END", "a", "ab", "", None, "Straße ÉTÉ été", "x😀y😀z", "10% off_now", "tab\tand\nline", "aaaaaa", "ΟΔΟΣ οδος", "(brackets) [too]", "the the", "quiet"]
LITERALS = ["the", "THE", "a", "ab", "é", "ét", "ÉTÉ", "😀", "😀y", "x😀y", "%", "d\nl", "aaaa", "ΟΔΟΣ", "zzz", "(br", "qui", "the quick brown fox", "k b", ""]
PATTERNS = [r"qui(ck|et)", r"quick.*fox", r"the( end)?$", r"a{3,}", r"brow?n", r"thee*", r"th+e", r"\(brackets\)", r"[xyz]", r"\bend\b", r"\d+%", "", r"off_now$", r"quick\s+brown", r"x.y"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, TEXTS[0], "x"), (None, TEXTS[0], "x"), (200, "word " * 5000 + "needle " + "word " * 5000, "x")]
    df = spark.createDataFrame(rows, "id long, body string, gram string").repartition(3)
    text_index.write_index(df, ["id", "gram"], "body", path)
    return path, rows


def ids(rows):
    return sorted(rows, key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("literal", [*LITERALS, "needle", "dle word"])
def test_literals(spark, index, literal):
    path, rows = index
    low = spark.range(1).select(F.lower(F.lit(literal))).first()[0]
    df = spark.createDataFrame(rows, "id long, body string, gram string")
    want = ids(r.id for r in df.where(F.contains(F.lower("body"), F.lit(low))).collect()) if literal else []
    assert ids(r.id for r in text_index.search(spark, path, literal).collect()) == want


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns(spark, index, pattern):
    path, rows = index
    df = spark.createDataFrame(rows, "id long, body string, gram string")
    want = ids(r.id for r in df.where(F.col("body").rlike("(?i)" + pattern)).collect()) if pattern else []
    assert ids(r.id for r in text_index.search(spark, path, pattern, regex=True).collect()) == want


def test_required_runs():
    runs = text_index.required_runs
    assert runs("quick.*fox") == ["quick", "fox"] and runs(r"colou?r red") == ["colo", "r red"] and runs("abc+def") == ["abc", "def"]
    assert runs("abc|def") == runs("(?x)abc def") == runs(r"\Qa.c\E") == runs("(abc)?") == runs("[abc]def") == []
    assert runs("ab{2,3}cde") == ["cde"] and runs(r"price\$ 10\.50") == ["price$ 10.50"] and runs("éabc") == ["abc"]
    assert runs(r"abc\x41def") == ["abc"] and runs(r"abc\d+ def") == ["abc", " def"] and runs("(abc)def") == ["def"]
    for p in PATTERNS:  # every match holds the runs
        for t in TEXTS:
            if t and (m := re.search(p, t, re.I)):
                assert all(r.lower() in m[0].lower() for r in runs(p))


def test_a_search_opens_only_its_buckets(spark, index):
    at = text_index._all_of(spark.read.parquet(f"{index[0]}/postings"), ["qui", "uic"])
    plan = at._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "gram IN" in plan or "In(gram" in plan


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    text_index.write_index(spark.createDataFrame([], "id long, body string"), ["id"], "body", path)
    for q, regex in (("abc", False), ("a", False), ("a.c", True)):
        docs = spark.read.schema("_n long, _block long, id long, _text string").parquet(f"{path}/docs")
        assert docs.count() == 0


def test_bucketed_join_has_no_exchange_and_prunes_months(spark):
    dialogs = BucketedTable.write(B.dialogs(spark, SF, ["dialog_id", "month", "dialog_grade", "dialog_role"]), "dialogs", 4, month_col="month")
    blocks = BucketedTable.write(SK.event_blocks(spark, SF), "blocks", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stores.semi_bucketed(dialogs, blocks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    months = spark.createDataFrame([("1996-03", 1), ("1996-04", 2), ("1997-01", 3)], "month string, rank int").where("rank < 3")
    chosen = of_months(dialogs.read(), months)
    assert "dynamicpruning" in chosen._jdf.queryExecution().executedPlan().toString()
    want = B.dialogs(spark, SF, ["month"]).where(F.col("month").isin("1996-03", "1996-04")).count()
    assert chosen.count() == want > 0
    dialogs.drop()
    blocks.drop()


def test_read_quality(spark, tmp_path):
    names = [f.name for f in tables.DIALOG_SCHEMA.fields]
    cells = [("a", "2024-01-02", "7", "10"), ("b", "2024-01-02 03:04:05", "7.0", "1e3"), (None, "2024-01-02", None, None), ("c", "02.01.2024", "7.5", "ten"), ("d", None, "x", None)]
    raw = spark.createDataFrame([(i, d, g, None, None, None, None, s, None, None, "jan") for i, d, g, s in cells], ", ".join(f"`{n}` string" for n in [*names, "month"]))
    path = f"file://{tmp_path}/checked"
    counts = quality.quarantine(raw, path)
    assert counts == {"rows": 5, "bad": 3, "no_id": 1, "date": 1, "grade": 2, "seconds": 1}
    rows = quality.stored(spark, path)
    assert sorted((r.dialog_id or "", tuple(r.reasons)) for r in rows.where("quarantined").collect()) == [("", ("no_id",)), ("c", ("date", "grade", "seconds")), ("d", ("grade",))]
    good = sorted((r.dialog_id, r.dialog_grade, r.session_seconds) for r in quality.good_dialogs(rows).collect())
    assert good == [("a", 7, 10.0), ("b", 7, 1000.0)]
    assert quality.quarantine(raw.limit(0), f"file://{tmp_path}/none")["rows"] == 0


def test_read_quality_scans_once(spark, tmp_path):
    names = [f.name for f in tables.DIALOG_SCHEMA.fields]
    spark.createDataFrame([("a",) + (None,) * 9 + ("jan",)], ", ".join(f"`{n}` string" for n in [*names, "month"])).write.csv(f"file://{tmp_path}/raw", header=True)
    marked = quality.with_reasons(spark.read.csv(f"file://{tmp_path}/raw", header=True))
    assert marked._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
