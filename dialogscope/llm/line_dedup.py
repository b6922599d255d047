"""Operator 4: lines that repeat across documents, with DataFrame functions only.

1. Every long line becomes (hash of its key, document, position); the text stays behind.
2. These rows are range-partitioned by (hash, document) and sorted within by document,
   largest first, and position.  A line that a third of all documents hold spreads over as many
   partitions as its rows need, since the document is part of the range key.
3. Each partition streams its first row of every (hash, document) and folds them to one row
   per hash and partition, and only those folded rows meet: the number of documents and the keeper of a hash.
   The answer goes back by (hash, partition), so no task gets more rows of a hash than one partition holds.
4. The positions to drop are folded into one sparse bitmap per document row: 64-bit words,
   all-kept words left out.  Documents meet their bitmap, not other documents' text.

Defined results: a null or empty text is one empty line.  A null doc_id is one document, smaller than any other.
Rows that repeat a doc_id belong to one document; each is cut by its own bitmap (a row is told apart by a hash of its
text).  A keeper keeps every line with the key.  Other columns pass through ``without_repeats``, whatever their names.
"""

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import cut, spread, table

BLANKS = " \t\n\x0b\f\r"
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_positions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, doc_id, print, pos) of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select("doc_id", _text(F.col("text")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("print"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "print", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.unhex(F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 32)).alias("hash"), "doc_id", "print", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row (doc_id, print, n_dropped, words) per document row that loses lines.

    words: array of (word, bits), where bit b of a word tells that line 64 * word + b goes; words without a bit are left out.
    """
    held = cut(cut(line_positions(docs, min_chars))
               .repartitionByRange(spread(docs), F.col("hash"), F.col("doc_id").desc_nulls_last())
               .sortWithinPartitions("hash", F.col("doc_id").desc_nulls_last(), "pos")).withColumn("part", F.spark_partition_id())
    pieces = (held.select("hash", "doc_id", "part").distinct()
              .groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")))
    whole = Window.partitionBy("hash")
    repeated = (pieces.select("hash", "part", F.sum("n_docs").over(whole).alias("n_docs"), F.max("keeper").over(whole).alias("keeper"))
                .where(F.col("n_docs") >= min_docs))
    going = held.join(repeated, ["hash", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return (going.groupBy("doc_id", "print", F.expr("pos >> 6").alias("word"))
            .agg(F.expr("bit_or(1L << (pos & 63))").alias("bits"))
            .groupBy("doc_id", "print")
            .agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
                 F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")))


def _kept(text: Column, words: Column) -> Column:
    """The lines whose bit is not set, joined again."""
    lines = _lines(text)
    bits = F.map_from_entries(words)
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")),
                        lambda w: F.coalesce(F.try_element_at(bits, w), F.lit(0).cast("bigint")))
    return F.array_join(F.filter(lines, lambda line, i: F.getbit(F.get(dense, F.floor(i / 64).cast("int")), i % 64) == 0), "\n")


def without_repeats(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc, kept, n_lines, n_dropped) for every row of ``docs``: doc holds the row's own columns as a struct,
    kept the text that stays."""
    rows = docs.select(F.struct("*").alias("doc"), _text(F.col("text")).alias("whole"))
    rows = rows.withColumn("mark", F.xxhash64("whole"))
    marks = bitmaps.select(F.col("doc_id").alias("of"), F.col("print").alias("of_mark"), "n_dropped", "words")
    met = rows.join(marks, (rows.mark == marks.of_mark) & F.col("doc").getField("doc_id").eqNullSafe(F.col("of")), "left")
    return met.select("doc", F.when(F.col("words").isNull(), F.col("whole")).otherwise(_kept(F.col("whole"), F.col("words"))).alias("kept"),
                      F.size(_lines(F.col("whole"))).cast("bigint").alias("n_lines"),
                      F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines cut from text, and n_chars (if there) counted anew for the rows that lost some."""
    met = without_repeats(docs, keep_bitmaps(docs))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    own = {c: F.col("doc").getField(c) for c in docs.columns}
    return met.select(*[(F.when(F.col("n_dropped") > 0, new[c].cast(t)).otherwise(own[c]) if c in new else own[c]).alias(c)
                        for c, t in docs.dtypes])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, keep_bitmaps(docs)).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(r.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
