"""Substring and regex search over texts by a trigram index (F-4 at scale).

``write_index`` numbers the rows and writes two tables:

* ``docs``: number, block (32,768 numbers), the id columns and the text, in order of the numbers;
* ``postings``: one row per (gram, block) with the sorted places in the block of the texts that hold the gram; folders by a hash of the gram, sorted by
  gram inside, so that a search reads the row groups of its grams only.  A gram that every text holds is one short row per block, never one long list.

A gram is three letters of the lower-cased text; a text of one or two letters is a gram itself.

A search becomes grams that a match must hold.  Their places are intersected block by block, the candidates are joined to the texts
and verified there, so the result is that of a full scan:

* a literal of three letters or more: all its grams;
* a shorter literal: the grams that contain it, any of them;
* a regex: the grams of the literal runs that every match must hold.  One without such a run (or with alternatives or inline flags) reads all texts.

Null and empty texts match nothing but a regex that matches the empty text; a null text never matches.  An empty search returns no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import default_parallelism, scratch_dir
from .filters import require

GRAM = 3
BLOCK = 1 << 15
BUCKETS = 16


def grams(text: Column) -> Column:
    """The distinct grams of a text, lower-cased."""
    low = F.lower(text)

    def of_letters(letters: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(letters) - GRAM), lambda i: F.concat(*[F.get(letters, i + k) for k in range(GRAM)]))

    # transform over a one-element array names the letters: the text is split once, not walked from its start for every gram
    whole = F.transform(F.array(F.split(low, "")), of_letters)[0]
    return (F.when(F.length(low) >= GRAM, F.array_distinct(whole)).when(F.length(low) > 0, F.array(low)).otherwise(F.array().cast("array<string>")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(df: DataFrame, id_cols: Sequence[str], text_col: str, path: str) -> None:
    """Write the two tables of the index of ``df``'s texts under ``path``."""
    require(df, *id_cols, text_col)
    spark = df.sparkSession
    scratch_dir(spark)
    numbered = df.select(F.monotonically_increasing_id().alias("_n"), *id_cols, F.col(text_col).alias("_text"))
    (numbered.withColumn("_block", F.floor(F.col("_n") / BLOCK)).write.mode("overwrite").parquet(f"{path}/docs"))
    docs = spark.read.parquet(f"{path}/docs")  # the numbers as written: they are not made a second time
    held = docs.where("_text is not null").select("_n", "_block", F.explode(grams(F.col("_text"))).alias("gram"))
    lists = held.groupBy("gram", "_block").agg(F.sort_array(F.collect_list((F.col("_n") % BLOCK).cast("int"))).alias("places"))  # at most BLOCK
    order = ["bucket", "gram", "_block"]
    (lists.withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange(default_parallelism(spark), *order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings"))


def required_runs(pattern: str) -> list[str]:
    """Literal ASCII runs that every match of a regex holds; [] where that can't be told from its plain letters.

    Only letters outside of groups, classes and quantifiers count.
    """
    if "|" in pattern or "(?" in pattern or "\\Q" in pattern:
        return []
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            break  # classes nest: what follows is not looked at
        if c == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            at += 1
            c, plain = pattern[at], True
        else:
            plain = c.isalnum() or c in " _-,;:!'\"/<>=@#%&~`"
        if depth == 0 and plain and c.isascii():
            run += c
        elif c in "*?{" and depth == 0 and not plain:
            runs.append(run[:-1])  # the letter before may be missing
            run = ""
            if c == "{":
                at = pattern.find("}", at) if "}" in pattern[at:] else len(pattern)
        elif c == "+" and depth == 0 and not plain:
            runs.append(run)
            run = ""
        else:
            depth += (c == "(") - (c == ")") if not plain else 0
            runs.append(run)
            run = ""
            if c == "\\":
                if at + 1 < len(pattern) and pattern[at + 1] not in "wWdDsSbBAz":
                    return [r for r in runs if len(r) >= GRAM]  # an escape with arguments: what follows is not looked at
                at += 1
        at += 1
    runs.append(run)
    return [r for r in runs if len(r) >= GRAM]


def _all_of(postings: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(_n): rows whose texts hold all the grams, by intersecting places block by block."""
    bucket = [F.pmod(F.xxhash64(F.lit(g)), F.lit(BUCKETS)).cast("int") for g in wanted]
    met = (postings.where(F.col("bucket").isin(*bucket) & F.col("gram").isin(*wanted)).groupBy("_block")
           .agg(F.collect_list("places").alias("lists"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], lambda acc, x: F.array_intersect(acc, x))
    return met.select("_block", F.explode(both).alias("place")).select((F.col("_block") * BLOCK + F.col("place")).alias("_n"))


def _any_with(postings: DataFrame, part: Column) -> DataFrame:
    """(_n): rows whose texts hold a gram with ``part`` in it."""
    met = postings.where(F.contains(F.col("gram"), part)).select("_block", F.explode("places").alias("place"))
    return met.select((F.col("_block") * BLOCK + F.col("place")).alias("_n")).distinct()


def search(spark: SparkSession, path: str, text: str, regex: bool = False) -> DataFrame:
    """The id columns and ``_text`` of the rows that match, like a case-insensitive ``contains`` or regex over all texts."""
    docs = spark.read.parquet(f"{path}/docs")
    out = docs.drop("_n", "_block")
    if not text:
        return out.limit(0)
    postings = spark.read.parquet(f"{path}/postings")
    if regex:
        found = F.col("_text").rlike("(?i)" + text)
        wanted = sorted({r[k:k + GRAM] for r in map(str.lower, required_runs(text)) for k in range(len(r) - GRAM + 1)})
        at = _all_of(postings, wanted) if wanted else None
    else:
        low = F.lower(F.lit(text))
        found = F.contains(F.lower("_text"), low)
        length, wanted = spark.range(1).select(F.length(low), grams(F.lit(text))).first()
        at = _all_of(postings, wanted) if length >= GRAM else _any_with(postings, low)
    candidates = docs if at is None else docs.join(at, "_n", "left_semi")
    return candidates.where(found).drop("_n", "_block")
