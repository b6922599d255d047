"""Operator 2: URL filter - rules first, then a naive Bayes classifier over segmented words.

Rules: a rule ``host/path`` fits its host and all subdomains where the url's path begins with the rule's; the
longest fitting rule decides (among equally long ones the alphabetically first).  This part is plain column expressions.

Other urls are judged by their words.  Host and path are split at everything but letters and digits; each concatenated
name is cut into words by Viterbi search under a unigram model, whose counts come from the words of all pages' html.
A multinomial naive Bayes model then scores the words.  No table labels urls, so the evidence is what the pages say: a page counts as
unwanted if the text of its html holds a seed word (``SEEDS``), as wanted if it has html without one.  The words of the
url play no part in its label, and no url is judged by its own pages: their counts are taken out of the token counts before it is scored
(leave-one-out, so what is judged was never trained on).  The verdict is ``block`` where the posterior of the unwanted class is above one half: a
seed word in a url decides nothing that the other pages don't bear out, and words that go with unwanted pages block urls without a seed word.

Counts cover all rows and all words, and stay in Spark: equal urls are folded first, each distinct run of letters meets the
counts of its substrings in a join and is cut once, and each url's tokens meet their counts in another.  No word
list is capped, collected or sent to the executors: known words above ``LONGEST`` letters are met by their first ``LONGEST``.  The joins'
large sides have exchanges of their own, so that a hot run, token or url can be split.  A run of more than ``RUN`` letters is cut every ``RUN`` letters,
so that no row holds an unbounded number of substrings.  Both classes have the same prior: how many unwanted
pages a crawl holds says nothing about one url.

Defined results: a null url or one without ``://`` has empty host and path, no rule and no words, and is allowed.
Null html adds no words and no evidence.  Rows are independent; repeated rows count as often as they stand.  A score of exactly zero (no known
word) is ``allow``.  An empty table gives no rows.  Further columns of the input, whatever their names, are ignored.
"""

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import cut, own_exchange, strings, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
# Words that mark an unwanted host or path.
SEEDS = ("adult bet bets betting casino cheap cialis crack dating drugs escort gambling hentai jackpot keygen loan loans lottery malware "
         "nude pharma phishing pills poker porn roulette sex slots spam torrent viagra warez win xxx xxxx ads track tracker").split()
SMOOTH = 10.0
ROUNDING = 1e-9  # log odds within it of zero are zero
LONGEST = 24
MEMO_ENTRIES = 100_000
RUN = 4_096
BATCH_ROWS = 50_000
_TAG = re.compile(r"<[^<>]*>|&#?\w{1,10};")
_HIDDEN = re.compile(r"<(script|style)\b")
_RUNS = "[a-z]{1,%d}|[0-9]+" % RUN
_RUN = re.compile(_RUNS)
_ASCII_WORD = re.compile(r"(?<![^\W\d_])[a-z]+(?![^\W\d_])")  # no part of a word with other letters


# --- rules ----------------------------------------------------------------------------------

def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last that fits wins
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


# --- words ----------------------------------------------------------------------------------

def shown(html: str) -> str:
    """The lower-cased page without its scripts and styles (one that is not closed reaches to the end)."""
    html, parts, at = html.lower(), [], 0
    while found := _HIDDEN.search(html, at):
        parts.append(html[at:found.start()])
        at = html.find(f"</{found[1]}", found.end())
        if at < 0:
            return " ".join(parts)
    return " ".join([*parts, html[at:]])


def page_words(html: str | None) -> list[str]:
    """The lower-cased words of a page's text, tags and entities left out, in ASCII letters; digits and signs end a word."""
    return _ASCII_WORD.findall(_TAG.sub(" ", shown(html))) if html else []


class Segmenter:
    """Cuts concatenated names into words: the most probable split under word counts.

    An unknown word of n letters has the probability 10 / (total * 10^n), so a name is only cut into known words
    that are likelier than the whole.  ``total`` is that of all words, where ``counts`` are only those a name can meet.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = sum(counts.values()) + 1 if total is None else total
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.sizes = sorted({len(w) for w in counts}, reverse=True)
        self.memo: dict[str, list[str]] = {}

    def words(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        unknown, letter = math.log(self.total / 10), math.log(10)
        start = (0.0, 0)  # the best place for an unknown word to begin, whatever its length
        for end in range(1, len(name) + 1):
            low = (start[0] + unknown + letter * end, start[1])
            for size in self.sizes:
                if size <= end and (cost := self.cost.get(name[end - size:end])) is not None:
                    low = min(low, (best[end - size] + cost, end - size))
            best.append(low[0])
            back.append(low[1])
            start = min(start, (low[0] - letter * end, end))
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """The words of host and path; a number is the token ``#``."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        out = []
        for run in _RUN.findall(host + " " + path.lower()):
            if run[0].isdigit():
                out.append("#")
            else:
                found = self.memo.get(run)
                if found is None:
                    found = self.words(run)
                    if len(run) <= 64:
                        self.memo[run] = found
                out += found
        return out


def log_ratio(b, g, bad, good, smooth: float = SMOOTH, log=math.log):
    """The weight of a token counted ``b`` and ``g`` times (not both 0) among the ``bad`` and ``good`` tokens (numbers, or columns with F.log)."""
    both = bad + good
    return log((b + smooth * (b + g) / both) / (bad + smooth)) - log((g + smooth * (b + g) / both) / (good + smooth))


class NaiveBayes:
    """Multinomial with equal priors; ``weights`` are the log ratios unwanted / wanted of the known tokens.

    Each class's counts are smoothed by ``SMOOTH`` tokens drawn from the frequencies of both classes together, so
    that a rare token does not lean to the smaller class.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], totals: tuple[int, int], smooth: float = SMOOTH):
        self.weights = {w: log_ratio(b, g, *totals, smooth) for w, (b, g) in counts.items()}

    def log_odds(self, tokens) -> float:
        return math.fsum(self.weights.get(t, 0.0) for t in tokens)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of all words of all pages, and the seed words with at least the median count."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for html in strings(batch.column(0)):
                counts.update(page_words(html))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = cut(pages.select("html").mapInArrow(counted, "word string, n bigint").groupBy("word", own_exchange("word"))
                .agg(F.sum("n").alias("n")).select("word", "n"))
    typical = found.select(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").cast("bigint").alias("n")).first().n or 1
    seeds = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SEEDS))).alias("word"), F.lit(typical).cast("bigint").alias("n"))
    return found.unionByName(seeds.join(found, "word", "left_anti"))


def unwanted(html: Column) -> Column:
    """Whether a page's text holds a seed word (null html: null)."""
    seeds = set(SEEDS)

    @F.arrow_udf("boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([None if h is None else not seeds.isdisjoint(page_words(h)) for h in strings(pages)], pa.bool_())

    return found(html)


def substrings(runs: DataFrame) -> DataFrame:
    """(run_id, word): the substrings of up to LONGEST letters of each (run_id, run)."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = [], []
            for run_id, run in zip(strings(batch.column(0)), strings(batch.column(1))):
                some = {run[a:b] for a in range(len(run)) for b in range(a + 1, min(len(run), a + LONGEST) + 1)}
                ids += [run_id] * len(some)
                held += some
                if len(ids) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.string())], ["run_id", "word"])
                    ids, held = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.string())], ["run_id", "word"])

    return runs.select("run_id", "run").mapInArrow(found, "run_id bigint, word string")


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of each distinct run, cut under the counts of all words."""
    total = (counts.agg(F.sum("n").alias("n")).first().n or 0) + 1
    numbered = cut(runs.distinct().select(F.monotonically_increasing_id().alias("run_id"), "run"))
    parts = substrings(numbered)
    met = parts.join(counts, "word").select("run_id", "word", "n")
    longer = counts.where(F.length("word") > LONGEST).select(F.col("word").alias("whole"), F.substring("word", 1, LONGEST).alias("word"), "n")
    candidates = parts.where(F.length("word") == LONGEST).join(longer, "word").join(numbered, "run_id")
    held = candidates.where(F.contains("run", "whole")).select("run_id", F.col("whole").alias("word"), "n")
    known = met.unionByName(held).groupBy("run_id").agg(F.collect_set(F.struct("word", "n")).alias("known"))  # at most LONGEST x RUN, and longer words

    @F.arrow_udf("array<string>")
    def words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, tables in batches:
            yield pa.array([Segmenter({k["word"]: k["n"] for k in some or ()}, total).words(name)
                            for name, some in zip(strings(names), strings(tables))], pa.list_(pa.string()))

    return cut(numbered.join(known, "run_id", "left").select("run", words("run", "known").alias("words")))


def worded(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``urls`` (url_id, host, path, ...) with the words of host and path in order; a number is the word ``#``."""
    names = F.regexp_extract_all(F.concat_ws(" ", "host", F.lower("path")), F.lit(f"({_RUNS})"), 1)
    held = (urls.select("url_id", F.posexplode(names).alias("at", "run"))
            .withColumn("run", F.when(F.col("run").rlike("^[0-9]"), "#").otherwise(F.col("run"))))
    found = (held.join(split_runs(held.select("run"), counts), "run").groupBy("url_id")
             .agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts")))
    none = F.array().cast("array<string>")
    return (urls.join(found, "url_id", "left")
            .select(*urls.columns, F.coalesce(F.flatten(F.transform("parts", lambda p: p["words"])), none).alias("words")))


def token_counts(urls: DataFrame) -> DataFrame:
    """(word, bad, good) of all tokens over all rows: each url counts ``n_bad`` or ``n_good`` times."""
    return cut(urls.select(F.explode("words").alias("word"), "n_bad", "n_good").groupBy("word", own_exchange("word"))
               .agg(F.sum("n_bad").alias("bad"), F.sum("n_good").alias("good")).select("word", "bad", "good"))


def weights(urls: DataFrame) -> DataFrame:
    """(url_id, weights): the weight of each of a url's words times its number, by the counts of all other urls."""
    counts = token_counts(urls)
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    own = (urls.select("url_id", "n_bad", "n_good", F.size("words").alias("size"), F.explode("words").alias("word"))
           .groupBy("url_id", "word", "n_bad", "n_good", "size").agg(F.count(F.lit(1)).alias("times")))
    b, g = F.col("bad") - F.col("times") * F.col("n_bad"), F.col("good") - F.col("times") * F.col("n_good")
    bad, good = (F.lit(getattr(total, k) or 0) - F.col("size") * F.col(f"n_{k}") for k in ("bad", "good"))
    weight = F.when(b + g > 0, F.col("times") * log_ratio(b, g, bad, good, log=F.log)).otherwise(F.lit(0.0))
    return own.join(counts, "word").select("url_id", weight.alias("weight")).groupBy("url_id").agg(F.collect_list("weight").alias("weights"))


def exact_sum(weights: str) -> Column:
    """The sum of an array column, the same in any order."""
    @F.arrow_udf("double")
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in batches:
            yield pa.array([math.fsum(w or ()) for w in strings(some)], pa.float64())

    return summed(weights)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words, log_odds of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = pages.select(host.alias("host"), path.alias("path"), unwanted(F.col("html")).alias("unwanted"))
    urls = cut(seen.groupBy("host", "path").agg(F.count_if("unwanted").alias("n_bad"), F.count_if(~F.col("unwanted")).alias("n_good"))
               .select(F.monotonically_increasing_id().alias("url_id"), "host", "path", "n_bad", "n_good"))
    urls = cut(worded(urls, word_counts(pages)))
    odds = weights(urls)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    found = (urls.join(odds, "url_id", "left").select("*", exact_sum("weights").alias("log_odds"))
             .select("host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("log_odds") > ROUNDING, "block").otherwise("allow")).alias("verdict"),
                     "words", "log_odds"))
    return rows.join(found, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
