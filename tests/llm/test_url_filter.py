"""URL filter: parsing and rules against a plain version, Viterbi against enumeration, naive Bayes against its formula."""

import itertools
import math
import os
from collections import Counter

import pytest

from dialogscope.llm import url_filter
from dialogscope.llm.url_filter import NaiveBayes, Segmenter, judged, page_words
from pyspark.sql import functions as F

from tests.llm.oracle import SF


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for kind, rule in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return host, path, *(best[::-1] if best else (None, None))


URLS = ["http://a.example.net/en/1?x#y", "https://A.Example.NET/EN/1", "http://example.net/en", "http://example.net/en/", "http://net/", "http://net", "http://xnet/",
        "http://example.com/de/5.html", "http://badexample.com/de/5", "ftp://x.org/fr/", "x.org/fr/", None, "", "://", "http://", "http://?q=/", "http://a.net#/en/",
        "http://a.example.net?/en/", "http://x.org/fr/a?b=://c", "http://É.org/É\n/z", "http://adult-x.example.com/en/7", "http://cheappills.example.com/x",
        "http://www.spam-farm.example.org/en/7", "http://riverstone.example.com/en/77", "http://river.example.com/en/7"]


def plain_odds(rows):
    """(page_id -> log odds) by leave-one-out naive Bayes in plain Python; rows: (page_id, host, path, words, html)."""
    words, bad, good = {}, Counter(), Counter()
    for _, host, path, own, html in rows:
        words[host, path] = own
        if html is not None:
            (good if set(page_words(html)).isdisjoint(url_filter.SEEDS) else bad)[host, path] += 1
    counts = {k: Counter() for k in "bg"}
    for u, own in words.items():
        for w in own:
            counts["b"][w] += bad[u]
            counts["g"][w] += good[u]
    total = {k: sum(c.values()) for k, c in counts.items()}
    out = {}
    for u, own in words.items():
        odds = []
        for w, n in Counter(own).items():
            b, g = counts["b"][w] - n * bad[u], counts["g"][w] - n * good[u]
            if b + g:
                odds.append(n * url_filter.log_ratio(b, g, total["b"] - len(own) * bad[u], total["g"] - len(own) * good[u]))
        out[u] = math.fsum(odds)
    return {i: out[host, path] for i, host, path, *_ in rows}


def same_as_plain(got, html):
    want = plain_odds([(r.page_id, r.host, r.path, r.words, html[r.page_id]) for r in got])
    for r in got:
        assert (r.log_odds or 0.0) == pytest.approx(want[r.page_id], rel=1e-9, abs=1e-9)
        if r.rule is None:
            assert r.verdict == ("block" if want[r.page_id] > url_filter.ROUNDING else "allow")


def test_rows_and_rules(spark):
    pages = [(i, u, f"<html><p>river stone cheap pills</p>{'<p>river stone paper green</p>' * 9}", "x") for i, u in enumerate(URLS)]
    pages += [(900, URLS[0], None, "x"), (901, URLS[1], "", "x"), (0, URLS[0], "<" * 50_000, "x")] + [(1000 + i, f"http://paper{i}.example.com/en/{i}", None, "x") for i in range(60)]
    pages += [(None, URLS[2], None, "x")]
    got = judged(spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")).collect()
    assert len(got) == len(pages)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == sorted(((i, *plain(u)[:3]) for i, u, *_ in pages), key=repr)
    by = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        if plain(u)[3]:
            assert by[i].verdict == plain(u)[3]
    assert [by[URLS.index(u)].verdict for u in (None, "")] == ["allow"] * 2
    assert by[21].words[:2] == ["cheap", "pills"] and by[23].words[:2] == ["river", "stone"]


def test_verdicts_are_learned_from_the_other_pages(spark):
    """Seed words in a url decide nothing; words that go with unwanted pages do."""
    bad, good = "<p>play poker and win the jackpot</p>", "<p>river stone paper green</p>"
    pages = [(i, f"http://luckyreel{i}.example/spin/{i}", bad) for i in range(20)] + [(100 + i, f"http://paper.example/green/{i}", good) for i in range(40)]
    pages += [(200 + i, f"http://pills.example/museum/{i}", good) for i in range(20)]  # a museum of pills
    pages += [(300, "http://spin.luckyreel.example/new", None), (301, "http://museum.example/pills", None), (302, "http://casino.example/", None),
              (303, "http://river.example/spin", good), (304, "http://luckyreel7.example/spin/7", good)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    words = spark.createDataFrame([(0, None, "<p>" + "lucky reel spin museum pills paper green " * 30 + "</p>")], "page_id long, url string, html string")
    got = judged(frame.unionByName(words.withColumn("page_id", F.lit(999).cast("long")))).collect()
    html = {i: h for i, _, h in pages} | {999: words.first().html}
    same_as_plain(got, html)
    verdict = {r.page_id: r.verdict for r in got}
    assert verdict[0] == verdict[19] == "block" and verdict[300] == "block"  # no seed word in the url
    assert verdict[200] == verdict[301] == "allow" and verdict[302] == "allow"  # a seed word in the url
    assert verdict[100] == "allow"


def test_long_words_and_runs(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    pages = [(1, f"http://die{long}mit.example/", f"<p>{(long + ' die mit ') * 40} x9mit</p>"), (2, f"http://x.example/{'ab' * 6000}/{long[:30]}", None)]
    got = {r.page_id: r.words for r in judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1][:3] == ["die", long, "mit"]
    assert "".join(got[2]) == "xexample" + "ab" * 6000 + long[:30]


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_viterbi_is_the_best_split():
    s = Segmenter({"the": 50, "cat": 20, "at": 30, "c": 5, "he": 9, "t": 8, "cats": 1, "a": 40})
    cost = lambda w: s.cost.get(w, math.log(s.total / 10) + math.log(10) * len(w))
    for name in ("thecat", "cathe", "atthecats", "zzcat", "q", "tttt", "cacata"):
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            parts, last = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(name[last:k])
                    last = k
            splits.append([*parts, name[last:]])
        assert sum(map(cost, s.words(name))) == pytest.approx(min(sum(map(cost, p)) for p in splits))
    assert s.tokens("www.thecat.com", "/At/12a")[-3:] == ["at", "#", "a"]
    assert s.words("") == []


def test_naive_bayes_formula():
    m = NaiveBayes({"a": (3, 1), "b": (0, 4)}, (3, 5), 2)
    ratio = lambda b, g: math.log((b + 2 * (b + g) / 8) / 5) - math.log((g + 2 * (b + g) / 8) / 7)
    assert m.log_odds(["a", "a", "b", "unknown"]) == pytest.approx(2 * ratio(3, 1) + ratio(0, 4))
    assert m.log_odds([]) == 0
    assert NaiveBayes({"once": (0, 1)}, (100, 1500)).weights["once"] < 0 < NaiveBayes({"once": (1, 0)}, (100, 1500)).weights["once"]


def test_words_beyond_the_most_frequent_count(spark):
    names = ["".join(p) + "q" for p in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 52_000)]
    path = "/".join(names)
    pages = [(1, f"http://a.example/{path}", f"<p>{' '.join(names)} oncecat oncedog</p>"), (2, f"http://b.example/{path}/2", f"<p>{' '.join(names)}</p>"),
             (3, "http://keygen.warez/", None), (4, "http://oncecatoncedog.example/", None)]
    got = judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert by[3].words[:2] == ["keygen", "warez"] and by[4].words[:2] == ["oncecat", "oncedog"]
    same_as_plain(got, {i: h for i, _, h in pages})


def test_page_words():
    assert page_words("<p class='x'>The CAT&amp;dog é naïve 12a b-c</p><") == ["the", "cat", "dog", "a", "b", "c"]
    assert page_words("a<SCRIPT>track()</script >b<style x>c</style><scripts>d<script>e") == ["a", "b", "d"]
    assert page_words("x" * 40) == ["x" * 40]
    assert page_words(None) == [] and page_words("") == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_on_the_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()}
    got = url_filter.op2_url_filter(spark, SF).collect()
    assert {(r.page_id, r.host, r.path, r.rule) for r in got} == {(i, *plain(p.url)[:3]) for i, p in pages.items()}
    whole = judged(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    same_as_plain(whole, {i: p.html for i, p in pages.items()})
    assert {r.page_id: r.verdict for r in whole} == {r.page_id: r.verdict for r in got}
