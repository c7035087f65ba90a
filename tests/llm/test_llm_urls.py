import random
import time

import corpus
import pytest
from pyspark.sql import functions as F

from tenderflow.llm import urls
from tenderflow.llm.queries import URL_RULES

RULES = "host string, path string, action string"
URL_SCHEMA = "page_id long, url string, rule string, host string, key string, n int"


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end].translate(corpus.FOLD), rest[end:]
        path = rest[:min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [
        (len(h + p), a == "block", h + p, a) for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def some_urls(rng, n):
    hosts = ["com", "example.com", "WWW.example.com", "a.b.example.net", "net", "x.org", "", ".com",
             "notexample.com", "é.net", "org:80", "a..net"]
    paths = ["", "/", "/en", "/en/", "/en/x?y=/fr/", "/fr/1#/es/", "/es/2", "?q=/en/", "#/en/", "//en/"]
    odd = [None, "", "no url", "http:/one.com/", "://", "a://b://c.com/en/", "http://exa\nmple.com/en/"]
    return odd + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(n)]


@pytest.mark.parametrize("most_bytes", [urls.MOST_BYTES, 0])
def test_contract_rules(spark, most_bytes):
    found = some_urls(random.Random(1), 300)
    rows = [(i, u, "x", "x", "x", 1) for i, u in enumerate(found)]
    frame = spark.createDataFrame(rows, URL_SCHEMA)
    judged = urls.judge(frame, spark.createDataFrame(URL_RULES, RULES), most_bytes=most_bytes)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(found)}
    assert judged.columns == ["page_id", "url", "host", "key", "n", "path", "rule", "verdict"]


def test_long_lists_need_more_levels_and_stay_exact(spark):
    rng = random.Random(3)
    rules = [(f"h{i}.com", "/", rng.choice(["allow", "block"])) for i in range(0, 6000, 3)]
    rules += [("h3.com", "/", "block"), ("h3.com", "/", "allow"), (None, "/", "block"),
              ("h6.com", None, "block")]
    frame = spark.range(12_000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".com/")).alias("url")
    )
    listed = spark.createDataFrame(rules, RULES)
    universe = frame.select(F.concat(F.lit("h"), "page_id", F.lit(".com/")).alias("key"))
    keys = listed.select(F.concat("host", "path").alias("key")).distinct()
    assert len(urls.build_cascade("test", keys, universe).filters) >= 2
    known = [r for r in rules if None not in r]
    for row in urls.judge(frame, listed).collect():
        assert (row.rule, row.verdict) == plain(row.url, known)[2:]


@pytest.mark.parametrize("most_bytes", [urls.MOST_BYTES, 0])
def test_long_hosts_and_paths(spark, most_bytes):
    """A megabyte of labels is judged like a short host."""
    long = "a." * 500_000
    found = [f"http://{long}net/es/1", f"http://{long}www.example.com/en/{'x/' * 500_000}",
             f"http://{long}org/es/", "http://" + "b" * 1_000_000, f"http://{long}", "http://net/fr/"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id long, url string")
    started = time.time()
    judged = urls.judge(frame, spark.createDataFrame(URL_RULES, RULES), most_bytes=most_bytes)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert time.time() - started < 60
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(found)}


def test_no_rows_no_rules(spark):
    rules = spark.createDataFrame(URL_RULES, RULES)
    assert urls.judge(corpus.empty(spark, URL_SCHEMA), rules).count() == 0
    frame = spark.createDataFrame([(1, "http://a.com/", "", "", "", 1)], URL_SCHEMA)
    row = urls.judge(frame, corpus.empty(spark, RULES), "block").first()
    assert (row.host, row.path, row.rule, row.verdict) == ("a.com", "/", None, "block")
