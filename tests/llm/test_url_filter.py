import random
import re

import pytest

from gridloom.llm.url_filter import filter_urls

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"), ("block", "bad.org", ""), ("allow", "ok.bad.org", "/")]


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def urls(seed, n=600):
    r = random.Random(seed)
    out = [None, "", "no scheme", "http://", "http:///en/7", "HTTP://EXAMPLE.com/en/7", "http://ÄExample.COM/en/7?x://y", "a://b://c/en/", "http://com/en/", "http://com", "http://xcom/en/", "http://example.com#/en/", "http://example.com?/en/", "http://.com/en/", "http://bad.org", "http://bad.org?q", "http://x.ok.bad.org/", "http://" + ".".join(["a"] * 60) + ".com/en/" + "z" * 5000]
    hosts = ["example.com", "www.example.com", "example.net", "m.Example.net", "com", "net.com", "b.org", "bad.org", "a.bad.org", "ok.bad.org"]
    return out + [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/en/7', '/en/77/x', '/de/8', '/de/9', '/es/1', '/EN/7'])}{r.choice(['', '?q=/en/', '#top'])}" for _ in range(n)]


@pytest.mark.parametrize("prefix_bytes", [1, 4])
@pytest.mark.parametrize("default", ["allow", "block"])
def test_equals_brute_force(spark, prefix_bytes, default):
    rows = list(enumerate(urls(prefix_bytes)))
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS _host", "'z' AS verdict")
    rules = spark.createDataFrame([*RULES, ("block", None, "/"), ("allow", "com", None), RULES[0]], "verdict string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in filter_urls(pages, rules, default=default, prefix_bytes=prefix_bytes).collect()}
    assert got == {i: judge(u, RULES, default) for i, u in rows}


def test_no_rules_no_pages_repeats_and_null_ids(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, "http://a.com/en/"), (None, None)], "page_id long, url string")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in filter_urls(pages, rules).collect()) == [(0, "allow"), (0, "block"), (1, "block"), (1, "block")]
    assert [r["verdict"] for r in filter_urls(pages, none, default="block").collect()] == ["block"] * 4
    assert filter_urls(pages.limit(0), rules).count() == 0
    plan = filter_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "Cartesian", "NestedLoop"))


def test_a_hot_url_and_pages_without_host_are_split(spark):
    """With broadcasts off, the join deals out a URL that a third of all pages have; those without host are no group."""
    rows = [(i, None if i % 3 == 0 else "http://hot.example.com/en/7" if i % 3 == 1 else f"http://h{i}.org/es/{i}") for i in range(9000)]
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
        got = filter_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(16), rules)
        assert {r["page_id"]: tuple(r)[1:] for r in got.collect()} == {i: judge(u, RULES) for i, u in rows}
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
