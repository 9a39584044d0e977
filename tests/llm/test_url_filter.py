"""URL verdicts against a plain version, on odd addresses and with an overfull filter."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from muster.llm import queries, url_filter
from muster.llm.common import table
from oracle_check import compare, connect

ODD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/", "http://a.net/x", "http://anet/x", "http://xexample.net/en/1",
    "http://example.net/en/1", "http://example.net/EN/1", "http://A.Example.net/en/", "http://a.example.net/en", "http://b.org/fr/?ref=1", "http://b.org/fr",
    "http://b.org?x://c.net/", "http://b.org#/fr/", "https://www.c.org/p/index.html?b=2&utm_source=x&a=1#t", "http://c.org/p?a=1&b=2", "http://m.c.org:443/p/?a=1&b=2&",
    "http://c.org/p?a=1", "http://c.org/p.html?refx=1", "http://c.org/p?ref", "x://y://z.net/", "http://ünet.org/ä?gclid=é", "http://ünet.org/ä#q",
    "http://long.org/" + "a/" * 20_000, "http://long.org/" + "a/" * 20_000 + "?fbclid=1", "http://c.org/p?a=1&b=2", "http://a\nb.org/x\ny?ref=2", "http://a\nb.org/x\ny",
]


def parts(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def asked(url):
    m = re.match(r"[^?#]*\?([^#]*)", url or "")
    return [p for p in (m[1] if m else "").split("&") if p]


def plain_canonical(url):
    host, path = parts(url)
    if not host:
        return None
    kept = sorted(p for p in asked(url) if not re.match(url_filter.TRACKING, p))
    site = re.sub(r"^(www|m)\.", "", re.sub(r":(80|443)\Z", "", host))
    page = re.sub(r"/\Z", "", re.sub(r"(/index)?\.html\Z", "", path))
    return site + page + ("?" + "&".join(kept) if kept else "")


def plain(urls, rules, listed):
    keys = {plain_canonical(u) for u in listed} - {None}
    for url in urls:
        host, path = parts(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
        verdict = best.action if best else "block" if plain_canonical(url) in keys else "allow"
        yield host, path, best.host + best.path if best else None, verdict


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i % 5 == 0 else i // 2, u, "k", "x", "x") for i, u in enumerate(ODD)]
    return spark.createDataFrame(rows, "page_id long, url string, key string, block string, x string").repartition(3)


def check(pages, rules, listed):
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules, listed).collect()]
    urls, given = [r.url for r in pages.collect()], [r.url for r in listed.collect()]
    want = [(u, *rest) for u, rest in zip(urls, plain(urls, rules, given))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_verdicts_equal_a_plain_version(spark, folder, odd):
    pages = table(spark, folder, "pages")
    check(pages.select("page_id", "url"), queries.URL_RULES, pages.where(url_filter.tracked(F.col("url"))))
    check(odd, queries.URL_RULES, odd.where(url_filter.tracked(F.col("url"))))
    # Rules of equal length: the longer host; and rules without a path.
    check(odd, [url_filter.Rule("block", "net", "/en/"), url_filter.Rule("allow", "example.net", ""), url_filter.Rule("allow", "c.org", "")], odd)


def test_tracked_equals_its_plain_version(odd):
    want = {(u, any(re.match(url_filter.TRACKING, p) for p in asked(u))) for u in ODD}
    assert {(r.url, r.t) for r in odd.select("url", url_filter.tracked(F.col("url")).alias("t")).collect()} == want


def test_columns_stay_and_empty_tables(spark, odd):
    got = url_filter.judge(odd.withColumn("host", F.lit(1)), [], odd.limit(0))
    assert got.columns == ["page_id", "url", "key", "block", "x", "host", "path", "rule", "verdict"]
    assert {(r.key, r.block, r.x, r.rule, r.verdict) for r in got.collect()} == {("k", "x", "x", None, "allow")}
    assert url_filter.judge(odd.limit(0), queries.URL_RULES, odd).count() == 0


def test_an_overfull_filter_lets_more_pass_and_blocks_the_same(spark, monkeypatch):
    listed = spark.range(5000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    pages = spark.range(4000, 9000).select(F.concat(F.lit("https://www.h.org/"), "id", F.lit("?ref=1")).alias("url"))
    blocked = lambda: {r.path for r in url_filter.judge(pages, [], listed).where("verdict = 'block'").collect()}
    want = {f"/{i}" for i in range(4000, 5000)}
    assert blocked() == want
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    assert blocked() == want


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    lanes, blocks = url_filter.bloom(keys, "key", 20_000)
    asked_for = spark.range(40_000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    hit = F.lit(True)
    for i, b in enumerate(url_filter._bits(F.col("key"))):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(b) != 0)
    met = asked_for.join(lanes, url_filter._block(F.col("key"), blocks) == F.col("block")).where(hit)
    true, false = met.where("id < 20000").count(), met.where("id >= 20000").count()
    assert true == 20_000 and false < 400


def test_query_equals_its_sql(spark, folder):
    got = queries.QUERIES["op12_url_bloom"](spark, folder).toArrow()
    assert compare(got, connect(folder).sql(queries.SQL["op12_url_bloom"]).to_arrow_table()) is None
