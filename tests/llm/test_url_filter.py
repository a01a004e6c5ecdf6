import pytest

from strandloom.llm import url_filter as u

URLS = [None, "", "no scheme/en/", "http://A.Example.NET/en/x?q#f", "http://example.net/fr/", "http://xexample.com/de/", "https://a.example.com/de/?x", "http://b.org/fr/", "http://b.org/fr", "http://c.net", "http://c.net/", "http://net/x", "x://y.org://z/fr/", "http://a.b.c.example.net/en/"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for rule, action in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, *(best or (None, "allow"))


@pytest.mark.parametrize("max_bytes", [u.MAX_FILTER_BYTES, 0])
def test_against_plain_rules(spark, frame, max_bytes):
    pages = frame([(i, x, "kept") for i, x in enumerate(URLS)] + [(0, None, "kept")], "page_id long, url string, host string")
    rules = u.rule_table(spark, ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"])
    got = u.url_filter(pages, rules, max_bytes=max_bytes).collect()
    assert len(got) == len(URLS) + 1
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"]) for r in got)


def test_both_lists_and_no_rules(spark, frame):
    pages = frame([(1, "http://a.net/x")], "page_id long, url string")
    got = u.url_filter(pages, u.rule_table(spark, ["net/"], ["net/"])).first()
    assert (got["rule"], got["verdict"]) == ("net/", "block")
    assert u.url_filter(pages, u.rule_table(spark, [], [])).first()["verdict"] == "allow"
    assert u.url_filter(frame([], "page_id long, url string"), u.rule_table(spark, ["net/"], [])).count() == 0


def test_cascade_is_exact_over_many_keys(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = u.build_cascade(keys)
    assert len(cascade.levels) > 1
    assert keys.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
