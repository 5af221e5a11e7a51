import pytest
from pyspark.sql import functions as F

from billweave.llm import url_filter as u

RULES = [u.Rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                              ("allow", "com/fr/"), ("block", "com/de/"), ("block", "net/*/ads"))]
URLS = {
    "https://www.Example.ORG/es/1": "example.org/es/", "http://example.org/en/12?x": "example.org/en/1",
    "http://example.org/en/2": "org/", "http://notexample.org/es/": "org/", "http://org/": "org/",
    "http://organ/": None, "http://a.com/fr": None, "http://a.com/fr/#x": "com/fr/", "http://a.com/FR/": None,
    "http://b.com/de/x": "com/de/", "http://b.com:80/de/x": None, "ftp://b.com?/de/": None, "no scheme": None,
    "": None, None: None, "a://x.net/y/ads": "net/*/ads", "a://x.net/ads": None, "a://b://c.org/": None,
    "http://x\ny.org/\n": "org/", "http://org": None, "http://ex.org/" + "a/" * 20_000: "org/",
}


def test_every_url_against_all_rules(spark):
    rows = [(i, url, "mine") for i, url in enumerate([*URLS, *URLS])]
    pages = spark.createDataFrame(rows, "page_id int, url string, rule string")
    got = u.judge(pages, RULES).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.rule == URLS[row.url], row.url
        host, path = u.split_url(row.url)
        assert (row.host, row.path) == (host, path)
        fits = [r for r in RULES if "*" not in r.text and (host == r.host or host.endswith("." + r.host))
                and path.startswith(r.path)]
        if row.rule is None or "*" not in row.rule:
            best = max(fits, key=lambda r: len(r.text), default=None)
            assert row.rule == (best and best.text)
        assert row.verdict == {r.text: r.verdict for r in RULES}.get(row.rule, "allow")


def test_rules_are_indexed_by_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://a.com/de/",), ("http://b.com/fr/",), ("http://c.com/fr/",)], "url string")
    counts = u.token_counts(pages, RULES)
    assert counts["com"] == 3 and counts["fr"] == 2 and counts["de"] == 1
    index = u.rarest_index(RULES, counts)
    assert [r.text for r in index["fr"]] == ["com/fr/"] and [r.text for r in index["de"]] == ["com/de/"]
    assert u.Rule("block", "example.org/en/1").tokens() == {"example", "org", "en"}


def test_native_parts_agree_and_empty_table(spark):
    pages = spark.createDataFrame([(url,) for url in URLS], "url string")
    for row in pages.select("url", u.host_of(F.col("url")).alias("h"), u.path_of(F.col("url")).alias("p")).collect():
        assert (row.h, row.p) == u.split_url(row.url)
    assert u.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in u.judge(pages, [], default="block").collect()} == {"block"}


def test_ties_go_to_the_longer_host_then_to_the_text(spark):
    pages = spark.createDataFrame([("http://ab.org/x",)], "url string")
    rules = [u.Rule("allow", "org/x"), u.Rule("block", "ab.org/")]
    assert u.judge(pages, rules).first().rule == "ab.org/"
    same = [u.Rule("allow", "org/x"), u.Rule("block", "org/x")]
    assert u.judge(pages, same).first().verdict == "block"
    with pytest.raises(ValueError, match="more than"):
        u.judge(pages, [u.Rule("allow", "org/")] * (u.MAX_RULES + 1))
