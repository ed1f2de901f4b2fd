import pytest

from tallyweave.llm import url_filters as u

CASES = {
    "http://EXAMPLE.org/es/1": ("block", "example.org/es/"),
    "http://a.b.example.org/en/12?x=1": ("block", "example.org/en/1"),
    "http://example.org/en/2": ("allow", "org/"),
    "https://example.org": ("allow", None),
    "https://notexample.org/es/": ("allow", "org/"),
    "http://shop.example.com/de/casino-win": ("block", "com/de/"),
    "http://shop.example.com/fr/casino-win": ("allow", "com/fr/"),
    "http://shop.example.net/casino-win#top": ("block", None),
    "http://shop.example.net/casino-winner": ("allow", None),
    "no address": ("allow", None),
    "": ("allow", None),
    None: ("allow", None),
    "x://comm/fr/": ("allow", None),
}


def test_cases_nulls_and_repeated_rows(spark):
    rows = [(k, url, "kept", "u") for k, url in enumerate([*CASES, *CASES])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, u string").repartition(3)
    got = u.judge_urls(pages, u.default_rules()).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row["verdict"], row["rule"]) == CASES[row["url"]], row
    by_url = {r["url"]: r for r in got}
    assert by_url["http://EXAMPLE.org/es/1"]["host"] == "example.org"
    assert by_url["http://a.b.example.org/en/12?x=1"]["path"] == "/en/12"
    assert (by_url[None]["host"], by_url[None]["path"]) == ("", "")
    assert by_url["http://shop.example.net/casino-win#top"]["pattern"] == "casino-win"


def test_empty_table_and_rule_without_words(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(empty, u.default_rules()).count() == 0
    every = u.UrlRule("all", "block", "^[^/]*/_", (), False)
    pages = spark.createDataFrame([(1, "http://a.b/_x"), (2, "http://a.b/x")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in u.judge_urls(pages, [every]).collect()}
    assert got == {1: "block", 2: "allow"}


@pytest.mark.parametrize("rule,words", [
    ("example.org/en/1", ("example", "org", "en")), ("com/fr/", ("com", "fr")), ("org/", ("org",))])
def test_literal_words_are_whole(rule, words):
    assert u.host_rule(rule, "allow").tokens == words
