"""URL verdicts against SQL, rule by rule."""

import pytest

from tarnwright.llm import url_filter
from tarnwright.llm.queries import op7_urlfilter

from .conftest import DATA


def test_whole_table_equals_sql(spark, tables, same):
    same(op7_urlfilter(spark, DATA), tables.sql(url_filter.oracle_sql()))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("http://NET/x?y#z", "net", "/x", "net/", "block"),
        ("http://planet/x", "planet", "/x", None, "allow"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://m.example.net/en/1", "m.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://myexample.net/en/1", "myexample.net", "/en/1", "net/", "block"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://example.com/fr/casino", "example.com", "/fr/casino", None, "block"),
        ("http://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"),
        ("https://CASINO88.com/?net", "casino88.com", "/", None, "block"),
        ("https://casinos.com/", "casinos.com", "/", None, "allow"),
        ("https://cheap.com/pills", "cheap.com", "/pills", None, "block"),
        ("https://cheap.com/cheap-cheap", "cheap.com", "/cheap-cheap", None, "allow"),
        ("https://free.com?bets", "free.com", "", None, "allow"),
        ("a://b://casino/x", "b:", "//casino/x", None, "block"),
        ("no scheme casino", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://" + "a" * 100_000 + "/x", "a" * 100_000, "/x", None, "allow"),
    ],
)
def test_one(spark, url, host, path, rule, verdict):
    row = url_filter.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_empty_table_and_repeats(spark):
    frame = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert url_filter.judge(frame).count() == 3 and url_filter.judge(frame.limit(0)).count() == 0
