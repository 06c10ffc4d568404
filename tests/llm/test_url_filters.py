import datetime as dt

from kinweave.llm.url_filters import ENTRIES, filter_urls

D = dt.date
LIST = [
    ("a", "block", "bad.org", "add", D(2024, 1, 10)),
    ("a", "block", "bad.org", "remove", D(2024, 2, 1)),
    ("a", "block", "bad.org", "add", D(2024, 3, 1)),
    ("b", "block", "x.bad.org", "add", D(2024, 1, 1)),
    ("ok", "allow", "bad.org/good", "add", D(2024, 3, 5)),
    ("c", "block", "same.org", "add", D(2024, 1, 1)),
    ("c", "block", "same.org", "remove", D(2024, 1, 1)),
    (None, "block", "bad.org", "add", D(2020, 1, 1)),
]


def run(spark, captures, entries=LIST):
    rows = spark.createDataFrame(captures, "page_id long, url string, fetched_on date, host string")
    return {r.page_id: r for r in filter_urls(rows, spark.createDataFrame(entries, ENTRIES)).collect()}


def test_as_of(spark):
    cases = {
        1: ("http://bad.org/", D(2024, 1, 9), [], False),
        2: ("http://bad.org/", D(2024, 1, 10), ["a"], True),
        3: ("http://u@WWW.Bad.org:80/x", D(2024, 1, 31), ["a"], True),
        4: ("http://bad.org", D(2024, 2, 1), [], False),
        5: ("https://x.bad.org/good?a", D(2024, 2, 15), ["b"], True),
        6: ("https://bad.org/good/1", D(2024, 3, 5), ["a", "ok"], False),
        7: ("https://bad.org/good/1", D(2024, 3, 4), ["a"], True),
        8: ("http://same.org/", D(2024, 1, 2), [], False),
        9: (None, D(2024, 1, 2), [], False),
        10: ("nonsense", None, [], False),
        11: ("http://notbad.org/", D(2024, 4, 1), [], False),
    }
    got = run(spark, [(k, v[0], v[1], "h") for k, v in cases.items()])
    assert {k: (r.url, r.fetched_on, r["lists"], r.blocked) for k, r in got.items()} == cases
    assert got[3].host == "www.bad.org" and got[6].entry == "bad.org/good" and got[9].host == ""


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    assert not run(spark, [(1, "http://bad.org/", D(2024, 1, 10), "")], [])[1].blocked
    rows = spark.createDataFrame([(1, "http://bad.org/", D(2024, 1, 10))] * 3, "page_id long, url string, fetched_on date")
    assert [r.blocked for r in filter_urls(rows, spark.createDataFrame(LIST, ENTRIES)).collect()] == [True] * 3
