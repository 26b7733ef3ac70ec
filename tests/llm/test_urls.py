from lodestar.llm.queries import URL_RULES
from lodestar.llm.urls import judged

CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme casino", "", "", None, "block"),
    ("http://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/casino", "a.example.com", "/en/casino", "example.com/en/", "block"),
    ("http://a.example.com/EN/", "a.example.com", "/EN/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://casino.com", "casino.com", "", None, "block"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/esx", "x.net", "/esx", None, "allow"),
    ("x://Free.org?free&FREE#bets", "free.org", "", None, "block"),
    ("x://free.org?free&FREE#betsy", "free.org", "", None, "allow"),
    ("x://essex.org/adults/freebets/a_b", "essex.org", "/adults/freebets/a_b", None, "allow"),
    ("x://a/b\nc://adult", "a", "/b\nc://adult", None, "block"),
    ("x://a.org/" + "y" * 100_000 + "-porn", "a.org", "/" + "y" * 100_000 + "-porn", None, "block"),
    ("x://éadult.org/", "éadult.org", "/", None, "allow"),
]


def test_cases(spark):
    pages = spark.createDataFrame([(c[0], i, "mine") for i, c in enumerate(CASES)], "url string, page_id int, host string")
    got = {r["row"]["page_id"]: r for r in judged(pages, URL_RULES).collect()}
    for i, (_, *wanted) in enumerate(CASES):
        assert [got[i][n] for n in ("host", "path", "rule", "verdict")] == wanted, CASES[i][0]
        assert got[i]["row"]["host"] == "mine"


def test_empty(spark):
    assert judged(spark.createDataFrame([], "url string, page_id int"), URL_RULES).count() == 0
