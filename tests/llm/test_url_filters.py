import random

from lexweave.llm import queries, url_filters
from lexweave.llm import url_filters as U

URLS = [
    (1, "http://a.example.net/en/1"), (2, "HTTPS://Example.NET/en/"), (3, "https://example.net"), (4, "https://x.net/?q"), (5, "http://www.example.com/de/9#x"),
    (6, "http://m.example.org/fr/2?x=/"), (7, None), (8, "no scheme"), (9, "http://notexample.com/de/"), (10, "http://www.cheap-pills.example.com/en/4"), (10, "http://www.cheap-pills.example.com/en/4"),
    (None, "ftp://net/"), (11, "http://org/fr"), (12, "a://b://c.net/x"), (13, ""), (14, "http:///en/"), (15, "http://" + "a." * 500 + "net/" + "p" * 5000),
]


def plain(url, rules, blocked):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("#")[0].split("?")[0]

    def fits(entry):
        h, _, p = entry.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

    best = max((r for r in rules if fits(r[0])), key=lambda r: len(r[0]), default=None)
    listed = any(map(fits, blocked))
    return host, path, best and best[0], best[1] if best else "block" if listed else "allow", listed


def test_against_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in URLS], "page_id long, url string, rule string, entry int")
    listed = url_filters.listing(spark, queries.URL_RULES, queries.BLOCKED_URLS)
    got = sorted(map(tuple, url_filters.judge(pages, listed).collect()), key=repr)
    assert got == sorted(((i, *plain(u, queries.URL_RULES, queries.BLOCKED_URLS)) for i, u in URLS), key=repr)


def test_many_rules(spark):
    r = random.Random(1)
    rules = [(f"h{r.randrange(40)}.net/{'x' * r.randrange(4)}", r.choice(["allow", "block"])) for _ in range(60)]
    rules = list(dict(rules).items())
    urls = [(i, f"http://w.h{r.randrange(60)}.net/{'x' * r.randrange(6)}") for i in range(300)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = sorted(map(tuple, url_filters.judge(pages, url_filters.listing(spark, rules, ["h1.net/"])).collect()))
    assert got == sorted((i, *plain(u, rules, ["h1.net/"])) for i, u in urls)


def test_filter_never_loses_a_key(spark):
    listed = spark.range(2000).selectExpr("concat('k', id) AS entry")
    passed = url_filters.possible_hits(spark.range(20000).selectExpr("concat('k', id) AS entry"), "entry", listed, 2000)
    assert passed.join(listed, "entry").count() == 2000
    assert passed.count() < 2000 + 18000 * 0.02


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(none, url_filters.listing(spark, queries.URL_RULES, [])).count() == 0
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r.verdict for r in url_filters.judge(pages, spark.createDataFrame([], "entry string, action string, is_rule boolean")).collect()} == {"allow"}


def test_the_order_of_the_list_does_not_matter(spark):
    pages = spark.createDataFrame([(1, "http://x.A.B.net/xx/1"), (2, "http://b.net/xx/1"), (3, "http://a.b.net/x"), (None, None)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS `key`", "3 AS _keep")
    rules = [("b.net/xx/", "allow"), ("A.b.Net/x", "block"), ("b.net/xx/", "block"), ("net/", "allow")]
    want = {1: ("A.b.Net/x", "block"), 2: ("b.net/xx/", "block"), 3: ("A.b.Net/x", "block"), None: (None, "allow")}
    for own in (rules, rules[::-1]):
        got = U.judge(pages, U.listing(spark, own, ["B.NET/xx/"]))
        assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want
    assert U.judge(pages, U.listing(spark, rules, []).where("false")).where("verdict = 'allow' AND rule IS NULL").count() == 4


def test_many_path_lengths(spark):
    import random

    r = random.Random(2)
    names = ["a.org", "b.a.org", "c.net", "net"]
    listed = [(f"{r.choice(names)}/{'x' * r.randrange(60)}", r.choice(["allow", "block"])) for _ in range(200)]
    pages = [(i, f"http://{r.choice(['', 'w.', 'v.w.'])}{r.choice(names)}/{'x' * r.randrange(60)}") for i in range(300)]
    got = {p.page_id: (p.rule, p.verdict) for p in U.judge(spark.createDataFrame(pages, "page_id long, url string"), U.listing(spark, listed, [])).collect()}
    for i, url in pages:
        host, path = url[7:].split("/", 1)
        fits = [(len(e), len(e.split("/")[0]), a == "block", e, a) for e, a in listed if (host == e.split("/")[0] or host.endswith("." + e.split("/")[0])) and ("/" + path).startswith("/" + e.split("/", 1)[1])]
        best = max(fits, default=None)
        assert got[i] == ((best[3], best[4]) if best else (None, "allow"))
