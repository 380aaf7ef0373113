from lexweave.llm import html_extraction as H

SCHEMA = "page_id long, url string, html string"


def page(*blocks, furniture=("Home About", "All content here is free")):
    return f"<html><body><div>{furniture[0]}</div>" + "".join(f"<p>{b}</p>" for b in blocks) + f"<div>{furniture[1]}</div></body></html>"


def test_markup():
    html = """<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>a<li>b</ul></nav>
      <div id="sidebar">s</div><div class="cookie-notice">c</div><form>f</form><article><header><h1>Title &amp; more</h1></header><p><b>One &lt;two&gt;<br><p>Three\n  four&nbsp;five
      <script>var t="</p>";</script><!-- no --><div class="ad">buy</div><section class="comments"><article class="comment"><p>reader</p></article></section></article><footer>f</footer>"""
    assert H.main_text(H.page_lines(html), []) == ("Title & more\nOne <two>\nThree four five", 9)


def test_broken_markup():
    for html in ("<", "<p", "<p class='x", "a < b", "<script>x", "<!-- x", "</p></div>x", "<b>" * 20_000 + "deep", "<div a=\"'>x</div>", ""):
        H.page_lines(html)
    assert H.page_lines("a < b &amp c") == [("a < b & c", False, False)]


def test_furniture_below_many_open_elements():
    deep = "<b>" * 20_000
    assert H.page_lines(f"{deep}<nav>menu</nav><div class='ad'>buy</div>text<article>own</article>") == [("menu", False, True), ("buy", False, True), ("text", False, False), ("own", True, False)]
    assert H.page_lines("<ul><li>" + "<i>" * 20_000 + "<ul>" + "<li>x</li>" * 20_000)[:2] == [("x", False, False)] * 2


def test_differencing(spark):
    rows = [(i, f"http://h.org/a/{i}", page(f"Text of page {i} alone.", f"More of {i}.")) for i in range(6)]
    rows += [(50, "http://other.org/a/1", page("Lonely page.")), (60, None, page("No url.")), (61, "http://h.org/a/9", None), (62, "", "")]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", _gone string")).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i].text == f"Text of page {i} alone.\nMore of {i}." and got[i].n_deleted == 2
    assert got[50].text.startswith("Home About") and got[60].text.startswith("Home About")
    assert got[61].text == got[62].text == "" and got[61].n_chars == 0


def test_copies_and_articles_stay_whole(spark):
    article = "<html><body><div>Menu line</div><article><p>Same line</p><p>Own {0}</p></article></body></html>"
    copy = page("A", "B", "C", "D", "E", "F", "G", "H")
    rows = [(1, "http://h/1", article.format(1)), (2, "http://h/2", article.format(2)), (3, "http://k/1", copy), (4, "http://k/2", copy), (4, "http://k/2", copy)]
    got = sorted((r.page_id, r.text) for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[:2] == [(1, "Same line\nOwn 1"), (2, "Same line\nOwn 2")]
    assert all("A\nB" in t and "Home" in t for _, t in got[2:]) and len(got) == 5


def test_text_beside_an_article_stays(spark):
    card = "<html><body><div>Menu line</div><article>Teaser {0}</article><div><p>The text {0}.</p><p>More of {0}.</p></div><div>Imprint</div></body></html>"
    rows = [(i, f"http://h/{i}", card.format(i)) for i in range(3)]
    for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.text, r.n_deleted) == (f"Teaser {r.page_id}\nThe text {r.page_id}.\nMore of {r.page_id}.", 2)


def test_long_templates_go(spark):
    furniture = ["\n".join(f"<div>Menu {i}</div>" for i in range(10)), "\n".join(f"<div>Foot {i}</div>" for i in range(10))]
    rows = [(i, f"http://h/{i}", page(*[f"Text {i} {k}" for k in range(4)], furniture=furniture)) for i in range(5)]
    for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.text, r.n_deleted) == ("\n".join(f"Text {r.page_id} {k}" for k in range(4)), 20)


def test_runs_of_copies_meet_the_pages_around_them(spark):
    rows = [(i, f"http://h/{i:03}", page("First page alone." if i == 0 else "Last page alone." if i == 60 else "The copied text.", "More." if i == 0 else f"Copy {i // 30}.")) for i in range(61)]
    for r in H.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        assert r.n_deleted >= 2 and "Home" not in r.text and "free" not in r.text, r
        assert r.text.endswith("More." if r.page_id == 0 else f"Copy {r.page_id // 30}."), r


def test_numbers_of_runs(spark):
    lines = [[0], [1], [1], [1], [1], [1], [2], [2], [1], [3], [3], [3], [3], [3], [3], [3]]
    rows = [(i, "g" if i == 15 else "h", bytes(x)) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "_id long, _host string, _digest binary")
    got = sorted(H.numbered_runs(df, ["_id"], "test-runs").collect(), key=lambda r: r._id)
    assert [r._rank for r in got] == [0, 1, 1, 1, 1, 1, 2, 2, 3, 4, 4, 4, 4, 4, 4, 5]
    assert [r._id for r in got if r._first] == [0, 1, 6, 8, 9, 15]


def plain_subsequence(a, b):
    """Length of the longest common subsequence, by the table."""
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, best[j] = best[j], before + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def plain_extract(rows):
    """Every page with every other page of its host, without Spark."""
    import re

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        return host.lower(), path

    own = sorted((*parts(u), u, i, h) for i, u, h in set(rows) if h is not None and parts(u)[0])
    lines = {r: H.page_lines(r[4]) for r in own}
    content = {r: [t for t, _, named in lines[r] if not named] for r in own}
    moving = {r: [x[0] for x in lines[r] if H.can_go(x)] for r in own}
    out = {}
    for k, r in enumerate(own):
        gone = set()
        for side in (own[:k][::-1], own[k + 1 :]):
            other = next((o for o in side if o[0] != r[0] or content[o] != content[r]), None)
            if other and other[0] == r[0]:
                # of a run of copies, the first page stands for all
                other = next(o for o in own if o[0] == other[0] and content[o] == content[other] and all(content[x] == content[other] for x in own[own.index(o) : own.index(other)]))
                found = H.shared_lines(moving[r], moving[other])
                assert len(found) == plain_subsequence(moving[r], moving[other])
                gone |= set(found)
        out[r[3], r[2], r[4]] = H.main_text(lines[r], sorted(gone))[0]
    return out


def test_against_every_pair(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(80):
        blocks = [f"<p>{r.choice(['shared', 'often', 'seldom %d' % r.randrange(9), 'own %d' % i])} {r.randrange(3)}</p>" for _ in range(r.randrange(0, 6))]
        ad = f"<div class='ad'>buy {r.randrange(4)}</div>"
        body = "".join(blocks) if r.random() < 0.7 else f"<article>{''.join(blocks)}</article>"
        rows.append((i, f"http://{r.choice('ab')}.org/{r.randrange(40)}?q={i}", f"<div>Home</div>{ad}{body}<div>Foot {r.randrange(3)}</div>"))
    rows += [(100 + i, f"http://a.org/20?c={i}", "<div>Home</div><p>copied text</p><div>Foot 1</div>" + (f"<div class='ad'>{i}</div>" if i % 2 else "")) for i in range(9)]
    want = plain_extract(rows)
    got = H.extract(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    html = {i: h for i, _, h in rows}
    assert {(x.page_id, x.url, html[x.page_id]): x.text for x in got} == want


def test_differencing_decides_on_the_tables_without_names(spark, tiny):
    """With the names of its furniture gone from the markup, a page whose neighbour has the same menu loses it by differencing alone."""
    import re

    rows = [(r.page_id, r.url, re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", r.html.replace(' class="ad"', ""))) for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()]
    rows += [(1000 + i, f"{u.split('#')[0].split('?')[0]}/next", re.sub(r"<article>.*</article>", f"<article><p>Another text {i}.</p></article>", h, flags=re.DOTALL)) for i, u, h in rows]
    inside = {i: "\n".join(t for t, own, _ in H.page_lines(h) if own) for i, _, h in rows}
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    right = [r for r in got if r.text == inside[r.page_id] and r.n_deleted > 2]
    assert len(right) >= 0.9 * len(got) and not any(r.n_markup for r in got), (len(right), len(got))  # in URL order another page may stand between the two
    off = {i: H.main_text(H.page_lines(h), [])[0] for i, _, h in rows}
    assert all(off[r.page_id] != r.text for r in right)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://h/1", page("A."), 7)] * 2, SCHEMA + ", _id int").selectExpr("*", "1 AS _th", "2 AS _html", "3 AS _gone", "4 AS text", "5 AS `a.b`")
    assert [(r.page_id, r.n_deleted) for r in H.extract(df).collect()] == [(1, 0)] * 2


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_articles_of_the_tables(spark, tiny):
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in H.extract(spark.read.parquet(f"{tiny}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*)</article>", rows[r.page_id], re.DOTALL)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_a_name_says_furniture_only_as_a_whole():
    page = "<body><article><p class='notice-of-appeal'>Appeal text</p><ul class='menu'><li>Soup</li></ul><p class='without-ads'>Free</p><div class='cookie-notice'>Cookies</div><div class='reader-comments'>Nice</div><p id='ad-2'>Buy</p></article></body>"
    assert H.main_text(H.page_lines(page), [])[0] == "Appeal text\nSoup\nFree"
