import duckdb

from ledgerloom.llm import queries, url_filters


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir.replace('0.001', '0.1')}/pages.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op3_url_filters"]).fetchall(), key=str)
    got = sorted(map(tuple, queries.op3_url_filters(spark, sf_dir.replace("0.001", "0.1")).collect()), key=str)
    assert got == want


def test_odd_urls(spark):
    urls = {
        None: ("", "", None, "allow"), "no scheme net/": ("", "", None, "allow"), "a://NET/x": ("net", "/x", "net/", "block"), "a://b.net": ("b.net", "", None, "allow"),
        "a://Example.NET/en/1?q": ("example.net", "/en/1", "example.net/en/", "allow"), "a://xexample.net/en/": ("xexample.net", "/en/", "net/", "block"),
        "a://example.com/DE/": ("example.com", "/DE/", None, "allow"), "a://w.example.com/de/#f": ("w.example.com", "/de/", "example.com/de/", "block"),
        "a://q.org/fr/": ("q.org", "/fr/", "org/fr/", "allow"), "a://ads-track.q.org/x": ("ads-track.q.org", "/x", None, "block"), "a://x?y://net/": ("x", "", None, "allow"),
        "a://x.com/y.net\x00/z": ("x.com", "/y.net\x00/z", None, "allow"), "a://b\x00.net/z": ("b\x00.net", "/z", "net/", "block"), "a://x\n.net/": ("x\n.net", "/", "net/", "block"), "a://x.com/a.ads-b.c/d": ("x.com", "/a.ads-b.c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    rows = url_filters.judge(pages).select("url", "judged.*").collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert tuple(r)[1:] == urls[r.url], r
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_tracking_words_fetch_their_rules(spark):
    urls = ["http://tracker.a.com/", "http://x.tracking.b.org/", "http://track.a.com/x", "http://A.Tracker-x.com", "http://my_tracker.a.com/", "http://tracked.a.com/", "http://trackers.a.com/", "http://a.com/tracker/", "http://\u00e9tracking.a.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [tuple(r) for r in url_filters.judge(pages).select("page_id", "judged.*").orderBy("page_id").collect()]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op3_url_filters"]).fetchall())
    assert [r[4] for r in got] == ["block"] * 4 + ["allow"] * 4 + ["block"]


def test_filter_list_rules(spark):
    lines = ["! comment", "||ads.example.org^", "@@||ads.example.org/ok/", "/banner/*/img^", "|good.com/x|", "##.ad", "*track*", "||a.b^$third-party", "/re[gx]/", "||stat.net^*/pixel."]
    rules = [url_filters.list_rule(x) for x in lines]
    assert [r is None for r in rules] == [True, False, False, False, False, True, True, True, True, False]
    urls = {
        "http://ads.example.org/": "block", "http://x.ADS.example.org:80/a": "block", "http://ads.example.org": "block", "http://xads.example.org/": "allow", "http://ads.example.org/ok/1": "allow", "http://ads.example.organ/": "allow",
        "http://q.com/banner/7/img?x": "block", "http://q.com/Banner/7/IMG/1": "block", "http://q.com/banner/img": "allow", "http://q.com/banner/7/imgs": "allow", "http://good.com/x": "block", "http://good.com/xy": "allow", "http://a.good.com/x": "allow",
        "http://w.stat.net/a/pixel.gif": "block", "http://w.stat.net/a/pixels.gif": "allow",
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.url: r.verdict for r in url_filters.judge(pages, tuple(r for r in rules if r)).select("url", "judged.verdict").collect()}
    assert got == urls


def test_many_list_rules_equal_every_rule_tried(spark):
    """A few hundred list rules and host rules: the index gives what trying each rule on each URL gives."""
    import random
    import re

    rnd = random.Random(11)
    words = ["ad", "ads", "pix", "net", "cdn", "img", "a1", "shop", "news"]
    host = lambda: ".".join(rnd.choices(words, k=rnd.randint(1, 3)))
    path = lambda: "/" + "/".join(rnd.choices(words, k=rnd.randint(0, 3)))
    lines = [rnd.choice(["||{h}^", "||{h}{p}/", "@@||{h}^", "|{h}{p}|", "*{p}/*", "/{p}^*{p}", "{h}^"]).format(h=host(), p=path()) for _ in range(300)]
    rules = tuple({r.text: r for r in map(url_filters.list_rule, lines) if r}.values()) + url_filters.HOST_RULES
    assert len(rules) > 150
    urls = [f"http://{host()}{path()}{rnd.choice(['', '/', '?q=1', '#net/'])}" for _ in range(400)]

    def tried(url):
        h, p = url_filters.parse(url)
        fit = [r for r in rules if re.fullmatch(r.pattern + ("" if r.label is None else ".*"), f"{h}?{p}", re.S)]
        best = min(fit, key=lambda r: (r.label is None, r.first, -len(r.text), r.text), default=None)
        return (best.label, best.verdict) if best else (None, "allow")

    rows = url_filters.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).select("url", "judged.*").collect()
    assert {r.verdict for r in rows} == {"allow", "block"}
    for r in rows:
        assert (r.rule, r.verdict) == tried(r.url), r.url
