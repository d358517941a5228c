import re

from tidemark.llm import url_filters as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute(url):
    host, path = parts(url)
    best = None
    for action, rule in U.SITE_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    if best:
        return host, path, best[1], best[0]
    bad = set(re.split("[^a-z0-9]+", host)) & set(U.HOST_WORDS)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), path)
    within = lambda text, phrases, gap: any(re.search(f"(?<![a-z0-9]){gap.join(p)}(?![a-z0-9])", text) for p in phrases)
    return host, path, None, "block" if bad or within(host, U.HOST_PHRASES, "[._-]") or within(low, U.PATH_PHRASES, "[^a-z0-9]+") else "allow"


URLS = [None, "", "no scheme.com/x", "http://", "://", "x://com/", "http://COM/a", "http://a.COM/en/", "http://example.com/en/x", "https://www.example.com/en/1", "http://xwww.example.com/en/", "http://wwwexample.com/en/",
        "http://a.net/es/", "http://a.net/ES/", "http://net/fr/?q", "http://net?x://com/", "http://a.b.net/fr", "http://spam-farm.example.org/en/", "http://casino.example.net/de/1", "http://myspamfarm.org/", "http://a.com#/en/",
        "http://a.com?/en/", "http://é.com/en/", "http://www.example.com", "http://example.com/en", "ftp://ads.x.org:80/p", "a://b://com/", "http://a\nb.com/\n", "http://ads.a\nb.org/\nx", "http://x.org/ads/casino",
        # A Kelvin sign, and an I with a dot, are no ASCII letters, whatever case folding says.
        "http://spam\u212a.org/", "http://a.ads\u0130.org/", "http://\u212apills.org/x", "http://x.org/buy\u212apills", "http://x.org/Buy-PILLS/1", "http://x.org/a/online_casino", "http://x.org/onlinecasino", "http://x.org/work/from/home/cash.html",
        "http://x.org/work/from/cash", "http://win-prize.org/", "http://win.x.prize.org/", "http://x.org/a\nfree  porn", "http://x.org/" + "a-" * 100_000 + "buy-pills", "http://buy.org/pills", "http://x.org/?buy-pills"]


def test_matches_brute_force_on_both_paths(spark):
    rows = [(k, u) for k, u in enumerate(URLS + URLS[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted((k, *brute(u)) for k, u in rows)
    key = lambda t: (t[0], str(t))
    for inline in (U.MAX_INLINE, 0):
        got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages, max_inline=inline).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_only_candidates_are_indexed_by_their_rarest_token():
    rules = U.ranked([U.site_rule("block", "example.com/en/"), U.site_rule("allow", "com/")])
    assert U.index_of(rules, {"com": 9, "example": 5, "en": 7}) == {"example": [0], "com": [1]}


def test_clashing_columns_empty_table_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://spam.com/", "h", "v")], "page_id long, url string, host string, verdict string")
    assert U.judge(pages).select("host", "verdict").collect()[0] == ("spam.com", "allow")
    assert U.judge(pages, []).collect()[0]["verdict"] == "allow"
    assert U.judge(pages.limit(0)).count() == 0


def test_query_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    from tidemark.llm.registry import ORACLES, QUERIES

    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(str, (tuple(r) for r in QUERIES["op9_url_filters"](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(map(str, con.sql(ORACLES["op9_url_filters"]).fetchall()))
