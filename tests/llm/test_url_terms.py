import re

from trialmill.llm import queries, url_terms

RULES = queries.RULES


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    has = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)
    bad = any(map(has, url_terms.STRICT)) or sum(bool(has(t)) for t in url_terms.SOFT) >= url_terms.SOFT_HITS
    return host, path, rule, RULES[rule] if rule else "block" if bad else "allow"


def test_agrees_with_plain_loops(spark):
    urls = [
        None, "", "no scheme/here", "http://", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.net/EN/x", "http://example.net", "http://net/",
        "https://a.example.com/de/", "https://notexample.com/de/", "http://b.org/fr/q", "http://b.org/fr", "http://cheap-pills.example.com/a",
        "http://cheapish.example.com/pills", "http://x.com/casino", "http://x.com/casinos", "http://x.com/free/free", "http://x.com/FREE?win=1",
        "http://x.com#://y/z", "http://ÄÖ.example.com/Ä", "http://x.com/" + "a" * 100_000 + "/porn", "http://user@h:80/p", "http://x.com/xfree-win",
    ] * 2
    pages = spark.createDataFrame([(i, u, "v", "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string, _host string")
    out = url_terms.judge(pages, RULES).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id]), urls[r.page_id]
    assert url_terms.judge(pages.limit(0), RULES).count() == 0


def test_terms_with_free_borders():
    assert url_terms.terms_in("http://free-bets.example.net/win", url_terms.SOFT) == ["bets", "free", "win"]
    assert url_terms.terms_in("http://winner.com/refree/éfree", url_terms.SOFT) == ["free"]
