import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outlyer.llm import url_filter
from outlyer.llm.queries import URL_RULES

RULES = [*URL_RULES, ("allow", "a.net", ""), ("block", "a.net", "/x"), ("block", "b.a.net", "/x/y"), ("allow", "b.a.net", "/x/y"), ("allow", "", "/free/")]


def brute(host, path):
    fits = [(len(h.split(".")) if h else 0, len(p), a == "block", a, h + p) for a, h, p in RULES if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (best[3], best[4]) if best else None


LABEL = st.sampled_from(["a", "b", "net", "org", "example", "com", ""])


@settings(max_examples=400, deadline=None)
@given(st.lists(LABEL, max_size=4), st.lists(st.sampled_from(["x", "y", "en", "de", "fr", "free", "", "xy"]), max_size=4))
def test_trie_against_brute_force(labels, segments):
    host, path = ".".join(labels), "/" * bool(segments) + "/".join(segments)
    assert url_filter.Trie(RULES).match(host, path) == brute(host, path)


def test_pages(spark):
    urls = ["http://Shop.Example.NET/en/1", "https://x.net", "https://x.net/", "ftp://example.com/de/?q=/fr/", "http://a.org/fr/", "http://notnet/", None, "no scheme", "a://b://c/d", "http://u\n.net/", "http://x.net?/", ""]
    df = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got[0] == ("shop.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.net", "", None, "allow") and got[2][3] == "block"
    assert got[3] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5][3] == "allow"
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][:2] == ("b:", "//c/d") and got[11][:2] == ("", "")
    assert got[9][3] == "block" and got[10][3] == "allow"
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def test_too_many_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_RULES", 1)
    with pytest.raises(ValueError):
        url_filter.judge(spark.createDataFrame([("x",)], "url string"), URL_RULES)
