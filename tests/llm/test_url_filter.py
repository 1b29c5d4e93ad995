import math
import re

import burstgraph.llm.url_filter as U

PAGE = "page_id BIGINT, url STRING, html STRING, word STRING, rule INT"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGE).repartition(3)


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
        host, path = "".join(c.lower() if c < "\x7f" else c for c in m[1]), m[2]
    fits = [(t, v) for t, v in rules for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_rules(spark):
    urls = [
        None, "", "nothing", "http://", "http://A.COM", "http://a.com/", "HTTPS://Example.COM/en/x?q#f", "http://www.example.com/en/",
        "http://m.www.example.com/en/1", "http://example.com/EN/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net?/es/",
        "a://b://c.com/", "http://x.org/#://y.com/", "http://ÄÖ.com/ß", "//x.com/", "http://example.com:80/en/",
    ]
    rows = [(k, u, "<p>sun moon</p>") for k, u in enumerate(urls)] + [(3, "http://a.com/", None), (None, "http://a.com/x", "")]
    for r in U.url_verdicts(pages(spark, rows)).collect():
        url = next(u for i, u, _ in rows if i == r.page_id and plain(u, U.RULES)[:2] == (r.host, r.path))
        host, path, rule, verdict = plain(url, U.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert U.url_verdicts(pages(spark, rows)).count() == len(rows)


def test_segmentation_is_the_cheapest():
    costs = {"sun": 2.0, "set": 2.5, "sunset": 4.0, "un": 1.0, "se": 1.0, "t": 3.0}

    def cheapest(text):
        best = [(0.0, ())]
        for j in range(1, len(text) + 1):
            best.append(min([(best[j - 1][0] + 20, (*best[j - 1][1], text[j - 1 : j]))] + [(best[i][0] + costs[text[i:j]], (*best[i][1], text[i:j])) for i in range(j) if text[i:j] in costs]))
        return best[-1][0]

    for text in ("sunset", "sunsets", "xsun", "unset", "qq", ""):
        words = U.segment(text, costs, 20.0)
        assert "".join(words) == text
        assert math.isclose(sum(costs.get(w, 20.0 * len(w)) for w in words), cheapest(text))
    assert U.segment("sunset", costs, 20.0) == ["sunset"] and U.segment("xysun", costs, 20.0) == ["xy", "sun"]


def test_naive_bayes_judges_open_urls(spark):
    html = "<p>casino lucky sun garden news casino garden lucky win</p><script>bad()</script>"
    rows = [(k, f"http://{'luckycasino' if k % 2 else 'sungarden'}{k}.{'net/es/' if k % 2 else 'com/'}{'win' if k % 2 else 'news'}", html) for k in range(40)]
    rows += [(100, "http://casinolucky.org/win", html), (101, "http://gardensun.org/news", html), (102, None, None)]
    found = {r.page_id: r for r in U.url_verdicts(pages(spark, rows)).collect()}
    assert found[100].verdict == "block" and found[101].verdict == "allow" and found[100].rule is None
    assert found[1].verdict == "block" and found[1].rule == "net/es/" and found[1].score is None


def test_long_words_are_words(spark):
    """Words beyond the looked-up prefix: alone, inside a name, one the beginning of another, with a shared beginning."""
    a, b = "abcdefghij" * 3, "abcdefghij" * 2 + "abcdqqqqqqqqqq"
    html = f"<p>{a} {a} {b} {a}xy sun x</p>"
    costs = U.word_costs(pages(spark, [(1, None, html)]))
    assert {r.word for r in costs.collect()} == {a, b, a + "xy", "sun", "x", "p"} - {"p"}
    names = {a: [a], "sun" + a + "sun": ["sun", a, "sun"], a + "xysun": [a + "xy", "sun"], b + "x": [b, "x"], a[:-1]: None, "sun" + b + a: ["sun", b, a]}
    found = {r.name: r.words for r in U.segmented(spark.createDataFrame([(n,) for n in names], "name STRING"), costs).collect()}
    assert all("".join(found[n]) == n and words in (None, found[n]) for n, words in names.items())
    long = "http://" + "luckycasino" * 200 + "." + "z" * 5000 + ".org/" + "y" * 3000
    assert U.url_verdicts(pages(spark, [(1, long, "lucky casino " + "z" * 4000)])).first().verdict == "allow"


def test_without_rules_or_rows(spark):
    assert U.url_verdicts(pages(spark, [])).collect() == []
    assert [r.verdict for r in U.url_verdicts(pages(spark, [(1, "http://x.org/", None)])).collect()] == ["allow"]
    only = [(1, "http://x.net/es/", "a"), (2, "http://y.org/", "b")]
    assert {r.page_id: r.verdict for r in U.url_verdicts(pages(spark, only)).collect()} == {1: "block", 2: "block"}
