import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factfade.llm import queries, urls

PAGES = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [
        (len(h + p), v, h + p) for v, h, p in urls.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, rows):
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    for name in ("host", "path", "score", "found", "rule", "token", "word", "n", "blocked"):
        df = df.withColumn(name, F.lit("x"))
    return df


URLS = [
    "https://www.Example.com/en/1", "http://example.com/en/", "http://example.com/EN/", "http://com/x",
    "http://a.b.net/es/1", "http://net/fr/", "http://internet/es/", "http://notexample.com/en/1",
    "http://example.com", "http://example.com?x=/en/", "http://EXAMPLE.COM:80/en/", "no scheme", "",
    None, "ftp://a.org://b.net/es/", "http:///en/", "://net/es/x#y", "http://x.net/es", "http://ÄB.net/fr/é?q",
    "http://example.com/en/\nline", "http://h" + "o" * 40_000 + "st.org/" + "p" * 20_000, "x://y?://net/es/",
]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, "<p>plain words here</p>") for k, u in enumerate(URLS)] + [(None, URLS[0], None)] * 2
    got = urls.judge(pages(spark, rows)).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in got) == sorted(
        (i is None, i or 0) for i, _, _ in rows
    )
    for r in got:
        url = URLS[r["page_id"] or 0]
        assert (r["host"], r["path"]) == parts(url)
        verdict, rule = brute_rule(r["host"], r["path"])
        assert r["rule"] == rule
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
        assert r["host"] != "" or r["verdict"] == "allow"


def splitter():
    counts = {"cheap": 40, "pills": 30, "pill": 9, "the": 900, "rapist": 2, "therapist": 30, "a": 300, "s": 5}
    return urls.Splitter(counts, 5000)


def every_split(run):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        yield [run[i:j] for i, j in itertools.pairwise(at)]


def chance(words, s):
    """Cost of a split by the model's definition."""
    return sum(
        math.log(s.total) - math.log(s.counts[w]) if w in s.counts
        else math.log(s.total) + (len(w) - 1) * math.log(10)
        for w in words
    )


@pytest.mark.parametrize("run", ["cheappills", "therapist", "thepill", "xqz", "acheapa", "thetherapists"])
def test_split_is_the_likeliest_of_all(run):
    s = splitter()
    words = s.split(run)
    assert "".join(words) == run
    assert chance(words, s) == pytest.approx(min(chance(w, s) for w in every_split(run)))


def test_tokens():
    assert splitter().tokens("www-CheapPills.x/12_34/é") == [
        *splitter().split("www"), "cheap", "pills", "x", "#", "#", "é"
    ]
    assert splitter().tokens("") == []


def test_bayes_against_plain_counting(spark):
    hosts = {"a.x": (["free", "bet", "x"], True), "b.x": (["news", "x"], False), "c.x": (["x"], False)}
    rows = [(h, t, bad) for h, (tokens, bad) in hosts.items() for t in tokens]
    model = urls.Bayes.fit(spark.createDataFrame(rows, "host string, token string, blocked boolean"))
    bad = Counter(t for _, (ts, b) in hosts.items() if b for t in ts)
    good = Counter(t for _, (ts, b) in hosts.items() if not b for t in ts)
    mu = urls.SMOOTHING

    def chance_in(t, own, part):
        p = (bad[t] + good[t]) / (bad.total() + good.total())
        spam = 1 / len(urls.SPAM_WORDS) if t in urls.SPAM_WORDS else 0
        return (own[t] + mu * ((1 - part) * p + part * spam)) / (own.total() + mu)

    def odds(tokens):
        total = math.log((1 + 1) / (2 + 1))
        for t in tokens:
            if bad[t] + good[t] or t in urls.SPAM_WORDS:
                total += math.log(chance_in(t, bad, 0.2) / chance_in(t, good, 0.002))
        return total

    for tokens in ([], ["x"], ["free", "bet"], ["news", "x", "x"], ["unseen"], ["casino", "news"]):
        assert model.log_odds(tokens) == pytest.approx(odds(tokens))


def test_run_together_names_are_blocked_and_plain_ones_are_not(spark):
    text = "<html><p>the garden of the house has winter flowers and a river for fishing</p></html>"
    plain = ["winter-garden.org", "riverhouse.org", "thegarden.org", "flowersandfishing.org", "house.net"]
    spam = ["casinowin.org", "cheap-pills.net", "freebets.org", "xxxcams.net"]
    rows = [
        (k, f"https://{h}/en/{n}", text)
        for k, (h, n) in enumerate(itertools.product(plain + spam, range(5)))
    ]
    got = {(r["host"], r["verdict"]) for r in urls.judge(pages(spark, rows)).collect()}
    assert got == {(h, "allow") for h in plain} | {(h, "block") for h in spam}


def test_no_pages(spark):
    assert urls.judge(pages(spark, [])).collect() == []


def test_query_covers_its_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["page_id"]: r["url"] for r in queries.table(spark, sf, "pages").collect()}
    got = queries.QUERIES["op11_url_filter"](spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(rows)
    unwanted = re.compile(r"casino|pills|bets|spam|adult|ads-")
    for r in got:
        assert (r["host"], r["path"]) == parts(rows[r["page_id"]])
        verdict, rule = brute_rule(r["host"], r["path"])
        assert r["rule"] == rule
        assert r["verdict"] == (verdict or ("block" if unwanted.search(r["host"]) else "allow"))
