"""URL filters against plain string tests, on odd urls and many rules."""

from __future__ import annotations

import random

import pytest

from paceline.llm import url_filter

KIND = "page_id long, url string"
RULE_KIND = "host string, path string, verdict string"


def parts(url):
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    return rest[:cut].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[cut:end]


def verdict(url, rules, default="allow"):
    h, p = parts(url)
    fits = [(len(rh + (rp or "")), len(rh), v == "block", rh + (rp or ""), v) for rh, rp, v in rules if rh and v and (h == rh or h.endswith("." + rh)) and p.startswith(rp or "")]
    return (h, p, *max(fits)[3:]) if fits else (h, p, None, default)


ODD = [
    None, "", "no scheme here", "://", "http://", "http://Example.ORG", "http://example.org/", "https://a.example.org/en/12?x=/es/#y",
    "https://example.org:80/en/1", "https://me@example.org/en/1", "http://badexample.org/es/1", "http://a..org/es/", "http://x.com/fr/a://b.org/", "http://x.com?/de/", "http://x.com#/de/",
    "http://Ünï.com/de/文字", "http://x.com/de/" + "y" * 60_000, "h" * 5000 + "://" + "a." * 3000 + "com/de/", "http://com/de/", "http://.com/fr/", "http://com./fr/", "http://x.com/DE/1", "x\n://e.org/a\nb", "http:///de/1", "http://x.com//de/",
]


def test_odd_urls(spark):
    rows = [(k % 7 if k % 5 else None, u) for k, u in enumerate(ODD + ODD[:9])]
    rules = spark.createDataFrame(url_filter.RULES, RULE_KIND)
    got = url_filter.judge(spark.createDataFrame(rows, KIND), rules).collect()
    want = [(k, u, *verdict(u, url_filter.RULES)) for k, u in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("most", [50_000, 0])
def test_many_rules_equal_brute_force(spark, monkeypatch, most):
    """Nested rules, ties, repeated and broken ones; by broadcast and by salted shuffle."""
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    monkeypatch.setattr(url_filter, "PREFIX", 1)  # so that short prefixes collide and digests must decide
    r = random.Random(12)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "org", "x.org", "com.org"]
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b", "/a/b/c.html"]
    rules = [(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(30)] + [(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("x.org", "/a", None)]
    urls = [f"https://{r.choice(['', 'www.', 'b.', 'c.b.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'z', '?q', '#f'])}" for _ in range(300)]
    rows = list(enumerate(urls))
    got = url_filter.judge(spark.createDataFrame(rows, KIND), spark.createDataFrame(rules, RULE_KIND), default="block").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, u, *verdict(u, rules, "block"))) for k, u in rows)


def test_empty_tables_and_clashing_columns(spark):
    rules, none = spark.createDataFrame(url_filter.RULES, RULE_KIND), spark.createDataFrame([], RULE_KIND)
    pages = spark.createDataFrame([(1, "http://x.com/de/", "own", "own", "own", "own", "own")], KIND + ", host string, path string, rule string, verdict string, prefix string")
    got = url_filter.judge(pages, rules)
    assert got.columns == [*pages.columns, "host_", "path_", "rule_", "verdict_"]
    assert tuple(got.first()) == (1, "http://x.com/de/", "own", "own", "own", "own", "own", "x.com", "/de/", "com/de/", "block")
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert tuple(url_filter.judge(pages, none).first())[-2:] == (None, "allow")
