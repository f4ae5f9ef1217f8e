from __future__ import annotations

import pytest

from peerglass.llm.queries import URL_RULES
from peerglass.llm.url_filter import Rule, compile_rules, judge_urls, match

CASES = [
    ("https://a.example.net/fr/1?x=/en/", "a.example.net", "/fr/1", "net/", "block"),
    ("http://EXAMPLE.net/en/2", "example.net", "/en/2", "example.net/en/", "allow"),
    ("http://x.example.com/de/#a", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://x.example.com/de", "x.example.com", "/de", None, "allow"),
    ("ftp://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://internet/", "internet", "/", None, "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.net?q=/", "x.net", "", None, "allow"),
    ("x.net/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
    ("http://Ünet.NET/" + "p" * 5000, "Ünet.net", "/" + "p" * 5000, "net/", "block"),
]


def test_contract_rules(spark):
    pages = spark.createDataFrame(
        [(i, c[0], "h") for i, c in enumerate(CASES)], "page_id long, url string, host string"
    )
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages.union(pages), URL_RULES).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_longest_rule_wins_and_ties_block():
    rules = [
        Rule("c.d", "/a/", "block"), Rule("b.c.d", "/", "allow"), Rule("c.d", "/a/b", "allow"),
        Rule("e", "/", "allow"), Rule("e", "/", "block"),
    ]
    root = compile_rules(rules)
    assert match(root, "c.d", "/a/bc").name == "c.d/a/b"
    assert match(root, "c.d", "/a/x").name == "c.d/a/"
    assert match(root, "x.b.c.d", "/a/bc").name == "b.c.d/"
    assert match(root, "e", "/").verdict == "block"
    assert match(root, "", "") is None


def test_too_many_rules():
    with pytest.raises(ValueError):
        compile_rules([Rule("a", "/", "block")] * 3, max_rules=2)
