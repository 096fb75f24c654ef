from chunkloom.llm import urls
from chunkloom.llm.queries import HOST_RULES
from chunkloom.llm.urls import PATTERNS, Rule, host_rule, judge_urls, rarest_first


def run(spark, urls, rules=(*HOST_RULES, *PATTERNS)):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, verdict string, host string")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).orderBy("page_id").collect()]


def test_contract_rules(spark):
    got = run(spark, ["https://A.Example.com/en/12", "http://m.example.com/en/71?x=/y", "https://com/en/", "https://x.net/de/1#top", "https://example.net/de/8", "https://notexample.net/de/8", "https://a.org/es/", "https://a.org/ES/1", None, "no scheme", "http://h?q", "x://y.com", "https://xcom/en/1"])
    assert got == [
        ("a.example.com", "/en/12", "com/en/", "block"),
        ("m.example.com", "/en/71", "example.com/en/7", "allow"),
        ("com", "/en/", "com/en/", "block"),
        ("x.net", "/de/1", "net/de/", "allow"),
        ("example.net", "/de/8", "example.net/de/8", "block"),
        ("notexample.net", "/de/8", "net/de/", "allow"),
        ("a.org", "/es/", "org/es/", "block"),
        ("a.org", "/ES/1", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h", "", None, "allow"),
        ("y.com", "", None, "allow"),
        ("xcom", "/en/1", None, "allow"),
    ]


def test_patterns(spark):
    got = run(spark, ["https://shop.xy/cart/1", "https://shop.xy/cartoon", "https://xy/a.JPG", "https://ads.xy/1", "https://net/de/wp-admin/"])
    assert [g[3] for g in got] == ["block", "allow", "block", "block", "allow"]
    assert run(spark, []) == []


def test_index_takes_the_rarest_token():
    rules = [host_rule("block", "example.com/en/7"), host_rule("block", "net/de/"), Rule("block", "x", (), 1)]
    index = rarest_first(rules, {"example": 9, "com": 5, "en": 70, "net": 4, "de": 4})
    assert {k: [r.name for r in v] for k, v in index.items()} == {"com": ["example.com/en/7"], "de": ["net/de/"], None: [None]}


def test_odd_pages(spark):
    """Null ids, repeated rows, very long URLs and columns of clashing names."""
    long = "https://a.com/en/" + "x/" * 60_000
    rows = [(None, "https://a.com/en/1", "own", "own"), (None, "https://a.com/en/1", "own", "own"), (1, long, "own", None), (1, long, None, "own"), (2, "", None, None), (3, None, None, None)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string, rank string"), [*HOST_RULES, *PATTERNS])
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"] is None, r["rule"] or "", r["verdict"], len(r["path"])) for r in got.collect()) == [
        (False, "", "allow", 0), (False, "", "allow", 0), (False, "com/en/", "block", 120_004), (False, "com/en/", "block", 120_004), (True, "com/en/", "block", 5), (True, "com/en/", "block", 5),
    ]


def test_many_rules(spark, monkeypatch):
    """Thousands of rules in batches, literals joined by a shuffle, against all rules tried."""
    import random
    import re

    monkeypatch.setattr(urls, "RULES_AT_ONCE", 400)
    monkeypatch.setattr(urls, "BROADCAST_LITERALS", 10)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    rules = [host_rule(rng.choice(["block", "allow"]), f"{word()}.com/{word()}/{word()}") for _ in range(900)] + [Rule("block", "aaa$", (), 5)]
    tried = [f"https://{word()}.com/{word()}/{word()}{word()}" for _ in range(300)]
    want = []
    for u in tried:
        fits = [r for r in rules if re.search(r.pattern, u.removeprefix("https://"))]
        best = max(fits, key=lambda r: (r.rank, r.name or ""), default=None)
        want.append(((best.name, best.verdict) if best else (None, "allow")))
    got = [(g[2], g[3]) for g in run(spark, tried, rules)]
    assert [g[0] for g in got] == [w[0] for w in want] and any(w[0] for w in want)
