"""Url rules against every rule tried on every url."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomtrail.llm import url_rules
from loomtrail.llm.queries import ORACLE, QUERIES
from loomtrail.llm.url_rules import LISTED, PATTERNS, Rule


def judged(url: str | None, rules: list[Rule]) -> tuple[str, str, str | None, str, str | None]:
    """Host, path, rule, verdict and pattern by the definition."""
    low = str.maketrans(url_rules.UPPER, url_rules.LOWER)
    rest = (url or "").partition("://")[2]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = host.translate(low)
    fits = []
    for r in rules:
        if r.listed:
            h, slash, p = r.text.partition("/")
            hit = (host == h or host.endswith("." + h)) and path.startswith(slash + p)
        else:
            text, target = r.text, (host + path).translate(low)
            # each ^ may be a separator or the end
            regex = "".join({"*": r"[\s\S]*?", "^": r"([^0-9a-z]|\Z)"}.get(c, re.escape(c)) for c in text.strip("|").strip("*"))
            head = r"\A([^/]*\.)?" if text.startswith("||") else r"\A" if text.startswith("|") else ""
            hit = re.search(head + regex + (r"\Z" if text.endswith("|") else ""), target) is not None
        if hit:
            fits.append((int(r.listed), len(r.text), r.verdict == "block", r.text))
    listed, _, block, text = max(fits, default=(None, 0, False, None))
    return host, path, text if listed == 1 else None, "block" if block else "allow", text if listed == 0 else None


ODD = [
    None, "", "no scheme", "http://", "https://ORG/", "http://x.org", "http://x.org?a/", "http://borg/", "http://.org/", "http://example.org/en/1", "http://EXAMPLE.org/en/12/x", "http://example.org/EN/1",
    "http://a.example.org/es/", "http://example.org:80/es/", "http://u@example.org/es/", "http://b.com/fr/?x", "http://b.com/de/#x", "http://b.com/de", "x://y://example.com/de/", "http://ads.b.net/x", "http://loads.b.net/x",
    "http://b.net/LOGIN", "http://b.net/login2", "http://b.net/a.exe", "http://b.net/a.exe.html", "http://ad.b.net/article/1", "http://b.net/search/help", "http://b.net/\n/login\n", "http://ü.net/é/search", "http://" + "a." * 400 + "org/" + "x/" * 400,
]


def test_by_definition(spark):
    rng = random.Random(5)
    rules = [*LISTED, *PATTERNS, Rule("block", "*x*y"), Rule("allow", "|k.net^a"), Rule("block", "||net|"), Rule("block", "q"), Rule("allow", "*")]
    urls = ODD + ["http://" + "".join(rng.choice(["a", "k", "net", "com", "org", "example", "x", "y", "ads", ".", ".", "/", "/", "-", "?", "q", "de", "fr", "login"]) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    df = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for some in (rules, LISTED + PATTERNS, LISTED):
        got = {r.page_id: tuple(r)[1:] for r in url_rules.url_verdicts(df, some).collect()}
        assert got == {i: judged(u, some) for i, u in enumerate(urls)}
    assert [r.url for r in url_rules.allowed(df, LISTED + PATTERNS).orderBy("page_id").collect()] == [u for u in urls if judged(u, LISTED + PATTERNS)[3] == "allow"]
    assert url_rules.allowed(df, []).count() == len(urls) and url_rules.url_verdicts(df.limit(0), rules).count() == 0
    twice = url_rules.url_verdicts(df.union(df), rules)
    assert twice.count() == 2 * len(urls) and twice.distinct().count() == len(urls)


def test_index(spark, monkeypatch):
    """A rule is filed under its rarest whole token, and only fetched rules run; several literals give the same result."""
    assert Rule("block", "example.org/en/1", True).tokens() == ["en", "example", "org"]
    assert Rule("block", "||ads-*/x/").tokens() == ["ads", "x"] and Rule("block", "ads").tokens() == [] and Rule("block", "|ads^b|").tokens() == ["ads", "b"]
    df = spark.createDataFrame([(i, f"http://a.com/k{i % 7}/rare/x" if i % 9 == 0 else f"http://a.com/k{i % 7}/") for i in range(90)], "page_id long, url string")
    rule = Rule("block", "||a.com/*/rare/")
    counts = url_rules.token_counts(df, "url", [rule])
    assert counts == {"a": 90, "com": 90, "rare": 10} and url_rules.keyed(rule, counts) == "rare"
    many = [Rule("block", f"/k{i}/") for i in range(50)] + [rule]
    want = sorted(map(str, url_rules.url_verdicts(df, many).collect()))
    monkeypatch.setattr(url_rules, "MOST", 7)
    assert sorted(map(str, url_rules.url_verdicts(df, many).collect())) == want
    plan = url_rules.url_verdicts(df, many)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["op11_url_rules"])
def test_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    df = QUERIES[name](spark, data)
    assert df.select(F.count("page_id"), F.count_distinct("verdict")).first()[0] > 0
    assert sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall())) == sorted(str(tuple(r)) for r in df.collect())
