r"""Url filters: pattern rules, indexed by their rarest literal token.

A url is judged by its host and path: the host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path goes from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has neither.

A pattern is text that must occur in host and path, in which ``*`` stands for any characters and ``^`` for a separator
(no letter or digit of ASCII) or the end; ``||`` in front ties it to the host or a parent domain of it, ``|`` in front
to the start and ``|`` behind to the end. Each pattern becomes a regular expression. Its literal tokens are the runs of
ASCII letters and digits that no ``*`` or open end touches, so every fitting url holds them whole. How often each token
occurs is counted over all urls, and a rule is filed under its rarest one, A-Z lower-cased. The tokens of a url fetch
rules from that index, and only those run their regular expressions; rules without a token run on every url.

The index is a literal of hash buckets in the plan, so judging is one projection without a join or a Python worker. A
literal holds ``MOST`` rules; further rules make further literals, whose best rules are compared.

Of the rules that fit, listed rules (host and path) come before patterns, then the longest text wins, block before allow
at equal length; without any, the verdict is allow. Repeated rows are judged alike, an empty table gives no rows, other
columns are ignored. Very long urls cost time by their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of one literal in the plan, about 200 bytes each.
MOST = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = "struct<token:string,listed:int,size:int,block:int,text:string,regex:string>"


@dataclass(frozen=True)
class Rule:
    """``listed`` rules are a host and the beginning of a path; patterns are lower case and matched on lower-cased A-Z."""

    verdict: str
    text: str
    listed: bool = False

    def parts(self) -> list[str]:
        """The pattern as literal texts and the signs ``||``, ``|``, ``*`` and ``^``."""
        if self.listed:
            return ["||", self.text]
        head = re.match(r"\|{0,2}", self.text)[0]
        tail = "|" if self.text.endswith("|") and len(self.text) > len(head) else ""
        inner = re.split(r"([*^])", self.text[len(head) : len(self.text) - len(tail)])
        parts = [x for x in [head, *inner, tail] if x]
        while parts and parts[0] == "*":  # it fits anything, and would only make the search slow
            parts.pop(0)
        while parts and parts[-1] == "*":
            parts.pop()
        return [x for k, x in enumerate(parts) if x != "*" or parts[k - 1] != "*"]

    def regex(self) -> str:
        """In the syntax that Java, Python and RE2 share."""
        parts = self.parts()
        signs = {"||": r"\A(?:[^/]*\.)?", "*": "(?s:.*?)", "^": r"(?:[^0-9A-Za-z]|\z)"}
        out = ""
        for k, x in enumerate(parts):
            if x == "|":
                out += r"\A" if k == 0 and self.text.startswith("|") else r"\z"
            else:
                out += signs.get(x) or re.sub(r"[^0-9A-Za-z]", lambda m: "\\" + m[0] if ord(m[0]) < 128 else m[0], x)
        return out

    def tokens(self) -> list[str]:
        """Lower-cased tokens that every fitting url holds whole."""
        parts, out = self.parts(), []
        for k, x in enumerate(parts):
            if x in ("||", "|", "*", "^"):
                continue
            closed_left, closed_right = (0 <= j < len(parts) and parts[j] != "*" for j in (k - 1, k + 1))  # an end that is not tied is open
            for m in re.finditer("[0-9A-Za-z]+", x):
                if (m.start() or closed_left) and (m.end() < len(x) or closed_right):
                    out.append(m[0].translate(str.maketrans(UPPER, LOWER)))
        return sorted(set(out))


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.concat(host, path), UPPER, LOWER), F.lit("([0-9a-z]+)"), 1))


def token_counts(urls: DataFrame, url_col: str, rules: Iterable[Rule]) -> dict[str, int]:
    """How many of all urls hold each token of the rules; one number per token of the rules comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    found = urls.select(F.explode(F.filter(_tokens(*parts_of(F.col(url_col))), lambda t: t.isin(wanted))).alias("token"))
    return {t: 0 for t in wanted} | {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def keyed(rule: Rule, counts: dict[str, int]) -> str:
    """The token that a rule is filed under: the rarest; empty if it has none."""
    return min(((counts.get(t, 0), t) for t in rule.tokens()), default=(0, ""))[1]


def _literal(rules: list[tuple[str, Rule]]) -> tuple[Column, int]:
    n = 1 << max(0, (2 * len(rules) - 1).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for token, r in rules:
        buckets[zlib.crc32(token.encode()) % n].append({"token": token, "listed": int(r.listed), "size": len(r.text), "block": int(r.verdict == "block"), "text": r.text, "regex": r.regex()})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<{ENTRY}>>"), n


def _fetched(tokens: Column, index: Column, n: int) -> Column:
    """The rules that are filed under one of the tokens."""
    def bucket(t: Column) -> Column:
        return F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(n)).cast("int"))

    return F.flatten(F.transform(tokens, lambda t: F.filter(bucket(t), lambda r: r["token"] == t)))


def best_rule(host: Column, path: Column, rules: Iterable[Rule], counts: dict[str, int]) -> Column:
    """The winning rule (listed, size, block, text) of each url; null if none fits."""
    target, tokens = F.concat(host, path), F.concat(_tokens(host, path), F.array(F.lit("")))
    lowered = F.translate(target, UPPER, LOWER)
    filed = [(keyed(r, counts), r) for r in dict.fromkeys(rules)]
    best = []
    for lo in range(0, len(filed), MOST):
        fetched = _fetched(tokens, *_literal(filed[lo : lo + MOST]))
        fits = F.filter(fetched, lambda r: F.regexp_like(F.when(r["listed"] == 1, target).otherwise(lowered), r["regex"]))
        best.append(F.array_max(F.transform(fits, lambda r: F.struct(r["listed"].alias("listed"), r["size"].alias("size"), r["block"].alias("block"), r["text"].alias("text")))))
    return best[0] if len(best) == 1 else F.greatest(*best) if best else F.lit(None).cast("struct<listed:int,size:int,block:int,text:string>")


def url_verdicts(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The id, host, path, rule (listed rules only), verdict and pattern (what else decided, or null) of each row."""
    host, path = parts_of(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules, token_counts(pages, url_col, rules)))
    listed = F.col("best.listed") == 1
    return rows.select(
        id_col, "host", "path", F.when(listed, F.col("best.text")).alias("rule"),
        F.when(F.col("best.block") == 1, "block").otherwise("allow").alias("verdict"), F.when(~listed, F.col("best.text")).alias("pattern"),
    )


def allowed(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """The rows whose url is allowed, with all their columns."""
    best = best_rule(*parts_of(F.col(url_col)), rules, token_counts(pages, url_col, rules))
    return pages.where(F.coalesce(best["block"], F.lit(0)) == 0)


LISTED = [Rule(v, t, True) for v, t in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]
#: Addresses that hold no prose: trackers, accounts, shops' forms, search results, programs and archives.
PATTERNS = [
    *(Rule("block", p) for p in ("||ads.", "||ads-", "||ad.", "||adserver.", "||track.", "||tracker.", "||tracking.", "||pixel.", "||doubleclick.", "||click.")),
    *(Rule("block", f"/{p}^") for p in ("login", "signin", "signup", "register", "logout", "cart", "checkout", "wp-admin", "wp-login.php", "cgi-bin", "search", "captcha")),
    *(Rule("block", f".{p}|") for p in ("exe", "zip", "gz", "rar", "jpg", "png", "gif", "mp4", "css", "js")),
    Rule("allow", "||ad.*/article/"), Rule("allow", "/search/help^"),
]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), LISTED + PATTERNS)


def oracle() -> str:
    """Every rule on every url, without an index."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rules = ",\n".join(f"({int(r.listed)}, {len(r.text)}, {int(r.verdict == 'block')}, {quoted(r.text)}, {quoted(r.regex())})" for r in LISTED + PATTERNS)
    return rf"""
WITH rules(listed, size, block, text, regex) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '\A([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '\A[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT page_id, host, path, (SELECT max({{'listed': listed, 'size': size, 'block': block, 'text': text}}) FROM rules WHERE regexp_matches(CASE WHEN listed = 1 THEN host || path ELSE translate(host || path, '{UPPER}', '{LOWER}') END, regex)) AS b FROM cut)
SELECT page_id, host, path, CASE WHEN b.listed = 1 THEN b.text END AS rule, CASE WHEN b.block = 1 THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN b.listed = 0 THEN b.text END AS pattern
FROM best
"""
