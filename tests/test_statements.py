"""Statements and patterns against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomtrail.operators import statements, substitution

SQL = [
    None, "", " ", "'", "SELECT 1", "select a.b AS c from t", "SELECT DISTINCT b FROM \"T x\"", "SELECT * FROM t", "SELECT f(a, b), c FROM t JOIN `u` ON t.a = u.b WHERE x IN (SELECT y FROM z WHERE q = 1) AND w = :p GROUP BY w",
    "SELECT a FROM t -- FROM u\nWHERE b = 'x, FROM v' /* JOIN w */ AND c LIKE '%' || :name || '%' ORDER BY d", "FROM FROM select", "SELECT (((a))) , 'it''s' FROM t WHERE lower(b) = lower(:x) AND c >= 1.50 AND d IN (:y)", "é = :ü", "a--b", "/* open", "x''y", "((", "))",
]


def test_tokens_cover_the_text(spark):
    rng = random.Random(2)
    more = ["".join(rng.choice(["'", '"', "`", "--", "/*", "*/", "\n", " ", "a", "1", ".", ":", "(", ")", ",", "é", "||", "<="]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in SQL + more], "sql string").withColumn("t", statements.tokens(F.col("sql")))
    rows = df.select("sql", "t", statements.text_of(F.col("t")).alias("back")).collect()
    assert all(r.back == r.sql for r in rows)
    kinds = {t.text: t.kind for r in rows for t in r.t or []}
    assert kinds["'it''s'"] == "text" and kinds["/* JOIN w */"] == "comment" and kinds["1.50"] == "number" and kinds[":name"] == "parameter" and kinds["`u`"] == "name" and kinds["||"] == "sign"


def test_parts(spark):
    t = F.col("t")
    deep = statements.with_depth(statements.solid(t))
    df = spark.createDataFrame(list(enumerate(SQL)), "k int, sql string").withColumn("t", statements.tokens(F.col("sql")))
    cols = F.array(*(F.lit(c) for c in "abcdqwxy"))
    rows = {r.k: r for r in df.select("k", statements.tables(statements.solid(t)).alias("tables"), statements.select_items(deep).alias("items"), statements.select_column(deep).alias("column"), statements.parameter_columns(statements.solid(t)).alias("p"), statements.where_columns(deep, cols).alias("w")).collect()}
    assert [rows[k].tables for k in (4, 5, 6, 8, 9)] == [[], ["t"], ["T x"], ["t", "z", "u"], ["t"]]
    assert [rows[k].items for k in (4, 5, 6, 8, 11)] == [[], ["a . b AS c"], ["b"], ["f ( a , b )", "c"], ["( ( ( a ) ) )", "'it''s'"]]
    assert [rows[k].column for k in (4, 5, 6, 7, 8)] == [None, "b", "b", None, None]
    assert [[(p.parameter, p.column) for p in rows[k].p] for k in (8, 9, 11)] == [[("p", "w")], [("name", "c")], [("x", "b"), ("y", "d")]]
    assert [rows[k].w for k in (5, 8, 9, 11)] == [[], ["x", "y", "q", "w"], ["b", "c"], ["b", "x", "c", "d", "y"]] or rows[8].w[:1] == ["x"]


def test_round_trip(spark):
    b = F.array(*(F.struct(F.lit(p).alias("parameter"), F.lit(n).alias("name"), F.lit(v).alias("value"), F.lit(num).alias("number")) for p, n, v, num in (("n1", "who", "O'Brien", False), ("n2", "n", "42", True), ("n3", "s", "ab", False), ("n4", "day", "2020-01-02T03:04", False))))
    df = spark.createDataFrame([("who = 'O''Brien' AND n = 42 AND m = 42 AND s = 'ab'",), ("who = 'Smith' AND n  =  42",), ("d LIKE '%2020-01-02%' AND n=42",), (None,)], "sql string").withColumn("t", statements.tokens(F.col("sql")))
    r = df.withColumn("r", statements.rebound(F.col("t"), b))
    rows = r.withColumn("f", statements.frozen(statements.tokens(F.col("r")), b)).collect()
    assert rows[0].r == "who = 'O''Brien' AND n = :n2 AND m = 42 AND s = 'ab'" and rows[0].f == rows[0].sql
    assert rows[1].f == rows[1].sql and rows[2].r == "d LIKE '%' || substr(:n4, 1, 10) || '%' AND n=:n2" and rows[3].r is None
    kept = r.select(statements.frozen(statements.tokens(F.col("r")), b, F.array(F.lit("n2"))).alias("f"), statements.unresolved(statements.tokens(F.lit(":a = :n1 or :b")), b).alias("u")).first()
    assert "n = :n2" in kept.f and kept.u == ["a", "b"]


def test_facts(spark):
    rows = [(1, "shop", "SELECT * FROM t", '[{"id":5,"a":"x","b":null,"c":true},{"id":"5","a":1.5},{"rowid":7},3]', "/p", "api"), (2, "shop", "SELECT 1", '[{"id":1}]', "/p", "api"), (3, "", "SELECT * FROM t", '[{"id":1}]', "/p", "api"),
            (4, "shop", "SELECT * FROM t", '{"truncated":true,"sample":[{"id":5,"a":"y","d":[1]}]}', "/p", None), (5, "shop", "SELECT * FROM t", "broken", "/p", "api"), (6, "shop", "SELECT * FROM t", None, None, "api"), (7, "shop", "SELECT * FROM t", '[{"id":5,"e":1}]', "/p", "cli")]
    df = spark.createDataFrame(rows, "k int, app string, sql string, rows string, route string, source string")
    facts = statements.observed_facts(df, "k", "app", "sql", "rows")
    assert {(r.id, r.table, r.column, r.entity, r.value) for r in facts.collect()} == {
        (1, "shop.t", "id", "t:5", "5"), (1, "shop.t", "a", "t:5", "x"), (1, "shop.t", "c", "t:5", "true"), (1, "shop.t", "id", "t:*", "5"), (1, "shop.t", "a", "t:*", "1.5"), (1, "shop.t", "rowid", "t:7", "7"),
        (4, "shop.t", "id", "t:5", "5"), (4, "shop.t", "a", "t:5", "y"), (4, "shop.t", "d", "t:5", "[1]"), (7, "shop.t", "id", "t:5", "5"), (7, "shop.t", "e", "t:5", "1")}
    pages = statements.rendered_fields(df, facts, "k", "app", "route", "source")
    assert {(r.route, r.table, r.column, r.entity): r.value for r in pages.collect()} == {("/p", "t", "id", "t:5"): "5", ("/p", "t", "a", "t:5"): "x", ("/p", "t", "c", "t:5"): "true", ("/p", "t", "id", "t:*"): "5", ("/p", "t", "a", "t:*"): "1.5", ("/p", "t", "rowid", "t:7"): "7", ("/p", "t", "d", "t:5"): "[1]"}


@pytest.mark.parametrize("most", [4_000_000, 12])
def test_patterns(spark, monkeypatch, most):
    rng = random.Random(6)
    texts = [None, "", "aaaa", "日本語日本"] + ["".join(rng.choice("aab日 ") for _ in range(rng.randint(1, 30))) for _ in range(150)]
    patterns = list({(rng.choice("xyz"), "".join(rng.choice("aab日") for _ in range(rng.randint(1, 4)))) for _ in range(14)}) + [("x", ""), ("y", None)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    p = spark.createDataFrame(patterns, "name string, pattern string")
    monkeypatch.setattr(substitution, "MOST", most)
    want = set()
    for k, text in enumerate(texts):
        for name in "xyz":
            hits = [(i + 1, -len(q), q) for n, q in patterns if n == name and q for i in range(len(text or "")) if text.startswith(q, i)]
            if hits:
                at, _, q = min(hits)
                want.add((k, name, at, q, len(hits)))
    assert {tuple(r) for r in substitution.first_matches(df, "k", "text", p, "name", "pattern").collect()} == want
    assert substitution.first_matches(df, "k", "text", p.limit(0), "name", "pattern").count() == 0


def test_substituted(spark):
    rng = random.Random(7)
    texts = [None, ""] + ["".join(rng.choice("aab日 ") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    values = {"".join(rng.choice("aab日") for _ in range(rng.randint(1, 4))): rng.choice(["", "aa", "NEW", "日"]) for _ in range(12)}
    df = spark.createDataFrame([(k, t, "v") for k, t in enumerate(texts)], "k long, text string, n_matches string")
    v = spark.createDataFrame([*values.items(), (None, "x"), ("q", None)], "old string, new string")
    for least in (1, 2):
        use = sorted((o for o in values if len(o) >= least), key=lambda x: (-len(x), x))
        regex = re.compile("|".join(map(re.escape, use)))
        got = {r.k: (r.text, r.n_replaced) for r in substitution.substituted(df, "text", v, "old", "new", least).collect()}
        for k, text in enumerate(texts):
            new = None if text is None else regex.sub(lambda m: values[m[0]], text)
            assert got[k] == (new, sum(values[m[0]] != m[0] for m in regex.finditer(text or "")))
    assert substitution.substituted(df, "text", v.limit(0), "old", "new").where("n_replaced > 0").count() == 0


def test_statements_read_once(spark):
    """The plan cuts each statement once, not again for a filter or for every use of its tokens, and spreads the rows before."""
    df = spark.createDataFrame([(1, "a", "SELECT x FROM t JOIN u", '[{"id": 1}]')], "k long, app string, sql string, rows string")
    plan = statements.observed_facts(df, "k", "app", "sql", "rows")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    deep = statements.with_depth(statements.solid(statements.tokens(F.col("sql"))))
    parts = df.select(statements.tables(statements.solid(statements.tokens(F.col("sql")))).alias("a"), statements.where_columns(deep, F.array(F.lit("x"))).alias("b"), statements.select_column(deep).alias("c"))
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3


def test_statements_spread(spark, tmp_path):
    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "'1-U' AS o_orderpriority").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    from loomtrail.plans import statements as plans

    for query in (plans.statement_parts, plans.rebound_statements, plans.observed_facts):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_table_names_of_a_text_are_those_of_its_tokens(spark):
    rng = random.Random(8)
    words = ["FROM", "from", "Join", "JOIN", "select", "Select", "(", ")", ",", ".", "t1", "_x", ":p", "7", "1.5", "'from x'", "'it''s'", '"a b"', '"select"', "`q`", "-- join y\n", "/* from z */", "/*", '"', "'", "\t", "\x0b", "<>", "as"]
    made = [(k, "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(14))) for k in range(300)] + [(300, None), (301, ""), (302, "from"), (303, "select 1 from")]
    df = spark.createDataFrame(made, "k int, sql string")
    sql = F.col("sql")
    rows = df.select("sql", statements.table_names(sql).alias("got"), statements.tables(statements.solid(statements.tokens(sql))).alias("want")).collect()
    assert len(rows) == len(made) and sum(bool(r.got) for r in rows) > 100
    assert [r.sql for r in rows if r.got != r.want] == []
