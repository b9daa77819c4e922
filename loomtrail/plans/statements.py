"""Queries over statements and patterns in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import statements, substitution
from loomtrail.plans.tables import spread, table

#: The statement of an order, by its key modulo 4, as Spark and DuckDB both build it; ~ stands for a quote.
STATEMENT = """translate(CASE o_orderkey % 4
  WHEN 0 THEN concat('SELECT DISTINCT o.o_orderstatus AS s FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderpriority = ~', o_orderpriority, '~ AND o_orderkey = ', o_orderkey, ' ORDER BY o_orderdate LIMIT 1')
  WHEN 1 THEN concat('select count(*), max(coalesce(o_totalprice, ', o_custkey, ')) from "orders" where lower(o_orderpriority) like ~%~ || lower(:prio) || ~%~ and o_custkey >= :cust -- FROM nowhere')
  WHEN 2 THEN 'SELECT c_name FROM customer WHERE c_custkey IN (:cust) AND c_name <> ~it~~s, FROM here; (~ GROUP BY c_name'
  ELSE concat('UPDATE t SET o_orderstatus = ~F~ /* FROM x */ FROM orders WHERE o_orderkey = :key AND o_orderpriority LIKE ~%', o_orderpriority, '%~ AND day LIKE ~%1995-0', o_orderkey % 9 + 1, '-11%~') END, '~', chr(39))"""


def _statements(spark, d):
    bind = lambda p, n, v, number: F.struct(F.lit(p).alias("parameter"), F.lit(n).alias("name"), v.cast("string").alias("value"), F.lit(number).alias("number"))
    bindings = F.array(bind("prio", "o_orderpriority", F.col("o_orderpriority"), False), bind("key", "o_orderkey", F.col("o_orderkey"), True), bind("day", "day", F.concat(F.lit("1995-0"), F.col("o_orderkey") % 9 + 1, F.lit("-11T08:00")), False), bind("none", "none", F.lit(None), False))
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", F.expr(STATEMENT).alias("sql"), bindings.alias("bindings")).withColumn("tokens", statements.tokens(F.col("sql")))


def _deep():
    return statements.with_depth(statements.solid(F.col("tokens")))


def statement_parts(spark, d):
    """Tables, items, the bare column, parameters with their columns, and columns of the condition, of each statement."""
    t, deep = F.col("tokens"), F.col("deep")
    known = F.array(*(F.lit(c) for c in ("o_orderkey", "o_orderpriority", "o_custkey", "c_name", "c_custkey")))
    s = _statements(spark, d).withColumn("deep", _deep())
    return s.select(
        "o_orderkey", F.array_join(statements.tables(statements.solid(t)), ",").alias("tables"), F.array_join(statements.select_items(deep), ";").alias("items"), statements.select_column(deep).alias("column"),
        F.array_join(F.transform(statements.parameter_columns(statements.solid(t)), lambda p: F.concat_ws("=", p["column"], p["parameter"])), ",").alias("parameters"), F.array_join(statements.where_columns(deep, known), ",").alias("conditions"),
    )


def token_kinds(spark, d):
    """How many tokens of each kind all statements have, and their characters."""
    t = _statements(spark, d).select(F.explode("tokens").alias("t"))
    return t.groupBy("t.kind").agg(F.count("*").alias("n"), F.sum(F.length("t.text")).alias("n_chars"))


def rebound_statements(spark, d):
    """Literals turned into parameters, and back."""
    s = _statements(spark, d).withColumn("rebound", statements.rebound(F.col("tokens"), F.col("bindings")))
    back = statements.frozen(statements.tokens(F.col("rebound")), F.col("bindings"))
    return s.select("o_orderkey", "rebound", back.alias("frozen"), F.array_join(statements.unresolved(statements.tokens(F.col("rebound")), F.col("bindings")), ",").alias("unresolved"))


def _records(spark, d):
    """Each order as the result of a statement: one row, cut results as samples, some without an id or with one that is no number."""
    o = spread(table(spark, d, "orders"), "o_orderkey")
    ident = F.when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit('"k'), "o_orderkey", F.lit('"'))).otherwise(F.col("o_orderkey").cast("string"))
    key = F.when(F.col("o_orderkey") % 3 == 0, "rowid").otherwise("id")
    row = F.concat(F.lit('{"'), key, F.lit('":'), ident, F.lit(',"state":"'), "o_orderstatus", F.lit('","prio":'), F.when(F.col("o_orderkey") % 7 == 2, "null").otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))), F.lit("}"))
    rows = F.when(F.col("o_orderkey") % 4 == 3, F.concat(F.lit('{"truncated":true,"sample":['), row, F.lit("]}"))).when(F.col("o_orderkey") % 11 == 4, F.lit("")).otherwise(F.concat(F.lit("["), row, F.lit(",5]")))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 5, "").otherwise("shop").alias("app"), F.expr(STATEMENT).alias("sql"), rows.alias("rows"), F.concat(F.lit("/c/"), F.col("o_custkey") % 40).alias("route"), F.when(F.col("o_orderkey") % 6 == 0, "cli").otherwise("api").alias("source"))


def observed_facts(spark, d):
    return statements.observed_facts(_records(spark, d), "o_orderkey", "app", "sql", "rows").drop("place").withColumnRenamed("id", "o_orderkey")


def rendered_fields(spark, d):
    r = _records(spark, d)
    return statements.rendered_fields(r, statements.observed_facts(r, "o_orderkey", "app", "sql", "rows"), "o_orderkey", "app", "route", "source")


def _sentences(spark, d):
    """The sentences of the benchmark items, of 20 characters or more."""
    each = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"\.")).alias("s"))
    return each.select("item_id", F.trim("s").alias("sentence")).where("length(sentence) >= 20")


def first_hazards(spark, d):
    """Where each document first holds a sentence of each benchmark item."""
    out = substitution.first_matches(table(spark, d, "documents"), "doc_id", "text", _sentences(spark, d), "item_id", "sentence")
    return out.select(F.col("id").alias("doc_id"), F.col("name").cast("long").alias("item_id"), "at", "pattern", "n_matches")


def substituted_texts(spark, d):
    """Documents with each sentence of a benchmark item replaced by a mark around it."""
    marks = _sentences(spark, d).select("sentence", F.concat(F.lit("<<"), "sentence", F.lit(">>")).alias("new"))
    out = substitution.substituted(table(spark, d, "documents").select("doc_id", "text"), "text", marks, "sentence", "new")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_replaced")


QUERIES = {f.__name__: f for f in (statement_parts, token_kinds, rebound_statements, observed_facts, rendered_fields, first_hazards, substituted_texts)}

_RECORDS = """r AS (SELECT o_orderkey AS k, 'c' AS c, CASE WHEN o_orderkey % 4 = 2 THEN 'customer' ELSE 'orders' END AS t, CASE WHEN o_orderkey % 5 = 1 THEN '*' ELSE o_orderkey::VARCHAR END AS n, '/c/' || o_custkey % 40 AS route, o_orderkey % 6 = 0 AS cli,
    CASE WHEN o_orderkey % 3 = 0 THEN 'rowid' ELSE 'id' END AS key, CASE WHEN o_orderkey % 5 = 1 THEN 'k' ELSE '' END || o_orderkey AS id, o_orderstatus, CASE WHEN o_orderkey % 7 <> 2 THEN o_orderpriority END AS prio
    FROM orders WHERE o_orderkey % 13 <> 5 AND (o_orderkey % 4 = 3 OR o_orderkey % 11 <> 4)),
  f AS (SELECT k, t, key AS "column", t || ':' || n AS entity, id AS value, route, cli FROM r UNION ALL SELECT k, t, 'state', t || ':' || n, o_orderstatus, route, cli FROM r UNION ALL SELECT k, t, 'prio', t || ':' || n, prio, route, cli FROM r WHERE prio IS NOT NULL)"""
_SENTENCES = """b AS (SELECT DISTINCT item_id, trim(s, ' ') AS s FROM (SELECT item_id, unnest(string_split(text, '.')) AS s FROM benchmark) WHERE length(trim(s, ' ')) >= 20)"""
ORACLE = {
    "statement_parts": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'orders,customer' WHEN 2 THEN 'customer' ELSE 'orders' END AS tables,
      CASE o_orderkey % 4 WHEN 0 THEN 'o . o_orderstatus AS s' WHEN 1 THEN 'count ( * );max ( coalesce ( o_totalprice , ' || o_custkey || ' ) )' WHEN 2 THEN 'c_name' ELSE '' END AS items,
      CASE o_orderkey % 4 WHEN 0 THEN 'o_orderstatus' WHEN 2 THEN 'c_name' END AS "column",
      CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'o_orderpriority=prio' WHEN 2 THEN 'c_custkey=cust' ELSE 'o_orderkey=key' END AS parameters,
      CASE o_orderkey % 4 WHEN 0 THEN 'o_orderpriority,o_orderkey' WHEN 1 THEN 'o_orderpriority,o_custkey' WHEN 2 THEN 'c_custkey,c_name' ELSE 'o_orderkey,o_orderpriority' END AS conditions FROM orders""",
    "token_kinds": rf"""WITH t AS (SELECT unnest(regexp_extract_all({STATEMENT}, '''(?:[^'']|'''')*''|"[^"]*"|--.*|/\*[^*]*\*/|\w+|:\w+| +|<=|>=|<>|\|\||[^ ]')) AS x FROM orders)
      SELECT CASE WHEN x LIKE '''%' THEN 'text' WHEN x LIKE '"%' THEN 'name' WHEN x LIKE '--%' OR x LIKE '/*%' THEN 'comment' WHEN x LIKE ' %' THEN 'space' WHEN x LIKE ':_%' THEN 'parameter' WHEN regexp_matches(x, '^[0-9]') THEN 'number' WHEN regexp_matches(x, '^\w') THEN 'word' ELSE 'sign' END AS kind,
      count(*) AS n, sum(length(x))::BIGINT AS n_chars FROM t GROUP BY 1""",
    "rebound_statements": f"""WITH s AS (SELECT o_orderkey, o_orderpriority AS p, '1995-0' || (o_orderkey % 9 + 1) || '-11' AS day, {STATEMENT} AS sql FROM orders),
      r AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN replace(replace(sql, '''' || p || '''', ':prio'), 'o_orderkey = ' || o_orderkey, 'o_orderkey = :key') WHEN 3 THEN replace(replace(sql, '''%' || p || '%''', '''%'' || :prio || ''%'''), '''%' || day || '%''', '''%'' || substr(:day, 1, 10) || ''%''') ELSE sql END AS rebound FROM s)
      SELECT o_orderkey, rebound, replace(replace(replace(rebound, ':prio', '''' || p || ''''), ':key', o_orderkey::VARCHAR), ':day', '''' || day || 'T08:00''') AS frozen, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'cust' ELSE '' END AS unresolved FROM r""",
    "observed_facts": f"""WITH {_RECORDS} SELECT k AS o_orderkey, 'shop.' || t AS "table", "column", entity, value FROM f""",
    "rendered_fields": f"""WITH {_RECORDS} SELECT 'shop' AS app, route, t AS "table", "column", entity, arg_min(value, k) AS value FROM f WHERE NOT cli GROUP BY ALL""",
    "first_hazards": f"""WITH {_SENTENCES}, m AS (SELECT doc_id, item_id, instr(text, s) AS "at", s, (length(text) - length(replace(text, s, ''))) // length(s) AS n FROM documents JOIN b ON contains(text, s))
      SELECT doc_id, item_id, min("at") AS "at", arg_min(s, "at" * 10000 - length(s)) AS pattern, sum(n)::BIGINT AS n_matches FROM m GROUP BY 1, 2""",
    "substituted_texts": f"""WITH {_SENTENCES}, p AS (SELECT '(' || string_agg(regexp_escape(s), '|' ORDER BY length(s) DESC, s) || ')' AS p FROM (SELECT DISTINCT s FROM b)),
      t AS (SELECT doc_id, text, regexp_replace(text, (SELECT p FROM p), '<<\\1>>', 'g') AS new FROM documents)
      SELECT doc_id, md5(new) AS text_md5, coalesce((length(new) - length(text)) // 4, 0)::INTEGER AS n_replaced FROM t""",
}
