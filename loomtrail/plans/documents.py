"""Queries over texts, pages, graphs and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.functions.expressions import compile_expression
from loomtrail.operators import graphs, relations, texts
from loomtrail.plans.tables import table

STOP = ["the", "and", "with", "that", "this", "from"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def ngram_leak(spark, d):
    return texts.ngram_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark").withColumnRenamed("text", "hidden"), "item_id", "hidden")


def extract_expectations(spark, d):
    return texts.expectations(table(spark, d, "documents"), "doc_id", "text")


def keyword_coverage(spark, d):
    words = table(spark, d, "documents").select(F.explode(texts.tokens(F.col("text"))).alias("word")).distinct()
    return texts.keyword_coverage(table(spark, d, "benchmark"), "item_id", "text", 4, STOP, words, "word")


def tag_strip(spark, d):
    return table(spark, d, "pages").select("page_id", texts.plain_of_markup(F.col("html")).alias("text"))


def slug_and_snake(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.slug(F.col("p_name")).alias("slug"), texts.snake(F.col("p_type")).alias("snake"))


def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.token_estimate(F.col("n_chars"), F.col("doc_id") % 30, 1000, 20).alias("tokens"))


def _edges(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    top = s.agg(F.max("a").alias("top"))
    e = s.select("a", F.explode(F.array(F.col("a") * 2, F.col("a") * 2 + 1, F.col("a") * 3 + 2)).alias("b")).distinct()
    return e.crossJoin(top).where("b <= top and a > 0").select("a", "b")  # one row on the right


def graph_closure(spark, d):
    return graphs.closure(_edges(spark, d), "a", "b")


def closure_depths(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    out = graphs.depths(nodes, "node", _edges(spark, d), "a", "b")
    return out.select("node", F.col("longest").cast("long").alias("longest"), F.col("shortest").cast("long").alias("shortest"))


def graph_sinks(spark, d):
    return graphs.sinks(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), "node", _edges(spark, d), "a")


def graph_degrees(spark, d):
    return graphs.degrees(_edges(spark, d), "a", "b")


def _tables(spark, d):
    return {t: table(spark, d, t) for t in TABLES}


def _columns(spark, tables):
    rows = [(t, c, i) for t, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "table string, column string, position int")


def confirmed_keys(spark, tables):
    """Relations between tables by the names of key columns, of which every value is found among those of the key."""
    named = graphs.infer_keys(_columns(spark, tables), "key")
    keys = {t: df.select(*(c for c in df.columns if c.endswith("key"))) for t, df in tables.items()}
    return relations.confirmed(named, relations.column_values(keys, nulls=True))


def key_inference(spark, d):
    return confirmed_keys(spark, _tables(spark, d))


def key_paths(spark, d):
    return graphs.key_paths(confirmed_keys(spark, _tables(spark, d)), 3)


EXPRESSIONS = {
    "band": "'high' if o_totalprice > 150000 and o_orderstatus in ['F', 'O'] else 'low'",
    "digit": "(o_orderkey - 50) % 7 + o_custkey // 10 * 2",
    "chained": "1000 <= o_custkey < 1200 or not o_orderstatus == 'F'",
    "label": "fmt('{}-{}', lower(o_orderstatus), o_orderkey)",
    "later": "date_add(day, days=30)",
    "weekday": "weekday_of(day)",
    "small": "len([x for x in [o_orderkey % 3, o_orderkey % 5, o_orderkey % 7] if x > 1])",
}


#: Text, list, mapping and number cases of the language; ``xs`` is a list of numbers, ``ws`` of words, ``m`` a mapping, ``rows`` a list of records.
TYPED = {
    "e1_join": "status + '-' + 'x' * 2", "e1_lists": "len(xs + [1])", "e1_floor": "(key - 70) // 4", "e1_mod": "(key - 70) % -4", "e1_power": "k3 ** 2", "e3_list": "k3 in xs", "e3_map": "status in m", "e3_text": "'U' not in priority",
    "e5_text": "1 if empty else 0", "e5_list": "1 if xs[4:] else 0", "e5_null": "1 if nothing else 0", "e6_tail": "xs[-2:]", "e6_inner": "xs[1:-1]", "e6_text": "priority[2:-1]", "e6_last": "xs[-1]", "e6_key": "m['F']", "e8_len": "len(xs) * 100 + len(priority)", "e8_sum": "sum(xs)",
    "e8_extremes": "max(xs) - min(xs)", "e8_all": "all(x > 0 for x in xs)", "e8_any": "any([x > 3 for x in xs])", "e8_sorted": "sorted(xs)[0]", "e9_casts": "int(str(key)) + 1", "e9_set": "len(set(ws))", "e9_dict": "dict(a=key)['a']", "e9_bool": "bool(empty) or bool(xs)", "e12_date": "date_of(day)", "e14_at": "at_time(day, '9:5')",
    "e15_fmt": "fmt('{0}/{1}/{0} {z}', key, status, z=k3)", "e17_pluck": "pluck(rows, 'n')", "e18_counts": "count_by(rows, 'k')['a']", "e18_argmax": "argmax(count_by(rows, 'k'))", "e18_argmin": "argmin(count_by(rows, 'k'))", "e18_unique": "unique(ws)", "e19_first": "first(xs[5:], 'none')", "e20_contains": "contains(ws, status)",
    "e4_is": "nothing is null and key is not null", "a11_words": "[w + '!' for w in ws if w != 'b']",
}


def expr_typed(spark, d):
    k3 = (F.col("o_orderkey") % 3).cast("int")
    words = F.array(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.lit("a"))
    record = F.transform(words, lambda w: F.struct(w.alias("k"), F.length(w).alias("n")))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"), k3.alias("k3"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(k3 == 0, "").otherwise("t").alias("empty"), F.lit(None).cast("string").alias("nothing"),
        F.array(k3 + 1, F.lit(2), k3, F.lit(1)).alias("xs"), words.alias("ws"), F.create_map(F.lit("F"), k3, F.lit("O"), F.lit(7)).alias("m"), record.alias("rows"))
    names = {c: F.col(c) for c in o.columns}

    def shown(name: str, c):
        return (F.array_join(c, ",") if dict(o.select(c.alias(name)).dtypes)[name].startswith("array") else c.cast("string")).alias(name)

    return o.select("o_orderkey", *(shown(k, compile_expression(e.replace("'none'", "-1"), names, frame=o)) for k, e in TYPED.items()))


def expr_eval(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    names = {c: F.col(c) for c in o.columns}
    return o.select("o_orderkey", *(compile_expression(e, names, frame=o).alias(k) for k, e in EXPRESSIONS.items()))


QUERIES = {f.__name__: f for f in (ngram_leak, extract_expectations, keyword_coverage, tag_strip, slug_and_snake, token_estimate, graph_closure, closure_depths, graph_sinks, graph_degrees, key_inference, key_paths, expr_eval, expr_typed)}

_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_EDGES = """t AS (SELECT max(s_suppkey) AS top FROM supplier), e AS (SELECT DISTINCT a, b FROM (SELECT s_suppkey AS a, unnest([s_suppkey * 2, s_suppkey * 2 + 1, s_suppkey * 3 + 2]) AS b FROM supplier), t WHERE b <= top AND a > 0)"""
_MARKUP = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"

_KEY_COLUMNS = ["region.r_regionkey", "nation.n_nationkey", "nation.n_regionkey", "customer.c_custkey", "customer.c_nationkey", "supplier.s_suppkey", "supplier.s_nationkey", "part.p_partkey", "orders.o_orderkey", "orders.o_custkey", "lineitem.l_orderkey", "lineitem.l_partkey", "lineitem.l_suppkey"]
_KEYS = f"""v AS ({' UNION ALL '.join(f"SELECT DISTINCT '{x.split('.')[0]}' AS t, '{x.split('.')[1]}' AS c, {x.split('.')[1]}::BIGINT AS v FROM {x.split('.')[0]}" for x in _KEY_COLUMNS)}), c AS (SELECT table_name AS t, column_name AS c, row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) AS p, regexp_extract(column_name, '^[a-z]+_([a-z]+key)$', 1) AS stem FROM information_schema.columns WHERE table_name IN ({', '.join(map(repr, TABLES))})),
  k AS (SELECT a.t AS from_table, a.c AS from_column, b.t AS to_table, b.c AS to_column FROM c a JOIN c b ON a.stem = b.stem AND a.stem <> '' AND b.p = 1 AND a.t <> b.t
    WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.t = a.t AND x.c = a.c AND NOT EXISTS (SELECT 1 FROM v y WHERE y.t = b.t AND y.c = b.c AND y.v = x.v)))"""

ORACLE = {
    "key_inference": f"WITH {_KEYS} SELECT * FROM k",
    "key_paths": f"""WITH {_KEYS}, e AS (SELECT from_table AS a, to_table AS b FROM k UNION SELECT to_table, from_table FROM k),
      h AS (SELECT a, b, 1 AS hops FROM e UNION ALL SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b UNION ALL SELECT x.a, z.b, 3 FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a WHERE x.a <> z.b AND x.a <> y.b)
      SELECT a, b, min(hops) AS hops FROM h GROUP BY 1, 2""",
    "ngram_leak": f"""WITH a AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents), b AS (SELECT item_id, {_TOKENS.format("text")} AS w FROM benchmark),
      x AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a)),
      y AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b))
      SELECT doc_id, item_id, count(*) AS n_shared FROM x JOIN y USING (g) GROUP BY 1, 2""",
    "extract_expectations": r"""SELECT DISTINCT doc_id, kind, value FROM (
      SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value FROM documents
      UNION ALL SELECT doc_id, 'date', unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) FROM documents UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\+\d[\d -]{7,}\d')) FROM documents)""",
    "keyword_coverage": f"""WITH v AS (SELECT DISTINCT unnest({_TOKENS.format("text")}) AS w FROM documents),
      k AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS w FROM benchmark) WHERE length(w) >= 4 AND w NOT IN ('the', 'and', 'with', 'that', 'this', 'from'))
      SELECT item_id, count(*) AS n_keywords, count(*) FILTER (w IN (SELECT w FROM v) OR regexp_replace(w, 's$', '') IN (SELECT w FROM v)) AS n_found FROM k GROUP BY 1""",
    "tag_strip": rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace({_MARKUP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
    "slug_and_snake": r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, lower(regexp_replace(regexp_replace(p_type, '[\s-]+', '_', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM part",
    "token_estimate": "SELECT doc_id, (n_chars + 3) // 4 + least(doc_id % 30, 20) * 1000 AS tokens FROM documents",
    "graph_closure": f"WITH RECURSIVE {_EDGES}, r(x, y) AS (SELECT a, b FROM e UNION SELECT x, b FROM r JOIN e ON y = a) SELECT x AS ancestor, y AS node FROM r",
    "closure_depths": f"""WITH RECURSIVE {_EDGES}, r(node, depth) AS (SELECT s_suppkey, 0::BIGINT FROM supplier WHERE s_suppkey NOT IN (SELECT b FROM e) UNION SELECT b, depth + 1 FROM r JOIN e ON node = a)
      SELECT node, max(depth) AS longest, min(depth) AS shortest FROM r GROUP BY 1""",
    "graph_sinks": f"WITH {_EDGES} SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT a FROM e)",
    "graph_degrees": f"WITH {_EDGES} SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT b AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT a, 0, 1 FROM e) GROUP BY 1",
    "expr_typed": """WITH o AS (SELECT *, (o_orderkey % 3)::INT AS k, o_orderkey - 70 AS j FROM orders), x AS (SELECT *, [k + 1, 2, k, 1] AS xs, ['a', o_orderstatus, 'b', 'a'] AS ws FROM o)
      SELECT o_orderkey, o_orderstatus || '-xx' AS e1_join, '5' AS e1_lists, floor(j::DOUBLE / 4)::BIGINT::VARCHAR AS e1_floor, (j - (-4) * floor(j::DOUBLE / -4)::BIGINT)::VARCHAR AS e1_mod, (k * k)::VARCHAR AS e1_power, list_contains(xs, k)::VARCHAR AS e3_list, (o_orderstatus IN ('F', 'O'))::VARCHAR AS e3_map, (NOT contains(o_orderpriority, 'U'))::VARCHAR AS e3_text,
      CASE WHEN k = 0 THEN '0' ELSE '1' END AS e5_text, '0' AS e5_list, '0' AS e5_null, k || ',1' AS e6_tail, '2,' || k AS e6_inner, o_orderpriority[3:-2] AS e6_text, '1' AS e6_last, k::VARCHAR AS e6_key, (400 + length(o_orderpriority))::VARCHAR AS e8_len, (2 * k + 4)::VARCHAR AS e8_sum, (greatest(2, k + 1) - least(k, 1))::VARCHAR AS e8_extremes,
      (k > 0)::VARCHAR AS e8_all, 'false' AS e8_any, least(k, 1)::VARCHAR AS e8_sorted, (o_orderkey + 1)::VARCHAR AS e9_casts, len(list_distinct(ws))::VARCHAR AS e9_set, o_orderkey::VARCHAR AS e9_dict, 'true' AS e9_bool, strftime(o_orderdate, '%Y-%m-%d') AS e12_date, strftime(o_orderdate, '%Y-%m-%d') || 'T09:05:00' AS e14_at,
      o_orderkey || '/' || o_orderstatus || '/' || o_orderkey || ' ' || k AS e15_fmt, '1,' || length(o_orderstatus) || ',1,1' AS e17_pluck, '2' AS e18_counts, 'a' AS e18_argmax, CASE WHEN o_orderstatus < 'b' THEN o_orderstatus ELSE 'b' END AS e18_argmin, 'a,' || o_orderstatus || ',b' AS e18_unique, '-1' AS e19_first, 'true' AS e20_contains, 'true' AS e4_is, 'a!,' || o_orderstatus || '!,a!' AS a11_words FROM x""",
    "expr_eval": """SELECT o_orderkey, CASE WHEN o_totalprice > 150000 AND o_orderstatus IN ('F', 'O') THEN 'high' ELSE 'low' END AS band,
      (((o_orderkey - 50) % 7 + 7) % 7 + o_custkey // 10 * 2)::BIGINT AS digit, (o_custkey >= 1000 AND o_custkey < 1200) OR o_orderstatus <> 'F' AS chained, lower(o_orderstatus) || '-' || o_orderkey AS label,
      strftime(o_orderdate::DATE + INTERVAL 30 DAY, '%Y-%m-%d') AS later, dayname(o_orderdate) AS weekday, ((o_orderkey % 3 > 1)::INT + (o_orderkey % 5 > 1)::INT + (o_orderkey % 7 > 1)::INT) AS small FROM orders""",
}
