"""Mutated values by example."""

from __future__ import annotations

from loomtrail.operators import mutations


def test_values(spark):
    rows = [("entity_other", "number", "3"), ("entity_same_name", "number", "3"), ("entity_same_name", "number", "9"), ("date_plus_minus_day", "text", "2024-03-01"), ("date_plus_minus_week", "text", "2024-03-01T10:30"), ("time_zone_shift_hour", "text", "2024-03-01T23:30:05"),
            ("time_zone_shift_hour", "text", "2024-03-01"), ("amount_pct", "number", "200"), ("amount_unit", "number", "200"), ("amount_unit", "number", "1.5"), ("amount_unit", "text", "x"), ("list_omit_element", "list", '["a","b","c"]'), ("list_omit_element", "list", '["a"]'),
            ("list_extra_element", "list", '["a","b"]'), ("list_reorder", "list", '["a","b"]'), ("boolean_flip", "boolean", "true"), ("text_similar_entity", "text", "abcd"), ("text_similar_entity", "text", "abc"), ("text_stale_version", "text", "v"), ("write_mutated_value", "number", "7"),
            ("write_mutated_value", "text", "a"), ("date_other_field", "text", "2024-03-01"), ("amount_pct", "number", None), ("list_reorder", "list", "broken")]
    m = spark.createDataFrame([(1, f"n{i}", "v", m, "t", k, v) for i, (m, k, v) in enumerate(rows)], "task int, node string, name string, mutation string, table string, kind string, value string")
    ids = spark.createDataFrame([("t", i, "ab"[i % 2]) for i in range(1, 7)] + [("t", 9, "c"), ("u", 8, "a")], "table string, id int, label string")
    got = {int(r.node[1:]): r.mutated for r in mutations.mutated_values(m, ids, 5).collect()}
    assert got[0] != "3" and got[1] in ("1", "5") and 2 not in got
    assert got[3] in ("2024-02-29", "2024-03-02") and got[4] in ("2024-02-23T10:30", "2024-03-08T10:30") and got[5] in ("2024-03-01T22:30:05", "2024-03-02T00:30:05") and 6 not in got
    assert got[7] in ("190", "210") and got[8] in ("199", "201") and got[9] in ("0.5", "2.5") and 10 not in got
    assert got[11] in ('["b","c"]', '["a","c"]', '["a","b"]') and 12 not in got and got[13] == '["a","b","a"]' and got[14] == '["b","a"]'
    assert got[15] == "false" and got[16] == "abc" and got[17] == "abcx" and got[18] == "v (old)" and got[19] == "8" and got[20] == "ax" and not {21, 22, 23} & set(got)
    assert {int(r.node[1:]): r.mutated for r in mutations.mutated_values(m.repartition(5), ids.repartition(4), 5).collect()} == got


def test_families(spark):
    df = spark.createDataFrame([("Person",), ("order_total",), ("created_at_time",), ("total",), ("itemlist",), ("is_open",), ("whatever",), ("user_id",)], "type string")
    assert {r.type: r.f for r in df.select("type", mutations.family(df.type).alias("f")).collect()} == {"Person": "entity", "order_total": "entity", "created_at_time": "date", "total": "amount", "itemlist": "list", "is_open": "boolean", "whatever": "text", "user_id": "entity"}


def test_rows_per_mutation_are_not_shuffled(spark):
    """Nodes are dealt over tasks before they become a row per mutation; two tables, the writing nodes and the horizons are the only ones shuffled."""
    produced = spark.createDataFrame([("a", "1", 1, "x", "title"), ("a", "1", 0, "y", "name"), ("a", "2", 0, "z", "is_open")], "task string, node string, place int, name string, type string")
    out = mutations.static_records(produced, spark.createDataFrame([("a", "2")], "task string, node string"), spark.createDataFrame([("a", "1", 5), ("a", "2", 6)], "task string, node string, horizon int"))
    assert {(r.node, r.mutation, r.mutated_ref, r.original_ref, r.horizon) for r in out.collect()} == {
        *(("1", m, f"static:y:{m}", "derived:1:y", 5) for m in mutations.BY_FAMILY["text"]), ("2", "boolean_flip", "static:z:boolean_flip", "derived:2:z", 6), *(("2", m, f"static:<writes>:{m}", None, 6) for m in mutations.WRITES)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan.split("== Initial Plan ==")[-1].split("Generate")[0]


def test_distance_of_a_catch_is_counted_without_pairs(spark):
    """The places up to the first failing check are counted by a running number, not by all pairs of places of a task."""
    n = 60
    order = spark.createDataFrame([("t", str(k), 3 * k) for k in range(n)], "task string, node string, place int")
    mutated = spark.createDataFrame([(f"m{k}", "t", str(k)) for k in range(n)], "id string, task string, node string")
    results = spark.createDataFrame([(f"m{k}", str(j), not (j > k and (j * k) % 7 == 3)) for k in range(n) for j in range(n)], "id string, node string, passed boolean")
    ends = spark.createDataFrame([(f"m{k}", None, True, None) for k in range(n)], "id string, error string, final_passed boolean, diverged string")
    out = mutations.outcomes(mutated, order, results, ends)
    first = {k: min((j for j in range(k + 1, n) if (j * k) % 7 == 3), default=None) for k in range(n)}
    assert {r.id: (r.caught_by, r.distance) for r in out.collect()} == {f"m{k}": (None, None) if j is None else (str(j), j - k) for k, j in first.items()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5
