"""Operators on small tables made by hand."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomtrail.functions.expressions import ExpressionError, compile_expression
from loomtrail.operators import changes, facts, graphs, metrics, prefixes, rubrics, rules, samples, sampling, steps


def test_first_passing_run_gives_the_score(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit string")
    runs = spark.createDataFrame([("a", 1, False, 0.4), ("a", 2, True, 1.0), ("b", 1, False, 0.2), ("b", 2, False, 0.7)], "unit string, run int, passed boolean, score double")
    got = {r.unit: (r.n_runs, r.solved, r.score) for r in metrics.pass_at_k(units, runs, "unit", 3).collect()}
    assert got == {"a": (2, True, 1.0), "b": (2, False, 0.7), "c": (0, False, 0.0)}
    assert metrics.pass_at_k(units, runs, "unit", 3, missing_fails=False).count() == 2
    assert not metrics.pass_at_k(units, runs, "unit", 1).where("solved").count()


def test_weights_must_be_positive(spark):
    with pytest.raises(Exception, match="positive"):
        metrics.rubric_verdict(spark.createDataFrame([(1, 0.0, True)], "run int, w double, s boolean"), "run", "w", F.col("s")).collect()


def test_replay_gives_the_last_images(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame([(1, 1, "UPDATE", "x"), (2, 2, "DELETE", None), (3, 4, "INSERT", "n"), (4, 1, "UPDATE", "y")], "seq int, k int, op string, v string")
    assert {tuple(r) for r in changes.replay(base, log, "k", "seq", "op", ["v"]).collect()} == {(1, "y"), (3, "c"), (4, "n")}
    assert {tuple(r) for r in changes.replay(base, log, "k", "seq", "op", ["v"], until=1).collect()} == {(1, "x"), (2, "b"), (3, "c")}


def test_digest_ignores_order_and_partitions(spark):
    df = spark.createDataFrame([(i, None if i % 3 else str(i)) for i in range(50)], "a int, b string")
    one = changes.table_digest(df, ["a", "b"]).first()
    assert changes.table_digest(df.orderBy(F.desc("a")).repartition(7), ["a", "b"]).first() == one
    assert changes.table_digest(df.where("a <> 7"), ["a", "b"]).first() != one


def test_normal_text(spark):
    df = spark.createDataFrame([("  a \n b ",), ("2024-01-02 03:04",), ("2024-01-02T03:04:05.678Z",)], "v string")
    assert [r[0] for r in df.select(facts.normal_text(F.col("v"))).collect()] == ["a b", "2024-01-02T03:04:00", "2024-01-02T03:04:05"]


def test_nearest_text_of_every_edit(spark):
    left = spark.createDataFrame([(1, "abcdefghij")], "i int, t string")
    for other in ("bcdefghij", "abcdefghijx", "abXdeYghiZ", "xyzabcdefghij", "abcdefg"):
        got = facts.nearest_text(left, spark.createDataFrame([(2, other)], "i int, t string"), "t", "i", 3).collect()
        assert len(got) == 1, other
    assert not facts.nearest_text(left, spark.createDataFrame([(2, "klmnopqrst")], "i int, t string"), "t", "i", 3).count()


def test_closure_stops_and_cycles_are_errors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert graphs.closure(edges, "a", "b").count() == 6
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "n int")
    assert {tuple(r) for r in graphs.depths(nodes, "n", edges.union(spark.createDataFrame([(1, 4)], "a int, b int")), "a", "b").collect()} == {(1, 0, 0), (2, 1, 1), (3, 2, 2), (4, 3, 1), (5, 0, 0)}
    with pytest.raises(ValueError, match="cycle"):
        graphs.depths(nodes, "n", edges.union(spark.createDataFrame([(4, 2)], "a int, b int")), "a", "b", most=8)


def test_split_is_exact_and_stable(spark):
    rows = spark.range(200).withColumnRenamed("id", "k")
    one = sampling.hash_split(rows, "k", 7, 30)
    assert one.where("split = 'test'").count() == 30
    assert one.exceptAll(sampling.hash_split(rows.orderBy(F.desc("k")).repartition(5), "k", 7, 30)).isEmpty()


def test_neutral_segment_returns_to_its_state(spark):
    rows = [("r", 0, "a", 1, "p"), ("r", 1, "a", 2, "p"), ("r", 2, "a", 1, "p"), ("r", 3, "b", 5, "p")]
    got = steps.neutral_segments(spark.createDataFrame(rows, "run string, at int, key string, value int, page string"), "run", "at", "key", "value", "page").collect()
    assert [tuple(r) for r in got] == [("r", 1, 2, 2)]


def test_neutral_segments_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(r, i, rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice("pq")) for r in range(6) for i in range(40)]
    feeds = [(r, i, i + rng.randint(1, 6)) for r in range(6) for i in range(40) if rng.random() < 0.1]

    def brute(run: int, fed: list) -> list:
        own = [x for x in rows if x[0] == run]
        out, i = [], 0
        while i < len(own):
            start = {k: v for _, _, k, v, _ in own[:i]}
            page, best = own[i - 1][4] if i else own[0][4], None
            for j in range(len(own) - 1, i - 1, -1):
                now = start | {k: v for _, _, k, v, _ in own[i : j + 1]}
                if now == start and own[j][4] == page and not any(r == run and own[i][1] <= s <= own[j][1] < u for r, s, u in fed):
                    best = j
                    break
            if best is not None:
                out.append((run, own[i][1], own[best][1], best - i + 1))
            i = i + 1 if best is None else best + 1
        return out

    steps_ = spark.createDataFrame(rows, "run int, at int, key string, value int, page string")
    for fed in ([], feeds):
        df = spark.createDataFrame(fed, "run int, at int, used int") if fed else None
        got = sorted(map(tuple, steps.neutral_segments(steps_, "run", "at", "key", "value", "page", df).collect()))
        assert got == [x for run in range(6) for x in brute(run, fed)] and got


def test_token_matched_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randint(1, 40), 300) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, n int, goal int")
    want = set()
    for g in "ab":
        total = 0
        for _, i, n, goal in sorted((x for x in rows if x[0] == g), key=lambda x: hashlib.sha256(str(x[1]).encode()).hexdigest()):
            if total < goal * 0.95 and total + n <= goal * 1.05:
                total += n
                want.add((g, i))
        assert 285 <= total <= 315
    assert {(r.g, r.i) for r in steps.token_matched(df, "g", "n", "goal", 0.05, F.sha2(F.col("i").cast("string"), 256)).collect()} == want


def test_other_row(spark):
    df = spark.createDataFrame([(i, "x" if i < 6 else f"n{i}") for i in range(10)], "k int, name string")
    got = {r.k: (r.other, r.same_name) for r in prefixes.other_row(df, "k", "name", 3).collect()}
    assert all(o != k and same == (k < 6) and (o < 6 or k >= 6) for k, (o, same) in got.items()) and len(got) == 10
    assert sorted(o for k, (o, _) in got.items() if k < 6) == list(range(6))
    assert prefixes.other_row(df.limit(1), "k", "name", 3).first().other is None


def test_patches_that_do_not_fit(spark):
    steps_ = spark.createDataFrame([("r", 0, "a", "o"), ("r", 1, "b", "p")], "run string, at int, action string, seen string")
    for patch, match in ((("r", 5, "drop", "a", None), "no step"), (("r", 1, "replace", "zz", "c"), "another action")):
        with pytest.raises(Exception, match=match):
            prefixes.patched(steps_, spark.createDataFrame([patch], "run string, at int, operation string, old_action string, new_action string"), "run", "at", "action", ["seen"]).collect()


def test_dates_of_every_form_and_unknown_labels(spark):
    df = spark.createDataFrame([("2024-02-29", "2024-02-29"), ("March 3rd, 2025", "2025-03-03"), ("Mar. 3, 2025", "2025-03-03"), ("Sept 9", "2026-09-09"), ("May 1", "2026-05-01"), ("7/4/2025", "2025-07-04"), ("7/4", "2026-07-04"), ("13/40", None)], "t string, want string")
    assert [r for r in df.select("t", "want", rubrics.iso_date(F.col("t"), 2026).alias("got")).collect() if r.want != r.got] == []
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([(["nonsense"],)], "l array<string>").select(rules.normal_labels(F.col("l"))).collect()


@pytest.mark.parametrize(("text", "want"), [
    ("-7 % 2", 1), ("-7 // 2", -4), ("7 % -2", -1), ("1 < a <= 5 and not b", True), ("b or a == 5", True), ("'x' if b else 'y'", "y"), ("xs[-1]", 3), ("xs[0:2]", [1, 2]),
    ("[x * 2 for x in xs if x > 1]", [4, 6]), ("round(2.5)", 2), ("sum(xs)", 6), ("argmax(count_by(ws))", "v"), ("date_add('2024-02-28', days=2)", "2024-03-01"), ("date_add('2024-02-28T10:00:00', hours=15)", "2024-02-29T01:00:00"),
    ("weekday_of('2024-02-29')", "Thursday"), ("at_time('2024-02-29', '9:05')", "2024-02-29T09:05:00"), ("'b' in word", True), ("a in [1, 5]", True), ("nothing is null", True), ("pick(m, 'z', 'd')", "d"), ("fmt('{}/{}', a, word)", "5/abc"),
    ("xs[-2:]", [2, 3]), ("xs[1:-1]", [2]), ("xs[:-1]", [1, 2]), ("xs[5:]", []), ("word[1:]", "bc"), ("word[-2:]", "bc"), ("word[0]", "a"), ("len(xs)", 3), ("len(word)", 3), ("len(m)", 1), ("word + 'd'", "abcd"), ("xs + [4]", [1, 2, 3, 4]),
    ("word * 2", "abcabc"), ("2 in xs", True), ("7 not in xs", True), ("'k' in m", True), ("'z' in m", False), ("1 if word else 0", 1), ("1 if '' else 0", 0), ("1 if xs else 0", 1), ("1 if xs[3:] else 0", 0), ("1 if nothing else 0", 0),
    ("9007199254740993 // 1", 9007199254740993), ("-9007199254740993 // 2", -4503599627370497), ("-7 // -2", 3), ("7.5 // 2", 3.0), ("2 ** 10", 1024), ("sum([1, 2])", 3), ("sum([1.5, 2])", 3.5), ("fmt('{0}-{1}-{0}', word, a)", "abc-5-abc"),
    ("fmt('{x}{{}}', x=a)", "5{}"), ("str(b)", "False"), ("lower(nothing)", "none"), ("any([x > 2 for x in xs])", True), ("all(x > 2 for x in xs)", False), ("[w if w == 'v' else 'n' for w in ws]", ["v", "n", "v", "n"]), ("[w + word for w in ws][0]", "vabc"),
    ("[len(w) for w in ws if w in word]", []), ("count_by(rows, 'k')", {"p": 2, "q": 1}), ("argmin(count_by(rows, 'k'))", "q"), ("pluck(rows, 'n')", [1, 2, 3]), ("pick(rows[0], 'k')", "p"), ("pick(rows[0], 'no', 7)", 7), ("first(xs, 0)", 1), ("first(xs[3:], 9)", 9),
    ("contains(xs, 2)", True), ("contains(word, 'z')", False), ("contains(nothing, 1)", False), ("set(ws)", ["v", "w"]), ("dict(a=1)", {"a": 1}), ("list(m)", ["k"]), ("tuple('ab')", ["a", "b"]), ("unique(ws)", ["v", "w"]), ("nothing == null", True), ("max(xs) - min(2, 3)", 1),
    ("sorted(xs)[-1]", 3), ("round(2.346, 2)", 2.35), ("abs(-3)", 3), ("date_of('2024-02-29T10:11:12Z')", "2024-02-29"), ("time_of('2024-02-29T10:11:12')", "10:11"), ("date_add('2024-02-28T23:00:00Z', hours=2)", "2024-02-29T01:00:00+00:00"), ("strip('  x ')", "x"), ("int('7') + 1", 8), ("float('1.5')", 1.5), ("bool(xs)", True),
])
def test_expressions(spark, text, want):
    names = {"a": F.lit(5), "b": F.lit(False), "xs": F.array(F.lit(1), F.lit(2), F.lit(3)), "ws": F.array(F.lit("v"), F.lit("w"), F.lit("v"), F.lit("w")), "word": F.lit("abc"), "nothing": F.lit(None), "m": F.create_map(F.lit("k"), F.lit("v")), "rows": F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in (("p", 1), ("p", 2), ("q", 3))))}
    assert spark.range(1).select(compile_expression(text, names)).first()[0] == want


@pytest.mark.parametrize("text", ["a.b", "lambda: 1", "open('x')", "__import__('os')", "[x for x in xs for y in xs]", "1 +", "unknown"])
def test_what_the_language_lacks(text):
    with pytest.raises(ExpressionError):
        compile_expression(text, {"a": None, "xs": None})


def test_last_used_runs_with_few_and_many_values(spark, monkeypatch):
    """A run with more pieces than are held gives the same as one whose pieces are held, and both the brute force."""
    values = [(run, f"{k % 7}val-{k:03d}") for run, n in ((1, 3), (2, 40)) for k in range(n)] + [(1, "ab"), (3, "never"), (2, "2024-01-15T10:00")]
    params = [(run, at, f"uses {at % 7}VAL-{at:03d} and ab") for run in (1, 2) for at in range(45)] + [(2, 50, "on 2024-01-15"), (2, 51, None)]
    v, p = spark.createDataFrame(values, "run int, value string"), spark.createDataFrame(params, "run int, at int, value string")
    want = {(r, x): max(at for run, at, t in params if run == r and t and x[:10].lower() in t.lower()) for r, x in values if any(run == r and t and x[:10].lower() in t.lower() for run, at, t in params)}
    for held in (256, 10, 0):
        monkeypatch.setattr(samples, "HELD", held)
        assert {(r.run, r.value): r.last_at for r in samples.last_used(v, p).collect()} == want


def test_literals_without_digits_are_not_cast(spark):
    """Each spelling is found, and a text without a digit is not tried as a number, which costs an exception."""
    rows = [("R", "buy r now", True), ("R", "buy o", False), ("1234.0", "for 1,234 dollars", True), ("1e3", "1000", True), ("2024-03-05", "on March 5", True), ("nan", "0", False), ("Infinity", "9223372036854775807", False), (None, "x", False), ("x", None, False), ("7", "8", False)]
    df = spark.createDataFrame(rows, "c string, t string, want boolean").repartition(1)
    assert [tuple(r) for r in df.select("c", rubrics.literal_allowed(F.col("c"), F.col("t"))).collect()] == [(c, w) for c, _, w in rows]
    cast = df.select(rubrics.literal_allowed(F.col("c"), F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(c" in cast.split("exi")[0]
