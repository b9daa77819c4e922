"""Repairs of edges, cycles and compositions against plain loops."""

from __future__ import annotations

import contextlib
import hashlib
import io
import itertools
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomtrail.operators import audits, bundles, changes, checks, compositions, graphs, relations, repairs, sampling
from loomtrail.plans import documents, modular


def test_long_chains_take_few_joins(spark, monkeypatch):
    """A chain of 1,000 links ends after 10 rounds; circles, and what leads into them, have no end."""
    n = 1000
    rows = [(i, i - 1) for i in range(1, n + 1)] + [(5001, 5002), (5002, 5003), (5003, 5001), (5004, 5001), (5005, 5005)]
    df, rounds = spark.createDataFrame(rows, "at long, to long"), []
    count = type(df).count
    monkeypatch.setattr(type(df), "count", lambda self: rounds.append(1) or count(self))
    out = {r.at: (r.end, r.hops) for r in repairs.follow_pointers(df).collect()}
    assert out == {i: (0, i) for i in range(1, n + 1)} and len(rounds) <= 13


def repaired(edges, ports, final):
    """Link by link."""
    out, feeds = {}, {}
    for e in sorted(edges):
        feeds[e[3], e[4]] = (e[1], e[2])
    kinds = {}
    for node, port, is_output, literal in ports:
        k = kinds.setdefault((node, port), [False, None])
        k[0], k[1] = k[0] or is_output, max(filter(None, (k[1], literal)), default=None)
    for edge, a, ap, b, bp in edges:
        at, hops, seen, passed = (a, ap), 0, set(), False
        while at in kinds and not kinds[at][0] and kinds[at][1] is None and at in feeds and feeds[at][0] != at[0] and (final or hops < 1):
            if at in seen:
                passed = True
                break
            seen.add(at)
            at, hops = feeds[at], hops + 1
        literal = kinds[at][1] if at in kinds and not kinds[at][0] and (final or hops == 0) else None
        if a == b:
            out[edge] = ("dropped_self_edge", a, ap, None)
        elif passed:
            out[edge] = ("kept", a, ap, None)
        elif literal is not None:
            out[edge] = ("literal_copied", a, ap, literal)
        elif hops:
            out[edge] = ("rewired_to_producer", *at, None)
        else:
            out[edge] = ("kept", a, ap, None)
    return out


@pytest.mark.parametrize("final", [True, False])
def test_repair_edges(spark, final):
    rng = random.Random(3)
    for _ in range(4):
        nodes = range(9)
        ports = [(n, p, p == "out", "lit" if p != "out" and rng.random() < 0.1 else None) for n in nodes for p in ("x", "y", "out") if rng.random() < 0.8]
        edges = [(i, rng.choice(nodes), rng.choice(["x", "y", "out", "none"]), rng.choice(nodes), rng.choice(["x", "y"])) for i in range(22)]
        e = spark.createDataFrame([("t", *x) for x in edges], "task string, edge int, from_node int, from_port string, to_node int, to_port string")
        p = spark.createDataFrame([("t", *x) for x in ports], "task string, node int, port string, is_output boolean, literal string")
        got = {r.edge: (r.repair, r.from_node, r.from_port, r.literal) for r in repairs.repair_edges(e, p, "task", final).collect()}
        assert got == repaired(edges, ports, final)
    odd = spark.createDataFrame([("t", 1, None, "x", 2, "x"), (None, 2, 1, "x", 2, "y")], e.schema)
    assert {(r.edge, r.repair) for r in repairs.repair_edges(odd, p, "task", final).collect()} == {(1, "kept"), (2, "kept")}
    assert repairs.repair_edges(e.limit(0), p, "task", final).count() == 0


def components(edges):
    reach = {(a, b) for a, b in edges if a is not None and b is not None}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    on = {a: min(b for b, c in reach if (a, b) in reach and (b, a) in reach and b == c or b == a) for a, b in reach if a == b}
    return {(n, c, sum(x == c for x in on.values())) for n, c in on.items()}


@pytest.mark.parametrize("chunk", [graphs.CHUNK, 0, 12])
def test_cycle_members(spark, monkeypatch, chunk):
    """In one task, by labels only, and by labels until few edges are left."""
    monkeypatch.setattr(graphs, "CHUNK", chunk)
    rng = random.Random(8)
    graphs_ = [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((12, 14), (20, 40), (30, 33))]
    graphs_ += [[], [(1, 1), (1, 2), (2, 3)], [(None, 1), (1, None), (2, 3), (3, 2), (2, 2)], [(3, 1), (1, 2), (2, 1), (2, 4), (4, 5), (5, 4), (5, 0)]]
    for edges in graphs_:
        df = spark.createDataFrame(edges, "a int, b int")
        assert {tuple(r) for r in graphs.cycle_members(df, "a", "b").collect()} == components(edges)


def test_cycles_of_many_small_graphs(spark, monkeypatch):
    """Small graphs are settled at once, however many there are and however deep: only their connected parts take rounds."""
    monkeypatch.setattr(graphs, "CHUNK", 40)
    rounds, own = [], graphs.least_reaching
    monkeypatch.setattr(graphs, "least_reaching", lambda *a: rounds.append(1) or own(*a))
    edges = [(10 * g + k, 10 * g + k + 1) for g in range(30) for k in range(9)] + [(10 * g + k + 1, 10 * g + k) for g in range(30) for k in (2, 3, 6)]
    got = {tuple(r) for r in graphs.cycle_members(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(10 * g + k, 10 * g + c, m) for g in range(30) for k, c, m in ((2, 2, 3), (3, 2, 3), (4, 2, 3), (6, 6, 2), (7, 6, 2))}
    assert len(rounds) <= 1



def test_graphs_wider_and_deeper_than_before(spark):
    chain = spark.range(70).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(71).select(F.col("id").alias("node"))
    assert graphs.depths(nodes, "node", chain, "a", "b").agg(F.max("longest")).first()[0] == 70
    assert graphs.component_ratio(nodes, "node", chain, "a", "b").first().largest == 71
    circle = chain.where("b < 3").union(spark.createDataFrame([(2, 0)], "a long, b long"))
    assert graphs.closure(circle, "a", "b").count() == 9
    assert {(r.source, r.target, r.length) for r in graphs.path_lengths(circle, "a", "b").collect()} == {(a, b, (b - a) % 3 or 3) for a in range(3) for b in range(3)}
    with pytest.raises(ValueError):
        graphs.carry_distances(circle, "a", "b", 3)


def form(members, edges):
    h = [hashlib.md5(str(m).encode()).hexdigest() for m in members]
    for _ in range(len(members) - 1):
        h = [
            hashlib.md5("|".join([str(m), ",".join(sorted(f"+{o}>{i}:{h[t]}" for s, o, t, i in edges if s == p)), ",".join(sorted(f"-{o}>{i}:{h[s]}" for s, o, t, i in edges if t == p))]).encode()).hexdigest()
            for p, m in enumerate(members)
        ]
    return hashlib.md5(",".join(sorted(h)).encode()).hexdigest()


def canonical(members, edges):
    """The least way to write a composition, over all orders of its members."""
    n = range(len(members))
    return min((tuple(members[p[k]] for k in n), tuple(sorted((p.index(s), o, p.index(t), i) for s, o, t, i in edges))) for p in itertools.permutations(n))


def beams(sizes, fits, rounds, width, budget, low, high):
    out = {}
    for seed in sizes:
        beam = [((seed,), (), 0)]
        for k in range(1, rounds + 1):
            found = {}
            for members, edges, score in beam:
                for p, m in enumerate(members):
                    for a, o, b, i, fit in fits:
                        if a == m and not (len(members) == 1 and b == m):
                            g = (*members, b), (*edges, (p, o, len(members), i))
                            found[canonical(*g)] = (*g, score + fit)
                        if b == m and not (len(members) == 1 and a == m) and not any(t == p and i == x for _, _, t, x in edges):
                            g = (*members, a), (*edges, (len(members), o, p, i))
                            found[canonical(*g)] = (*g, score + fit)
            assert len({form(*x[:2]) for x in found.values()}) == len(found)
            good = sorted((g for g in found.values() if low <= sum(sizes[m] for m in g[0]) <= high), key=lambda g: (-g[2], form(*g[:2])))
            beam = [g for g in good[:budget] if g[2] % 5][:width]
            out.update({(seed, k, form(*g[:2])): (canonical(*g[:2]), g[2], sum(sizes[m] for m in g[0])) for g in beam})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_beam_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {m: rng.randint(1, 4) for m in range(6)}
    fits = list({(a, rng.choice("xy"), b, rng.choice("uv")): rng.randint(1, 12) for a, b in itertools.product(sizes, sizes) if rng.random() < 0.4}.items())
    fits = [(*k, v) for k, v in fits]
    modules = spark.createDataFrame(list(sizes.items()), "module long, n_nodes long")
    df = spark.createDataFrame(fits, "a long, out string, b long, into string, score long")
    for width, budget in ((3, 9), (2, 3)):
        got = compositions.beam_rounds(modules, df, 3, width, budget, F.col("score") % 5 != 0, 3, 11).collect()
        assert {(r.seed, r.round, r.form): (canonical(r.members, [tuple(e) for e in r.edges]), r.score, r.n_nodes) for r in got} == beams(sizes, fits, 3, width, budget, 3, 11)
    cut = {tuple(r) for r in compositions.best_fits(df, 1).collect()}
    want = {min((f for f in fits if f[:2] == key), key=lambda f: (-f[4], f[2], f[3])) for key in {f[:2] for f in fits}} | {min((f for f in fits if f[2:4] == key), key=lambda f: (-f[4], f[0], f[1])) for key in {f[2:4] for f in fits}}
    assert cut == want
    assert compositions.beam_rounds(modules, df.limit(0), 3, 2, 2, F.lit(True), 1, 99).count() == 0


def test_beam_reads_fits_once(spark):
    """However many rounds there are, what fits what is worked out once."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    fits = spark.createDataFrame(spark.sparkContext.parallelize([(m, "x", (m + 1) % 4, "u", m + 1) for m in range(4)], 1).map(seen), "a long, out string, b long, into string, score long")
    modules = spark.createDataFrame([(m, 1) for m in range(4)], "module long, n_nodes long")
    assert compositions.beam_rounds(modules, fits, 3, 2, 4, F.lit(True), 1, 9).count() > 0
    assert read.value == 4


def test_closure_reads_records_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    items = spark.createDataFrame([("/t/1", "/r/1", "/f/1"), ("/t/1", "/r/2", None), ("/t/2", None, "/f/2"), ("/t/3", "/t/1", "/f/3"), (None, "/r/4", "/f/1")], "trajectory string, review string, fixed string")
    rows = [("/t/1", "/s/a.jsonl#line=3", None), ("/t/1", "/s/a.jsonl#line=4", "my AGENT-x"), ("/f/1", "/p/b.jsonl", "other"), ("/t/2", "/q/c.jsonl", "agent-x"), ("/f/3", "/u/d.jsonl", "agent-x"), ("/t/3", "/v/#line=x", ""), ("/t/3", None, "agent-x"), (None, "/w/e", "agent-x")]
    records = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "path string, source string, agent string")
    files = spark.createDataFrame([(p,) for p in ("/t/1", "/t/1", "/t/3", "/f/1", "/s/a.jsonl", "/s/probe.json", "/v/probe.json", "/q/probe.json", "/n", None)], "path string")
    got = sorted(tuple(r) for r in bundles.file_closure(items, ["trajectory", "review"], "trajectory", records, files, "probe.json", "messages.json", "agent-x", "fixed").collect())
    assert got == sorted([
        ("/t/1", "required", "review"), ("/t/2", "missing", "trajectory"), ("/t/3", "required", "trajectory"), ("/r/1", "required", "review"), ("/r/2", "required", "review"), ("/r/4", "required", "review"),
        ("/f/1", "required", "repaired"), ("/f/3", "missing", "repaired"), ("/s/a.jsonl", "required", "source"), ("/s/probe.json", "required", "sidecar"), ("/s/messages.json", "missing", "messages"),
        ("/p/b.jsonl", "missing", "source"), ("/v/#line=x", "missing", "source"), ("/v/probe.json", "required", "sidecar"),
    ])
    assert read.value == len(rows)


def test_relations(spark):
    rng = random.Random(4)
    a = spark.createDataFrame([(i, f"n{i}") for i in range(300)], "a_id long, a_name string")
    b = spark.createDataFrame([(i, rng.randrange(300), f"n{rng.randrange(300)}" if i else None, rng.randrange(310), "t" * 40) for i in range(900)], "b_no long, b_id long, b_label string, b_most long, b_kind string")
    v = relations.column_values({"a": a, "b": b})
    got = {(r.from_column, r.to_column): r.contained for r in relations.inclusions(v).collect()}
    assert got == {("b_id", "a_id"): 1.0, ("a_id", "b_no"): 1.0, ("b_label", "a_name"): 1.0}
    some = {(r.from_column, r.to_column): r.contained for r in relations.inclusions(v, 0.9).collect()}
    most = {r.b_most for r in b.collect()}
    assert abs(some["b_most", "a_id"] - sum(x < 300 for x in most) / len(most)) < 1e-9
    found = {r.from_column: (r.to_column, r.rule, r.type_column) for r in relations.relations(v, [("b_kind", "b_most")]).collect()}
    assert found == {"b_id": ("a_id", "name", None), "b_label": ("a_name", "values", None), "b_most": (None, "polymorphic", "b_kind")}


def test_inclusions_count_all_values(spark, monkeypatch):
    """A pair is found however its values are hashed, over as many columns as there are, and a number is no text."""
    by_hash = [r.id for r in spark.range(1000).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    key = spark.createDataFrame([(i, str(i)) for i in by_hash[150:]], "k_id long, k_text string")
    some = spark.range(1000).select(F.col("id").alias("s_id"), (F.col("id") % 2).cast("int").alias("s_two"))
    for bits in (60, 2, 1):
        monkeypatch.setattr(relations, "_BITS", bits, raising=False)
        got = {(r.from_column, r.to_column): (r.contained, r.size) for r in relations.inclusions(relations.column_values({"key": key, "some": some}), 0.8).collect()}
        got.pop(("s_two", "k_id"), None)
        assert got == {("s_id", "k_id"): (0.85, 1000), ("k_id", "s_id"): (1.0, 850)}


def test_keys_are_confirmed_without_keeping_values(spark, data, monkeypatch):
    """What is kept between steps follows from the schema, not from the rows."""
    kept, keep = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: kept.append(self.count()) or keep(self, *a))
    assert modular.schema_prompt(spark, data).count() == 7
    assert kept and max(kept) < 100


def test_values_are_shuffled_once(spark, data, monkeypatch):
    """Values go straight to their columns: one exchange by value, one of the sets of columns, none by column and value before."""
    plans, keep = [], type(spark.range(1)).checkpoint

    def plan(self, *a):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            self.explain()
        plans.append(out.getvalue())
        return keep(self, *a)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", plan)
    assert modular.schema_prompt(spark, data).count() == 7
    assert [p.count("Exchange ") for p in plans] == [2]


def test_keys_on_odd_tables(spark, data, tmp_path):
    """A null lies in no key, a key may hold a value twice, and an empty column lies in every key: as its SQL has it."""
    tables = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in documents.TABLES}
    tables["customer"] = tables["customer"].withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey")))
    tables["part"] = tables["part"].union(tables["part"].limit(3))
    tables["supplier"] = tables["supplier"].limit(0)
    tables["region"] = tables["region"].union(tables["region"].limit(1).withColumn("r_regionkey", F.lit(None).cast("int")))
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name, query, sql in (("key_inference", documents.key_inference, documents.ORACLE), ("schema_prompt", modular.schema_prompt, modular.ORACLE)):
        got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(sql[name]).fetchall())
    pairs = {(r.from_column, r.to_column) for r in documents.key_inference(spark, str(tmp_path)).collect()}
    assert pairs == {("n_regionkey", "r_regionkey"), ("s_nationkey", "n_nationkey"), ("o_custkey", "c_custkey"), ("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey")}


def test_shards_and_digests_in_levels(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 5003).alias("k"))
    got = {r.id: r.shard for r in sampling.shards(rows.repartition(9), ["k"], "g", 7).collect()}
    want = {}
    for g in (None, 0, 1):
        own = sorted((r.k, r.id) for r in rows.collect() if r.g == g)
        want |= {i: n % 7 for n, (_, i) in enumerate(own)}
    assert got == want
    one = changes.table_digest(rows, ["id", "g"], leaf=4).first()
    assert one == changes.table_digest(rows.orderBy(F.desc("k")).repartition(5), ["id", "g"], leaf=4).first() and one.n_rows == 5000
    assert one.digest != changes.table_digest(rows.where("id <> 77"), ["id", "g"], levels=2).first().digest
    assert changes.table_digest(rows.limit(0), ["id"]).first().digest is not None


@pytest.mark.parametrize("span", [2, 100])
def test_first_readers(spark, monkeypatch, span):
    """The next reader behind a node, within a step of positions and beyond it, equal facts or wildcards, against all pairs."""
    monkeypatch.setattr(audits, "SPAN", span)
    rng = random.Random(4)
    places = {n: (rng.choice([None, *range(12)]), rng.choice("pq")) for n in range(30)}
    facts = [[(rng.randrange(32), "t", rng.choice("cd"), rng.choice(["e:1", "e:2", "e:3", "e:*", None])) for _ in range(25)] for _ in range(2)]
    meets = lambda x, y: x[1:3] == y[1:3] and (str(x[3]).endswith(":*") or str(y[3]).endswith(":*") or (x[3] is not None and x[3] == y[3]))
    found = {}
    for x, y in itertools.product(*facts):
        p, q = (places.get(z[0], (None,))[0] for z in (x, y))
        if meets(x, y) and p is not None and q is not None and q > p:
            found.setdefault(x[0], []).append((q, y[0], places[y[0]][1]))
    dirty, reads = (spark.createDataFrame(f, "node long, table string, column string, entity string") for f in facts)
    place = spark.createDataFrame([(n, *p) for n, p in places.items()], "node long, position long, app string")
    assert {r.node: tuple(r.w) for r in audits._first_readers(dirty, reads, place).collect()} == {n: min(w) for n, w in found.items()}


def test_port_compatibility_of_one_type(spark, tmp_path):
    """Pairs of a single type are made in many tasks, all of them."""
    from loomtrail.plans import joins

    spark.range(400).selectExpr("id AS p_partkey", "'T' AS p_type", "id % 3 AS p_size", "'B' AS p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = joins.port_compatibility(spark, str(tmp_path)).cache()
    assert df.count() == df.distinct().count() == 20 * 399
    assert df.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism


def test_port_compatibility_writes_little_per_pair(spark, tmp_path):
    """Pairs that differ by their input alone lie together, so files of all pairs are small; nulls score no points, and a null type or key has no pair."""
    from loomtrail.plans import joins

    rows = [(k if k % 701 else None, "T" if k % 97 else None, k * 7919 % 5 or None, f"B{k * 104729 % 4}" if k % 3 else None) for k in range(1, 4001)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    joins.port_compatibility(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    typed = [r for r in rows if r[0] and r[1]]
    want = sorted((a, b, 50 + 30 * (x is not None and x == y) + 20 * (u is not None and u == v)) for a, _, x, u in typed if a % 20 == 0 for b, _, y, v in typed if a != b)
    out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert list(zip(*(out.sort_values(["src", "dst"])[c].tolist() for c in ("src", "dst", "score")), strict=True)) == want
    runs = [sum(1 for _ in itertools.groupby(zip(*(t[c].to_pylist() for c in ("src", "score")), strict=True))) for t in map(pq.read_table, (tmp_path / "out").glob("*.parquet"))]
    assert len(runs) > 4 and sum(runs) < len(want) / 8


def test_chains_of_tasks_that_fit_take_no_rounds(spark, monkeypatch):
    """Whole tasks are followed in one pass, in several chunks, or by rounds where they are larger than a chunk, with one result."""
    rng = random.Random(5)
    ports = [(f"t{t}", f"n{k}", "in", False, "v" if k % 17 == 3 else None) for t in range(6) for k in range(40)] + [(f"t{t}", f"n{k}", "out", True, None) for t in range(6) for k in range(40)]
    edges = [(f"t{t}", t * 100 + k, f"n{rng.randrange(k) if k % 9 else (k + 1) % 40}", "out" if rng.random() < 0.1 else "in", f"n{k}", "in") for t in range(6) for k in range(1, 40)]
    e = spark.createDataFrame(edges, "task string, edge long, from_node string, from_port string, to_node string, to_port string")
    p = spark.createDataFrame(ports, "task string, node string, port string, is_output boolean, literal string")
    rounds = repairs.follow_pointers
    got = []
    for chunk in (0, 100, 1 << 18):
        called = []
        monkeypatch.setattr(repairs, "CHUNK", chunk)
        monkeypatch.setattr(repairs, "follow_pointers", lambda x: called.append(1) or rounds(x))
        got.append(sorted(map(str, repairs.repair_edges(e, p, "task").collect())))
        assert bool(called) == (chunk == 0)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(edges)
    assert {"rewired_to_producer", "literal_copied", "kept"} <= {r.repair for r in repairs.repair_edges(e, p, "task").collect()}


def test_cycles_of_parts_are_found_without_a_search_for_them(spark, monkeypatch):
    """With a column of parts the result is the same, with parts that fit a task and with larger ones, and those that fit are not searched for."""
    rng = random.Random(11)
    made = [(t, f"{t}-{rng.randrange(12)}", f"{t}-{rng.randrange(12)}") for t in range(8) for _ in range(3 + 2 * t)]
    df = spark.createDataFrame(made + [(1, None, "1-1"), (1, "1-2", None)], "t int, a string, b string")
    want = sorted(map(tuple, graphs.cycle_members(df, "a", "b").collect()))
    assert any(members > 1 for _, _, members in want)
    connected = graphs._connected
    for chunk, searched in ((1 << 18, False), (8, True)):
        called = []
        monkeypatch.setattr(graphs, "CHUNK", chunk)
        monkeypatch.setattr(graphs, "_connected", lambda e: called.append(1) or connected(e))
        assert sorted(map(tuple, graphs.cycle_members(df, "a", "b", "t").collect())) == want
        assert bool(called) == searched


def _faults(nodes, ports, edges):
    """What is wrong with tasks, by plain loops."""
    text = lambda *x: " ".join(y for y in x if y is not None)
    empty = lambda x: x is None or not x.strip(" ")
    out = set()
    bad, loose = (lambda t, n, *x: out.add((t, n, "INVALID_GROUNDING", text(*x)))), (lambda t, n, *x: out.add((t, n, "UNBOUND_PORT", text(*x))))
    for t, n, op, app in nodes:
        same = [x for x in nodes if x[:2] == (t, n)]
        for wrong, *what in ((empty(n), "node without an id"), (len(same) > 1, "duplicate node", n), (op not in ("R", "A"), "unknown operation", op), (empty(app), "no app")):
            _ = wrong and bad(t, n, *what)
    fed = [(t, x, y) for t, _, _, _, x, y, _ in edges]
    for t, n, p, is_out, source, ground in ports:
        if is_out is False:
            _ = source == "upstream" and ((t, n, p) not in fed or None in (t, n, p)) and loose(t, n, "lacks an edge", p)
            _ = source in ("world", "literal") and empty(ground) and bad(t, n, "lacks stable grounding", p)
            _ = source not in checks.SOURCES and bad(t, n, "invalid source", p)
        _ = is_out and empty(ground) and bad(t, n, "lacks grounding", p)
    of = lambda side: {x[:3] for x in ports if x[3] is side and None not in x[:3]}
    for t, e, a, p, b, q, kind in edges:
        same = [x[4] for x in edges if x[:2] == (t, e)]
        _ = empty(e) and bad(t, b, "edge without an id")
        _ = len(same) > 1 and bad(t, min((x for x in same if x is not None), default=None), "duplicate edge", e)
        _ = kind not in checks.KINDS and bad(t, b, "unknown dependency kind", e)
        _ = (t, a, p) not in of(True) and loose(t, a, "source is no output", e)
        _ = (t, b, q) not in of(False) and loose(t, b, "target is no input", e)
        _ = fed.count((t, b, q)) > 1 and loose(t, b, "several producers", q)
    for n, least, _ in components([((t, a), (t, b)) for t, _, a, _, b, _, _ in edges if a is not None and b is not None]):
        out.add((*n, "GLOBAL_CONSTRAINT_UNSAT", f"on a cycle with {least[1]}"))
    return out


def test_structure_of_tasks_dealt_already_is_not_shuffled(spark):
    """All faults are found, with nulls too, and where the tables are dealt by task only the nodes of cycles are shuffled."""
    rng = random.Random(23)
    pick = lambda *x: rng.choice(x)
    node = lambda: pick("a", "b", "c", "d", " ", None)
    nodes = [(t, node(), pick("R", "A", "X", None), pick("s", "", None)) for t in range(9) for _ in range(5)]
    ports = [(t, node(), pick("i", "o", None), pick(True, False, False, None), pick(*checks.SOURCES, "file", None), pick("g", "", None)) for t in range(9) for _ in range(8)]
    edges = [(t, pick("e", "f", "g", "h", "", None), node(), pick("i", "o", None), node(), pick("i", "o", None), pick(*checks.KINDS, "x", None)) for t in range(9) for _ in range(7)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols).repartition(3, "task")
    df = checks.structure_issues(frame(nodes, "task long, node string, op string, app string"), frame(ports, "task long, node string, port string, is_output boolean, source string, grounding string"), frame(edges, "task long, edge string, from_node string, from_port string, to_node string, to_port string, kind string"), ["R", "A"])
    got = [(r.task, r.node, r.code, r.detail) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == _faults(nodes, ports, edges)
    assert {r.severity for r in df.collect()} == {"error"} and len({d.split(" ")[0] + d.split(" ")[1] for *_, d in got}) >= 14
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("ENSURE_REQUIREMENTS") <= 1


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_parts_of_edges_are_cut_where_they_end(size):
    """However the rows are cut into batches, parts are settled whole, and the edges of those that are too large pass."""
    rows = []
    for part, n in enumerate([5, 1, 8, 2, 9, 5, 12, 3]):
        rows += [(f"{part}-{k}", f"{part}-{(k + 1) % n}", n) for k in range(n)]  # a circle of n nodes
    table = pa.table({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "x": [r[0] for r in rows], "y": [r[1] for r in rows], "n": pa.array([r[2] for r in rows], pa.int64())})
    out = [tuple(r.values()) for b in graphs._within(8)(iter(table.to_batches(size))) for r in b.to_pylist()]
    roots = {a: root for a, b, root in out if root is not None}
    assert sorted((a, b) for a, b, root in out if root is None) == sorted(r[:2] for r in rows if r[2] > 8)
    assert set(roots) == {r[0] for r in rows if r[2] <= 8} and all(roots[r[0]] == roots[r[1]] for r in rows if r[2] <= 8) and len(set(roots.values())) == 6
