"""Streams over files against the same operators in batch."""

from __future__ import annotations

import random

from loomtrail.operators import changes
from loomtrail.streaming import change_stream as cs
from loomtrail.streaming import session_end
from pyspark.sql import functions as F

SCHEMA = "seq long, k long, v string, action_index long, current_index long, ts timestamp"


def rows(spark, lo, hi):
    return spark.range(lo, hi, 1, 1).select(F.col("id").alias("seq"), (F.col("id") % 5).alias("k"), (F.col("id") / 7).cast("long").cast("string").alias("v"), F.col("id").alias("action_index"), (F.col("id") + (F.col("id") % 11 == 0).cast("long")).alias("current_index"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))


def test_flags_over_two_batches_equal_the_batch_result(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for lo, hi in ((0, 60), (60, 100)):
        rows(spark, lo, hi).write.mode("append").parquet(source)
        cs.run_available(cs.state_flags(cs.kept_changes(cs.read_changes(spark, source, SCHEMA)), "k", "seq", "v"), out, mark)
    got = {tuple(r) for r in spark.read.parquet(out).select("k", "seq", "changed").collect()}
    batch = changes.changed_flag(cs.kept_changes(rows(spark, 0, 100)), "k", "seq", F.col("v")).select("k", "seq", "changed")
    assert got == {tuple(r) for r in batch.collect()}
    assert len(got) == 100 - 10


def test_late_rows_by_policy(spark):
    df = rows(spark, 0, 100)
    assert cs.kept_changes(df).count() == 90
    assert cs.kept_changes(df, late="keep").count() == 100
    assert cs.kept_changes(df, late="mark").where("late").count() == 10


def test_windows_close_behind_the_watermark(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for lo, hi in ((0, 100), (100, 200)):
        rows(spark, lo, hi).write.mode("append").parquet(source)
        cs.run_available(cs.windowed_counts(cs.read_changes(spark, source, SCHEMA), "ts", "k", "10 minutes", "0 minutes"), out, mark)
    assert spark.read.parquet(out).where("n = 2").count() >= 45


def ended(rows, steps, seconds):
    """Session by session, with all rows at hand."""
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        began, n = own[0][0], 0
        for at, _, flag in own:
            if at >= began + seconds:
                break
            n += 1
            if flag or n >= steps:
                out[k] = (n, flag or "budget_exhausted", at)
                break
        else:
            out[k] = (n, "budget_exhausted", began + seconds)
        out.setdefault(k, (n, "budget_exhausted", began + seconds))
    return out


def test_session_ends_over_restarts(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rng, schema = random.Random(9), "k long, t long, place long, flag string"
    rows = []
    for k in range(30):
        began = rng.randint(0, 500)
        times = sorted(began + rng.randint(0, 400) for _ in range(rng.randint(1, 14)))
        rows += [(k, t, i, rng.choice([None] * 9 + ["declared_complete", "declared_infeasible"])) for i, t in enumerate(times)]
    batches = [[r for r in rows if lo <= r[1] < lo + 150] for lo in range(0, 900, 150)]
    for batch in [*batches, [(999, 5000, 0, "declared_complete")], [(998, 9000, 0, None)], [(3, 1, 0, "late")]]:
        df = spark.createDataFrame(batch, schema).coalesce(1)
        df.write.mode("append").parquet(source)  # each batch is another run of the query, which goes on from its checkpoint
        stream = cs.read_changes(spark, source, schema).withColumn("ts", F.timestamp_seconds("t"))
        cs.run_available(session_end.session_ends(stream, "k", "ts", "place", "flag", 8, 300, keep=3000), out, mark)
    got = {r.k: (r.n_steps, r.reason, int(r.ended)) for r in spark.read.parquet(out).selectExpr("*", "unix_seconds(ended_at) AS ended").collect()}
    want = ended(rows, 8, 300)
    assert {k: got.get(k) for k in want} == want
    assert got[999] == (1, "declared_complete", 5000) and 998 not in got and spark.read.parquet(out).count() == len(got)
