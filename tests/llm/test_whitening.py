"""Whitening against one matrix in memory, with exact integers where they are asked for."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomtrail.llm import whitening
from loomtrail.llm.queries import QUERIES


def by_definition(vecs: list[list[float]], most: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Deviations, whitened rows up to signs, shares and eigenvalues."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vecs]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x])
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    return deviation, centred @ vector / np.sqrt(value), value / np.trace(cov), value


def check(rows: list, vecs: dict[int, list[float]], most: int) -> None:
    deviation, white, share, value = by_definition(list(vecs.values()), most)
    got = {r.id: r for r in rows}
    assert len(rows) == len(vecs) and {r.n for r in rows} == {len(vecs)}
    assert [int(got[k].deviation) for k in vecs] == deviation
    y = np.array([got[k].whitened for k in vecs])
    assert y.shape == white.shape
    for k in range(white.shape[1]):
        gap = min([abs(value[k] - v) / value[k] for j, v in enumerate(value) if j != k], default=1)
        if gap > 1e-6:
            assert np.abs(y[:, k] * np.sign(y[:, k] @ white[:, k]) - white[:, k]).max() < 1e-6
    assert np.allclose(rows[0].explained, share, rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    assert np.abs(np.cov(y.T, bias=True).reshape(len(share), -1) - np.eye(len(share))).max() < 1e-9


@pytest.mark.parametrize(("d", "tile", "scale"), [(7, 3, 1.0), (20, 64, 1.0), (33, 8, 1e4), (5, 2, 1e9)])
def test_by_definition(spark, d, tile, scale):
    rng = np.random.default_rng(d)
    x = (rng.standard_normal((400, d)) @ rng.standard_normal((d, d)) + rng.standard_normal(d)) * scale
    vecs = {i: v for i, v in enumerate(x.tolist())}
    df = spark.createDataFrame([(i, v, "e") for i, v in vecs.items()], "vec_id long, embedding array<double>, explained string").repartition(5)
    check(whitening.whiten(df, tile=tile, most=9).collect(), vecs, min(9, d))


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    good = {i: v for i, v in enumerate(rng.standard_normal((50, 4)).tolist())}
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([*good.items(), *odd], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(whitening, "BLOCK", 12)
    check(whitening.whiten(df, tile=3).collect(), good, 4)
    twice = spark.createDataFrame([(i if i > 3 else None, v) for i, v in [*good.items()] * 2], "vec_id long, embedding array<double>")
    out = whitening.whiten(twice).collect()
    assert len(out) == 100 and {r.n for r in out} == {100} and sum(r.id is None for r in out) == 8 and out[0].identity_error < 1e-9
    for few in (df.where("vec_id >= 100 and vec_id <> 105"), df.limit(0), df.where("vec_id = 1"), spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")):
        assert whitening.whiten(few).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(30)], "vec_id long, embedding array<double>")
    out = whitening.whiten(flat).collect()
    assert len(out) == 30 and len(out[0].whitened) == 1 and abs(out[0].explained[0] - 1) < 1e-9


def test_query(spark, data):
    rows = QUERIES["op13_whitening"](spark, data).collect()
    table = pq.read_table(f"{data}/embeddings.parquet").to_pylist()
    vecs = {r["vec_id"]: r["embedding"] for r in table if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])}
    deviation, white, share, _ = by_definition(list(vecs.values()), 32)
    y = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(y) == len(vecs) * 32
    own = np.array([[y[k, c].whitened for c in range(1, 33)] for k in vecs])
    assert np.abs(own * np.sign((own * white).sum(axis=0)) - white).max() < 1e-6
    assert [y[k, 1].deviation for k in vecs] == deviation
    assert np.allclose([y[next(iter(vecs)), c].explained for c in range(1, 33)], share) and max(r.identity_error for r in rows) < 1e-9
