"""op11 against numpy's dense solver and exact whole-number sums; inertia, slices and contour integration on hard spectra; odd rows."""

import numpy as np
import pytest

from ledgerloom.llm import queries, whitening


def brute(vectors, top=32):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, v, e[::-1][:top], u[:, ::-1][:, :top], centred, deviations


def test_query_equals_dense_solver(spark, sf_dir):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = list(table)
    n, v, e, u, centred, deviations = brute([table[i] for i in ids])
    rows = queries.op11_whitening(spark, sf_dir).toPandas()
    assert len(rows) == 32 * n and set(rows.n) == {n} and rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    deviation = dict(zip(ids, deviations))
    assert all(deviation[i] == d for i, d in zip(rows.vec_id, rows.deviation))
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[ids]
    assert list(wide.columns) == list(range(1, 33))
    want = centred @ (u / np.sqrt(e))
    signs = np.sign((wide.to_numpy() * want).sum(axis=0))
    assert np.abs(wide.to_numpy() - want * signs).max() < 1e-8
    share = rows.groupby("component").explained.first()
    assert np.abs(share.to_numpy() / (e / np.trace(v)) - 1).max() < 1e-10


@pytest.mark.parametrize("values", [[7.0], [8.0, 4.0, 2.0, 1.0, 1.0], [3.0, 3.0, 3.0], [5.0] * 12 + [1.0] * 30, list(range(1, 61)), [1e6, 1.0, 1 + 1e-9, 1e-3] + [0.0] * 40, [2.0 + k * 1e-7 for k in range(50)]])
def test_slices_and_contours_on_hard_spectra(values):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = q * np.array(values) @ q.T
    v = (v + v.T) / 2
    own = np.sort(values)[::-1]
    for s in (own.max() * 1.1, own.max() * 0.9, own.mean() * 0.97, own[own > 0].min() * 0.5):
        assert whitening.above(v, s) == (own > s).sum()
    parts = whitening.slices(v, 32, 8)
    found = [whitening.feast(v, *p) for p in parts]
    e = np.sort(np.concatenate([f[0] for f in found]))[::-1]
    want = own[own > own.sum() * 1e-10]
    assert len(e) >= min(32, len(want)) and np.abs(e[:32] - want[: len(e)][:32]).max() < 1e-11 * own.sum()
    for e, u in found:
        assert np.abs(v @ u - u * e).max() < 1e-11 * own.sum()


def test_slices_that_do_not_match_their_count_are_an_error():
    with pytest.raises(RuntimeError):
        whitening.feast(np.diag([1.0, 2.0, 3.0]), 0.5, 2.5, 3, rounds=3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [1.0, 0.0, 0.5]), (2, [0.0, 2.0, 0.5]), (2, [0.0, 2.0, 0.5]), (None, [-3.0, 1.0, 0.5]), (5, [1e3, 7.0, 0.5])]
    odd = [(6, None), (7, [nan, 1.0, 1.0]), (8, [1.0, inf, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0]), (11, []), (12, [1e300, 1.0, 1.0])]
    table = spark.createDataFrame([(a, b, 0.5, "x") for a, b in fine + odd], "vec_id long, embedding array<double>, whitened double, component string")
    rows = whitening.whiten(whitening.usable(table)).collect()
    n, v, e, u, centred, deviations = brute([x for _, x in fine])
    assert n == 5 and len(rows) == 2 * n and {r.component for r in rows} == {1, 2}  # the third dimension has no variance
    assert sorted(int(r.deviation) for r in rows) == sorted(2 * deviations) and max(abs(r.identity_error) for r in rows) < 1e-4
    one = [r for r in rows if r.component == 1]
    assert np.allclose(sorted(abs(r.whitened) for r in one), sorted(abs(centred @ u[:, 0] / np.sqrt(e[0]))))
    for few in (table.where("false"), table.where("vec_id = 1"), table.where("vec_id = 2")):
        assert whitening.whiten(whitening.usable(few)).collect() == []
    wide = spark.createDataFrame([(1, [2.0**54, 0.0]), (2, [-(2.0**54), 1.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    own = brute([[2.0**54, 0.0], [-(2.0**54), 1.0], [0.5, 0.0]])
    assert {int(r.deviation) for r in whitening.whiten(whitening.usable(wide)).collect()} == {d for d in own[5] if d < 10**38}


def test_sums_do_not_depend_on_tasks(spark, sf_dir):
    rows = whitening.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    n, s = whitening.totals(rows)
    v = whitening.covariance(rows, n, s)
    again = rows.repartition(7)
    assert (n, s) == whitening.totals(again) and (v == whitening.covariance(again, n, s)).all()
