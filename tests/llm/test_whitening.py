import math

import numpy as np

from quillstack.llm.whitening import fit, whiten, whitening_report, whole_numbers

SCHEMA = "vec_id long, embedding array<float>, x int, dim string, w int, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "d", 2, 3) for i, v in rows], SCHEMA)


def plainly(rows):
    """Whole numbers, deviations and an eigendecomposition by NumPy alone, and by Python's own integers."""
    sound = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(sound), range(len(sound[0][1]))
    sums = [sum(x[d] for _, x in sound) for d in dims]
    deviations = [sum((n * x[d] - sums[d]) ** 2 for d in dims) for _, x in sound]
    x = np.array([x for _, x in sound], float)
    x = x - np.array(sums) / n
    v = x.T @ x / n
    values, vectors = np.linalg.eigh(v)
    return [i for i, _ in sound], n, deviations, x, v, values[::-1], vectors[:, ::-1]


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 12)) @ np.diag(np.linspace(0.05, 1.5, 12))
    vectors[50:150] = vectors[50]  # a hot vector
    rows = list(enumerate(vectors.tolist()))
    rows += [(1000, None), (1001, [None, *[1.0] * 11]), (1002, [float("nan"), *[1.0] * 11]), (1003, [float("-inf"), *[1.0] * 11]), (None, [0.5] * 12), (3, [0.25] * 12)]
    got = whitening_report(table(spark, rows))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = got.collect()
    ids, n, deviations, x, v, values, vectors = plainly(rows)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted(zip(map(str, ids), deviations, strict=True))
    for c in range(8):
        own = {(r.vec_id, r.deviation): r for r in got if r.component == c + 1}
        want = x @ vectors[:, c] / math.sqrt(values[c])
        have = np.array([own[i, d].whitened for i, d in zip(ids, deviations, strict=True)])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert {round(r.explained, 12) for r in own.values()} == {round(values[c] / np.trace(v), 12)}
    white = np.array([[r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == i][:8] for i in range(4, 300)])
    assert white.shape == (296, 8)


def test_no_variance_and_few_rows(spark):
    same = whiten(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert all(r.w == [0.0] * 3 and r.explained == [0.0] * 3 and r.deviation == 0 and r.identity_error == 1.0 for r in same)
    two = whiten(table(spark, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0])])).collect()
    assert all(np.allclose(np.abs(r.w), [1, 0, 0]) and np.allclose(r.explained, [1, 0, 0]) for r in two)
    assert [r.component for r in sorted(whitening_report(table(spark, [(7, [1.0])])).collect())] == [1]


def test_lengths_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=2 + i % 2).tolist()) for i in range(40)] + [(90, [])]
    got = whiten(table(spark, rows)).collect()
    assert sorted((len(r.w), r.n) for r in got) == [(0, 1)] + [(2, 20)] * 20 + [(3, 20)] * 20
    assert whitening_report(table(spark, rows)).count() == 20 * 5
    assert whitening_report(table(spark, [])).count() == 0 and whitening_report(table(spark, [(1, None)])).count() == 0


def test_large_entries(spark):
    rows = [(i, [10.0 ** (i % 30), -(10.0 ** (i % 7)), 1.0]) for i in range(60)]
    got = whiten(table(spark, rows)).collect()
    assert len(got) == 60 and all(np.isfinite(r.w).all() for r in got) and all(r.deviation > 0 for r in got)
    assert max(r.deviation for r in got) == 2**63 - 1


def test_model(spark):
    rows = [(i, [float(i % 3), float(i % 5), float(i % 2)]) for i in range(30)]
    model = fit(whole_numbers(table(spark, rows)), 3, 2)
    assert model.n == 30 and model.sums == [sum(1024 * int(v[d]) + 100_000 for _, v in rows) for d in range(3)]
    assert np.allclose(model.components @ model.components.T, np.eye(2)) and model.eigenvalues[0] >= model.eigenvalues[1]
    assert model.explained.sum() < 1
