import math
from fractions import Fraction

import numpy as np
import pytest

import pyarrow as pa

from quillstack.llm import pivot_search
from quillstack.llm.pivot_search import _dealt, _table, asked_blocks, choose_pivots, search_block, tabled, top_k, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, v int, dim string, score int"


def brute(rows, queries, k=5):
    sound = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float)]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if q in queries:
            scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in sound if i != q and len(b) == len(a)))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("pivots", [0, 1, 24])
def test_against_brute_force(spark, pivots):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8))
    vectors[50:90] = vectors[50]  # ties and a hot vector
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] + [0.0] * 7), (1003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1005, [0.0] * 8), (1006, [1.0, 2.0]), (1050, [1.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 1, "d", 2) for i, v in rows], SCHEMA)
    w = whole_vectors(frame)
    got = top_k(w, w.filter("vec_id % 50 = 0"), pivots=pivots, a_block=60, a_group=4, a_cell=50).collect()
    assert {tuple(r) for r in got} == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0})


def test_empty_and_few(spark):
    none = whole_vectors(spark.createDataFrame([], SCHEMA))
    assert top_k(none, none).count() == 0
    two = whole_vectors(spark.createDataFrame([(0, [1.0], 1, "", 1), (1, [2.0], 1, "", 1)], SCHEMA))
    assert [tuple(r) for r in top_k(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]


def clustered(n, centres=20, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 300
    x = np.floor(middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 5)
    return np.floor(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * 1000)


def test_elimination_skips_candidates(monkeypatch):
    x = clustered(4000)
    far = _table(x, choose_pivots(x[:500], 24)).astype(np.float32)

    def rows(ids, x, far, **more):
        many = len(ids)
        columns = {"vec_id": pa.array(ids), "v": pa.array(x.astype(int).tolist(), pa.list_(pa.int64())), "huge": pa.nulls(many, pa.list_(pa.float64())), "dim": pa.array([16] * many, pa.int32()), "far": pa.array(list(far), pa.list_(pa.float32())), "norm": pa.array((x * x).sum(axis=1))}
        return pa.table(columns | {k: pa.array([v] * many) for k, v in more.items()})

    seen, product = [], np.ndarray.__matmul__

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return product(np.asarray(self), np.asarray(other))

    floats = pivot_search._floats
    monkeypatch.setattr(pivot_search, "_floats", lambda *a: floats(*a).view(Counted))
    block = rows(np.arange(4000), x, far)
    search = lambda least: search_block(rows([-1], x[:1], far[:1], least=least), block, 5).to_pydict()["score"]
    best = sorted((x @ x[0]).astype(int).tolist(), reverse=True)[:5]
    assert search(float("-inf")) == best
    assert 0 < sum(seen) < 2000
    before = sum(seen)
    assert [s for s in search(float(best[-1])) if s >= best[-1]] == best and sum(seen) - before <= before


def test_rings_are_ruled_out_before_the_shuffle(spark):
    """Clustered vectors: few of all pairs of query and block are sent, and the answer is exact."""
    x = clustered(6000)
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(i, v, 1, "d", 2) for i, v in rows], SCHEMA)
    w = whole_vectors(frame)
    queries = w.filter("vec_id % 50 = 0")
    shipped = []

    def counted(queries, rings, first_only):
        out = asked_blocks(queries, rings, first_only).cache()
        shipped.append((out.count(), sum(int(r.many.sum()) for r in rings.values())))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pivot_search, "asked_blocks", counted)
        got = {tuple(r) for r in top_k(w, queries, a_block=100, a_group=20, a_cell=250).collect()}
    assert got == brute(rows, set(range(0, 6000, 50)))
    blocks = shipped[0][1]
    assert blocks >= 40 and sum(n for n, _ in shipped) < 120 * blocks / 5


def test_blocks_are_bounded(spark):
    """A third of all rows are one vector and have one id: they fill blocks in turn."""
    rows = [(7 if i % 3 == 0 else i, [1.0, 2.0] if i % 3 == 0 else [float(i % 11), float(i % 7)]) for i in range(1500)]
    w = whole_vectors(spark.createDataFrame([(i, v, 1, "d", 2) for i, v in rows], SCHEMA))
    t = tabled(w, {2: np.array([[0.0, 0.0], [2560.0, 0.0]])}).cache()
    rings = _dealt(t, 2, 100, 4)[2]
    assert rings.many.sum() >= 15
    got = {tuple(r) for r in top_k(w, w.filter("vec_id = 50"), a_block=100, a_cell=100).collect()}
    assert {(q, n, s) for q, n, _, s in got} == {(q, n, s) for q, n, _, s in brute(rows, {50})}


def test_large_numbers(spark):
    """Components of any size: products beyond a double's 53 bits, beyond 64 bits, and beyond what a double can hold."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 10.0 ** (i % 12)]) for i in range(120)]
    rows += [(500, [1e30, 0.0, 0.0, 0.0]), (501, [-1e30, 3.0, 0.0, 0.0]), (550, [3e38, -3e38, 0.0, 1.0]), (551, [2e16, 0.5, -1.0, 0.25])]
    for schema, more in ((SCHEMA, []), (SCHEMA.replace("float", "double"), [(600, [1e300, 1.0, 0.0, -1e300]), (601, [1e308, 1e-3, 0.0, 0.0]), (602, [-1e308, 1e308, 0.0, 0.0])])):
        frame = spark.createDataFrame([(i, v, 1, "d", 2) for i, v in rows + more], schema)
        w = whole_vectors(frame)
        got = {tuple(r) for r in top_k(w, w.filter("vec_id % 50 = 0"), a_block=30, a_group=2, a_cell=20).collect()}
        clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
        exact = [(i, v) for i, v in rows + more]
        sound = [(i, [math.floor(Fraction(x if more else float(np.float32(x))) * 256) for x in v]) for i, v in exact]
        for q, a in sound:
            if q % 50:
                continue
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in sound if i != q)[:5]
            own = sorted((n, i, s) for g, n, i, s in got if g == q)
            assert [s for _, _, s in own] == [clip(-s) for s, _ in best]
            if abs(best[0][0]) < 2**63 and abs(best[-1][0]) < 2**63:
                assert [i for _, i, _ in own] == [i for _, i in best]
