"""Exact top-k inner products by pivot-table elimination.

Vectors become whole numbers, floor(256 x).  A table holds the distances of every vector to
many pivots.  By the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) for each pivot p, and
<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so the largest of these differences bounds the
score from above.  Candidates are evaluated in the order of their bounds until the next bound
is below the k-th best score so far: what is left cannot change the answer.

The table is worked out once and stored with the vectors.  Vectors are dealt into *rings*: by their nearest
pivot, and then by their distance to it; the vectors of a large ring take turns at its blocks, so a
repeated vector, however often it occurs, is spread over many blocks.  Of each ring the driver
holds the least and largest distance to each pivot and the largest norm, pivots x ``rings`` rows whatever
the number of vectors.  By the same inequality they bound a query's score with all of a ring at once:

1. each query sees one block of its own ring; its k-th best score there is the least
   that counts;
2. rings whose bound is below that are ruled out for the query before anything is shuffled, and it is
   sent to the blocks of the others only.  Queries are grouped in the order of their own rings, and a block
   is sent to those groups of which a query asks for it.

Each task takes one group against one block and returns k rows a query at most; a last step keeps
the best k of all blocks.

Pivots are a bounded sample (``pivots`` vectors, farthest-first within ``sample`` rows); every
vector is indexed.  The answer is exact with any pivots.

Edge cases: a null vector, one with null or non-finite components, or with a null id takes no
part; finite components of any size do, their whole numbers being exact; a score beyond 64 bits is the
nearest number of 64 bits; vectors of another length than most are compared among those of the same
length; ties go to the smaller id; a row is not its own candidate, rows that repeat its id aren't
either; with fewer candidates than k all are returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, send_package, stored

SCALE = 256
ROW = "query_id long, vec_id long, score long"
_WHOLE = float(2**62)
_TABLED = "vec_id long, v array<long>, huge array<double>, dim int, far array<float>, norm double"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers), huge and dim of the vectors that take part. Where a whole number has more
    than 62 bits, v holds the nearest that has not, and huge the components themselves (else null)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(_WHOLE)), F.lit(-_WHOLE))).cast("long")
    huge = F.when(F.exists(v, lambda x: F.abs(x) * scale >= _WHOLE), F.transform(v, lambda x: x * F.lit(scale / SCALE)))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, held).alias("v"), huge.alias("huge"), F.size(vector_col).alias("dim"))


def choose_pivots(x: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first among the rows of x."""
    if not len(x):
        return x
    chosen = [int(np.argmax((x * x).sum(axis=1)))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(x)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
        return np.sqrt(np.maximum(squares, 0))


def _floats(column: pa.Array, dim: int, huge: pa.Array) -> np.ndarray:
    """Vectors as doubles, rounded where they have more than 53 bits."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
    for i in np.flatnonzero(huge.is_valid().to_numpy(zero_copy_only=False)).tolist():
        with np.errstate(over="ignore"):
            x[i] = np.array(huge[i].as_py(), float) * SCALE
    return x


def tabled(vectors: DataFrame, by_dim: dict[int, np.ndarray]) -> DataFrame:
    """Vectors with their squared norm and the row of the pivot table that is theirs, worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            rows: list[np.ndarray] = [np.zeros(0, np.float32)] * batch.num_rows
            norm = np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                take = pa.array(own)
                x = _floats(batch.column("v").take(take), dim, batch.column("huge").take(take))
                with np.errstate(over="ignore"):
                    norm[own] = (x * x).sum(axis=1)
                    far = _table(x, by_dim.get(dim, np.zeros((0, dim)))).astype(np.float32)
                for i, row in zip(own.tolist(), far, strict=True):
                    rows[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32())), pa.array(norm)], [*batch.schema.names, "far", "norm"])

    return map_arrow(vectors.select("vec_id", "v", "huge", "dim"), run, _TABLED)


def _gap(low: np.ndarray, high: np.ndarray, far: np.ndarray) -> np.ndarray:
    """How far a point with distances ``far`` to the pivots is at least from those with distances low .. high."""
    with np.errstate(invalid="ignore"):
        apart = np.maximum(far - high, low - far)
    return np.where(np.isfinite(apart), np.maximum(apart, 0), 0).max(axis=-1, initial=0)


def _rounding(norm: np.ndarray, far: np.ndarray) -> np.ndarray:
    """What rounding can add to a distance: to 24 bits, and small ones are differences of large squares."""
    return 1e-2 + 2e-6 * (far.max(axis=-1, initial=0) + np.sqrt(norm))


def _upper(gap: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """An upper bound of scores, from distances of at least ``gap`` and the sum of both squared norms."""
    with np.errstate(invalid="ignore", over="ignore"):
        bound = (norms - gap * gap) / 2 + 1 + 1e-9 * norms
    return np.where(np.isfinite(bound), bound, np.inf)


@dataclass
class Rings:
    """What the driver knows of the vectors of one length: for each ring the least and largest distances to the
    pivots, the largest squared norm, and its blocks first .. first + many - 1; ``own`` are the pivots that deal, ``cuts`` distances."""

    own: int
    cuts: list[list[float]]
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    many: np.ndarray

    def ring(self, far: np.ndarray) -> np.ndarray:
        """The ring of each row of the pivot table."""
        if not self.own or far.shape[1] < self.own:
            return np.zeros(len(far), np.int64)
        near = far[:, : self.own]
        pivot = np.where(np.isfinite(near), near, np.inf).argmin(axis=1)
        base = np.concatenate(([0], np.cumsum([len(c) + 1 for c in self.cuts])))
        return np.array([base[p] + np.searchsorted(self.cuts[p], row[p], side="right") for p, row in zip(pivot.tolist(), near, strict=True)], np.int64)

    def bounds(self, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """An upper bound of the scores of each row with each ring; below all scores for rings without vectors."""
        gap = np.stack([_gap(lo, hi, far) for lo, hi in zip(self.low, self.high, strict=True)], axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            gap = np.maximum(gap - _rounding(norm, far)[:, None] - _rounding(self.norm, np.where(np.isfinite(self.high), self.high, 0))[None, :], 0)
            upper = _upper(np.where(np.isfinite(gap), gap, 0), norm[:, None] + self.norm[None, :])
        return np.where(self.many[None, :] > 0, upper, -np.inf)


def _dealt(vectors: DataFrame, c: int, a_block: int, rings: int) -> dict[int, Rings]:
    """Rings over stored, tabled vectors: three aggregates with at most lengths x pivots x rings rows."""
    pivots = {r["dim"]: r["p"] for r in vectors.groupBy("dim").agg(F.max(F.size("far")).alias("p")).collect()}
    near = F.slice("far", 1, c)
    at = F.greatest(F.array_position(near, F.array_min(near)), F.lit(1)).cast("int")
    dealt = vectors.withColumn("pivot", F.coalesce(at, F.lit(1)) - 1).withColumn("near", F.coalesce(F.get("far", F.col("pivot")), F.lit(0.0)))
    steps = [i / rings for i in range(1, rings)] or [0.5]
    found = dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.percentile_approx("near", steps, 1000).alias("cuts")).collect()
    out: dict[int, Rings] = {}
    for dim, p in pivots.items():
        own = min(c, p)
        cuts: list[list[float]] = [[] for _ in range(max(own, 1))]
        for r in (r for r in found if r["dim"] == dim):
            wanted = min(rings, -(-r["n"] // a_block))
            cuts[r["pivot"]] = sorted({float(r["cuts"][i * rings // wanted - 1]) for i in range(1, wanted)} if rings > 1 else set())
        n = sum(len(x) + 1 for x in cuts)
        out[dim] = Rings(own, cuts, np.zeros((n, p)), np.zeros((n, p)), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64))
    most = max(pivots.values(), default=0)
    ends = [f(F.get("far", F.lit(i)).cast("double")).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(most)]
    first = 0
    for r in sorted(_ringed(vectors, out).groupBy("dim", "ring").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), *ends).collect(), key=lambda r: (r["dim"], r["ring"])):
        own, i = out[r["dim"]], r["ring"]
        own.low[i], own.high[i] = ([r[f"{name}{k}"] for k in range(own.low.shape[1])] for name in ("low", "high"))
        own.norm[i], own.first[i], own.many[i] = r["norm"], first, max(1, -(-r["n"] // a_block))
        first += int(own.many[i])
    return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their rows of the pivot table)."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        yield dim, own, batch.column("far").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)


def _ringed(vectors: DataFrame, rings: dict[int, Rings], spread: dict[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """Adds the ring, and with spread ((length, ring): first place, how many) a place: rows take turns, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            ring, place = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for dim, own, far in _by_dim(batch):
                ring[own] = rings[dim].ring(far) if dim in rings else 0
                if spread is not None:
                    first, many = np.array([spread[dim, r] for r in ring[own].tolist()], np.int64).T
                    place[own] = first + (turn + own) % many
            turn += batch.num_rows
            added = [pa.array(ring)] if spread is None else [pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "ring" if spread is None else "place"])

    return map_arrow(vectors.select("vec_id", "v", "huge", "dim", "far", "norm"), run, f"{_TABLED}, {'ring' if spread is None else 'place'} long")


def asked_blocks(queries: DataFrame, rings: dict[int, Rings], first_only: bool) -> DataFrame:
    """A row for each query (with ``least``) and block that may hold a score of its answer; with ``first_only``
    one block of its own ring, and otherwise all others that aren't ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            least = batch.column("least").to_numpy(zero_copy_only=False)
            norm = batch.column("norm").to_numpy(zero_copy_only=False)
            wanted: list[list[int]] = [[]] * batch.num_rows
            for dim, own, far in _by_dim(batch):
                if dim not in rings:
                    continue
                r = rings[dim]
                upper = r.bounds(far, norm[own])
                at_home = r.ring(far)
                for i, row, home in zip(own.tolist(), upper, at_home.tolist(), strict=True):
                    best = home if r.many[home] else int(row.argmax())
                    seen = int(r.first[best] + ids[i] % r.many[best])
                    open_ = [] if first_only else np.flatnonzero((row >= least[i]) & (r.many > 0)).tolist()
                    wanted[i] = [seen] if first_only else [b for k in open_ for b in range(r.first[k], r.first[k] + r.many[k]) if b != seen]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wanted, pa.list_(pa.int64()))], [*batch.schema.names, "blocks"])

    found = map_arrow(queries, run, f"{_TABLED}, g long, least double, blocks array<long>")
    return found.withColumn("b", F.explode("blocks")).drop("blocks")


def whole_numbers(v: list[int], huge: list[float] | None) -> list[int]:
    return v if huge is None else [floor(Fraction(x) * SCALE) for x in huge]


def search_block(asked: pa.Table, held: pa.Table, k: int, step: int = 64) -> pa.Table:
    """The k best of the block for each query, exactly, but for those whose scores are below its ``least``.

    Both tables have the columns of ``tabled``, the queries also least."""
    dim = asked.column("dim")[0].as_py()
    asked, held = asked.combine_chunks(), held.sort_by("vec_id").combine_chunks()
    one = lambda t, c: t.column(c).combine_chunks()
    numbers = lambda t, c: one(t, c).to_numpy(zero_copy_only=False)
    far_of = lambda t: one(t, "far").flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    ids, q_ids, least = numbers(held, "vec_id"), numbers(asked, "vec_id"), numbers(asked, "least")
    x, q = (_floats(one(t, "v"), dim, one(t, "huge")) for t in (held, asked))
    of_x, of_q, norm_x, norm_q = far_of(held), far_of(asked), numbers(held, "norm"), numbers(asked, "norm")
    most_x, most_q = np.abs(x).max(axis=1, initial=0), np.abs(q).max(axis=1, initial=0)
    slack_x, slack_q = _rounding(norm_x, np.where(np.isfinite(of_x), of_x, 0)), _rounding(norm_q, np.where(np.isfinite(of_q), of_q, 0))
    of_x = np.ascontiguousarray(of_x.T)

    def exact(now: np.ndarray, i: int) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            fast = most_x[now] * most_q[i] * max(dim, 1) < 2**52
        if fast.all():
            return x[now] @ q[i]
        out = np.zeros(len(now), object)
        out[fast] = (x[now[fast]] @ q[i]).astype(np.int64)
        b = whole_numbers(asked.column("v")[i].as_py(), asked.column("huge")[i].as_py())
        for n in np.flatnonzero(~fast).tolist():
            a = whole_numbers(held.column("v")[int(now[n])].as_py(), held.column("huge")[int(now[n])].as_py())
            out[n] = sum(s * t for s, t in zip(a, b, strict=True))
        return out

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        gap = np.zeros(len(x), np.float32)
        with np.errstate(invalid="ignore", over="ignore"):
            for p, own in enumerate(of_x):
                np.fmax(gap, np.nan_to_num(np.abs(own - of_q[i, p]), nan=0, posinf=0), out=gap)
            apart = gap.astype(np.float64) - slack_x - slack_q[i]
            bound = _upper(np.where(apart > 0, apart, 0), norm_q[i] + norm_x)
        open_ = np.flatnonzero((bound >= least[i]) & (ids != q_ids[i]))
        turn = open_[np.argsort(-bound[open_], kind="stable")]
        best_s, best_id, at, now_step = np.zeros(0), np.zeros(0, np.int64), 0, step
        while at < len(turn) and not (len(best_s) == k and bound[turn[at]] < best_s[-1]):
            now = turn[at : at + now_step]
            s, n = np.concatenate((best_s, exact(now, i))), np.concatenate((best_id, ids[now]))
            top = np.array(sorted(range(len(s)), key=lambda j: (-s[j], n[j]))[:k]) if s.dtype == object else np.lexsort((n, -s))[:k]
            best_s, best_id = s[top], n[top]
            at, now_step = at + len(now), now_step * 2
        found.append((np.full(len(best_id), q_ids[i]), best_id, np.array([max(min(int(v), 2**63 - 1), -(2**63)) for v in best_s], np.int64)))
    columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 24, sample: int = 2000, a_block: int = 16_000, a_group: int = 1_000, rings: int = 8, a_cell: int = 1_000) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have the columns of ``whole_vectors``.

    ``rings``: at most so many for each pivot; as many pivots deal as leave ``a_cell`` vectors for each."""
    send_package(vectors)
    near = vectors.filter("huge is null").select("v", "dim", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).collect()  # at most `sample` rows
    by_dim: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in near}:
        by_dim[dim] = choose_pivots(np.array([r["v"] for r in near if r["dim"] == dim], float).reshape(-1, dim), pivots)
    vectors, queries = stored(tabled(vectors, by_dim), "search-vectors"), stored(tabled(queries, by_dim), "search-queries")
    known = _dealt(vectors, max(1, min(pivots, vectors.count() // a_cell)), a_block, rings)
    blocks = {(dim, i): (int(r.first[i]), int(r.many[i])) for dim, r in known.items() for i in range(len(r.many))}
    held = stored(_ringed(vectors, known, blocks).withColumnRenamed("place", "b"), "search-held")
    # queries of one ring stand together, and every a_group of them are a group: small rings share one
    order, begin = {}, 0
    for r in sorted(_ringed(queries, known).groupBy("dim", "ring").count().collect()):  # as many rows as rings
        order[r["dim"], r["ring"]] = begin, r["count"]
        begin += r["count"]
    grouped = _ringed(queries, known, order).withColumn("g", F.floor(F.col("place") / a_group).cast("long")).drop("place")
    grouped = stored(grouped, "search-grouped")

    def run(key: tuple, asked: pa.Table, block: pa.Table) -> pa.Table:
        if not len(asked) or not len(block):
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        return search_block(asked, block, k)

    def search(left: DataFrame) -> DataFrame:
        """Queries against the blocks that they ask for."""
        left = stored(left, "search-asked")
        needs = stored(left.select("g", "b", "dim").distinct(), "search-needs")
        right = held.join(needs, ["b", "dim"])
        return left.groupBy("g", "b", "dim").cogroup(right.groupBy("g", "b", "dim")).applyInArrow(run, ROW)

    found = stored(search(asked_blocks(grouped.withColumn("least", F.lit(float("-inf"))), known, True)), "search-first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    known_least = found.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("found"))
    least = F.coalesce("found", F.lit(float("-inf"))).alias("least")
    left = asked_blocks(grouped.join(known_least, "vec_id", "left").select(*grouped.columns, least), known, False)
    found = found.union(search(left))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
