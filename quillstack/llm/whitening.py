"""Embedding whitening: principal components scaled to unit variance.

Vectors become whole numbers, floor(scale * c) + shift, so that counts, sums and what is centred
with them are exact whatever the order in which tasks are added up:

1. Tasks send sums per dimension, which Spark adds up: n and S.
2. Rows n*x - S are whole numbers, centred exactly.  MLlib's ``RowMatrix`` over them computes the
   Gramian matrix in a tree of partial sums; divided by n (and by n^2 for the scale of the rows) it is
   the covariance V.
3. ``eigh`` of V, dim x dim, on the driver; the matrix dim x components is broadcast, and
   ``mapInPandas`` projects the rows.
4. The covariance of what comes out is checked the same way: centred with its own means, Gramian
   matrix, divided by n.

The broadcast holds dim x components numbers and the Gramian matrix dim x dim, whatever the number of
rows.  No row is shuffled.  Rows are read back from tables in the shared folder in each pass.

Edge cases: a null vector and one with null or non-finite entries are dropped; an empty vector
stays but has no components; vectors of different lengths are fitted and whitened among those of
their own length (one fit a length); with fewer dimensions than components all dimensions are
given; a component without variance (repeated rows only, or fewer rows than dimensions) whitens to
0 and explains 0, and then the identity error is 1; repeated rows and null ids are rows like others;
whole numbers beyond 2^53 are held there, and a deviation beyond 64 bits is the largest number of 64
bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, send_package, stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_FAR = float(2**53)


@dataclass
class Whitening:
    """n vectors with sums S per dimension; eigenvalues falling, a row of ``components`` each; trace of V."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else np.zeros(len(self.eigenvalues))

    @property
    def matrix(self) -> np.ndarray:
        """dim x components: centred x times this is whitened."""
        scale = np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, np.inf))
        return self.components.T / scale


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (whole numbers) and dim of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(_FAR)), F.lit(-_FAR))).cast("long") + F.lit(shift).cast("long"))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.size(vector_col).alias("dim"))


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def sums_of(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors, and their exact sums: dim numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            x = _rows(batch, dim)
            small = np.abs(x).max(initial=0) < 2**62 // max(len(x), 1)
            total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([*map(str, total), str(n)])], ["cell", "v"])

    rows = map_arrow(vectors.select("x"), run, "cell int, v string")
    found = {r["cell"]: int(r["v"] or 0) for r in rows.groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}  # dim + 1 rows
    return found.get(dim, 0), [found.get(i, 0) for i in range(dim)]


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """n * x - S, as doubles that hold the whole numbers exactly up to 2^53."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    low, left = F.array(*map(F.lit, whole)), F.array(*(F.lit(float(r)) for r in rest))
    return F.zip_with(F.zip_with(x, low, lambda a, b: (a - b).cast("double") * n), left, lambda a, b: a - b)


def gramian(rows: DataFrame, column: Column) -> np.ndarray:
    """The sum of outer products of an array column's rows, by MLlib."""
    vectors = rows.select(array_to_vector(column).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Means, covariance and its leading eigenvectors over all rows of ``whole_numbers``, all of length dim."""
    send_package(vectors)
    n, sums = sums_of(vectors, dim)
    if not n or not dim:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0)
    v = gramian(vectors, centred(F.col("x"), n, sums)) / n / n / n
    values, columns = np.linalg.eigh((v + v.T) / 2)
    values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
    values = np.where(values > 16 * dim * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    return Whitening(n, sums, values, columns.T, float(np.trace(v)))


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the components w (an array) of each row."""
    send_package(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, matrix = shared.value
        dim = len(sums)
        low, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        for frame in frames:
            off = np.array(frame["x"].tolist(), np.int64).reshape(len(frame), dim) - low
            if (float(np.abs(off).max(initial=0)) + 1) ** 2 * n * n * dim < 2**62:
                exact = ((off * n - rest) ** 2).sum(axis=1)
            else:
                exact = [min(sum((int(a) * n - int(b)) ** 2 for a, b in zip(row, rest, strict=True)), 2**63 - 1) for row in off]
            # an explicit sum per row: a row's numbers don't depend on its neighbours in the batch
            w = np.column_stack([((off - rest / n) * c).sum(axis=1) for c in matrix.T]) if matrix.shape[1] else np.zeros((len(off), 0))
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "deviation": np.array(exact, np.int64), "w": list(w)})

    return vectors.select("vec_id", "x").mapInPandas(run, "vec_id long, deviation long, w array<double>")


def identity_error(found: DataFrame, n: int, many: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    if not many or not n:
        return 0.0
    means = found.agg(*(F.avg(F.col("w")[i]).alias(str(i)) for i in range(many))).first()
    own = F.zip_with("w", F.array(*(F.lit(float(m)) for m in means)), lambda a, b: a - b)
    return float(np.abs(gramian(found, own) / n - np.eye(many)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, w, explained (arrays over components) and identity_error of each vector that takes part."""
    rows = stored(whole_numbers(vectors, id_col, vector_col), "whiten-vectors")
    lengths = sorted(r["dim"] for r in rows.select("dim").distinct().collect())  # one, unless models were mixed
    out = None
    for dim in lengths or [0]:
        own = rows.filter(F.col("dim") == dim)
        model = fit(own, dim, components)
        found = stored(whitened(own, model), "whitened")
        shares = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
        error = identity_error(found, model.n, len(model.eigenvalues))
        found = found.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "w", shares.alias("explained"), F.lit(error).alias("identity_error"))
        out = found if out is None else out.unionByName(found)
    return out


def whitening_report(vectors: DataFrame) -> DataFrame:
    """A row for each vector and component."""
    each = F.posexplode(F.arrays_zip(F.col("w"), F.col("explained")))
    rows = whiten(vectors).select("vec_id", "n", "deviation", "identity_error", each.alias("at", "of"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.w").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
