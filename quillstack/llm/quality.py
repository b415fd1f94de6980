"""Quality scores from a regularised quadratic discriminant.

Statistics of each whole text (sizes, shares of kinds of characters, repetition of words) go
through variance-stabilising transforms: logarithms for sizes, arc sines of square roots for
shares.  Each class is a normal density with its own mean and a covariance shrunk towards a
multiple of the identity on standardised statistics.  The score is the logistic of the
tempered difference of Mahalanobis log densities, from Cholesky factors kept in the model.

The fit reads every labelled row: tasks send sums, products and counts, 2 x (1 + p + p(p+1)/2)
numbers, which Spark adds up; no row goes to the driver.

Edge cases: null and empty texts have all statistics zero and get a score; rows with a null
label, a label other than 0 and 1, or a null id teach nothing; with a class missing among the
labels every score is the share of label 1 (0.5 without labels); repeated rows score alike;
other columns of the documents are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, send_package, stored
from .tokens import slices

NAMES = ("log_bytes", "log_words", "log_word_bytes", "spaces", "upper", "digits", "stops", "bangs", "signs", "bars", "others", "wide", "lines", "ends_signed", "repeats", "distinct")
_KINDS = 12
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    kind = np.full(256, 10, np.uint8)
    kind[128:] = 9
    for k, characters in enumerate((" \t\r\v\f", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"-()", "!", "#$%&*@^~", "|<>{}[]\\/=+_`", "\n")):
        kind[np.frombuffer(characters.encode(), np.uint8)] = k
    return kind


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of transformed statistics, in the order of NAMES."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.zeros((0, len(NAMES)))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    kind = _kinds()[raw]
    row = np.repeat(np.arange(n, dtype=np.int64) * _KINDS, sizes)
    count = np.bincount(row + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    blank = (kind == 0) | (kind == 8)
    starts = ~blank
    starts[1:] &= blank[:-1]
    first = offsets[:-1][sizes > 0]
    starts[first] = ~blank[first]
    words = np.bincount(row[starts] // _KINDS, minlength=n).astype(float)
    last = np.ones(len(raw), bool)
    last[:-1] = blank[1:]
    last[offsets[1:][sizes > 0] - 1] = True
    signed = (kind >= 5) & (kind <= 7) & last
    ends = np.bincount(row[signed] // _KINDS, minlength=n).astype(float)
    total = np.maximum(sizes.astype(float), 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    many = np.maximum(words, 1)
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
    cut = pc.ascii_split_whitespace(texts)
    of_word = np.diff(cut.offsets.to_numpy())
    code = cut.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    in_doc = np.repeat(np.arange(n), of_word)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (in_doc[1:] == in_doc[:-1])
    repeats = np.bincount(in_doc[again], minlength=n)
    pair = np.sort(in_doc * (int(code.max(initial=0)) + 1) + code)
    fresh = np.ones(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    distinct = np.bincount(in_doc[fresh], minlength=n)
    inked = sizes - count[:, 0] - count[:, 8]
    return np.column_stack(
        [
            np.log1p(sizes),
            np.log1p(words),
            np.log1p(inked / many),
            share(count[:, 0] + count[:, 8], total),
            share(count[:, 2], letters),
            *(share(count[:, k], total) for k in (3, 4, 5, 6, 7, 10, 9)),
            share(count[:, 8], many),
            share(ends, many),
            share(repeats, many),
            np.log1p(distinct) - np.log1p(of_word),
        ]
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "x"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, x array<double>")


@dataclass
class QualityModel:
    """Standardisation, and for each class its log prior less half the log determinant, mean and inverse Cholesky factor."""

    middle: np.ndarray
    spread: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray]]
    share: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.share)
        z = (x - self.middle) / self.spread
        low, high = (c - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for c, mean, inverse in self.classes)
        return 1 / (1 + np.exp(-np.clip((high - low) / self.temper, -500, 500)))


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0)


def fit(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrink: float = 0.05, temper: float = 4.0) -> QualityModel:
    """Learns from all rows of ``features`` whose id has a label and isn't held out."""
    p = len(NAMES)
    upper = np.triu_indices(p)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + p + len(upper[0])))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own)[upper]))
        cells = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], cells), pa.int32()), pa.array(np.tile(np.arange(cells), 2), pa.int32()), pa.array(sums.ravel())], ["y", "cell", "v"])

    sums = map_arrow(found.join(known, "doc_id").select("x", "y"), run, "y int, cell int, v double")
    got = np.zeros((2, 1 + p + len(upper[0])))
    for r in sums.groupBy("y", "cell").agg(F.sum("v").alias("v")).collect():  # as many rows as cells
        got[r["y"], r["cell"]] = float(f"{r['v']:.12g}")
    counts = got[:, 0]
    if not counts.all():
        return QualityModel(np.zeros(p), np.ones(p), [], float(counts[1] / counts.sum()) if counts.sum() else 0.5, temper)

    def moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, second = v[1 : 1 + p] / v[0], np.zeros((p, p))
        second[upper] = v[1 + p :] / v[0]
        second = second + np.triu(second, 1).T
        return mean, second - np.outer(mean, mean)

    middle, whole = moments(got.sum(axis=0))
    spread = np.sqrt(np.maximum(np.diag(whole), 1e-8))
    classes = []
    for v in got:
        mean, cov = moments(v)
        cov = cov / np.outer(spread, spread)
        cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / p, 0.05) * np.eye(p)
        factor = np.linalg.cholesky(cov)
        constant = np.log(v[0] / counts.sum()) - np.log(np.diag(factor)).sum()
        classes.append((float(constant), (mean - middle) / spread, np.linalg.inv(factor)))
    return QualityModel(middle, spread, classes, float(counts[1] / counts.sum()), temper)


def scored(found: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for rows of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(found, run, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the model accepts. Only texts go to Python and only a flag
    comes back, so rows stay where they are: no shuffle, and other columns cost nothing."""
    send_package(docs)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
        return pa.array(np.concatenate([np.zeros(0, bool), *(model.score(statistics(p.column("text"))) >= threshold for p in parts)]))

    return docs.filter(accepted(F.col(text_col).cast("string")))


def quality(docs: DataFrame, labels: DataFrame, shrink: float = 0.05, temper: float = 4.0) -> DataFrame:
    found = stored(features(docs), "quality-features")
    return scored(found, fit(found, labels, shrink=shrink, temper=temper))
