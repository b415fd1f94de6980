import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstack.llm.common import table
from quillstack.llm.quality import NAMES, features, fit, held_out, kept, quality, scored, statistics


def test_statistics_of_slices_agree():
    texts = pa.array(["Ab c!! 12", None, "", "x x x\ny|", "É ñ", "  "])
    whole = statistics(texts)
    assert whole.shape == (6, len(NAMES)) and np.isfinite(whole).all()
    for i in range(6):
        assert np.allclose(statistics(texts.take(pa.array([i]))), whole[i])
    assert whole[3][NAMES.index("repeats")] > 0 and whole[0][NAMES.index("bangs")] > 0
    assert len(statistics(pa.array([], pa.string()))) == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    got = quality(table(spark, folder, "documents"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    right = (got.predicted == got.quality).mean()
    lost = ((got.predicted == 0) & (got.quality == 1)).sum() / (got.quality == 1).sum()
    assert right > 0.97 and lost < 0.02, (right, lost)


def test_cases(spark, docs, odd):
    labels = spark.createDataFrame([(i, q) for i, q in ((1, 0), (2, 1), (4, 1), (7, 0), (8, 1), (3, None), (None, 1), (5, 7))], "doc_id long, quality int")
    frame = docs(*odd)
    got = quality(frame, labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    none = scored(features(frame), fit(features(frame), labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality(docs(), labels).count() == 0
    model = fit(features(frame), labels)
    stay = kept(frame, model)
    assert stay.columns == frame.columns and stay.count() <= len(odd)


def test_held_out_rows_teach_nothing(spark, docs):
    rows = [(i, f"word{i % 5} and more {'!!' * (i % 2)}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (fit(features(docs(*rows)), x) for x in (labels, flipped))
    assert np.allclose(a.middle, b.middle) and np.allclose(a.classes[0][1], b.classes[0][1])


def test_against_a_plain_discriminant(spark, small):
    """The same densities from whole matrices, determinants and solved equations."""
    documents, labels = table(spark, small, "documents"), table(spark, small, "labels")
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    taught = [i for i in texts if known.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    x = statistics(pa.array([texts[i] for i in taught], pa.string()))
    y = np.array([known[i] for i in taught])
    middle, spread = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    z = (x - middle) / spread
    p, shrink, temper = len(NAMES), 0.05, 4.0

    def density(v):
        out = []
        for k in (0, 1):
            own = z[y == k]
            cov = np.cov(own.T, bias=True)
            cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / p, 0.05) * np.eye(p)
            d = v - own.mean(axis=0)
            out.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d * np.linalg.solve(cov, d.T).T).sum(axis=1))
        return out

    ids = sorted(texts)
    low, high = density((statistics(pa.array([texts[i] for i in ids], pa.string())) - middle) / spread)
    want = dict(zip(ids, 1 / (1 + np.exp(-np.clip((high - low) / temper, -500, 500))), strict=True))
    got = {r.doc_id: r.score for r in quality(documents, labels).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in ids)
