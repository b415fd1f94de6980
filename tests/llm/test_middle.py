import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm.middle import DELIMITER, ESCAPE, fill_in_middle, middle_report, restored
from quillstack.llm.queries import OP11_SQL


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plainly(i, t, units=list, seed=1):
    """(n, form, prefix, middle, suffix, output) by slicing."""
    t = t or ""
    u, h = units(t), sha(f"{seed}:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(u)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, None, t
    a, b, c = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    return (n, "spm", a, b, c, f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else (n, "psm", a, b, c, f"<P>{a}<S>{c}<M>{b}")


TEXTS = ["", None, "a", "ab", "<P>", "x<S>y", "<<M", "<P<S<M", "é😀漢́z" * 5, f"a{DELIMITER}b{ESCAPE}c{ESCAPE}d{DELIMITER}{DELIMITER}", f"{ESCAPE}e{ESCAPE}", "line one\nline two\r\n\n  three", "$0 \\1 $", "\x00\x85  w", " \t\n ", "word " * 2000]


@pytest.mark.parametrize("unit, cut", [("character", list), ("word", lambda t: re.findall(r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", t)), ("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t))])
def test_against_slices(docs, unit, cut):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(20 * len(TEXTS))] + [(None, "no id"), (5, "again"), (5, "again")]
    got = fill_in_middle(docs(*rows), unit=unit).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:1] + tuple(r)[2:] for r in got))) == sorted(repr((i, *plainly(i, t, cut), t or "")) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("<PSM>ab\x1e\x1bed$\\😀")), min_size=1, max_size=30))
def test_any_text_comes_back(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fill_in_middle(frame, percent=100).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert [r.back for r in sorted(got)] == texts
    assert [r.n for r in sorted(got)] == list(map(len, texts))


def test_rates_and_markers(spark):
    frame = spark.createDataFrame([(i, "some text") for i in range(400)], "doc_id long, text string")
    forms = lambda **k: {r.form: r["count"] for r in fill_in_middle(frame, **k).groupBy("form").count().collect()}
    assert forms(percent=0) == {"plain": 400} and forms(percent=100, spm_percent=100) == {"spm": 400}
    assert forms() != forms(seed=2) and 300 < 400 - forms()["plain"] < 400
    own = ("<|pre|>", "<|suf|>", "<|mid|>")
    made = fill_in_middle(frame, percent=100, markers=own)
    assert all(r.back == r.text and r.output.startswith("<|") for r in made.withColumn("back", restored(F.col("output"), F.col("form"), own)).collect())
    with pytest.raises(ValueError):
        fill_in_middle(frame, markers=("<P>", "<P>", "<M>"))


def test_odd_empty_and_long(spark, docs, odd):
    long_ = "ä" * 3_000_000 + "<"
    rows = [*odd, (77, long_)]
    got = middle_report(docs(*rows)).collect()
    want = [(i, *plainly(i, t)) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, n, f, None if a is None else len(a), None if b is None else len(b), sha(o), sha(t or ""))) for (i, t), (_, n, f, a, b, _, o) in zip(rows, want, strict=True))
    assert middle_report(docs()).count() == 0


def test_sql_and_plan(spark, small):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    made = middle_report(spark.read.parquet(f"{small}/documents.parquet"))
    assert dict(made.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    want = c.execute(f"SELECT {', '.join(made.columns)} FROM ({OP11_SQL})").fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert all(r.restored_sha256 == r[1] for r in made.join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id").select("restored_sha256", F.sha2("text", 256)).collect())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
