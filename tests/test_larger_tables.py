"""Queries against their SQL where keys are larger than in the given tables, or rows lie otherwise."""

import io
import random
import re
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstack import queries as Q
from quillstack.functions import text as T
from quillstack.operators import marks
from quillstack.operators.marks import related_pairs
from quillstack.operators.orders import notes
from quillstack.plans.prefix_join import prefix_join
from quillstack.plans.tiled_join import tiled_join
from quillstack.sources import office

from .test_queries import rows


@pytest.fixture
def against_sql(spark, tmp_path):
    """check(query, table=frame, ...): the query over these tables gives what its SQL gives."""

    def check(name, **tables):
        c = duckdb.connect()
        for t, frame in tables.items():
            frame.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        want = c.execute(Q.oracle_sql()[name]).df()
        got = Q.queries()[name](spark, str(tmp_path)).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns and len(want)
        assert rows(got, columns) == rows(want, columns)

    return check


def test_house_numbers_of_five_digits(spark, against_sql):
    against_sql("same_sites", supplier=spark.range(990, 1_100).union(spark.range(9_990, 10_050)).withColumnRenamed("id", "s_suppkey"))


def test_site_numbers_of_five_digits(spark, against_sql):
    nation = spark.range(25).selectExpr("cast(id as int) n_nationkey", "'NATION_' || id n_name")
    keys = spark.range(9_990, 10_050).union(spark.range(99_990, 100_010))
    against_sql("ship_to_keys", nation=nation, supplier=keys.selectExpr("id s_suppkey", "cast(id % 25 as int) s_nationkey"))


def test_line_numbers_that_could_equal_the_order_s_own(spark, against_sql):
    """P700007 is order 100,007's number and part 7's."""
    orders = spark.createDataFrame([(100_007, 5), (100_012, 6), (3, 7), (4, 8)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame([(100_007, 7, 1), (100_012, 12, 1), (100_012, 17, 2), (3, 22, 1), (3, 23, 2)], "l_orderkey long, l_partkey long, l_linenumber int")
    against_sql("order_warnings", orders=orders, lineitem=lines.withColumn("l_quantity", F.lit(2.0)))


def test_no_side_of_a_prefix_join_is_broadcast(spark):
    """The driver would hold a side whose files are small and whose rows are not."""
    a, b = (spark.range(50).selectExpr(f"id {k}", f"'name' || id k{k}") for k in "ab")
    pairs = prefix_join(a, b, "ka", "kb")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = sorted((i, j) for i in range(50) for j in range(50) if f"name{i}".startswith(f"name{j}") or f"name{j}".startswith(f"name{i}"))
    assert sorted((r.a, r.b) for r in pairs.select("a", "b").collect()) == want


def test_tiled_join_against_a_join(spark):
    a = spark.range(3_000).selectExpr("id a", "if(id % 3 = 0, 'hot', string(id % 40)) k").union(spark.range(2).selectExpr("9000 a", "'1' k"))
    b = spark.range(2_000).selectExpr("id b", "if(id % 5 = 0, 'hot', string(id % 60)) k")
    got = tiled_join(a, b, "k", 50)
    want = a.join(b, "k")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_pairs_of_names_are_not_shuffled(spark):
    """Neither to be told apart nor to meet: rows sent are a small share of the pairs."""
    prints = spark.range(6_000).selectExpr("id", "'Brand ' || id % 3 || '.png' name")
    pairs = related_pairs(prints)
    assert pairs.count() == 3 * 2_000 * 1_999 // 2 and pairs.distinct().count() == pairs.count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[a#" not in plan


def test_rows_of_one_place_are_dealt_over_tasks(spark, against_sql, tmp_path):
    """Keys of rows that are written alike are worked out once, and no place is paired in one task."""
    orders = spark.range(4_000).selectExpr("id o_orderkey", "id * 7 % 90 o_custkey", "timestamp_ntz'2024-01-01' o_orderdate")
    against_sql("same_place_same_courier", orders=orders, supplier=spark.range(150).withColumnRenamed("id", "s_suppkey"))
    plan = Q.queries()["same_place_same_courier"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [place#" in plan and "__l#" in plan


def test_sound_pairs_are_worked_out_once_a_row(spark):
    """Not again for each value and each order, which made the work grow with the square of their number."""
    rows_ = spark.createDataFrame([(["a", "b", "c"], ["x", "y", "z"], {0: "x ", 2: "z", 9: "q"}), (["a"], ["x"], {0: "x"}), (["a", "b"], ["x", "x"], {0: "x"}), (["a", "b"], ["x", "y"], None), (None, ["x"], {0: "x"})], "v array<string>, o array<string>, g map<int,string>")
    found = rows_.select(T.assign_one_to_one(F.col("v"), F.col("o"), F.col("g")).alias("m"))
    assert [r.m for r in found.collect()] == [{0: "x ", 1: "y", 2: "z"}, {}, {0: "x"}, None, {}]
    assert found._jdf.queryExecution().analyzed().toString().count("map_filter(") == 1


def test_a_sheet_packs_only_its_own_part():
    """Parts that are the same in every file are packed once; the files stay whole packages."""
    sheets = [[[str(i), f"é <&> {i}", "x" * i], []] for i in range(40)]
    office.xlsx(sheets[0])
    made = Counter()
    real = zipfile.ZipFile.writestr
    with pytest.MonkeyPatch.context() as m:
        m.setattr(zipfile.ZipFile, "writestr", lambda self, *a, **k: (made.update(["parts"]), real(self, *a, **k)))
        files = [office.xlsx(s) for s in sheets]
    assert made["parts"] == 0
    for s, f in zip(sheets, files, strict=True):
        z = zipfile.ZipFile(io.BytesIO(f))
        assert z.testzip() is None and len(z.namelist()) == 5 and office.xlsx_rows(f) == s
    table = zipfile.ZipFile(io.BytesIO(office.docx([["a", "b\nc"]])))
    assert table.testzip() is None and table.namelist()[-1] == "word/document.xml" and office.docx_rows(office.docx([["a", "b\nc"]])) == [["a", "b\nc"]]


def test_notes_are_cut_in_one_pass(spark):
    """As places of all notes and quantities in the whole text have it, with one cut of a document in the plan."""
    parts = ["Order Line Notes: CPO LINE 4", "order  line notes:cpo#3-5, 9", "5.00 EA", "EA 7.5", "1.2.50 EA", "12.5 EA 3.0", " EA", ".5 EA", " ", "\n", "Widget", "12\n", "-" * 230]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(300)]
    got = notes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("(?=") == 1
    note, before, after = (re.compile(x, re.I) for x in (r"Order\s+Line\s+Notes:\s*CPO\s*(?:LINES?\s*)?#?\s*([0-9]+(?:\s*[-,]\s*[0-9]+)*)", r"(\d+\.\d+)\s+EA\b", r"EA\s*(\d+\.\d+)"))
    want = set()
    for k, t in enumerate(texts):
        found = list(note.finditer(t))
        quantities = sorted((m.end(), float(m[1])) for p in (before, after) for m in p.finditer(t))
        for i, m in enumerate(found):
            q = [v for end, v in quantities if end <= m.start()]
            want.add((k, i, " ".join(m[1].split()), q[-1] if q else None, t[max(m.start() - 400, 0) : m.start()], m[0], t[m.end() : found[i + 1].start() if i + 1 < len(found) else None]))
    assert {(r.doc_id, r.ordinal, r.spec, r.quantity, r.back, r.note, r.after) for r in got.collect()} == want


def test_only_prints_outside_the_largest_cluster_ask_all(spark, monkeypatch):
    rng = random.Random(4)
    h = [rng.getrandbits(63) for _ in range(120)]
    h[110], h[111], h[112] = h[5] ^ 7, h[109] ^ 3, h[109] ^ 15  # 109, 111 and 112 match among themselves, 110 matches 5
    prints = spark.createDataFrame([(i, h[i], 1.0, 50, "brand.png" if i < 100 else chr(ord("a") + i - 100) * 6 + ".png") for i in range(120)], "id long, h long, aspect double, ink int, name string")
    asked, real = [], marks.matched
    monkeypatch.setattr(marks, "matched", lambda a, b, *c: (asked.append(a.count()), real(a, b, *c))[1])
    monkeypatch.setattr(marks, "_FIRST", 10, raising=False)
    got = {r.id: r.cluster for r in marks.clusters(prints).collect()}
    assert got == {i: 0 if i < 100 or i == 110 else 109 if i in (109, 111, 112) else i for i in range(120)}
    assert sum(asked) < 40
