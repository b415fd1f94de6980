"""Pages of a service: filters reach it, and what it hands out is no more than what they ask for."""

import os
import sqlite3

from pyspark.sql import functions as F

from quillstack.sources.paged import PagedStore


def test_filters_and_pages(spark, tmp_path, monkeypatch):
    file = str(tmp_path / "store.db")
    monkeypatch.setenv("PAGED_FILE", file)
    rows = [(i, "shipping" if i % 3 else "bol", i % 90, None if i % 10 == 0 else f"t{i}") for i in range(25_000)]
    with sqlite3.connect(file) as c:
        c.execute("CREATE TABLE documents (id INTEGER PRIMARY KEY, kind TEXT, day INTEGER, title TEXT)")
        c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    # workers start with this process's environment; the client reads the file's place from it
    client = tmp_path / "paged_client_here.py"
    client.write_text("import os\n" + f"os.environ['PAGED_FILE'] = {file!r}\n" + (open(os.path.join(os.path.dirname(__file__), "paged_client.py")).read()))
    spark.sparkContext.addPyFile(str(client))
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedStore)
    options = {"client": "paged_client_here:client", "table": "documents", "key": "id", "columns": "id long, kind string, day int, title string", "parts": "4", "page": "700"}
    read = lambda: spark.read.format("paged").options(**options).load()
    asked = lambda: [int(x) for x in open(file + ".log")]
    assert read().count() == 25_000 and sum(asked()) == 25_000 and max(asked()) == 700
    os.remove(file + ".log")
    found = read().filter((F.col("kind") == "bol") & (F.col("day") >= 60) & (F.col("id") < 20_000) & F.col("title").contains("7"))
    want = [r for r in rows if r[1] == "bol" and r[2] >= 60 and r[0] < 20_000 and r[3] and "7" in r[3]]
    assert sorted(map(tuple, found.collect())) == want
    assert sum(asked()) == sum(r[1] == "bol" and r[2] >= 60 and r[0] < 20_000 for r in rows)
    assert read().filter("kind = 'none'").count() == 0
