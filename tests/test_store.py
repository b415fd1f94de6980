"""Kept tables: what an upsert rewrites, what a page reads."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import resolve, scoring
from quillstack.operators.history import page
from quillstack.plans.first_independent import first_independent
from quillstack.sources.ranged import RangedTable
from quillstack.sources.snapshot import KeyedSnapshot
from quillstack.sources.trigrams import TrigramIndex, _gathered
from quillstack.streaming.latest import fresh_answers

SCHEMA = "k long, t int, v string, bucket string"


def table(spark, *rows):
    return spark.createDataFrame([(*r, "b") for r in rows], SCHEMA)


def rows(frame):
    return sorted((r.k if r.k is not None else -1, r.t, r.v) for r in frame.collect())


def test_upserts_rewrite_their_buckets_only(spark, tmp_path):
    s = KeyedSnapshot(spark, str(tmp_path), ["k"], ["t"], buckets=8)
    assert s.upsert(table(spark)) == 0 and s.versions() == []
    assert s.upsert(table(spark, *((k, 1, "a") for k in range(200)))) == 1
    before = s.manifest()["places"]
    assert len(before) == 8 and sum(n for _, n in before.values()) == 200
    assert s.upsert(table(spark, (7, 2, "b"), (7, 3, "c"), (7, 3, "b"))) == 2
    after = s.manifest()["places"]
    assert sum(after[b] != before[b] for b in before) == 1
    assert rows(s.read()) == sorted((k, 1, "a") if k != 7 else (7, 3, "c") for k in range(200))
    # a repeated batch, older rows and ties change nothing
    assert s.upsert(table(spark, (7, 2, "b"), (7, 3, "c"), (8, 1, "z"))) == 2 and s.manifest()["places"] == after
    assert rows(s.read(1)) == [(k, 1, "a") for k in range(200)]
    assert rows(s.lookup(table(spark, (7, 0, ""), (999, 0, "")))) == [(7, 3, "c")]
    s.vacuum()
    assert s.versions() == [2] and s.read().count() == 200


def test_any_batches_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(3), {}
    s = KeyedSnapshot(spark, str(tmp_path), ["k"], ["t"], buckets=5, rows_a_file=7)
    for n in range(6):
        batch = [(rng.choice([None, *range(40)]), rng.randint(0, 9), rng.choice("abc")) for _ in range(30)]
        s.upsert(table(spark, *batch), ("q", n))
        best = {}
        for k, t, v in batch:
            best[k] = max((t, v), best.get(k, (t, v)))
        for k, (t, v) in best.items():
            if k not in want or t > want[k][0]:
                want[k] = (t, v)
        gone = rng.sample(range(40), 3)
        s.delete(table(spark, *((k, 0, "") for k in gone)))
        want = {k: v for k, v in want.items() if k not in gone}
        assert rows(s.read()) == sorted(((-1 if k is None else k), *v) for k, v in want.items())
        assert {b: n for b, (_, n) in s.manifest()["places"].items()} == {str(r[0]): r[1] for r in s.read().groupBy(s.bucket_of(5)).count().collect()}
    version = s.manifest()["version"]
    assert s.upsert(table(spark, (1, 99, "late")), ("q", 5)) == version
    s.delete(s.read())
    assert s.read().count() == 0 and s.upsert(table(spark, (1, 1, "x"))) == s.versions()[-1]


def test_without_newer_any_difference_counts(spark, tmp_path):
    s = KeyedSnapshot(spark, str(tmp_path), ["k"], buckets=4)
    s.upsert(table(spark, (1, 5, "a"), (2, 5, "a")))
    assert s.upsert(table(spark, (1, 5, "a"))) == 1 and s.upsert(table(spark, (1, 4, None))) == 2
    assert [tuple(r)[:3] for r in s.read().orderBy("k").collect()] == [(1, 4, None), (2, 5, "a")]


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer whose version is taken starts anew from the other's."""
    a, b = (KeyedSnapshot(spark, str(tmp_path), ["k"], ["t"], buckets=2) for _ in range(2))
    made, plain = [], a._upserted

    def late(*args):
        if not made:
            made.append(b.upsert(table(spark, (1, 1, "other"))))
        return plain(*args)

    monkeypatch.setattr(a, "_upserted", late)
    assert a.upsert(table(spark, (2, 1, "own"))) == 2
    assert rows(a.read()) == [(1, 1, "other"), (2, 1, "own")]


def test_a_stream_is_followed(spark, tmp_path):
    s = KeyedSnapshot(spark, str(tmp_path / "s"), ["k"], ["t"], buckets=4)
    for n in range(3):
        table(spark, *((k, n, f"{n}") for k in range(n, 10))).write.mode("append").parquet(str(tmp_path / "in"))
        s.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "in", str(tmp_path / "c")).awaitTermination(120)
    assert rows(s.read()) == [(k, min(k, 2), f"{min(k, 2)}") for k in range(10)]


def scanned(frame):
    """Rows that the scans of a frame read."""
    frame.collect()
    plan, out = frame._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.executedPlan().collectLeaves().apply(0) if "AdaptiveSparkPlan" in leaf.nodeName() else leaf
        leaf = leaf.plan().collectLeaves().apply(0) if "QueryStage" in leaf.nodeName() else leaf
        metric = leaf.metrics().get("numOutputRows")
        out += metric.get().value() if metric.isDefined() else 0
    return out


@pytest.fixture(scope="module")
def many(spark):
    day = F.make_date(F.lit(2020), F.lit(1), F.lit(1)) + (F.col("id") % 97).cast("int")
    return spark.range(60_000).select("id", day.alias("day"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"))


def test_pages_read_their_ranges(spark, many, tmp_path):
    t = RangedTable(spark, str(tmp_path), ["-day", "id"], ["kind"])
    t.write(many, 2_000)
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i % 97)
    want = sorted((i for i in range(60_000) if i % 3), key=lambda i: (-day(i).toordinal(), i))
    for number in (0, 1, 299, 399, 400):
        found = t.page(number, 100, kind="y")
        assert [(r.position, r.id, r.pages) for r in sorted(found.collect(), key=lambda r: r.position)] == [(number * 100 + n + 1, i, 400) for n, i in enumerate(want[number * 100 : number * 100 + 100])]
        assert scanned(found) <= 2 * 3_000
    last = None
    for number in range(3):
        found = t.after(last, 100, kind="y").collect()
        assert [r.id for r in found] == want[number * 100 : number * 100 + 100]
        last = found[-1].asDict()
    plan = t.after({"day": day(96), "id": 5}, 10, kind="y")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(day" in plan and "kind" in plan.split("PushedFilters")[1].split("]")[0]
    assert t.page(0, 10, kind="none").count() == 0
    empty = RangedTable(spark, str(tmp_path / "empty"), ["-day", "id"])
    empty.write(many.limit(0))
    assert empty.page(0, 10).count() == 0 and empty.after(None, 5).count() == 0


def test_pages_beyond_twenty_thousand(many):
    order = (F.desc("day"), F.col("id"))
    assert [(r.position, r.pages) for r in page(many, 1199, 50, *order).orderBy("position").collect()] == [(59_951 + n, 1200) for n in range(50)]
    assert page(many, 0, 50, *order).agg(F.max("pages")).first()[0] == 1200
    assert page(many, 0, 50, *order, most=100).agg(F.max("pages")).first()[0] == 2 and page(many, 2, 50, *order, most=100).count() == 0


def test_trigram_search_against_contains(spark, tmp_path):
    rng = random.Random(8)
    words = ["alpha", "beta", "Straße", "ÉCOLE", "gamma ray", "x", "", "漢字テスト", "a%b_c", "common"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))) if i % 17 else None, "common tail") for i in range(4_000)] + [(4_001, "needle in a haystack", None), (4_001, "needle again", "x")]
    frame = spark.createDataFrame(texts, "id long, text string, tail string")
    index = TrigramIndex(spark, str(tmp_path), buckets=8, salts=2)
    index.build(frame, "id", "text", "tail")
    for q in ("Needle", "école gam", "漢字テ", "a%b_c x", "x", "common", "nothing like it", " ", "le in a hay", "needle"):
        found = index.search(q)
        low = q.strip().lower()
        assert sorted(r.id for r in found.collect()) == sorted(i for i, *t in texts if low in " ".join(x for x in t if x is not None).lower()), q
    rare = index.search("needle in")
    assert scanned(rare) <= 1_000
    assert index.candidates("x") is None and index.candidates("common") is None and index.candidates("needle") is not None
    none = TrigramIndex(spark, str(tmp_path / "none"))
    none.build(frame.limit(0), "id", "text")
    assert none.search("abc").count() == 0
    plan = index.candidates("needle")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")


def test_first_independent_against_a_greedy_pass(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (40, 60), (200, 900), (30, 29)):
        edges = [(i, i + 1) for i in range(29)] if m == 29 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        near = {i: set() for i in range(n)}
        for a, b in edges:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        taken = set()
        for i in range(n):
            if not near[i] & taken:
                taken.add(i)
        got = first_independent(spark.range(n), spark.createDataFrame(edges, "a long, b long"))
        assert sorted(r.id for r in got.collect()) == sorted(taken)


def test_questions_end_and_merge_as_one_pass(spark):
    """Asking in rounds leads to what a pass over the rows, asking at once, comes to."""
    rng = random.Random(4)
    rows = [(i, i, f"Yard {rng.randrange(3)}", f"{100 + rng.randrange(7)} Elm Street", rng.choice(["Alpha", "Bravo"]), rng.choice(["", "A1", "B2"])) for i in range(80)]
    book = spark.createDataFrame(rows, "address_key long, position long, ship_to_name string, address string, carrier string, account_numbers string")
    keys = {r.address_key: r for r in resolve.keyed(book).collect()}
    truth = lambda x, y: (int(x[:3]) - 100) // 2 == (int(y[:3]) - 100) // 2
    street = {keys[i].street_key: a for i, _, _, a, _, _ in rows}
    want, seeds = {}, []
    for i, *_ in rows:
        k = keys[i]
        for s in seeds:
            t = keys[s]
            if t.carrier_key == k.carrier_key and (not t.account_key or not k.account_key or t.account_key == k.account_key) and t.ship_key == k.ship_key and (t.street_key == k.street_key or truth(street[t.street_key], street[k.street_key])):
                want[i] = s
                break
        else:
            seeds.append(i)
            want[i] = i
    known, asked = [], 0
    for _ in range(20):
        answers = spark.createDataFrame(known, "ship_key string, street_a string, street_b string, same boolean")
        found = resolve.questions(book, answers).collect()
        if not found:
            break
        asked += len(found)
        known += [(r.ship_key, r.street_a, r.street_b, truth(street[r.street_a], street[r.street_b])) for r in found]
    assert not found and asked <= 3 * 21
    assert {r.address_key: r["into"] for r in resolve.greedy_merge(book, answers).collect()} == want


@pytest.mark.parametrize("batches", [1, 4])
def test_answers_in_any_split(spark, tmp_path, batches):
    """A stream that comes in several batches gives the rows of the table."""
    rng = random.Random(batches)
    start = datetime.datetime(2024, 1, 1)
    rows, last = [], {}
    for i in range(300):
        key = rng.choice("abc")
        if rng.random() < 0.5 or key not in last:
            last[key] = i
            rows.append((key, i, start + datetime.timedelta(seconds=i), False, 0.0))
        else:
            rows.append((key, rng.choice([last[key], last[key], rng.randrange(i)]), start + datetime.timedelta(seconds=i), True, float(i)))
    schema = "key string, request long, ts timestamp, answer boolean, value double"
    whole = {tuple(r) for r in fresh_answers(spark.createDataFrame(rows, schema)).collect()}
    asked, want = {}, set()
    for k, r, t, answer, v in rows:
        if not answer:
            asked[k] = max(r, asked.get(k, r))
        elif asked.get(k) == r:
            want.add((k, r, t, v))
    assert whole == want and want
    for n in range(batches):
        spark.createDataFrame(rows[n * 300 // batches : (n + 1) * 300 // batches], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = fresh_answers(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_upper_middles_of_any_group(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random()])) for _ in range(500)] + [("c", 4.0), ("d", None)]
    got = {r.k: r.middle for r in scoring.upper_middles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(v for j, v in rows if j == k and v is not None)
        if own:
            want[k] = own[len(own) // 2]
    assert got == want


def test_postings_are_gathered_before_they_are_written(spark, tmp_path):
    """A row of postings stands for a gram's texts, not for one of them; any letters, also very many, keep their places."""
    many = "".join(map(chr, range(0x4E00, 0x9FFF)))
    texts = [(i, f"{i} over and over") for i in range(3_000)] + [(9_000, many), (9_001, many[::-1] + chr(0x10FFFF)), (9_002, "ab"), (9_003, "")]
    index = TrigramIndex(spark, str(tmp_path), buckets=4)
    index.build(spark.createDataFrame(texts, "id long, text string").coalesce(2), "id", "text")
    assert spark.read.parquet(f"{tmp_path}/postings").filter("gram = 'ove'").count() <= 16
    counts = {r.gram: r.texts for r in spark.read.parquet(f"{tmp_path}/counts").collect()}
    want = {}
    for _, t in texts:
        for g in {t[i : i + 3] for i in range(len(t) - 2)}:
            want[g] = want.get(g, 0) + 1
    assert counts == want
    assert [r.id for r in index.search(many[70:80]).collect()] == [9_000]


def test_grams_of_texts_with_too_many_letters_for_one_number():
    texts = ["".join(map(chr, range(0x10000, 0x10000 + 250_000))), *["abcab"] * 300, *["cabx"] * 300]
    grams, ends, numbers = _gathered(texts)
    got = {g: numbers[ends[i] : ends[i + 1]].tolist() for i, g in enumerate(grams)}
    assert len(got) == 249_998 + 4 and got[texts[0][:3]] == got[texts[0][-3:]] == [0]
    assert got["cab"] == list(range(1, 601)) and got["abc"] == got["bca"] == list(range(1, 301)) and got["abx"] == list(range(301, 601))
