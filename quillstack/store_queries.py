"""Queries over tables that are kept: keyed snapshots, ranged tables, search indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fit import Font
from .operators import history, resolve
from .queries import query, read
from .sources.ranged import RangedTable
from .sources.sinks import scratch
from .sources.snapshot import KeyedSnapshot
from .sources.trigrams import TrigramIndex
from .streaming.latest import fresh_answers


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate,
arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1""")
def bucketed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, from all orders in ten batches that come in no order of time; the last batch comes twice."""
    kept = KeyedSnapshot(spark, scratch(spark, "last-orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], buckets=16)
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    for n in (*range(10), 9):
        kept.upsert(orders.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(10)) == n), ("orders", n))
    return kept.read()


_LINE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
_LINES_SQL = f"SELECT l_returnflag, {', '.join(_LINE)}, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, {', '.join(_LINE[1:])}) AS position, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem"


@query(f"SELECT l_returnflag, {', '.join(_LINE)}, position, ceil(n / 50)::BIGINT AS pages FROM ({_LINES_SQL}) WHERE (position - 1) // 50 = (n - 1) // 50 // 2")
def ranged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle page of the lines of each flag, from its own ranges of a ranged table."""
    lines = read(spark, sf_dir, "lineitem", "l_returnflag", *_LINE)
    table = RangedTable(spark, scratch(spark, "ranged"), ["-l_shipdate", *_LINE[1:]], ["l_returnflag"])
    table.write(lines, 2_000)
    out = None
    for flag, n in lines.groupBy("l_returnflag").count().collect():  # as many as flags
        page = table.page((n - 1) // 50 // 2, 50, l_returnflag=flag)
        out = page if out is None else out.unionByName(page)
    return out


@query(f"""WITH r AS (SELECT {', '.join(_LINE)}, row_number() OVER (ORDER BY l_shipdate DESC, {', '.join(_LINE[1:])})::INT AS position, count(*) OVER () AS n FROM lineitem)
SELECT {', '.join(_LINE)}, position, ceil(n / 70)::BIGINT AS pages FROM r WHERE (position - 1) // 70 = (n - 1) // 70""")
def history_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of all lines, however far in it lies."""
    lines = read(spark, sf_dir, "lineitem", *_LINE)
    return history.page(lines, (lines.count() - 1) // 70, 70, F.desc("l_shipdate"), *map(F.col, _LINE[1:]))


_SEARCHED = ["that the", "ization", "Thing AND", "qu", "zzz zzz", "token = ", "  AND, ON "]


@query(f"""SELECT q.query, doc_id, lang FROM documents JOIN (VALUES {', '.join(f"('{q}')" for q in _SEARCHED)}) AS q(query) ON contains(lower(concat_ws(' ', text, source)), lower(trim(q.query)))""")
def trigram_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches of whole texts by one index; the short and the frequent ones scan."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    index = TrigramIndex(spark, scratch(spark, "trigrams"), buckets=16)
    index.build(docs, "doc_id", "text", "source")
    out = None
    for q in _SEARCHED:
        found = index.search(q).select(F.lit(q).alias("query"), F.col("id").alias("doc_id"))
        out = found if out is None else out.unionByName(found)
    return out.join(docs.select("doc_id", "lang"), "doc_id")


_TYPED = "4th st"
_BOOK_SQL = "book AS (SELECT c_custkey, 'Customer ' || c_custkey AS ship_to_name, (c_custkey * 7 % 900 + 1) || ' ' || (c_custkey % 60) || 'th Street' AS address, c_acctbal FROM customer)"


@query(f"WITH {_BOOK_SQL} SELECT c_custkey, address FROM book WHERE contains(lower(concat_ws(' ', ship_to_name, address)), '{_TYPED}') ORDER BY c_acctbal DESC, c_custkey LIMIT 8")
def trigram_address_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved addresses while typing: the eight best of those that contain the text, from the index."""
    key = F.col("c_custkey")
    book = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select(key, "c_acctbal", F.concat(F.lit("Customer "), key).alias("ship_to_name"), F.concat((key * 7 % 900 + 1).cast("string"), F.lit(" "), (key % 60).cast("string"), F.lit("th Street")).alias("address"))
    index = TrigramIndex(spark, scratch(spark, "addresses"), buckets=16)
    index.build(book, "c_custkey", "ship_to_name", "address")
    hits = index.search(_TYPED).select(F.col("id").alias("c_custkey"))
    return book.join(hits, "c_custkey", "left_semi").orderBy(F.desc("c_acctbal"), "c_custkey").limit(8).select("c_custkey", "address")


_MERGE_SQL = """b AS (SELECT c_custkey AS address_key, c_custkey AS position, c_nationkey AS ship, c_custkey * 7 % 12 AS street, CASE WHEN c_custkey % 5 = 0 THEN 'Alpha' ELSE 'Bravo' END AS carrier, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A' || c_custkey % 4 END AS account FROM customer),
o AS (SELECT *, row_number() OVER (PARTITION BY ship ORDER BY position) AS n FROM b)"""
_SEED = "STRUCT(position BIGINT, street BIGINT, carrier VARCHAR, account VARCHAR)"


@query(f"""WITH RECURSIVE {_MERGE_SQL}, s AS (SELECT DISTINCT ship, 0::BIGINT AS n, NULL::BIGINT AS address_key, NULL::BIGINT AS into_, []::{_SEED}[] AS seeds FROM o
UNION ALL SELECT t.ship, t.n, t.address_key, coalesce(t.hit, t.position), CASE WHEN t.hit IS NULL THEN list_append(t.seeds, {{'position': t.position, 'street': t.street, 'carrier': t.carrier, 'account': t.account}}::{_SEED}) ELSE t.seeds END
FROM (SELECT o.*, s.seeds, list_min(list_transform(list_filter(s.seeds, lambda x: x.carrier = o.carrier AND (x.account = '' OR o.account = '' OR x.account = o.account) AND (x.street = o.street OR (greatest(x.street, o.street) - least(x.street, o.street) = 1 AND least(x.street, o.street) % 3 = 0))), lambda x: x.position)) AS hit
FROM s JOIN o ON o.ship = s.ship AND o.n = s.n + 1) t)
SELECT address_key, into_ AS "into" FROM s WHERE n > 0""")
def greedy_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each saved address goes into the first kept one of its name, courier and place, places being the same also where a
    reviewer has said so: of streets 3k and 3k + 1."""
    key = F.col("c_custkey")
    book = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(
        key.alias("address_key"), key.alias("position"), F.concat(F.lit("Depot "), F.col("c_nationkey").cast("string")).alias("ship_to_name"), F.concat((key * 7 % 12 + 100).cast("string"), F.lit(" Oak Street, Calgary")).alias("address"),
        F.when(key % 5 == 0, "Alpha").otherwise("Bravo").alias("carrier"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("A"), (key % 4).cast("string"))).alias("account_numbers"),
    )
    places = resolve.keyed(book).select("ship_key", "street_key", (F.col("position") * 7 % 12).alias("street")).distinct()
    a, b = (places.select("ship_key", F.col("street_key").alias(f"street_{x}"), F.col("street").alias(x)) for x in "ab")
    answers = a.filter("a % 3 = 0").withColumn("b", F.col("a") + 1).join(b, ["ship_key", "b"]).select("ship_key", "street_a", "street_b", F.lit(True).alias("same"))
    return resolve.greedy_merge(book, answers)


_WIDTHS = {c: 222 for c in "ijl"} | {c: 278 for c in " .,ft"} | {c: 833 for c in "mw"}
_WIDE = "(CASE WHEN c IN ('i', 'j', 'l') THEN 222 WHEN c IN (' ', '.', ',', 'f', 't') THEN 278 WHEN c IN ('m', 'w') THEN 833 ELSE 556 END)"
_TAG_SQL = """t AS (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, p_brand)) AS s, 60 + p_size % 30 AS width FROM part),
w AS (SELECT p_partkey, width, u.word, row_number() OVER (PARTITION BY p_partkey ORDER BY u.i) AS n FROM (SELECT p_partkey, width, unnest(list_zip(string_split(s, ' '), range(100))) AS z, z[1] AS word, z[2] AS i FROM t) u WHERE u.word IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_TAG_SQL}, m AS (SELECT *, (SELECT coalesce(sum({_WIDE}), 0) FROM (SELECT unnest(string_split(w.word, '')) AS c)) AS wide FROM w),
f AS (SELECT p_partkey, width, 1::BIGINT AS n, word AS line, wide AS used, 1 AS no FROM m WHERE n = 1
UNION ALL SELECT m.p_partkey, m.width, m.n, CASE WHEN f.used + 278 + m.wide <= m.width * 1000 / 9.0 THEN f.line || ' ' || m.word ELSE m.word END, CASE WHEN f.used + 278 + m.wide <= m.width * 1000 / 9.0 THEN f.used + 278 + m.wide ELSE m.wide END,
CASE WHEN f.used + 278 + m.wide <= m.width * 1000 / 9.0 THEN f.no ELSE f.no + 1 END FROM f JOIN m ON m.p_partkey = f.p_partkey AND m.n = f.n + 1)
SELECT p_partkey, no AS line_no, arg_max(line, n) AS line FROM f GROUP BY 1, 2""")
def wrapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each part's tag at nine points, on tags of different widths."""
    tag = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    lines = Font(_WIDTHS, 556).lines(tag, 60 + F.col("p_size") % 30, F.lit(9.0))
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(lines).alias("i", "line")).select("p_partkey", (F.col("i") + 1).alias("line_no"), "line")


@query(f"""WITH t AS (SELECT p_partkey, p_name, (SELECT sum({_WIDE}) FROM (SELECT unnest(string_split(p_name, '')) AS c)) AS w, 20 + p_size AS width FROM part)
SELECT p_partkey, greatest(6.0, 12.0 - greatest(0, ceil((12.0 - width * 1000.0 / w) / 0.5)) * 0.5)::DOUBLE AS size FROM t""")
def tag_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = Font(_WIDTHS, 556).one_line_size(F.col("p_name"), 20 + F.col("p_size"), 12.0, 6.0)
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select("p_partkey", size.alias("size"))


# streams, each run to the end of what is there


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def followed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, kept by a stream of the events in a keyed snapshot; they arrive in two halves, each across all times."""
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type")
    kept = KeyedSnapshot(spark, scratch(spark, "last-events"), ["user_id"], ["ts", "event_id"], buckets=8)
    checkpoint, arrived = scratch(spark, "followed"), scratch(spark, "arrived")
    for late in (True, False):
        events.filter((F.col("event_id") % 2 == 0) == late).write.mode("append").parquet(arrived)
        kept.follow(spark.readStream.schema(events.schema).parquet(arrived), "events", checkpoint).awaitTermination()
    return kept.read()


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type IN ('click', 'purchase') AS answer, value, CASE WHEN event_type IN ('click', 'purchase') THEN event_id // 7 * 7 ELSE event_id END AS request FROM events),
a AS (SELECT *, max(CASE WHEN NOT answer THEN request END) OVER (PARTITION BY user_id ORDER BY ts, request, answer) AS asked FROM e)
SELECT user_id::VARCHAR AS key, request, ts, value FROM a WHERE answer AND request = asked""")
def wanted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases are answers to the request with the last number of seven before theirs, other events are requests: a
    stream of them, from a table in the order of time, gives the answers that are still wanted."""
    is_answer = F.col("event_type").isin("click", "purchase")
    rows = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type", "value").select(F.col("user_id").cast("string").alias("key"), F.when(is_answer, F.floor(F.col("event_id") / 7) * 7).otherwise(F.col("event_id")).alias("request"), F.col("ts").cast("timestamp").alias("ts"), is_answer.alias("answer"), "value")
    where, out, checkpoint = (scratch(spark, x) for x in ("asked", "wanted", "wanted-log"))
    rows.write.parquet(where)
    stream = fresh_answers(spark.readStream.schema(rows.schema).parquet(where))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
