"""Queries that apply the operators to the test tables, each beside the SQL that gives the same rows.

The tables hold orders, parts, customers and events rather than the records the operators are for, so
records are derived from them, or written out as VALUES where no table fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import address as A
from .functions import text as T
from .operators import expand, headers, history, layout, orders, places, rank, raster, resolve, restore, scoring, sync
from .plans.components import components
from .plans.hamming_join import hamming_pairs, nearest
from .plans.prefix_join import prefix_join
from .sources import tables as S
from .streaming import latest as L

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return S.parquet(spark, f"{sf_dir}/{name}.parquet", *columns)


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _sql_rows(names: str, rows: list[tuple]) -> str:
    """The same rows as a VALUES list."""
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


# replicated tables

_CONTACTS_SQL = """
remote AS (SELECT lower(c_name) AS name_key, c_name AS name, max(o_orderdate) AS last_used_at FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0 GROUP BY 1, 2),
local AS (SELECT lower(c_name) AS name_key, min(upper(c_name)) AS name FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1),
dead AS (SELECT DISTINCT lower(c_name) AS name_key FROM customer WHERE c_custkey % 7 = 0),
pushed AS (SELECT name_key, name FROM local WHERE name_key NOT IN (SELECT name_key FROM remote) AND name_key NOT IN (SELECT name_key FROM dead))"""


def _contacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, o = read(spark, sf_dir, "customer", "c_custkey", "c_name"), read(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    remote = c.filter("c_custkey % 3 <> 0").join(o, c.c_custkey == o.o_custkey).groupBy(F.col("c_name").alias("name")).agg(F.max("o_orderdate").alias("last_used_at"))
    local = c.filter("c_custkey % 4 = 0").select(F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t")).alias("name"))
    return local, remote, c.filter("c_custkey % 7 = 0").select(T.name_key("c_name").alias("name_key"))


@query(f"""WITH {_CONTACTS_SQL},
u AS (SELECT name_key, name, last_used_at FROM remote UNION ALL SELECT name_key, name, TIMESTAMP '2002-01-01' FROM pushed),
k AS (SELECT *, row_number() OVER (ORDER BY last_used_at DESC, name_key)::INT AS position FROM u WHERE name_key NOT IN (SELECT name_key FROM dead))
SELECT position, name_key, name, last_used_at FROM k WHERE position <= 60""")
def contact_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_names(*_contacts(spark, sf_dir), F.lit("2002-01-01").cast("timestamp_ntz")).select("position", "name_key", "name", "last_used_at")


@query(f"WITH {_CONTACTS_SQL} SELECT name_key, name FROM pushed")
def contacts_to_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, dead = _contacts(spark, sf_dir)
    return sync.names_to_push(sync.first_per_key(sync.named(local), "name_key", F.col("name")), sync.named(remote), dead).select("name_key", "name")


_PRESETS_SQL = """
l AS (SELECT o_orderpriority AS kind, o_custkey::VARCHAR AS name, max(o_orderdate) AS updated_at, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
r AS (SELECT o_orderpriority AS kind, o_custkey::VARCHAR AS name, max(o_orderdate) AS updated_at, nullif(max_by(o_orderstatus, (o_orderdate, o_orderkey)), 'P') AS status FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
t AS (SELECT DISTINCT o_orderpriority AS kind, o_custkey::VARCHAR AS name FROM orders WHERE o_orderkey % 11 = 0)"""


def _presets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").withColumn("name", F.col("o_custkey").cast("string")).withColumnRenamed("o_orderpriority", "kind")
    def side(odd: int) -> DataFrame:
        status = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
        return o.filter(F.col("o_orderkey") % 2 == odd).groupBy("kind", "name").agg(F.max("o_orderdate").alias("updated_at"), (F.nullif(status, F.lit("P")) if odd else status).alias("status"))

    return side(0), side(1), o.filter("o_orderkey % 11 = 0").select("kind", "name").distinct()


@query(f"""WITH {_PRESETS_SQL},
j AS (SELECT coalesce(l.kind, r.kind) AS kind, coalesce(l.name, r.name) AS name, l.updated_at AS lu, r.updated_at AS ru, l.status AS ls, r.status AS rs,
             (r.kind IS NULL OR coalesce(l.updated_at > r.updated_at, FALSE)) AS push FROM l FULL JOIN r ON l.kind = r.kind AND l.name = r.name)
SELECT kind, name, CASE WHEN push THEN lu ELSE ru END AS updated_at, CASE WHEN push THEN ls ELSE coalesce(rs, ls, '') END AS status,
       CASE WHEN push THEN 'local' ELSE 'remote' END AS origin, push FROM j WHERE (kind, name) NOT IN (SELECT (kind, name) FROM t)""")
def preset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_presets(*_presets(spark, sf_dir), fill=("status",))


@query(f"""WITH {_PRESETS_SQL}, j AS (SELECT coalesce(l.kind, r.kind) AS kind, coalesce(l.name, r.name) AS name, l.updated_at AS lu, r.updated_at AS ru, l.status AS ls, r.status AS rs, (r.kind IS NULL OR coalesce(l.updated_at > r.updated_at, FALSE)) AS push FROM l FULL JOIN r ON l.kind = r.kind AND l.name = r.name)
SELECT kind, name, CASE WHEN push THEN lu ELSE ru END AS updated_at, CASE WHEN push THEN ls ELSE rs END AS status, CASE WHEN push THEN 'local' ELSE 'remote' END AS origin, push FROM j""")
def signature_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = _presets(spark, sf_dir)
    return sync.last_writer(local, remote, ["kind", "name"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey < 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer
UNION ALL SELECT -c_custkey - 1, c_name || '!', 'NEW', NULL FROM customer WHERE c_custkey % 50 = 0""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    change = lambda key, f: c.filter(f).select(key.alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    rows = change(F.col("c_custkey"), "c_custkey % 5 = 0").unionByName(change(-F.col("c_custkey") - 1, "c_custkey % 50 = 0"))
    return sync.upsert(c, rows, "c_custkey")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2002-01-01' ELSE o_orderdate END AS updated_at FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders)")
def touch_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").withColumnRenamed("o_orderdate", "updated_at")
    after = before.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")))
    return sync.touched(before, after, "o_orderkey", F.lit("2002-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus", "updated_at")


@query("""SELECT name_key, CASE WHEN name_key IN (SELECT DISTINCT event_type || user_id FROM events WHERE event_id % 13 = 0) THEN TIMESTAMP '2025-01-01' ELSE ts END AS deleted_at
FROM (SELECT event_type || user_id AS name_key, max(ts) AS ts FROM events GROUP BY 1) WHERE name_key NOT IN (SELECT DISTINCT event_type || user_id FROM events WHERE event_id % 17 = 0)""")
def tombstone_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").withColumn("name_key", F.concat("event_type", F.col("user_id").cast("string")))
    dead = e.groupBy("name_key").agg(F.max("ts").alias("deleted_at"))
    again = sync.set_tombstones(dead, e.filter("event_id % 13 = 0"), "name_key", F.lit("2025-01-01").cast("timestamp_ntz"))
    return sync.clear_tombstones(again, e.filter("event_id % 17 = 0"), "name_key")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_type = 'PROMO' AND p_size > 10)")
def delete_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.delete_where(read(spark, sf_dir, "part"), (F.col("p_type") == "PROMO") & (F.col("p_size") > 10)).select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE FALSE")
def delete_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.delete_all(read(spark, sf_dir, "nation", "n_nationkey", "n_name"))


@query("SELECT s_suppkey, s_name, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 100)::INT AS chunk FROM supplier")
def delete_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.chunks(read(spark, sf_dir, "supplier", "s_suppkey", "s_name"), 100, "s_suppkey")


@query("SELECT s_suppkey, n AS serial, 'SW-' || right(lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0'), 4) AS label FROM (SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) + 9990)::INT AS n FROM supplier)")
def serial_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.assign_serials(read(spark, sf_dir, "supplier", "s_suppkey"), 9990, "s_suppkey").withColumn("label", T.serial_label("serial"))


@query("""WITH w AS (SELECT p_partkey, p_brand AS stem, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
t AS (SELECT DISTINCT p_brand AS stem, p_size AS n FROM part), c AS (SELECT stem, count(*) AS c FROM w GROUP BY 1),
g AS (SELECT stem, unnest(generate_series(1, c + 60)) AS n FROM c), f AS (SELECT stem, n, row_number() OVER (PARTITION BY stem ORDER BY n) AS i FROM g WHERE NOT EXISTS (FROM t WHERE t.stem = g.stem AND t.n = g.n))
SELECT w.p_partkey, w.stem, f.n::INT AS n FROM w JOIN f ON w.stem = f.stem AND w.i = f.i""")
def free_file_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part wants a number of its brand; the numbers up to 50 that sizes of the brand take are gone."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").withColumnRenamed("p_brand", "stem")
    return sync.free_names(p.select("p_partkey", "stem"), p.select("stem", F.col("p_size").alias("n")), "p_partkey").select("p_partkey", "stem", "n")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'p' || (l_partkey % 10) ELSE 'q' || (l_partkey % 5) END AS v FROM lineitem),
m AS (SELECT l_orderkey, CASE WHEN v = 'p0' THEN 'q0' WHEN v = 'p1' THEN 'q1' ELSE v END AS v, min(i) AS i FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, v) AS i FROM o) WHERE v <> 'q4' GROUP BY 1, 2)
SELECT l_orderkey, string_agg(v, ',' ORDER BY i) AS logos FROM m GROUP BY 1""")
def remap_logo_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    v = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("p"), (F.col("l_partkey") % 10).cast("string"))).otherwise(F.concat(F.lit("q"), (F.col("l_partkey") % 5).cast("string")))
    lists = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", v.alias("v")))), lambda x: x["v"]).alias("logos"))
    cut = sync.remove_value(lists, "logos", F.lit("q4")).filter(F.size("logos") > 0)
    return sync.remap_values(cut, "logos", values(spark, "old string, new string", ("p0", "q0"), ("p1", "q1")), "l_orderkey").select("l_orderkey", F.array_join("logos", ",").alias("logos"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS i FROM orders) WHERE i = 1")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.latest_per_key(read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


# history

_RECORDS_SQL = "rec AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'shipping' WHEN 1 THEN 'receiving' ELSE 'bol' END AS kind, o_orderkey::VARCHAR AS id, o_orderdate AS created_at, o_orderpriority AS title FROM orders)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "shipping").when(F.col("o_orderkey") % 3 == 1, "receiving").otherwise("bol")
    return read(spark, sf_dir, "orders").select(kind.alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("title"))


def _now():
    return F.lit("2001-08-01").cast("timestamp_ntz")


@query(f"""WITH {_RECORDS_SQL}, w AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id)::INT AS position, ceil(count(*) OVER () / 5.0)::BIGINT AS pages FROM rec
WHERE kind = 'shipping' AND created_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) SELECT * FROM w WHERE position BETWEEN 6 AND 10""")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.in_window(_records(spark, sf_dir).filter("kind = 'shipping'"), _now())
    return history.page(rows, 1, 5, F.desc("created_at"), F.col("id"))


@query(f"WITH {_RECORDS_SQL} SELECT kind, id FROM rec WHERE lower(concat_ws(' ', title, kind, id)) LIKE '%urgent ship%'")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.search(_records(spark, sf_dir), "  URGENT ship", "title", "kind", "id").select("kind", "id")


@query("SELECT doc_id, lang FROM documents WHERE lower(concat_ws(' ', text, source)) LIKE '%that the%'")
def document_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.search(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), "That THE", "text", "source").select("doc_id", "lang")


@query(f"""WITH {_RECORDS_SQL}, g AS (SELECT *, created_at < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY AS gone FROM rec)
SELECT 'record' AS what, kind || '/' || id AS name FROM g WHERE NOT gone UNION ALL SELECT 'object', kind || '/' || id || unnest(['/form.json', '/page.pdf']) FROM g WHERE NOT gone UNION ALL SELECT 'purged', count(*)::VARCHAR FROM g WHERE gone""")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    objects = rec.select(F.explode(F.array(F.concat_ws("/", "kind", "id", F.lit("form.json")), F.concat_ws("/", "kind", "id", F.lit("page.pdf")))).alias("name"))
    kept, left, gone = history.purge(rec, objects, _now(), days=0)
    named = lambda what, f, name: f.select(F.lit(what).alias("what"), name.alias("name"))
    return named("record", kept, F.concat_ws("/", "kind", "id")).union(named("object", left, F.col("name"))).union(named("purged", gone, F.col("purged").cast("string")))


@query(f"WITH {_RECORDS_SQL} SELECT kind, id FROM rec WHERE NOT (id::BIGINT % 5 = 0 AND id::BIGINT % 2 = 0)")
def prune_without_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _records(spark, sf_dir)
    n = F.col("id").cast("long")
    probes = rec.filter(n % 5 == 0).select("id", F.when(n % 2 == 1, F.lit(True)).when(n % 10 == 0, F.lit(False)).otherwise(F.lit(None).cast("boolean")).alias("found"))
    return history.prune_without(rec, probes).select("kind", "id")


# totals and expansion


@query("""WITH t AS (SELECT l_orderkey, CASE p_type WHEN 'SMALL' THEN 'Boxes' WHEN 'MEDIUM' THEN 'Crates' WHEN 'LARGE' THEN 'Pallets' WHEN 'PROMO' THEN 'Bundles' WHEN 'ECONOMY' THEN 'Pipes' ELSE 'STANDARD' END AS k, l_quantity AS q, p_size AS w FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, sum(q) AS total_pieces, sum(w)::DOUBLE AS total_weight, nullif(coalesce(sum(q) FILTER (k = 'Pallets'), 0), 0) AS pallets, nullif(coalesce(sum(q) FILTER (k = 'Crates'), 0), 0) AS crates, nullif(coalesce(sum(q) FILTER (k = 'Boxes'), 0), 0) AS boxes,
nullif(coalesce(sum(q) FILTER (k = 'Pipes'), 0), 0) AS pipes, nullif(coalesce(sum(q) FILTER (k = 'Bundles'), 0), 0) AS bundles, NULL::DOUBLE AS other FROM t GROUP BY 1""")
def goods_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    kinds = {"SMALL": " box", "MEDIUM": "CRATES", "LARGE": "pallet", "PROMO": "Bundles ", "ECONOMY": "pipe"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("p_type")), F.col("p_type"))
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    lines = l.select("l_orderkey", F.concat(F.lit(" "), F.format_number("l_quantity", 1)).alias("pieces"), F.col("p_size").cast("string").alias("weight"), kind.alias("item_type"))
    return expand.goods_totals(lines, "l_orderkey")


@query("SELECT l_returnflag, p_type, sum(l_quantity) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_type")
    return expand.category_totals(read(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey")), "l_returnflag", "p_type", "l_quantity")


_LABELS_SQL = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_quantity::INT END AS n, l_quantity::INT AS q, l_suppkey % 2 = 0 AND l_partkey % 3 <> 0 AS own FROM lineitem),
s AS (SELECT * EXCLUDE (n), unnest(range(n))::INT AS sticker FROM x),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sticker, CASE WHEN own THEN (sticker + 1)::VARCHAR ELSE 'all ' || q END AS cpo FROM s),
r AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, sticker, cpo) - 1)::INT AS i FROM c)"""


@query(f"WITH {_LABELS_SQL} SELECT l_orderkey, l_linenumber, sticker, cpo, i AS index, i // 10 AS sheet, (i % 10) // 2 AS row, i % 2 AS \"column\" FROM r")
def sticker_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumn("quantity", F.col("l_quantity").cast("int"))  # noqa: E741
    numbers = F.when(F.col("l_suppkey") % 2 == 0, F.sequence(F.lit(1), F.col("quantity"))).otherwise(F.array().cast("array<int>"))
    lines = l.withColumn("print_mode", F.when(F.col("l_partkey") % 3 == 0, "single").otherwise("unit")).withColumn("cpo_display", F.concat(F.lit("all "), F.col("quantity").cast("string"))).withColumn("cpo_numbers", numbers)
    return expand.tiled(expand.labels(lines), ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey", "sticker", "cpo").select("l_orderkey", "l_linenumber", "sticker", "cpo", "index", "sheet", "row", "column")


@query("SELECT l_orderkey, sum(l_quantity)::BIGINT AS stickers, ((sum(l_quantity)::BIGINT + 9) // 10) AS sheets FROM lineitem GROUP BY 1")
def sticker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("stickers")).withColumn("sheets", expand.sheets(F.col("stickers")))


@query("""WITH p AS (SELECT o_orderkey, (o_custkey % 4)::INT AS a, (o_custkey % 3)::INT AS b, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE (o_custkey % 4 + o_custkey % 3)::INT END AS pages FROM orders),
x AS (SELECT *, unnest(CASE WHEN pages > 0 THEN range(1, pages + 1) ELSE [0] END)::INT AS page FROM p)
SELECT o_orderkey, pages, page, CASE WHEN page = 0 THEN '' WHEN page <= a THEN 'pallet' ELSE 'box' END AS unit FROM x""")
def piece_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    plans = o.select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("pallet_crates"), (F.col("o_custkey") % 3).cast("int").alias("boxes"), (F.col("o_orderkey") % 9 == 0).alias("is_undetermined"))
    return expand.piece_pages(plans).select("o_orderkey", "pages", "page", "unit")


@query("""WITH s AS (SELECT o_custkey, sum(o_orderkey % 4)::BIGINT AS pallet_crates, sum(o_orderkey % 3)::BIGINT AS boxes FROM orders GROUP BY 1), d AS (SELECT c_custkey AS o_custkey, c_nationkey::BIGINT AS declared_pallet_crates, 5::BIGINT AS declared_boxes FROM customer)
SELECT *, pallet_crates = declared_pallet_crates AND boxes = declared_boxes AS agrees FROM s JOIN d USING (o_custkey)""")
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_custkey", (F.col("o_orderkey") % 4).alias("pallet_crates"), (F.col("o_orderkey") % 3).alias("boxes"))
    declared = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("pallet_crates"), F.lit(5).cast("long").alias("boxes"))
    return expand.plan_checks(plans, declared, "o_custkey")


@query("""SELECT o_custkey, job::INT AS job, o AS "order", CASE WHEN job = 1 THEN 'own ' || o ELSE 'base' END AS carrier, 'x' AS po FROM (SELECT o_custkey, unnest(list_sort(list(o_orderkey::VARCHAR))) AS o, generate_subscripts(list_sort(list(o_orderkey::VARCHAR)), 1) - 1 AS job FROM orders GROUP BY 1)""")
def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))).alias("orders"))
    second = F.try_element_at("orders", F.lit(2))
    d = d.withColumn("overrides", F.create_map(F.lit("carrier"), F.when(second.isNotNull(), F.create_map(second, F.concat(F.lit("own "), second))).otherwise(F.create_map().cast("map<string,string>"))))
    d = d.withColumn("fields", F.create_map(F.lit("carrier"), F.lit("base"), F.lit("po"), F.lit("x")))
    return expand.jobs(d).select("o_custkey", "job", "order", F.element_at("fields", "carrier").alias("carrier"), F.element_at("fields", "po").alias("po"))


@query("""WITH f AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS i FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, nullif(replace(o_orderstatus, 'P', ' '), ' ') AS v, min(o_orderkey) AS i FROM orders GROUP BY 1, 2)
SELECT o.o_custkey, (SELECT string_agg(v, ' / ' ORDER BY i) FROM f WHERE f.o_custkey = o.o_custkey) AS priority, coalesce((SELECT string_agg(v, ' / ' ORDER BY i) FROM s WHERE s.o_custkey = o.o_custkey AND v IS NOT NULL), '') AS status, bool_or(o_totalprice > 490000) AS big
FROM orders o GROUP BY 1""")
def merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("priority"), F.regexp_replace("o_orderstatus", "P", " ").alias("status"), (F.col("o_totalprice") > 490000).alias("big"))
    return expand.merged_documents(o, "o_custkey", "o_orderkey", ["priority", "status"], ["big"])


# scores


@query("""WITH r AS (SELECT toxic AS run, doc_id::VARCHAR AS case_id, quality = 1 AS ok, quality::DOUBLE AS composite FROM labels)
SELECT run, round(avg(composite), 4) AS mean_composite, count(*) AS cases, count(*) FILTER (NOT ok) AS failures FROM r GROUP BY 1""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "labels").select(F.col("toxic").alias("run"), F.col("doc_id").cast("string").alias("case_id"), (F.col("quality") == 1).alias("ok"), F.col("quality").cast("double").alias("composite"))
    return scoring.summary(cases, "run")


@query("""(SELECT event_id, value, 'best' AS side, row_number() OVER (ORDER BY value DESC, event_id)::INT AS place FROM events ORDER BY value DESC, event_id LIMIT 10)
UNION ALL (SELECT event_id, value, 'worst', row_number() OVER (ORDER BY value, event_id)::INT FROM events ORDER BY value, event_id LIMIT 10)""")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.extremes(read(spark, sf_dir, "events", "event_id", "value"), 10, "value", "event_id")


@query("""WITH u AS (SELECT user_id, unnest(list_distinct(list(event_type))) AS technique, max(value) > 90 AS won FROM events GROUP BY user_id)
SELECT technique, count(*) AS uses, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS fails, round(count(*) FILTER (won) / count(*), 4) AS win_rate FROM u GROUP BY 1""")
def technique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("used"), (F.max("value") > 90).alias("won"))
    return scoring.technique_counts(runs)


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, value FROM events), i AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM e WHERE value > 20),
r AS (SELECT user_id, g, min(p) AS first, count(*) AS length FROM i GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) AS k FROM r)
SELECT user_id, first::INT AS first, length FROM b WHERE k = 1""")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "value").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return scoring.longest_run(e, "user_id", "p", F.col("value") > 20)


@query("SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS middle FROM events GROUP BY 1")
def upper_middle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.upper_middles(read(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 40")
def capped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.capped_tail(read(spark, sf_dir, "events", "user_id", "event_id", "ts"), "user_id", "ts", 40, "event_id").select("user_id", "event_id")


@query("""SELECT event_id, CASE WHEN value < 10 THEN greatest(0, least(1, 1 - (10 - value) / 5)) WHEN value > 60 THEN greatest(0, least(1, 1 - (value - 60) / 5)) ELSE 1 END AS band, CASE WHEN value <= 50 THEN 1 ELSE greatest(0, least(50 / value, 1)) END AS speed,
CASE WHEN value >= 80 THEN 'excellent' WHEN value >= 50 THEN 'good' WHEN value >= 20 THEN 'fair' END AS grade FROM events""")
def graded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf_dir, "events").select("event_id", scoring.band_score(v, 10.0, 60.0, 5.0).alias("band"), scoring.speed_score(v, F.lit(50.0)).alias("speed"), scoring.grade(v, {"good": 50, "excellent": 80, "fair": 20}).alias("grade"))


@query("SELECT l_orderkey, (sum(l_linenumber) / count(*))::DOUBLE AS mean, bool_and(l_quantity < 45) AS holds FROM lineitem GROUP BY 1")
def metric_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("r"))
    number = F.transform("r", lambda x, i: F.struct(i.alias("key"), x["l_linenumber"].cast("double").alias("value")))
    gates = F.transform("r", lambda x, i: F.struct(i.alias("key"), (x["l_quantity"] < 45).alias("value")))
    return rows.select("l_orderkey", scoring.map_mean(F.map_from_entries(number)).alias("mean"), scoring.gates_hold(F.map_from_entries(gates)).alias("holds"))


# keys, text and parsing


@query("""WITH p AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)
SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k = b.k OR (least(length(a.k), length(b.k)) >= 3 AND (starts_with(a.k, b.k) OR starts_with(b.k, a.k)))""")
def part_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_name")
    k = p.select(T.compact_key("p_name").alias("k")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    return prefix_join(k.withColumnRenamed("k", "a"), k.withColumnRenamed("k", "b"), "a", "b")


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS shown, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders")
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("shown", T.shown_date("o_orderdate")).select("o_orderkey", "shown", T.display_date("shown").cast("string").alias("back"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'SL' WHEN 1 THEN 'RL' WHEN 2 THEN 'BOL' ELSE 'BL' END || '-' || replace(s_name, '#', '_x_') || '.pdf' AS file, CASE s_suppkey % 4 WHEN 0 THEN 'shipping' WHEN 1 THEN 'receiving' WHEN 2 THEN 'bol' ELSE 'bulk' END || '::' || s_name AS key, s_name AS name FROM supplier")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("shipping", "receiving", "bol", "bulk"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_name").withColumn("key", T.preset_key(kind, "s_name"))
    return s.select("s_suppkey", T.file_name(T.preset_key_parts("key")["kind"], F.regexp_replace("s_name", "#", " x ")).alias("file"), "key", T.preset_key_parts("key")["name"].alias("name"))


@query("SELECT event_id, lower(to_base(event_id * 1000003 + 7, 36)) AS id FROM events")
def base36_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", "event_id").select("event_id", T.base36(F.col("event_id") * 1000003 + 7).alias("id"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", F.element_at(T.json_map("props"), "k").cast("int").alias("k"))


# order documents


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'filled' ELSE 'open' END WHEN l_orderkey % 2 = 1 THEN 'unmatched' WHEN l_linenumber % 2 = 0 THEN 'agrees' ELSE 'differs' END AS status,
CASE WHEN l_linenumber % 3 = 0 AND l_orderkey % 2 = 0 THEN 'R' WHEN l_linenumber % 3 = 0 THEN '' ELSE 'V' END AS id_value FROM lineitem GROUP BY 1, 2""")
def reviewed_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct()  # noqa: E741
    lines = l.withColumn("cpo_display", F.concat(F.lit("c "), n.cast("string"))).withColumn("id_kind", F.lit("tag")).withColumn("id_value", F.when(n % 3 == 0, "").otherwise("V")).withColumn("reason", F.when(n % 3 == 0, "Missing").otherwise(""))
    both = l.filter("l_orderkey % 2 = 0").withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1))))
    value = F.when(F.col("ordinal") == 1, "late").when(n % 3 == 0, "R ").when(n % 2 == 0, " v").otherwise("other")
    reviews = both.select("l_orderkey", "ordinal", F.concat(F.lit("C"), n.cast("string")).alias("cpo"), F.lit("tag").alias("id_kind"), value.alias("id_value"), F.lit("high").alias("confidence"), F.lit("").alias("reasoning"))
    return orders.reviewed_lines(lines, reviews, "l_orderkey").select("l_orderkey", "l_linenumber", "status", "id_value")


# ranking


@query("""WITH u AS (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS key, url FROM pages), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS i FROM u) SELECT page_id, key FROM b WHERE i = 1""")
def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "url").withColumn("key", T.url_key("url"))
    return rank.ordered_distinct(p, F.col("key"), "page_id").select("page_id", "key")


@query("""WITH c AS (SELECT page_id % 20 AS company, page_id AS ordinal, url, (length(url) * 7 % 40)::INT AS score, lower(regexp_replace(url, '[?#].*$', '')) AS key FROM pages WHERE page_id % 20 <> 3 OR length(url) * 7 % 40 < 18),
p AS (SELECT * FROM c QUALIFY score >= 18 OR NOT bool_or(score >= 18) OVER (PARTITION BY company)), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY company, key ORDER BY score DESC, ordinal) = 1)
SELECT company, ordinal, score, row_number() OVER (PARTITION BY company ORDER BY score DESC, ordinal)::INT AS position FROM b QUALIFY position <= 30""")
def picked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.length("url") * 7 % 40).cast("int")
    c = read(spark, sf_dir, "pages", "page_id", "url").select((F.col("page_id") % 20).alias("company"), F.col("page_id").alias("ordinal"), "url", score.alias("score")).filter("company <> 3 or score < 18")
    return rank.picked(c, "company").select("company", "ordinal", "score", "position")


@query("""WITH e AS (SELECT user_id, event_id, value, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 12)::INT AS batch FROM events), s AS (SELECT user_id, batch, sum((value > 80)::INT) AS n FROM e GROUP BY 1, 2),
b AS (SELECT user_id, batch, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT e.user_id, e.event_id, e.batch FROM e JOIN b USING (user_id, batch) WHERE before < 3""")
def batches_until_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "value")
    return rank.until_enough(e, "user_id", F.col("value") > 80, 3, 12, "event_id").select("user_id", "event_id", "batch")


@query("""SELECT page_id % 10 AS company, page_id AS ordinal, (page_id % 7 + CASE WHEN page_id // 10 < 6 THEN 18 - 3 * (page_id // 10) ELSE 0 END)::BIGINT AS score FROM pages""")
def reranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "pages", "page_id").select((F.col("page_id") % 10).alias("company"), F.col("page_id").alias("ordinal"), (F.col("page_id") % 7).alias("score"))
    first = c.withColumn("i", F.row_number().over(Window.partitionBy("company").orderBy("ordinal"))).filter("i <= 9")
    opinion = first.groupBy("company").agg(F.array_sort(F.collect_list("ordinal")).alias("order"))
    return rank.reranked(c, "company", opinion).select("company", "ordinal", "score")


@query("""WITH m AS (SELECT c_custkey, c_name, CASE WHEN starts_with(lower(c_name), 'customer#00000001') THEN 0 WHEN contains(lower(c_name), 'customer#00000001') THEN 1 END AS tier FROM customer ORDER BY c_custkey),
k AS (SELECT * FROM m WHERE tier IS NOT NULL ORDER BY c_custkey LIMIT 12) SELECT c_custkey, c_name, tier FROM k ORDER BY tier, c_custkey LIMIT 6""")
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hits_first(read(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_name", "Customer#00000001", 6, "c_custkey")


@query("""WITH s AS (SELECT 0 AS tier, s_suppkey AS n, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 1, c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY tier, n) AS i FROM s) SELECT tier AS source_rank, n, name FROM k WHERE i = 1 ORDER BY tier, n LIMIT 15""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    a = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("n"), F.col("n_name").alias("name"))
    b = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("n"), F.col("n_name").alias("name"))
    return rank.ordered_distinct(rank.united(a, b), T.name_key("name"), "source_rank", "n", keep=15)


@query(r"""WITH f AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)href="([^"#]+)"', 1), regexp_extract_all(html, '(?i)src="([^"]+)"', 1), regexp_extract_all(html, '(?i)content="(https?://[^"]+)"', 1))) AS link FROM pages)
SELECT page_id, count(DISTINCT split_part(link, '?', 1)) AS links FROM f GROUP BY 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.links(read(spark, sf_dir, "pages", "page_id", "html"), "html", "page_id").groupBy("page_id").agg(F.count("*").alias("links"))


# layout and time


@query("SELECT l_orderkey, min(CASE WHEN l_quantity > 0 THEN least(100.0, 100.0 * 20 / l_quantity) ELSE 100.0 END)::DOUBLE AS height, CASE WHEN sum(l_quantity) <= greatest(120 - 4.0 * (count(*) - 1), 0) THEN 1.0 ELSE (greatest(120 - 4.0 * (count(*) - 1), 0) / sum(l_quantity)) END::DOUBLE AS factor FROM lineitem GROUP BY 1")
def row_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").select("l_orderkey", F.col("l_quantity").alias("width"), F.lit(20.0).alias("most"))
    return layout.shared_height(cells, "l_orderkey", 100.0).join(layout.shrink(cells, "l_orderkey", 120.0, 4.0), "l_orderkey")


@query("SELECT p_brand, p_partkey, CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END AS tier FROM part WHERE p_type IN ('PROMO', 'SMALL') QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_partkey) = 1")
def chosen_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").withColumn("ordinal", F.col("p_partkey"))
    return layout.chosen_asset(p, "p_brand", F.col("p_type") == "PROMO", F.col("p_type") == "SMALL").select("p_brand", "p_partkey", "tier")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, max(ts) AS last, count(*) AS events, max_by(value, ts) AS value FROM s GROUP BY user_id, k""")
def typing_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.debounced(read(spark, sf_dir, "events", "user_id", "ts", "value"), "user_id", gap="6 hours")
    return out


@query("SELECT event_id, (ts + INTERVAL 12 HOUR)::TIMESTAMP < ts + INTERVAL 3 DAY AS snoozed FROM events")
def snoozed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return read(spark, sf_dir, "events", "event_id", "ts").select("event_id", L.snoozed(t + F.make_dt_interval(F.lit(0), F.lit(12)), t).alias("snoozed"))


# headers, places and choices


@query("""WITH h AS (SELECT s_nationkey AS q, s_suppkey AS ordinal, s_suppkey % 9 || ' Elm' AS display_address, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE (s_suppkey % 9)::VARCHAR END AS hit FROM supplier),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY q, lower(display_address) ORDER BY ordinal) = 1), t AS (SELECT *, CASE WHEN hit = '3' THEN 0 WHEN hit = '' THEN 2 ELSE 1 END AS tier FROM o),
p AS (SELECT * FROM t QUALIFY NOT (min(tier) OVER (PARTITION BY q) = 0 AND tier = 2)) SELECT q, display_address, tier, row_number() OVER (PARTITION BY q ORDER BY tier, display_address)::INT AS position FROM p QUALIFY position <= 8""")
def ranked_geocoder_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    hits = s.select(F.col("s_nationkey").alias("q"), n.alias("ordinal"), F.concat((n % 9).cast("string"), F.lit(" Elm")).alias("display_address"), F.when(n % 4 == 0, "").otherwise((n % 9).cast("string")).alias("hit_number"), F.lit("3").alias("wanted"))
    return places.ranked_hits(hits, "q", "wanted").select("q", "display_address", "tier", "position")


@query("""WITH a AS (SELECT user_id, event_id, event_type AS engine, value, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS place FROM events), u AS (SELECT * FROM a WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, engine ORDER BY event_id) = 1)
SELECT user_id, engine, event_id FROM u WHERE value > 25 OR place = 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place) = 1""")
def restore_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value").withColumnRenamed("event_type", "engine")
    one = sync.first_per_key(e, ["user_id", "engine"], F.col("event_id"))
    return restore.cascade(one, "user_id", ("view", "click", "purchase"), F.col("value") > 25).select("user_id", "engine", "event_id")


@query("""WITH e AS (SELECT user_id, event_type, value > 50 AS good, value < 10 AS bad, unnest([event_type, 'all']) AS technique FROM events) SELECT technique, count(*) AS uses, count(*) FILTER (good) AS wins, count(*) FILTER (bad) AS fails FROM e GROUP BY 1""")
def graded_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.col("value") > 50, "favourable").when(F.col("value") < 10, "fail").otherwise("other")
    return restore.technique_record(read(spark, sf_dir, "events", "event_type", "value").select(F.array("event_type", F.lit("all")).alias("used"), g.alias("grade")))


@query("""SELECT p_partkey, round(ln(greatest(p_size * 10, 16)) * 10 + ln(greatest(p_size * 4000, 16)) * 4 + CASE WHEN p_brand = 'Brand#1' THEN 80 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN -12 ELSE 24 END + CASE WHEN p_partkey % 3 = 0 THEN 6 ELSE 0 END, 4) AS score FROM part""")
def keep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, "My mark(2).png").otherwise("mark.png")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(restore.keep_score(name, F.col("p_size") * 10, F.col("p_size"), F.lit(4000), F.col("p_brand") == "Brand#1"), 4).alias("score"))


@query("""SELECT o_custkey, least(a, b) / greatest(a, b) AS size_ratio, least(a, b) / greatest(a, b) >= 0.5 AS holds FROM (SELECT o_custkey, max(o_totalprice) AS a, min(o_totalprice) AS b FROM orders GROUP BY 1)""")
def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("size_a"), F.min("o_totalprice").alias("size_b"))
    return restore.parity(p, {"size": 0.5}).select("o_custkey", "size_ratio", "holds")


@query("SELECT o_orderkey, o_orderdate, len(list_filter([o_orderstatus, o_orderpriority], lambda x: x <> 'P')) AS n FROM orders WHERE o_orderkey % 3 = 0")
def records_with_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").withColumn("id", F.col("o_orderkey").cast("string"))
    fields = F.map_filter(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")), lambda k, v: v != "P")
    forms = o.filter("o_orderkey % 3 = 0").select("id", fields.alias("fields"))
    return restore.with_snapshots(o, forms).select("o_orderkey", "o_orderdate", F.col("n_fields").cast("long").alias("n"))


from . import image_queries, record_queries, store_queries  # noqa: E402, F401  their queries are added to those above
