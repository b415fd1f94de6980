"""Queries over images and fingerprints made of the embeddings: a vector of 64 numbers is an image of 8 x 8
pixels, whose colours and opacity its numbers give, and a 64-bit hash."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import layout, marks, raster, tiles
from .plans.components import components
from .plans.hamming_join import hamming_pairs, nearest
from .queries import query, read
from .sources import png

# hashes

_HASH_SQL = "h AS (SELECT vec_id AS id, bit_or(CASE WHEN list_extract(embedding, i::INT + 1) > 0.12 THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END) AS u FROM embeddings, range(64) r(i) GROUP BY 1)"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    bit = lambda x, i: F.when(x > 0.12, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return e.select(F.col("vec_id").alias("id"), F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("h"))


@query(f"WITH {_HASH_SQL} SELECT a.id AS a, b.id AS b, bit_count(xor(a.u, b.u))::INT AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.u, b.u)) <= 10")
def hamming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_pairs(_hashes(spark, sf_dir), "id", "h", 10)


@query(f"""WITH RECURSIVE {_HASH_SQL}, e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.u, b.u)) <= 7), c AS (SELECT id, id AS root FROM h UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id)
SELECT id, min(root) AS component FROM c GROUP BY 1""")
def visual_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hashes(spark, sf_dir)
    return components(h.select("id"), hamming_pairs(h, "id", "h", 7).select("a", "b"))


@query(f"WITH {_HASH_SQL} SELECT a.id, arg_min(b.id, (bit_count(xor(a.u, b.u)), b.id)) AS match, min(bit_count(xor(a.u, b.u)))::INT AS distance FROM h a JOIN h b ON a.id % 10 = 0 AND b.id % 10 <> 0 AND bit_count(xor(a.u, b.u)) <= 10 GROUP BY 1")
def nearest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth mark is new, the others are stored."""
    h = _hashes(spark, sf_dir)
    return nearest(h.filter("id % 10 = 0"), h.filter("id % 10 <> 0"), 10)


# marks: fingerprints with shapes, ink, sizes and names

_PRINTS_SQL = f"""{_HASH_SQL}, p AS (SELECT id, u, 1 + (id % 7) / 10.0::DOUBLE AS aspect, (40 + id % 90)::INT AS ink, (1000 + 40 * (id % 11))::INT AS bytes, 'brand' || id % 37 AS stem FROM h),
v AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.u, b.u))::INT AS distance, least(a.bytes, b.bytes) >= greatest(a.bytes, b.bytes) * 0.88::DOUBLE - 1e-9 AS fits, contains(a.stem, b.stem) OR contains(b.stem, a.stem) AS related FROM p a JOIN p b ON a.id <> b.id
AND bit_count(xor(a.u, b.u)) <= 10 AND abs(a.aspect - b.aspect) / greatest(a.aspect, b.aspect) <= 0.22 AND abs(a.ink - b.ink) / greatest(a.ink, b.ink) <= 0.55)"""


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    h = _hashes(spark, sf_dir).withColumn("aspect", 1 + (i % 7) / 10).withColumn("ink", (40 + i % 90).cast("int")).withColumn("bytes", (1000 + 40 * (i % 11)).cast("int"))
    return h.withColumn("width", (100 + i % 13).cast("int")).withColumn("height", F.lit(100)).withColumn("name", F.concat(F.lit("Brand "), (i % 37).cast("string"), F.when(i % 3 == 0, "(2).png").otherwise(".png")))


@query(f"WITH {_PRINTS_SQL} SELECT a, b FROM v WHERE a < b")
def visual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.visual_pairs(_prints(spark, sf_dir))


@query(f"WITH {_PRINTS_SQL} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND (contains(a.stem, b.stem) OR contains(b.stem, a.stem))")
def related_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.related_pairs(_prints(spark, sf_dir))


@query(f"""WITH {_PRINTS_SQL}, w AS (SELECT *, related AND fits AS known FROM v WHERE a % 10 = 0 AND b % 10 <> 0)
SELECT a AS id, b AS match, distance FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY CASE WHEN known THEN 0 ELSE distance + 1 END, (NOT fits)::INT, CASE WHEN fits AND NOT known THEN -b ELSE b END) = 1""")
def reusable_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prints(spark, sf_dir)
    return marks.find_reusable(p.filter("id % 10 = 0"), p.filter("id % 10 <> 0"))


@query(f"""WITH RECURSIVE {_PRINTS_SQL}, e AS (SELECT a, b FROM v UNION SELECT a.id, b.id FROM p a JOIN p b ON a.id <> b.id AND a.stem = b.stem UNION SELECT min(a.id), min(b.id) FROM p a JOIN p b ON a.stem <> b.stem AND (contains(a.stem, b.stem) OR contains(b.stem, a.stem)) GROUP BY a.stem, b.stem),
c AS (SELECT id, id AS root FROM p UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id) SELECT id, min(root) AS cluster FROM c GROUP BY 1""")
def mark_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.clusters(_prints(spark, sf_dir))


_SEED = "STRUCT(u HUGEINT, aspect DOUBLE, ink INTEGER, width BIGINT)"


@query(f"""WITH RECURSIVE {_PRINTS_SQL}, c AS (SELECT id, u, aspect, ink, 100 + id % 13 AS width, id % 5 AS cluster, row_number() OVER (PARTITION BY id % 5 ORDER BY id) AS n FROM p),
s AS (SELECT DISTINCT cluster, 0::BIGINT AS n, []::{_SEED}[] AS seeds FROM c UNION ALL SELECT s.cluster, c.n, CASE WHEN len(list_filter(s.seeds, lambda x: bit_count(xor(c.u, x.u)) <= 10 AND abs(c.aspect - x.aspect) / greatest(c.aspect, x.aspect) <= 0.28
AND abs(c.width - x.width) / greatest(c.width, x.width)::DOUBLE <= 0.18 AND abs(c.ink - x.ink) / greatest(c.ink, x.ink)::DOUBLE <= 0.28)) = 0 THEN list_append(s.seeds, {{'u': c.u, 'aspect': c.aspect, 'ink': c.ink, 'width': c.width}}::{_SEED}) ELSE s.seeds END FROM s JOIN c ON c.cluster = s.cluster AND c.n = s.n + 1),
f AS (SELECT cluster, arg_max(seeds, n) AS seeds FROM s GROUP BY 1), d AS (SELECT id, cluster, list_transform(seeds, lambda x: bit_count(xor(c.u, x.u))) AS apart FROM c JOIN f USING (cluster))
SELECT id, cluster, (list_position(apart, list_min(apart)) - 1)::INT AS version FROM d""")
def mark_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy versions of the prints of five large clusters."""
    return marks.versions(_prints(spark, sf_dir).withColumn("cluster", F.col("id") % 5))


# pixels

_PIXELS_SQL = """px AS (SELECT 'v' || vec_id AS img_id, (i % 8)::INT AS x, (i // 8)::INT AS y, CASE WHEN w < 0.03 THEN 250 WHEN w < 0.05 THEN 20 ELSE floor(w * 2000)::INT % 256 END AS r, CASE WHEN w < 0.03 THEN 250 WHEN w < 0.05 THEN 20 ELSE floor(w * 3000)::INT % 256 END AS g,
CASE WHEN w < 0.03 THEN 250 WHEN w < 0.05 THEN 20 ELSE floor(w * 700)::INT % 256 END AS b, CASE WHEN v < -0.1 THEN 0 WHEN v > 0.15 THEN 120 ELSE 255 END AS a FROM (SELECT vec_id, i::INT AS i, embedding[i::INT + 1]::DOUBLE AS v, abs(embedding[i::INT + 1]::DOUBLE) AS w FROM embeddings, range(64) t(i)))"""
_INK = "(a >= 16 AND least(r, g, b) < 240)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "f"))
    p = e.select("vec_id", "i", F.col("f").cast("double").alias("v"), F.abs(F.col("f").cast("double")).alias("w"))
    channel = lambda by: F.when(F.col("w") < 0.03, 250).when(F.col("w") < 0.05, 20).otherwise((F.floor(F.col("w") * by) % 256).cast("int"))
    alpha = F.when(F.col("v") < -0.1, 0).when(F.col("v") > 0.15, 120).otherwise(255)
    return p.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("img_id"), (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), channel(2000).alias("r"), channel(3000).alias("g"), channel(700).alias("b"), alpha.alias("a"))


_NEAR = "abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND NOT (n.x = p.x AND n.y = p.y)"
_COUNTED = f"i AS (SELECT img_id, x, y FROM px WHERE {_INK}), k AS (SELECT p.img_id, p.x, p.y, p.r, p.g, p.b, p.a, count(n.x) AS ink_near FROM px p LEFT JOIN i n ON n.img_id = p.img_id AND {_NEAR} GROUP BY ALL)"


@query(f"WITH {_PIXELS_SQL}, k AS (SELECT img_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS ink FROM px WHERE {_INK} GROUP BY 1) SELECT *, (x1 - x0 + 1)::DOUBLE / (y1 - y0 + 1) AS aspect, ink::DOUBLE / ((x1 - x0 + 1) * (y1 - y0 + 1)) AS fill FROM k")
def ink_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.ink_box(_pixels(spark, sf_dir))


@query(f"WITH {_PIXELS_SQL}, k AS (SELECT img_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE {_INK} GROUP BY 1) SELECT img_id, greatest(x0 - 1, 0) AS x0, greatest(y0 - 1, 0) AS y0, least(x1 + 1, 7) AS x1, least(y1 + 1, 7) AS y1 FROM k")
def inset_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.inset_box(_pixels(spark, sf_dir), 1)


@query(f"WITH {_PIXELS_SQL}, k AS (SELECT img_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS bucket, count(*) AS n FROM px WHERE a >= 16 GROUP BY 1, 2) SELECT img_id, bucket, n, n::DOUBLE / sum(n) OVER (PARTITION BY img_id) AS share, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, bucket)::INT AS place FROM k QUALIFY place <= 6")
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.histogram(_pixels(spark, sf_dir))


@query(f"""WITH {_PIXELS_SQL}, l AS (SELECT img_id, y * 8 + x AS i, (r * 299 + g * 587 + b * 114)::DOUBLE / 1000 AS l FROM px), m AS (SELECT *, avg(l) OVER (PARTITION BY img_id) AS m FROM l),
h AS (SELECT img_id, bit_or(CASE WHEN l >= m THEN 1::HUGEINT << i ELSE 0::HUGEINT END) AS h FROM m GROUP BY 1) SELECT img_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM h""")
def block_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_hash(_pixels(spark, sf_dir))


@query(f"""WITH {_PIXELS_SQL}, p AS (SELECT * FROM px WHERE {_INK}), o AS (SELECT img_id, x + 1 AS x, y, r, g, b FROM p), j AS (SELECT coalesce(p.img_id, o.img_id) AS img_id, p.x IS NOT NULL AND o.x IS NOT NULL AS "both", abs(p.r - o.r) + abs(p.g - o.g) + abs(p.b - o.b) AS e FROM p FULL JOIN o ON p.img_id = o.img_id AND p.x = o.x AND p.y = o.y)
SELECT img_id, count(*) FILTER ("both") AS "both", count(*) AS either, count(*) FILTER ("both")::DOUBLE / count(*) AS iou, round(sum(e) FILTER ("both") / 3.0 / count(*) FILTER ("both"), 6) AS error FROM j GROUP BY 1""")
def mask_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return raster.mask_agreement(p, p.withColumn("x", F.col("x") + 1)).withColumn("error", F.round("error", 6))


@query(f"WITH {_PIXELS_SQL} SELECT img_id, avg((a < 16)::INT) AS share FROM px WHERE x < 1 OR y < 1 OR x > 6 OR y > 6 GROUP BY 1")
def clear_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.border_share(_pixels(spark, sf_dir), F.col("a") < 16, 1)


@query(f"WITH {_PIXELS_SQL} SELECT img_id, avg((a >= 16)::INT) AS share FROM px WHERE x % 3 = 0 AND y % 3 = 0 GROUP BY 1")
def sampled_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sampled_share(_pixels(spark, sf_dir), F.col("a") >= 16, 3)


@query(f"WITH {_PIXELS_SQL}, {_COUNTED} SELECT img_id, x, y, ink_near, 8 - ink_near AS empty_near FROM k")
def neighbour_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.neighbour_counts(_pixels(spark, sf_dir)).select("img_id", "x", "y", "ink_near", "empty_near")


@query(f"WITH {_PIXELS_SQL}, {_COUNTED} SELECT img_id, x, y, r, g, b, a FROM k WHERE {_INK} OR ink_near > 0")
def dilated_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilated(_pixels(spark, sf_dir))


@query(f"WITH {_PIXELS_SQL}, {_COUNTED} SELECT img_id, x, y, r, g, b, a FROM k WHERE {_INK} AND EXISTS (FROM i n WHERE n.img_id = k.img_id AND n.x = k.x + 1 AND n.y = k.y) AND EXISTS (FROM i n WHERE n.img_id = k.img_id AND n.x = k.x - 1 AND n.y = k.y) AND EXISTS (FROM i n WHERE n.img_id = k.img_id AND n.x = k.x AND n.y = k.y + 1) AND EXISTS (FROM i n WHERE n.img_id = k.img_id AND n.x = k.x AND n.y = k.y - 1)")
def eroded_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.eroded(_pixels(spark, sf_dir))


@query(f"WITH {_PIXELS_SQL}, {_COUNTED} SELECT img_id, x, y, r, g, b, CASE WHEN least(r, g, b) >= 200 AND ink_near BETWEEN 1 AND 6 AND a > 0 THEN 0 ELSE a END AS a FROM k")
def rims_punched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rim_punched(_pixels(spark, sf_dir))


@query(f"""WITH {_PIXELS_SQL}, s AS (SELECT * FROM px WHERE a >= 200 AND least(r, g, b) < 240), m AS (SELECT p.img_id, p.x, p.y, (sum(n.r) // count(*))::INT AS r, (sum(n.g) // count(*))::INT AS g, (sum(n.b) // count(*))::INT AS b FROM px p JOIN s n ON n.img_id = p.img_id AND {_NEAR} GROUP BY ALL)
SELECT px.img_id, px.x, px.y, CASE WHEN px.a BETWEEN 16 AND 199 AND m.r IS NOT NULL THEN m.r ELSE px.r END AS r, CASE WHEN px.a BETWEEN 16 AND 199 AND m.r IS NOT NULL THEN m.g ELSE px.g END AS g, CASE WHEN px.a BETWEEN 16 AND 199 AND m.r IS NOT NULL THEN m.b ELSE px.b END AS b,
CASE WHEN px.a BETWEEN 16 AND 199 AND m.r IS NOT NULL THEN 255 ELSE px.a END AS a FROM px LEFT JOIN m ON m.img_id = px.img_id AND m.x = px.x AND m.y = px.y""")
def hardened_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.hardened(_pixels(spark, sf_dir))


@query(f"""WITH {_PIXELS_SQL}, f AS (SELECT img_id, x, y FROM px WHERE {_INK} AND greatest(r, g, b) > 48), d AS (SELECT p.* FROM px p WHERE {_INK} AND greatest(r, g, b) <= 48 AND EXISTS (FROM f n WHERE n.img_id = p.img_id AND {_NEAR})),
e AS (SELECT img_id, count(*) AS n, floor(avg(r))::INT AS r, floor(avg(g))::INT AS g, floor(avg(b))::INT AS b FROM d GROUP BY 1), c AS (SELECT img_id, count(*) AS n FROM f GROUP BY 1) SELECT e.img_id, e.r, e.g, e.b, e.n::DOUBLE / c.n AS share FROM e JOIN c USING (img_id) WHERE e.n::DOUBLE / c.n BETWEEN 0.02 AND 0.5""")
def outline_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.outline_colour(_pixels(spark, sf_dir))


@query(f"""WITH {_PIXELS_SQL}, o AS (SELECT * FROM px WHERE a >= 16), k AS (SELECT px.*, EXISTS (FROM o n WHERE n.img_id = px.img_id AND abs(n.x - px.x) <= 2 AND abs(n.y - px.y) <= 2) AND a < 16 AS ring FROM px)
SELECT img_id, x, y, CASE WHEN ring THEN 10 ELSE r END AS r, CASE WHEN ring THEN 20 ELSE g END AS g, CASE WHEN ring THEN 30 ELSE b END AS b, CASE WHEN ring THEN 255 ELSE a END AS a FROM k""")
def outlines_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.per_image(_pixels(spark, sf_dir), lambda g: raster.outlined(g, 2, (10, 20, 30)))


@query(f"""WITH {_PIXELS_SQL}, c AS (SELECT *, greatest(abs(r - 200), abs(g - 40), abs(b - 60)) AS d1, greatest(abs(r - 20), abs(g - 60), abs(b - 180)) AS d2, greatest(r, g, b) - least(r, g, b) <= 18 AS grey, greatest(abs(r - 90), abs(g - 90), abs(b - 90)) AS d3 FROM px),
k AS (SELECT *, CASE WHEN grey AND d3 <= 48 THEN 3 WHEN NOT grey AND d1 <= 48 AND d1 <= d2 THEN 1 WHEN NOT grey AND d2 <= 48 THEN 2 ELSE 0 END AS o FROM c)
SELECT img_id, x, y, [r, 200, 20, 90][o + 1] AS r, [g, 40, 60, 90][o + 1] AS g, [b, 60, 180, 90][o + 1] AS b, a FROM k""")
def palette_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.nearest_palette(_pixels(spark, sf_dir), [(200, 40, 60), (20, 60, 180), (90, 90, 90)])


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, i AS (SELECT img_id, x, y, x + y * 8 + 1 AS id FROM px WHERE {_INK}), c AS (SELECT img_id, x, y, id AS root FROM i UNION SELECT i.img_id, i.x, i.y, c.root FROM c JOIN i ON i.img_id = c.img_id AND abs(i.x - c.x) <= 1 AND abs(i.y - c.y) <= 1),
l AS (SELECT img_id, x, y, min(root) AS root FROM c GROUP BY ALL) SELECT img_id, root::INT AS region, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*)::INT AS n FROM l GROUP BY 1, 2""")
def ink_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.regions(_pixels(spark, sf_dir))


_EDGE = "x = 0 OR y = 0 OR x = 7 OR y = 7"


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, m AS (SELECT img_id, r AS pr, g AS pg, b AS pb FROM px WHERE a >= 16 AND ({_EDGE}) GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, r, g, b) = 1),
p AS (SELECT px.img_id, x, y FROM px JOIN m USING (img_id) WHERE a >= 16 AND greatest(abs(r - pr), abs(g - pg), abs(b - pb)) <= 24), c AS (SELECT * FROM p WHERE {_EDGE} UNION SELECT p.img_id, p.x, p.y FROM c JOIN p ON p.img_id = c.img_id AND abs(p.x - c.x) + abs(p.y - c.y) = 1)
SELECT px.img_id, px.x, px.y, r, g, b, CASE WHEN c.x IS NULL THEN a ELSE 0 END AS a FROM px LEFT JOIN c ON c.img_id = px.img_id AND c.x = px.x AND c.y = px.y""")
def backgrounds_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.per_image(_pixels(spark, sf_dir), raster.without_background)


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, p AS (SELECT img_id, x, y, x + y * 8 AS id FROM px WHERE a >= 16 AND least(r, g, b) >= 240), c AS (SELECT img_id, x, y, id AS root FROM p UNION SELECT p.img_id, p.x, p.y, c.root FROM c JOIN p ON p.img_id = c.img_id AND abs(p.x - c.x) <= 1 AND abs(p.y - c.y) <= 1),
l AS (SELECT img_id, x, y, min(root) AS root FROM c GROUP BY ALL), h AS (SELECT img_id, root FROM l GROUP BY 1, 2 HAVING NOT bool_or({_EDGE}) AND count(*) <= 0.2 * 64), k AS (SELECT l.img_id, l.x, l.y FROM l JOIN h USING (img_id, root))
SELECT px.img_id, px.x, px.y, r, g, b, CASE WHEN k.x IS NULL THEN a ELSE 0 END AS a FROM px LEFT JOIN k ON k.img_id = px.img_id AND k.x = px.x AND k.y = px.y""")
def holes_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.per_image(_pixels(spark, sf_dir), raster.holes_punched)


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, q AS (SELECT *, (r >> 6) * 4096 + (g >> 6) * 64 + (b >> 6) AS code FROM px WHERE a >= 16), c AS (SELECT img_id, x, y, code, x + y * 8 AS root FROM q UNION SELECT q.img_id, q.x, q.y, q.code, c.root FROM c JOIN q ON q.img_id = c.img_id AND q.code = c.code AND abs(q.x - c.x) + abs(q.y - c.y) = 1),
l AS (SELECT img_id, x, y, min(root) AS root FROM c GROUP BY ALL), w AS (SELECT l.*, px.r, px.g, px.b FROM l JOIN px USING (img_id, x, y)), m AS (SELECT img_id, root, list_sort(list(r))[count(*) // 2 + 1] AS mr, list_sort(list(g))[count(*) // 2 + 1] AS mg, list_sort(list(b))[count(*) // 2 + 1] AS mb FROM w GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT px.img_id, px.x, px.y, coalesce(mr, r) AS r, coalesce(mg, g) AS g, coalesce(mb, b) AS b, a FROM px LEFT JOIN l ON l.img_id = px.img_id AND l.x = px.x AND l.y = px.y LEFT JOIN m ON m.img_id = l.img_id AND m.root = l.root""")
def fills_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.per_image(_pixels(spark, sf_dir), lambda g: raster.flattened(g, 6, 3))


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, q AS (SELECT *, greatest(abs(r - 250), abs(g - 250), abs(b - 250)) <= 40 AS plate FROM px WHERE a >= 16), f AS (SELECT p.img_id, p.x, p.y FROM q p WHERE plate AND NOT EXISTS (FROM q n WHERE n.img_id = p.img_id AND NOT n.plate AND abs(n.x - p.x) <= 2 AND abs(n.y - p.y) <= 2)),
s AS (SELECT f.* FROM f JOIN px p ON p.img_id = f.img_id AND p.a < 16 AND abs(p.x - f.x) <= 1 AND abs(p.y - f.y) <= 1 UNION SELECT * FROM f WHERE {_EDGE}), c AS (SELECT * FROM s UNION SELECT f.img_id, f.x, f.y FROM c JOIN f ON f.img_id = c.img_id AND abs(f.x - c.x) <= 1 AND abs(f.y - c.y) <= 1)
SELECT px.img_id, px.x, px.y, r, g, b, CASE WHEN c.x IS NULL THEN a ELSE 0 END AS a FROM px LEFT JOIN c ON c.img_id = px.img_id AND c.x = px.x AND c.y = px.y""")
def remnants_punched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.per_image(_pixels(spark, sf_dir), lambda g: raster.without_remnants(g, (250, 250, 250)))


_BACKGROUND = """w AS (SELECT * FROM px WHERE (x < 2 OR x > 5) AND (y < 2 OR y > 5)), m AS (SELECT img_id, list_sort(list(r))[9] AS br, list_sort(list(g))[9] AS bg, list_sort(list(b))[9] AS bb FROM w GROUP BY 1),
bk AS (SELECT img_id, br, bg, bb, avg((greatest(abs(r - br), abs(g - bg), abs(b - bb)) <= 60)::INT) AS share FROM w JOIN m USING (img_id) GROUP BY 1, 2, 3, 4 HAVING share >= 0.2)"""


@query(f"WITH {_PIXELS_SQL}, {_BACKGROUND} SELECT * FROM bk")
def corner_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.background(_pixels(spark, sf_dir), 2, 0.2, 60)


@query(f"""WITH {_PIXELS_SQL}, {_BACKGROUND}, q AS (SELECT px.*, greatest(abs(r - br), abs(g - bg), abs(b - bb)) <= 24 AS plate FROM px JOIN bk USING (img_id)), o AS (SELECT * FROM q WHERE a >= 16 AND NOT plate)
SELECT p.img_id, p.x, p.y FROM q p WHERE NOT plate AND EXISTS (FROM o n WHERE n.img_id = p.img_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1)""")
def protected_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return raster.protected(p, raster.background(p, 2, 0.2, 60))


@query(f"""WITH {_PIXELS_SQL}, l AS (SELECT img_id, x, y, (r + g + b) / 3.0::DOUBLE AS l FROM px WHERE a >= 16), j AS (SELECT p.img_id, abs(p.l - d.l) < 50 AND abs(e.l - s.l) < 50 AND abs(p.l - e.l) >= 100 AS hit FROM l p JOIN l e ON e.img_id = p.img_id AND e.x = p.x + 2 AND e.y = p.y
JOIN l s ON s.img_id = p.img_id AND s.x = p.x AND s.y = p.y + 2 JOIN l d ON d.img_id = p.img_id AND d.x = p.x + 2 AND d.y = p.y + 2 WHERE p.x % 2 = 0 AND p.y % 2 = 0) SELECT img_id, avg(hit::INT) AS share FROM j GROUP BY 1""")
def checkerboard_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.checkerboard_share(_pixels(spark, sf_dir), 2, 100)


@query(f"WITH {_PIXELS_SQL}, b AS (SELECT img_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE {_INK} AND a < 200 GROUP BY 1) SELECT px.img_id, x - greatest(x0 - 1, 0) AS x, y - greatest(y0 - 1, 0) AS y, r, g, b, a FROM px JOIN b USING (img_id) WHERE x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1")
def trimmed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut to the box of half-clear ink, with a margin of one pixel."""
    return raster.trimmed(_pixels(spark, sf_dir), 1, raster.is_ink() & (F.col("a") < 200))


@query(f"""WITH {_PIXELS_SQL}, c AS (SELECT img_id, 'x' AS side, x AS place, count(*) FILTER ({_INK}) / 8.0::DOUBLE AS share FROM px GROUP BY ALL UNION ALL SELECT img_id, 'y', y, count(*) FILTER ({_INK}) / 8.0::DOUBLE FROM px GROUP BY ALL), b AS (SELECT img_id, min(place) FILTER (side = 'x') AS x0, max(place) FILTER (side = 'x') AS x1, min(place) FILTER (side = 'y') AS y0, max(place) FILTER (side = 'y') AS y1 FROM c WHERE share >= 0.6 GROUP BY 1)
SELECT px.img_id, x - x0 AS x, y - y0 AS y, r, g, b, a FROM px JOIN b USING (img_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def thin_margins_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.trimmed_by_coverage(_pixels(spark, sf_dir), 0.6)


@query(f"""WITH {_PIXELS_SQL}, k AS (SELECT img_id, (max(x) - min(x) + 1)::DOUBLE / (max(y) - min(y) + 1) AS aspect, count(*) AS ink, count(*)::DOUBLE / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) AS fill FROM px WHERE {_INK} GROUP BY 1),
o AS (SELECT img_id, (max(x) - min(x) + 1)::DOUBLE / (max(y) - min(y) + 1) AS aspect FROM px WHERE {_INK} AND a = 120 GROUP BY 1) SELECT img_id, abs(k.aspect - o.aspect) / k.aspect AS drift, fill < 0.5 AND ink >= 20 AS thin FROM k JOIN o USING (img_id)""")
def drifts_and_thin_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    box = raster.ink_box(p)
    return raster.aspect_drift(box, raster.ink_box(p, raster.is_ink() & (F.col("a") == 120))).join(raster.is_thin(box, 0.5, 20), "img_id")


@query(f"""WITH {_PIXELS_SQL}, c AS (SELECT img_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, greatest(r, g, b) / 255.0::DOUBLE AS hi, (greatest(r, g, b) - least(r, g, b)) / 255.0::DOUBLE AS d FROM px WHERE {_INK} AND greatest(r, g, b) - least(r, g, b) > 18),
h AS (SELECT img_id, radians(60 * CASE WHEN hi = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END) AS t FROM c), m AS (SELECT img_id, degrees(atan2(avg(sin(t)), avg(cos(t)))) AS hue FROM h GROUP BY 1) SELECT img_id, round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END, 3) AS hue FROM m""")
def hue_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.hue_anchor(_pixels(spark, sf_dir)).withColumn("hue", F.round("hue", 3))


@query(f"""WITH {_PIXELS_SQL} SELECT img_id, x, y, r, g, b, round(greatest(r, g, b) / 255.0, 6)::DOUBLE AS value, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round((greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b), 6) END AS saturation FROM px""")
def hsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours to hue, saturation and value, and back."""
    p = _pixels(spark, sf_dir).withColumn("c", raster.to_hsv(F.col("r"), F.col("g"), F.col("b")))
    back = raster.from_hsv(F.col("c.h"), F.col("c.s"), F.col("c.v"))
    return p.select("img_id", "x", "y", back["r"].alias("r"), back["g"].alias("g"), back["b"].alias("b"), F.round("c.v", 6).alias("value"), F.round("c.s", 6).alias("saturation"))


@query(f"WITH {_PIXELS_SQL} SELECT img_id, x, y, least(r, g, b) >= 240 AS plate, greatest(r, g, b) - least(r, g, b) <= 18 AS grey, greatest(r, g, b) <= 48 AS black, {_INK} AS ink, greatest(abs(r - 10), abs(g - 20), abs(b - 30)) AS distance FROM px")
def pixel_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("img_id", "x", "y", raster.is_plate().alias("plate"), raster.is_grey().alias("grey"), raster.is_near_black().alias("black"), raster.is_ink().alias("ink"), raster.colour_distance(F.col("r"), F.col("g"), F.col("b"), F.lit(10), F.lit(20), F.lit(30)).alias("distance"))


@query(f"WITH {_PIXELS_SQL}, d AS (SELECT img_id, x, y, trunc(255 - (r * 299 + g * 587 + b * 114) / 1000.0::DOUBLE)::INT AS a FROM px) SELECT img_id, x, y, 0 AS r, 0 AS g, 0 AS b, a FROM d WHERE a >= 18")
def signature_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.signature_ink(_pixels(spark, sf_dir))


@query(f"WITH {_PIXELS_SQL} SELECT img_id, x - 2 AS x, y - 1 AS y, r, g, b, a FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
def cropped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cropped(_pixels(spark, sf_dir), 0.25, 0.125, 0.5, 0.75)


@query("SELECT p_partkey, greatest(4, least(64, round(p_size * 20 * 0.06::DOUBLE)))::INT AS x, greatest(4, least(64, round((p_size + 3) * 20 * 0.06::DOUBLE)))::INT AS y FROM part")
def pad_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select("p_partkey", raster.pad_sizes(F.col("p_size") * 20, (F.col("p_size") + 3) * 20).alias("s")).select("p_partkey", "s.*")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 25 - 0.5 AS x, l_linenumber / 5.0::DOUBLE AS w FROM lineitem), k AS (SELECT *, least(greatest(w, 0.05), 1) AS bw FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(x, 1 - bw)), 9) AS "left", round(bw, 9) AS width FROM k""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")  # noqa: E741
    box = layout.clamped_box(F.col("l_quantity") / 25 - 0.5, F.lit(0.0), F.col("l_linenumber") / 5, F.lit(1.0))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", F.round("b.left", 9).alias("left"), F.round("b.width", 9).alias("width"))


@query(f"WITH {_PIXELS_SQL} SELECT * FROM px")
def png_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels written as PNG files and read again."""

    def file(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "content": [png.encode(raster.grid(p))]})

    return png.pixels(_pixels(spark, sf_dir).groupBy("img_id").applyInPandas(file, "path string, content binary"))


@query(f"""WITH {_HASH_SQL}, k AS (SELECT id, bit_count(u)::INT AS n FROM h) SELECT a.id AS a, b.id AS b, a.n + b.n AS bits FROM k a JOIN k b ON b.id = a.id + 1""")
def hash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of neighbours' hashes: their distances from an empty hash."""
    h = _hashes(spark, sf_dir).withColumn("n", T.hamming(F.col("h"), F.lit(0).cast("long")))
    b = h.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("n").alias("m"))
    return h.join(b, F.col("id") == F.col("a")).select("a", "b", (F.col("n") + F.col("m")).alias("bits"))


# other sizes


def _resize_sql(n: int, weights: str) -> str:
    return f"""WITH {_PIXELS_SQL}, k AS ({weights}), f AS (SELECT img_id, x, y, (r * a)::DOUBLE AS r, (g * a)::DOUBLE AS g, (b * a)::DOUBLE AS b, a::DOUBLE AS a FROM px),
h AS (SELECT img_id, y, t AS x, sum(r * w) AS r, sum(g * w) AS g, sum(b * w) AS b, sum(a * w) AS a FROM f JOIN k ON s = x GROUP BY ALL), v AS (SELECT img_id, x, t AS y, sum(r * w) AS r, sum(g * w) AS g, sum(b * w) AS b, sum(a * w) AS a FROM h JOIN k ON s = y GROUP BY ALL)
SELECT img_id, x::INT AS x, y::INT AS y, {', '.join(f"greatest(0, least(255, floor(CASE WHEN a > 1e-6 THEN {c} / a ELSE 0 END + 0.500001)))::INT AS {c}" for c in "rgb")}, greatest(0, least(255, floor(a + 0.500001)))::INT AS a FROM v"""


_AVERAGED = "SELECT t, s, (least((t + 1) * 1.6::DOUBLE, s + 1) - greatest(t * 1.6::DOUBLE, s)) / 1.6::DOUBLE AS w FROM range(5) a(t), range(8) b(s) WHERE s < (t + 1) * 1.6::DOUBLE - 1e-9 AND s + 1 > t * 1.6::DOUBLE + 1e-9"
_CUBED = """SELECT t, least(greatest(floor(t * 8 / 13.0::DOUBLE)::INT + k, 0), 7) AS s, sum(CASE k WHEN -1 THEN -d + 2 * d * d - d * d * d WHEN 0 THEN 2 - 5 * d * d + 3 * d * d * d WHEN 1 THEN d + 4 * d * d - 3 * d * d * d ELSE d * d * d - d * d END / 2) AS w
FROM (SELECT t, t * 8 / 13.0::DOUBLE - floor(t * 8 / 13.0::DOUBLE) AS d FROM range(13) a(t)), (VALUES (-1), (0), (1), (2)) v(k) GROUP BY 1, 2"""


@query(_resize_sql(5, _AVERAGED))
def averaged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return raster.resized_pixels(p, p.select("img_id").distinct().select("img_id", F.lit(5).alias("width"), F.lit(5).alias("height")))


@query(_resize_sql(13, _CUBED))
def cubic_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return raster.resized_pixels(p, p.select("img_id").distinct().select("img_id", F.lit(13).alias("width"), F.lit(13).alias("height")), "cubic")


# one large image of all vectors: a row of 40 small images, and as many rows as it takes

_MOSAIC_SQL = f"{_PIXELS_SQL}, mo AS (SELECT img_id[2:]::BIGINT % 40 * 8 + x AS x, img_id[2:]::BIGINT // 40 * 8 + y AS y, r, g, b, a FROM px)"


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("img_id", 2, 20).cast("long")
    return _pixels(spark, sf_dir).select(F.lit("m").alias("img_id"), (n % 40 * 8 + F.col("x")).cast("int").alias("x"), (F.floor(n / 40) * 8 + F.col("y")).cast("int").alias("y"), "r", "g", "b", "a")


@query(f"""WITH RECURSIVE {_MOSAIC_SQL}, i AS (SELECT x, y, y * 4294967296 + x AS id FROM mo WHERE a = 120), c AS (SELECT x, y, id AS root FROM i UNION SELECT i.x, i.y, c.root FROM c, (VALUES (-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)) d(dx, dy) JOIN i ON i.x = c.x + dx AND i.y = c.y + dy AND i.id > c.root)
, l AS (SELECT x, y, min(root) AS root FROM c GROUP BY ALL) SELECT root AS region, min(x)::INT AS x0, min(y)::INT AS y0, max(x)::INT AS x1, max(y)::INT AS y1, count(*) AS n FROM l GROUP BY 1""")
def mosaic_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of half-clear pixels across the whole mosaic, from tiles of 64 x 64."""
    return tiles.boxes(tiles.regions(_mosaic(spark, sf_dir), F.col("a") == 120, True, 64)).drop("img_id")


@query(f"""WITH RECURSIVE {_MOSAIC_SQL}, z AS (SELECT max(x) AS w, max(y) AS h FROM mo), e AS (SELECT mo.* FROM mo, z WHERE x = 0 OR y = 0 OR x = w OR y = h), m AS (SELECT r AS pr, g AS pg, b AS pb FROM e WHERE a >= 16 GROUP BY 1, 2, 3 ORDER BY count(*) DESC, 1, 2, 3 LIMIT 1),
p AS (SELECT x, y FROM mo, m WHERE a >= 16 AND greatest(abs(r - pr), abs(g - pg), abs(b - pb)) <= 24), c AS (SELECT p.x, p.y FROM p JOIN e USING (x, y) UNION SELECT p.x, p.y FROM c, (VALUES (0, -1), (-1, 0), (1, 0), (0, 1)) d(dx, dy) JOIN p ON p.x = c.x + dx AND p.y = c.y + dy)
SELECT mo.x::INT AS x, mo.y::INT AS y, r, g, b, CASE WHEN c.x IS NULL THEN a ELSE 0 END AS a FROM mo LEFT JOIN c ON c.x = mo.x AND c.y = mo.y""")
def mosaic_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.backgrounds_cleared(_mosaic(spark, sf_dir), tile=64).drop("img_id")


# layers of colours

_NEAREST = "list_transform(pts, lambda p: list_position(list_transform(c, lambda q: greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b))), list_min(list_transform(c, lambda q: greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b))))))"
_POINT = "STRUCT(r DOUBLE, g DOUBLE, b DOUBLE)"


def _mean(channel: str) -> str:
    return f"list_avg(list_transform(list_filter(list_zip(pts, lab), lambda z: z[2] = i), lambda z: z[1].{channel}))"


@query(f"""WITH RECURSIVE {_PIXELS_SQL}, o AS (SELECT img_id, list({{'r': r, 'g': g, 'b': b}}::{_POINT} ORDER BY r, g, b) AS pts FROM px WHERE a >= 16 GROUP BY 1),
s AS (SELECT img_id, 0 AS k, list_transform([0, 1, 2], lambda i: pts[floor((len(pts) - 1) * i / 2.0)::INT + 1]) AS c FROM o
UNION ALL SELECT img_id, k + 1, list_transform([1, 2, 3], lambda i: CASE WHEN list_contains(lab, i) THEN {{'r': {_mean('r')}, 'g': {_mean('g')}, 'b': {_mean('b')}}}::{_POINT} ELSE c[i] END)
FROM (SELECT s.img_id, s.k, s.c, o.pts, {_NEAREST} AS lab FROM s JOIN o USING (img_id) WHERE s.k < 8))
SELECT img_id, i::INT AS layer, round(c[i].r, 6) AS r, round(c[i].g, 6) AS g, round(c[i].b, 6) AS b, len(list_filter({_NEAREST}, lambda x: x = i))::INT AS n FROM s JOIN o USING (img_id), range(1, 4) t(i) WHERE k = 8""")
def colour_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of each image: their centres after eight rounds and how many pixels each has."""

    def find(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        centres, label = raster.colour_layers(raster.grid(p), 3)
        rows = [(key[0], i + 1, *(round(float(v), 6) for v in c), int((label == i).sum())) for i, c in enumerate(centres)]
        return pd.DataFrame(rows, columns=["img_id", "layer", "r", "g", "b", "n"])

    return _pixels(spark, sf_dir).groupBy("img_id").applyInPandas(find, "img_id string, layer int, r double, g double, b double, n int")
