"""The thin queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pseudonym_key, shared_path, table
from .exact_dedup import exact_groups
from .grammar import round_trip
from .license_scan import license_report
from .middle import middle_report
from .packing import pack, pieces
from .parity_join import near_duplicates
from .piece_codec import round_trip as piece_round_trip
from .pivot_search import top_k, whole_vectors
from .pseudonyms import pseudonymised
from .quality import quality
from .secret_scan import secret_report
from .shard_store import ShardStore
from .whitening import whitening_report

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_parity_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op4_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals, dealt by a hash of the id; what the last manifest lists, read back."""
    store = ShardStore(spark, shared_path(spark, "shards"))
    store.append_arrivals(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    rows = store.located()
    return rows.select("row.doc_id", "shard", "tier", "version", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"))


def op5_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op6_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).drop("row_key")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_report(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
n AS (SELECT doc_id, sha256(t) AS text_sha256, row_number() OVER (PARTITION BY t, doc_id) AS i,
             min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND i = 1) AS kept, text_sha256 FROM n
"""


OP7_SQL = """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM w q JOIN w c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, least(a, b)) AS pre, substr(t, least(a, b) + 1, abs(a - b)) AS mid, substr(t, greatest(a, b) + 1) AS suf FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_pivot_top_k": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_fill_in_middle": OP11_SQL}
