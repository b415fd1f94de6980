"""Join of 64-bit hashes within a Hamming distance, by bands and probes.

Of four bands of 16 bits one differs in at most a quarter of the bits that differ in all.  So the
stored side is keyed by its bands as they are, the asking side by every value within that
quarter of its own bands (137 for a distance of 8 to 11), and an equality join on (band, value)
has all pairs.  Against random hashes it lets one pair in about 120 through to the bit count, where
eleven equal bands of five or six bits let one in four or five.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hamming

BANDS, WIDTH = 4, 16


def _band(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _masks(distance: int) -> list[int]:
    """All numbers of a band's width with at most a quarter of ``distance`` bits."""
    return [m for m in range(1 << WIDTH) if m.bit_count() <= distance // BANDS]


def matched(asking: DataFrame, stored: DataFrame, distance: int, condition: Column | None = None) -> DataFrame:
    """Pairs of structs (a, b) of rows whose columns h are within a distance; each pair once.

    Both sides: h and any other columns. ``condition`` may use a and b and holds before a pair is built."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(distance)])

    def near(i: int) -> Column:
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("band"), _band(F.col("h"), i).bitwiseXOR(m).alias("v")))

    probes = F.flatten(F.array(*[near(i) for i in range(BANDS)]))
    a = asking.select(F.struct("*").alias("a"), F.explode(probes).alias("k")).select("a", "k.*")
    b = stored.select(F.struct("*").alias("b"), F.posexplode(F.array(*[_band(F.col("h"), i) for i in range(BANDS)])).alias("band", "v"))
    close = hamming(F.col("a.h"), F.col("b.h")) <= distance
    first = F.lit(BANDS)
    for i in reversed(range(BANDS)):
        first = F.when(F.bit_count(_band(F.col("a.h"), i).bitwiseXOR(_band(F.col("b.h"), i))) <= distance // BANDS, i).otherwise(first)
    j = a.join(b, (a["band"] == b["band"]) & (a["v"] == b["v"]) & (close if condition is None else close & condition))
    return j.filter(a["band"] == first).select("a", "b", hamming(F.col("a.h"), F.col("b.h")).alias("distance"))


def hamming_pairs(rows: DataFrame, key: str, hash_: str, distance: int = 10) -> DataFrame:
    """(a, b, distance) with a < b."""
    r = rows.select(F.col(key).alias("id"), F.col(hash_).alias("h"))
    return matched(r, r, distance, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "distance")


def nearest(incoming: DataFrame, stored: DataFrame, distance: int = 10, condition: Column | None = None, *order: Column) -> DataFrame:
    """For each incoming (id, h, ...) the first stored (id, h, ...) row in an order, by default the least
    distance and then the smallest id; ``condition`` and ``order`` may use a (incoming) and b (stored)."""
    pairs = matched(incoming, stored, distance, condition)
    turn = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order or (F.col("distance"),))], F.col("b.id").alias("tie"))
    best = pairs.groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.struct(F.col("b.id").alias("match"), "distance"), turn).alias("r"))
    return best.select("id", "r.*")
