"""Join on a loose prefix match, by the prefixes of the longer key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stem: int = 3) -> DataFrame:
    """Pairs whose keys are equal, or of which the shorter, of ``stem`` characters at least, starts the other.

    Either the right key is one of the left key's prefixes, itself included, or the left key is a shorter
    prefix of the right one's.  Both are equality joins on whole prefixes, so keys that merely start alike
    don't meet; a key of n characters stands for n - ``stem`` + 1 of them.

    Both sides are shuffled: either may be a table of records, whose files are far smaller than its rows in memory, so that
    a broadcast chosen by their size would not fit the driver."""
    a, b = left.filter(F.col(left_key) != "").hint("merge"), right.filter(F.col(right_key) != "").hint("merge")

    def prefixes(key: str, whole: bool):
        """Prefixes of ``stem`` characters or more; with ``whole`` the key itself, however short."""
        n, least = F.length(key), F.lit(stem)
        shorter = F.when(n > least, F.sequence(least, n - 1)).otherwise(F.array().cast("array<int>"))
        lengths = F.concat(shorter, F.array(n)) if whole else shorter
        return F.explode(F.transform(lengths, lambda k: F.substring(key, F.lit(1), k)))

    of_left = a.withColumn("__p", prefixes(left_key, True))
    of_right = b.withColumn("__q", prefixes(right_key, False))
    columns = [*left.columns, *right.columns]
    return of_left.join(b, F.col("__p") == F.col(right_key)).select(*columns).union(a.join(of_right, F.col(left_key) == F.col("__q")).select(*columns))
