"""Joins that stay even where keys are skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import one_name, small_side, written

#: Rows of one key that go to one task.
SALT_ROWS = 2_000


def spread_join(a: DataFrame, b: DataFrame, keys: list[str], rows: int = SALT_ROWS) -> DataFrame:
    """Inner join of a and b on keys; a key with more than `rows` rows of b goes to several tasks, its rows of a to each of them.

    Keys are counted by a map-side combined aggregate.  Null keys meet nothing.
    """
    both = a.select("*", *[F.lit(None).alias(c) for c in b.columns if c not in a.columns])
    salts, salt = one_name(both, "salts"), one_name(both, "salt")
    n = b.groupBy(*keys).agg(F.count("*").alias(salts)).where(F.col(salts) > rows).withColumn(salts, F.ceil(F.col(salts) / rows).cast("int"))
    side = small_side(written(n, "hot"))
    left = a.join(side, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    right = b.join(side, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*b.columns), F.col(salts)).cast("int"), F.lit(0))).drop(salts)
    return left.join(right, [*keys, salt]).drop(salt)
