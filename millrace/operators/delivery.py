"""Repeated deliveries: keep one row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import one_name, small_side, written


def latest_delivery(df: DataFrame, key: list[str] | str, order: list[str] | str) -> DataFrame:
    """One row for each key: the one with the greatest `order` values.

    Only keys that occur more than once need comparing, and they are few: a
    narrow aggregate (key, greatest order, count) finds them, all other rows pass
    a filter without being shuffled.  The table of repeated keys is broadcast if
    its written size is within the bounds of session.small_side; otherwise Spark
    joins by shuffle.

    Ties are broken by a hash of the whole row, exact copies by any of them (they
    are equal).  Rows with a null in the key stay as they are: they name no key.
    Nulls in `order` rank lowest.  An empty table gives an empty table.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    h, n, top, rn = (one_name(df, s) for s in ("hash", "n", "top", "rn"))
    kinds = dict(df.dtypes)
    hashable = [F.col(f"`{c}`") if not kinds[c].startswith("map") else F.to_json(F.col(f"`{c}`")) for c in df.columns]
    rank = F.struct(*[F.col(f"`{c}`") for c in order], F.col(h))
    marked = df.withColumn(h, F.xxhash64(*hashable))
    known = F.lit(True)
    for c in key:
        known = known & F.col(f"`{c}`").isNotNull()
    repeated = written(
        marked.where(known).groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.max(rank).alias(top), F.count("*").alias(n)).where(F.col(n) > 1).drop(n),
        "repeated",
    )
    joined = marked.join(small_side(repeated), key, "left").where(F.col(top).isNull() | (F.col(top) == rank))
    single = joined.where(F.col(top).isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in key]).orderBy(F.lit(1))
    again = joined.where(F.col(top).isNotNull()).withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1)
    return single.unionAll(again.select(*[F.col(f"`{c}`") for c in df.columns]))
