"""Comparison of two result sets, whatever the order of their columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _as_text(c: str):
    """Values of different types that read alike are equal: 1 and 1.0 are, as in result sets of untyped engines."""
    x = F.col(c)
    number = x.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), (number + 0.0).cast("string")), x.cast("string"))


def _fingerprints(df: DataFrame) -> tuple[int, list[tuple]]:
    """(rows, for each column a sum over the hashes of its values): equal columns have equal sums."""
    cols = df.columns
    aggs = [F.sum(F.xxhash64(F.coalesce(_as_text(c), F.lit("\0null"))).cast("decimal(38,0)")).alias(c) for c in cols]
    row = df.agg(F.count("*").alias("__n"), *aggs).first()
    return row["__n"], [row[c] for c in cols]


def _pairings(left: list, right: list) -> Iterator[list[int]]:
    """Ways to give every left column a right column of the same fingerprint."""

    def extend(done: list[int]) -> Iterator[list[int]]:
        if len(done) == len(left):
            yield done
            return
        for j, f in enumerate(right):
            if f == left[len(done)] and j not in done:
                yield from extend([*done, j])

    yield from extend([])


def results_equal(a: DataFrame, b: DataFrame, ordered: str | None = None) -> bool:
    """Whether two results hold the same rows equally often under some order of the columns.

    ordered: a column of both that numbers their rows; then a row must also stand in the same place.
    Column fingerprints leave few column orders to try; each costs one comparison of row counts.
    """
    if ordered is not None:
        a, b = (df.select(F.col(ordered), *[c for c in df.columns if c != ordered]) for df in (a, b))
    if len(a.columns) != len(b.columns):
        return False
    a, b = _named(a), _named(b)
    (n, left), (m, right) = _fingerprints(a), _fingerprints(b)
    if n != m or sorted(map(str, left)) != sorted(map(str, right)):
        return False
    x = a.select(*[_as_text(c).alias(c) for c in a.columns])
    y = b.select(*[_as_text(c).alias(c) for c in b.columns])
    for order in _pairings(left, right):
        if ordered is not None and order[0] != 0:
            continue
        z = y.select(*[F.col(f"c{j}").alias(f"c{i}") for i, j in enumerate(order)])
        counts = x.withColumn("__s", F.lit(1)).unionByName(z.withColumn("__s", F.lit(-1))).groupBy(*x.columns).agg(F.sum("__s").alias("d"))
        if counts.where("d <> 0").isEmpty():
            return True
    return not a.columns

