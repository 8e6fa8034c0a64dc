"""Algebra of ordered batches: every frame carries an explicit row id, results are ordered only through it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import one_name, written


def positions(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Numbers the rows 0, 1, ... by a column, without moving them into one task.

    Rows are range-partitioned by the order, counted by partition, and numbered
    inside their partition; the table of counts has one row for each partition.
    Equal order values keep no particular order among themselves.
    """
    part, at, base = one_name(df, "part"), one_name(df, "at"), one_name(df, "base")
    ranged = written(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(part).agg(F.count("*").alias("n"))
    offset = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    w = Window.partitionBy(part).orderBy(order)
    numbered = ranged.withColumn(at, F.row_number().over(w) - 1)
    return numbered.join(F.broadcast(offset), part).withColumn(name, F.col(base) + F.col(at)).drop(part, at, base)


# ---- columns ------------------------------------------------------------------------------------------------------


def pop(df: DataFrame, columns: list[str], row_id: str = "rid") -> tuple[DataFrame, DataFrame]:
    """Splits a frame vertically: (the named columns, the rest), both with the row id."""
    return df.select(row_id, *columns), df.drop(*columns)


def rename(df: DataFrame, old: list[str] | str, new: list[str] | str) -> DataFrame:
    old, new = ([x] if isinstance(x, str) else list(x) for x in (old, new))
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def unfold_chunks(df: DataFrame, n: int, columns: list[str], row_id: str = "rid") -> DataFrame:
    """Each row becomes n rows with the n-th part of the chosen arrays; `chunk` tells which."""
    rest = [c for c in df.columns if c not in columns]
    x = df.select(*rest, *columns, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"))
    size = lambda c: F.floor(F.size(c) / n).cast("int")
    return x.select(*rest, "chunk", *[F.slice(c, F.col("chunk") * size(c) + 1, size(c)).alias(c) for c in columns])


def fold_rows(df: DataFrame, k: int, columns: list[str], pos: str = "pos") -> DataFrame:
    """Contiguous groups of k rows become one row of arrays in row order (exact groups only matter to the caller)."""
    packed = F.array_sort(F.collect_list(F.struct(pos, *columns)))
    g = df.groupBy(F.floor(F.col(pos) / k).alias("fold")).agg(packed.alias("__p"))
    return g.select("fold", *[F.col(f"__p.{c}").alias(c) for c in columns])


def unfold_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Inverse of fold_rows: `fold`, `at` and the columns."""
    z = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return df.select("fold", F.posexplode(z).alias("at", "__z")).select("fold", "at", "__z.*")


def reduce_by_name(metrics: Column, name: Column) -> Column:
    """Max where the name holds `max`, else min where it holds `min`, else the mean; an empty list gives NaN."""
    total = F.aggregate(metrics, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(F.contains(name, F.lit("max")), F.array_max(metrics)).when(F.contains(name, F.lit("min")), F.array_min(metrics))
        .when(F.size(metrics) == 0, F.lit(float("nan"))).otherwise(total / F.size(metrics))
    )


# ---- rows ---------------------------------------------------------------------------------------------------------


def slice_rows(df: DataFrame, start: int | None, stop: int | None, step: int = 1, pos: str = "pos") -> DataFrame:
    """start:stop:step of the rows by position (no negative bounds)."""
    s = start or 0
    keep = (F.col(pos) >= s) & ((F.col(pos) - s) % step == 0)
    return df.where(keep if stop is None else keep & (F.col(pos) < stop))


def gather(df: DataFrame, indices: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows by a table (at, idx) of positions; an index may repeat; `at` orders the result."""
    return indices.join(df, F.col("idx") == F.col(pos)).drop("idx")


def inverse_permutation(df: DataFrame) -> DataFrame:
    """(at, idx) -> (idx as at, at as idx)."""
    return df.select(F.col("idx").alias("at"), F.col("at").alias("idx"))


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), frames)


def repeat(df: DataFrame, n: int, interleave: bool = True, pos: str = "pos", size: int | None = None) -> DataFrame:
    """n copies of each row; `copy` tells which, `at` is the place: a,a,b,b interleaved, a,b,a,b tiled (needs size)."""
    x = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return x.withColumn("at", F.col(pos) * n + F.col("copy") if interleave else F.col("copy") * F.lit(size) + F.col(pos))


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """As many copies of a row as its own column says; none for 0 and null."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))


def suffixed(df: DataFrame, key: str, n: int) -> DataFrame:
    """n copies with the copy's number put behind the key."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(key, F.concat_ws("_", key, "copy"))


def pad_to_divisor(df: DataFrame, k: int, n: int, pos: str = "pos") -> DataFrame:
    """Appends leading rows, again and again if need be, until the number of rows n divides by k."""
    extra = (-n) % k
    if not extra or not n:
        return df
    times = F.floor((F.lit(extra) - 1 - F.col(pos)) / n).cast("int")
    more = df.where(F.col(pos) < extra).withColumn("__i", F.explode(F.sequence(F.lit(0), times))).withColumn(pos, F.lit(n) + F.col(pos) + F.col("__i") * n).drop("__i")
    return df.unionByName(more)


def unpad(df: DataFrame, n: int, pad: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) < n - pad)


def chunk_of(pos: Column, n: Column | int, parts: int) -> Column:
    """Which of `parts` equal contiguous parts a position belongs to."""
    return F.floor(pos * parts / n).cast("int")


def near_equal_part(pos: Column, n: Column, parts: int) -> Column:
    """Contiguous parts whose sizes differ by at most one, the first n % parts one longer."""
    q, r = F.floor(n / parts), n % parts
    return F.when(pos < r * (q + 1), F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")


def batches(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("int")


def hash_order(key: Column, seed: int) -> Column:
    """A seeded random order that is the same on every run and executor."""
    return F.xxhash64(key, F.lit(seed))


# ---- routes -------------------------------------------------------------------------------------------------------


def routed(df: DataFrame, route: str, row_id: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], other: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each route's rows through its own handler, the results together under their row ids.

    A handler takes and returns frames that keep row_id.  Rows of an unknown or null route go to `other`; without it they fail.
    """
    parts = [h(df.where(F.col(route) == name)) for name, h in handlers.items()]
    rest = df.where(F.col(route).isNull() | ~F.col(route).isin(*handlers)) if handlers else df
    if other is not None:
        parts.append(other(rest))
    else:
        refused = F.raise_error(F.concat(F.lit("no handler for "), F.coalesce(route, F.lit("null")))).cast(dict(df.dtypes)[row_id])
        parts.append(rest.select(refused.alias(row_id)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- joins --------------------------------------------------------------------------------------------------------


def side_by_side(a: DataFrame, b: DataFrame, row_id: str = "rid", check: bool = True) -> DataFrame:
    """Joins two frames of the same rows; a shared column must be equal everywhere (null and NaN equal themselves) or the query fails."""
    shared = [c for c in a.columns if c in b.columns and c != row_id]
    r = b.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    x = a.join(r, row_id)
    if check:
        for c in shared:
            ok = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
            x = x.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs between the two sides")).cast(dict(a.dtypes)[c])))
    return x.drop(*[f"__r_{c}" for c in shared])


def merge_maps(a: Column, b: Column) -> Column:
    """Union of two maps; a key with different values fails."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), F.raise_error(F.concat(F.lit("conflict at "), k)).cast("string")).otherwise(F.coalesce(x, y)))
    return both


def bags_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often, whatever their order."""
    return len(a.columns) == len(b.columns) and a.exceptAll(b.toDF(*a.columns)).isEmpty() and b.toDF(*a.columns).exceptAll(a).isEmpty()
