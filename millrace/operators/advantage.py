"""Group-normalised advantages and returns.

Frames have one row for each response; token columns are arrays.  Group
statistics are map-side combined and joined back to the rows, by broadcast while
the table of groups is small.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.session import small_side, written

EPS = 1e-6
WHITEN_EPS = 1e-8

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str):
    """Registers an estimator under a name; the same name for another function is an error."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name} is taken")
        ESTIMATORS[name] = f
        return f

    return put


def group_stats(df: DataFrame, group: str, score: str) -> DataFrame:
    """(group, n, mean, sample std, population std, sum), map-side combined: hot groups do not hurt."""
    s = F.col(score)
    return df.groupBy(group).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.stddev_pop(s).alias("std_pop"), F.sum(s).alias("total")
    )


def with_group(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """The rows with the columns of their group's row; a null group is a group of its own.

    The table of groups is written and sent to the rows while it is small, so a hot group's rows stay where they are.
    """
    g = small_side(written(groups.withColumnRenamed(group, "__g"), "groups"))
    return df.join(g, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def with_stats(df: DataFrame, group: str, score: str) -> DataFrame:
    """The rows with their group's statistics; a null group is a group of its own."""
    return with_group(df, group_stats(df, group, score), group)


@estimator("grpo")
def grpo(df: DataFrame, group: str = "uid", score: str = "score", by_std: bool = True) -> DataFrame:
    """(s - mean) / (sample std + eps); a group of one has mean 0 and std 1."""
    one = F.col("n") == 1
    mean, std = F.when(one, 0.0).otherwise(F.col("mean")), F.when(one, 1.0).otherwise(F.col("std"))
    a = F.col(score) - mean
    return with_stats(df, group, score).withColumn("advantage", a / (std + EPS) if by_std else a)


@estimator("grpo_no_std")
def grpo_no_std(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    return grpo(df, group, score, by_std=False)


@estimator("grpo_groups_only")
def grpo_groups_only(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """The form that refuses groups of one: they come out with a null advantage."""
    return grpo(df, group, score).withColumn("advantage", F.when(F.col("n") > 1, F.col("advantage")))


@estimator("grpo_passk")
def grpo_passk(df: DataFrame, group: str = "uid", score: str = "score", row_id: str = "rid", by_std: bool = True) -> DataFrame:
    """Only a group's best row gets best - second (over std + eps), others 0; ties by row id; a group of one is null."""
    w = Window.partitionBy(group).orderBy(F.desc(score), row_id)
    x = with_stats(df, group, score).withColumn("__r", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w))
    gain = F.col(score) - F.col("__next")
    best = gain / (F.col("std") + EPS) if by_std else gain
    return x.withColumn("advantage", F.when(F.col("n") > 1, F.when(F.col("__r") == 1, best).otherwise(0.0))).drop("__r", "__next")


@estimator("rloo")
def rloo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """Leave one out: s n/(n-1) - mean n/(n-1); a group of one keeps its score."""
    n = F.col("n")
    return with_stats(df, group, score).withColumn("advantage", F.when(n > 1, (F.col(score) - F.col("mean")) * n / (n - 1)).otherwise(F.col(score)))


@estimator("opo")
def opo(df: DataFrame, group: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Baseline: the length-weighted mean of the group, NaN where all lengths are 0; 0 for a group of one."""
    total = F.sum(length)
    base = F.when(total == 0, float("nan")).otherwise(F.sum(F.col(score) * F.col(length)) / total)
    g = df.groupBy(group).agg(F.count(score).alias("n"), base.alias("base"))
    x = with_group(df, g, group)
    return x.withColumn("advantage", F.col(score) - F.when(F.col("n") == 1, 0.0).otherwise(F.col("base")))


@estimator("gpg")
def gpg(df: DataFrame, group: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """rows / (rows with a nonzero score) * (s - mean) / f_norm; the mean of a group of one is 0."""
    total = df.agg((F.count(score) / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("alpha"))  # one row
    x = with_stats(df, group, score).join(F.broadcast(total), how="cross")
    return x.withColumn("advantage", F.col("alpha") * (F.col(score) - F.when(F.col("n") == 1, 0.0).otherwise(F.col("mean"))) / f_norm)


@estimator("reinforce_baseline")
def reinforce_baseline(df: DataFrame, group: str = "uid", score: str = "score", weight: str = "length") -> DataFrame:
    """s - group mean, then whitened over all tokens (each row counts `weight` tokens)."""
    x = with_stats(df, group, score).withColumn("__a", F.col(score) - F.when(F.col("n") == 1, 0.0).otherwise(F.col("mean")))
    return whiten_weighted(x, "__a", weight).withColumnRenamed("whitened", "advantage").drop("__a")


@estimator("gapo")
def gapo(df: DataFrame, group: str = "uid", score: str = "score", actions: str = "n_actions") -> DataFrame:
    """Mean and sample std weighted by the number of actions; rows without actions do not count."""
    w, s = F.col(actions).cast("double"), F.col(score)
    g = df.groupBy(group).agg(F.sum(w).alias("n"), F.sum(w * s).alias("s1"), F.sum(w * s * s).alias("s2"))
    mean = F.col("s1") / F.col("n")
    std = F.sqrt(F.greatest((F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    x = with_group(df, g, group)
    a = F.when(F.col("n") > 1, (s - mean) / (std + EPS)).when(F.col("n") == 1, s / (1.0 + EPS)).otherwise(s)
    return x.withColumn("advantage", a).drop("s1", "s2")


@estimator("adpo")
def adpo(df: DataFrame, group: str = "uid", score: str = "score", difficulty: str = "difficulty", low: float = 0.3, high: float = 0.8, least: float = 0.5) -> DataFrame:
    """grpo scaled by least + clip((d - low) / (high - low), 0, 1) (1 - least)."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(difficulty) - low) / (high - low)))
    return grpo(df, group, score).withColumn("advantage", F.col("advantage") * (least + ratio * (1 - least)))


@estimator("process_grpo")
def process_grpo(df: DataFrame, group: str = "uid", total: str = "total_return", eps: float = EPS) -> DataFrame:
    """Population std; below eps it counts as 1; a group of one has mean 0 and std 1."""
    one = F.col("n") == 1
    std = F.when(one | (F.col("std_pop") < eps), 1.0).otherwise(F.col("std_pop"))
    return with_stats(df, group, total).withColumn("advantage", (F.col(total) - F.when(one, 0.0).otherwise(F.col("mean"))) / std)


def whiten_weighted(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(x - mean) * rsqrt(var + 1e-8) over tokens, each row standing for `weight` equal tokens (sample variance)."""
    x, w = F.col(value), F.col(weight).cast("double")
    stats = df.agg(F.sum(w).alias("__n"), F.sum(w * x).alias("__s1"), F.sum(w * x * x).alias("__s2"))  # one row
    mean = F.col("__s1") / F.col("__n")
    var = (F.col("__s2") - F.col("__n") * mean * mean) / (F.col("__n") - 1)
    return df.join(F.broadcast(stats), how="cross").withColumn("whitened", (x - mean) / F.sqrt(var + WHITEN_EPS)).drop("__n", "__s1", "__s2")


def whiten(df: DataFrame, value: str, mask: str | None = None, shift_mean: bool = True) -> DataFrame:
    """Whitens a column over the rows where mask is 1 (all rows without a mask); the mean may be added back."""
    x = F.col(value) if mask is None else F.when(F.col(mask) == 1, F.col(value))
    stats = df.agg(F.avg(x).alias("__m"), F.var_samp(x).alias("__v"))  # one row
    y = (F.col(value) - F.col("__m")) / F.sqrt(F.col("__v") + WHITEN_EPS)
    return df.join(F.broadcast(stats), how="cross").withColumn("whitened", y if shift_mean else y + F.col("__m")).drop("__m", "__v")


# ---- token recursions: vectorised over the rows of an Arrow batch, linear in a row's length, no shuffle -------------


def _lists(arrays: tuple[pa.Array, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(start and length of every row's list, flat values of each column, rows that hold a list in every column)."""
    have = np.ones(len(arrays[0]), bool)
    for x in arrays:
        have &= x.is_valid().to_numpy(zero_copy_only=False)
    rows = pa.array(np.flatnonzero(have))
    taken = [x.take(rows) for x in arrays]
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in taken]
    n = np.max(sizes, axis=0) if len(rows) else np.zeros(0, np.int64)
    start = np.concatenate(([0], np.cumsum(n)))[:-1].astype(np.int64)
    flat = []
    for x, size in zip(taken, sizes):
        values = x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        if (size == n).all():
            flat.append(values)
        else:  # a shorter list counts as filled up with nulls
            out = np.full(int(n.sum()), np.nan)
            out[np.repeat(start, size) + np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
            flat.append(out)
    return start, n, flat, have


def _as_lists(values: np.ndarray, n: np.ndarray, have: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a flat result; rows without a list are null, NaN is null."""
    sizes = np.zeros(len(have), np.int64)
    sizes[have] = n
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, mask=np.isnan(values)).cast(kind), mask=pa.array(~have))


def _backward(arrays: list[Column], start: tuple[float, ...], step: Callable[..., tuple[tuple[np.ndarray, ...], np.ndarray]]) -> Column:
    """Runs step(state, tokens) -> (state, out) from the last token of every row to the first; all rows of a batch take each step together."""

    def run(*columns: pa.Array) -> pa.Array:
        first, n, flat, have = _lists(columns)
        order = np.argsort(-n, kind="stable")
        longest = n[order]
        out = np.zeros(int(n.sum()))
        state = tuple(np.full(len(n), x) for x in start)
        for t in range(int(longest[0]) if len(longest) else 0):
            k = int(np.searchsorted(-longest, -t, "left"))  # rows longer than t
            state = tuple(x[:k] for x in state)
            at = (first + n - 1)[order[:k]] - t
            state, out[at] = step(state, tuple(x[at] for x in flat))
        return _as_lists(out, n, have, pa.float64())

    return _arrow(run, len(arrays), "array<double>")(*[a.cast("array<double>") for a in arrays])


def _arrow(f: Callable[..., pa.Array], n: int, kind: str):
    """f as an Arrow UDF of n columns."""

    def one(a: pa.Array) -> pa.Array:
        return f(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return f(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return f(a, b, c)

    return F.arrow_udf((one, two, three)[n - 1], kind)


def gae_carry(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Advantages, masked tokens carry the next value and the next advantage through."""

    def step(s, x):
        (a0, v0), (r, v, m) = s, x
        a = m * (r + gamma * v0 - v + gamma * lam * a0) + (1 - m) * a0
        return (a, m * v + (1 - m) * v0), a

    return _backward([rewards, values, mask], (0.0, 0.0), step)


def gae_plain(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Advantages, the next value is the next token's whatever the mask."""

    def step(s, x):
        a = x[0] + gamma * s[1] - x[1] + gamma * lam * s[0]
        return (a, x[1]), a

    return _backward([rewards, values], (0.0, 0.0), step)


def gae_turns(rewards: Column, values: Column, turn_mask: Column, gamma: float, lam: float) -> Column:
    """Advantages, next value and next advantage count only if the next token's turn mask is set."""

    def step(s, x):
        a = x[0] + gamma * s[1] * s[2] - x[1] + gamma * lam * s[0] * s[2]
        return (a, x[1], x[2]), a

    return _backward([rewards, values, turn_mask], (0.0, 0.0, 1.0), step)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sum; after a masked token it starts anew."""

    def step(s, x):
        r = x[0] + gamma * s[0]
        return (r * x[1],), r

    return _backward([rewards, mask], (0.0,), step)


def masked_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sum where the mask applies before the return is stored: masked tokens hold 0."""

    def step(s, x):
        r = (x[0] + gamma * s[0]) * x[1]
        return (r,), r

    return _backward([rewards, mask], (0.0,), step)


def reverse_cumsum(values: Column) -> Column:
    return _backward([values], (0.0,), lambda s, x: ((s[0] + x[0],), s[0] + x[0]))


def remax(rewards: Column, baseline: Column, mask: Column) -> Column:
    """Reverse cumulative sum of masked rewards less the greedy baseline, masked."""
    m = mask.cast("array<double>")
    r = reverse_cumsum(F.zip_with(rewards, m, lambda a, b: a * b))
    return F.zip_with(r, m, lambda a, b: (a - baseline) * b)


def remax_scalar(rewards: Column, baseline: Column, mask: Column) -> Column:
    """(sum of rewards - baseline) at every masked-in token."""
    total = F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x) - baseline
    return let(total, lambda t: F.transform(mask.cast("array<double>"), lambda m: t * m))


# ---- masks --------------------------------------------------------------------------------------------------------


def running_sum(values: Column) -> Column:
    """Sums of the elements up to each one; from a null on the sums are null."""

    def run(column: pa.Array) -> pa.Array:
        start, n, (x,), have = _lists((column,))
        total = np.cumsum(np.nan_to_num(x))
        base = np.concatenate(([0.0], total))[start] if len(start) else np.zeros(0)
        out = total - np.repeat(base, n)
        gone = np.cumsum(np.isnan(x))
        out[gone > np.repeat(np.concatenate(([0], gone))[start], n)] = np.nan
        return _as_lists(out, n, have, pa.int64())

    return _arrow(run, 1, "array<bigint>")(values.cast("array<double>"))


def response_mask(ids: Column, eos: int) -> Column:
    """1 up to and with the first end token."""
    return let(F.array_position(ids, F.lit(eos)), lambda p: F.transform(ids, lambda x, i: ((p == 0) | (i < p)).cast("long")))


def response_mask_before(ids: Column, eos: int) -> Column:
    """1 before the first end token, which itself is out."""
    return let(F.array_position(ids, F.lit(eos)), lambda p: F.transform(ids, lambda x, i: ((p == 0) | (i < p - 1)).cast("long")))


def position_ids(mask: Column) -> Column:
    """Running sum of the mask less 1, at least 0."""
    return F.transform(running_sum(mask), lambda c: F.greatest(c - 1, F.lit(0).cast("long")))


def position_ids_masked(mask: Column) -> Column:
    """(Running sum - 1) * mask: 0 at padding on either side."""
    return F.zip_with(running_sum(mask), mask.cast("array<long>"), lambda c, m: (c - 1) * m)


def n_actions(mask: Column) -> Column:
    """Number of runs of ones."""
    prev = F.concat(F.array(F.lit(0)), F.slice(mask, 1, F.greatest(F.size(mask) - 1, F.lit(0))))
    starts = F.zip_with(mask, prev, lambda m, p: ((m == 1) & (p == 0)).cast("long"))
    return F.aggregate(starts, F.lit(0).cast("long"), lambda a, x: a + x)


def run_discount(mask: Column, reward: Column, factor: float) -> Column:
    """reward * factor ** (runs of ones that follow) at the ones, 0 elsewhere."""
    prev = F.concat(F.array(F.lit(0)), F.slice(mask, 1, F.greatest(F.size(mask) - 1, F.lit(0))))
    run = running_sum(F.zip_with(mask, prev, lambda m, p: ((m == 1) & (p == 0)).cast("long")))
    follow = F.zip_with(F.array_repeat(n_actions(mask), F.size(mask)), run, lambda n, r: n - r)
    return F.zip_with(mask, follow, lambda m, k: F.when(m == 1, reward * F.pow(F.lit(factor), k.cast("double"))).otherwise(0.0))


def run_ends(mask: Column) -> Column:
    """Positions (from 0) of the last one of each run of ones."""
    nxt = F.concat(F.slice(mask, 2, F.size(mask)), F.array(F.lit(0)))
    pos = F.zip_with(F.zip_with(mask, nxt, lambda m, n: ((m == 1) & (n == 0)).cast("int")), F.sequence(F.lit(0), F.size(mask) - 1), lambda e, i: F.when(e == 1, i))
    return F.filter(pos, lambda x: x.isNotNull())
