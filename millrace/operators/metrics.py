"""Metrics over responses, steps and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import let


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))


def mean_of_means(df: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """Per source the mean over rows of each row's mean score (not weighted by the number of scores)."""
    return df.groupBy(source, row).agg(F.avg(score).alias("m")).groupBy(source).agg(F.avg("m").alias("mean_score"))


# ---- votes --------------------------------------------------------------------------------------------------------


def votes(df: DataFrame, key: list[str], vote: str, value: str, pos: str) -> DataFrame:
    """Per key and vote: count, first place, value at the first place."""
    v = F.col(value)
    return df.groupBy(*key, vote).agg(F.count("*").alias("votes"), F.min(pos).alias("first_pos"), F.min_by(v, pos).alias("first_value"), F.sum(v).alias("value_sum"))


def majority(df: DataFrame, key: list[str], vote: str, value: str, pos: str) -> DataFrame:
    """The first value of the winning vote; a tie goes to the vote seen first.

    Two map-side combined aggregates: a hot key needs no window.
    """
    v = votes(df, key, vote, value, pos)
    best = F.max_by(F.struct(vote, "votes", "first_value"), F.struct("votes", -F.col("first_pos")))
    return v.groupBy(*key).agg(best.alias("b"), F.sum("votes").alias("n")).select(*key, "b.*", "n", (F.col("b.votes") / F.col("n")).alias("share"))


def weighted_majority(df: DataFrame, key: list[str], vote: str, value: str, weight: Column, pos: str) -> DataFrame:
    """Signed weighted vote: the greatest sum of weights wins, ties by first place; gives its first value."""
    v = df.withColumn("__w", weight).groupBy(*key, vote).agg(F.sum("__w").alias("w"), F.min(pos).alias("p"), F.min_by(value, pos).alias("first_value"))
    best = F.max_by(F.struct(vote, "w", "first_value"), F.struct("w", -F.col("p")))
    return v.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def judged_mean(df: DataFrame, key: list[str], value: str, verdict: str) -> DataFrame:
    """Mean value of the rows judged `correct`, 0 if there is none."""
    return df.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col(verdict) == "correct", F.col(value))), F.lit(0.0)).alias("value"))


def judged_best(df: DataFrame, key: list[str], value: str, verdict: str, prob: str, pos: str) -> DataFrame:
    """Value at the greatest probability among `correct`, else at the least among `wrong`, else the mean; first wins ties."""
    p, v = F.col(prob), F.col(value)
    right, wrong = F.col(verdict) == "correct", F.col(verdict) == "wrong"
    top = F.max_by(F.when(right & p.isNotNull(), v), F.when(right & p.isNotNull(), F.struct(p, -F.col(pos))))
    low = F.min_by(F.when(wrong & p.isNotNull(), v), F.when(wrong & p.isNotNull(), F.struct(p, F.col(pos))))
    return df.groupBy(*key).agg(F.coalesce(top, low, F.avg(v)).alias("value"))


def best_of(values: Column, n: Column, best: bool = True) -> Column:
    """Exact expectation of the max (min) of n draws with replacement from an array: the closed form of the bootstrap."""
    ordered = F.array_sort(values)
    size = F.size(values)
    k = lambda i: F.pow((i + 1) / size, n) - F.pow(i / size, n)
    low = lambda i: F.pow((size - i) / size, n) - F.pow((size - i - 1) / size, n)
    parts = F.transform(ordered, lambda x, i: x * (k(i) if best else low(i)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def validation_rollup(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """(source, metric, value): mean@N, std@N (population), best@n and worst@n for n = 2, 4, ... < N and N, averaged over prompts."""
    x = df.where(F.col(value).isNotNull()).select(source, prompt, F.col(value).cast("double").alias("__v"))
    group = Window.partitionBy(source, prompt)
    # a value's weight in each expectation follows from its rank: no group is collected, a large one is a sorted partition that may spill
    x = x.withColumn("__i", F.row_number().over(group.orderBy("__v"))).withColumn("__n", F.count("*").over(group))
    i, n, v = F.col("__i"), F.col("__n"), F.col("__v")
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n)).cast("int"), F.lit(1))), lambda p: F.pow(F.lit(2.0), p).cast("long")), lambda k: k < n)
    draws = F.when(n > 1, F.concat(powers, F.array(n))).otherwise(F.array().cast("array<bigint>"))
    part = lambda name, k, w: F.struct(F.concat(F.lit(name), F.lit("@"), k).alias("metric"), (v * w).alias("v"))
    best = F.transform(draws, lambda k: part("best", k, F.pow(i / n, k) - F.pow((i - 1) / n, k)))
    worst = F.transform(draws, lambda k: part("worst", k, F.pow((n - i + 1) / n, k) - F.pow((n - i) / n, k)))
    parts = x.select(source, prompt, F.explode(F.concat(F.array(part("mean", n, 1 / n)), best, worst)).alias("m")).select(source, prompt, "m.*")
    sums = parts.groupBy(source, prompt, "metric").agg(F.sum("v").alias("v"))
    spreads = x.groupBy(source, prompt).agg(F.count("*").alias("n"), F.stddev_pop("__v").alias("v")).where("n > 1").select(source, prompt, F.concat(F.lit("std@"), "n").alias("metric"), "v")
    return sums.unionByName(spreads).groupBy(source, "metric").agg(F.avg("v").alias("value"))


# ---- accuracy -----------------------------------------------------------------------------------------------------


def accuracy(df: DataFrame, match: Column, by: list[str] | None = None) -> DataFrame:
    """accuracy, correct, total; zeros where there are no rows."""
    agg = (F.count_if(match).alias("correct"), F.count("*").alias("total"))
    g = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    return g.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def verification_f1(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 with 0 on empty denominators."""
    agg = (F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    g = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))


def rollup_sets(df: DataFrame, source: str, aggs: dict[str, Column], unknown: str = "unknown") -> DataFrame:
    """Overall and per-source values in one pass; the overall row has a null source, a missing source is `unknown`."""
    x = df.withColumn(source, F.coalesce(source, F.lit(unknown)))
    return x.rollup(source).agg(*[v.alias(k) for k, v in aggs.items()])


# ---- token statistics ---------------------------------------------------------------------------------------------


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum where the mask is 1; what stands outside the mask, NaN too, is ignored."""
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m == 1, v).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def mask_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m)


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (mask_count(mask) + 1e-8)


def masked_var(values: Column, mask: Column) -> Column:
    """Masked variance with Bessel's correction; null for fewer than two values."""
    n = mask_count(mask)
    sq = let(masked_mean(values, mask), lambda mean: masked_mean(F.transform(values, lambda v: (v - mean) * (v - mean)), mask))
    return F.when(n > 1, sq * n / (n - 1))


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def agg_loss(df: DataFrame, loss: str, mask: str, mode: str = "token-mean") -> DataFrame:
    """One number over a batch of token losses (arrays)."""
    s, n = masked_sum(F.col(loss), F.col(mask)), mask_count(F.col(mask))
    if mode == "token-mean":
        return df.agg((F.sum(s) / (F.sum(n) + 1e-8)).alias("loss"))
    if mode == "seq-mean-token-sum":
        return df.agg(F.avg(s).alias("loss"))
    if mode == "seq-mean-token-mean":
        return df.agg(F.avg(s / n).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return df.agg((F.sum(s) / F.max(F.size(loss))).alias("loss"))
    raise ValueError(f"unknown mode {mode}")


def spread(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, total, mean, min, max, population std and median of a column."""
    v = F.col(value)
    agg = [F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("std"), F.median(v).alias("median")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def explained_variance(df: DataFrame, values: str, returns: str) -> DataFrame:
    """1 - var(returns - values) / (var(returns) + 1e-5), sample variances."""
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


# ---- rewards ------------------------------------------------------------------------------------------------------


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """min(-(length - (most - buffer)) / buffer * factor, 0)."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def curiosity(used_tool: Column, rate: Column, goal: float = 0.3, weight: float = 0.5) -> Column:
    return weight * used_tool.cast("double") * F.greatest(F.lit(0.0), goal - rate)


def redundancy(calls: Column, weight: float = 0.05) -> Column:
    return weight * F.least(1 - calls, F.lit(0)).cast("double")


def at_last_token(score: Column, mask: Column) -> Column:
    """Array of the mask's length with the score at the last masked-in token."""
    return let(mask_count(mask), lambda n: F.transform(mask, lambda m, i: F.when(i + 1 == n, score).otherwise(0.0)))


def curriculum_score(share: Column, penalty: Column, tool: Column, parsed: Column) -> Column:
    """min(s, 1 - s) (or -1 if nothing was parsed) less the cluster share plus the tool reward."""
    return F.when(parsed, F.least(share, 1 - share)).otherwise(F.lit(-1.0)) - penalty + tool


# ---- turns --------------------------------------------------------------------------------------------------------


def turn_changes(df: DataFrame, key: str, turn: str, correct: str) -> DataFrame:
    """Per turn: accuracy, mean change to the turn before, correct->incorrect and incorrect->correct rates."""
    before = F.lag(correct).over(Window.partitionBy(key).orderBy(turn))
    x = df.withColumn("__b", before)
    return x.groupBy(turn).agg(
        F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg((F.col(correct) - F.col("__b")).cast("double")).alias("change"),
        F.avg(F.when(F.col("__b").isNotNull(), ((F.col("__b") == 1) & (F.col(correct) == 0)).cast("double"))).alias("lost"),
        F.avg(F.when(F.col("__b").isNotNull(), ((F.col("__b") == 0) & (F.col(correct) == 1)).cast("double"))).alias("won"),
    )


def pair_agreement(df: DataFrame, block: str, row_id: str, score: str, label: str) -> DataFrame:
    """Share of pairs i < j of a block whose scores are ordered like their labels, weighted by the label difference; 0.5 for equal labels; mean over blocks.

    Blocks have a fixed small number of rows; a block's pairs are its rows' products.
    """
    a = df.select(block, F.col(row_id).alias("i"), F.col(score).alias("si"), F.col(label).alias("li"))
    b = df.select(block, F.col(row_id).alias("j"), F.col(score).alias("sj"), F.col(label).alias("lj"))
    p = a.join(b, block).where("i < j")
    w = F.abs(F.col("li") - F.col("lj"))
    agree = (F.signum(F.col("si") - F.col("sj")) * F.signum(F.col("li") - F.col("lj")) > 0).cast("double")
    per = p.groupBy(block).agg(F.when(F.sum(w) > 0, F.sum(w * agree) / F.sum(w)).otherwise(0.5).alias("acc"))
    return per.agg(F.avg("acc").alias("accuracy"))
