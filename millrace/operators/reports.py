"""Run reports: timing and throughput, token statistics of a batch, balance of parts, rates of repairs and completions.

All are single map-side combined aggregates; a report has a fixed small number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import mask_count, masked_sum

#: Stages whose time is divided by all tokens (fixed values); `gen` counts response tokens only.
TOKEN_STAGES = ("ref", "values", "adv", "update_critic", "update_actor")


def timing(stages: DataFrame, response_tokens: Column | int, all_tokens: Column | int, response_stages: tuple[str, ...] = ("gen",), token_stages: tuple[str, ...] = TOKEN_STAGES) -> DataFrame:
    """(stage, seconds, ms_per_token) from (stage, seconds): milliseconds a token for the stages that have a token count, else null."""
    tokens = F.when(F.col("stage").isin(*response_stages), response_tokens).when(F.col("stage").isin(*token_stages), all_tokens)
    return stages.groupBy("stage").agg(F.sum("seconds").alias("seconds")).withColumn("ms_per_token", F.col("seconds") * 1000 / tokens)


def throughput(df: DataFrame, tokens: Column, seconds: float, workers: int) -> DataFrame:
    """One row: total tokens, seconds, tokens per second and worker."""
    total = F.coalesce(F.sum(tokens), F.lit(0))
    return df.agg(total.alias("tokens"), F.lit(float(seconds)).alias("seconds"), (total / (seconds * workers)).alias("per_second_worker"))


def batch_statistics(df: DataFrame, arrays: list[str], mask: str, sequence_sums: list[str] = ()) -> DataFrame:
    """(name, mean, most, least): masked token columns over all tokens, and the sums of a row's tokens over all rows; the mask's length is `length`.

    A column that df does not have is left out.
    """
    m = F.col(mask)
    have = [a for a in arrays if a in df.columns]
    sums = [a for a in sequence_sums if a in df.columns]
    kept = lambda a: F.filter(F.zip_with(F.col(a), m, lambda v, k: F.when(k == 1, v.cast("double"))), lambda v: v.isNotNull())
    agg = [F.avg(mask_count(m)).alias("length|mean"), F.max(mask_count(m)).cast("double").alias("length|most"), F.min(mask_count(m)).cast("double").alias("length|least")]
    for a in have:
        agg += [(F.sum(masked_sum(F.col(a), m)) / F.sum(mask_count(m))).alias(f"{a}|mean"), F.max(F.array_max(kept(a))).alias(f"{a}|most"), F.min(F.array_min(kept(a))).alias(f"{a}|least")]
    for a in sums:
        s = F.aggregate(F.col(a), F.lit(0.0), lambda x, y: x + y)
        agg += [F.avg(s).alias(f"{a}_sum|mean"), F.max(s).alias(f"{a}_sum|most"), F.min(s).alias(f"{a}_sum|least")]
    one = df.agg(*agg)
    names = ["length", *have, *[f"{a}_sum" for a in sums]]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), *[F.col(f"`{n}|{k}`").alias(k) for k in ("mean", "most", "least")]) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def part_balance(df: DataFrame, part: str, length: str, by: list[str] = ()) -> DataFrame:
    """least, most, gap and mean of the parts' totals."""
    totals = df.groupBy(*by, part).agg(F.sum(length).alias("__t"))
    agg = [F.min("__t").alias("least"), F.max("__t").alias("most"), (F.max("__t") - F.min("__t")).alias("gap"), F.avg("__t").alias("mean")]
    return totals.groupBy(*by).agg(*agg) if by else totals.agg(*agg)


def ratio_of_sums(df: DataFrame, part: Column, whole: Column, by: list[str] = ()) -> DataFrame:
    """rate = sum(part) / sum(whole), 0 where there is nothing to divide by: repairs per step, calls per turn."""
    p, w = F.coalesce(F.sum(part), F.lit(0)), F.coalesce(F.sum(whole), F.lit(0))
    agg = F.when(w != 0, p / w).otherwise(0.0).alias("rate")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def mean_or_zero(df: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """mean, 0 where there is no value: steps a response, share of complete trajectories."""
    agg = F.coalesce(F.avg(value.cast("double")), F.lit(0.0)).alias("mean")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def accumulate(batches: DataFrame, batch: str, kept: str, target: int, most: int | None = None) -> DataFrame:
    """(batch, kept, taken): batches in order until `target` kept rows are together; the last one is cut.  More than `most` batches without reaching it fail.

    batches has one row for each batch, however many rows a batch holds.
    """
    w = Window.orderBy(batch)
    x = batches.select(batch, kept, F.sum(kept).over(w).alias("__c"), F.row_number().over(w).alias("__n"))
    before = F.col("__c") - F.col(kept)
    if most is not None:
        x = x.withColumn("__c", F.when((F.col("__n") > most) & (before < target), F.raise_error(F.lit(f"fewer than {target} kept rows in {most} batches")).cast("bigint")).otherwise(F.col("__c")))
    return x.where(F.col("__c") - F.col(kept) < target).select(batch, kept, F.least(F.col(kept), target - (F.col("__c") - F.col(kept))).alias("taken"))


def covariance_clip(df: DataFrame, row_id: str, log_prob: str, old_log_prob: str, advantage: str, mask: str, clip: float = 0.2, ratio: float = 0.0002, low: float = 1.0, high: float = 5.0, seed: int = 0) -> DataFrame:
    """(row_id, place): the tokens whose loss is set to 0.

    Candidates are masked-in tokens that the ratio clip leaves alone and whose covariance of advantage and log
    probability lies in (low, high).  max(ratio * tokens, 1) of them are taken in a seeded order: the order's leading 16
    bits are counted (65,536 rows), whole buckets are taken up to the one that holds the bound, and only that one is
    sorted, so no task sees all candidates.
    """
    m = F.col(mask)
    stats = df.agg((F.sum(masked_sum(F.col(advantage), m)) / F.sum(mask_count(m))).alias("__a"), (F.sum(masked_sum(F.col(log_prob), m)) / F.sum(mask_count(m))).alias("__l"), F.sum(mask_count(m)).alias("__n"))  # one row
    z = F.arrays_zip(F.col(log_prob).alias("l"), F.col(old_log_prob).alias("o"), F.col(advantage).alias("a"), m.alias("m"))
    t = df.select(F.col(row_id), F.posexplode(z).alias("place", "z")).where("z.m = 1").join(F.broadcast(stats), how="cross")
    q = F.exp(F.col("z.l") - F.col("z.o"))
    plain, clipped = -F.col("z.a") * q, -F.col("z.a") * F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), q))
    cov = (F.col("z.a") - F.col("__a")) * (F.col("z.l") - F.col("__l"))
    c = t.where((clipped <= plain) & (cov > low) & (cov < high)).select(row_id, "place", "__n", F.xxhash64(row_id, "place", F.lit(seed)).alias("__h")).withColumn("__b", F.shiftrightunsigned("__h", 48))
    n = c.groupBy("__b").agg(F.count("*").alias("__k"), F.max("__n").alias("__n"))
    w = n.withColumn("__before", F.coalesce(F.sum("__k").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__most", F.greatest(F.floor(F.col("__n") * ratio), F.lit(1)))
    w = w.where("__before < __most").select("__b", "__before", "__k", "__most")
    x = c.drop("__n").join(F.broadcast(w), "__b")
    whole = x.where("__before + __k <= __most").select(row_id, "place")
    edge = x.where("__before + __k > __most").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", row_id, "place"))).where("__r <= __most - __before").select(row_id, "place")
    return whole.unionByName(edge)
