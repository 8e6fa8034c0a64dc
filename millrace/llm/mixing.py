"""Mixing sources to target weights (problem 7).

Method: hash-threshold histograms.  Every document has a fixed 64-bit hash.  The
tokens are summed by source and hash bucket; running sums over the buckets give,
for every mix, the bucket in which the source's budget ends.  Only documents of
that one bucket are looked at again, with finer buckets, until the budget is
exhausted; the choice itself is a filter on the hash.  Nothing is sorted and no
document list leaves the executors.  As all mixes use the same hash, a smaller
budget's documents are a subset of a larger budget's.

A source that must give more than it holds is repeated: floor(budget / tokens)
whole passes, at most max_repeats in all, and a threshold for the rest.

Nulls: rows without doc_id are left out; null and blank texts count zero tokens and are chosen like others.  A
document without source takes part in the total only.  A target whose source
has no document is reported with zero tokens.  Shares and budgets that are null
count as zero.  Repeated rows of a document count once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Where the tokenizer's ranks lie; a parameter, never a part of this repository.
RANKS = os.environ.get("MILLRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The word pattern of the byte-level BPE vocabulary, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Buckets by level: 2**12, so three levels refine a source to 2**-36 of its hash range.
LEVEL_BITS = 12
LEVELS = 3

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, h, tokens): one row for each document; whole texts are encoded."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t and not t.isspace() else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where("doc_id is not null")
    sized = base.mapInArrow(sizes, "doc_id long, source string, tokens long")
    # h is uniform on 0 .. 2**60 - 1; a later delivery of a document has the same h
    return sized.groupBy("doc_id").agg(F.min_by("source", F.struct("tokens", "source")).alias("source"), F.min("tokens").alias("tokens")).select(
        "doc_id", "source", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(20_240_607)), 4).alias("h"), "tokens"
    )


def _targets(targets: DataFrame) -> DataFrame:
    return targets.select(
        F.col("mix_name").cast("string").alias("mix_name"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats"),
        F.coalesce(F.col("budget_ratio").cast("double"), F.lit(0.0)).alias("budget_ratio"),
    ).dropDuplicates(["mix_name", "source"])


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (mix, source): need, available tokens, whole passes, the rest for the threshold, and reachability."""
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    total = by_source.agg(F.sum("available")).first()[0] or 0  # one number
    t = _targets(targets).join(by_source, "source", "left")
    need = F.col("target_share") * F.col("budget_ratio") * F.lit(total)
    t = t.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("need", need)
    passes = F.when(F.col("available") > 0, F.least(F.floor(F.col("need") / F.col("available")), F.col("max_repeats").cast("long"))).otherwise(0)
    t = t.withColumn("passes", passes.cast("int"))
    rest = F.when(F.col("passes") < F.col("max_repeats"), F.col("need") - F.col("passes") * F.col("available")).otherwise(0.0)
    return t.withColumn("rest", F.greatest(rest, F.lit(0.0))).withColumn("reachable", F.col("need") <= F.col("max_repeats") * F.col("available"))


def thresholds(sizes: DataFrame, planned: DataFrame, bits: int = LEVEL_BITS, levels: int = LEVELS) -> DataFrame:
    """(mix_name, source, passes, cut): documents with h < cut are used once more than `passes`.

    Level by level the histogram of one bucket of the level before: the first
    level sums every document once by (source, bucket), the others only the
    documents of boundary buckets.
    """
    state = planned.select("mix_name", "source", "passes", "rest", F.lit(0).cast("long").alias("lo"), F.col("rest").alias("left")).where("rest > 0")
    for level in range(levels):
        width = 1 << (60 - bits * (level + 1))
        span = width << bits
        if level == 0:
            hist = sizes.where("source is not null").groupBy("source", F.expr(f"h div {width}L").alias("b")).agg(F.sum("tokens").alias("t"))
            hist = F.broadcast(state).join(hist, "source") if state.count() <= 10_000 else state.join(hist, "source")
        else:
            edges = written(state.select("mix_name", "source", "lo", "left", "passes", "rest"), "edges")
            wanted = F.broadcast(edges) if edges.count() <= 10_000 else edges
            inside = sizes.join(wanted, "source").where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + F.lit(span)))
            hist = inside.groupBy("mix_name", "source", "passes", "rest", "lo", "left", F.expr(f"h div {width}L").alias("b")).agg(F.sum("tokens").alias("t"))
        w = Window.partitionBy("mix_name", "source").orderBy("b")
        run = hist.withColumn("upto", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # the bucket in which the running sum passes what is left of the budget
        edge = run.where("upto > left").groupBy("mix_name", "source").agg(
            F.min_by(F.struct("b", "upto", "t"), "b").alias("e")
        )
        keep = state.select("mix_name", "source", "passes", "rest", "left", F.col("lo").alias("lo0"))
        joined = keep.join(edge, ["mix_name", "source"], "left")
        state = written(
            joined.select(
                "mix_name", "source", "passes", "rest",
                # the last level's bucket is taken whole if that comes nearer to the budget
                F.coalesce(F.expr(f"(e.b + IF({str(level == levels - 1).lower()} AND 2 * (left - (e.upto - e.t)) > e.t, 1, 0)) * {width}L"), F.col("lo0") + F.lit(span)).alias("lo"),
                F.coalesce(F.expr("left - (e.upto - e.t)"), F.lit(0.0)).alias("left"),
            ),
            f"cut{level}",
        )
    cuts = state.select("mix_name", "source", F.col("lo").alias("cut"))
    return planned.select("mix_name", "source", "passes").join(cuts, ["mix_name", "source"], "left").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long")))


def chosen(sizes: DataFrame, cuts: DataFrame) -> DataFrame:
    """(mix_name, doc_id, source, tokens, repeats) of the chosen documents: one filter on the hash."""
    cuts = F.broadcast(cuts) if cuts.count() <= 10_000 else cuts
    return (
        sizes.join(cuts, "source")
        .withColumn("repeats", F.col("passes") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0))
        .where("repeats > 0")
        .select("mix_name", "doc_id", "source", "tokens", "repeats")
    )


def mix(docs: DataFrame, targets: DataFrame, ranks: str = RANKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, plan, chosen documents) for every mix of the targets."""
    sizes = written(token_sizes(docs, ranks=ranks), "sizes")
    planned = written(plan(sizes, targets), "plan")
    return sizes, planned, chosen(sizes, written(thresholds(sizes, planned), "cuts"))


def shares(planned: DataFrame, picked: DataFrame) -> DataFrame:
    """The report: actual tokens and share of each source in each mix beside its target."""
    got = picked.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_repeats"), F.count("*").alias("documents")
    )
    t = planned.join(got, ["mix_name", "source"], "left").fillna(0, ["used", "most_repeats", "documents"])
    total = F.sum("used").over(Window.partitionBy("mix_name"))
    return t.select(
        "mix_name", "source", "target_share", "reachable", F.col("need").alias("target_tokens"), F.col("used").alias("actual_tokens"),
        F.when(total > 0, F.col("used") / total).otherwise(0.0).alias("actual_share"), "most_repeats", "documents",
    )


def unreachable(planned: DataFrame) -> DataFrame:
    """The targets whose source cannot reach its share within its repeats."""
    return planned.where(~F.col("reachable")).select("mix_name", "source")


__all__ = ["chosen", "encoder", "mix", "plan", "shares", "thresholds", "token_sizes", "unreachable"]
