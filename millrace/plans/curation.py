"""Question curation: extract answers, vote, keep the band of fitting difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.answers import is_provable
from millrace.operators.metrics import majority


def curate(answers: DataFrame, question: str = "question", answer: str = "answer", row_id: str = "rid", low: float = 0.3, high: float = 0.7) -> DataFrame:
    """(problem, answer, score, votes, n): each question's majority answer and its share, band and exclusions applied.

    The share is over extracted answers.  Both bounds are inclusive.  A tie goes
    to the answer seen first.  Questions without an extracted answer drop out.
    """
    got = answers.where(F.col(answer).isNotNull() & (F.col(answer) != "") & F.col(question).isNotNull())
    v = majority(got.withColumn("__one", F.lit(1.0)), [question], answer, "__one", row_id)
    v = v.withColumn("score", F.col("votes") / F.col("n"))
    v = v.where(is_provable(F.col(question), F.col(answer)) & F.col("score").between(low, high))
    return v.select(F.col(question).alias("problem"), F.col(answer).alias("answer"), "score", "votes", "n")


def advantage_step(rollouts: DataFrame, estimator: str = "grpo", group: str = "uid", score: str = "score") -> DataFrame:
    """One update's data work: filter groups without spread, then the advantages of a registered estimator."""
    from millrace.operators.advantage import ESTIMATORS

    keep = rollouts.groupBy(group).agg(F.stddev_pop(score).alias("sd"), F.count("*").alias("c")).where("sd > 0 or c = 1")
    return ESTIMATORS[estimator](rollouts.join(keep.select(group), group, "left_semi"), group, score)
