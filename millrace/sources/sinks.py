"""Writers: distributed, partitioned where readers prune by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

SAMPLE_COLUMNS = ["sample_id", "data_source", "question", "ground_truth", "prediction", "confidence", "is_correct", "num_steps", "num_repairs"]


def write_questions(df: DataFrame, path: str) -> None:
    """(problem, answer, score) as Parquet."""
    df.select("problem", "answer", "score").write.mode("overwrite").parquet(path)


def write_generations(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines, one folder for each step; all columns are kept."""
    df.write.mode("overwrite").partitionBy(step).json(path)


def write_samples(df: DataFrame, path: str) -> None:
    """CSV with a fixed set of columns; extra columns are left out, missing ones are null."""
    samples(df).write.mode("overwrite").option("header", True).csv(path)


def samples(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in SAMPLE_COLUMNS])


def four_places(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as text with four decimals."""
    return df.select(*[F.format_string("%.4f", F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns])


def flat_columns(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named a/b/c."""

    def walk(t: StructType, path: str, name: str) -> list[Column]:
        out: list[Column] = []
        for f in t.fields:
            p, n = (f"{path}.`{f.name}`" if path else f"`{f.name}`"), (f"{name}{sep}{f.name}" if name else f.name)
            out += walk(f.dataType, p, n) if isinstance(f.dataType, StructType) else [F.col(p).alias(n)]
        return out

    return df.select(*walk(df.schema, "", ""))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def list_to_map(items: Column) -> Column:
    """A list as a map: list_len and the elements by their place."""
    keys = F.concat(F.array(F.lit("list_len")), F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: i.cast("string")))
    return F.map_from_arrays(F.when(F.size(items) > 0, keys).otherwise(F.array(F.lit("list_len"))), F.concat(F.array(F.size(items).cast("string")), items.cast("array<string>")))


def metric_rows(df: DataFrame, step: str) -> DataFrame:
    """(step, metric, value): wide metric columns in long form."""
    numeric = [f.name for f in df.schema.fields if f.name != step and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.select(step, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(step, numeric, "metric", "value")


def nested_validation(df: DataFrame, source: str, prompt: str, reward: str, pred: str) -> DataFrame:
    """Per source and prompt the samples with score, prediction and is_correct (score >= 0.5)."""
    s = F.struct(F.col(reward).alias("score"), F.col(pred).alias("prediction"), (F.col(reward) >= 0.5).alias("is_correct"))
    return df.groupBy(source, prompt).agg(F.array_sort(F.collect_list(s)).alias("samples"))


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """JSON lines, one folder for each shard."""
    df.write.mode("overwrite").partitionBy(shard).json(path)


def write_results(samples_: DataFrame, metrics: DataFrame, path: str) -> None:
    """One result in three forms: all samples as JSON lines, the fixed sample columns and the metrics as CSV."""
    samples_.write.mode("overwrite").json(f"{path}/results")
    write_samples(samples_, f"{path}/samples")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/metrics")


def track(df: DataFrame, path: str, step: str = "step") -> None:
    """Appends metric rows (step, metric, value) to a log that a reader prunes by step."""
    metric_rows(df, step).write.mode("append").partitionBy(step).parquet(path)


def save_batch(df: DataFrame, path: str) -> None:
    """A batch as Parquet; types and nested columns come back as they were."""
    df.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
