"""Readers: files to frames with a declared schema."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RL_RECORD = (
    "uid string, data_source string, prompt array<struct<role:string,content:string>>, ability string, "
    "reward_model struct<style:string,ground_truth:string>, extra_info struct<split:string,index:bigint,answer:string,question:string>"
)


def parquet_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """UNION ALL of files in argument order; file_idx and row_idx keep the order."""
    parts = [spark.read.parquet(f).withColumn("row_idx", F.col("_metadata.row_index")).withColumn("file_idx", F.lit(i)) for i, f in enumerate(files)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of Parquet, JSON lines, or a JSON document (a list or {"data": [...]})."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        df = spark.read.option("multiLine", True).json(path)
        return df.select(F.explode("data").alias("d")).select("d.*") if df.columns == ["data"] else df
    return spark.read.parquet(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the candidate paths that exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def normalised_samples(df: DataFrame, name: str, index: str, most: int | None = None) -> DataFrame:
    """(id, question, answer): alternative names coalesced, array answers' first element, empty questions dropped.

    The limit counts raw rows in index order, before the drop.
    """
    have = set(df.columns)

    def any_of(*names: str) -> Column:
        found = [F.element_at(F.col(n), 1) if dict(df.dtypes)[n].startswith("array") else F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    x = df.orderBy(index).limit(most) if most is not None else df
    i = any_of("id").cast("string")
    return x.select(
        F.coalesce(i, F.concat_ws("_", F.lit(name), F.col(index).cast("string"))).alias("id"), any_of("question", "prompt", "prompts").alias("question"), any_of("answer", "ground_truth").alias("answer")
    ).where("question is not null and question <> ''")


def lifted(df: DataFrame) -> DataFrame:
    """extra_info lifted to columns with defaults: index 0; score 0.6 where there is none."""
    fields = {f.name for f in df.schema["extra_info"].dataType.fields}
    score = F.col("extra_info.score") if "score" in fields else F.lit(None).cast("double")
    return df.withColumn("index", F.coalesce("extra_info.index", F.lit(0))).withColumn("score", F.coalesce(score, F.lit(0.6)))


def short_prompts(df: DataFrame, prompt: str, most: int) -> DataFrame:
    """Rows whose prompt has at most `most` blank-separated words."""
    return df.where(F.size(F.split(F.trim(F.col(prompt)), r"\s+")) <= most)


class _Text(html.parser.HTMLParser):
    SKIP = {"script", "style", "head", "noscript"}

    def __init__(self, links: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.links, self.href = links, [""]

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            if self.links:
                self.out.append("[")
        elif tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag == "a" and len(self.href) > 1:
            h = self.href.pop()
            if self.links:
                self.out.append(f"]({h})")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(page: str, links: bool = False, most: int | None = None) -> str:
    """The visible text; with most, so many characters of it."""
    p = _Text(links)
    p.feed(page)
    return re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", "".join(p.out))).strip()[:most]


def page_texts(df: DataFrame, key: str, page: str, links: bool = False, most: int | None = None) -> DataFrame:
    """(key, text): the visible text of stored pages; null pages give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else html_text(x, links, most) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(page).alias("page")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
