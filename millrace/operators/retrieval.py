"""Top-k search: dense by inner product, lexical by BM25.

Queries are a stated set against all rows.  Queries are sent to the executors in
blocks of a checked size; each block is matched with every batch of the corpus by
one matrix product, a batch keeps its k best for each query, and the final choice
is an aggregate over those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import spread_join
from millrace.session import small_side, written

#: Queries in one block: with 1024 doubles each, 32 MB.
BLOCK = 4_096
#: Queries that are scored against a batch at a time.
TILE = 256
#: Queries one call accepts; more are to be given in several calls, each against all rows.
MOST_QUERIES = 200_000


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", normalise: bool = True) -> DataFrame:
    """(query_id, rank, key, score): the k vectors of greatest inner product (of unit vectors) for each query.

    Ties go to the smaller key.  Null vectors take no part; a zero vector has
    score 0 with everything.  k of 0 or empty tables give an empty result.
    """
    n = queries.count()
    if n > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in one call")
    spark = corpus.sparkSession
    parts: list[DataFrame] = []
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    for block in range(max(1, -(-n // BLOCK))):
        blocks = max(1, -(-n // BLOCK))
        got = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow()
        if not got.num_rows:
            continue
        q = spark.sparkContext.broadcast((got.column(0).to_numpy(), _matrix(got.column(1).to_pylist(), normalise)))
        parts.append(_block(corpus, q, k, key, vector, normalise))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, key long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def _matrix(rows: list[list[float]], normalise: bool) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    if normalise:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(size == 0, 1.0, size)
    return m


def _block(corpus: DataFrame, q, k: int, key: str, vector: str, normalise: bool) -> DataFrame:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = q.value
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            if not len(keys) or k < 1:
                continue
            c = _matrix(b.column(1).to_pylist(), normalise).T
            for at in range(0, len(ids), TILE):
                s = m[at : at + TILE] @ c
                # all that reach the k-th best score, then the k first of them by score and key
                least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                rows, cols = np.nonzero(s >= least[:, None])
                order = np.lexsort((keys[cols], -s[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                first = np.searchsorted(rows, np.arange(len(s)))
                best = np.arange(len(rows)) - first[rows] < k
                rows, cols = rows[best], cols[best]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + rows]), pa.array(keys[cols]), pa.array(s[rows, cols])], names=["query_id", "key", "score"])

    base = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return base.mapInArrow(match, "query_id long, key long, score double")


K1, B = 0.9, 0.4


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query: str, doc_id: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, doc_id, score) by BM25 over all documents.

    Only terms of queries are kept from the documents before anything is
    shuffled; document counts and the mean length are aggregates over all of them.
    A common term's documents are spread over tasks.
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).  Ties go to the smaller document.
    """
    q = queries.where(F.col(query).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    total = d.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"))  # one row
    wanted = small_side(written(q.select("term").distinct(), "terms"))
    tf = d.select("doc_id", "len", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    w = tf.join(df, "term").join(F.broadcast(total), how="cross").select("term", "doc_id", weight.alias("w"))
    s = spread_join(q, written(w, "weights"), ["term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 9).alias("score"))
    win = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
