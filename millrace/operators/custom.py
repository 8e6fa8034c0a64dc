"""Operators that are sequential by nature, run inside bounded groups."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import small_side, written

#: Largest group that the sequential operators accept: one training batch.
MOST_IN_GROUP = 20_000


def karmarkar_karp(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Largest differencing: k parts with balanced sums; with equal, parts of equal counts."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    n = 0

    def push(parts: list[tuple[int, list[int]]]) -> None:
        nonlocal n
        parts.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
        n += 1

    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if equal:
        if len(sizes) % k:
            raise ValueError("the number of items must divide by the number of parts")
        for at in range(0, len(order), k):
            push([(sizes[i], [i]) for i in order[at : at + k]])
    else:
        for i in order:
            push([(sizes[i], [i])] + [(0, []) for _ in range(k - 1)])
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        push([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))])
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy_parts(sizes: list[int], k: int) -> list[list[int]]:
    """Each item, in input order, to the lightest part."""
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, p) for p in range(k)]
    for i, s in enumerate(sizes):
        w, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (w + s, p))
    return parts


def balanced_parts(df: DataFrame, batch: str, row_id: str, length: str, k: int, method: str = "kk") -> DataFrame:
    """(batch, row_id, part): each batch's rows in k parts of similar token totals."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_IN_GROUP:
            raise ValueError(f"a batch of more than {MOST_IN_GROUP} rows")
        pdf = pdf.sort_values(row_id, ignore_index=True)
        sizes = [int(x) for x in pdf[length]]
        parts = karmarkar_karp(sizes, k) if method == "kk" else greedy_parts(sizes, k)
        out = np.zeros(len(sizes), np.int32)
        for p, items in enumerate(parts):
            out[items] = p
        return pd.DataFrame({batch: pdf[batch], row_id: pdf[row_id], "part": out})

    return df.select(batch, row_id, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {row_id} {kinds[row_id]}, part int")


def sentence_bleu(ref: list[str], hyp: list[str], most: int = 4, epsilon: float = 0.1) -> float:
    """BLEU of one sentence, zero counts smoothed by epsilon over the number of n-grams."""
    if not hyp or not ref:
        return 0.0
    total = 0.0
    for n in range(1, most + 1):
        grams = Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1))
        seen = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hit, all_of = sum(min(c, seen[g]) for g, c in grams.items()), max(1, sum(grams.values()))
        if n == 1 and hit == 0:
            return 0.0
        total += math.log((hit or epsilon) / all_of) / most
    return math.exp(total + min(0.0, 1 - len(ref) / len(hyp)))


def average_linkage(d: np.ndarray, limit: float) -> np.ndarray:
    """Labels of agglomerative clustering with average linkage up to a distance."""
    n = len(d)
    label, size = np.arange(n), np.ones(n)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > limit:
            break
        i, j = min(i, j), max(i, j)
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label


def cluster_shares(df: DataFrame, batch: str, row_id: str, text: str, limit: float = 0.5) -> DataFrame:
    """(batch, row_id, cluster, share): BLEU clusters of a batch's texts and the share of the batch in each."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id, ignore_index=True)
        tok = [str(t).split() for t in pdf[text]]
        n = len(tok)
        if n > 2_000:
            raise ValueError("a batch of more than 2000 texts")
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                d[i, j] = d[j, i] = 1 - sentence_bleu(tok[j], tok[i])
        label = average_linkage(d, limit) if n else np.zeros(0, int)
        count = Counter(label.tolist())
        return pd.DataFrame({batch: pdf[batch], row_id: pdf[row_id], "cluster": label.astype("int32"), "share": [count[x] / n for x in label.tolist()]})

    return df.where(F.col(text).isNotNull()).select(batch, row_id, text).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {row_id} {kinds[row_id]}, cluster int, share double")


def is_negative(answer: Column) -> Column:
    """Answers of the kind "no ...": all of them are taken as one."""
    return F.contains(F.lower(answer), F.lit("no "))


def first_match_groups(df: DataFrame, key: str, row_id: str, answer: str) -> DataFrame:
    """(key, row_id, representative): each answer joins the first earlier one it is equal to, or with which it is of the kind "no ...".

    Both relations are equivalences, so the first match of an answer is the first answer of its kind: one map-side
    combined aggregate for each key, no walk over its rows.  Null and empty answers are left out.
    """
    x = df.where(F.col(answer).isNotNull() & (F.col(answer) != "")).select(key, row_id, answer)
    first = x.where(is_negative(F.col(answer))).groupBy(key).agg(F.min_by(answer, F.struct(row_id, answer)).alias("__first"))
    y = x.join(small_side(written(first, "negatives")), key, "left")
    return y.select(key, row_id, F.when(is_negative(F.col(answer)), F.col("__first")).otherwise(F.col(answer)).alias("representative"))


def part_report(parts: DataFrame, batch: str, part: str, length: str) -> DataFrame:
    """(batch, rows, total, fair): what a division holds, and whether its parts differ by no more than its largest item."""
    one = parts.groupBy(batch, part).agg(F.count("*").alias("n"), F.sum(length).alias("t"), F.max(length).alias("m"))
    return one.groupBy(batch).agg(F.sum("n").alias("rows"), F.sum("t").alias("total"), (F.max("t") - F.min("t") <= F.max("m")).alias("fair"))


def repetition(text: str) -> float:
    """2 * (sum of neighbouring suffixes' common prefixes) / (n (n + 1)): near 1 for a text that repeats itself."""
    n = len(text)
    if n < 2:
        return 0.0
    rank = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (key[order][1:] != key[order][:-1]).astype(np.int64))))
        if rank.max() == n - 1 or k >= n:
            break
        k *= 2
    total = h = 0
    for i in range(n):
        if rank[i] == 0:
            h = 0
            continue
        j = order[rank[i] - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        total += h
        h = max(0, h - 1)
    return 2.0 * total / (n * (n + 1))
