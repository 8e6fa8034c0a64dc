"""Evaluation texts leaking into training text (problem 6).

Method: size-partitioned MinHash containment search, verified by exact containment
of runs.

A leak is a run of RUN consecutive words of an item in a document.  A signature of
a whole document would not show it: one run is a tiny part of a long document, so
the similarity of both sets is near 0 whatever the item is.  All texts are
therefore partitioned into parts of one size, the windows of RUN words, each the
set of its RUN - GRAM + 1 runs of GRAM words.  Between parts of equal size
containment 1 is similarity 1, and sets of similarity 1 have the same MinHash, so
one permutation is the whole signature of a part and no leak is missed.
Neighbouring windows mostly share their minimum: a text keeps about two of seven
of its runs (`window_minima`).  Documents are looked up by these minima only, and
every document and item that meet are verified: their common runs of RUN words,
compared word by word.

Items are one sorted index on every executor while their text stays within
INDEX_BYTES (its packed form is checked again); beyond that the minima of both
sides are joined by shuffle, hot minima being spread over several tasks, and the
pairs are verified in the same way.

Nulls: a null or blank text or question has no words and gives no row, nor does
a row with a null id.  Repeated rows: (doc_id, item_id) comes out once; of several
questions of one item the least is taken.  Texts of fewer than RUN words hold no
run.  Empty tables give an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokens as T
from millrace.operators.joins import spread_join
from millrace.session import small_side, written

RUN = 10
#: Words of the runs that a window consists of.
GRAM = 5
#: Largest item table (bytes of text, and of the packed index) that is sent to every executor.
INDEX_BYTES = 64 << 20
_OUT = "doc_id long, item_id long, shared_runs int, containment double"


def clean(text: str | None) -> str:
    return T.fold(T.strip_markup(text)) if text else ""


def window_minima(h: np.ndarray, o: np.ndarray, run: int = RUN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(text, MinHash) of the windows of run words of texts given by their word hashes; equal neighbours come once."""
    gram = min(gram, run)
    s, so = T.shingle_hashes(h, o, gram)
    width = run - gram + 1
    n = np.maximum(np.diff(so) - (width - 1), 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.repeat(so[:-1] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
    if not len(at):
        return owner, np.zeros(0, np.uint64)
    low = s[at]
    for i in range(1, width):
        low = np.minimum(low, s[at + i])
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], low[keep]


class ItemIndex:
    """The items' side: the sorted minima of all items' windows and the items they belong to."""

    def __init__(self, ids: list[int], questions: list[str], run: int):
        self.run = run
        self.ids = np.asarray(ids, np.int64)
        self.questions = questions
        owner, low = window_minima(*T.word_hashes([clean(q) for q in questions], folded=True), run)
        order = np.lexsort((owner, low))
        low, owner = low[order], owner[order]
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        self.keys, self.owner = low[keep], owner[keep]

    def probe(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of value, item) with equal minima."""
        lo = np.searchsorted(self.keys, value, "left")
        hi = np.searchsorted(self.keys, value, "right")
        hit = np.flatnonzero(hi > lo)
        reps = (hi - lo)[hit]
        right = np.repeat(lo[hit], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        return np.repeat(hit, reps), self.owner[right]


@lru_cache(maxsize=100_000)
def item_runs(question: str, run: int) -> frozenset[tuple[str, ...]]:
    w = T.words(clean(question))
    return frozenset(tuple(w[i : i + run]) for i in range(len(w) - run + 1))


def text_runs(text: str, run: int) -> set[tuple[str, ...]]:
    """The runs of a cleaned text."""
    w = T.WORD.findall(text)
    return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}


def _rows(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """(document, item, common runs, the item's runs)."""
    d, i, n, total = zip(*found) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array([a / b for a, b in zip(n, total)], pa.float64())], names=["doc_id", "item_id", "shared_runs", "containment"]
    )


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    question: str = "question",
    run: int = RUN,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """(doc_id, item_id, shared_runs, containment) of every document and item that share a run of words."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(question).cast("string").alias("question")).where("item_id is not null and question is not null")
    items = written(items.groupBy("item_id").agg(F.min("question").alias("question")), "items")
    size = items.agg(F.sum(F.octet_length("question")).alias("bytes")).first().bytes or 0
    packed = None
    if size <= index_bytes:
        rows = items.orderBy("item_id").collect()
        packed = pickle.dumps(ItemIndex([r.item_id for r in rows], [r.question for r in rows], run))
    if packed is None or len(packed) > index_bytes:
        return _by_shuffle(docs, items, run)
    shared = spark.sparkContext.broadcast(packed)
    held: dict[str, ItemIndex] = {}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.get("x") or held.setdefault("x", pickle.loads(shared.value))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = [clean(t) for t in b.column(1).to_pylist()]
            yield _rows(list(_verified(ids, texts, ix)))

    found = docs.mapInArrow(search, _OUT)
    return found.groupBy("doc_id", "item_id").agg(F.max("shared_runs").alias("shared_runs"), F.max("containment").alias("containment"))


def _verified(ids: np.ndarray, texts: list[str], ix: ItemIndex) -> Iterator[tuple[int, int, int, int]]:
    if not len(ix.keys):
        return
    owner, low = window_minima(*T.word_hashes(texts, folded=True), ix.run)
    row, item = ix.probe(low)
    last, runs = -1, set()
    for d, i in np.unique(np.stack([owner[row], item]), axis=1).T.tolist():
        if d != last:  # the pairs of a document stand together: it is read once
            last, runs = d, text_runs(texts[d], ix.run)
        mine = item_runs(ix.questions[i], ix.run)
        if n := len(mine & runs):
            yield int(ids[d]), int(ix.ids[i]), n, len(mine)


def _by_shuffle(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """The same search for item tables of any size: the minima of both sides are joined."""

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            owner, low = window_minima(*T.word_hashes([clean(t) for t in b.column(1).to_pylist()], folded=True), run)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(T.signed(low))], names=["id", "low"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, runs = None, set()
        for b in batches:
            found = []
            for d, i, t, q in zip(*(b.column(k).to_pylist() for k in range(4))):
                if d != last:
                    last, runs = d, text_runs(clean(t), run)
                mine = item_runs(q, run)
                if n := len(mine & runs):
                    found.append((d, i, n, len(mine)))
            yield _rows(found)

    i = written(items.mapInArrow(minima, "id long, low long").distinct().withColumnRenamed("id", "item_id"), "item_minima")
    asked = small_side(written(i.select("low").distinct(), "asked_minima"))
    d = docs.mapInArrow(minima, "id long, low long").join(asked, "low", "left_semi").distinct().withColumnRenamed("id", "doc_id")
    pairs = written(spread_join(i, written(d, "document_minima"), ["low"]).select("doc_id", "item_id").distinct(), "meetings")
    wanted = small_side(written(pairs.select("doc_id").distinct(), "met"))
    both = pairs.join(docs.join(wanted, "doc_id", "left_semi"), "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "question")
    found = both.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(check, _OUT)
    return found.groupBy("doc_id", "item_id").agg(F.max("shared_runs").alias("shared_runs"), F.max("containment").alias("containment"))
