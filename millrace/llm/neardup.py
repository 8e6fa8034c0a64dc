"""Near-duplicate records with small edits (problem 4).

Method: a Jaccard metric-space join.  Pivots create regions, windows replicate
documents to every region in which a partner may lie, and regions join
recursively and exactly.

Documents are sets of runs of three words; d = 1 - Jaccard similarity is a
metric and two documents are linked at d <= 1/2.  With this threshold pivots
that are documents prune nothing at the top: unrelated texts all lie at d near 1
from every document, and the window of the triangle inequality, d(p, y) <=
r + 1/2, spans them all.  The top-level pivots are therefore single runs: a run s
is a set of one element, a document lies nearer than 1 to it only if it holds s,
and its Voronoi regions are those of its runs in one global order (rarest words
first).  The window is the overlap bound, which is exact: a document x can have
K runs in common with a partner only among its first |x| - ceil(|x|/2) + K runs,
so it is replicated to these regions and no others, and a pair must meet in at
least K of them.  The order may be any; it takes the word counts and the frequent
runs of all documents, so that common runs are pivots last.

Documents that meet often enough, directly or over others, are a region of the
metric space: nothing outside it can be linked to anything inside.  Each region is
joined by `metric_join`: documents as pivots, members put to their nearest pivot,
windows of the triangle inequality (|d(p, x) - d(p, y)| <= 1/2, and the hyperplane
between two pivots) that replicate boundary documents to the other cores, pairs that
a pivot already decides left uncounted, and recursion into the cores.  A region of
more than REGION documents (a large family of near-copies) is joined by the same
steps as jobs (`dense_links`); pairs on both sides of a pivot within 1/2 of it are
connected through it there and need no look.  Regions that do not shrink are joined
block by block.

Documents with equal sets are one node from the start, so copies cost one row.
What moves through shuffles is packed: a blob of hashes for each batch and each range
that it has something for, never more blobs than hashes; every range is a task.

Nulls: null texts, rows with a null id and documents of fewer than LEAST_WORDS
words take no part and get no row.  Repeated rows of a document count once.
Empty tables give an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokens as T
from millrace.operators.components import connected_components
from millrace.session import small_side, written

SHINGLE = 3
THRESHOLD = 0.5
LEAST_WORDS = 40
#: Common runs that a pair must show among the replicated ones.
K = 6
#: Runs in at least so many documents are pivots last; a partition reports those it holds LOCAL times.
HOT, LOCAL = 10, 2
#: Bounds of the two frequency tables (rows); beyond them the least frequent are left out of the order, which stays valid.
FREQUENT_WORDS, FREQUENT_RUNS = 250_000, 250_000
#: Bytes of input for each range.
RANGE_BYTES = 16 << 20
REGION = 1_000
PIVOTS = 8
#: Regions of so few members are compared pair by pair.
LEAF = 12
#: Members of regions that one task joins together.
TASK_MEMBERS = 5_000
EPS = 1e-9
ROUNDS = 6

_U = np.uint64
_HASH_BITS = _U(48)
_LOW = _U((1 << 48) - 1)


def _sets(texts: list[str | None], ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, word hashes, word offsets, run hashes, run offsets) of the documents that take part."""
    h, o = T.word_hashes(texts)
    keep = np.flatnonzero(np.diff(o) >= max(least, SHINGLE))
    n = np.diff(o)[keep]
    at = np.repeat(o[:-1][keep] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
    h, o = h[at], np.concatenate(([0], np.cumsum(n)))
    s, so = T.shingle_hashes(h, o, SHINGLE)
    return ids[keep], h, o, s, so


def _split(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places) for the ranges that occur: the cost follows the values, not the number of ranges."""
    order = np.argsort(where, kind="stable")
    found, first = np.unique(where[order], return_index=True)
    for r, lo, hi in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield r, order[lo:hi]


def _blobs(rows: list[tuple[str, int, int, int, bytes]]) -> pa.RecordBatch:
    kind, x, y, n, blob = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "x", "y", "n", "blob"]
    )


_FIRST = "kind string, x long, y long, n int, blob binary"


def _first_pass(docs: DataFrame, ranges: int, least: int) -> DataFrame:
    """Documents' nodes (d: doc, node, size), word counts (w) and runs that a partition holds LOCAL times (s)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        runs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, parts, floor in (("w", words, 1), ("s", runs, LOCAL)):
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                u, n = u[n >= floor], n[n >= floor]
                where = ((u & _LOW) % _U(ranges)).astype(np.int64)
                for r, at in _split(where):
                    rows.append((kind, r, 0, len(at), u[at].tobytes() + n[at].astype(np.uint32).tobytes()))
            words.clear()
            runs.clear()
            return _blobs(rows)

        for b in batches:
            ids, h, _, s, so = _sets(b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False), least)
            if not len(ids):
                continue
            d, do = T.distinct_by_text(s, so)
            node = T.signed(T.set_hashes(d, do))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["d"] * n), pa.array(ids), pa.array(node), pa.array(np.diff(do).astype(np.int32)), pa.nulls(n, pa.binary())], names=["kind", "x", "y", "n", "blob"]
            )
            words.append(h)
            runs.append(d)
            held += len(d)
            if held > 8_000_000:
                held = 0
                yield flush()
        if words:
            yield flush()

    return docs.mapInArrow(look, _FIRST)


def _frequent(first: DataFrame, kind: str, floor: int, most: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts): the most frequent words or runs, at most `most` rows (16 bytes each, so what is broadcast is bounded)."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for n, blob in zip(pdf["n"], pdf["blob"]):
            keys.append(np.frombuffer(blob, _U, n))
            counts.append(np.frombuffer(blob, np.uint32, n, 8 * n))
        u, inv = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(inv, np.concatenate(counts)).astype(np.int64)
        return pd.DataFrame({"h": T.signed(u[c >= floor]), "c": c[c >= floor]})

    t = _by_range(first.where(F.col("kind") == kind), ranges, total, "h long, c long")
    t = t.orderBy(F.desc("c"), "h").limit(most).toPandas()
    h = t["h"].to_numpy(np.int64).view(_U)
    order = np.argsort(h)
    return h[order], t["c"].to_numpy(np.int64)[order]


def _by_range(df: DataFrame, ranges: int, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over the rows of each range; every range is one task of its own, whatever the session's setting is."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if held:
            for _, g in pd.concat(held).groupby("x"):
                yield f(g)

    return df.repartitionById(ranges, F.col("x").cast("int")).mapInPandas(run, schema)


def _lookup(keys: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, counts[at], 0)


class Order:
    """The global order of runs: frequent runs last, before them by how rare their words are."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], runs: tuple[np.ndarray, np.ndarray]):
        self.words, self.runs = words, runs

    def keyed(self, h: np.ndarray, o: np.ndarray, s: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of each document in global order, as (rank << 48 | hash), and the offsets."""
        u, inv = np.unique(h, return_inverse=True)
        weight = np.log2(1.0 + _lookup(*self.words, u))[inv]
        n = np.diff(so)
        at = np.repeat(o[:-1] - so[:-1], n) + np.arange(len(s))
        rank = np.zeros(len(s))
        for i in range(SHINGLE):
            rank += weight[at + i]
        rank = np.minimum(rank * 256, 32_000)
        hot = _lookup(*self.runs, s)
        rank = np.where(hot > 0, 32_001 + np.minimum(np.log2(1.0 + hot) * 800, 33_000), rank).astype(_U)
        return T.distinct_by_text((rank << _HASH_BITS) | (s & _LOW), so)


def least_common(size: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(K, np.ceil(t * size).astype(np.int64))


def prefix_lengths(size: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(size, size - np.ceil(t * size).astype(np.int64) + least_common(size, t))


def _replicas(docs: DataFrame, order: Order, ranges: int, least: int, t: float) -> DataFrame:
    """Packed replicas of each document in its regions: range, blob of (nodes, sizes, runs, owner, place)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h, o, s, so = _sets(b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False), least)
            if not len(ids):
                continue
            d0, do0 = T.distinct_by_text(s, so)
            node = T.set_hashes(d0, do0)
            key, ko = shared.value.keyed(h, o, s, so)
            size = np.diff(ko)
            _, first = np.unique(node, return_index=True)
            keep = np.zeros(len(node), bool)
            keep[first] = True  # a batch sends copies once
            place = np.arange(len(key)) - np.repeat(ko[:-1], size)
            take = (place < np.repeat(prefix_lengths(size, t), size)) & np.repeat(keep, size)
            owner = np.repeat(np.arange(len(node)), size)[take]
            run, place = key[take] & _LOW, place[take]
            rows = []
            for r, at in _split((run % _U(ranges)).astype(np.int64)):
                own, local = np.unique(owner[at], return_inverse=True)
                blob = b"".join(
                    [node[own].tobytes(), size[own].astype(np.uint32).tobytes(), (run[at] >> _U(16)).astype(np.uint32).tobytes(), (run[at] & _U(0xFFFF)).astype(np.uint16).tobytes(),
                     local.astype(np.uint16 if len(own) < 65_536 else np.uint32).tobytes(), np.minimum(place[at], 65_535).astype(np.uint16).tobytes()]
                )
                rows.append(("r", r, len(own), len(at), blob))
            yield _blobs(rows)

    return docs.mapInArrow(look, _FIRST)


def _unpack(owners: int, n: int, blob: bytes) -> tuple[np.ndarray, ...]:
    node, at = np.frombuffer(blob, _U, owners), 8 * owners
    size, at = np.frombuffer(blob, np.uint32, owners, at), at + 4 * owners
    hi, at = np.frombuffer(blob, np.uint32, n, at), at + 4 * n
    lo, at = np.frombuffer(blob, np.uint16, n, at), at + 2 * n
    kind, width = (np.uint16, 2) if owners < 65_536 else (np.uint32, 4)
    own, at = np.frombuffer(blob, kind, n, at), at + width * n
    place = np.frombuffer(blob, np.uint16, n, at)
    return (hi.astype(_U) << _U(16)) | lo, node[own], size[own].astype(np.int64), place.astype(np.int64)


def _meet(t: float, region: int, ranges: int):
    """Reducer of one range: pairs that meet in a region (p) and members of regions too large for one task (g)."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(y, n, blob) for y, n, blob in zip(pdf["y"], pdf["n"], pdf["blob"])]
        run, node, size, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((node, size, run))
        run, node, size, place = run[order], node[order], size[order], place[order]
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != run[:-1]) | (node[1:] != node[:-1])
        run, node, size, place = run[keep], node[keep], size[keep], place[keep]
        start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        length = np.diff(np.append(start, len(run)))
        rest = size - 1 - place
        k = least_common(size, t)
        found: list[np.ndarray] = []
        big: list[tuple[int, np.ndarray]] = []
        for n in np.unique(length[length > 1]).tolist():
            cells = start[length == n]
            if n > region:
                big += [(int(run[c]), node[c : c + n]) for c in cells]
                continue
            i, j = np.triu_indices(n, 1)
            step = max(1, 2_000_000 // len(i))
            for c in range(0, len(cells), step):
                a = (cells[c : c + step, None] + i).ravel()
                b = (cells[c : c + step, None] + j).ravel()
                need = np.ceil(t / (1 + t) * (size[a] + size[b]) - 1e-9)
                both = np.minimum(k[a], k[b])
                ok = (size[a] >= t * size[b]) & (both + np.minimum(rest[a], rest[b]) >= need)
                a, b, both = a[ok], b[ok], both[ok]
                x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
                # a pair that needs fewer than K meetings gets the difference as a bonus, each time at most K
                found.append(np.stack([x, y, (K - both).astype(_U)]))
        rows = []
        if found:
            x, y, bonus = np.concatenate(found, axis=1)
            if len(x):
                order = np.lexsort((y, x))
                x, y, bonus = x[order], y[order], bonus[order]
                first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
                n = np.diff(np.append(first, len(x))) + bonus[first].astype(np.int64)
                x, y, n = x[first], y[first], np.minimum(n, 255).astype(np.uint8)
                where = (T.mix64(x ^ (y * _U(3))) % _U(ranges)).astype(np.int64)
                for r, at in _split(where):
                    rows.append(("p", r, 0, len(at), x[at].tobytes() + y[at].tobytes() + n[at].tobytes()))
        for cell, members in big:
            rows.append(("g", cell, 0, len(members), members.tobytes()))
        return pd.DataFrame(rows, columns=["kind", "x", "y", "n", "blob"])

    return join


def _often(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs that meet in at least K regions."""
    xs, ys, ns = [], [], []
    for n, blob in zip(pdf["n"], pdf["blob"]):
        xs.append(np.frombuffer(blob, _U, n))
        ys.append(np.frombuffer(blob, _U, n, 8 * n))
        ns.append(np.frombuffer(blob, np.uint8, n, 16 * n))
    x, y, n = np.concatenate(xs), np.concatenate(ys), np.concatenate(ns).astype(np.int64)
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    keep = np.add.reduceat(n, first) >= K
    return pd.DataFrame({"a": T.signed(x[first][keep]), "b": T.signed(y[first][keep])})


def run_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(node, set): the sorted runs, as packed 64-bit hashes, of the wanted nodes; one document of each is read."""
    reps = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(wanted.distinct(), "wanted")
    reps = written(reps.join(small_side(wanted), "node", "left_semi").select("doc_id", "node"), "reps")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, _, s, so = _sets(b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False), least)
            d, do = T.distinct_by_text(s, so)
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(T.set_hashes(d, do))), pa.array([d[do[i] : do[i + 1]].tobytes() for i in range(len(ids))], pa.binary())], names=["node", "set"]
            )

    mine = docs.join(small_side(reps.select("doc_id")), "doc_id", "left_semi")
    return mine.mapInArrow(look, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    n = int((y[at] == x).sum())
    return n / (len(x) + len(y) - n)


def _common(x: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted set x with sets that lie flat, none of them empty."""
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    return np.add.reduceat((x[at] == flat).astype(np.int64), start)


def metric_join(sets: list[np.ndarray], t: float = THRESHOLD, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of sets (sorted hashes, not empty, in a random order) whose Jaccard similarity is at least t."""
    size = np.array([len(x) for x in sets], np.int64)
    theta = 1 - t
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def similarity(i: int, others: np.ndarray) -> np.ndarray:
        n = size[others]
        common = _common(sets[i], np.concatenate([sets[j] for j in others]), np.concatenate(([0], np.cumsum(n)))[:-1])
        return common / (size[i] + n - common)

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        left.append(np.minimum(a, b))
        right.append(np.maximum(a, b))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else []
        for lo, hi in zip(first, [*first[1:], len(a)]):
            ok = b[lo:hi][similarity(int(a[lo]), b[lo:hi]) >= t - EPS]
            keep(np.full(len(ok), a[lo]), ok)

    def decide(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs with their distances x and y to all pivots: far and close ones by the triangle inequality, the others by their sets."""
        open_ = np.abs(x - y).max(axis=0) <= theta + EPS
        sure = open_ & ((x + y).min(axis=0) <= theta - EPS)
        keep(a[sure], b[sure])
        compare(a[open_ & ~sure], b[open_ & ~sure])

    def join(members: np.ndarray) -> None:
        if len(members) <= leaf:
            i, j = np.triu_indices(len(members), 1)
            return compare(members[i], members[j])
        pivots = members[:PIVOTS]
        d = np.stack([1 - similarity(int(p), members) for p in pivots])
        nearest = d.argmin(axis=0)
        cores = [np.flatnonzero(nearest == q) for q in range(len(pivots))]
        if max(map(len, cores)) > 0.9 * len(members):
            i, j = np.triu_indices(len(members), 1)
            return decide(members[i], members[j], d[:, i], d[:, j])
        own = d[nearest, np.arange(len(members))]
        for q, core in enumerate(cores):
            if not len(core):
                continue
            join(members[core])
            window = np.flatnonzero((nearest > q) & (d[q] <= d[q, core].max() + theta + EPS) & (d[q] - own <= 2 * theta + EPS))
            if len(window):
                i, j = (z.ravel() for z in np.meshgrid(core, window, indexing="ij"))
                decide(members[i], members[j], d[:, i], d[:, j])

    join(np.arange(len(sets)))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _least_of_component(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each one's component."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def _region_classes(t: float):
    """Joins whole regions: the class of every member and the number of documents that it is linked with."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.sort_values(["region", "node"]).groupby("region"):
            node, copies = g["node"].to_numpy(), g["copies"].to_numpy()
            i, j = metric_join([np.frombuffer(x, _U) for x in g["set"]], t)
            n = copies - 1
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            out.append(pd.DataFrame({"node": node, "component": node[_least_of_component(len(node), i, j)], "n_links": n}))
        return pd.concat(out)

    return join


def _region_links(t: float):
    """Exact join of one region in one task."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(x, _U) for x in pdf["set"]]
        node = pdf["node"].to_numpy()
        i, j = metric_join(sets, t)
        return pd.DataFrame({"a": node[i], "b": node[j]})

    return join


def dense_links(members: DataFrame, sets: DataFrame, t: float = THRESHOLD, region: int = REGION, rounds: int = ROUNDS) -> DataFrame:
    """Links inside regions too large for one task, up to links between nodes that a pivot already connects.

    members: (region, node).  Pivots are the PIVOTS members of least hash.  Links
    to pivots are exact.  A member within theta = 1 - t of pivot q is settled with
    q.  The new region of q holds the unsettled members y with d(q, y) <= r + theta,
    r being the radius of q's Voronoi core, and those settled core members x with
    d(q, x) >= d(q, y) - theta for the nearest such y.
    """
    theta = 1 - t
    out: list[DataFrame] = []
    now = written(members.select("region", "node").distinct(), "dense")
    schema = "region long, node long, pivots array<long>, d array<double>"

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [[p["node"] for p in ps] for ps in b.column(3).to_pylist()]
            d = [[1 - jaccard(s, p["set"]) for p in ps] for s, ps in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(d, pa.list_(pa.float64()))], names=["region", "node", "pivots", "d"])

    for r in range(rounds):
        sizes = written(now.groupBy("region").agg(F.count("*").alias("members")), "sizes")
        small = now.join(small_side(sizes.where(F.col("members") <= region).select("region")), "region", "left_semi")
        out.append(written(small.join(sets, "node").groupBy("region").applyInPandas(_region_links(t), "a long, b long"), f"small{r}"))
        large = sizes.where(F.col("members") > region)
        if large.isEmpty():
            return _union(out)
        rest = now.join(small_side(large), "region").join(sets, "node")
        h = F.xxhash64("node", "region", F.lit(r))
        chosen = rest.groupBy("region", F.pmod(h, F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("node", "set"), h).alias("p"))
        # a region has at most PIVOTS of them, so a region's row stays small
        pivots = written(chosen.groupBy("region").agg(F.collect_list("p").alias("pivots")), "pivots")
        far = written(rest.select("region", "node", "set").join(small_side(pivots), "region").mapInArrow(distances, schema), f"far{r}")
        each = far.select("region", "node", F.explode(F.arrays_zip(F.col("pivots").alias("q"), F.col("d").alias("dq"))).alias("z"), F.array_min("d").alias("nearest")).select("region", "node", "z.*", "nearest")
        out.append(written(each.where((F.col("dq") <= theta + EPS) & (F.col("q") != F.col("node"))).select(F.least("node", "q").alias("a"), F.greatest("node", "q").alias("b")), f"star{r}"))
        core = each.where("dq = nearest").groupBy("region", "q").agg(F.max("dq").alias("radius"))
        open_side = each.where(F.col("dq") > theta + EPS).join(core, ["region", "q"]).where(F.col("dq") <= F.col("radius") + theta + EPS)
        reach = open_side.groupBy("region", "q").agg(F.min("dq").alias("closest"))
        shell = each.where((F.col("dq") <= theta + EPS) & (F.col("dq") > 0)).join(reach, ["region", "q"]).where(F.col("dq") >= F.col("closest") - theta - EPS)
        nxt = open_side.select("region", "q", "node").unionByName(shell.select("region", "q", "node"))
        nxt = written(nxt.select("region", F.xxhash64("region", "q", F.lit(r)).alias("sub"), "node").distinct(), f"next{r}")
        grown = nxt.groupBy("region", "sub").agg(F.count("*").alias("n")).join(large, "region")
        stuck = written(grown.where(F.col("n") > 0.9 * F.col("members")).select("region").distinct(), "stuck")
        if not stuck.isEmpty():
            out.append(_block_links(now.join(small_side(stuck), "region", "left_semi"), sets, t, region))
        now = nxt.join(small_side(stuck), "region", "left_anti").select(F.col("sub").alias("region"), "node")
        now = written(now, f"round{r}")
    out.append(_block_links(now, sets, t, region))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.distinct()


def _block_links(members: DataFrame, sets: DataFrame, t: float, region: int) -> DataFrame:
    """Exact join of regions of any size: members in blocks, every pair of blocks in a task of its own."""
    half = max(1, region // 2)
    n = members.groupBy("region").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / half)).cast("int").alias("blocks"))
    b = members.join(n, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = b.select("region", "node", "block", other).select("region", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return written(cells.join(sets, "node").groupBy("region", "i", "j").applyInPandas(_region_links(t), "a long, b long"), "blocks")


def _ranges(df: DataFrame) -> int:
    """Number of ranges, from the planner's size of the input; where it has none, from the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // RANGE_BYTES)) if size < 1 << 60 else least


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = THRESHOLD, least: int = LEAST_WORDS, region: int = REGION) -> DataFrame:
    """(doc_id, class_id, class_size, n_links): the classes of two or more documents connected through links.

    n_links: other documents that this one is linked with directly, copies included; null in a region of more than `region` nodes.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    ranges = _ranges(base)
    first = written(_first_pass(base, ranges, least), "first")
    nodes = written(first.where("kind = 'd'").groupBy(F.col("x").alias("doc_id")).agg(F.min("y").alias("node")), "nodes")
    copies = written(nodes.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")), "copies")
    order = Order(_frequent(first, "w", 1, FREQUENT_WORDS, ranges), _frequent(first, "s", HOT, FREQUENT_RUNS, ranges))
    met = written(_by_range(_replicas(base, order, ranges, least, t), ranges, _meet(t, region, ranges), _FIRST), "met")
    pairs = _by_range(met.where("kind = 'p'"), ranges, _often, "a long, b long")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(blob, np.int64, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n - 1, x[0])), pa.array(x[1:])], names=["a", "b"])

    crowded = met.where("kind = 'g'").select("n", "blob").mapInArrow(star, "a long, b long")
    members = connected_components(written(pairs.unionByName(crowded), "pairs")).withColumnRenamed("component", "region")
    members = written(members, "members")
    sizes = written(members.groupBy("region").agg(F.count("*").alias("n")), "sizes")
    sets = written(run_sets(base, members.select("node"), nodes, least), "sets")
    small, large = (written(sizes.where(c).select("region"), "regions") for c in (F.col("n") <= region, F.col("n") > region))
    tasks = max(1, -(-members.count() // TASK_MEMBERS))
    full = members.join(small_side(small), "region", "left_semi").join(sets, "node").join(copies.select("node", "copies"), "node")
    task = F.pmod(F.xxhash64("region"), F.lit(tasks))
    parts = _by_range(full.withColumn("x", task), tasks, _region_classes(t), "node long, component long, n_links long")
    if not large.isEmpty():
        links = dense_links(members.join(small_side(large), "region", "left_semi"), sets, t, region)
        parts = parts.unionByName(connected_components(written(links, "linked")).withColumn("n_links", F.lit(None).cast("long")))
    parts = copies.join(small_side(written(parts, "parts")), "node", "left").where("copies > 1 or component is not null")
    parts = parts.select("node", "copies", "first_doc", F.coalesce("component", "node").alias("c"), F.when(F.col("component").isNull(), F.col("copies") - 1).otherwise(F.col("n_links")).alias("n_links"))
    parts = written(parts, "classes_of_nodes")
    classes = parts.groupBy("c").agg(F.sum("copies").alias("class_size"), F.min("first_doc").alias("class_id")).where("class_size > 1")
    found = written(parts.join(small_side(written(classes, "classes")), "c").select("node", "class_id", "class_size", "n_links"), "found")
    return nodes.join(small_side(found), "node").select("doc_id", "class_id", "class_size", "n_links")


def pairs_of(classes: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all pairs of documents in the same class."""
    a = classes.select(F.col("doc_id").alias("doc_id_a"), "class_id")
    b = classes.select(F.col("doc_id").alias("doc_id_b"), "class_id")
    return a.join(b, "class_id").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


__all__ = ["dense_links", "jaccard", "metric_join", "near_duplicates", "pairs_of", "run_sets"]
