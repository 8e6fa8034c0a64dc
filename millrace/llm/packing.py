"""Filling fixed-capacity containers with items (problem 2).

Method: swap-based local search.  Bins are filled best fit decreasing, then
underfull bins exchange items one for one, two for one, or move one item, always
so that the sum of squared fills grows.  A growing sum drives items out of
nearly empty bins into nearly full ones until bins empty and vanish.

Only lengths are moved, never token arrays.  Items are hashed into groups of
about GROUP_ITEMS, each searched in its own task; bins that stay underfull are
broken up and their items regrouped with others for the next round, so the loss
is that of the last, small round and not one bin for each group.  Group sizes
follow the item count alone, whatever the keys look like.

A sequence longer than the capacity is divided: full-capacity parts fill a bin
each, the remainder is packed like an item.  Every other sequence stays whole.

Nulls: a null attention mask means all of input_ids, null input_ids mean length
0; empty sequences need no container and get no row.  Rows with a null seq_id or
a capacity that is null or below 1 are no work and get no row.  A sequence
delivered twice counts once (its greatest length).  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

GROUP_ITEMS = 2_000
ROUNDS = 4
#: A bin this full is closed; a fuller one is never opened again.
CLOSED = 0.99
#: Limits come as a small table; more than this many is refused rather than crossed with the items.
MAX_LIMITS = 1_000
PASSES = 12

_OUT = "pack_name string, capacity int, bin_id string, seq_id long, part_no int, parts int, length int, open boolean"


def lengths(seqs: DataFrame, seq_id: str = "seq_id", ids: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    """(seq_id, length), one row for each sequence."""
    ones = F.size(F.filter(F.col(mask), lambda x: x == 1))
    n = F.when(F.col(mask).isNull(), F.when(F.col(ids).isNull(), 0).otherwise(F.size(F.col(ids)))).otherwise(ones)
    return (
        seqs.select(F.col(seq_id).cast("long").alias("seq_id"), n.cast("int").alias("length"))
        .where("seq_id is not null")
        .groupBy("seq_id")
        .agg(F.max("length").alias("length"))
    )


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices; each item goes to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free space, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        k = bisect_left(free, (s, -1))
        if k < len(free):
            room, b = free.pop(k)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > s:
            insort(free, (room - s, b))
    return bins


def local_search(sizes: list[int], capacity: int, bins: list[list[int]], passes: int = PASSES) -> list[list[int]]:
    """Improves underfull bins by moves and exchanges that increase the sum of squared fills."""
    full = [b for b in bins if sum(sizes[i] for i in b) >= capacity]
    work = [sorted(b, key=lambda i: sizes[i]) for b in bins if sum(sizes[i] for i in b) < capacity]
    fill = [sum(sizes[i] for i in b) for b in work]

    def put(b: int, out: list[int], into: list[int]) -> None:
        for i in out:
            work[b].remove(i)
        work[b] = sorted(work[b] + into, key=lambda i: sizes[i])
        fill[b] = sum(sizes[i] for i in work[b])

    def improve(a: int, b: int) -> bool:
        """Sends size from the emptier bin a to the fuller bin b."""
        room = capacity - fill[b]
        keys_a = [sizes[i] for i in work[a]]
        # move: the largest item of a that fits into b
        k = bisect_right(keys_a, room) - 1
        if k >= 0:
            i = work[a][k]
            put(a, [i], [])
            put(b, [], [i])
            return True
        keys_b = [sizes[i] for i in work[b]]
        best: tuple[int, list[int], list[int]] | None = None
        for j in work[b]:
            # one for one: the largest item of a that is at most room longer than j
            k = bisect_right(keys_a, sizes[j] + room) - 1
            if k >= 0 and sizes[work[a][k]] > sizes[j]:
                gain = sizes[work[a][k]] - sizes[j]
                if best is None or gain > best[0]:
                    best = (gain, [work[a][k]], [j])
            # two of a for one of b
            lo, hi = 0, len(keys_a) - 1
            while lo < hi:
                s = keys_a[lo] + keys_a[hi]
                if s > sizes[j] + room:
                    hi -= 1
                    continue
                if s > sizes[j] and (best is None or s - sizes[j] > best[0]):
                    best = (s - sizes[j], [work[a][lo], work[a][hi]], [j])
                lo += 1
        # one of a for two of b
        for i in work[a]:
            lo, hi = 0, len(keys_b) - 1
            while lo < hi:
                s = keys_b[lo] + keys_b[hi]
                if s >= sizes[i]:
                    hi -= 1
                    continue
                if sizes[i] - s <= room and (best is None or sizes[i] - s > best[0]):
                    best = (sizes[i] - s, [i], [work[b][lo], work[b][hi]])
                lo += 1
        if best is None:
            return False
        put(a, best[1], best[2])
        put(b, best[2], best[1])
        return True

    for _ in range(passes):
        order = sorted(range(len(work)), key=lambda b: (fill[b], b))
        changed = False
        for x, a in enumerate(order):
            for b in reversed(order[x + 1 :]):
                # b must be the fuller bin: then whatever it gains increases the sum of squares
                while work[a] and fill[a] <= fill[b] < capacity and improve(a, b):
                    changed = True
                if not work[a]:
                    break
        keep = [b for b in range(len(work)) if work[b]]
        work, fill = [work[b] for b in keep], [fill[b] for b in keep]
        if not changed:
            break
    return full + work


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "seq_id", "part_no"], ascending=[False, True, True], ignore_index=True)
    capacity = int(pdf["capacity"].iloc[0])
    sizes = [int(x) for x in pdf["length"]]
    bins = local_search(sizes, capacity, best_fit_decreasing(sizes, capacity))
    name = str(pdf["name"].iloc[0])
    where, still = [""] * len(sizes), [False] * len(sizes)
    for k, b in enumerate(bins):
        is_open = sum(sizes[i] for i in b) < CLOSED * capacity
        for i in b:
            where[i], still[i] = f"{name}-{k}", is_open
    out = pdf[["pack_name", "capacity", "seq_id", "part_no", "parts", "length"]].copy()
    out.insert(2, "bin_id", where)
    out["open"] = still
    return out


def fill_containers(seqs: DataFrame, limits: DataFrame, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """(pack_name, capacity, bin_id, seq_id, part_no, parts, length): the container of every sequence or part."""
    caps = (
        limits.select(F.col("pack_name").cast("string").alias("pack_name"), F.col("capacity").cast("int").alias("capacity"))
        .where("pack_name is not null and capacity >= 1").dropDuplicates(["pack_name"]).orderBy("pack_name").limit(MAX_LIMITS + 1).collect()
    )
    if len(caps) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    sized = lengths(seqs).where("length > 0")
    empty = sized.sparkSession.createDataFrame([], _OUT).drop("open")
    if not caps:
        return empty
    choices = F.explode(F.array(*[F.struct(F.lit(c.pack_name).alias("pack_name"), F.lit(c.capacity).alias("capacity")) for c in caps]))
    item = sized.select("seq_id", "length", choices.alias("c")).select("c.*", "seq_id", "length")
    item = item.withColumn("parts", F.ceil(F.col("length") / F.col("capacity")).cast("int"))
    part = item.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "length", F.least(F.col("capacity"), F.col("length") - F.col("part_no") * F.col("capacity")).cast("int")
    )
    done = part.where("length = capacity").select(
        "pack_name", "capacity", F.concat_ws("-", F.lit("full"), "seq_id", "part_no").alias("bin_id"), "seq_id", "part_no", "parts", "length"
    )
    todo = part.where("length < capacity").select("pack_name", "capacity", "seq_id", "part_no", "parts", "length")
    pieces = [written(done, "full")]
    for r in range(rounds):
        counts = {x.pack_name: x.n for x in todo.groupBy("pack_name").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        groups = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, max(1, -(-n // group_items)))]), F.col("pack_name"))
        keyed = todo.withColumn("g", F.pmod(F.xxhash64("seq_id", "part_no", F.lit(r)), groups.cast("long"))).withColumn("name", F.concat_ws("-", F.lit(f"r{r}"), "g"))
        packed = written(keyed.groupBy("pack_name", "capacity", "g").applyInPandas(_search, _OUT), f"pack{r}")
        last = r == rounds - 1 or all(n <= group_items for n in counts.values())
        if last:
            pieces.append(packed.drop("open"))
            break
        pieces.append(packed.where("not open").drop("open"))
        todo = packed.where("open").select("pack_name", "capacity", "seq_id", "part_no", "parts", "length")
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def divided(packed: DataFrame) -> DataFrame:
    """(pack_name, seq_id) of the sequences that had to be divided."""
    return packed.where("parts > 1 and part_no = 0").select("pack_name", "seq_id")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers used, the least number possible by volume, and unused positions, per limit."""
    bins = packed.groupBy("pack_name", "capacity", "bin_id").agg(F.sum("length").alias("used"))
    total = bins.groupBy("pack_name", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.select(
        "pack_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens",
        (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"), "fullest",
    )
