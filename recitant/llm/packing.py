"""Problem 8: items of known size into containers of permitted capacities with little unused room.

Items of one size are interchangeable, so only the histogram of sizes is planned, and it has no more rows
than the largest capacity has tokens, however large the corpus. Planning is variable-capacity best fit: the
largest size left opens a bin of the permitted capacity whose best filling costs least per token held; the
filling is the subset of the sizes left that comes nearest to the gap (subset sums as bit sets, large sizes
first); the pattern is repeated until one of its sizes runs out, so there are no more patterns than sizes;
at last each bin is put down to the smallest permitted capacity that holds its contents.

Items then find their bins by size and rank: ranks are counted within (size, salt) and shifted by the counts
of the salts before, so that a size that a third of all items has is no single group.

Defined results: items of size null, 0 or less are in no container; an item above the largest capacity is cut
into full containers and a rest, no other item is cut; repeated rows are items of their own only if their
keys differ (a key stands for one item).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut

#: Items that one (size, salt) group should not exceed.
GROUP_ITEMS = 500_000


def best_filling(gap: int, counts: dict[int, int], sizes: list[int]) -> list[int]:
    """Sizes (with repetition, within counts) whose sum is as near below ``gap`` as can be. ``sizes`` falls.

    Bit k of a set says that k tokens can be filled. The sets after each size are kept for the way back.
    """
    if gap <= 0:
        return []
    mask, reach, trail = (1 << (gap + 1)) - 1, 1, []
    for size in sizes:
        if size > gap or not counts.get(size):
            continue
        before, copies, power = reach, min(counts[size], gap // size), 1
        left = copies
        while left:  # bounded copies by powers of two
            take = min(power, left)
            reach |= (reach << (size * take)) & mask
            left -= take
            power *= 2
        trail.append((size, before))
        if reach >> gap & 1:
            break
    here, chosen = reach.bit_length() - 1, []
    for size, before in reversed(trail):
        while not before >> here & 1:
            chosen.append(size)
            here -= size
    return chosen


def plan(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, dict[int, int]]]:
    """(capacity, repetitions, {size: copies}) of all bins. Sizes are at most the largest capacity."""
    permitted, left = sorted(capacities), {s: n for s, n in histogram.items() if n > 0}
    sizes, out = sorted(left, reverse=True), []
    while sizes:
        if not left.get(sizes[0]):
            sizes.pop(0)
            continue
        if len(sizes) > 64 and sum(1 for s in sizes if left.get(s)) < len(sizes) // 2:
            sizes = [s for s in sizes if left.get(s)]
        largest = sizes[0]
        left[largest] -= 1
        best = None
        for capacity in permitted:
            if capacity >= largest:
                filling = best_filling(capacity - largest, left, sizes)
                cost = capacity / (largest + sum(filling))
                if best is None or cost < best[0]:
                    best = (cost, capacity, filling)
        left[largest] += 1
        need: dict[int, int] = defaultdict(int)
        for size in [largest, *best[2]]:
            need[size] += 1
        times = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= times * k
        held = sum(s * k for s, k in need.items())
        out.append((min(c for c in permitted if c >= held), times, dict(need)))
    return out


def pack(items: DataFrame, key: str, size: str, capacities: DataFrame, joint: bool = False) -> DataFrame:
    """(container_kind, container_id, key, piece_no int, start_token int, n_tokens int, capacity int).

    ``capacities`` has container_kind and capacity_tokens. Each kind takes all items on its own; with
    ``joint`` all capacities are permitted in one packing, and container_kind names the kind that a bin ended
    up as. Items are read twice, so they are cut from their lineage first.
    """
    spark = items.sparkSession
    sized = cut(items.select(F.col(key), F.col(size).cast("int").alias("n")).where(F.col(size) > 0))
    kinds = [(r[0], int(r[1])) for r in capacities.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().orderBy("capacity_tokens", "container_kind").collect()]
    if not kinds:
        return sized.select(F.lit("").alias("container_kind"), F.lit("").alias("container_id"), key, *(F.lit(0).alias(c) for c in ("piece_no", "start_token", "n_tokens", "capacity"))).where("false")
    groups = [("", [c for _, c in kinds], max(c for _, c in kinds))] if joint else [(kind, [c], c) for kind, c in kinds]
    named = {c: kind for kind, c in reversed(kinds)}

    cutting = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(top).alias("top")) for g, (_, _, top) in enumerate(groups)))
    split = sized.select(key, "n", F.inline(cutting)).select(
        key, "g", "top", F.when(F.col("n") <= F.col("top"), 0).otherwise((F.col("n") / F.col("top")).cast("int")).alias("full"), "n"
    )
    rest = split.withColumn("rest", F.col("n") - F.col("full") * F.col("top"))

    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    total = 0
    for g, s, n in rest.where("rest > 0").groupBy("g", "rest").count().collect():  # at most the capacities' sum
        histogram[g][s] = n
        total = max(total, n)
    salts = max(1, -(-total // GROUP_ITEMS))

    # For each (group, size): first rank, copies in a bin, number of the first bin, capacity, of each pattern.
    slots: dict[tuple[int, int], list[list[int]]] = defaultdict(lambda: [[], [], [], []])
    for g, (_, permitted, _) in enumerate(groups):
        used: dict[int, int] = defaultdict(int)
        first = 0
        for capacity, times, need in plan(histogram[g], permitted):
            for s, k in need.items():
                for column, value in zip(slots[g, s], (used[s], k, first, capacity)):
                    column.append(value)
                used[s] += times * k
            first += times
    shared = spark.sparkContext.broadcast({k: [np.array(c, dtype=np.int64) for c in v] for k, v in slots.items()})

    salted = rest.where("rest > 0").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    before = Window.partitionBy("g", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy("g", "rest", "salt").count().select("g", "rest", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    ranked = salted.withColumn("at", F.row_number().over(Window.partitionBy("g", "rest", "salt").orderBy(key)) - 1)
    ranked = ranked.join(shifts, ["g", "rest", "salt"]) if salts > 1 else ranked.withColumn("shift", F.lit(0))
    placed = ranked.select(key, "g", "full", "top", F.col("rest").alias("size"), (F.col("at") + F.col("shift")).cast("long").alias("rank"))

    kind = dict(items.dtypes)[key]
    names = [key, "g", "piece_no", "start_token", "n_tokens", "bin", "capacity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            g, full, top, n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 6))
            bins, held = np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int32)
            order = np.lexsort((n, g))
            edges = np.flatnonzero(np.diff(g[order]) | np.diff(n[order])) + 1
            for rows in np.split(order, edges) if len(order) else []:
                starts, copies, firsts, capacity = table[int(g[rows[0]]), int(n[rows[0]])]
                at = np.searchsorted(starts, rank[rows], side="right") - 1
                bins[rows] = firsts[at] + (rank[rows] - starts[at]) // copies[at]
                held[rows] = capacity[at]
            columns = [batch.column(0), pa.array(g), pa.array((full + 1).astype(np.int32)), pa.array((full * top).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(bins), pa.array(held)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rests = placed.mapInArrow(run, f"`{key}` {kind}, g int, piece_no int, start_token int, n_tokens int, bin long, capacity int")
    fulls = split.where("full > 0").select(key, "g", "top", F.posexplode(F.sequence(F.lit(0), F.col("full") - 1)).alias("pos", "no"))
    name = F.element_at(F.create_map(*(F.lit(x) for pair in named.items() for x in pair)), F.col("capacity")) if joint else F.element_at(F.array(*(F.lit(x[0]) for x in groups)), F.col("g") + 1)
    rests = rests.select(name.alias("container_kind"), F.concat(F.lit("bin-"), F.col("bin").cast("string")).alias("container_id"), key, "piece_no", "start_token", "n_tokens", "capacity")
    fulls = fulls.withColumn("capacity", F.col("top")).select(
        name.alias("container_kind"), F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("no").cast("string")).alias("container_id"), key,
        (F.col("no") + 1).alias("piece_no"), (F.col("no") * F.col("top")).alias("start_token"), F.col("top").alias("n_tokens"), "capacity",
    )
    return rests.unionByName(fulls)


def unused_room(packed: DataFrame) -> DataFrame:
    """(container_kind, n_containers, held_tokens, unused_tokens) of a packing."""
    bins = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("held"), F.first("capacity").alias("capacity"))
    return bins.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("held").alias("held_tokens"), F.sum(F.col("capacity") - F.col("held")).alias("unused_tokens"))
