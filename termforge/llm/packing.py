"""Filling containers of fixed capacity with items by multiway differencing.

What an item has above capacity fills containers by itself, which are numbered by running sums. The rests and all other
items are dealt to groups of about WINDOWS containers by a hash; each group is packed by itself by the Karmarkar-Karp
method: the two partial partitions with the largest imbalance are merged, the fullest window of one with the emptiest of
the other, until one partition is left. If its fullest window is over capacity, the number of windows rises and it
starts again. Items that are tiny beside the capacity are bundled first, so that a group's work is bounded by its
containers, however many items it has. Only the sizes are shuffled.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.operators.numbering import running
from termforge.session import stored

#: Containers that a group fills; the last of them is left partly empty, so more of them waste less.
WINDOWS = 192
#: Containers of one group have numbers from group * GROUP_STEP on; a group has fewer rows than that.
GROUP_STEP = 1 << 32
#: Items below that part of the capacity are bundled up to that size.
TINY = 64
#: Items that a task packs, as far as there are groups to share out.
TASK_ITEMS = 200_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, of each item, such that the windows' sums are nearly equal."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # a node is a partial partition: its sums in ascending order; merges[i] tells how node n + i was made
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def take() -> tuple[int, np.ndarray]:
        _, node = heapq.heappop(heap)
        if node >= n:
            return node, sums.pop(node)
        one = np.zeros(k, np.int64)
        one[-1] = sizes[node]
        return node, one

    while len(heap) > 1:
        (a, x), (b, y) = take(), take()
        both = x + y[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        both -= both[0]  # only differences matter from here on
        merges.append((a, b, order))
        node = n + len(merges) - 1
        sums[node] = both
        heapq.heappush(heap, (-int(both[-1]), node))
    at: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)} if heap else {}
    out = np.zeros(n, np.int64)
    if n == 1:
        return out
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        own = at.pop(n + i)
        for child, slots in ((a, order), (b, k - 1 - order)):
            where = np.empty(k, np.int64)
            where[slots] = own
            if child >= n:
                at[child] = where
            else:
                out[child] = where[-1]
    return out


def bundles(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bundle of each item, numbers from 0: tiny items together up to twice capacity / TINY, any other by itself."""
    least = max(1, capacity // TINY)
    tiny = sizes < least
    own = np.cumsum(np.where(tiny, sizes, 0)) // least
    _, bundle = np.unique(own[tiny], return_inverse=True)
    out = np.empty(len(sizes), np.int64)
    out[tiny] = bundle
    out[~tiny] = (bundle.max() + 1 if len(bundle) else 0) + np.arange((~tiny).sum())
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; no item is above capacity."""
    total = int(sizes.sum())
    # two items above half of the capacity can't share a container
    k = max(1, -(-total // capacity), int((sizes * 2 > capacity).sum()))
    while True:
        where = differencing(sizes, k)
        if np.bincount(where, sizes, minlength=k).max() <= capacity:
            return where
        k += 1


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, windows: int = WINDOWS) -> DataFrame:
    """(container, id, start, size): every item with a size above 0 in one container, or, above capacity, in several.

    An item above capacity fills containers by itself as often as it can, and its rest is packed like any other item;
    start is where in the item a piece begins. Container numbers are unique, but not without gaps. Sizes that are null,
    0 or negative are left out. Repeated rows are items of their own, a null id is kept; an empty table gives an empty
    result; extra columns are ignored.
    """
    sizes = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(size_col).cast("bigint").alias("size")).where(F.col("size") > 0)
    sizes = stored(sizes, "sizes")
    rest = F.col("size") % capacity
    total, number, whole = sizes.agg(F.sum(rest), F.count_if(rest > 0), F.sum(F.expr(f"size div {capacity}"))).first()
    groups = max(1, -(-(total or 0) // (capacity * windows)))
    tasks = min(groups, max(sizes.sparkSession.sparkContext.defaultParallelism, -(-number // TASK_ITEMS)))
    # the salt spreads repeated rows of one id
    grouped = sizes.where(rest > 0).withColumn("grp", F.pmod(F.xxhash64("id", "size", F.monotonically_increasing_id()), F.lit(groups)))
    schema = pa.schema([("container", pa.int64()), (id_col, pa.int64()), ("start", pa.int64()), (size_col, pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("id", "ascending")]).combine_chunks()
        size = table.column("size").to_numpy()
        left = size % capacity
        bundle = bundles(left, capacity)
        where = pack_group(np.bincount(bundle, left).astype(np.int64), capacity)[bundle]
        container = where + table.column("grp")[0].as_py() * GROUP_STEP
        return pa.table([pa.array(container), table.column("id"), pa.array(size - left), pa.array(left)], schema=schema)

    packed = grouped.repartition(tasks, "grp").groupBy("grp").applyInArrow(run, f"container bigint, `{id_col}` bigint, start bigint, `{size_col}` bigint")
    if not whole:
        return packed
    large = running(sizes.where(F.col("size") >= capacity).withColumn("full", F.expr(f"size div {capacity}")), ["id", "size"], {"first": "full"})
    each = large.select("id", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("k"))
    # the numbers of whole containers end below 0
    full = each.select((F.col("first") + F.col("k") - F.lit(whole)).alias("container"), F.col("id").alias(id_col), (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias(size_col))
    return packed.unionByName(full)
