"""Items of varying length into containers of a fixed capacity, planned on the histogram of lengths.

Best fit, longest first, runs over the counts of each length, so the plan's size depends on the
capacity and never on the number of items. The items then take the planned slots by their rank
within their length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.runtime import durable

#: Parts that the items of one length are ranked in, so that a frequent length isn't one task.
RANK_PARTS = 256
#: Items of a slot that one task writes out at most.
SLOT_RUN = 1 << 18
_SLOTS = "budget_id int, len bigint, rank_lo bigint, n bigint, first_container bigint, per_container bigint"


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over counts: ([(length, first rank, items, first container, items per container)], containers).

    Lengths must be in 1..capacity. The items of one slot run, in rank order, fill consecutive
    containers with `items per container` each (the last one perhaps with fewer).
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> [(first container, containers)]
    spaces: list[int] = []  # sorted keys of free
    opened, slots = 0, []

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                bisect.insort(spaces, space)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = space // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, full * each, first, each))
                rank, left = rank + full * each, left - full * each
                put(space - each * length, first, full)
            if left and full < count:  # fewer than `each` items are left: one container takes them
                slots.append((length, rank, left, first + full, left))
                put(space - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(space, first + full, count - full)
    return slots, opened


def pack(sizes: DataFrame, budgets: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(budget_id, id_col, piece_no, start_token, n_tokens, container_id): the container of each item or piece, per budget.

    An item within the capacity stays whole; one beyond it is cut into full containers and a rest.
    Containers are numbered from 0 for each budget. An item of size 0 or null needs no space and is
    put into container 0. Rows of the same id are items of their own. Budgets without a positive
    capacity are skipped; of a repeated budget the largest capacity holds. `sizes` is read more than once: pass a written or checkpointed table.
    """
    known = budgets.where("capacity_tokens > 0 and budget_id is not null").groupBy("budget_id").agg(F.max("capacity_tokens").cast("bigint").alias("cap")).collect()  # a few rows
    if not known:
        kind = dict(sizes.dtypes)[id_col]
        return sizes.sparkSession.createDataFrame([], f"budget_id int, `{id_col}` {kind}, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint")
    budget = F.explode(F.array(*(F.struct(F.lit(int(b)).cast("int").alias("budget_id"), F.lit(int(cap)).cast("bigint").alias("cap")) for b, cap in known)))
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    items = sizes.select(F.col(id_col), size.alias("size"), budget.alias("b")).select(id_col, "size", "b.*")
    pieces = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / F.col("cap"))))))
    pieces = pieces.withColumn("start_token", F.col("piece_no") * F.col("cap")).withColumn("len", F.least("cap", F.col("size") - F.col("start_token")))
    pieces = pieces.select("budget_id", id_col, "piece_no", "start_token", "len")

    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for b, n, c in pieces.where("len > 0").groupBy("budget_id", "len").count().collect():  # at most the sum of the capacities
        histogram[b][n] = c
    rows = []
    for b, cap in known:
        for length, rank, n, first, each in plan_slots(histogram[b], int(cap))[0]:
            run = max(each, SLOT_RUN // each * each)  # a long slot is written out by several tasks
            rows += [(b, length, rank + k, min(run, n - k), first + k // each, each) for k in range(0, n, run)]
    spark = sizes.sparkSession
    slots = (
        spark.createDataFrame(rows, _SLOTS)
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        .select("budget_id", "len", (F.col("rank_lo") + F.col("k")).alias("rank"), (F.col("first_container") + F.floor(F.col("k") / F.col("per_container"))).alias("container_id"))
    )
    sized = pieces.where("len > 0").withColumn("part", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(RANK_PARTS)).cast("int"))
    before = Window.partitionBy("budget_id", "len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("budget_id", "len", "part").count().select("budget_id", "len", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("budget_id", "len", "part").orderBy(id_col, "piece_no")
    ranked = sized.withColumn("r", F.row_number().over(within)).join(offsets, ["budget_id", "len", "part"]).withColumn("rank", F.col("offset") + F.col("r") - 1)
    placed = ranked.join(slots, ["budget_id", "len", "rank"])
    columns = lambda df: df.select("budget_id", id_col, "piece_no", "start_token", F.col("len").alias("n_tokens"), "container_id")
    return columns(placed).unionByName(columns(pieces.where("len = 0").withColumn("container_id", F.lit(0).cast("bigint"))))


def pack_counted(counted: DataFrame, budgets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pack() of freshly counted sizes, which are checkpointed first, as counting is the costly part."""
    return pack(durable(counted), budgets, id_col)
