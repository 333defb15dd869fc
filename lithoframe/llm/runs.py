"""Runs of near-identical consecutive events, collapsed by adjacent agglomeration.

Every entity's ordered events form a linked list; neighbouring runs that are similar enough are
merged, most similar first, from a priority queue, until none meets the limits. An entity may hold
any share of the rows, and its order values may be as sparse as time stamps: all rows are parted by
counted ranges of (entity, order), a task agglomerates its rows in chunks of bounded length, handing
the last run of each on to the next, and only the first and the last run of a task are stitched to
those of its neighbours. Between facing ends the result doesn't depend on where the cuts are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.runtime import finite

#: Events that one agglomeration holds in memory.
CHUNK = 4096
_OUT = "grp string, part int, edge boolean, n bigint, first_ord bigint, last_ord bigint, hx double, hy double, tx double, ty double, t0 bigint, t1 bigint"


def agglomerate(order: np.ndarray, x: np.ndarray, y: np.ndarray, max_distance: float, max_gap: float = math.inf, between: str = "ends", weight: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index ranges (first, last) of the runs of one ordered sequence, single events included.

    Two neighbouring runs may merge if they are at most `max_distance` apart and the order values of
    their facing ends differ by at most `max_gap`. The distance is that of the facing ends, or of the
    runs' means (between="means"), which move with every merge. The queue holds (distance, left run,
    right run, age of either); a merge ages the surviving run, so entries made before it are stale and
    skipped. weight tells how many events each item stands for.
    """
    n = len(x)
    if n == 0:
        return []
    means = between == "means"
    cx, cy, w = x.tolist(), y.tolist(), [1.0] * n if weight is None else weight.tolist()
    last = list(range(n))  # of the run that starts here
    right = list(range(1, n + 1))  # linked list over the starts of runs
    left = list(range(-1, n - 1))
    age = [0] * n
    with np.errstate(invalid="ignore", over="ignore"):
        step = np.hypot(np.diff(x), np.diff(y))
        near = np.flatnonzero((step <= max_distance) & (np.diff(order) <= max_gap))

    def apart(a: int, b: int) -> float:
        return math.hypot(cx[b] - cx[a], cy[b] - cy[a]) if means else float(step[b - 1])

    def offer(a: int, b: int) -> None:
        if (d := apart(a, b)) <= max_distance and order[b] - order[b - 1] <= max_gap:
            heapq.heappush(queue, (d, a, b, age[a], age[b]))

    queue = [(float(step[i]), int(i), int(i) + 1, 0, 0) for i in near]
    heapq.heapify(queue)
    while queue:
        _, a, b, age_a, age_b = heapq.heappop(queue)
        if age[a] != age_a or age[b] != age_b:
            continue
        last[a], right[a] = last[b], right[b]
        total = w[a] + w[b]
        cx[a], cy[a], w[a] = cx[a] + (cx[b] - cx[a]) * (w[b] / total), cy[a] + (cy[b] - cy[a]) * (w[b] / total), total
        age[a] += 1
        age[b] = -1
        if right[a] < n:
            left[right[a]] = a
            offer(a, right[a])
        if left[a] >= 0:
            offer(left[a], a)
    runs, i = [], 0
    while i < n:
        runs.append((i, last[i]))
        i = right[i]
    return runs


class _Sequence:
    """The runs of one task's sorted rows. The latest run is held open, as the next rows may belong to it."""

    def __init__(self, max_distance: float, max_gap: float, between: str, least: int) -> None:
        self.limits, self.between, self.least, self.part = (max_distance, max_gap), between, least, TaskContext.get().partitionId()
        self.open: tuple | None = None  # (group, n, first order, last order, head x, y, tail x, y, first and last time, at the task's start)
        self.done: list[tuple] = []
        self.begun = False

    def _close(self, run: tuple, at_end: bool) -> None:
        grp, n, *rest, at_start = run
        if n >= self.least or at_start or at_end:
            self.done.append((grp, self.part, at_start or at_end, n, *rest))

    def add(self, grp: str, order: np.ndarray, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> None:
        """Rows of one group that follow those added before."""
        held = self.open if self.open and self.open[0] == grp else None
        if self.open and not held:
            self._close(self.open, False)
        k = 1 if held else 0
        if held:
            order, x, y = np.r_[held[3], order], np.r_[held[6], x], np.r_[held[7], y]
        weight = np.ones(len(x))
        if held:
            weight[0] = held[1]
        runs = []
        for a, b in agglomerate(order, x, y, *self.limits, self.between, weight):
            starts = held is not None and a == 0
            n, first = (held[1], held[2]) if starts else (1, int(order[a]))
            head, t0 = ((held[4], held[5]), held[8]) if starts else ((x[a], y[a]), t[a - k])
            tail, t1 = ((held[6], held[7]), held[9]) if starts and b == 0 else ((x[b], y[b]), t[b - k])
            if self.between == "means":
                w = weight[a : b + 1]
                head = tail = (float((x[a : b + 1] * w).sum() / w.sum()), float((y[a : b + 1] * w).sum() / w.sum()))
            runs.append((grp, n + b - a, first, int(order[b]), *head, *tail, t0, t1, held[10] if starts else not self.begun))
            self.begun = True
        for run in runs[:-1]:
            self._close(run, False)
        self.open = runs[-1]

    def flush(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        if end and self.open:
            self._close(self.open, True)
            self.open = None
        if self.done:
            names = [c.split()[0] for c in _OUT.split(", ")]
            kinds = [pa.string(), pa.int32(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 4, *[pa.int64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*self.done), kinds)], names=names)
            self.done = []


def collapse_runs(
    df: DataFrame, group: str, order: str, x: str, y: str, time: str, valid: str | None = None, max_distance: float = 1.0, max_gap: float | None = None, min_events: int = 2, chunk: int = CHUNK, between: str = "ends", parts: int | None = None
) -> DataFrame:
    """One row per run: (grp, first_ord, last_ord, n, duration_s) with n >= min_events.

    Events whose group, order or `valid` is null (or not true) are skipped, as are positions that
    aren't finite; they don't interrupt a run. Copies of an event (same group and order) count once;
    if they disagree, the smallest position (by x, then y) and the earliest time stand. max_gap limits
    the difference of order values within a run (None: no limit). duration_s is null without times.

    between="ends" merges by the distance of facing ends. between="means" merges by that of the runs'
    means: the most similar first within chunks of `chunk` events, then across their borders. parts is
    the number of ranges the rows are cut into (None: the session's shuffle partitions).
    """
    if between not in ("ends", "means"):
        raise ValueError(f"between is ends or means, not {between}")
    gap = math.inf if max_gap is None else float(max_gap)
    keep = F.col(group).isNotNull() & F.col(order).isNotNull() & finite(F.col(x)) & finite(F.col(y))
    if valid:
        keep = keep & F.col(valid)
    place = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    once = (
        df.where(keep)
        .groupBy(F.col(group).cast("string").alias("grp"), F.col(order).cast("bigint").alias("ord"))
        .agg(F.min(place).alias("p"), F.min(F.unix_micros(F.col(time).cast("timestamp"))).alias("t"))
        .select("grp", "ord", "p.x", "p.y", "t")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Sequence(max_distance, gap, between, min_events)
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column(0).dictionary_encode()
            order_, x_, y_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            t_ = batch.column(4).to_pylist()
            codes, names = grp.indices.to_numpy(zero_copy_only=False), grp.dictionary.to_pylist()
            cuts = sorted({0, len(codes), *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), *range(0, len(codes), chunk)})
            for a, b in zip(cuts, cuts[1:]):
                rows.add(names[codes[a]], order_[a:b], x_[a:b], y_[a:b], t_[a:b])
            yield from rows.flush()
        yield from rows.flush(end=True)

    ranged = once.repartitionByRange(parts, "grp", "ord") if parts else once.repartitionByRange("grp", "ord")
    runs = ranged.sortWithinPartitions("grp", "ord").mapInArrow(work, _OUT)
    # Runs between the first and the last of a task are final: a window of their task alone keeps them out of the stitching.
    at = F.when(~F.col("edge"), F.col("part"))
    seq = Window.partitionBy("grp", "at").orderBy("first_ord")
    before = lambda c: F.lag(c).over(seq)
    dx, dy = F.col("hx") - before("tx"), F.col("hy") - before("ty")
    linked = (before("part") != F.col("part")) & (F.sqrt(dx * dx + dy * dy) <= max_distance)
    if max_gap is not None:
        linked = linked & (F.col("first_ord") - before("last_ord") <= max_gap)
    return (
        runs.withColumn("at", at)
        .withColumn("starts", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
        .withColumn("island", F.sum("starts").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("grp", "at", "island")
        .agg(F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"), F.sum("n").alias("n"), F.min_by("t0", "first_ord").alias("t0"), F.max_by("t1", "last_ord").alias("t1"))
        .where(F.col("n") >= min_events)
        .select("grp", "first_ord", "last_ord", "n", ((F.col("t1") - F.col("t0")) / F.lit(1e6)).alias("duration_s"))
    )
