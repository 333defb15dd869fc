"""Sample windows, ranges and the clipping of polylines to rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import round_half_away

EPS = 1e-12


def sample_window(first: Column, last: Column, n: Column) -> Column:
    """struct<first, last>: an inclusive window clamped to n samples; null if it is reversed or lies outside."""
    a, b = F.greatest(first, F.lit(0)), F.least(last, n - 1)
    return F.when((first <= last) & (a <= b) & (n > 0), F.struct(a.alias("first"), b.alias("last")))


def time_window(lo_ms: Column, hi_ms: Column, interval_us: Column, n: Column) -> Column:
    """struct<first, last> of a time range in ms, ends in either order, rounded to the nearest samples; null if one sample or none is left."""
    dt = interval_us / F.lit(1000.0)
    at = lambda ms: round_half_away(ms / dt)
    a, b = F.greatest(at(F.least(lo_ms, hi_ms)), F.lit(0)), F.least(at(F.greatest(lo_ms, hi_ms)), n - 1)
    return F.when((interval_us > 0) & (b > a), F.struct(a.alias("first"), b.alias("last")))


def number_range(first: Column, last: Column, n: Column) -> Column:
    """struct<first, last> from 0 of sample numbers from 1, swapped if reversed, clamped."""
    c = lambda v: F.least(F.greatest(v - 1, F.lit(0)), n - 1)
    return F.struct(c(F.least(first, last)).alias("first"), c(F.greatest(first, last)).alias("last"))


def stride(df: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """Every step-th trace of a range, ends included."""
    return df.where(F.col("trace_number").between(first, last) & ((F.col("trace_number") - first) % max(step, 1) == 0))


def line_range(df: DataFrame, value: str, lo: float, hi: float, group: str) -> DataFrame:
    """The rows of each group inside the range; a group of which fewer than two rows are inside stays whole."""
    inside = F.col(value).between(min(lo, hi), max(lo, hi))
    return df.withColumn("_in", inside).withColumn("_n", F.count_if("_in").over(Window.partitionBy(group))).where("_n < 2 OR _in").drop("_in", "_n")


def normal_range(lo: Column, hi: Column) -> Column:
    """struct<lo, hi>, ends ordered; null, meaning everything, if they are equal or missing."""
    return F.when(lo != hi, F.struct(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")))


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, box: tuple[float, float, float, float]) -> Column:
    """struct<t0, t1>: the part of the segment from a to b inside the closed box (x0, x1, y0, y1), as fractions of its length; null if outside.

    Each of the four half planes bounds t from below or above, so the part is the largest lower to the smallest upper bound.
    """
    x0, x1, y0, y1 = box
    dx, dy = bx - ax, by - ay
    lows, highs, misses = [F.lit(0.0)], [F.lit(1.0)], []
    for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
        flat = F.abs(p) <= 1e-15
        lows.append(F.when(~flat & (p < 0), q / p).otherwise(F.lit(0.0)))
        highs.append(F.when(~flat & (p > 0), q / p).otherwise(F.lit(1.0)))
        misses.append(flat & (q < 0))
    t0, t1 = F.greatest(*lows), F.least(*highs)
    missed = misses[0] | misses[1] | misses[2] | misses[3]
    return F.when(~missed & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def segments(line: DataFrame) -> DataFrame:
    """(line, i, trace_a, trace_b, ax, ay, bx, by, da, db): consecutive places of each line, i from 1."""
    w = Window.partitionBy("line").orderBy("trace")
    lag = lambda c: F.lag(c).over(w)
    return line.select("line", (F.row_number().over(w) - 1).alias("i"), lag("trace").alias("trace_a"), F.col("trace").alias("trace_b"), lag("x").alias("ax"), lag("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"), lag("distance").alias("da"), F.col("distance").alias("db")).where("i > 0")


def lines_in_range(line: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(line, touches): whether any segment of the line meets the box."""
    return segments(line).groupBy("line").agg(F.bool_or(clip_segment(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), box).isNotNull()).alias("touches"))


def clip_runs(line: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(line, run, start, end, first_support, last_support, vertices): the stretches of each line (line, trace, x, y, distance) inside the box.

    start and end are distances at the exact border; the supports are the traces next to them, at most
    one outside on either side. A line that leaves and comes back has several runs, numbered from 0.
    """
    t = clip_segment(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), box)
    cut = segments(line).withColumn("t", t).where(F.col("t").isNotNull() & (F.col("t.t1") - F.col("t.t0") > EPS))
    at = lambda k: F.col("da") + (F.col("db") - F.col("da")) * F.col(f"t.{k}")
    cut = cut.withColumns({"s": at("t0"), "e": at("t1"), "left": F.col("t.t1") < 1 - EPS})
    w = Window.partitionBy("line").orderBy("i")
    # a new run where the segment before was outside, was left early, or ends elsewhere
    fresh = F.coalesce((F.lag("i").over(w) != F.col("i") - 1) | F.lag("left").over(w) | (F.abs(F.lag("e").over(w) - F.col("s")) > 1e-9), F.lit(True))
    numbered = cut.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    runs = numbered.groupBy("line", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.min("trace_a").alias("first_support"), F.max("trace_b").alias("last_support"), (F.count(F.lit(1)) + 1).alias("vertices")).where(F.col("end") - F.col("start") > EPS)
    return runs.select("line", (F.row_number().over(Window.partitionBy("line").orderBy("start", "run")) - 1).alias("run"), "start", "end", "first_support", "last_support", "vertices")


def support_traces(line: DataFrame, runs: DataFrame) -> DataFrame:
    """(line, trace): the traces that the runs need, each once."""
    return line.select("line", "trace").join(runs.select("line", "first_support", "last_support"), "line").where("trace BETWEEN first_support AND last_support").select("line", "trace").distinct()


def export_plan(line: DataFrame, runs: DataFrame, window: Column, sample_bytes: int = 4, header_bytes: int = 3600) -> DataFrame:
    """(line, traces, samples, bytes): size of the cropped file of each line that has something to export."""
    n = F.col("w.last") - F.col("w.first") + 1
    per_line = support_traces(line, runs).groupBy("line").agg(F.count(F.lit(1)).alias("traces")).withColumn("w", window).where("w IS NOT NULL")
    return per_line.select("line", "traces", n.alias("samples"), (F.lit(header_bytes) + F.col("traces") * (240 + n * sample_bytes)).alias("bytes"))


def even_indices(n: Column, k: int, truncate: bool = False) -> Column:
    """array<int>: at most k indices from 0 to n - 1, evenly spread, both ends kept, each once; rounded, or truncated."""
    step = lambda i: i * (n - 1) / F.lit(float(max(k - 1, 1)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.floor(step(i)) if truncate else F.round(step(i))).cast("int"))
    return F.array_distinct(F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(spread))


def decimate(line: DataFrame, k: int, truncate: bool = False) -> DataFrame:
    """(line, trace): at most k traces of each line, evenly spread by their order, ends kept."""
    w = Window.partitionBy("line")
    ranked = line.select("line", "trace", (F.row_number().over(w.orderBy("trace")) - 1).alias("r"))
    wanted = ranked.groupBy("line").agg(F.count(F.lit(1)).alias("n")).select("line", F.explode(even_indices(F.col("n"), k, truncate)).alias("r"))
    return ranked.join(wanted, ["line", "r"]).select("line", "trace")


def safe_names(df: DataFrame, name: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """(name, output): file names free of unsafe signs and, ignoring case, each once and none of the reserved ones.

    A name stands as it is if it is the only one of its kind. Others carry eight hex digits of their
    SHA-256 before the extension, and all of them where even that isn't unique, so a name's output
    doesn't depend on the order of the table. Equal names are one; null ones are left out.
    """
    clean = F.regexp_replace(F.trim(F.col(name)), r"[^\p{L}\p{N}._-]+", "_")
    clean = F.regexp_replace(clean, r"\.+$", "")
    clean = F.when((clean == "") | F.upper(F.regexp_replace(clean, r"\..*$", "")).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("line_"), clean)).otherwise(clean)
    sha, ext = F.sha2(F.col("name"), 256), F.regexp_extract("c", r"(\.[^.]*)$", 1)
    marked = lambda mark: F.concat(F.expr("substr(c, 1, length(c) - length(e))"), F.lit("_"), mark, F.col("e"))
    of = lambda c: Window.partitionBy(F.lower(c))
    names = df.select(F.col(name).alias("name"), clean.alias("c")).where("name IS NOT NULL").distinct().withColumn("e", ext)
    taken = F.lower("c").isin([r.lower() for r in reserved]) if reserved else F.lit(False)
    once = names.withColumn("o", F.when((F.count(F.lit(1)).over(of("c")) == 1) & ~taken, F.col("c")).otherwise(marked(F.substring(sha, 1, 8))))
    return once.select("name", F.when(F.count(F.lit(1)).over(of("o")) == 1, F.col("o")).otherwise(marked(sha)).alias("output"))
