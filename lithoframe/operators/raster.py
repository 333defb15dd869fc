"""Slices and rasters of samples, their value ranges and palette indices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import is_finite
from lithoframe.operators.gathers import with_flags
from lithoframe.operators.ordering import accumulated, numbered


def nearest_index(i: Column, width: int, n: Column) -> Column:
    """Source index of output index i, rounded: both ends meet."""
    return F.round(i * (n - 1) / F.lit(float(max(width - 1, 1)))).cast("int") if width > 1 else F.lit(0)


def clean(v: Column) -> Column:
    """Non-finite values of a raster are 0, and count in its own range."""
    return F.when(is_finite(v), v).otherwise(F.lit(0.0))


def nearest_raster(df: DataFrame, width: int, height: int, order: str = "trace", samples: str = "samples") -> DataFrame:
    """(px, py, value): traces in order as columns, samples as rows, each pixel its nearest sample.

    Only traces that a column shows are kept before their samples are touched; they are numbered by
    counting, not by one sort of all.
    """
    ranked = _ranked(df, order)
    n = ranked.agg((F.max("r") + 1).alias("n"))
    columns = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px")).select("px", nearest_index(F.col("px"), width, F.col("n")).cast("bigint").alias("r"))
    shown = columns.join(ranked, "r").join(df.select(order, samples), order)
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.struct(y.alias("py"), F.try_element_at(F.col(samples), nearest_index(y, height, F.size(samples)) + 1).alias("v")))
    return shown.select("px", F.explode(rows).alias("c")).select("px", "c.py", clean(F.col("c.v")).alias("value"))


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """(r, order): rank of each trace. Samples aren't touched; what is shown is joined to them afterwards."""
    return numbered(df.select(order), [order], "r")


def bilinear(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """The grid (samples x traces) resampled with its ends met; non-finite values are 0."""
    g = np.where(np.isfinite(grid), grid, 0.0)
    y, x = (np.linspace(0, n - 1, m) if m > 1 else np.zeros(1) for n, m in ((g.shape[0], height), (g.shape[1], width)))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return g[np.ix_(y0, x0)] * (1 - fy) * (1 - fx) + g[np.ix_(y0, x1)] * (1 - fy) * fx + g[np.ix_(y1, x0)] * fy * (1 - fx) + g[np.ix_(y1, x1)] * fy * fx


def _down(lists: pa.Array, height: int) -> np.ndarray:
    """Traces (rows) resampled to a height, those of one length at a time; values that aren't finite are 0, a trace without samples is 0."""
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    flat, starts, out = np.where(np.isfinite(flat), flat, 0.0), np.r_[0, np.cumsum(n)[:-1]], np.zeros((len(n), height))
    for k in np.unique(n[n > 0]):
        at = np.flatnonzero(n == k)
        y = np.linspace(0, k - 1, height) if height > 1 else np.zeros(1)
        y0 = np.floor(y).astype(int)
        block, fy = flat[starts[at][:, None] + np.arange(k)], y - y0
        out[at] = block[:, y0] * (1 - fy) + block[:, np.minimum(y0 + 1, k - 1)] * fy
    return out


def bilinear_raster(df: DataFrame, width: int, height: int, order: str = "trace", samples: str = "samples") -> DataFrame:
    """(px, py, value): a smooth raster. Each output column mixes the two traces around it, so columns are made apart, each from two traces."""
    ranked = _ranked(df, order)
    n = ranked.agg((F.max("r") + 1).alias("n")).where("n > 0")
    at = F.col("px") * (F.col("n") - 1) / F.lit(float(max(width - 1, 1)))
    columns = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px")).select("px", F.floor(at).cast("bigint").alias("l"), F.least(F.floor(at) + 1, F.col("n") - 1).cast("bigint").alias("h"), (at - F.floor(at)).alias("f"))
    at_rank = lambda k: ranked.select(F.col("r").alias(k), F.col(order).alias(f"t{k}"))
    with_samples = lambda k: df.select(F.col(order).alias(f"t{k}"), F.col(samples).alias(f"s{k}"))
    met = columns.join(at_rank("l"), "l").join(at_rank("h"), "h").join(with_samples("l"), "tl").join(with_samples("h"), "th").select("px", "f", "sl", "sh")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            left, right = (_down(batch.column(k), height) for k in (2, 3))
            value = left * (1 - f[:, None]) + right * f[:, None]
            cols = (np.repeat(px, height).astype(np.int32), np.tile(np.arange(height, dtype=np.int32), len(px)), value.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["px", "py", "value"])

    return met.mapInArrow(work, "px int, py int, value double")


def order_range(df: DataFrame, value: str, gain: float) -> DataFrame:
    """One row (lo, hi): order statistics that cut gain percent off either end, without interpolation; gain is held in 0..49.

    Distinct values are counted, then placed by ranges of the values themselves, so heavy tails don't
    crowd one range; a range's values are summed within it, the ranges' sums among each other.
    """
    g = min(max(gain, 0.0), 49.0)
    v = df.where(is_finite(value)).select(F.col(value).cast("double").alias("v"))
    if g == 0:
        return v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    counted = v.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked = accumulated(counted, ["v"], "n", "upto")
    ranked = with_flags(ranked, ranked.agg(F.max("upto").alias("t")))
    # the k-th order statistic is the smallest value that more than k values don't exceed
    k = lambda p: F.least(F.floor(F.col("t") * F.lit(p) / 100), F.col("t") - 1)
    return ranked.agg(F.min(F.when(F.col("upto") > k(g), F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") > k(100 - g), F.col("v"))).alias("hi"))


def palette(df: DataFrame, value: str, range_: DataFrame) -> DataFrame:
    """Adds idx: 0 for the range's top, 255 for its bottom; a range without extent is one wide."""
    hi = F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1)
    idx = F.round((hi - F.col(value)) / (hi - F.col("lo")) * 255)
    return with_flags(df, range_).withColumn("idx", F.greatest(F.lit(0), F.least(F.lit(255), idx)).cast("int")).drop("lo", "hi")


def time_slice(df: DataFrame, sample: int, samples: str = "samples") -> DataFrame:
    """(il, xl, value float): one sample of every trace, null where the trace is too short."""
    return df.select("il", "xl", F.try_element_at(F.col(samples), F.lit(sample + 1)).cast("float").alias("value"))


def slice_splat(sliced: DataFrame, width: int, height: int) -> DataFrame:
    """(px, py, value): the slice on a raster of its bounds, pixels averaging their cells; pixels without one have no row."""
    ends = sliced.agg(F.min("il").alias("a"), F.max("il").alias("b"), F.min("xl").alias("c"), F.max("xl").alias("d"))
    at = lambda v, lo, hi, n: F.coalesce(F.round(F.try_divide((F.col(v) - F.col(lo)) * F.lit(n - 1), F.col(hi) - F.col(lo))), F.lit(0)).cast("int")
    placed = with_flags(sliced.where(is_finite("value")), ends).select(at("xl", "c", "d", width).alias("px"), at("il", "a", "b", height).alias("py"), "value")
    return placed.groupBy("px", "py").agg(F.avg(F.col("value").cast("double")).alias("value"))


def slice_nearest(sliced: DataFrame, width: int, height: int) -> DataFrame:
    """(px, py, value): a dense slice by the nearest line of each axis; empty cells have no row."""
    def axis(name: str, n: int, pixel: str) -> DataFrame:
        values = sliced.select(name).distinct()
        ranks = values.select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("r"))  # as many rows as lines
        count = values.agg(F.count(F.lit(1)).alias("n"))
        pixels = count.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(pixel)).select(pixel, nearest_index(F.col(pixel), n, F.col("n")).alias("r"))
        return pixels.join(ranks, "r").select(pixel, name)

    return sliced.where(is_finite("value")).join(axis("xl", width, "px"), "xl").join(axis("il", height, "py"), "il").select("px", "py", "value")


def raster_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(px, py, value float): A - B where both have a value."""
    return a.select("px", "py", F.col("value").cast("float").alias("va")).join(b.select("px", "py", F.col("value").cast("float").alias("vb")), ["px", "py"]).select("px", "py", (F.col("va") - F.col("vb")).alias("value"))


def shared_range(a: DataFrame, b: DataFrame, gain: float = 0.0, budget: int | None = None) -> DataFrame:
    """One row (lo, hi) for both slices: order statistics of their finite values; (-1, 1) without any, one wide if constant.

    All values count. With a budget, as a display may ask for, of more values than that every k-th is
    taken by the hash of its place.
    """
    values = a.select("il", "xl", "value").unionByName(b.select("il", "xl", "value")).where(is_finite("value"))
    if budget:
        n = values.agg(F.count(F.lit(1)).alias("_n"))
        values = with_flags(values, n).where(F.pmod(F.xxhash64("il", "xl"), F.greatest(F.lit(1), F.floor(F.col("_n") / budget)).cast("bigint")) == 0)
    r = order_range(values, "value", gain)
    lo = F.coalesce("lo", F.lit(-1.0))
    return r.select(lo.alias("lo"), F.when(F.coalesce("hi", F.lit(1.0)) > lo, F.coalesce("hi", F.lit(1.0))).otherwise(lo + 1).alias("hi"))


def residual_range(df: DataFrame, value: str = "value") -> DataFrame:
    """One row (lo, hi) around 0 by the largest finite magnitude; (-1, 1) without any or if it is 0."""
    m = df.agg(F.coalesce(F.max(F.when(is_finite(value), F.abs(F.col(value).cast("double")))), F.lit(0.0)).alias("m"))
    top = F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(1.0))
    return m.select((-top).alias("lo"), top.alias("hi"))


def orthogonal_range(slices: list[DataFrame], gain: float, clip: float) -> DataFrame:
    """One row (lo, hi) for several slices together; the tail cut off is gain + (100 - clip) / 2, zeros count, and a constant gets 1 % (1e-6 at least) on either side."""
    values = slices[0].select("value")
    for s in slices[1:]:
        values = values.unionByName(s.select("value"))
    r = order_range(values, "value", gain + (100 - clip) / 2)
    pad = F.greatest(F.abs("lo") * 0.01, F.lit(1e-6))
    return r.select(F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - pad).alias("lo"), F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + pad).alias("hi"))


def section_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(trace, samples): A - B of traces in both volumes, over the shorter of two."""
    n = F.least(F.size("sa"), F.size("sb"))
    met = a.select("trace", F.col("samples").alias("sa")).join(b.select("trace", F.col("samples").alias("sb")), "trace")
    return met.select("trace", F.zip_with(F.slice("sa", 1, n), F.slice("sb", 1, n), lambda x, y: x - y).alias("samples"))


def position_columns(line: DataFrame, width: int, bounds: DataFrame | None = None) -> DataFrame:
    """(line, px, trace_l, trace_r, f): for evenly spread positions of each line (line, trace, distance) the traces on either side and the weight of the right one.

    bounds (line, start, end) limit the positions; a start before the line's is its start, an end beyond it or not behind the start its end.
    """
    ends = line.groupBy("line").agg(F.min("distance").alias("a"), F.max("distance").alias("b"))
    if bounds is not None:
        low = F.greatest("a", F.coalesce("start", "a"))
        ends = ends.join(bounds, "line").select("line", low.alias("a"), F.when((F.col("end") > F.col("b")) | (F.col("end") <= low), F.col("b")).otherwise(F.coalesce("end", "b")).alias("b"))
    targets = ends.select("line", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px"), "a", "b").select("line", "px", (F.col("a") + (F.col("b") - F.col("a")) * F.col("px") / F.lit(float(max(width - 1, 1)))).alias("p"))
    both = line.select("line", F.col("distance").alias("p"), "trace", F.lit(None).cast("int").alias("px")).unionByName(targets.select("line", "p", F.lit(None).cast("bigint").alias("trace"), "px"))
    at = F.when(F.col("trace").isNotNull(), F.struct("p", "trace"))
    left = F.last(at, ignorenulls=True).over(Window.partitionBy("line").orderBy("p", F.col("trace").isNull(), "trace").rowsBetween(Window.unboundedPreceding, 0))
    right = F.last(at, ignorenulls=True).over(Window.partitionBy("line").orderBy(F.desc("p"), F.col("trace").isNull(), F.desc("trace")).rowsBetween(Window.unboundedPreceding, 0))
    met = both.select("line", "px", "p", left.alias("l"), right.alias("r")).where("px IS NOT NULL").withColumns({"l": F.coalesce("l", "r"), "r": F.coalesce("r", "l")})
    return met.select("line", "px", F.col("l.trace").alias("trace_l"), F.col("r.trace").alias("trace_r"), F.coalesce(F.try_divide(F.col("p") - F.col("l.p"), F.col("r.p") - F.col("l.p")), F.lit(0.0)).alias("f"))


def texture_size(traces: Column, samples: Column, budget_bytes: int, lines: int, cap: tuple[int, int] = (1024, 1536)) -> Column:
    """struct<width, height>: the largest texture within the cap, no larger than the source but at least 2 x 2, and within the line's share of the byte budget."""
    w, h = (F.greatest(F.lit(2), F.least(v, F.lit(c))) for v, c in ((traces, cap[0]), (samples, cap[1])))
    shrink = F.least(F.lit(1.0), F.sqrt(F.lit(budget_bytes / max(lines, 1)) / (w * h)))
    return F.struct(F.greatest(F.lit(2), F.floor(w * shrink)).alias("width"), F.greatest(F.lit(2), F.floor(h * shrink)).alias("height"))


def time_fraction(ms: Column, lo: float, hi: float) -> Column:
    return (ms - lo) / F.lit(hi - lo) if hi != lo else F.lit(0.0)


def time_at_fraction(f: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + f * F.lit(hi - lo)


def pixel_place(px: Column, py: Column, width: int, height: int, traces: Column, samples: Column, dt_us: Column, delay_ms: Column) -> Column:
    """struct<trace, sample, ms> under a pixel, clamped to the data."""
    t = F.least(traces - 1, F.greatest(F.lit(0), nearest_index(px, width, traces)))
    s = F.least(samples - 1, F.greatest(F.lit(0), nearest_index(py, height, samples)))
    return F.struct(t.alias("trace"), s.alias("sample"), (delay_ms + s * dt_us / 1000.0).alias("ms"))
