"""Panels of a display: sections, differences, curtains and their supports; the trace under a place of a panel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import is_finite
from lithoframe.operators import clip, grid, lines, raster
from lithoframe.operators.gathers import with_flags
from lithoframe.operators.raster import _down


def sample_support(samples: int, height: int, smooth: bool) -> list[tuple[int, int, int, float]]:
    """(row, upper sample, lower sample, weight of the lower) of each output row; without smoothing the nearest sample, twice."""
    out = []
    for y in range(height):
        at = y * (samples - 1) / (height - 1) if height > 1 and samples > 1 else 0.0
        if smooth:
            top = int(at)
            out.append((y, top, min(top + 1, samples - 1), at - top if top < samples - 1 else 0.0))
        else:
            out.append((y, int(at + 0.5), int(at + 0.5), 0.0))
    return out


def trace_support(columns: DataFrame) -> DataFrame:
    """(line, trace): the traces that any column of raster.position_columns needs, each once."""
    return columns.select("line", F.explode(F.array("trace_l", "trace_r")).alias("trace")).where("trace IS NOT NULL").distinct()


def section(df: DataFrame, width: int, height: int, smooth: bool = False, traces: tuple[int, int] | list[int] | None = None, order: str = "trace") -> DataFrame:
    """(px, py, value): a raster of all traces, of those of a range (first, last), or of a list in its order. The traces of a list that aren't there are left out."""
    if isinstance(traces, tuple):
        df = df.where(F.col(order).between(*traces))
    elif traces is not None:
        listed = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(traces)], f"`{order}` bigint, _k bigint")
        df, order = df.join(listed, order).drop(order), "_k"
    return raster.bilinear_raster(df, width, height, order) if smooth else raster.nearest_raster(df, width, height, order)


def delta_range(values: DataFrame, value: str = "value", gain: float = 0.0, limits: tuple[float, float] | None = None) -> DataFrame:
    """One row (lo, hi) around 0: the larger of manual limits, or the order statistic of magnitudes that cuts gain percent off; (-1, 1) if that is 0 or there is none. Only finite values count."""
    if limits and limits[0] < limits[1]:
        top = max(abs(limits[0]), abs(limits[1]))
        return values.sparkSession.createDataFrame([(-top, top)], "lo double, hi double")
    m = raster.order_range(values.where(is_finite(value)).select(F.abs(F.col(value).cast("double")).alias("v")), "v", gain)
    top = F.when(F.col("hi") > 0, F.col("hi")).otherwise(F.lit(1.0))
    return m.select((-top).alias("lo"), top.alias("hi"))


def panel_range(sides: list[DataFrame], value: str = "value", gain: float = 0.0, limits: tuple[float, float] | None = None) -> DataFrame:
    """One row (lo, hi) for several panels: manual limits, or order statistics over the finite values of all; (-1, 1) without any, one wide if constant. A side that isn't there (null) isn't 0."""
    if limits and limits[0] < limits[1]:
        return sides[0].sparkSession.createDataFrame([limits], "lo double, hi double")
    every = sides[0].select(F.col(value).cast("double").alias("v"))
    for s in sides[1:]:
        every = every.unionByName(s.select(F.col(value).cast("double").alias("v")))
    r = raster.order_range(every, "v", gain)
    lo = F.coalesce("lo", F.lit(-1.0))
    return r.select(lo.alias("lo"), F.when(F.coalesce("hi", F.lit(1.0)) > lo, F.coalesce("hi", F.lit(1.0))).otherwise(lo + 1).alias("hi"))


def difference_section(a: DataFrame, b: DataFrame, pairs: DataFrame, width: int, height: int, smooth: bool = False) -> DataFrame:
    """(px, py, value): a raster of A - B of pairs (a_trace, b_trace, position) of traces (trace, samples), in the pairs' order, over the shorter of two."""
    n = F.least(F.size("sa"), F.size("sb"))
    met = pairs.join(a.select(F.col("trace").alias("a_trace"), F.col("samples").alias("sa")), "a_trace").join(b.select(F.col("trace").alias("b_trace"), F.col("samples").alias("sb")), "b_trace")
    d = met.select("position", F.zip_with(F.slice("sa", 1, n), F.slice("sb", 1, n), lambda x, y: x - y).alias("samples"))
    return section(d, width, height, smooth, order="position")


def side_section(rows: DataFrame, side: DataFrame, ordinal: str, width: int, height: int) -> DataFrame:
    """(px, py, value): one side of a comparison's rows (row, ordinal), a column per row; where the side isn't there the value is null, not 0."""
    n = rows.agg((F.max("row") + 1).alias("n")).where("n > 0")
    columns = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("px")).select("px", raster.nearest_index(F.col("px"), width, F.col("n")).cast("bigint").alias("row"))
    shown = columns.join(rows.select("row", F.col(ordinal).alias("ord")), "row").join(side.select("ord", "samples"), "ord", "left")
    pixel = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.struct(y.alias("py"), F.try_element_at(F.col("samples"), raster.nearest_index(y, height, F.size("samples")) + 1).alias("v")))
    return shown.select("px", "samples", F.explode(pixel).alias("c")).select("px", "c.py", F.when(F.col("samples").isNotNull(), raster.clean(F.col("c.v"))).alias("value"))


def position_raster(line: DataFrame, samples: DataFrame, width: int, height: int, smooth: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """(line, px, py, value): lines (line, trace, distance) of uneven spacing on even positions, from traces (line, trace, samples); bounds as in raster.position_columns.

    Smooth rasters mix the traces on either side of a position and the samples on either side of a row;
    others take the nearest of each, the left one at a tie. Only traces that a column needs are touched.
    """
    columns = raster.position_columns(line, width, bounds)
    if not smooth:
        nearest = F.when(F.col("f") <= 0.5, F.col("trace_l")).otherwise(F.col("trace_r"))
        shown = columns.select("line", "px", nearest.alias("trace")).join(samples.select("line", "trace", "samples"), ["line", "trace"])
        pixel = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.struct(y.alias("py"), F.try_element_at(F.col("samples"), raster.nearest_index(y, height, F.size("samples")) + 1).alias("v")))
        return shown.select("line", "px", F.explode(pixel).alias("c")).select("line", "px", "c.py", raster.clean(F.col("c.v")).alias("value"))
    of = lambda k: samples.select("line", F.col("trace").alias(f"trace_{k}"), F.col("samples").alias(f"s{k}"))
    met = columns.join(of("l"), ["line", "trace_l"]).join(of("r"), ["line", "trace_r"]).select("line", "px", "f", "sl", "sr")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            px, f = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            value = _down(b.column(3), height) * (1 - f[:, None]) + _down(b.column(4), height) * f[:, None]
            each = np.repeat(np.arange(len(px)), height)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each)), pa.array(px[each].astype(np.int32)), pa.array(np.tile(np.arange(height, dtype=np.int32), len(px))), pa.array(value.ravel())], names=["line", "px", "py", "value"])

    return met.mapInArrow(work, f"line {dict(line.dtypes)['line']}, px int, py int, value double")


def curtains(line: DataFrame, samples: DataFrame, box: tuple[float, float, float, float], width: int, height: int, calibration: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, rasters) of the stretches of lines (line, trace, x, y) inside a box, calibrated first if there is a calibration.

    runs are those of clip.clip_runs; rasters (line, run, px, py, value) show each run from border to
    border. A run with fewer than two traces to draw from has no raster.
    """
    placed = lines.apply_calibration(line, calibration) if calibration is not None else lines.with_distance(line)
    runs = clip.clip_runs(placed, box)
    key = F.struct("line", "run").alias("line")
    needed = placed.join(runs.select("line", "run", "first_support", "last_support"), "line").where("trace BETWEEN first_support AND last_support")
    drawn = position_raster(needed.select(key, "trace", "distance"), needed.select("line", "run", "trace").join(samples, ["line", "trace"]).select(key, "trace", "samples"), width, height, bounds=runs.select(key, "start", "end"))
    return runs, drawn.select("line.line", "line.run", "px", "py", "value")


def residual_panels(a: DataFrame, b: DataFrame, il: float, xl: float, sample: int, width: int, height: int, gain: float = 0.0) -> tuple[dict[str, DataFrame], DataFrame]:
    """({"inline", "crossline", "time"} -> raster of A - B, range): three panels of volumes (trace, il, xl, samples) with one range around 0.

    Lines are the nearest of A; sections pair A's traces with B's first trace of the place.
    """
    index = lambda df: df.select(F.col("trace").alias("trace_number"), "il", "xl")
    out = {}
    for name, axis, target in (("inline", "il", il), ("crossline", "xl", xl)):
        on = grid.line_traces(index(a), axis, target)
        cells = grid.cell_pairs(index(a), index(b)).select("a_trace", "b_trace")
        pairs = on.select(F.col("trace_number").alias("a_trace"), F.col("across").alias("position")).join(cells, "a_trace").select("a_trace", "b_trace", "position")
        out[name] = difference_section(a, b, pairs, width, height)
    da, db = (raster.slice_splat(raster.time_slice(df, sample), width, height) for df in (a, b))
    out["time"] = raster.raster_difference(da, db).select("px", "py", F.col("value").cast("double").alias("value"))
    every = out["inline"].unionByName(out["crossline"]).unionByName(out["time"])
    return out, delta_range(every, gain=gain)


def pick_on_line(index: DataFrame, axis: str, target: float, across: float, sample: float, samples: int, other: DataFrame | None = None) -> DataFrame:
    """One row (il, xl, trace, other_trace, sample) under a place of a section: the nearest line, on it the nearest trace (the lower at a tie), and the sample, clamped.

    With `other` (a difference) only places that both have count, and no row comes back if their lines differ.
    """
    on = grid.line_traces(index, axis, target).select("trace_number", "across")
    if other is not None:
        there = grid.line_traces(other, axis, target).select(F.col("trace_number").alias("other_trace"), "across")
        same = with_flags(on, grid.nearest_value(index, axis, target).withColumnRenamed("value", "la"))
        same = with_flags(same, grid.nearest_value(other, axis, target).withColumnRenamed("value", "lb"))
        on = same.where("la = lb").join(there, "across").select("trace_number", "across", "other_trace")
    else:
        on = on.withColumn("other_trace", F.lit(None).cast("bigint"))
    best = on.agg(F.min(F.struct(F.abs(F.col("across") - F.lit(across)).alias("d"), "across", "trace_number", "other_trace")).alias("m")).where("m IS NOT NULL")
    at = with_flags(best.select("m.across", F.col("m.trace_number").alias("trace"), F.col("m.other_trace").alias("other_trace")), grid.nearest_value(index, axis, target))
    row = min(max(int(sample + 0.5) if sample >= 0 else 0, 0), samples - 1)
    il, xl = (F.col("value"), F.col("across")) if axis == "il" else (F.col("across"), F.col("value"))
    return at.select(il.alias("il"), xl.alias("xl"), "trace", "other_trace", F.lit(row).alias("sample"))


def pick_on_slice(index: DataFrame, il: float, xl: float, other: DataFrame | None = None) -> DataFrame:
    """One row (il, xl, trace, other_trace) under a place of a time slice: the cell of the nearest lines of each axis; no row if it is empty, or, with `other`, empty there."""
    cells = grid.first_per_cell(index)
    at = with_flags(cells, grid.nearest_value(index, "il", il).withColumnRenamed("value", "vi"))
    at = with_flags(at, grid.nearest_value(index, "xl", xl).withColumnRenamed("value", "vx")).where("il = vi AND xl = vx").select("il", "xl", F.col("trace_number").alias("trace"))
    if other is None:
        return at.withColumn("other_trace", F.lit(None).cast("bigint"))
    return at.join(grid.first_per_cell(other).withColumnRenamed("trace_number", "other_trace"), ["il", "xl"])


def window_texture_size(size: Column, full: Column, window: Column, cap: int = 1536) -> Column:
    """struct<width, height> of a texture of a time window: the whole record's width, and of its height the window's share, rounded up, within 2..the window."""
    share = F.when(window < full, F.ceil(size["height"] * window / F.greatest(full, window))).otherwise(size["height"])
    return F.struct(size["width"].alias("width"), F.greatest(F.lit(2), F.least(share, window, F.lit(cap))).cast("bigint").alias("height"))
