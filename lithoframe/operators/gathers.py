"""Gather keys, bins, selections and orders of prestack records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import centred_bin, is_finite
from lithoframe.operators.ordering import numbered

OFFSET_WIDTH, AZIMUTH_WIDTH = 20.0, 1.0


def offset_bin(width: float = OFFSET_WIDTH) -> Column:
    """Bin of the offset, null without a finite offset; bin b is centred on b times the width."""
    return F.when(F.col("has_offset") & is_finite("trace_offset"), centred_bin("trace_offset", width, OFFSET_WIDTH))


def azimuth_bin(width: float = AZIMUTH_WIDTH) -> Column:
    """Bin of the azimuth; bins don't wrap, so 359.6 degrees are in bin 360 at width 1."""
    return F.when(F.col("has_azimuth") & is_finite("azimuth"), centred_bin("azimuth", width, AZIMUTH_WIDTH))


def with_flags(df: DataFrame, flags: DataFrame) -> DataFrame:
    """The table with a one-row table's columns: file-level facts, as a scalar subquery, that steer row-level choices. Null if there is no such row."""
    facts = flags.select(F.struct(*flags.columns).alias("f")).scalar()
    return df.withColumn("_facts", facts).select(*df.columns, *(F.col(f"_facts.{c}").alias(c) for c in flags.columns))


def cmp_keys(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds cmp_kind and the key (cmp_a, cmp_b): inline and crossline on a grid, else the CDP number if the file has any, else the midpoint. Null where the trace lacks it."""
    out = with_flags(df, flags)
    kind = F.when(F.col("uses_grid"), "grid").when(F.col("any_cdp"), "id").otherwise("xy")
    a = F.when(F.col("uses_grid"), F.col("inline").cast("double")).when(F.col("any_cdp"), F.when(F.col("has_cdp"), F.col("cdp").cast("double"))).otherwise(F.when(F.col("has_midpoint"), F.col("midpoint_x")))
    b = F.when(F.col("uses_grid"), F.col("crossline").cast("double")).when(F.col("any_cdp"), F.lit(None).cast("double")).otherwise(F.when(F.col("has_midpoint"), F.col("midpoint_y")))
    return out.withColumns({"cmp_kind": kind, "cmp_a": a, "cmp_b": b}).drop("uses_grid", "any_cdp")


def point_keys(df: DataFrame, kind: str, by_place: Column) -> DataFrame:
    """Adds {kind}_key_id or {kind}_key_x/y: the place where by_place holds, else the number (0 is none)."""
    has = F.col(f"has_{kind}")
    return df.withColumns(
        {
            f"{kind}_key_id": F.when(~by_place & (F.col(f"{kind}_id") != 0), F.col(f"{kind}_id")),
            f"{kind}_key_x": F.when(by_place & has, F.col(f"{kind}_x")),
            f"{kind}_key_y": F.when(by_place & has, F.col(f"{kind}_y")),
        }
    )


def cmp_xy_bins(df: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(bin_i, bin_j, centre_x, centre_y, fold): square midpoint bins from the origin; origin (0, 0) means the smallest midpoint."""
    located = df.where(F.col("has_midpoint") & is_finite("midpoint_x") & is_finite("midpoint_y"))
    if origin == (0.0, 0.0):
        located = with_flags(located, located.agg(F.min("midpoint_x").alias("ox"), F.min("midpoint_y").alias("oy")))
    else:
        located = located.withColumns({"ox": F.lit(origin[0]), "oy": F.lit(origin[1])})
    i, j = F.floor((F.col("midpoint_x") - F.col("ox")) / size), F.floor((F.col("midpoint_y") - F.col("oy")) / size)
    binned = located.withColumns({"bin_i": i, "bin_j": j}).groupBy("bin_i", "bin_j", "ox", "oy").agg(F.count(F.lit(1)).alias("fold"))
    return binned.select("bin_i", "bin_j", (F.col("ox") + (F.col("bin_i") + 0.5) * size).alias("centre_x"), (F.col("oy") + (F.col("bin_j") + 0.5) * size).alias("centre_y"), "fold")


def bin_gathers(df: DataFrame, bin_: Column, width: float) -> DataFrame:
    """(bin, centre, lo, hi, traces) of the bins that hold traces."""
    return df.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("traces")).select("bin", (F.col("bin") * width).alias("centre"), ((F.col("bin") - 0.5) * width).alias("lo"), ((F.col("bin") + 0.5) * width).alias("hi"), "traces")


def secondary_order(mode: str) -> list[Column]:
    """Sort columns of a secondary order; what a trace lacks comes last; trace number breaks ties."""
    off = F.when(F.col("has_offset"), F.col("trace_offset"))
    columns = {
        "physical": [],
        "offset": [off.asc_nulls_last()],
        "abs_offset": [F.abs(off).asc_nulls_last()],
        "azimuth": [F.when(F.col("has_azimuth"), F.col("azimuth")).asc_nulls_last()],
        "cmp": [F.when(F.col("has_cdp"), F.col("cdp")).asc_nulls_last()],
        "shot": [F.when(F.col("source_id") != 0, F.col("source_id")).asc_nulls_last()],
        "receiver": [F.when(F.col("receiver_id") != 0, F.col("receiver_id")).asc_nulls_last()],
        "common_offset": [offset_bin().asc_nulls_last()],
    }[mode]
    return [*columns, F.col("trace_number").asc()]


def ordered_gather(df: DataFrame, group: list[str], mode: str = "physical") -> DataFrame:
    """Adds position (from 0) of each trace in its gather, by the secondary order. A gather is one partition of a window: it is what a viewer shows at once."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*secondary_order(mode))) - 1)


def two_level(df: DataFrame, primary: str, mode: str) -> DataFrame:
    """Adds output_order (from 0) of all rows by primary key, then secondary order, then trace number. Rows without the key come last; a key may hold any share of the rows."""
    return numbered(df, [F.col(primary).cast("double").asc_nulls_last(), *secondary_order(mode)], "output_order")


def select_keys(df: DataFrame, key: str, keys: list[int]) -> DataFrame:
    """Rows of several gathers, each row once."""
    return df.where(F.col(key).isin([int(k) for k in dict.fromkeys(keys)]))


def at_traces(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of a list (position, trace_number), with position; traces that aren't there have none, and several records of a trace share its position."""
    return df.join(wanted.select("position", "trace_number"), "trace_number")


def raw_range(df: DataFrame, first: int, end: int, n_traces: int) -> DataFrame:
    """Traces first..end-1 in physical order; reversed ends are swapped, both are clamped, and an end of 0 or less means the file's."""
    if end <= 0:
        end = n_traces
    if first > end:
        first, end = end, first
    first, end = max(0, first), min(end, n_traces)
    return df.where((F.col("trace_number") >= first) & (F.col("trace_number") < end))


def adjacent_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, previous, next) of the sorted keys; the ends are their own neighbours."""
    keys = numbered(df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct(), ["key"])
    beside = lambda name, by: keys.select(F.col("key").alias(name), (F.col("n") + by).alias("n"))
    met = keys.join(beside("p", 1), "n", "left").join(beside("x", -1), "n", "left")
    return met.select("key", F.coalesce("p", "key").alias("previous"), F.coalesce("x", "key").alias("next"))


#: Separators of a key expression, and what stands between them.
_SEPARATORS = re.compile(r"[,;，；\s]+")
_NUMBER = r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)"
_RANGE = re.compile(rf"(#?)({_NUMBER})(?:(?:\.\.|-)(#?)({_NUMBER}))?")
_BIN = re.compile(r"(-?\d+)[:/](-?\d+)")


def parse_keys(text: str, available: list) -> list:
    """Keys of an expression over the available ones, each once, in the order named.

    'all', values, ranges 'a-b' or 'a..b' in either order, positions '#n' and '#a-#b' from 1, and bins
    'x:y' or 'x/y' where keys are pairs (x, y). Pairs have no numeric value, so values and ranges don't
    find them. Raises ValueError for what can't be read and for what finds nothing.
    """
    found: dict = {}
    for part in (p for p in _SEPARATORS.split(text.strip()) if p):
        if part.lower() == "all":
            found.update(dict.fromkeys(available))
            continue
        if b := _BIN.fullmatch(part):
            key = (int(b[1]), int(b[2]))
            if key not in available:
                raise ValueError(f"there is no bin {part!r}")
            found[key] = None
            continue
        m = _RANGE.fullmatch(part)
        if not m or (m[3] and not m[1]):
            raise ValueError(f"not a key expression: {part!r}")
        lo, hi = sorted((float(m[2]), float(m[4] or m[2])))
        if m[1]:
            if lo < 1 or hi > len(available) or lo % 1 or hi % 1:
                raise ValueError(f"there are {len(available)} keys, so no {part!r}")
            found.update(dict.fromkeys(available[int(lo) - 1 : int(hi)]))
        else:
            hit = [k for k in available if not isinstance(k, tuple) and lo <= k <= hi]
            if not hit:
                raise ValueError(f"no key in {part!r}")
            found.update(dict.fromkeys(hit))
    if not found:
        raise ValueError("an expression names at least one key")
    return list(found)


#: Columns of a gather key of any kind; those of another kind are null. kind is id, offset_bin, azimuth_bin, cmp_bin, grid or xy.
KEY_COLUMNS = "kind id bin_index bin_centre bin_width bin_i bin_j bin_size origin_x origin_y inline crossline x y".split()


def key_order() -> list[Column]:
    """Sort columns of gather keys: numbers and offset bins, then places, then grid cells, azimuth bins, and CMP bins, each by what they consist of."""
    kind = F.col("kind")
    of = lambda k, c: F.when(kind == k, c if isinstance(c, Column) else F.col(c))
    rank = F.when(kind == "cmp_bin", 4).when(kind == "azimuth_bin", 3).when(kind == "grid", 2).when(kind == "xy", 1).otherwise(0)
    low = F.col("bin_centre") - F.col("bin_width") / 2
    return [rank, of("cmp_bin", "bin_i"), of("cmp_bin", "bin_j"), of("cmp_bin", "bin_size"), of("cmp_bin", "origin_x"), of("cmp_bin", "origin_y"), of("azimuth_bin", "bin_index"), of("azimuth_bin", "bin_width"), of("azimuth_bin", low), of("xy", "x"), of("xy", "y"), of("grid", "inline"), of("grid", "crossline"), F.when(kind.isin("id", "offset_bin"), F.coalesce(F.col("id").cast("double"), F.col("bin_index").cast("double")))]


def key_value() -> Column:
    """What a key is as a number: the centre of an offset or azimuth bin, or the number; null of CMP bins, grid cells and places."""
    return F.when(F.col("kind").isin("offset_bin", "azimuth_bin"), F.col("bin_centre")).when(F.col("kind") == "id", F.col("id").cast("double"))


def primary_keys(df: DataFrame, gather: str, flags: DataFrame | None = None, width: float | None = None, bin_size: float | None = None, origin: tuple[float, float] | None = None) -> DataFrame:
    """The records with KEY_COLUMNS of a gather type: "cmp", "shot", "receiver", "offset" or "azimuth"; kind is null where a record has none.

    flags is one row (uses_grid, source_by_place, receiver_by_place). A CMP is its XY bin if a size and an
    origin are given, else the grid cell of a grid, else its CDP number if the record has one, else its
    midpoint.
    """
    if gather not in ("cmp", "shot", "receiver", "offset", "azimuth"):
        raise ValueError(f"gather is cmp, shot, receiver, offset or azimuth, not {gather}")
    there = with_flags(df, flags) if flags is not None else df.withColumns({c: F.lit(False) for c in ("uses_grid", "source_by_place", "receiver_by_place")})
    cells: dict[str, Column] = {}
    if gather in ("shot", "receiver"):
        p = "source" if gather == "shot" else "receiver"
        placed = F.col(f"has_{p}") & is_finite(f"{p}_x") & is_finite(f"{p}_y")
        cells["kind"] = F.when(F.col(f"{p}_by_place"), F.when(placed, F.lit("xy"))).when(F.coalesce(F.col(f"{p}_id"), F.lit(0)) != 0, F.lit("id"))
        cells |= {"id": F.when(F.col("kind") == "id", F.col(f"{p}_id")), "x": F.when(F.col("kind") == "xy", F.col(f"{p}_x")), "y": F.when(F.col("kind") == "xy", F.col(f"{p}_y"))}
    elif gather in ("offset", "azimuth"):
        w = width if width and 0 < width < float("inf") else OFFSET_WIDTH if gather == "offset" else AZIMUTH_WIDTH
        b = offset_bin(w) if gather == "offset" else azimuth_bin(w)
        cells = {"kind": F.when(b.isNotNull(), F.lit(f"{gather}_bin")), "bin_index": b.cast("bigint"), "bin_centre": b * w, "bin_width": F.when(b.isNotNull(), F.lit(w))}
    else:
        mid = F.col("has_midpoint") & is_finite("midpoint_x") & is_finite("midpoint_y")
        if bin_size and origin:
            i, j = (F.floor((F.col(f"midpoint_{k}") - o) / bin_size) for k, o in zip("xy", origin))
            cells = {"kind": F.when(mid, F.lit("cmp_bin")), **{c: F.when(mid, v) for c, v in (("bin_i", i), ("bin_j", j), ("bin_size", F.lit(bin_size)), ("origin_x", F.lit(origin[0])), ("origin_y", F.lit(origin[1])))}}
        else:
            on = (F.coalesce("inline", F.lit(0)) != 0) | (F.coalesce("crossline", F.lit(0)) != 0)
            cells = {"kind": F.when(F.col("uses_grid"), F.when(on, F.lit("grid"))).when(F.col("has_cdp"), F.lit("id")).when(mid, F.lit("xy"))}
            cells |= {"key_inline": F.when(F.col("kind") == "grid", F.col("inline")), "key_crossline": F.when(F.col("kind") == "grid", F.col("crossline")), "id": F.when(F.col("kind") == "id", F.col("cdp")), "x": F.when(F.col("kind") == "xy", F.col("midpoint_x")), "y": F.when(F.col("kind") == "xy", F.col("midpoint_y"))}
    out = there.withColumn("kind", cells.pop("kind")).withColumns(cells)
    kinds = {"id": "bigint", "bin_index": "bigint", "bin_i": "bigint", "bin_j": "bigint"}
    key = [(F.col(f"key_{c}") if f"key_{c}" in out.columns else F.lit(None).cast("int")).alias(c) if c in ("inline", "crossline") else (F.col(c) if c in out.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c) if c != "kind" else F.col("kind") for c in KEY_COLUMNS]
    return out.select(F.struct(*df.columns).alias("record"), *key)


def legacy_order(df: DataFrame, mode: str | None, all_traces: bool = False) -> DataFrame:
    """Adds output_order by a plain sort (offset, abs_offset or azimuth), without grouping by a primary key; unset, or physical, over all traces it is the order of the file."""
    if mode not in (None, "physical", "offset", "abs_offset", "azimuth"):
        raise ValueError(f"mode is offset, abs_offset or azimuth, not {mode}")
    return numbered(df, secondary_order("physical" if mode is None or all_traces and mode == "physical" else mode), "output_order")


def displayed(ordered: DataFrame, first: int, last: int, position: str = "position") -> DataFrame:
    """The traces of an ordered gather that a view from first to last shows, ends included and in either order; the view is held within the gather, so something is always shown."""
    lo, hi = sorted((first, last))
    n = ordered.agg(F.max(position).alias("_top"))
    held = with_flags(ordered, n)
    inside = F.col(position).between(F.least(F.lit(max(lo, 0)), F.col("_top")), F.greatest(F.lit(max(hi, 0)), F.lit(0)))
    return held.where(inside).drop("_top")
