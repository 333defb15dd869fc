"""Column functions shared by the operators. Null in, null out, unless said otherwise."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")

# Labels of SEG-Y codes.
SAMPLE_FORMATS = {1: "IBM float32", 2: "int32", 3: "int16", 4: "fixed point with gain", 5: "IEEE float32", 6: "IEEE float64", 7: "int24", 8: "int8", 9: "int64", 10: "uint32", 11: "uint16", 12: "uint64", 15: "uint24", 16: "uint8"}
MEASUREMENT_SYSTEMS = {1: "metres", 2: "feet"}
COORDINATE_UNITS = {1: "length", 2: "seconds of arc", 3: "decimal degrees", 4: "degrees, minutes, seconds"}
TRACE_KINDS = {
    1: "seismic data", 2: "dead", 3: "dummy", 4: "time break", 5: "uphole", 6: "sweep", 7: "timing", 8: "waterbreak", 9: "near-field gun signature", 10: "far-field gun signature", 11: "seismic pressure sensor",
    12: "multicomponent vertical", 13: "multicomponent crossline", 14: "multicomponent inline", 15: "rotated vertical", 16: "rotated transverse", 17: "rotated radial", 18: "vibrator reaction mass",
    19: "vibrator baseplate", 20: "vibrator estimated ground force", 21: "vibrator reference", 22: "time-velocity pairs",
}
TIME_BASES = {1: "local", 2: "GMT", 3: "other", 4: "UTC", 5: "GPS"}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a value that is neither null, NaN nor infinite; never null."""
    c = as_col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def scaled(value: Column | str, scalar: Column | str) -> Column:
    """A coordinate word with its scalar: positive multiplies, negative divides, zero or null counts as one."""
    v, s = as_col(value).cast("double"), F.coalesce(as_col(scalar), F.lit(0)).cast("double")
    return F.when(s > 0, v * s).when(s < 0, v / -s).otherwise(v)


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def azimuth_degrees(dx: Column, dy: Column) -> Column:
    """Clockwise from north in [0, 360)."""
    a = F.degrees(F.atan2(dx, dy)) + 360.0
    return a - 360.0 * F.floor(a / 360.0)


def centred_bin(value: Column | str, width: float, default: float) -> Column:
    """Number of the bin centred on a multiple of the width, halves upwards; a width that isn't positive gives the default width."""
    w = width if width and 0 < width < INF else default
    return F.floor(as_col(value) / w + 0.5)


def edge_bin(value: Column | str, origin: Column | float, size: float) -> Column:
    """Number of the bin that starts at the origin."""
    return F.floor((as_col(value) - origin) / size)


def clamp(value: Column, lo: Column | float, hi: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(lo), F.least(lit(hi), value))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def round_half_away(value: Column | str) -> Column:
    return F.round(as_col(value)).cast("bigint")


def checked_int(value: Column | str) -> Column:
    """The value as int, null where it doesn't fit."""
    return as_col(value).try_cast("int")


def code_label(code: Column | str, labels: dict[int, str], unknown: str = "unknown") -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(labels.items())))
    return F.coalesce(F.try_element_at(table, as_col(code)), F.lit(unknown))


def time_label(ms: Column | str) -> Column:
    """'850 ms' below a second, '1.250 s' from there on."""
    v = as_col(ms).cast("double")
    return F.when(F.abs(v) < 1000, F.format_string("%.0f ms", v)).otherwise(F.format_string("%.3f s", v / 1000))


def nice_step(span: Column | str, divisions: int) -> Column:
    """The smallest 1, 2 or 5 times a power of ten that cuts the span into at most so many parts; 1 for a span that isn't positive."""
    raw = as_col(span).cast("double") / divisions
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    q = raw / base
    return F.when(raw > 0, F.when(q <= 1, base).when(q <= 2, base * 2).when(q <= 5, base * 5).otherwise(base * 10)).otherwise(F.lit(1.0))


def natural_key(name: Column | str) -> Column:
    """Sort key of a file name: case ignored, runs of digits by value."""
    return F.regexp_replace(F.regexp_replace(F.lower(as_col(name)), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")


def line_name(path: Column | str) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(as_col(path), r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def folder(path: Column | str) -> Column:
    """Folder of a path, without its last separator; '' if it has none."""
    return F.regexp_replace(F.regexp_extract(as_col(path), r"^(.*)[/\\\\][^/\\\\]*$", 1), r"[/\\\\]+$", "")


def common_folder(df: DataFrame, path: str = "path") -> DataFrame:
    """One row (folder): the folder of all paths, as the first one spells it; '' if they lie in several (ignoring case) or there are none."""
    f = folder(path)
    return df.agg(F.when(F.count_distinct(F.lower(f)) == 1, F.min(f)).otherwise(F.lit("")).alias("folder"))


def hex_dump(data: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.hex(as_col(data)), "(..)", "$1 "))


def number_text(value: Column | str) -> Column:
    """Shortest text of a float, whole numbers without a point."""
    v = as_col(value).cast("double")
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.format_string("%.0f", v)).otherwise(v.cast("string"))


def gather_label(kind: Column, value: Column, x: Column, y: Column) -> Column:
    """'CMP 205', 'SHOT (12.5, 3.0)'."""
    return F.when(value.isNotNull(), F.concat_ws(" ", kind, value.cast("string"))).otherwise(F.format_string("%s (%.1f, %.1f)", kind, x, y))
