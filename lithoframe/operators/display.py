"""Rows that a display asks for: selections with positions and ranges, columns, slots of a comparison, places under a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import COORDINATE_UNITS, MEASUREMENT_SYSTEMS, SAMPLE_FORMATS, TIME_BASES, TRACE_KINDS, code_label, is_finite, scaled
from lithoframe.operators import acquisition, lines
from lithoframe.sources.words import SCALED_BY

WIGGLE_FACTORS = (1, 2, 4, 5, 8)


def gather_ranges(gather: DataFrame) -> DataFrame:
    """One row (traces, offset_min, offset_max, azimuth_min, azimuth_max) of a selection."""
    off, az = F.when(F.col("has_offset") & is_finite("trace_offset"), F.col("trace_offset")), F.when(F.col("has_azimuth") & is_finite("azimuth"), F.col("azimuth"))
    return gather.agg(F.count(F.lit(1)).alias("traces"), F.min(off).alias("offset_min"), F.max(off).alias("offset_max"), F.min(az).alias("azimuth_min"), F.max(az).alias("azimuth_max"))


def wiggle_width(traces: Column, width: int, factor: int) -> Column:
    """Columns of a wiggle display: the width over one of WIGGLE_FACTORS, within 2..1024 and no more than there are traces."""
    if factor not in WIGGLE_FACTORS:
        raise ValueError(f"factor is one of {WIGGLE_FACTORS}, not {factor}")
    return F.least(traces, F.greatest(F.lit(2), F.least(F.lit(1024), F.lit(width // factor))))


def offset_columns(gathers: DataFrame, key: str, width: int) -> DataFrame:
    """(line, qid, trace): for evenly spread offsets of each gather the trace with the nearest offset, the left one at a tie."""
    placed = gathers.where(F.col("has_offset") & is_finite("trace_offset")).select(F.col(key).alias("line"), F.col("trace_number").alias("trace"), F.col("trace_offset").alias("distance"))
    return lines.nearest_along(placed, lines.even_targets(placed, width))


def compare_slots(rows: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Logical rows with both sides' values (ord, value) and their difference; a side that isn't there is null, not 0."""
    joined = rows.join(a.select(F.col("ord").alias("a_ord"), F.col("value").alias("a_value")), "a_ord", "left").join(b.select(F.col("ord").alias("b_ord"), F.col("value").alias("b_value")), "b_ord", "left")
    return joined.withColumn("delta", F.col("a_value") - F.col("b_value"))


def pick(queries: DataFrame, pts: DataFrame, affine: tuple[float, float, float, float, float, float], pixels: float) -> DataFrame:
    """(qid, first_trace, distance) of the point nearest to each query (qid, x, y) in pixels; affine maps a place (x, y) to (a x + b y + c, d x + e y + f)."""
    a, b, c, d, e, f = affine
    on_screen = pts.select("first_trace", (F.col("x") * a + F.col("y") * b + c).alias("x"), (F.col("x") * d + F.col("y") * e + f).alias("y"))
    return acquisition.nearest_points(queries, on_screen, pixels)


def scene_bounds(line: DataFrame) -> DataFrame:
    """One row (x0, x1, y0, y1, lines) over finite places."""
    s = line.where(is_finite("x") & is_finite("y"))
    return s.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count_distinct("line").alias("lines"))


def choose_navigation(files: DataFrame, nav: DataFrame) -> DataFrame:
    """(source, hits): the navigation source (source, line) in which most files find their line; ties take the first name, and one without any hit isn't chosen."""
    found = lines.match_line_names(files, nav.select("line").distinct())
    hits = nav.select("source", "line").distinct().join(found, "line").groupBy("source").agg(F.count_distinct("file").alias("hits"))
    return hits.orderBy(F.desc("hits"), "source").limit(1)


def interpreted(words: DataFrame) -> DataFrame:
    """Header words (path, trace_number, name, value, unit) with `scaled`, `meaning` and `shown_unit`.

    scaled has elevations, coordinates and shotpoint numbers under their scalars, the others as they
    are; meaning is the label of a code, null of other words; shown_unit names the coordinates' unit
    where the word has that. Rows of a binary header have no trace_number; their scalars are none.
    """
    words = words if "trace_number" in words.columns else words.withColumn("trace_number", F.lit(None).cast("bigint"))
    needed = (*dict.fromkeys(SCALED_BY.values()), "coordinate_units")
    per_trace = words.where(F.col("name").isin(*needed)).groupBy("path", "trace_number").agg(*(F.max(F.when(F.col("name") == s, F.col("value"))).alias(f"_{s}") for s in needed))
    factor = F.lit(None).cast("bigint")
    for name, s in SCALED_BY.items():
        factor = F.when(F.col("name") == name, F.col(f"_{s}")).otherwise(factor)
    meaning = F.lit(None).cast("string")
    for name, labels in (("format_code", SAMPLE_FORMATS), ("measurement_system", MEASUREMENT_SYSTEMS), ("coordinate_units", COORDINATE_UNITS), ("time_basis", TIME_BASES), ("trace_id_code", TRACE_KINDS)):
        meaning = F.when(F.col("name") == name, code_label(F.col("value").cast("int"), labels)).otherwise(meaning)
    meaning = F.when(F.col("name") == "revision", F.format_string("%d.%d", F.floor(F.col("value") / 256).cast("int"), (F.col("value") % 256).cast("int"))).otherwise(meaning)
    unit = F.when(F.col("unit") == "xy", code_label(F.col("_coordinate_units").cast("int"), COORDINATE_UNITS)).otherwise(F.col("unit"))
    met = words.join(per_trace.withColumnsRenamed({"path": "_path", "trace_number": "_trace"}), F.col("path").eqNullSafe(F.col("_path")) & F.col("trace_number").eqNullSafe(F.col("_trace")), "left")
    return met.select(*words.columns, scaled("value", factor).alias("scaled"), meaning.alias("meaning"), unit.alias("shown_unit"))


def header_filter(words: DataFrame, keep: str, key_fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a header table: 'all', 'key' fields, or those whose raw word isn't 0 ('nonzero')."""
    if keep == "all":
        return words
    if keep == "key":
        return words.where(F.col("name").isin(*key_fields))
    if keep == "nonzero":
        return words.where("value <> 0")
    raise ValueError(f"keep is all, key or nonzero, not {keep}")


def once_by_path(files: DataFrame, path: str = "path", ordinal: str = "ordinal") -> DataFrame:
    """Each path once whatever its case, the first of the list."""
    return files.groupBy(F.lower(path).alias("_k")).agg(F.min_by(path, ordinal).alias(path), F.min(ordinal).alias(ordinal)).drop("_k")
