"""Queries of what a display asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators import acquisition, clip, display, gathers, lines, raster
from lithoframe.plans.views import NAV, REC, TRJ, navigation, records, trajectory
from lithoframe.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query(REC + " SELECT count(*) AS traces, min(trace_offset) FILTER (WHERE has_offset AND isfinite(trace_offset)) AS offset_min, max(trace_offset) FILTER (WHERE has_offset AND isfinite(trace_offset)) AS offset_max, min(azimuth) FILTER (WHERE has_azimuth AND isfinite(azimuth)) AS azimuth_min, max(azimuth) FILTER (WHERE has_azimuth AND isfinite(azimuth)) AS azimuth_max FROM rec WHERE source_id = 1010")
def gather_ranges(spark, sf):
    """Traces, offset and azimuth range of one shot gather."""
    return display.gather_ranges(gathers.select_keys(records(spark, sf), "source_id", [1010]))


@query(REC + " SELECT record_id, trace_number FROM rec WHERE source_id = 1010 OR receiver_id = 2050 OR cdp = 130")
def union_of_gathers(spark, sf):
    """A shot, a receiver and a midpoint gather together, each trace once."""
    rec = records(spark, sf)
    parts = [gathers.select_keys(rec, c, [k]) for c, k in (("source_id", 1010), ("receiver_id", 2050), ("cdp", 130))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("record_id", "trace_number").distinct()


@query(REC + ", n AS (SELECT source_id, count(*) AS t FROM rec WHERE source_id <> 0 GROUP BY 1) SELECT source_id, least(t, greatest(2, least(1024, 200 // 4))) AS width FROM n")
def wiggle_widths(spark, sf):
    """Wiggle columns of every shot gather on 200 pixels at factor 4."""
    n = records(spark, sf).where("source_id <> 0").groupBy("source_id").agg(F.count(F.lit(1)).alias("t"))
    return n.select("source_id", display.wiggle_width(F.col("t"), 200, 4).alias("width"))


@query(
    REC
    + """, p AS (SELECT source_id AS line, trace_number AS trace, trace_offset AS d FROM rec WHERE source_id <> 0 AND has_offset AND isfinite(trace_offset)), e AS (SELECT line, min(d) AS a, max(d) AS b FROM p GROUP BY 1), t AS (SELECT line, q AS qid, a + (b - a) * q / 11.0 AS target FROM e, generate_series(0, 11) g(q)),
m AS (SELECT t.line, qid, p.trace, row_number() OVER (PARTITION BY t.line, qid ORDER BY abs(p.d - target), p.d, p.trace) AS rn FROM t JOIN p ON p.line = t.line) SELECT line, qid, trace FROM m WHERE rn = 1"""
)
def offset_columns(spark, sf):
    """The traces of twelve even offsets of every shot gather."""
    return display.offset_columns(records(spark, sf).where("source_id <> 0"), "source_id", 12)


@query(REC + ", b AS (SELECT record_id + 1 AS record_id, trace_offset + 1.5 AS v FROM rec) SELECT a.record_id AS a_ord, a.trace_offset AS a_value, b.v AS b_value, round(a.trace_offset - b.v, 6) AS delta FROM rec a LEFT JOIN b USING (record_id)")
def compare_slots(spark, sf):
    """Values of A and B side by side; what isn't there is null. B is A moved by one record."""
    rec = records(spark, sf)
    a = rec.select(F.col("record_id").alias("ord"), F.col("trace_offset").alias("value"))
    b = rec.select((F.col("record_id") + 1).alias("ord"), (F.col("trace_offset") + 1.5).alias("value"))
    rows = a.select(F.col("ord").alias("a_ord")).withColumn("b_ord", F.col("a_ord"))
    return display.compare_slots(rows, a, b).select("a_ord", "a_value", "b_value", r("delta"))


@query(
    REC
    + ", p AS (SELECT min_by(source_x, trace_number) * 0.1 - 50 AS x, min_by(source_y, trace_number) * -0.1 + 300500 AS y, min(trace_number) AS first_trace FROM rec WHERE has_source AND isfinite(source_x) AND isfinite(source_y) AND source_id <> 0 GROUP BY source_id), "
    "q AS (SELECT record_id AS qid, receiver_x * 0.1 - 50 AS qx, receiver_y * -0.1 + 300500 AS qy FROM rec WHERE has_receiver), j AS (SELECT qid, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS d, first_trace FROM q, p WHERE abs(x - qx) <= 5 AND abs(y - qy) <= 5) "
    "SELECT qid, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d) AS rn FROM j WHERE d <= 5) t WHERE rn = 1"
)
def pick_point(spark, sf):
    """Distance in pixels from every receiver to the source that a click there would pick."""
    rec = records(spark, sf)
    q = rec.where("has_receiver").select(F.col("record_id").alias("qid"), (F.col("receiver_x") * 0.1 - 50).alias("x"), (F.col("receiver_y") * -0.1 + 300500).alias("y"))
    return display.pick(q, acquisition.points(rec, "source", by_place=False), (0.1, 0.0, -50.0, 0.0, -0.1, 300500.0), 5.0).select("qid", r("distance", 5))


@query(TRJ + " SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(DISTINCT line) AS lines FROM trj")
def scene_bounds(spark, sf):
    """The box around all lines."""
    return display.scene_bounds(trajectory(spark, sf))


@query("SELECT 'survey.dat' AS source, count(DISTINCT f.line) AS hits FROM segy_files f JOIN navigation n ON n.line = f.line")
def choose_navigation(spark, sf):
    """Of two navigation files the one in which more lines are found."""
    nav = table(spark, sf, "navigation").where("line IS NOT NULL").select("line").distinct()
    both = nav.select(F.lit("survey.dat").alias("source"), "line").unionByName(nav.where("pmod(xxhash64(line), 2) = 0").select(F.lit("a_part.dat").alias("source"), "line"))
    files = table(spark, sf, "segy_files").select(F.concat("line", F.lit(".sgy")).alias("file")).distinct()
    return display.choose_navigation(files, both)


@query(NAV + ", st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM nav WINDOW w AS (PARTITION BY line ORDER BY trace)), ds AS (SELECT line, trace, sum(d) OVER (PARTITION BY line ORDER BY trace) AS distance, row_number() OVER (PARTITION BY line ORDER BY trace) - 1 AS k, count(*) OVER (PARTITION BY line) AS n FROM st) SELECT line, trace, round(distance, 4) AS distance FROM ds WHERE n <= 4 OR k IN (0, round((n - 1) / 3.0), round(2 * (n - 1) / 3.0), n - 1)")
def navigation_polyline(spark, sf):
    """Every line's navigation with its running distance, at most four points."""
    nav = lines.with_distance(navigation(spark, sf))
    return clip.decimate(nav, 4).join(nav, ["line", "trace"]).select("line", "trace", r("distance", 4))


@query(REC + " SELECT record_id, CAST(least(3988, greatest(0, round(trace_in_field * 3988 / 79.0))) AS INTEGER) AS trace, CAST(least(1499, greatest(0, round(inline * 1499 / 59.0))) AS INTEGER) AS sample, delay_ms + least(1499, greatest(0, round(inline * 1499 / 59.0))) * sample_interval_us / 1000.0 AS ms FROM rec")
def pixel_places(spark, sf):
    """The trace, sample and time under pixels of an 80 x 60 display of 3,989 traces."""
    p = raster.pixel_place(F.col("trace_in_field"), F.col("inline"), 80, 60, F.lit(3989), F.lit(1500), F.col("sample_interval_us"), F.col("delay_ms"))
    return records(spark, sf).select("record_id", p.alias("p")).select("record_id", "p.trace", "p.sample", F.col("p.ms").cast("double").alias("ms"))


@query(REC + " SELECT record_id, round((delay_ms + trace_in_field - 4.0) / 96.0, 9) AS fraction, round(4.0 + (trace_in_field / 100.0) * 96.0, 9) AS ms FROM rec")
def time_fractions(spark, sf):
    """Times as fractions of a range, and fractions as times."""
    return records(spark, sf).select("record_id", F.round(raster.time_fraction(F.col("delay_ms") + F.col("trace_in_field"), 4.0, 100.0), 9).alias("fraction"), F.round(raster.time_at_fraction(F.col("trace_in_field") / F.lit(100.0), 4.0, 100.0), 9).alias("ms"))


@query("WITH f AS (SELECT file_id AS ordinal, CASE WHEN file_id % 2 = 0 THEN upper(line) ELSE lower(line) END AS path FROM segy_files UNION ALL SELECT file_id + 1000000, line FROM segy_files) SELECT min_by(path, ordinal) AS path, min(ordinal) AS ordinal FROM f GROUP BY lower(path)")
def paths_once(spark, sf):
    """A list of paths, each once whatever its case."""
    f = table(spark, sf, "segy_files")
    both = f.select(F.col("file_id").alias("ordinal"), F.when(F.col("file_id") % 2 == 0, F.upper("line")).otherwise(F.lower("line")).alias("path")).unionByName(f.select((F.col("file_id") + 1_000_000).alias("ordinal"), F.col("line").alias("path")))
    return display.once_by_path(both)


@query(REC + ", m AS (SELECT max(trace_number) AS m FROM rec), w AS (SELECT DISTINCT trace_number AS position, m - trace_number AS trace_number FROM rec, m) SELECT w.position, rec.record_id FROM w JOIN rec USING (trace_number)")
def records_of_traces(spark, sf):
    """The records of a list of traces, with their place in the list: here the traces in reverse."""
    rec = records(spark, sf)
    top = rec.agg(F.max("trace_number").alias("m"))
    wanted = gathers.with_flags(rec.select(F.col("trace_number").alias("position")).distinct(), top).select("position", (F.col("m") - F.col("position")).alias("trace_number"))
    return gathers.at_traces(rec, wanted).select("position", "record_id")
