"""Queries on prestack records: derived geometry, gathers, acquisition points, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.functions import scalar as S
from lithoframe.operators import acquisition, gathers, qc
from lithoframe.operators import records as R
from lithoframe.operators.ordering import numbered
from lithoframe.plans.views import REC, records
from lithoframe.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


FIN = "isfinite({0})"


@query(
    REC
    + """, g AS (SELECT *, has_source AND isfinite(source_x) AND isfinite(source_y) AS hs, has_receiver AND isfinite(receiver_x) AND isfinite(receiver_y) AS hr, receiver_x - source_x AS dx, receiver_y - source_y AS dy FROM rec),
h AS (SELECT *, hs AND hr AS hm, CASE WHEN hs AND hr THEN sqrt(dx * dx + dy * dy) END AS co, has_header_offset AND isfinite(header_offset) AS ho, degrees(atan2(dx, dy)) + 360 AS az FROM g)
SELECT record_id, hm AS d_has_midpoint, round(CASE WHEN hm THEN (source_x + receiver_x) / 2 END, 6) AS d_midpoint_x, round(CASE WHEN hm THEN (source_y + receiver_y) / 2 END, 6) AS d_midpoint_y, round(co, 6) AS d_computed_offset,
  round(CASE WHEN co > 0 THEN az - 360 * floor(az / 360) END, 6) AS d_azimuth, round(CASE WHEN ho THEN header_offset ELSE co END, 6) AS d_offset, ho OR hm AS d_has_offset FROM h"""
)
def derive_offset_azimuth(spark, sf):
    """Midpoint, computed offset, azimuth and the offset that holds, of every record."""
    d = R.derive_geometry(records(spark, sf))
    return d.select("record_id", "d_has_midpoint", *(r(c) for c in ("d_midpoint_x", "d_midpoint_y", "d_computed_offset", "d_azimuth", "d_offset")), "d_has_offset")


@query(REC + " SELECT count(*) FILTER (WHERE inline <> 0 OR crossline <> 0) >= 0.9 * count(*) AND count(*) > 0 AS uses_grid, bool_or(has_cdp) AS any_cdp FROM rec")
def file_flags(spark, sf):
    """Whether the file is on a grid and has CDP numbers."""
    return R.uses_grid(records(spark, sf))


_CMP = """, f AS (SELECT count(*) FILTER (WHERE inline <> 0 OR crossline <> 0) >= 0.9 * count(*) AS ug, bool_or(has_cdp) AS ac FROM rec),
cmp AS (SELECT rec.*, CASE WHEN ug THEN 'grid' WHEN ac THEN 'id' ELSE 'xy' END AS cmp_kind, CASE WHEN ug THEN CAST(inline AS DOUBLE) WHEN ac THEN CASE WHEN has_cdp THEN CAST(cdp AS DOUBLE) END WHEN has_midpoint THEN midpoint_x END AS cmp_a,
  CASE WHEN ug THEN CAST(crossline AS DOUBLE) WHEN ac THEN NULL WHEN has_midpoint THEN midpoint_y END AS cmp_b FROM rec, f)"""


@query(REC + _CMP + " SELECT record_id, cmp_kind, cmp_a, cmp_b FROM cmp")
def cmp_keys(spark, sf):
    """The common-midpoint key of every record."""
    rec = records(spark, sf)
    return gathers.cmp_keys(rec, R.uses_grid(rec)).select("record_id", "cmp_kind", "cmp_a", "cmp_b")


@query(REC + " SELECT source_id // 2 AS id, count(DISTINCT (source_x, source_y)) AS places FROM rec WHERE has_source AND source_id // 2 <> 0 GROUP BY 1 HAVING count(DISTINCT (source_x, source_y)) > 1")
def shot_keys_conflict(spark, sf):
    """Source numbers that stand for more than one place, where two sources share each number."""
    return acquisition.id_conflicts(records(spark, sf).withColumn("source_id", F.floor(F.col("source_id") / 2)), "source")


@query(REC + " SELECT receiver_id // 5000 AS id, count(DISTINCT (receiver_x, receiver_y)) AS places FROM rec WHERE has_receiver AND receiver_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (receiver_x, receiver_y)) > 1")
def receiver_keys_conflict(spark, sf):
    """Receiver numbers, 0 included, that stand for more than one place, where many receivers share each number."""
    return acquisition.id_conflicts(records(spark, sf).withColumn("receiver_id", F.floor(F.col("receiver_id") / 5000)), "receiver", with_zero=True)


@query(
    REC
    + """, c AS (SELECT count(*) > 0 AS conflict FROM (SELECT source_id FROM rec WHERE has_source AND source_id <> 0 GROUP BY 1 HAVING count(DISTINCT (source_x, source_y)) > 1) t)
SELECT conflict, coalesce(bool_and(source_id <> 0) FILTER (WHERE has_source), FALSE) AS all_have_ids, conflict OR NOT coalesce(bool_and(source_id <> 0) FILTER (WHERE has_source), FALSE) AS uses_coordinates FROM rec, c GROUP BY conflict"""
)
def source_identity(spark, sf):
    """Whether sources are told apart by number or by place."""
    return acquisition.identity_flags(records(spark, sf), "source")


@query(
    REC
    + """, c AS (SELECT source_id FROM rec WHERE has_source AND source_id <> 0 GROUP BY 1 HAVING count(DISTINCT (source_x, source_y)) > 1), f AS (SELECT count(*) > 0 AS p FROM c)
SELECT record_id, CAST(CASE WHEN NOT p AND source_id <> 0 THEN source_id END AS DOUBLE) AS source_key_id, CASE WHEN p AND has_source THEN source_x END AS source_key_x, CASE WHEN p AND has_source THEN source_y END AS source_key_y FROM rec, f"""
)
def shot_keys(spark, sf):
    """The shot key of every record: the number, or the place where numbers conflict anywhere in the file."""
    rec = records(spark, sf)
    flags = acquisition.identity_flags(rec, "source").select("conflict")
    return gathers.point_keys(gathers.with_flags(rec, flags), "source", F.col("conflict")).select("record_id", F.col("source_key_id").cast("double").alias("source_key_id"), "source_key_x", "source_key_y")


@query(
    REC
    + """, c AS (SELECT receiver_id FROM rec WHERE has_receiver GROUP BY 1 HAVING count(DISTINCT (receiver_x, receiver_y)) > 1), f AS (SELECT count(*) > 0 AS p FROM c)
SELECT record_id, CAST(CASE WHEN NOT p AND receiver_id <> 0 THEN receiver_id END AS DOUBLE) AS receiver_key_id, CASE WHEN p AND has_receiver THEN receiver_x END AS receiver_key_x, CASE WHEN p AND has_receiver THEN receiver_y END AS receiver_key_y FROM rec, f"""
)
def receiver_keys(spark, sf):
    """The receiver key of every record; its conflict test includes number 0."""
    rec = records(spark, sf)
    flags = acquisition.id_conflicts(rec, "receiver", with_zero=True).agg((F.count(F.lit(1)) > 0).alias("conflict"))
    return gathers.point_keys(gathers.with_flags(rec, flags), "receiver", F.col("conflict")).select("record_id", F.col("receiver_key_id").cast("double").alias("receiver_key_id"), "receiver_key_x", "receiver_key_y")


@query(REC + " SELECT CAST(floor(trace_offset / 20 + 0.5) AS BIGINT) AS bin, floor(trace_offset / 20 + 0.5) * 20 AS centre, (floor(trace_offset / 20 + 0.5) - 0.5) * 20 AS lo, (floor(trace_offset / 20 + 0.5) + 0.5) * 20 AS hi, count(*) AS traces FROM rec WHERE has_offset AND isfinite(trace_offset) GROUP BY 1, 2, 3, 4")
def offset_bins(spark, sf):
    """Common-offset gathers at the default width of 20."""
    return gathers.bin_gathers(records(spark, sf), gathers.offset_bin(), gathers.OFFSET_WIDTH)


@query(REC + " SELECT CAST(floor(azimuth + 0.5) AS BIGINT) AS bin, floor(azimuth + 0.5) AS centre, floor(azimuth + 0.5) - 0.5 AS lo, floor(azimuth + 0.5) + 0.5 AS hi, count(*) AS traces FROM rec WHERE has_azimuth AND isfinite(azimuth) GROUP BY 1, 2, 3, 4")
def azimuth_bins(spark, sf):
    """Azimuth gathers at the default width of one degree, without wrapping."""
    return gathers.bin_gathers(records(spark, sf), gathers.azimuth_bin(), gathers.AZIMUTH_WIDTH)


@query(REC + " SELECT CAST(floor(azimuth / 10 + 0.5) AS BIGINT) AS bin, floor(azimuth / 10 + 0.5) * 10 AS centre, (floor(azimuth / 10 + 0.5) - 0.5) * 10 AS lo, (floor(azimuth / 10 + 0.5) + 0.5) * 10 AS hi, count(*) AS traces FROM rec WHERE has_azimuth AND isfinite(azimuth) GROUP BY 1, 2, 3, 4")
def azimuth_bins_wide(spark, sf):
    """Azimuth gathers ten degrees wide."""
    return gathers.bin_gathers(records(spark, sf), gathers.azimuth_bin(10.0), 10.0)


@query(
    REC
    + """, m AS (SELECT * FROM rec WHERE has_midpoint AND isfinite(midpoint_x) AND isfinite(midpoint_y)), o AS (SELECT min(midpoint_x) AS ox, min(midpoint_y) AS oy FROM m),
b AS (SELECT CAST(floor((midpoint_x - ox) / 50) AS BIGINT) AS bin_i, CAST(floor((midpoint_y - oy) / 50) AS BIGINT) AS bin_j, ox, oy, count(*) AS fold FROM m, o GROUP BY 1, 2, 3, 4)
SELECT bin_i, bin_j, round(ox + (bin_i + 0.5) * 50, 6) AS centre_x, round(oy + (bin_j + 0.5) * 50, 6) AS centre_y, fold FROM b"""
)
def cmp_xy_bins(spark, sf):
    """Square midpoint bins of 50 m from the smallest midpoint."""
    return gathers.cmp_xy_bins(records(spark, sf), 50.0).select("bin_i", "bin_j", r("centre_x"), r("centre_y"), "fold")


@query(REC + " SELECT record_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN has_offset THEN trace_offset END NULLS LAST, trace_number) - 1 AS position FROM rec WHERE source_id <> 0")
def gather_offset_order(spark, sf):
    """Every shot gather in offset order, traces without offset last."""
    return gathers.ordered_gather(records(spark, sf).where("source_id <> 0"), ["source_id"], "offset").select("record_id", "source_id", "position")


_ORDERS = {
    "physical": "",
    "abs_offset": "abs(CASE WHEN has_offset THEN trace_offset END) NULLS LAST,",
    "azimuth": "CASE WHEN has_azimuth THEN azimuth END NULLS LAST,",
    "cmp": "CASE WHEN has_cdp THEN cdp END NULLS LAST,",
    "receiver": "CASE WHEN receiver_id <> 0 THEN receiver_id END NULLS LAST,",
    "common_offset": "CASE WHEN has_offset AND isfinite(trace_offset) THEN floor(trace_offset / 20 + 0.5) END NULLS LAST,",
}


def _order_query(mode: str):
    def f(spark, sf):
        return gathers.ordered_gather(records(spark, sf).where("source_id <> 0"), ["source_id"], mode).select("record_id", "source_id", "position")

    f.__doc__ = f"Every shot gather in the secondary order {mode}."
    QUERIES[f"gather_order_{mode}"] = f
    SQL[f"gather_order_{mode}"] = REC + f" SELECT record_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {_ORDERS[mode]} trace_number) - 1 AS position FROM rec WHERE source_id <> 0"


for _mode in _ORDERS:
    _order_query(_mode)


@query(REC + " SELECT record_id, row_number() OVER (ORDER BY CASE WHEN has_cdp THEN cdp END NULLS LAST, CASE WHEN has_offset THEN trace_offset END NULLS LAST, trace_number) - 1 AS output_order FROM rec")
def gather_two_level_order(spark, sf):
    """All traces by CMP, then offset, then trace number."""
    rec = records(spark, sf).withColumn("k", F.when(F.col("has_cdp"), F.col("cdp")))
    return gathers.two_level(rec, "k", "offset").select("record_id", "output_order")


@query(REC + " SELECT record_id, source_id, row_number() OVER (ORDER BY source_id, trace_number) - 1 AS position FROM rec WHERE source_id IN (1005, 1010, 1011, 1012)")
def gather_multi_key(spark, sf):
    """Several shot gathers at once, of a key expression."""
    rec = records(spark, sf)
    keys = gathers.parse_keys("1005,1010-1012,1005", [1000.0 + i for i in range(200)])
    return gathers.two_level(gathers.select_keys(rec, "source_id", [int(k) for k in keys]), "source_id", "physical").select("record_id", "source_id", F.col("output_order").alias("position"))


@query(REC + " SELECT record_id, trace_number FROM rec WHERE trace_number >= 200 AND trace_number < 600")
def raw_range(spark, sf):
    """Traces 200 to 599 in physical order, of a range given in reverse."""
    return gathers.raw_range(records(spark, sf), 600, 200, 1 << 40).select("record_id", "trace_number")


@query(REC + ", k AS (SELECT DISTINCT source_id AS key FROM rec WHERE source_id <> 0) SELECT key, coalesce(lag(key) OVER (ORDER BY key), key) AS previous, coalesce(lead(key) OVER (ORDER BY key), key) AS next FROM k")
def adjacent_gather(spark, sf):
    """The neighbours of every shot gather."""
    return gathers.adjacent_keys(records(spark, sf).where("source_id <> 0"), "source_id")


@query(REC + " SELECT DISTINCT cdp AS key FROM rec WHERE has_cdp")
def available_gathers(spark, sf):
    """The CMP gathers there are."""
    return records(spark, sf).where("has_cdp").select(F.col("cdp").alias("key")).distinct()


_POINTS = """ SELECT {id} AS id, min_by({k}_x, trace_number) AS x, min_by({k}_y, trace_number) AS y, count(*) AS traces, min(trace_number) AS first_trace, min(CASE WHEN has_offset THEN trace_offset END) AS offset_min, max(CASE WHEN has_offset THEN trace_offset END) AS offset_max
FROM rec WHERE has_{k} AND isfinite({k}_x) AND isfinite({k}_y) AND {where} GROUP BY {by}"""


@query(REC + _POINTS.format(k="receiver", id="receiver_id", where="receiver_id <> 0", by="receiver_id"))
def acquisition_points(spark, sf):
    """Receivers told apart by number, with the traces they recorded."""
    return acquisition.points(records(spark, sf), "receiver", by_place=False)


@query(REC + _POINTS.format(k="source", id="min_by(source_id, trace_number)", where="TRUE", by="source_x, source_y"))
def acquisition_points_by_place(spark, sf):
    """Sources told apart by place."""
    return acquisition.points(records(spark, sf), "source", by_place=True)


@query(REC + " SELECT source_id, receiver_id, count(*) AS traces FROM rec WHERE source_id <> 0 AND receiver_id <> 0 GROUP BY 1, 2")
def source_receiver_links(spark, sf):
    """Which source was recorded by which receiver."""
    return acquisition.links(records(spark, sf))


@query(REC + " SELECT source_id AS id, count(DISTINCT receiver_id) AS n_others, min(receiver_id) AS first_other, max(receiver_id) AS last_other FROM rec WHERE source_id <> 0 AND receiver_id <> 0 GROUP BY 1")
def counterpart_receivers(spark, sf):
    """The receivers of every source."""
    parts = acquisition.counterparts(records(spark, sf), "source", together=16)
    return parts.groupBy("id").agg(F.sum(F.size("others")).alias("n_others"), F.min(F.element_at("others", 1)).alias("first_other"), F.max(F.element_at("others", -1)).alias("last_other"))


@query(
    REC
    + ", p AS (SELECT min_by(source_x, trace_number) AS x, min_by(source_y, trace_number) AS y, min(trace_number) AS first_trace FROM rec WHERE has_source AND isfinite(source_x) AND isfinite(source_y) AND source_id <> 0 GROUP BY source_id), "
    "q AS (SELECT record_id AS qid, receiver_x AS qx, receiver_y AS qy FROM rec WHERE has_receiver AND isfinite(receiver_x) AND isfinite(receiver_y)), j AS (SELECT qid, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS d, first_trace FROM q, p WHERE abs(x - qx) <= 60 AND abs(y - qy) <= 60) "
    "SELECT qid, first_trace, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, first_trace) AS rn FROM j WHERE d <= 60) t WHERE rn = 1"
)
def nearest_point(spark, sf):
    """The source nearest to every receiver position within 60 m."""
    rec = records(spark, sf)
    q = rec.where("has_receiver").select(F.col("record_id").alias("qid"), F.col("receiver_x").alias("x"), F.col("receiver_y").alias("y"))
    return acquisition.nearest_points(q, acquisition.points(rec, "source", by_place=False), 60.0).select("qid", "first_trace", r("distance"))


_FOLD = """ SELECT cmp_a, cmp_b, count(*) AS fold, round(avg(CASE WHEN has_midpoint THEN midpoint_x END), 6) AS mean_x, round(avg(CASE WHEN has_midpoint THEN midpoint_y END), 6) AS mean_y, min(CASE WHEN has_offset AND isfinite(trace_offset) THEN trace_offset END) AS offset_min,
max(CASE WHEN has_offset AND isfinite(trace_offset) THEN trace_offset END) AS offset_max, min(CASE WHEN has_azimuth AND isfinite(azimuth) THEN azimuth END) AS azimuth_min, max(CASE WHEN has_azimuth AND isfinite(azimuth) THEN azimuth END) AS azimuth_max FROM cmp WHERE cmp_a IS NOT NULL GROUP BY 1, 2"""


def _folds(spark, sf):
    rec = records(spark, sf)
    return qc.fold_bins(gathers.cmp_keys(rec, R.uses_grid(rec)).where("cmp_a IS NOT NULL"), ["cmp_a", "cmp_b"])


@query(REC + _CMP + _FOLD)
def fold_bins(spark, sf):
    """Fold, mean midpoint, offset and azimuth range of every common-midpoint gather."""
    return _folds(spark, sf).select("cmp_a", "cmp_b", "fold", r("mean_x"), r("mean_y"), "offset_min", "offset_max", "azimuth_min", "azimuth_max")


@query(REC + _CMP + ", b AS (SELECT count(*) AS fold FROM cmp WHERE cmp_a IS NOT NULL GROUP BY cmp_a, cmp_b) SELECT count(*) AS bins, CAST(sum(fold) AS BIGINT) AS traces, min(fold) AS fold_min, max(fold) AS fold_max, round(avg(fold), 6) AS fold_mean FROM b")
def fold_stats(spark, sf):
    """Smallest, largest and mean fold."""
    return qc.fold_stats(_folds(spark, sf)).select("bins", "traces", "fold_min", "fold_max", r("fold_mean"))


@query(
    REC
    + """ SELECT count(*) AS traces, count(*) FILTER (WHERE NOT header_valid) AS invalid_headers, count(*) FILTER (WHERE source_id = 0) AS missing_ffid, count(*) FILTER (WHERE source_id = 0 OR NOT has_source) AS missing_source,
count(*) FILTER (WHERE receiver_id = 0 OR NOT has_receiver) AS missing_receiver, count(*) FILTER (WHERE NOT has_cdp) AS missing_cdp, count(*) FILTER (WHERE NOT has_offset OR NOT isfinite(trace_offset)) AS missing_offset, count(*) FILTER (WHERE NOT has_azimuth) AS missing_azimuth,
count(*) FILTER (WHERE NOT coordinate_scalar_valid) AS scalar_errors, count(*) FILTER (WHERE header_sample_count <> 1500) AS count_inconsistent, count(*) FILTER (WHERE header_sample_interval_us <> 2000) AS interval_inconsistent,
count(DISTINCT floor(trace_offset / 20 + 0.5)) FILTER (WHERE has_offset AND isfinite(trace_offset)) AS common_offset_bins FROM rec"""
)
def quality_counters(spark, sf):
    """The twelve quality counters of the file."""
    return qc.quality(records(spark, sf), 1500, 2000)


_HIST = """, s AS (SELECT min({v}) AS v0, max({v}) AS v1, CASE WHEN max({v}) > min({v}) THEN 32 ELSE 1 END AS k FROM src WHERE isfinite({v})), w AS (SELECT *, (v1 - v0) / k AS w FROM s WHERE v0 IS NOT NULL),
p AS (SELECT CAST(CASE WHEN w > 0 THEN least(floor(({v} - v0) / w), k - 1) ELSE 0 END AS INTEGER) AS bin, {c} AS c FROM src, w WHERE isfinite({v})), n AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE c) AS nc FROM p GROUP BY bin)
SELECT CAST(g.b AS INTEGER) AS bin, round(v0 + g.b * w, 6) AS lo, round(v0 + (g.b + 1) * w, 6) AS hi, coalesce(n, 0) AS n{extra} FROM w, generate_series(0, 31) g(b) LEFT JOIN n ON n.bin = g.b WHERE g.b < k"""


@query(REC + ", src AS (SELECT * FROM rec WHERE has_offset)" + _HIST.format(v="trace_offset", c="TRUE", extra=""))
def histogram32_offset(spark, sf):
    """Offsets in 32 bins."""
    return qc.histogram(records(spark, sf).where("has_offset"), "trace_offset").select("bin", r("lo"), r("hi"), "n")


@query(REC + ", src AS (SELECT * FROM rec WHERE has_offset)" + _HIST.format(v="trace_offset", c="line = 'SL000001'", extra=", coalesce(nc, 0) AS n_chosen"))
def histogram32_overlay(spark, sf):
    """Offsets in 32 bins, and those of one selection beside."""
    rec = records(spark, sf).where("has_offset").withColumn("chosen", F.col("line") == "SL000001")
    return qc.histogram(rec, "trace_offset", "chosen").select("bin", r("lo"), r("hi"), "n", "n_chosen")


@query(REC + ", src AS (SELECT * FROM rec WHERE has_azimuth)" + _HIST.format(v="azimuth", c="TRUE", extra=""))
def histogram32_azimuth(spark, sf):
    """Azimuths in 32 bins."""
    return qc.histogram(records(spark, sf).where("has_azimuth"), "azimuth").select("bin", r("lo"), r("hi"), "n")


@query(REC + _CMP + ", src AS (SELECT CAST(count(*) AS DOUBLE) AS fold FROM cmp WHERE cmp_a IS NOT NULL GROUP BY cmp_a, cmp_b)" + _HIST.format(v="fold", c="TRUE", extra=""))
def histogram32_fold(spark, sf):
    """Folds in 32 bins."""
    return qc.histogram(_folds(spark, sf), "fold").select("bin", r("lo"), r("hi"), "n")


@query(
    REC
    + """, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE source_id <> 0) AS source, count(*) FILTER (WHERE receiver_id <> 0) AS receiver, count(*) FILTER (WHERE has_cdp) AS cdp, count(*) FILTER (WHERE has_header_offset) AS header_offset FROM rec)
SELECT field, total, present, round(present / total, 6) AS coverage FROM t, (SELECT 'source' AS field, source AS present FROM t UNION ALL SELECT 'receiver', receiver FROM t UNION ALL SELECT 'cdp', cdp FROM t UNION ALL SELECT 'header_offset', header_offset FROM t) u"""
)
def mapping_field_summary(spark, sf):
    """How many traces have each field of the header mapping."""
    fields = {"source": "source_id <> 0", "receiver": "receiver_id <> 0", "cdp": "has_cdp", "header_offset": "has_header_offset"}
    return qc.field_summary(records(spark, sf), fields).select("field", "total", "present", r("coverage"))


@query(REC + " SELECT min(trace_offset) FILTER (WHERE isfinite(trace_offset)) AS lo, max(trace_offset) FILTER (WHERE isfinite(trace_offset)) AS hi, count(trace_offset) FILTER (WHERE isfinite(trace_offset)) AS n FROM rec")
def offset_range(spark, sf):
    """Smallest and largest finite offset."""
    return qc.value_range(records(spark, sf), "trace_offset")


@query(
    REC
    + """, q AS (SELECT count(*) AS traces, count(*) FILTER (WHERE NOT header_valid) AS invalid_headers FROM rec), o AS (SELECT min(trace_offset) AS lo, max(trace_offset) AS hi, count(trace_offset) AS n FROM rec WHERE isfinite(trace_offset))
SELECT 'quality' AS section, 'traces' AS field, CAST(traces AS VARCHAR) AS value FROM q UNION ALL SELECT 'quality', 'invalid_headers', CAST(invalid_headers AS VARCHAR) FROM q UNION ALL SELECT 'offset', 'n', CAST(n AS VARCHAR) FROM o"""
)
def qc_report(spark, sf):
    """Report lines: section, field, value."""
    rec = records(spark, sf)
    quality = qc.report_rows("quality", qc.quality(rec, 1500, 2000).select("traces", "invalid_headers"))
    return quality.unionByName(qc.report_rows("offset", qc.value_range(rec, "trace_offset").select("n")))


_SCALE = "CASE WHEN scalar > 0 THEN {0} * scalar WHEN scalar < 0 THEN {0} / -scalar ELSE {0} END"


@query(f"WITH t AS (SELECT DISTINCT coord_id, x, y, scalar FROM trace_coordinates WHERE valid) SELECT coord_id, round({_SCALE.format('x')}, 6) AS sx, round({_SCALE.format('y')}, 6) AS sy, x <> 0 OR y <> 0 AS located FROM t")
def coordinate_scaling(spark, sf):
    """Recorded coordinate words with their scalar applied, and whether a crooked line would count the trace as located."""
    t = table(spark, sf, "trace_coordinates").where("valid").select("coord_id", "x", "y", "scalar").distinct()
    return t.select("coord_id", F.round(S.scaled("x", "scalar"), 6).alias("sx"), F.round(S.scaled("y", "scalar"), 6).alias("sy"), ((F.col("x") != 0) | (F.col("y") != 0)).alias("located"))


@query("SELECT DISTINCT coord_id, CASE units WHEN 1 THEN 'length' WHEN 2 THEN 'seconds of arc' WHEN 3 THEN 'decimal degrees' WHEN 4 THEN 'degrees, minutes, seconds' ELSE 'unknown' END AS label FROM trace_coordinates")
def code_labels(spark, sf):
    """Coordinate unit codes as words."""
    return table(spark, sf, "trace_coordinates").select("coord_id", S.code_label("units", S.COORDINATE_UNITS).alias("label")).distinct()


_KEYED = REC + """, ks AS (SELECT record_id, CASE WHEN has_offset AND isfinite(trace_offset) THEN 'offset_bin' END AS kind, CAST(floor(trace_offset / 25.0 + 0.5) AS BIGINT) AS k, floor(trace_offset / 25.0 + 0.5) * 25.0 AS value FROM rec
UNION ALL SELECT record_id, CASE WHEN source_id <> 0 THEN 'id' END, source_id, source_id FROM rec UNION ALL SELECT record_id, CASE WHEN inline <> 0 OR crossline <> 0 THEN 'grid' END, inline * 100000 + crossline, NULL FROM rec
UNION ALL SELECT record_id, CASE WHEN has_midpoint AND isfinite(midpoint_x) AND isfinite(midpoint_y) THEN 'cmp_bin' END, CAST(floor(midpoint_x / 50.0) * 1000000 + floor(midpoint_y / 50.0) AS BIGINT), NULL FROM rec)"""


def _all_keys(spark, sf):
    rec = records(spark, sf)
    grid = rec.limit(1).select(F.lit(True).alias("uses_grid"), F.lit(False).alias("source_by_place"), F.lit(False).alias("receiver_by_place"))
    parts = [gathers.primary_keys(rec, "offset", width=25.0), gathers.primary_keys(rec, "shot"), gathers.primary_keys(rec, "cmp", flags=grid), gathers.primary_keys(rec, "cmp", bin_size=50.0, origin=(0.0, 0.0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(_KEYED + " SELECT record_id, kind, CAST(value AS DOUBLE) AS value FROM ks WHERE kind IS NOT NULL")
def gather_key_values(spark, sf):
    """Every record's keys by offset, shot, grid cell and midpoint bin, with what they are as a number."""
    return _all_keys(spark, sf).where("kind IS NOT NULL").select("record.record_id", "kind", gathers.key_value().alias("value"))


@query(_KEYED + ", d AS (SELECT DISTINCT kind, k, CASE kind WHEN 'cmp_bin' THEN 4 WHEN 'grid' THEN 2 ELSE 0 END AS rank FROM ks WHERE kind IS NOT NULL) SELECT kind, count(*) AS keys, min(n) AS first, max(n) AS last FROM (SELECT *, row_number() OVER (ORDER BY rank, k) - 1 AS n FROM d WHERE rank > 0) t GROUP BY 1")
def gather_key_order(spark, sf):
    """Where the keys of each kind stand among all keys in their order: grid cells, then midpoint bins."""
    keys = _all_keys(spark, sf).where("kind IN ('grid', 'cmp_bin')").select(*gathers.KEY_COLUMNS).distinct()
    return numbered(keys, gathers.key_order()).groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("first"), F.max("n").alias("last"))


@query(REC + " SELECT record_id, row_number() OVER (ORDER BY abs(CASE WHEN has_offset THEN trace_offset END) NULLS LAST, trace_number, record_id) - 1 AS output_order FROM rec")
def gather_legacy_order(spark, sf):
    """All records by distance alone, without grouping."""
    rec = records(spark, sf)
    return numbered(rec, [*gathers.secondary_order("abs_offset"), "record_id"], "output_order").select("record_id", "output_order")


@query(REC + ", p AS (SELECT record_id, row_number() OVER (ORDER BY trace_number) - 1 AS position FROM rec WHERE source_id = 1010) SELECT record_id, position FROM p WHERE position BETWEEN 3 AND 9")
def gather_displayed(spark, sf):
    """The traces that a view from 9 back to 3 shows of a shot gather."""
    g = gathers.ordered_gather(gathers.select_keys(records(spark, sf), "source_id", [1010]), ["source_id"])
    return gathers.displayed(g, 9, 3).select("record_id", "position")
