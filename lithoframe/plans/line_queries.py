"""Queries on grids, crooked lines, ranges and clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.functions import scalar as S
from lithoframe.operators import clip, grid, lines
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


# --- grids -------------------------------------------------------------------------------------------
_GRID = REC + ", g AS (SELECT trace_number, inline AS il, crossline AS xl FROM rec WHERE inline IS NOT NULL AND crossline IS NOT NULL AND NOT (inline = 0 AND crossline = 0))"


def _index(spark, sf):
    return grid.grid_index(records(spark, sf))


@query(_GRID + " SELECT trace_number, il, xl, dense_rank() OVER (ORDER BY il) - 1 AS row, dense_rank() OVER (ORDER BY xl) - 1 AS col FROM g")
def grid_index(spark, sf):
    """Rows and columns of every trace on the grid."""
    return _index(spark, sf)


@query(
    _GRID
    + ", s AS (SELECT count(*) AS traces, count(DISTINCT il) AS inlines, count(DISTINCT xl) AS crosslines, count(*) - count(DISTINCT (il, xl)) AS duplicates FROM g) SELECT *, traces >= 4 AND inlines >= 2 AND crosslines >= 2 AS usable, traces >= 4 AND inlines >= 2 AND crosslines >= 2 AND duplicates <= 0.1 * traces AS post_stack FROM s"
)
def grid_summary(spark, sf):
    """Size of the grid, and whether it is post-stack."""
    return grid.grid_summary(_index(spark, sf))


_CELLS = ", c AS (SELECT il, xl, min(trace_number) AS trace_number FROM g GROUP BY 1, 2)"


@query(_GRID + _CELLS + ", l AS (SELECT il FROM c ORDER BY abs(il - 2.5), il LIMIT 1) SELECT trace_number, xl AS across, row_number() OVER (ORDER BY xl) - 1 AS position FROM c WHERE il = (SELECT il FROM l)")
def line_traces(spark, sf):
    """The traces along the inline nearest to 2.5, the lower one at the tie."""
    return grid.line_traces(_index(spark, sf), "il", 2.5)


@query(_GRID + _CELLS + ", l AS (SELECT xl FROM c ORDER BY abs(xl - 5000), xl LIMIT 1) SELECT trace_number, il AS across, row_number() OVER (ORDER BY il) - 1 AS position FROM c WHERE xl = (SELECT xl FROM l)")
def crossline_traces(spark, sf):
    """The traces along the last crossline, of a target beyond the end."""
    return grid.line_traces(_index(spark, sf), "xl", 5000.0)


@query(_GRID + " SELECT min(trace_number) AS trace_number FROM g WHERE il = 2 AND xl = 70")
def trace_at(spark, sf):
    """The first trace of one cell."""
    return grid.trace_at(_index(spark, sf), 2, 70)


@query(
    _GRID
    + """, v AS (SELECT DISTINCT xl AS v, dense_rank() OVER (ORDER BY xl) - 1 AS k FROM g), q AS (SELECT record_id AS qid, cdp / 4.0 AS t FROM rec), e AS (SELECT min(v) AS a, max(v) AS b FROM v),
lo AS (SELECT qid, t, max(v) AS v FROM q, v WHERE v <= t GROUP BY 1, 2), hi AS (SELECT qid, t, min(v) AS v FROM q, v WHERE v >= t GROUP BY 1, 2)
SELECT q.qid, CAST(CASE WHEN lo.v IS NULL OR hi.v IS NULL THEN -1 WHEN q.t - lo.v <= hi.v - q.t THEN lk.k ELSE hk.k END AS INTEGER) AS rank FROM q LEFT JOIN lo ON lo.qid = q.qid LEFT JOIN hi ON hi.qid = q.qid LEFT JOIN v lk ON lk.v = lo.v LEFT JOIN v hk ON hk.v = hi.v"""
)
def nearest_rank(spark, sf):
    """Rank of the crossline nearest to a value of every trace; -1 outside the axis."""
    rec = records(spark, sf)
    ranks = grid.grid_index(rec).select(F.col("xl").alias("value"), F.col("col").alias("rank")).distinct()
    return grid.nearest_rank(ranks, rec.select(F.col("record_id").alias("qid"), (F.col("cdp") / 4.0).alias("target")))


@query(_GRID + " SELECT min(il) AS il0, max(il) + 3 AS il1, min(xl) - 2 AS xl0, max(xl) AS xl1 FROM g")
def grid_bounds_union(spark, sf):
    """The box around the grid and the same grid moved by three inlines and two crosslines."""
    i = _index(spark, sf)
    moved = i.withColumns({"il": F.col("il") + 3, "xl": F.col("xl") - 2})
    return grid.union_bounds(grid.bounds(i), grid.bounds(moved))


@query(REC + " SELECT crossline FROM rec WHERE line = 'SL000000' INTERSECT SELECT crossline FROM rec WHERE line = 'SL000001'")
def axis_intersection(spark, sf):
    """Crosslines that two lines have in common."""
    rec = records(spark, sf)
    return grid.common_values(rec.where("line = 'SL000000'"), rec.where("line = 'SL000001'"), "crossline")


@query(_GRID + " SELECT trace_number, il, xl FROM g WHERE il BETWEEN 1 AND 3 AND xl BETWEEN 20 AND 60")
def traces_in_box(spark, sf):
    """Traces in a box of lines whose ends are reversed."""
    return grid.in_box(_index(spark, sf), (3, 1), (60, 20)).select("trace_number", "il", "xl")


@query(_GRID + ", c AS (SELECT il, xl + 1 AS xl, min(trace_number) AS b_trace FROM g GROUP BY 1, 2) SELECT g.trace_number AS a_trace, c.b_trace, il, xl FROM g JOIN c USING (il, xl)")
def pair_by_cell(spark, sf):
    """Traces of two volumes in the same cell, the first of B; B is A moved by a crossline."""
    i = _index(spark, sf).select("trace_number", "il", "xl")
    return grid.cell_pairs(i, i.withColumn("xl", F.col("xl") + 1))


@query(REC + ", b AS (SELECT crossline + 1 AS crossline, max(trace_number) AS b_trace FROM rec GROUP BY 1) SELECT rec.trace_number AS a_trace, b_trace, rec.crossline AS across FROM rec JOIN b USING (crossline)")
def pair_by_coord(spark, sf):
    """Traces of two lines at the same coordinate, the last of B; B is A moved by one."""
    rec = records(spark, sf).select("trace_number", "crossline")
    b = rec.select("trace_number", (F.col("crossline") + 1).alias("crossline")).groupBy("crossline").agg(F.max("trace_number").alias("b_trace"))
    return rec.join(b, "crossline").select(F.col("trace_number").alias("a_trace"), "b_trace", F.col("crossline").alias("across"))


# --- lines -------------------------------------------------------------------------------------------
_DIST = TRJ + ", st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM trj WINDOW w AS (PARTITION BY line ORDER BY trace)), ds AS (SELECT line, trace, cdp, has_cdp, x, y, sum(d) OVER (PARTITION BY line ORDER BY trace) AS distance FROM st)"


@query(_DIST + " SELECT line, trace, round(distance, 3) AS distance FROM ds")
def trajectory_distance(spark, sf):
    """Running distance along every line."""
    return lines.with_distance(trajectory(spark, sf)).select("line", "trace", r("distance", 3))


@query(_DIST + " SELECT line, count(*) AS traces, round(max(distance), 3) AS length, count(*) >= 2 AND max(distance) > 0 AS usable FROM ds GROUP BY 1")
def line_summary(spark, sf):
    """Traces and length of every line."""
    return lines.line_summary(trajectory(spark, sf)).select("line", "traces", r("length", 3), "usable")


@query(
    _DIST.replace("sum(d) OVER (PARTITION BY line ORDER BY trace) AS distance", "round(sum(d) OVER (PARTITION BY line ORDER BY trace), 4) AS distance")
    + """, e AS (SELECT line, min(distance) AS a, max(distance) AS b FROM ds GROUP BY 1), t AS (SELECT line, q AS qid, a + (b - a) * q / 8.0 AS target FROM e, generate_series(0, 8) g(q)),
m AS (SELECT t.line, qid, target, ds.trace, ds.distance, row_number() OVER (PARTITION BY t.line, qid ORDER BY abs(ds.distance - target), ds.distance, ds.trace) AS rn FROM t JOIN ds ON ds.line = t.line) SELECT line, qid, trace FROM m WHERE rn = 1"""
)
def trace_at_distance(spark, sf):
    """The trace nearest to each of nine even distances of every line."""
    line = lines.with_distance(trajectory(spark, sf)).withColumn("distance", F.round("distance", 4))
    return lines.nearest_along(line, lines.even_targets(line, 9))


@query(TRJ + " SELECT line, trace, round(d2, 4) AS d2 FROM (SELECT line, trace, (x - 3000) * (x - 3000) + (y - 3005000) * (y - 3005000) AS d2, row_number() OVER (PARTITION BY line ORDER BY (x - 3000) * (x - 3000) + (y - 3005000) * (y - 3005000), trace) AS rn FROM trj) t WHERE rn = 1")
def nearest_trace_xy(spark, sf):
    """Every line's trace nearest to one place."""
    return lines.nearest_to_point(trajectory(spark, sf), 3000.0, 3005000.0).select("line", "trace", r("d2", 4))


_MONO = ", c AS (SELECT line, trace, cdp, has_cdp, sign(cdp - lag(cdp) OVER (PARTITION BY line ORDER BY trace)) AS d FROM trj), mo AS (SELECT line, bool_and(coalesce(has_cdp, FALSE)) AND coalesce(min(d), 0) * coalesce(max(d), 0) >= 0 AND (coalesce(min(d), 0) <> 0 OR coalesce(max(d), 0) <> 0) AS monotonic, coalesce(min(d), 0) < 0 AS down FROM c GROUP BY 1)"


@query(TRJ + _MONO + " SELECT line, monotonic, monotonic AND down AS descending FROM mo")
def cdp_monotonic(spark, sf):
    """Whether the CDP numbers of every line run one way."""
    return lines.cdp_monotonic(trajectory(spark, sf))


@query(_DIST + _MONO + " SELECT ds.line, trace, row_number() OVER (PARTITION BY ds.line ORDER BY trace) - 1 AS ordinal, CASE WHEN monotonic THEN CASE WHEN down THEN -cdp ELSE cdp END END::DOUBLE AS cdp_position, round(distance, 3) AS distance FROM ds JOIN mo ON mo.line = ds.line")
def axis_positions(spark, sf):
    """Positions of every trace on the three axes of its line."""
    return lines.axis_positions(trajectory(spark, sf)).select("line", "trace", "ordinal", "cdp_position", r("distance", 3))


_CAND = REC + ", v AS (SELECT 'cdp_xy' AS spec, line, trace_number AS trace, midpoint_x AS x, midpoint_y AS y, has_midpoint AS ok FROM rec UNION ALL SELECT 'source_xy', line, trace_number, source_x, source_y, has_source FROM rec UNION ALL SELECT 'group_xy', line, trace_number, receiver_x, receiver_y, has_receiver FROM rec), " + """
n AS (SELECT spec, line, count(*) AS n, count(*) FILTER (WHERE ok) AS v, count(DISTINCT (x, y)) FILTER (WHERE ok) AS uniques FROM v GROUP BY 1, 2), d0 AS (SELECT spec, line, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM v WHERE ok WINDOW w AS (PARTITION BY spec, line ORDER BY trace)),
d1 AS (SELECT spec, line, d, row_number() OVER (PARTITION BY spec, line ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY spec, line) AS m FROM d0 WHERE d > 0 AND isfinite(d)),
st AS (SELECT spec, line, max(d) FILTER (WHERE r = m // 2) AS median_step, max(d) FILTER (WHERE r = round((m - 1) * 0.95)) AS p95_step, sum(d) AS length FROM d1 GROUP BY 1, 2),
sc AS (SELECT n.spec, n.line, v / n AS valid_ratio, uniques, median_step, p95_step, coalesce(length, 0) AS length, 100 * (0.65 * (v / n) + 0.20 * least(1.0, uniques / 32) + 0.15 * coalesce(greatest(0.0, least(1.0, (10 - p95_step / median_step) / 9)), 0.0)) AS score FROM n LEFT JOIN st USING (spec, line))"""


def _candidates(spark, sf):
    rec = records(spark, sf)
    parts = [rec.select(F.lit(s).alias("spec"), "line", F.col("trace_number").alias("trace"), F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"), F.col(f"has_{p}").alias("ok")) for s, p in (("cdp_xy", "midpoint"), ("source_xy", "source"), ("group_xy", "receiver"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_CAND + " SELECT spec, line, round(valid_ratio, 6) AS valid_ratio, uniques, round(median_step, 6) AS median_step, round(p95_step, 6) AS p95_step, round(length, 3) AS length, round(score, 6) AS score FROM sc")
def coordinate_score(spark, sf):
    """How well each kind of coordinate words describes each line."""
    s = lines.coordinate_score(_candidates(spark, sf))
    return s.select("spec", "line", r("valid_ratio"), "uniques", r("median_step"), r("p95_step"), r("length", 3), r("score"))


@query(_CAND + " SELECT line, spec, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY round(score, 9) DESC, CASE spec WHEN 'cdp_xy' THEN 1 WHEN 'source_xy' THEN 2 ELSE 3 END) AS rn FROM sc WHERE uniques >= 2 AND valid_ratio > 0) t WHERE rn = 1")
def top_candidates(spark, sf):
    """The coordinate words chosen for each line."""
    return lines.pick_coordinates(lines.coordinate_score(_candidates(spark, sf)), ["cdp_xy", "source_xy", "group_xy"]).select("line", "spec", r("score"))


_SHAPE = TRJ + """, d0 AS (SELECT line, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM trj WINDOW w AS (PARTITION BY line ORDER BY trace)),
d1 AS (SELECT line, d, row_number() OVER (PARTITION BY line ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY line) AS m FROM d0 WHERE d > 0), st AS (SELECT line, max(d) FILTER (WHERE r = m // 2) AS med, max(d) FILTER (WHERE r = round((m - 1) * 0.95)) AS p95, sum(d) AS length FROM d1 GROUP BY 1),
e AS (SELECT line, min_by(x, trace) AS x0, min_by(y, trace) AS y0, max_by(x, trace) AS x1, max_by(y, trace) AS y1, count(DISTINCT (x, y)) AS uniques FROM trj GROUP BY 1),
dv AS (SELECT trj.line, max(CASE WHEN x1 = x0 AND y1 = y0 THEN sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) ELSE abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) END) AS deviation FROM trj JOIN e ON e.line = trj.line GROUP BY 1),
sh AS (SELECT e.line, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS chord, deviation, uniques, med, p95, length FROM e JOIN dv ON dv.line = e.line LEFT JOIN st ON st.line = e.line)
SELECT line, round(chord, 3) AS chord, round(deviation, 3) AS deviation, round(CASE WHEN chord > 0 THEN coalesce(length, 0) / chord END, 6) AS sinuosity,
coalesce(uniques >= 8 AND med > 0 AND p95 <= 10 * med AND (coalesce(length / CASE WHEN chord > 0 THEN chord END >= 1.01, TRUE) OR deviation >= greatest(3 * med, 0.005 * length)), FALSE) AS crooked FROM sh"""


@query(_SHAPE)
def crooked_shape(spark, sf):
    """Chord, deviation and sinuosity of every line, and whether it is clearly crooked."""
    line = trajectory(spark, sf)
    scores = lines.coordinate_score(line.select(F.lit("xy").alias("spec"), "line", "trace", "x", "y", F.lit(True).alias("ok"))).drop("spec", "score")
    return lines.crookedness(line, scores).select("line", r("chord", 3), r("deviation", 3), r("sinuosity"), "crooked")


_Q = ", q AS (SELECT DISTINCT line, trace FROM trace_coordinates)"


@query(
    NAV
    + _Q
    + """, s AS (SELECT *, lead(trace) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM nav WINDOW w AS (PARTITION BY line ORDER BY trace))
SELECT q.line, q.trace, round(CASE WHEN q.trace = s.trace THEN x ELSE x + (q.trace - s.trace) / (t1 - s.trace) * (x1 - x) END, 9) AS x, round(CASE WHEN q.trace = s.trace THEN y ELSE y + (q.trace - s.trace) / (t1 - s.trace) * (y1 - y) END, 9) AS y FROM q JOIN s ON s.line = q.line AND (q.trace = s.trace OR (q.trace > s.trace AND q.trace < s.t1))"""
)
def nav_interpolate(spark, sf):
    """The navigation at every recorded trace within its range."""
    q = table(spark, sf, "trace_coordinates").select("line", "trace").distinct()
    return lines.interpolate(q, navigation(spark, sf)).select("line", "trace", r("x", 9), r("y", 9))


@query(NAV + ", d AS (SELECT line, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM nav WINDOW w AS (PARTITION BY line ORDER BY trace)) SELECT line, round(sum(d), 3) AS length FROM d GROUP BY 1")
def navigation_length(spark, sf):
    """Length of every line's navigation."""
    return lines.navigation_length(navigation(spark, sf)).select("line", r("length", 3))


_LINE = ", l AS (SELECT line, trace, min(x) AS x, min(y) AS y FROM trace_coordinates WHERE valid GROUP BY 1, 2)"
_PAIRS = """, sp AS (SELECT line, min(trace) AS t0, max(trace) AS t1 FROM nav GROUP BY 1), ins AS (SELECT l.line, l.trace, l.x, l.y FROM l JOIN sp ON sp.line = l.line WHERE l.trace BETWEEN t0 AND t1),
hit AS (SELECT DISTINCT line, trace FROM (SELECT i.line, i.trace, row_number() OVER (PARTITION BY n.line, n.trace ORDER BY abs(i.trace - n.trace), i.trace) AS rn FROM nav n JOIN ins i ON i.line = n.line) t WHERE rn = 1),
s AS (SELECT *, lead(trace) OVER w AS u1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM nav WINDOW w AS (PARTITION BY line ORDER BY trace)),
pr AS (SELECT i.line, i.x AS hx, i.y AS hy, CASE WHEN i.trace = s.trace THEN s.x ELSE s.x + (i.trace - s.trace) / (u1 - s.trace) * (x1 - s.x) END AS nx, CASE WHEN i.trace = s.trace THEN s.y ELSE s.y + (i.trace - s.trace) / (u1 - s.trace) * (y1 - s.y) END AS ny FROM hit JOIN ins i USING (line, trace) JOIN s ON s.line = i.line AND (i.trace = s.trace OR (i.trace > s.trace AND i.trace < s.u1)))"""


def _cal_line(spark, sf):
    t = table(spark, sf, "trace_coordinates").where("valid").groupBy("line", "trace").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return t.withColumns({"cdp": F.col("trace"), "has_cdp": F.lit(True)})


@query(NAV + _LINE + _PAIRS + " SELECT line, hx, hy, round(nx, 9) AS nx, round(ny, 9) AS ny FROM pr")
def calibration_pairs(spark, sf):
    """Recorded places with the navigation's, at the control points of every line."""
    return lines.calibration_pairs(_cal_line(spark, sf), navigation(spark, sf)).select("line", "hx", "hy", r("nx", 9), r("ny", 9))


_CAL = _PAIRS + """, tr AS (SELECT pr.*, pow(10.0, k)::DOUBLE AS m FROM pr, generate_series(-3, 3) g(k)), oo AS (SELECT line, m, median(nx - hx * m) AS ox, median(ny - hy * m) AS oy, count(*) AS matches FROM tr GROUP BY 1, 2),
nl AS (SELECT line, sum(d) AS length FROM (SELECT line, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM nav WINDOW w AS (PARTITION BY line ORDER BY trace)) t GROUP BY 1),
me AS (SELECT tr.line, m, ox, oy, matches, greatest(5.0, length * CASE WHEN matches = 2 THEN 0.01 ELSE 0.005 END) AS tol, sqrt((hx * m + ox - nx) * (hx * m + ox - nx) + (hy * m + oy - ny) * (hy * m + oy - ny)) AS e FROM tr JOIN oo USING (line, m) JOIN nl USING (line)),
sc AS (SELECT line, m, ox, oy, matches, tol, median(e) AS residual, count(*) FILTER (WHERE e <= tol) AS inliers FROM me GROUP BY 1, 2, 3, 4, 5, 6),
rk AS (SELECT *, row_number() OVER w AS rn, lead(residual) OVER w AS second FROM sc WINDOW w AS (PARTITION BY line ORDER BY residual, inliers DESC, abs(log10(m)))),
cal AS (SELECT line, m, ox, oy, residual, inliers, matches, residual <= tol AND inliers >= greatest(2, ceil(matches / 2)) AND (residual <= 1e-9 OR (second >= 2 * residual AND second - residual >= greatest(1.0, tol * 0.25))) AS accepted FROM rk WHERE rn = 1 AND matches >= 2)"""


@query(NAV + _LINE + _CAL + " SELECT line, round(log10(m)) AS power, round(residual, 3) AS residual, inliers, matches, accepted FROM cal")
def calibration(spark, sf):
    """The power of ten that brings every line's recorded places to its navigation."""
    nav = navigation(spark, sf)
    c = lines.calibrate(lines.calibration_pairs(_cal_line(spark, sf), nav), nav)
    return c.select("line", F.round(F.log10("multiplier")).alias("power"), r("residual", 3), "inliers", "matches", "accepted")


@query(NAV + _LINE + _CAL + " SELECT l.line, l.trace, round(l.x * m + ox, 2) AS x, round(l.y * m + oy, 2) AS y FROM l JOIN cal ON cal.line = l.line WHERE accepted")
def calibrated_lines(spark, sf):
    """Every line with an accepted calibration, in navigation coordinates."""
    nav, line = navigation(spark, sf), _cal_line(spark, sf)
    return lines.apply_calibration(line, lines.calibrate(lines.calibration_pairs(line, nav), nav)).select("line", "trace", r("x", 2), r("y", 2))


@query("WITH f AS (SELECT DISTINCT 'data/' || line || '.sgy' AS file FROM segy_files UNION SELECT DISTINCT 'data/export_' || lower(line) || '.SEGY' FROM segy_files) SELECT file, max(n.line) AS line FROM f JOIN (SELECT DISTINCT line FROM navigation WHERE line IS NOT NULL) n ON lower(file) = 'data/' || lower(n.line) || '.sgy' OR lower(file) = 'data/export_' || lower(n.line) || '.segy' GROUP BY 1")
def navigation_names(spark, sf):
    """The navigation line of every file, by its name or the end of its name."""
    f = table(spark, sf, "segy_files")
    files = f.select(F.concat(F.lit("data/"), "line", F.lit(".sgy")).alias("file")).union(f.select(F.concat(F.lit("data/export_"), F.lower("line"), F.lit(".SEGY")))).distinct()
    return lines.match_line_names(files, table(spark, sf, "navigation").where("line IS NOT NULL").select("line").distinct())


@query(TRJ + ", h AS (SELECT line, trace, md5(trace || ':' || CAST(round(x * 100) AS BIGINT) || ':' || CAST(round(y * 100) AS BIGINT)) AS h FROM trj), k AS (SELECT line, trace // 4096 AS k, md5(string_agg(h, '|' ORDER BY trace)) AS h FROM h GROUP BY 1, 2), m AS (SELECT line, k // 4096 AS m, md5(string_agg(h, '|' ORDER BY k)) AS h FROM k GROUP BY 1, 2) SELECT line, md5(string_agg(h, '|' ORDER BY m)) AS fingerprint FROM m GROUP BY 1")
def geometry_fingerprint(spark, sf):
    """A hash of every line's traces and places."""
    return lines.fingerprint(trajectory(spark, sf))


@query("SELECT line, count(*) AS points, count(*) FILTER (WHERE max_trace >= min_trace) AS ordered FROM (SELECT DISTINCT line, sp, trace, x, y, min_trace, max_trace FROM navigation) t GROUP BY 1")
def parse_navigation(spark, sf):
    """Navigation written as whitespace text and parsed again."""
    n = table(spark, sf, "navigation").distinct()
    text = n.select(F.concat_ws("  ", "line", "sp", "trace", "x", "y", "min_trace", "max_trace", F.lit("# control point")).alias("value"))
    return lines.parse_navigation(text).groupBy("line").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("max_trace") >= F.col("min_trace")).alias("ordered"))


# --- ranges and clipping ------------------------------------------------------------------------------
BOX = (2000.0, 5000.0, 3003000.0, 3007000.0)
_T = "greatest(0.0, {lo}) AS t0, least(1.0, {hi}) AS t1"


@query(REC + " SELECT record_id, greatest(trace_in_field * 10 - 100, 0) AS first, least(trace_in_field * 40, sample_count - 1) AS last FROM rec WHERE trace_in_field * 10 - 100 <= trace_in_field * 40 AND greatest(trace_in_field * 10 - 100, 0) <= least(trace_in_field * 40, sample_count - 1)")
def sample_window(spark, sf):
    """A sample window of every trace, clamped; those outside drop out."""
    w = clip.sample_window(F.col("trace_in_field") * 10 - 100, F.col("trace_in_field") * 40, F.col("sample_count"))
    return records(spark, sf).select("record_id", w.alias("w")).where("w IS NOT NULL").select("record_id", "w.first", "w.last")


@query(
    REC
    + ", w AS (SELECT record_id, greatest(CAST(round((delay_ms + 501.0) / (sample_interval_us / 1000.0)) AS BIGINT), 0) AS first, least(CAST(round((delay_ms + 2999.0) / (sample_interval_us / 1000.0)) AS BIGINT), sample_count - 1) AS last FROM rec) SELECT * FROM w WHERE last > first"
)
def time_window(spark, sf):
    """The samples of a time range given in reverse."""
    w = clip.time_window(F.col("delay_ms") + F.lit(2999.0), F.col("delay_ms") + F.lit(501.0), F.col("sample_interval_us"), F.col("sample_count"))
    return records(spark, sf).select("record_id", w.alias("w")).where("w IS NOT NULL").select("record_id", "w.first", "w.last")


@query(REC + " SELECT record_id, greatest(least(1700, trace_in_field) - 1, 0) AS first, least(greatest(1700, trace_in_field) - 1, sample_count - 1) AS last FROM rec")
def sample_numbers(spark, sf):
    """Sample numbers from 1, in either order, as a window from 0."""
    w = clip.number_range(F.lit(1700), F.col("trace_in_field"), F.col("sample_count"))
    return records(spark, sf).select("record_id", w.alias("w")).select("record_id", "w.first", "w.last")


@query(REC + " SELECT record_id, trace_number FROM rec WHERE trace_number BETWEEN 100 AND 2000 AND (trace_number - 100) % 7 = 0")
def trace_stride(spark, sf):
    """Every seventh trace of a range, as a display asks for it."""
    return clip.stride(records(spark, sf), 100, 2000, 7).select("record_id", "trace_number")


@query(TRJ + ", c AS (SELECT *, x BETWEEN 0 AND 3000 AS inside, count(*) FILTER (WHERE x BETWEEN 0 AND 3000) OVER (PARTITION BY line) AS n FROM trj) SELECT line, trace FROM c WHERE n < 2 OR inside")
def line_coordinate_range(spark, sf):
    """Each line's traces within a range, or the whole line if fewer than two are."""
    return clip.line_range(trajectory(spark, sf), "x", 3000.0, 0.0, "line").select("line", "trace")


_SEG = _DIST + """, sg AS (SELECT line, row_number() OVER w - 1 AS i, lag(trace) OVER w AS ta, trace AS tb, lag(x) OVER w AS ax, lag(y) OVER w AS ay, x AS bx, y AS by_, lag(distance) OVER w AS da, distance AS db FROM ds WINDOW w AS (PARTITION BY line ORDER BY trace)),
s1 AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM sg WHERE i > 0), s2 AS (SELECT *, greatest(0.0, CASE WHEN dx > 1e-15 THEN (2000 - ax) / dx WHEN dx < -1e-15 THEN (5000 - ax) / dx ELSE 0.0 END, CASE WHEN dy > 1e-15 THEN (3003000 - ay) / dy WHEN dy < -1e-15 THEN (3007000 - ay) / dy ELSE 0.0 END) AS t0,
least(1.0, CASE WHEN dx > 1e-15 THEN (5000 - ax) / dx WHEN dx < -1e-15 THEN (2000 - ax) / dx ELSE 1.0 END, CASE WHEN dy > 1e-15 THEN (3007000 - ay) / dy WHEN dy < -1e-15 THEN (3003000 - ay) / dy ELSE 1.0 END) AS t1,
(abs(dx) <= 1e-15 AND (ax < 2000 OR ax > 5000)) OR (abs(dy) <= 1e-15 AND (ay < 3003000 OR ay > 3007000)) AS missed FROM s1), s3 AS (SELECT * FROM s2 WHERE NOT missed AND t0 <= t1)"""


@query(_SEG + " SELECT line, i, round(t0, 9) AS t0, round(t1, 9) AS t1 FROM s3")
def segment_clip(spark, sf):
    """The part of every segment that lies in a rectangle."""
    s = clip.segments(lines.with_distance(trajectory(spark, sf)))
    t = clip.clip_segment(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), BOX)
    return s.select("line", "i", t.alias("t")).where("t IS NOT NULL").select("line", "i", F.round("t.t0", 9).alias("t0"), F.round("t.t1", 9).alias("t1"))


@query(_SEG + " SELECT s1.line, count(s3.i) > 0 AS touches FROM s1 LEFT JOIN s3 ON s3.line = s1.line AND s3.i = s1.i GROUP BY 1")
def lines_in_range(spark, sf):
    """Which lines meet a rectangle at all."""
    return clip.lines_in_range(lines.with_distance(trajectory(spark, sf)), BOX)


_RUNS = _SEG + """, r0 AS (SELECT *, da + (db - da) * t0 AS s, da + (db - da) * t1 AS e, t1 < 1 - 1e-12 AS lft FROM s3 WHERE t1 - t0 > 1e-12),
r1 AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND NOT lag(lft) OVER w AND abs(lag(e) OVER w - s) <= 1e-9 THEN 0 ELSE 1 END AS f FROM r0 WINDOW w AS (PARTITION BY line ORDER BY i)), r2 AS (SELECT *, sum(f) OVER (PARTITION BY line ORDER BY i) AS g FROM r1),
r3 AS (SELECT line, g, min(s) AS s, max(e) AS e, min(ta) AS fs, max(tb) AS ls, count(*) + 1 AS vertices FROM r2 GROUP BY 1, 2 HAVING max(e) - min(s) > 1e-12), runs AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY s, g) - 1 AS run, s, e, fs, ls, vertices FROM r3)"""


def _runs(spark, sf):
    line = lines.with_distance(trajectory(spark, sf))
    return line, clip.clip_runs(line, BOX)


@query(_RUNS + ' SELECT line, run, round(s, 3) AS start, round(e, 3) AS "end", fs AS first_support, ls AS last_support, vertices FROM runs')
def clip_runs(spark, sf):
    """The stretches of every line inside a rectangle, re-entries apart."""
    return _runs(spark, sf)[1].select("line", "run", r("start", 3), r("end", 3), "first_support", "last_support", "vertices")


@query(_RUNS + " SELECT DISTINCT trj.line, trj.trace FROM trj JOIN runs ON runs.line = trj.line AND trj.trace BETWEEN fs AND ls")
def support_plan(spark, sf):
    """The traces that the clipped lines need."""
    return clip.support_traces(*_runs(spark, sf))


@query(_RUNS + ", su AS (SELECT DISTINCT trj.line, trj.trace FROM trj JOIN runs ON runs.line = trj.line AND trj.trace BETWEEN fs AND ls) SELECT line, count(*) AS traces, CAST(251 AS BIGINT) AS samples, 3600 + count(*) * (240 + 251 * 4) AS bytes FROM su GROUP BY 1")
def export_plan(spark, sf):
    """Traces, samples and bytes of every line's cropped export."""
    w = clip.time_window(F.lit(500.0), F.lit(1000.0), F.lit(2000), F.lit(1500))
    return clip.export_plan(*_runs(spark, sf), w)


@query(TRJ + ", k AS (SELECT line, trace, row_number() OVER (PARTITION BY line ORDER BY trace) - 1 AS r, count(*) OVER (PARTITION BY line) AS n FROM trj), w AS (SELECT DISTINCT line, CAST(round(i * (n - 1) / 19.0) AS BIGINT) AS r FROM (SELECT DISTINCT line, n FROM k WHERE n > 20) t, generate_series(0, 19) g(i)) SELECT line, trace FROM k JOIN w USING (line, r) UNION ALL SELECT line, trace FROM k WHERE n <= 20")
def decimate_path(spark, sf):
    """At most twenty traces of every line, evenly spread."""
    return clip.decimate(trajectory(spark, sf), 20)


@query(TRJ + ", k AS (SELECT line, trace, row_number() OVER (PARTITION BY line ORDER BY trace) - 1 AS r, count(*) OVER (PARTITION BY line) AS n FROM trj), w AS (SELECT DISTINCT line, CAST(floor(i * (n - 1) / 95.0) AS BIGINT) AS r FROM (SELECT DISTINCT line, n FROM k WHERE n > 96) t, generate_series(0, 95) g(i)) SELECT line, trace FROM k JOIN w USING (line, r) UNION ALL SELECT line, trace FROM k WHERE n <= 96")
def raster_columns(spark, sf):
    """The traces of 96 raster columns of every line, indices truncated."""
    return clip.decimate(trajectory(spark, sf), 96, truncate=True)


_NAMES = """WITH n AS (SELECT name FROM xy_ranges WHERE name IS NOT NULL UNION SELECT upper(name) FROM xy_ranges WHERE name IS NOT NULL UNION SELECT name || '?.sgy' FROM xy_ranges WHERE name IS NOT NULL UNION SELECT name || '*.SGY' FROM xy_ranges WHERE name IS NOT NULL UNION SELECT range_id || '.dat' FROM xy_ranges),
c AS (SELECT name, CASE WHEN c = '' THEN 'line_' ELSE c END AS c FROM (SELECT name, regexp_replace(regexp_replace(trim(name), '[^\\p{L}\\p{N}._-]+', '_', 'g'), '\\.+$', '') AS c FROM n)), e AS (SELECT *, regexp_extract(c, '(\\.[^.]*)$', 1) AS e, sha256(name) AS h FROM c),
o AS (SELECT *, left(c, length(c) - length(e)) AS stem, CASE WHEN count(*) OVER (PARTITION BY lower(c)) = 1 THEN c ELSE left(c, length(c) - length(e)) || '_' || left(h, 8) || e END AS o FROM e)"""


@query(_NAMES + " SELECT name, CASE WHEN count(*) OVER (PARTITION BY lower(o)) = 1 THEN o ELSE stem || '_' || h || e END AS output, 1 AS of_that_name FROM o")
def output_names(spark, sf):
    """Safe and distinct file names of names that collide, and how many have each of them."""
    t = table(spark, sf, "xy_ranges")
    n = t.where("name IS NOT NULL").select(F.explode(F.array(F.col("name"), F.upper("name"), F.concat("name", F.lit("?.sgy")), F.concat("name", F.lit("*.SGY")))).alias("name"))
    out = clip.safe_names(n.unionByName(t.select(F.concat(F.col("range_id").cast("string"), F.lit(".dat")).alias("name"))), "name")
    return out.join(out.groupBy(F.lower("output").alias("k")).agg(F.count(F.lit(1)).alias("of_that_name")), F.lower("output") == F.col("k")).select("name", "output", "of_that_name")


@query("WITH t AS (SELECT DISTINCT record_id, delay_ms + trace_in_field * 37 AS ms FROM prestack_records) SELECT record_id, CASE WHEN abs(ms) < 1000 THEN CAST(ms AS VARCHAR) || ' ms' ELSE printf('%.3f s', ms / 1000.0) END AS label FROM t")
def time_labels(spark, sf):
    """Times as labels in ms or s."""
    t = table(spark, sf, "prestack_records").select("record_id", (F.col("delay_ms") + F.col("trace_in_field") * 37).alias("ms")).distinct()
    return t.select("record_id", S.time_label("ms").alias("label"))


@query("WITH t AS (SELECT DISTINCT range_id, abs(x_max - x_min) AS span FROM xy_ranges WHERE isfinite(x_max - x_min)), b AS (SELECT range_id, span / 6 AS raw, CASE WHEN span > 0 THEN pow(10.0, floor(log10(CASE WHEN span > 0 THEN span / 6 ELSE 1 END))) END AS base FROM t) SELECT range_id, round(CASE WHEN raw > 0 THEN CASE WHEN raw / base <= 1 THEN base WHEN raw / base <= 2 THEN base * 2 WHEN raw / base <= 5 THEN base * 5 ELSE base * 10 END ELSE 1.0 END, 9) AS step FROM b")
def axis_steps(spark, sf):
    """Round steps for the axis of every rectangle."""
    t = table(spark, sf, "xy_ranges").where("x_max IS NOT NULL AND x_min IS NOT NULL AND NOT isnan(x_max) AND NOT isnan(x_min)").select("range_id", F.abs(F.col("x_max") - F.col("x_min")).alias("span")).distinct()
    return t.where(S.is_finite("span")).select("range_id", F.round(S.nice_step("span", 6), 9).alias("step"))


@query(_DIST + ", k AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY trace) - 1 AS position FROM ds) SELECT k.line, k.trace, k.x, k.y, round(k.distance, 3) AS distance, k.position FROM k JOIN (SELECT DISTINCT line, trace FROM navigation) n ON n.line = k.line AND n.trace = k.trace")
def places_of_traces(spark, sf):
    """Where the traces that navigation names stand on their lines."""
    return lines.places(trajectory(spark, sf), table(spark, sf, "navigation").select("line", "trace")).select("line", "trace", "x", "y", r("distance", 3), "position")


@query(TRJ + " SELECT line, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM trj GROUP BY 1")
def line_bounds(spark, sf):
    """The box around every line."""
    return lines.bounds(trajectory(spark, sf))


@query(_DIST + ", s AS (SELECT line, count(*) >= 2 AND max(distance) > 0 AS usable FROM ds GROUP BY 1), n AS (SELECT line, count(DISTINCT trace) >= 2 AS nav FROM navigation GROUP BY 1) SELECT count(*) AS lines, count(*) FILTER (WHERE usable) AS usable, count(*) FILTER (WHERE nav) AS navigated FROM s LEFT JOIN n USING (line)")
def line_counts(spark, sf):
    """Lines, usable ones, and those with navigation."""
    return lines.count_lines(lines.line_summary(trajectory(spark, sf)), navigation(spark, sf))
