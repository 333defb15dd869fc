"""Queries of panels: rasters of sections, differences, curtains, and picks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators import panels, raster
from lithoframe.plans.views import REC, TRC, records, traces, traces_b

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


# Lines of uneven spacing: the inlines, their traces at growing distances.
_LN = TRC + ", ln AS (SELECT il AS line, trace, (xl - 2000) * 10.0 + (trace % 3) * 2 AS d, samples FROM trc), e AS (SELECT line, min(d) AS a, max(d) AS b FROM ln GROUP BY 1)"
_SIDES = """, l AS (SELECT t.line, t.px, t.p, max(ln.d) AS lp, max_by(ln.trace, ln.d) AS tl, max_by(ln.samples, ln.d) AS sl FROM t JOIN ln ON ln.line = t.line AND ln.d <= t.p GROUP BY 1, 2, 3),
h AS (SELECT t.line, t.px, min(ln.d) AS rp, min_by(ln.trace, ln.d) AS tr, min_by(ln.samples, ln.d) AS sr FROM t JOIN ln ON ln.line = t.line AND ln.d >= t.p GROUP BY 1, 2),
c AS (SELECT line, px, tl, tr, sl, sr, CASE WHEN rp > lp THEN (p - lp) / (rp - lp) ELSE 0 END AS f FROM l JOIN h USING (line, px))"""
_EVEN = ", t AS (SELECT line, px, a + (b - a) * px / 7.0 AS p FROM e, generate_series(0, 7) g(px))"


def _line(spark, sf):
    return traces(spark, sf).select(F.col("il").alias("line"), "trace", ((F.col("xl") - 2000) * 10.0 + (F.col("trace") % 3) * 2).alias("distance"), "samples")


@query(_LN + _EVEN + _SIDES + """, y AS (SELECT py, floor(py * 63 / 4.0) AS y0, py * 63 / 4.0 - floor(py * 63 / 4.0) AS g FROM generate_series(0, 4) s(py)), z AS (SELECT *, CAST(y0 AS INTEGER) + 1 AS i, least(CAST(y0 AS INTEGER) + 2, 64) AS j FROM y)
SELECT line, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round((sl[i] * (1 - g) + sl[j] * g) * (1 - f) + (sr[i] * (1 - g) + sr[j] * g) * f, 6) AS value FROM c, z""")
def position_raster(spark, sf):
    """Every line of uneven spacing on a smooth raster of even positions."""
    line = _line(spark, sf)
    return panels.position_raster(line.select("line", "trace", "distance"), line, 8, 5).select("line", "px", "py", r("value"))


@query(_LN + _EVEN + _SIDES + " SELECT line, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round((CASE WHEN f <= 0.5 THEN sl ELSE sr END)[CAST(round(py * 63 / 4.0) AS INTEGER) + 1], 6) AS value FROM c, generate_series(0, 4) s(py)")
def position_raster_nearest(spark, sf):
    """Every line of uneven spacing, nearest trace and sample."""
    line = _line(spark, sf)
    return panels.position_raster(line.select("line", "trace", "distance"), line, 8, 5, smooth=False).select("line", "px", "py", r("value"))


@query(_LN + ", t AS (SELECT line, px, 20.0 + 55.0 * px / 3.0 AS p FROM e, generate_series(0, 3) g(px))" + _SIDES + " SELECT DISTINCT line, trace FROM (SELECT line, tl AS trace FROM c UNION ALL SELECT line, tr FROM c) u")
def trace_supports(spark, sf):
    """The traces that four positions between 20 m and 75 m of every line need."""
    line = _line(spark, sf).select("line", "trace", "distance")
    bounds = line.select("line").distinct().select("line", F.lit(20.0).alias("start"), F.lit(75.0).alias("end"))
    return panels.trace_support(raster.position_columns(line, 4, bounds))


@query("SELECT CAST(py AS INTEGER) AS py, CAST(floor(py * 63 / 20.0) AS INTEGER) AS top, CAST(least(floor(py * 63 / 20.0) + 1, 63) AS INTEGER) AS bottom, round(py * 63 / 20.0 - floor(py * 63 / 20.0), 9) AS f FROM generate_series(0, 20) g(py)")
def sample_supports(spark, sf):
    """The samples that 21 smooth rows of 64 samples need, with the weight of the lower one."""
    return spark.createDataFrame(panels.sample_support(64, 21, True), "py int, top int, bottom int, f double").select("py", "top", "bottom", r("f", 9))


_PAIRS = TRC + ", p AS (SELECT x.trace, x.xl - 2000 AS k, list_transform(range(1, 65), lambda i: x.samples[i] - y.samples[i]) AS d FROM trc x JOIN trb y USING (trace) WHERE x.il = 1003), q AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS r, count(*) OVER () AS n FROM p)"


def _pairs(spark, sf):
    return traces(spark, sf).where("il = 1003").select(F.col("trace").alias("a_trace"), F.col("trace").alias("b_trace"), (F.col("xl") - 2000).alias("position"))


@query(_PAIRS + " SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(d[CAST(round(py * 63 / 9.0) AS INTEGER) + 1], 6) AS value FROM generate_series(0, 11) a(px), generate_series(0, 9) b(py), q WHERE r = CAST(round(px * (n - 1) / 11.0) AS BIGINT)")
def difference_section(spark, sf):
    """A raster of the difference along one inline."""
    return panels.difference_section(traces(spark, sf), traces_b(spark, sf), _pairs(spark, sf), 12, 10).select("px", "py", r("value"))


@query(_PAIRS + ", v AS (SELECT abs(unnest(d)) AS v FROM q), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM v), m AS (SELECT max(v) FILTER (WHERE k = least(floor(n * 95 / 100), n - 1)) AS m FROM s) SELECT round(-m, 9) AS lo, round(m, 9) AS hi FROM m")
def delta_range(spark, sf):
    """Range around 0 of that difference, 5 % cut off."""
    met = _pairs(spark, sf).join(traces(spark, sf).select(F.col("trace").alias("a_trace"), F.col("samples").alias("a")), "a_trace").join(traces_b(spark, sf).select(F.col("trace").alias("b_trace"), F.col("samples").alias("b")), "b_trace")
    return panels.delta_range(met.select(F.explode(F.zip_with("a", "b", lambda x, y: x - y)).alias("value")), gain=5.0).select(r("lo", 9), r("hi", 9))


@query(TRC + ", v AS (SELECT v FROM smp WHERE il = 1003 UNION ALL SELECT smb.v FROM smb JOIN trc USING (trace) WHERE il = 1003), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM v) SELECT round(max(v) FILTER (WHERE k = least(floor(n * 2 / 100), n - 1)), 9) AS lo, round(max(v) FILTER (WHERE k = least(floor(n * 98 / 100), n - 1)), 9) AS hi FROM s")
def panel_range(spark, sf):
    """One range for the same inline of both volumes."""
    on = traces(spark, sf).where("il = 1003")
    flat = lambda df: df.select(F.explode("samples").alias("value"))
    return panels.panel_range([flat(on), flat(traces_b(spark, sf).join(on.select("trace"), "trace"))], gain=2.0).select(r("lo", 9), r("hi", 9))


@query(TRC + ", w AS (SELECT trace AS row, trace + 20 AS o FROM trc), n AS (SELECT count(*) AS n FROM w) SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(samples[CAST(round(py * 63 / 6.0) AS INTEGER) + 1], 6) AS value FROM generate_series(0, 30) a(px), generate_series(0, 6) b(py), n JOIN w ON w.row = CAST(round(px * (n.n - 1) / 30.0) AS BIGINT) LEFT JOIN trc ON trc.trace = w.o")
def side_section(spark, sf):
    """One side of a comparison whose last rows have none."""
    t = traces(spark, sf)
    rows = t.select(F.col("trace").alias("row"), (F.col("trace") + 20).alias("b_ord"))
    return panels.side_section(rows, t.select(F.col("trace").alias("ord"), "samples"), "b_ord", 31, 7).select("px", "py", r("value"))


@query(TRC + ", k AS (SELECT unnest([40, 7, 99, 7]) AS trace, unnest([0, 1, 2, 3]) AS k) SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(samples[CAST(round(py * 63 / 4.0) AS INTEGER) + 1], 6) AS value FROM generate_series(0, 6) a(px), generate_series(0, 4) b(py), k JOIN trc USING (trace) WHERE k = CAST(round(px * 3 / 6.0) AS BIGINT)")
def listed_section(spark, sf):
    """A raster of a list of traces in its order, one of them twice."""
    return panels.section(traces(spark, sf), 7, 5, traces=[40, 7, 99, 7]).select("px", "py", r("value"))


@query(TRC + ", d AS (SELECT smp.trace, smp.sample, smp.il, smp.xl, CAST(smp.v - smb.v AS DOUBLE) AS d, CAST(smp.v AS FLOAT) - CAST(smb.v AS FLOAT) AS fd FROM smp JOIN smb USING (trace, sample)), i AS (SELECT 'inline' AS panel, xl - 2000 AS k, sample, d FROM d WHERE il = 1003 UNION ALL SELECT 'crossline', il - 1000, sample, d FROM d WHERE xl = 2004), "
       "q AS (SELECT *, dense_rank() OVER (PARTITION BY panel ORDER BY k) - 1 AS r, max(k) OVER (PARTITION BY panel) AS m FROM i), n AS (SELECT panel, count(DISTINCT k) AS n FROM i GROUP BY 1), v AS (SELECT panel, px, py, d FROM generate_series(0, 9) a(px), generate_series(0, 5) b(py), q JOIN n USING (panel) WHERE r = CAST(round(px * (n - 1) / 9.0) AS BIGINT) AND sample = CAST(round(py * 63 / 5.0) AS BIGINT)) "
       "SELECT panel, count(*) AS pixels, round(sum(abs(d)), 5) AS total FROM v GROUP BY 1")
def residual_panels(spark, sf):
    """The inline and the crossline panel of a difference of volumes."""
    a = traces(spark, sf)
    b = traces_b(spark, sf).join(a.select("trace", "il", "xl"), "trace")
    out, _ = panels.residual_panels(a, b, 1003.2, 2003.9, 7, 10, 6)
    both = out["inline"].withColumn("panel", F.lit("inline")).unionByName(out["crossline"].withColumn("panel", F.lit("crossline")))
    return both.groupBy("panel").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum(F.abs("value")), 5).alias("total"))


_XY = TRC + ", ln AS (SELECT il AS line, trace, (xl - 2000) * 10.0 AS d, samples FROM trc), e AS (SELECT line, min(d) AS a, max(d) AS b FROM ln GROUP BY 1), e2 AS (SELECT line, greatest(a, 35.0) AS a, least(b, 155.0) AS b FROM e WHERE b > 35), t AS (SELECT line, px, a + (b - a) * px / 6.0 AS p FROM e2, generate_series(0, 6) g(px))"


@query(_XY + _SIDES + " SELECT CAST(line AS BIGINT) AS line, 0 AS run, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(CASE py WHEN 0 THEN sl[1] * (1 - f) + sr[1] * f ELSE sl[64] * (1 - f) + sr[64] * f END, 6) AS value FROM c, generate_series(0, 1) s(py)")
def curtain_rasters(spark, sf):
    """Curtains of the inlines, straight lines along x, between x = 35 and x = 155."""
    t = traces(spark, sf)
    line = t.select(F.col("il").alias("line"), "trace", ((F.col("xl") - 2000) * 10.0).alias("x"), (F.col("il") * 1.0).alias("y"))
    _, drawn = panels.curtains(line, t.select(F.col("il").alias("line"), "trace", "samples"), (35.0, 155.0, -1e9, 1e9), 7, 2)
    return drawn.select(F.col("line").cast("bigint").alias("line"), "run", "px", "py", r("value"))


@query("SELECT 'line' AS panel, 1003 AS il, 2007 AS xl, 1003 - 1000 AS il_no, 82 AS trace, 82 AS other_trace, 12 AS sample UNION ALL SELECT 'slice', 1002, 2011, 2, 61, 61, -1")
def picked_places(spark, sf):
    """The traces under a place of a section's difference and of a time slice's."""
    i = traces(spark, sf).select(F.col("trace").alias("trace_number"), "il", "xl")
    on = panels.pick_on_line(i, "il", 1003.4, 2007.5, 11.6, 64, other=i).withColumn("panel", F.lit("line"))
    at = panels.pick_on_slice(i, 1002.4, 2011.2, other=i).withColumns({"panel": F.lit("slice"), "sample": F.lit(-1)})
    return on.unionByName(at).select("panel", "il", "xl", (F.col("il") - 1000).alias("il_no"), "trace", "other_trace", "sample")


@query(REC + ", n AS (SELECT line, count(*) AS t, max(sample_count) AS s FROM rec GROUP BY 1), z AS (SELECT line, s, greatest(2, least(t, 1024)) AS w, greatest(2, least(s, 1536)) AS h FROM n), k AS (SELECT line, s, greatest(2, floor(w * least(1.0, sqrt(500000.0 / (w * h))))) AS w, greatest(2, floor(h * least(1.0, sqrt(500000.0 / (w * h))))) AS h FROM z) "
       "SELECT line, CAST(w AS BIGINT) AS width, CAST(greatest(2, least(CASE WHEN 301 < s THEN ceil(h * 301 / s) ELSE h END, 301, 1536)) AS BIGINT) AS height FROM k")
def window_textures(spark, sf):
    """Texture size of every line for a window of 301 samples."""
    n = records(spark, sf).groupBy("line").agg(F.count(F.lit(1)).alias("t"), F.max("sample_count").alias("s"))
    z = n.select("line", "s", raster.texture_size(F.col("t"), F.col("s"), 2_000_000, 4).alias("z"))
    w = z.select("line", panels.window_texture_size(F.col("z"), F.col("s"), F.lit(301)).alias("w"))
    return w.select("line", F.col("w.width").cast("bigint").alias("width"), "w.height")
