"""Queries on sampled traces: statistics, spectra, gain, slices, rasters; and A/B matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.operators import lines, match, numeric, raster
from lithoframe.plans.views import REC, TRC, TRJ, records, traces, traces_b, trajectory

QUERIES, SQL = {}, {}
DT_US = 2000.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# Samples with some that aren't finite, so that their rules show.
_HOLES = TRC + ", hol AS (SELECT trace, sample, CASE WHEN (trace + sample) % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN (trace + sample) % 13 = 0 THEN 0.0 ELSE v END AS v FROM smp)"


def _holes(spark, sf):
    t = traces(spark, sf)
    return t.withColumn("samples", F.transform("samples", lambda v, i: F.when((F.col("trace") + i) % 17 == 0, F.lit(float("nan"))).when((F.col("trace") + i) % 13 == 0, F.lit(0.0)).otherwise(v)))


@query(
    _HOLES
    + """, f AS (SELECT * FROM hol WHERE isfinite(v)), p AS (SELECT trace, count(*) AS finite, count(*) FILTER (WHERE v = 0) AS zeros, min(v) AS minimum, max(v) AS maximum, avg(v) AS mean, sqrt(avg(v * v)) AS rms, stddev_pop(v) AS std, max(abs(v)) AS peak,
quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM f GROUP BY 1)
SELECT trace, 64 AS n, finite, zeros, round(finite / 64, 6) AS finite_ratio, round(zeros / finite, 6) AS zero_ratio, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(mean, 6) AS mean, round(rms, 6) AS rms, round(std, 6) AS std, round(peak, 6) AS peak,
round(p01, 6) AS p01, round(p05, 6) AS p05, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM p"""
)
def trace_stats(spark, sf):
    """Statistics of every trace's finite samples."""
    s = numeric.trace_stats(_holes(spark, sf))
    return s.select("trace", "n", "finite", "zeros", *(r(c) for c in s.columns[4:]))


@query(_HOLES + " SELECT trace, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM hol WHERE isfinite(v) GROUP BY 1")
def finite_percentile(spark, sf):
    """Linear quartiles of every trace."""
    s = F.sort_array(numeric.finite_only("samples"))
    return _holes(spark, sf).select("trace", F.round(numeric.percentile_of(s, 25), 6).alias("p25"), F.round(numeric.percentile_of(s, 75), 6).alias("p75"))


@query(_HOLES + ", g AS (SELECT trace, sqrt(avg(v * v)) AS g FROM hol WHERE isfinite(v) GROUP BY 1) SELECT h.trace, h.sample, round(h.v / g.g, 6) AS v FROM hol h JOIN g USING (trace) WHERE isfinite(h.v)")
def agc(spark, sf):
    """Every trace over its root mean square."""
    e = _holes(spark, sf).select("trace", F.posexplode(numeric.agc("samples")).alias("sample", "v"))
    return e.where("NOT isnan(v)").select("trace", "sample", r("v"))


@query(TRC + " SELECT smp.trace, smp.sample, round(smp.v - smb.v, 6) AS v FROM smp JOIN smb USING (trace, sample)")
def difference(spark, sf):
    """A less B, sample by sample."""
    d = traces(spark, sf).join(traces_b(spark, sf).withColumnRenamed("samples", "other"), "trace").select("trace", numeric.difference("samples", "other").alias("d"))
    return d.select("trace", F.posexplode("d").alias("sample", "v")).select("trace", "sample", r("v"))


@query(_HOLES + " SELECT trace, round(-max(abs(v)), 6) AS lo, round(max(abs(v)), 6) AS hi FROM hol WHERE isfinite(v) GROUP BY 1")
def symmetric_range(spark, sf):
    """Range around 0 of every trace."""
    return _holes(spark, sf).select("trace", numeric.symmetric_range("samples").alias("s")).select("trace", F.round("s.lo", 6).alias("lo"), F.round("s.hi", 6).alias("hi"))


@query(_HOLES + " SELECT trace, round(max(abs(v)), 6) AS peak, round(greatest(abs(quantile_cont(v, 0.01)), abs(quantile_cont(v, 0.99))), 6) AS robust FROM hol WHERE isfinite(v) GROUP BY 1")
def visual_scale(spark, sf):
    """Peak and robust scale of every trace."""
    return _holes(spark, sf).select("trace", F.round(numeric.visual_scale("samples"), 6).alias("peak"), F.round(numeric.visual_scale("samples", True), 6).alias("robust"))


@query(
    _HOLES
    + ", u AS (SELECT *, sum(CASE WHEN isfinite(v) THEN 0 ELSE 1 END) OVER (PARTITION BY trace ORDER BY sample) AS run FROM hol) SELECT trace, CAST(sample * 10 // 64 AS INTEGER) AS row, CAST(run AS BIGINT) AS run, round(min_by(v, sample), 6) AS first, round(max_by(v, sample), 6) AS last, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM u WHERE isfinite(v) GROUP BY 1, 2, 3"
)
def waveform_envelope(spark, sf):
    """Every trace's waveform on ten rows."""
    e = numeric.envelope(_holes(spark, sf), 10)
    return e.select("trace", "row", "run", r("first"), r("last"), r("lo"), r("hi"))


# A plain transform of 64 samples, by sines and cosines of all 33 frequencies.
_DFT = TRC + """, mn AS (SELECT trace, avg(v) AS m FROM smp GROUP BY 1), w AS (SELECT smp.trace, sample, (v - m) * (0.5 - 0.5 * cos(2 * pi() * sample / 63)) AS v FROM smp JOIN mn USING (trace)),
ft AS (SELECT trace, k AS bin, sqrt(sum(v * cos(2 * pi() * k * sample / 64)) ** 2 + sum(v * sin(2 * pi() * k * sample / 64)) ** 2) AS amplitude FROM w, generate_series(0, 32) g(k) GROUP BY 1, 2), tp AS (SELECT trace, max(amplitude) AS top FROM ft WHERE bin > 0 GROUP BY 1)"""


@query(_DFT + " SELECT trace, CAST(bin AS INTEGER) AS bin, round(bin * 500000.0 / 64 / 1000, 6) AS frequency, round(amplitude, 6) AS amplitude, round(greatest(-80, 20 * log10(greatest(amplitude, 1e-300) / top)), 4) AS db FROM ft JOIN tp USING (trace)")
def trace_spectrum(spark, sf):
    """Amplitude spectrum of every trace."""
    s = numeric.spectra(traces(spark, sf), DT_US)
    return s.select("trace", "bin", r("frequency"), r("amplitude"), r("db", 4))


_MEAN = _DFT + ", me AS (SELECT bin, avg(amplitude) AS amplitude FROM ft GROUP BY 1), tm AS (SELECT max(amplitude) AS top FROM me WHERE bin > 0)"


@query(_MEAN + " SELECT CAST(bin AS INTEGER) AS bin, round(bin * 500.0 / 64, 6) AS frequency, round(amplitude, 6) AS amplitude, round(greatest(-80, 20 * log10(amplitude / top)), 5) AS db FROM me, tm")
def mean_spectrum(spark, sf):
    """Mean amplitude spectrum of all traces."""
    m = numeric.mean_spectrum(numeric.spectra(traces(spark, sf), DT_US))
    return m.select("bin", r("frequency"), r("amplitude"), r("db", 5))


@query(
    _MEAN
    + """, wb AS (SELECT trace, sample, (v - avg(v) OVER (PARTITION BY trace)) * (0.5 - 0.5 * cos(2 * pi() * sample / 63)) AS v FROM smb), fb AS (SELECT trace, k AS bin, sqrt(sum(v * cos(2 * pi() * k * sample / 64)) ** 2 + sum(v * sin(2 * pi() * k * sample / 64)) ** 2) AS amplitude FROM wb, generate_series(0, 32) g(k) GROUP BY 1, 2),
mb AS (SELECT bin, avg(amplitude) AS amplitude FROM fb GROUP BY 1), tb AS (SELECT max(amplitude) AS top FROM mb WHERE bin > 0)
SELECT CAST(me.bin AS INTEGER) AS bin, round(me.bin * 500.0 / 64, 6) AS frequency, round(greatest(-80, 20 * log10(me.amplitude / tm.top)) - greatest(-80, 20 * log10(mb.amplitude / tb.top)), 5) AS db FROM me JOIN mb USING (bin), tm, tb"""
)
def spectrum_difference(spark, sf):
    """Mean spectrum of A less that of B, in decibels."""
    a, b = (numeric.mean_spectrum(numeric.spectra(t, DT_US)) for t in (traces(spark, sf), traces_b(spark, sf)))
    return numeric.spectrum_difference(a, b).select("bin", r("frequency"), r("db", 5))


# --- slices and rasters -------------------------------------------------------------------------------
@query(TRC + " SELECT il, xl, CAST(v AS FLOAT) AS value FROM smp WHERE sample = 7")
def time_slice(spark, sf):
    """Sample 7 of every trace."""
    return raster.time_slice(traces(spark, sf), 7)


@query(TRC + ", e AS (SELECT min(il) AS a, max(il) AS b, min(xl) AS c, max(xl) AS d FROM trc) SELECT CAST(round((xl - c) * 9 / (d - c)) AS INTEGER) AS px, CAST(round((il - a) * 7 / (b - a)) AS INTEGER) AS py, round(avg(CAST(CAST(v AS FLOAT) AS DOUBLE)), 6) AS value FROM smp, e WHERE sample = 7 GROUP BY 1, 2")
def raster_time_slice(spark, sf):
    """A time slice on a raster of 10 x 8 pixels, averaged."""
    return raster.slice_splat(raster.time_slice(traces(spark, sf), 7), 10, 8).select("px", "py", r("value"))


@query(
    TRC
    + ", rx AS (SELECT xl, dense_rank() OVER (ORDER BY xl) - 1 AS r FROM (SELECT DISTINCT xl FROM trc) t), ri AS (SELECT il, dense_rank() OVER (ORDER BY il) - 1 AS r FROM (SELECT DISTINCT il FROM trc) t), nx AS (SELECT count(*) AS n FROM rx), ni AS (SELECT count(*) AS n FROM ri), "
    "cx AS (SELECT p AS px, xl FROM generate_series(0, 39) g(p), nx JOIN rx ON rx.r = round(p * (n - 1) / 39.0)), cy AS (SELECT p AS py, il FROM generate_series(0, 29) g(p), ni JOIN ri ON ri.r = round(p * (n - 1) / 29.0)) SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, CAST(v AS FLOAT) AS value FROM smp JOIN cx USING (xl) JOIN cy USING (il) WHERE sample = 7"
)
def raster_slice_nearest(spark, sf):
    """A time slice on a raster of 40 x 30 pixels, by the nearest lines."""
    return raster.slice_nearest(raster.time_slice(traces(spark, sf), 7), 40, 30)


@query(TRC + ", n AS (SELECT count(*) AS n FROM trc), k AS (SELECT trace, samples, row_number() OVER (ORDER BY trace) - 1 AS r FROM trc) SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(samples[CAST(round(py * 63 / 31.0) AS INTEGER) + 1], 6) AS value FROM generate_series(0, 79) a(px), n, generate_series(0, 31) b(py), k WHERE k.r = CAST(round(px * (n.n - 1) / 79.0) AS BIGINT)")
def nearest_raster(spark, sf):
    """All traces on a raster of 80 x 32 pixels, nearest samples."""
    return raster.nearest_raster(traces(spark, sf), 80, 32).select("px", "py", r("value"))


@query(
    TRC
    + """, n AS (SELECT count(*) AS n FROM trc), k AS (SELECT trace, samples, row_number() OVER (ORDER BY trace) - 1 AS r FROM trc), c AS (SELECT px, px * (n - 1) / 79.0 AS p, n FROM generate_series(0, 79) g(px), n),
q AS (SELECT px, py, p - floor(p) AS f, py * 63 / 99.0 AS y, a.samples AS l, b.samples AS h FROM c JOIN k a ON a.r = floor(p) JOIN k b ON b.r = least(floor(p) + 1, n - 1), generate_series(0, 99) g(py)), z AS (SELECT px, py, f, y - floor(y) AS g, CAST(floor(y) AS INTEGER) + 1 AS i, least(CAST(floor(y) AS INTEGER) + 2, 64) AS j, l, h FROM q)
SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round((l[i] * (1 - g) + l[j] * g) * (1 - f) + (h[i] * (1 - g) + h[j] * g) * f, 6) AS value FROM z"""
)
def bilinear_raster(spark, sf):
    """All traces on a smooth raster of 80 x 100 pixels."""
    return raster.bilinear_raster(traces(spark, sf), 80, 100).select("px", "py", r("value"))


def _samples(spark, sf):
    return traces(spark, sf).select("trace", F.posexplode("samples").alias("sample", "v"))


_ORDER = ", so AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM smp), ra AS (SELECT max(v) FILTER (WHERE k = least(floor(n * 10 / 100), n - 1)) AS lo, max(v) FILTER (WHERE k = least(floor(n * 90 / 100), n - 1)) AS hi FROM so)"


@query(TRC + _ORDER + " SELECT round(lo, 9) AS lo, round(hi, 9) AS hi FROM ra")
def gain_range(spark, sf):
    """Order statistics that cut 10 % off either end of all samples."""
    return raster.order_range(_samples(spark, sf), "v", 10.0).select(r("lo", 9), r("hi", 9))


@query(TRC + _ORDER + " SELECT trace, sample, CAST(greatest(0, least(255, round((hi - v) / (hi - lo) * 255))) AS INTEGER) AS idx FROM smp, ra")
def palette_index(spark, sf):
    """Palette index of every sample within that range; 0 is the top."""
    s = _samples(spark, sf)
    return raster.palette(s, "v", raster.order_range(s, "v", 10.0)).select("trace", "sample", "idx")


def _slices(spark, sf):
    a = traces(spark, sf)
    return raster.time_slice(a, 7), raster.time_slice(traces_b(spark, sf).join(a.select("trace", "il", "xl"), "trace"), 7)


@query(TRC + ", u AS (SELECT CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM smp WHERE sample = 7 UNION ALL SELECT CAST(CAST(v AS FLOAT) AS DOUBLE) FROM smb WHERE sample = 7), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM u) SELECT round(max(v) FILTER (WHERE k = least(floor(n * 2 / 100), n - 1)), 9) AS lo, round(max(v) FILTER (WHERE k = least(floor(n * 98 / 100), n - 1)), 9) AS hi FROM s")
def shared_slice_range(spark, sf):
    """One range for the same time slice of both volumes."""
    a, b = _slices(spark, sf)
    return raster.shared_range(a, b, 2.0).select(r("lo", 9), r("hi", 9))


@query(TRC + " SELECT round(-max(abs(smp.v - smb.v)), 6) AS lo, round(max(abs(smp.v - smb.v)), 6) AS hi FROM smp JOIN smb USING (trace, sample) WHERE sample = 7")
def residual_range(spark, sf):
    """Range around 0 of the difference of two time slices."""
    a, b = _slices(spark, sf)
    d = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), ["il", "xl"]).select((F.col("va").cast("double") - F.col("vb").cast("double")).alias("value"))
    return raster.residual_range(d).select(r("lo"), r("hi"))


@query(TRC + " SELECT smp.xl - 2000 AS px, smp.il - 1000 AS py, CAST(CAST(smp.v AS FLOAT) - CAST(smb.v AS FLOAT) AS FLOAT) AS value FROM smp JOIN smb USING (trace, sample) WHERE sample = 7")
def raster_difference(spark, sf):
    """Difference of two time slices, pixel by pixel, in single precision."""
    a, b = (s.select((F.col("xl") - 2000).alias("px"), (F.col("il") - 1000).alias("py"), "value") for s in _slices(spark, sf))
    return raster.raster_difference(a, b)


@query(TRC + ", u AS (SELECT v FROM smp WHERE il = 1003 UNION ALL SELECT v FROM smp WHERE xl = 2004 UNION ALL SELECT CAST(CAST(v AS FLOAT) AS DOUBLE) FROM smp WHERE sample = 7), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM u) SELECT round(max(v) FILTER (WHERE k = least(floor(n * 1.5 / 100), n - 1)), 9) AS lo, round(max(v) FILTER (WHERE k = least(floor(n * 98.5 / 100), n - 1)), 9) AS hi FROM s")
def orthogonal_slice_range(spark, sf):
    """One range for an inline, a crossline and a time slice."""
    t = traces(spark, sf)
    flat = lambda df: df.select(F.explode("samples").alias("value"))
    return raster.orthogonal_range([flat(t.where("il = 1003")), flat(t.where("xl = 2004")), raster.time_slice(t, 7)], 1.0, 99.0).select(r("lo", 9), r("hi", 9))


@query(TRC + " SELECT smp.trace, count(*) AS n, round(sum(abs(smp.v - smb.v)), 5) AS total FROM smp JOIN smb USING (trace, sample) WHERE smp.il = 1003 GROUP BY 1")
def section_difference(spark, sf):
    """A less B along one inline."""
    d = raster.section_difference(traces(spark, sf).where("il = 1003"), traces_b(spark, sf))
    return d.select("trace", F.size("samples").cast("bigint").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + F.abs(v)), 5).alias("total"))


@query(
    TRJ
    + """, st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM trj WINDOW w AS (PARTITION BY line ORDER BY trace)), ds AS (SELECT line, trace, round(sum(d) OVER (PARTITION BY line ORDER BY trace), 4) AS p FROM st), e AS (SELECT line, min(p) AS a, max(p) AS b FROM ds GROUP BY 1),
t AS (SELECT line, px, a + (b - a) * px / 15.0 AS p FROM e, generate_series(0, 15) g(px)), l AS (SELECT t.line, px, t.p, max_by(trace, (ds.p, trace)) AS trace_l, max(ds.p) AS lp FROM t JOIN ds ON ds.line = t.line AND ds.p <= t.p GROUP BY 1, 2, 3), h AS (SELECT t.line, px, min_by(trace, (ds.p, trace)) AS trace_r, min(ds.p) AS rp FROM t JOIN ds ON ds.line = t.line AND ds.p >= t.p GROUP BY 1, 2)
SELECT l.line, CAST(l.px AS INTEGER) AS px, trace_l, coalesce(trace_r, trace_l) AS trace_r, round(CASE WHEN rp > lp THEN (p - lp) / (rp - lp) ELSE 0 END, 5) AS f FROM l LEFT JOIN h ON h.line = l.line AND h.px = l.px"""
)
def position_columns(spark, sf):
    """The traces on either side of sixteen even positions of every line, with the weight of the right one."""
    line = lines.with_distance(trajectory(spark, sf)).withColumn("distance", F.round("distance", 4))
    return raster.position_columns(line, 16).select("line", "px", "trace_l", "trace_r", r("f", 5))


@query(REC + ", n AS (SELECT line, count(*) AS t, max(sample_count) AS s FROM rec GROUP BY 1), z AS (SELECT line, greatest(2, least(t, 1024)) AS w, greatest(2, least(s, 1536)) AS h FROM n) SELECT line, CAST(greatest(2, floor(w * least(1.0, sqrt(500000.0 / (w * h))))) AS BIGINT) AS width, CAST(greatest(2, floor(h * least(1.0, sqrt(500000.0 / (w * h))))) AS BIGINT) AS height FROM z")
def texture_sizes(spark, sf):
    """Texture size of every line under a byte budget."""
    n = records(spark, sf).groupBy("line").agg(F.count(F.lit(1)).alias("t"), F.max("sample_count").alias("s"))
    z = n.select("line", raster.texture_size(F.col("t"), F.col("s"), 2_000_000, 4).alias("z"))
    return z.select("line", F.col("z.width").cast("bigint").alias("width"), F.col("z.height").cast("bigint").alias("height"))


# --- A/B matching -------------------------------------------------------------------------------------
# B is the same survey, sent again with other trace numbers: some numbers and places changed, some traces doubled, some left out.
# Of a few the places are those of one trace and midpoint and offset those of a neighbour: two A's want them.
_BCOLS = "record_id, line, trace_number, source_id, receiver_id, cdp, source_x, source_y, receiver_x, receiver_y, has_source, has_receiver, trace_offset, has_cdp, has_offset, header_valid, header_error"
_META_SQL = ", inline, crossline, midpoint_x, midpoint_y, header_offset, computed_offset, azimuth"
_AB = REC + f""", a AS (SELECT record_id AS ord, * FROM rec), b AS (SELECT record_id + 100000000 AS ord, record_id, line, trace_number, CASE WHEN record_id % 19 = 0 THEN source_id + 50000 ELSE source_id END AS source_id, receiver_id, cdp, source_x, source_y, CASE WHEN record_id % 23 = 0 THEN receiver_x + 1 ELSE receiver_x END AS receiver_x, receiver_y,
has_source, has_receiver, trace_offset, has_cdp, has_offset, header_valid, header_error{_META_SQL} FROM rec WHERE record_id % 7 <> 0 AND record_id % 31 NOT IN (5, 6, 15, 16) UNION ALL SELECT record_id + 200000000, {_BCOLS}{_META_SQL} FROM rec WHERE record_id % 41 = 0 AND record_id % 7 <> 0 AND record_id % 31 NOT IN (5, 6, 15, 16)
UNION ALL SELECT r.record_id + 300000000, r.record_id, r.line, r.trace_number, 0, 0, q.cdp, r.source_x, r.source_y, r.receiver_x, r.receiver_y, r.has_source, r.has_receiver, q.trace_offset, q.has_cdp, q.has_offset, r.header_valid, r.header_error, r.inline, r.crossline, r.midpoint_x, r.midpoint_y, r.header_offset, r.computed_offset, r.azimuth FROM rec r JOIN rec q ON q.record_id = r.record_id + CASE WHEN r.record_id % 31 = 5 THEN 1 ELSE -1 END WHERE r.record_id % 31 IN (5, 16)),
al AS (SELECT 'a' AS side, ord, source_id, receiver_id, source_x, source_y, receiver_x, receiver_y, has_source, has_receiver, cdp, has_cdp, trace_offset, has_offset, header_valid, header_error FROM a UNION ALL SELECT 'b', ord, source_id, receiver_id, source_x, source_y, receiver_x, receiver_y, has_source, has_receiver, cdp, has_cdp, trace_offset, has_offset, header_valid, header_error FROM b)"""


def _ab(spark, sf):
    rec = records(spark, sf)
    a = rec.withColumn("ord", F.col("record_id"))
    plain = rec.where("record_id % 31 NOT IN (5, 6, 15, 16)")
    b = plain.where("record_id % 7 <> 0").withColumns({"ord": F.col("record_id") + 100_000_000, "source_id": F.when(F.col("record_id") % 19 == 0, F.col("source_id") + 50_000).otherwise(F.col("source_id")), "receiver_x": F.when(F.col("record_id") % 23 == 0, F.col("receiver_x") + 1).otherwise(F.col("receiver_x"))})
    doubled = plain.where("record_id % 41 = 0 AND record_id % 7 <> 0").withColumn("ord", F.col("record_id") + 200_000_000)
    beside = rec.select(F.col("record_id").alias("q"), *(F.col(c).alias(f"q_{c}") for c in ("cdp", "trace_offset", "has_cdp", "has_offset")))
    wanted = rec.where("record_id % 31 IN (5, 16)").withColumn("q", F.col("record_id") + F.when(F.col("record_id") % 31 == 5, 1).otherwise(-1)).join(beside, "q")
    wanted = wanted.withColumns({"ord": F.col("record_id") + 300_000_000, "source_id": F.lit(0), "receiver_id": F.lit(0), **{c: F.col(f"q_{c}") for c in ("cdp", "trace_offset", "has_cdp", "has_offset")}})
    return a, b.unionByName(doubled).unionByName(wanted.select(*b.columns))


_CON = """, c{k} AS (SELECT {k}_id AS id FROM al WHERE {k}_id <> 0 GROUP BY 1 HAVING count(DISTINCT (round({k}_x * 1e6), round({k}_y * 1e6))) FILTER (WHERE has_{k} AND isfinite({k}_x) AND isfinite({k}_y)) > 1
OR (count(*) FILTER (WHERE has_{k} AND isfinite({k}_x) AND isfinite({k}_y)) > 0 AND count(*) FILTER (WHERE NOT (has_{k} AND isfinite({k}_x) AND isfinite({k}_y))) > 0))"""


@query(_AB + _CON.format(k="source") + " SELECT id FROM csource")
def id_conflicts(spark, sf):
    """Source numbers that A and B together place in more than one way."""
    a, b = _ab(spark, sf)
    return match.id_conflicts(a.unionByName(b), "source")


_KEYS = _AB + _CON.format(k="source") + _CON.format(k="receiver") + """, v AS (SELECT * FROM al WHERE header_valid AND coalesce(header_error, '') = ''),
ks AS (SELECT side, ord, 0 AS rank, 'id:' || source_id || ':' || receiver_id AS key FROM v WHERE source_id <> 0 AND receiver_id <> 0 AND source_id NOT IN (SELECT id FROM csource) AND receiver_id NOT IN (SELECT id FROM creceiver)
UNION ALL SELECT side, ord, 1, 'xy:' || CAST(round(source_x * 1e6) AS BIGINT) || ':' || CAST(round(source_y * 1e6) AS BIGINT) || ':' || CAST(round(receiver_x * 1e6) AS BIGINT) || ':' || CAST(round(receiver_y * 1e6) AS BIGINT) FROM v WHERE has_source AND has_receiver AND isfinite(source_x) AND isfinite(source_y) AND isfinite(receiver_x) AND isfinite(receiver_y)
UNION ALL SELECT side, ord, 2, 'cdp:' || cdp || ':' || CAST(round(trace_offset * 1e6) AS BIGINT) FROM v WHERE has_cdp AND has_offset AND isfinite(trace_offset)), ct AS (SELECT key, count(*) FILTER (WHERE side = 'a') AS na, count(*) FILTER (WHERE side = 'b') AS nb FROM ks GROUP BY 1)"""


@query(_KEYS + " SELECT side, ord, CAST(rank AS INTEGER) AS rank, key, na, nb FROM ks JOIN ct USING (key)")
def match_keys(spark, sf):
    """Every record's keys, strongest first, with how often each side has them."""
    a, b = _ab(spark, sf)
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    keys = match.candidate_keys(both, match.id_conflicts(both, "source"), match.id_conflicts(both, "receiver"))
    counts = keys.groupBy("key").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    return keys.join(counts, "key").select("side", "ord", "rank", "key", "na", "nb")


# Each A takes its strongest unique key; of two that want the same B the earlier one gets it, and the other has no second choice here.
_PAIRS = _KEYS + """, u AS (SELECT x.ord AS a, y.ord AS b, x.rank FROM ks x JOIN ct USING (key) JOIN ks y ON y.key = x.key AND y.side = 'b' WHERE x.side = 'a' AND na = 1 AND nb = 1), fi AS (SELECT a, min_by(b, rank) AS b, min(rank) AS rank FROM u GROUP BY 1), te AS (SELECT * FROM fi QUALIFY a = min(a) OVER (PARTITION BY b)),
lo AS (SELECT ks.ord, ks.key, na, nb FROM ks JOIN ct USING (key) WHERE side = 'a' AND ord NOT IN (SELECT a FROM te)), gr AS (SELECT DISTINCT key FROM lo WHERE nb >= 1 AND (na > 1 OR nb > 1)), be AS (SELECT lo.ord AS a, y.ord AS b FROM lo JOIN ks y ON y.key = lo.key AND y.side = 'b' WHERE na = 1 AND nb = 1), aa AS (SELECT ord FROM ks WHERE side = 'a' AND key IN (SELECT key FROM gr) UNION SELECT a FROM be),
pr AS (SELECT * FROM te WHERE a NOT IN (SELECT ord FROM aa)), ab AS (SELECT ord FROM ks WHERE side = 'b' AND key IN (SELECT key FROM gr) UNION SELECT b FROM be UNION SELECT b FROM te WHERE a IN (SELECT ord FROM aa))"""


@query(_PAIRS + " SELECT a AS a_ord, b AS b_ord, CASE rank WHEN 0 THEN 'source_receiver_id' WHEN 1 THEN 'source_receiver_xy' ELSE 'cdp_signed_offset' END AS strategy FROM pr")
def match_pairs(spark, sf):
    """The pairs of A and B."""
    return match.match(*_ab(spark, sf))[0]


_CLASSES = _PAIRS + """, kd AS (SELECT DISTINCT side, ord FROM ks), cl AS (SELECT side, ord, 'invalid' AS class FROM al WHERE (side, ord) NOT IN (SELECT (side, ord) FROM kd) UNION ALL SELECT 'a', a, 'matched' FROM pr UNION ALL SELECT 'b', b, 'matched' FROM pr UNION ALL SELECT 'a', ord, 'ambiguous' FROM aa UNION ALL SELECT 'b', ord, 'ambiguous' FROM ab
UNION ALL SELECT 'a', ord, 'a_only' FROM kd WHERE side = 'a' AND ord NOT IN (SELECT ord FROM aa) AND ord NOT IN (SELECT a FROM pr) UNION ALL SELECT 'b', ord, 'b_only' FROM kd WHERE side = 'b' AND ord NOT IN (SELECT ord FROM ab) AND ord NOT IN (SELECT b FROM pr))"""


@query(_CLASSES + " SELECT side, ord, class FROM cl")
def match_classified(spark, sf):
    """The class of every record of A and B."""
    return match.match(*_ab(spark, sf))[1]


@query(_CLASSES + " SELECT class, side, count(*) AS n FROM cl GROUP BY 1, 2")
def match_counts(spark, sf):
    """How many records of either side each class has."""
    return match.class_counts(match.match(*_ab(spark, sf))[1])


@query(_CLASSES + ", w AS (SELECT 0 AS part, cl.ord AS o, class, cl.ord AS a_ord, pr.b AS b_ord FROM cl LEFT JOIN pr ON pr.a = cl.ord WHERE side = 'a' UNION ALL SELECT 1, ord, class, NULL, ord FROM cl WHERE side = 'b' AND class <> 'matched') SELECT row_number() OVER (ORDER BY part, o, class) - 1 AS row, class, coalesce(a_ord, -1) AS a_ord, coalesce(b_ord, -1) AS b_ord FROM w WHERE class IN ('matched', 'a_only', 'b_only', 'ambiguous')")
def match_logical_rows(spark, sf):
    """What a comparison of A and B shows, row by row."""
    rows = match.logical_rows(*match.match(*_ab(spark, sf)), allowed=("matched", "a_only", "b_only", "ambiguous"))
    return rows.select("row", "class", F.coalesce("a_ord", F.lit(-1)).alias("a_ord"), F.coalesce("b_ord", F.lit(-1)).alias("b_ord"))


def _report_sql() -> str:
    word = "CASE rank WHEN 0 THEN 'source_receiver_id' WHEN 1 THEN 'source_receiver_xy' ELSE 'cdp_signed_offset' END"
    count = lambda c: f"(SELECT count(*) FROM rw WHERE classification = '{c}') AS {c}"
    six = lambda c: f"CAST(round({c} * 1e6) AS BIGINT) / 1e6"
    part = lambda c, k, name: f"CASE WHEN classification = 'matched' THEN CASE WHEN strategy = '{k}' THEN {c} ELSE 0 END END AS {name}"
    meta = [f"{x}.{'trace_offset' if c == 'offset' else c} AS {s}_{c}" for s, x in (("a", "x"), ("b", "y")) for c in match._META]
    cells = [
        "'1.1' AS schema_version", "'a.sgy' AS a_path", "'b.sgy' AS b_path", "'all' AS selection", "'' AS \"primary\"", "'' AS secondary", "0 AS sample_window_start", "63 AS sample_window_end",
        "(SELECT CASE count(DISTINCT strategy) WHEN 0 THEN 'invalid' WHEN 1 THEN min(strategy) ELSE 'mixed' END FROM rw WHERE classification = 'matched') AS strategy",
        *(count(c) for c in ("matched", "a_only", "b_only", "ambiguous_a", "ambiguous_b", "invalid_a", "invalid_b")), "true AS sample_axis_compatible", "'' AS axis_reason", "'' AS reason",
        "classification", "CASE WHEN classification LIKE 'ambiguous%' THEN 'ambiguous' WHEN classification LIKE 'invalid%' THEN 'invalid' ELSE classification END AS category", "x.trace_number AS a_trace", "y.trace_number AS b_trace",
        "rw.strategy AS pair_strategy", "CASE WHEN classification = 'matched' THEN rw.strategy END AS key_strategy", part("x.source_id", "source_receiver_id", "source_id"), part("x.receiver_id", "source_receiver_id", "receiver_id"),
        part("x.cdp", "cdp_signed_offset", "cdp"), part(six("x.trace_offset"), "cdp_signed_offset", '"offset"'), *(part(six(f"x.{c}"), "source_receiver_xy", f"key_{c}") for c in ("source_x", "source_y", "receiver_x", "receiver_y")), *meta,
    ]
    rows = f"rw AS (SELECT a AS a_ord, b AS b_ord, 'matched' AS classification, {word} AS strategy FROM pr UNION ALL SELECT CASE WHEN side = 'a' THEN ord END, CASE WHEN side = 'b' THEN ord END, CASE WHEN class IN ('ambiguous', 'invalid') THEN class || '_' || side ELSE class END, 'invalid' FROM cl WHERE class <> 'matched')"
    return f"{_CLASSES}, {rows} SELECT {', '.join(cells)} FROM rw LEFT JOIN a x ON x.ord = rw.a_ord LEFT JOIN b y ON y.ord = rw.b_ord"


@query(_report_sql())
def match_report(spark, sf):
    """The report of a comparison, all its columns, a row for every pair and every record without one."""
    a, b = _ab(spark, sf)
    pairs, classes = match.match(a, b)
    return match.report(pairs, classes, a, b, window=(0, 63), a_path="a.sgy", b_path="b.sgy", selection="all")


_AXES = REC + ", j AS (SELECT a.record_id AS a_record_id, b.record_id AS b_record_id, a.sample_count AS ac, a.sample_count - CASE WHEN b.record_id % 5 = 0 THEN 1 ELSE 0 END AS bc, a.sample_interval_us AS ai, b.sample_interval_us AS bi, a.delay_ms AS ad, b.delay_ms AS bd FROM rec a JOIN recb b ON a.trace_number = b.trace_number)"


@query(_AXES + ", w AS (SELECT a_record_id, b_record_id, concat_ws('; ', CASE WHEN ai <> bi THEN 'sample interval mismatch' END, CASE WHEN ac <> bc THEN 'sample count mismatch' END, CASE WHEN ad <> bd THEN 'delay mismatch; time origin mismatch' END) AS reason FROM j) SELECT *, reason = '' AS compatible FROM w")
def axis_compatibility(spark, sf):
    """Whether the sample axes of traces of the same number agree, and what differs."""
    from lithoframe.plans.views import records_b

    side = lambda df, s, n: df.select("trace_number", F.col("record_id").alias(f"{s}_record_id"), n.alias(f"{s}_sample_count"), F.col("sample_interval_us").alias(f"{s}_sample_interval_us"), F.col("delay_ms").alias(f"{s}_delay_ms"))
    a = side(records(spark, sf), "a", F.col("sample_count"))
    b = side(records_b(spark, sf), "b", F.lit(1500) - F.when(F.col("record_id") % 5 == 0, 1).otherwise(0))
    return match.axis_reasons(a.join(b, "trace_number")).select("a_record_id", "b_record_id", "reason", "compatible")


@query(_AXES + " SELECT a_record_id, b_record_id, greatest(0, least(CAST(round(700.0 * ai / bi) AS BIGINT), 1499)) AS sample_b FROM j")
def sample_time_map(spark, sf):
    """Sample 700 of A as a sample of B, by time."""
    from lithoframe.plans.views import records_b

    j = records(spark, sf).select("trace_number", F.col("record_id").alias("a_record_id"), F.col("sample_interval_us").alias("ai")).join(records_b(spark, sf).select("trace_number", F.col("record_id").alias("b_record_id"), F.col("sample_interval_us").alias("bi")), "trace_number")
    return j.select("a_record_id", "b_record_id", match.sample_of_b(F.lit(700.0), F.col("ai"), F.col("bi"), F.lit(1500)).alias("sample_b"))


@query(REC + ", s AS (SELECT 'source' AS field, avg(CASE WHEN source_id <> 0 THEN 1.0 ELSE 0 END) AS coverage, count(DISTINCT source_id) / count(*) AS uniq FROM rec UNION ALL SELECT 'receiver', avg(CASE WHEN receiver_id <> 0 THEN 1.0 ELSE 0 END), count(DISTINCT receiver_id) / count(*) FROM rec UNION ALL SELECT 'cdp', avg(CASE WHEN cdp <> 0 THEN 1.0 ELSE 0 END), count(DISTINCT cdp) / count(*) FROM rec UNION ALL SELECT 'offset', avg(CASE WHEN trace_offset <> 0 THEN 1.0 ELSE 0 END), NULL FROM rec) SELECT field, round(coverage, 6) AS coverage, round(CASE WHEN field = 'offset' THEN coverage ELSE coverage * (0.65 + 0.35 * least(1.0, uniq)) END, 6) AS confidence, CASE WHEN field = 'offset' THEN coverage ELSE coverage * (0.65 + 0.35 * least(1.0, uniq)) END < 0.7 AS confirm FROM s")
def header_confidence(spark, sf):
    """How sure the mapping of each header field is, and whether a user should confirm it."""
    fields = {"source": "source_id", "receiver": "receiver_id", "cdp": "cdp", "offset": "trace_offset"}
    one = records(spark, sf).agg(*(F.avg(F.when(F.col(c) != 0, 1.0).otherwise(0.0)).alias(f"c_{f}") for f, c in fields.items()), *((F.count_distinct(c) / F.count(F.lit(1))).alias(f"u_{f}") for f, c in fields.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"c_{f}").alias("coverage"), (F.lit(1.0) if f == "offset" else F.col(f"u_{f}")).alias("u")) for f in fields))).alias("s")).select("s.*")
    conf = F.col("coverage") * (0.65 + 0.35 * F.least(F.lit(1.0), F.col("u")))
    return rows.select("field", r("coverage"), F.round(conf, 6).alias("confidence"), (conf < 0.7).alias("confirm"))


@query(TRC + ", d AS (SELECT smp.trace, smp.v AS a, smb.v AS b FROM smp LEFT JOIN smb USING (trace, sample)), u AS (SELECT trace AS id, 'A' AS role, a AS v FROM d UNION ALL SELECT trace, 'B', b FROM d WHERE b IS NOT NULL UNION ALL SELECT trace, 'A-B', a - b FROM d) SELECT id, role, count(v) > 0 AS there, round(coalesce(avg(v), 0), 6) AS mean, round(coalesce(sqrt(avg(v * v)), 0), 6) AS rms, CASE WHEN count(v) = 0 THEN 'a side is missing' ELSE '' END AS note FROM u GROUP BY 1, 2")
def trace_analysis(spark, sf):
    """Statistics of A, B and A - B of every place; the last place has no B."""
    side = lambda t: t.select("trace", "samples", F.lit(2000.0).alias("interval_us"), F.lit(0).alias("first_sample"))
    a, b = side(traces(spark, sf)), side(traces_b(spark, sf))
    pairs = a.select(F.col("trace").alias("id"), F.col("trace").alias("a_trace"), F.col("trace").alias("b_trace"))
    return numeric.analyse(pairs, a, b).select("id", "role", F.coalesce(F.col("finite") > 0, F.lit(False)).alias("there"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce("rms", F.lit(0.0)), 6).alias("rms"), F.coalesce("note", F.lit("")).alias("note"))
