"""Small cases with answers worked out by hand."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lithoframe.functions import scalar as S
from lithoframe.operators import acquisition, clip, gathers, grid, lines, numeric, qc, raster
from lithoframe.operators.records import decode_records, derive_geometry, uses_grid


def value(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0]["v"]


def test_trace_stats(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [-2.0, 0.0, 2.0, 4.0, nan, inf]), (2, [0.0, 0.0]), (3, [nan, inf]), (4, [10.0, nan, 0.0]), (5, []), (6, None)], "trace int, samples array<double>")
    s = {r["trace"]: r for r in numeric.trace_stats(df).collect()}
    assert s[1]["mean"] == 1 and s[1]["rms"] == pytest.approx(6**0.5) and s[1]["std"] == pytest.approx(5**0.5) and s[1]["p50"] == 1 and s[1]["finite_ratio"] == pytest.approx(4 / 6) and s[1]["zero_ratio"] == 0.25 and s[1]["peak"] == 4
    assert s[2]["zero_ratio"] == 1 and s[3]["mean"] is None and s[3]["finite"] == 0 and s[5]["n"] == 0
    assert value(spark, numeric.percentile_of(F.array(F.lit(0.0), F.lit(10.0)), 25)) == 2.5


def test_spectrum():
    t = np.arange(1000) * 1e-3
    f, a = numeric.amplitude(np.sin(2 * math.pi * 50 * t), 1000)
    assert len(f) == 513 and f[-1] == 500 and abs(f[a.argmax()] - 50) <= 0.6
    assert (numeric.decibels(numeric.amplitude(np.zeros(64), 1000)[1]) == -80).all()
    assert (numeric.decibels(numeric.amplitude(np.full(64, 12.5), 1000)[1]) == -80).all()
    assert numeric.amplitude(np.ones(31), 1000) is None
    assert [numeric.fft_length(n) for n in (1, 5, 1024)] == [1, 8, 1024] and numeric.fft_length(1000, False) == 512 and numeric.fft_length(0) == 0


def test_agc_and_ranges(spark):
    assert value(spark, numeric.agc(F.array(F.lit(3.0), F.lit(-3.0)))) == [1.0, -1.0]
    assert value(spark, numeric.agc(F.array(F.lit(0.0)))) == [0.0]
    assert tuple(value(spark, numeric.symmetric_range(F.array(F.lit(0.0), F.lit(float("nan")))))) == (-1.0, 1.0)
    assert value(spark, numeric.difference(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert value(spark, numeric.difference_shorter(F.array(F.lit(3.0)), F.array(F.lit(1.0), F.lit(2.0)))) == [2.0]


def test_gain_trim_and_palette(spark):
    df = spark.createDataFrame([(float(v),) for _ in range(2) for v in range(-50, 50)], "v double")
    lo, hi = raster.order_range(df, "v", 10.0).collect()[0]
    assert (lo, hi) == (-40.0, 40.0)
    assert tuple(raster.order_range(df, "v", 0.0).collect()[0]) == (-50.0, 49.0)
    idx = {r["v"]: r["idx"] for r in raster.palette(df, "v", raster.order_range(df, "v", 10.0)).collect()}
    assert idx[45.0] == 0 and idx[-45.0] == 255 and idx[0.0] == 128
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r["idx"] for r in raster.palette(flat, "v", raster.order_range(flat, "v", 0.0)).collect()} == {255}


@pytest.mark.parametrize("gain", [0.0, 1.0, 7.5, 49.0])
def test_order_range_against_sorting(spark, gain):
    v = sorted(np.random.default_rng(3).normal(size=301).round(1).tolist())
    k = lambda p: min(int(len(v) * p / 100), len(v) - 1)
    got = raster.order_range(spark.createDataFrame([(x,) for x in v], "v double"), "v", gain).collect()[0]
    assert tuple(got) == (v[k(gain)] if gain else v[0], v[k(100 - gain)] if gain else v[-1])


def test_bins(spark):
    df = spark.createDataFrame([(-10.0, True), (-11.0, True), (10.0, True), (11.0, True), (float("nan"), True), (5.0, False)], "trace_offset double, has_offset boolean")
    assert [r[0] for r in df.select(gathers.offset_bin()).collect()] == [0, -1, 1, 1, None, None]
    az = spark.createDataFrame([(10.2,), (10.4,), (11.4,), (22.0,), (359.6,)], "azimuth double").withColumn("has_azimuth", F.lit(True))
    assert [r[0] for r in az.select(gathers.azimuth_bin()).collect()] == [10, 10, 11, 22, 360]
    assert [r[0] for r in az.select(gathers.azimuth_bin(0.0)).collect()] == [10, 10, 11, 22, 360]
    mid = spark.createDataFrame([(105.0, 202.0, True), (119.0, 206.0, True), (125.0, 202.0, True), (None, None, False)], "midpoint_x double, midpoint_y double, has_midpoint boolean")
    assert rows(gathers.cmp_xy_bins(mid, 20.0)) == [(0, 0, 115.0, 212.0, 2), (1, 0, 135.0, 212.0, 1)]


def test_histogram_edges(spark):
    h = lambda v: qc.histogram(spark.createDataFrame([(x,) for x in v], "v double"), "v").select("bin", "n").collect()
    full = h([0.0, 1.0, 32.0])
    assert len(full) == 32 and full[-1]["n"] == 1 or {r["bin"]: r["n"] for r in full}[31] == 1
    assert [tuple(r) for r in h([5.0, 5.0])] == [(0, 2)] and h([]) == [] and h([float("nan")]) == []


def test_key_expressions():
    keys = [100.0, 105.0, 106.0, 108.0, 110.0]
    assert gathers.parse_keys("100,105-110", keys) == keys and gathers.parse_keys("all", keys) == keys and gathers.parse_keys("#2,#4-#5", keys) == [105.0, 108.0, 110.0] and gathers.parse_keys("110..108,100,110", keys) == [108.0, 110.0, 100.0]
    assert gathers.parse_keys("-40--1", [-41.0, -40.0, -1.0, 0.0]) == [-40.0, -1.0]
    for bad in ("x", "999", "#9", "1-#2"):
        with pytest.raises(ValueError):
            gathers.parse_keys(bad, keys)


def test_raw_range(spark):
    df = spark.range(8).withColumnRenamed("id", "trace_number")
    got = lambda a, b: [r[0] for r in gathers.raw_range(df, a, b, 8).orderBy("trace_number").collect()]
    assert got(6, 2) == [2, 3, 4, 5] and got(-5, 99) == list(range(8)) and got(3, 0) == [3, 4, 5, 6, 7]


def test_derived_geometry(spark):
    c = "source_x double, source_y double, receiver_x double, receiver_y double, has_source boolean, has_receiver boolean, has_header_offset boolean, header_offset double"
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, True, True, False, None), (0.0, 0.0, 0.0, 0.0, True, True, True, 0.0), (0.0, 0.0, -1.0, 0.0, True, True, False, None), (0.0, 0.0, 1.0, 1.0, True, False, False, None)], c)
    r = derive_geometry(df).collect()
    assert r[0]["d_computed_offset"] == 5 and r[0]["d_azimuth"] == pytest.approx(36.8698976) and r[0]["d_midpoint_x"] == 1.5
    assert r[1]["d_offset"] == 0 and r[1]["d_azimuth"] is None and r[2]["d_azimuth"] == pytest.approx(270) and r[3]["d_has_midpoint"] is False and r[3]["d_has_offset"] is False


def test_decoded_headers(spark):
    c = "coordinate_scalar int, " + ", ".join(f"{p}_{k}_raw int" for p in ("source", "receiver", "cdp") for k in "xy") + ", header_sample_count int, header_sample_interval_us int, file_sample_count int, file_sample_interval_us int"
    r = decode_records(spark.createDataFrame([(-10, 100, 0, 0, 0, 0, 0, 0, 2000, 50, 4000), (0, 100, 0, 0, 0, 0, 0, 10, 0, 50, 4000), (2, 100, 0, 0, 0, 0, 0, 10, 2000, 50, 4000)], c)).collect()
    assert [x["source_x"] for x in r] == [10.0, 100.0, 200.0] and r[0]["sample_count"] == 50 and r[0]["header_error"] == "sample count is zero" and r[1]["sample_interval_us"] == 4000 and r[2]["header_valid"]


def test_uses_grid_threshold(spark):
    flags = lambda n: uses_grid(spark.createDataFrame([(1 if i < n else 0, 0, False) for i in range(10)], "inline int, crossline int, has_cdp boolean")).collect()[0]
    assert flags(9)["uses_grid"] and not flags(8)["uses_grid"] and not flags(9)["any_cdp"]
    empty = uses_grid(spark.createDataFrame([], "inline int, crossline int, has_cdp boolean")).collect()[0]
    assert tuple(empty) == (False, False)


def test_grid_rules(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 3), (3, 4, 1), (4, 0, 0), (5, None, 2)], "trace_number bigint, inline int, crossline int")
    g = grid.grid_index(df)
    assert rows(g.select("trace_number", "row", "col")) == [(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 0)]
    assert rows(grid.line_traces(g, "il", 2.5).select("position", "trace_number")) == [(0, 0), (1, 2)]  # a tie goes to the lower line
    assert rows(grid.line_traces(g, "il", 99.0).select("trace_number")) == [(3,)]
    s = grid.grid_summary(g).collect()[0]
    assert s["duplicates"] == 1 and s["usable"] and not s["post_stack"]


def test_crooked_line(spark):
    line = spark.createDataFrame([("l", 0, 0.0, 0.0), ("l", 1, 3.0, 4.0), ("l", 3, 6.0, 8.0)], "line string, trace bigint, x double, y double")
    d = lines.with_distance(line)
    assert [r["distance"] for r in d.orderBy("trace").collect()] == [0.0, 5.0, 10.0]
    q = spark.createDataFrame([("l", 1, 6.0), ("l", 2, 7.5), ("l", 3, -9.0), ("l", 4, 99.0)], "line string, qid bigint, target double")
    assert rows(lines.nearest_along(d, q).select("qid", "trace")) == [(1, 1), (2, 1), (3, 0), (4, 3)]
    assert rows(lines.nearest_to_point(line, 5.8, 8.1).select("trace")) == [(3,)]


def test_calibration(spark):
    line = spark.createDataFrame([("l", i, 100 + c, True, 1000.0 + 10 * c, 2000.0) for i, c in enumerate((10, 50, 90))], "line string, trace bigint, cdp int, has_cdp boolean, x double, y double")
    nav = spark.createDataFrame([("l", 100, 600.0, 900.0), ("l", 200, 700.0, 900.0)], "line string, trace bigint, x double, y double")
    pairs = lines.calibration_pairs(line, nav)
    assert pairs.count() == 2
    c = lines.calibrate(pairs, nav).collect()[0]
    assert c["accepted"] and c["multiplier"] == pytest.approx(0.1) and c["offset_x"] == pytest.approx(500) and c["offset_y"] == pytest.approx(700) and c["inliers"] == 2
    moved = lines.apply_calibration(line, lines.calibrate(pairs, nav)).orderBy("trace").collect()
    assert moved[0]["x"] == pytest.approx(610) and moved[-1]["distance"] == pytest.approx(80.0)


def test_navigation_text(spark):
    text = spark.createDataFrame([("# head",), ("A 1 20 1.5 2.5 1 9",), ("  A 2 10 3 4 1 9 # end",), ("",)], "value string")
    assert rows(lines.parse_navigation(text).select("line", "trace", "x")) == [("A", 10, 3.0), ("A", 20, 1.5)]
    for bad in ("A 1 2", "A 1 x 1 1 1 1"):
        with pytest.raises(Exception, match="not a navigation row"):
            lines.parse_navigation(spark.createDataFrame([(bad,)], "value string")).collect()


def test_navigation_names(spark):
    files = spark.createDataFrame([("d/x_L-1.sgy",), ("d/l-1.SGY",), ("d/zz.sgy",), ("d/aL-1.sgy",)], "file string")
    nav = spark.createDataFrame([("1",), ("L-1",)], "line string")
    assert rows(lines.match_line_names(files, nav)) == [("d/aL-1.sgy", "1"), ("d/l-1.SGY", "L-1"), ("d/x_L-1.sgy", "L-1")]


def test_clipping(spark):
    box = (0.0, 10.0, 0.0, 10.0)
    make = lambda xs, y=5.0: lines.with_distance(spark.createDataFrame([("l", i, float(x), y) for i, x in enumerate(xs)], "line string, trace bigint, x double, y double"))
    run = clip.clip_runs(make([-5, 15]), box).collect()
    assert len(run) == 1 and (run[0]["start"], run[0]["end"], run[0]["vertices"]) == (5.0, 15.0, 2)
    again = clip.clip_runs(make([-2, 5, 12, 5, -2]), box).orderBy("run").collect()
    assert [(r["first_support"], r["last_support"]) for r in again] == [(0, 2), (2, 4)]
    assert clip.clip_runs(make([0, 10], 10.0), box).count() == 1 and clip.clip_runs(make([0, 10], 11.0), box).count() == 0
    line = make([-5, 5, 15, 20, 20, 15, 5, -5])
    assert [r["trace"] for r in clip.support_traces(line, clip.clip_runs(line, box)).orderBy("trace").collect()] == [0, 1, 2, 5, 6, 7]


def test_time_windows(spark):
    w = lambda a, b, dt, n: value(spark, clip.time_window(F.lit(float(a)), F.lit(float(b)), F.lit(dt), F.lit(n)))
    assert tuple(w(999, 501, 2000, 1000)) == (251, 500) and w(2500, 3000, 2000, 1000) is None
    assert tuple(w(3.1, 8.2, 2000, 100)) == (2, 4) and tuple(w(3.1, 8.2, 1000, 100)) == (3, 8)


def test_even_indices(spark):
    assert value(spark, clip.even_indices(F.lit(10), 3)) == [0, 5, 9] and value(spark, clip.even_indices(F.lit(10), 3, True)) == [0, 4, 9] and value(spark, clip.even_indices(F.lit(2), 5)) == [0, 1]


def test_scalars(spark):
    assert value(spark, S.scaled(F.lit(7.0), F.lit(-100))) == 0.07 and value(spark, S.scaled(F.lit(7.0), F.lit(None).cast("int"))) == 7
    assert value(spark, S.nice_step(F.lit(70.0), 6)) == 20 and value(spark, S.nice_step(F.lit(0.0), 6)) == 1
    assert value(spark, S.time_label(F.lit(1250.0))) == "1.250 s" and value(spark, S.time_label(F.lit(850.0))) == "850 ms"
    names = spark.createDataFrame([("b10",), ("B9",), ("a",)], "n string")
    assert [r["n"] for r in names.orderBy(S.natural_key("n")).collect()] == ["a", "B9", "b10"]
    assert value(spark, S.line_name(F.lit("x/y/L 1.v2.sgy"))) == "L 1.v2" and value(spark, S.hex_dump(F.lit(b"\x01\xff"))) == "01 FF"
    assert value(spark, S.checked_int(F.lit(1 << 40))) is None and value(spark, S.round_half_away(F.lit(-2.5))) == -3
    assert value(spark, S.code_label(F.lit(5), S.SAMPLE_FORMATS)) == "IEEE float32" and value(spark, S.code_label(F.lit(99), S.SAMPLE_FORMATS)) == "unknown"
    assert value(spark, S.number_text(F.lit(3.0))) == "3" and value(spark, S.gather_label(F.lit("CMP"), F.lit(205), F.lit(None), F.lit(None))) == "CMP 205"


def test_bilinear_meets_its_corners():
    g = np.array([[0.0, 10.0], [20.0, 30.0]])
    out = raster.bilinear(g, 3, 3)
    assert out.tolist() == [[0, 5, 10], [10, 15, 20], [20, 25, 30]] and raster.bilinear(np.array([[np.nan]]), 1, 1).tolist() == [[0.0]]


def test_nearest_points_ties_and_limits(spark):
    pts = spark.createDataFrame([(5, 0.0, 0.0), (2, 10.0, 0.0)], "first_trace bigint, x double, y double")
    q = spark.createDataFrame([(1, 5.0, 0.0), (2, 30.0, 0.0), (3, float("nan"), 0.0), (4, 18.0, 0.0)], "qid bigint, x double, y double")
    assert rows(acquisition.nearest_points(q, pts, 10.0)) == [(1, 2, 5.0), (4, 2, 8.0)]


def test_key_expressions():
    from lithoframe.operators.gathers import parse_keys

    some = [-40.0, -20.0, 0.0, 20.0, 1001.0, 1003.0]
    assert parse_keys("all", some) == some and parse_keys("1003; 1001", some) == [1003.0, 1001.0]
    assert parse_keys("-40--20", some) == [-40.0, -20.0] and parse_keys("20..-20", some) == [-20.0, 0.0, 20.0]
    assert parse_keys("#2,#5-#6 #2", some) == [-20.0, 1001.0, 1003.0] and parse_keys(".0，+20", some) == [0.0, 20.0]
    bins = [(3, 4), (3, 5), (-1, 2)]
    assert parse_keys("3:5 -1/2", bins) == [(3, 5), (-1, 2)] and parse_keys("#1", bins) == [(3, 4)]
    for bad, of in (("", some), ("9:9", bins), ("3", bins), ("#7", some), ("#0", some), ("5-6", some), ("x", some), ("1-#2", some)):
        with pytest.raises(ValueError):
            parse_keys(bad, of)


def test_gather_keys_of_records_without_any(spark):
    from lithoframe.operators import gathers

    df = spark.createDataFrame([(0, None, None, None, False, False, False, False)], "source_id int, receiver_id int, cdp int, trace_offset double, has_offset boolean, has_azimuth boolean, has_cdp boolean, has_midpoint boolean")
    df = df.selectExpr("*", "double(null) AS azimuth", "double(null) AS midpoint_x", "double(null) AS midpoint_y", "int(null) AS inline", "int(null) AS crossline", "double(null) AS source_x", "double(null) AS source_y", "false AS has_source", "double('NaN') AS receiver_x", "double(null) AS receiver_y", "true AS has_receiver", "'clash' AS kind", "7 AS id")
    flags = spark.createDataFrame([(False, True, True)], "uses_grid boolean, source_by_place boolean, receiver_by_place boolean")
    for gather in ("cmp", "shot", "receiver", "offset", "azimuth"):
        for f in (None, flags):
            got = gathers.primary_keys(df.drop("kind", "id"), gather, f).collect()
            assert [r["kind"] for r in got] == [None] and all(got[0][c] is None for c in gathers.KEY_COLUMNS)


def test_supports_and_folders(spark):
    from lithoframe.functions import scalar
    from lithoframe.operators import identity, panels

    assert panels.sample_support(5, 3, False) == [(0, 0, 0, 0.0), (1, 2, 2, 0.0), (2, 4, 4, 0.0)]
    assert panels.sample_support(3, 4, True)[1][:3] == (1, 0, 1) and panels.sample_support(1, 2, True) == [(0, 0, 0, 0.0), (1, 0, 0, 0.0)]
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert scalar.common_folder(df("/a/B/x.sgy", "/a/b/y.sgy")).collect()[0][0].lower() == "/a/b" and scalar.common_folder(df("/a/x", "/b/y")).collect()[0][0] == "" and scalar.common_folder(df()).collect()[0][0] == ""
    image = np.zeros((2, 3, 4), np.uint8)
    assert identity.raster_sha256(image) == identity.raster_sha256(image.copy()) != identity.raster_sha256(image.reshape(3, 2, 4))


def test_orders_of_all_rows(spark):
    from lithoframe.operators.ordering import accumulated, numbered, surrounded

    df = spark.createDataFrame([(i * 7919 % 1000, 1 if i % 3 else None) for i in range(1000)], "k bigint, v int").repartition(5)
    assert sorted((r["k"], r["n"]) for r in numbered(df, ["k"]).collect()) == [(i, i) for i in range(1000)]
    by = {r["k"]: r for r in surrounded(df, ["k"], F.when(F.col("v").isNotNull(), F.col("k"))).collect()}
    has = [k for k in by if by[k]["v"] is not None]
    for k, r in by.items():
        assert r["before"] == max((h for h in has if h <= k), default=None) and r["after"] == min((h for h in has if h >= k), default=None)
    got = {r["k"]: r["s"] for r in accumulated(df.na.fill(0), ["k"], "v", "s").collect()}
    assert got[999] == len(has) and all(got[k] - got[k - 1] == (k in has) for k in range(1, 1000))
    assert numbered(df.where("false"), ["k"]).count() == 0
