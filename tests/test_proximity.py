import random

from conftest import rows

from lithoframe.operators.proximity import containing_ranges, cover, distinct_positions, near_pairs, normal_ranges

POINTS = "trace_id bigint, line string, x double, y double, valid boolean, id string, cx int"
RANGES = "range_id bigint, name string, x_min double, x_max double, y_min double, y_max double, valid boolean, x0 int"


def brute_near(pts, d):
    return sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in pts for b in pts if a[0] != b[0] and a[1] is not None and b[1] is not None and a[1] != b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= d})


def cloud(seed, n=250):
    r = random.Random(seed)
    pts = [(i, r.choice(["a", "b", "c", "", None]), round(r.uniform(-100, 100), 1), round(r.uniform(-100, 100), 1)) for i in range(n)]
    pts += [(n + i, "still", 10.0, 10.0) for i in range(60)] + [(n + 60 + i, "b", 10.0 + i % 3, 10.0) for i in range(20)]
    return pts


def frame(spark, pts):
    return spark.createDataFrame([(*p, True, "clash", 7) for p in pts], POINTS)


def test_near_matches_brute_force(spark):
    pts = cloud(1)
    got = rows(near_pairs(distinct_positions(frame(spark, pts), "trace_id", "line"), 15.0).distinct())
    assert got == brute_near(pts, 15.0)


def test_near_at_the_limit_and_across_cells(spark):
    pts = [(1, "a", 0.0, 0.0), (2, "b", 15.0, 0.0), (3, "b", -9.0, -12.0), (4, "b", 15.0001, 0.0)]
    assert rows(near_pairs(distinct_positions(frame(spark, pts), "trace_id", "line"), 15.0)) == [(1, 2), (1, 3)]


def test_bad_rows_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(1, "a", 0.0, 0.0, True), (1, "a", 0.0, 0.0, True), (2, "b", 1.0, 0.0, False), (3, "b", nan, 0.0, True), (4, "b", None, 0.0, True), (5, "b", inf, 0.0, True), (None, "b", 0.0, 0.0, True), (6, None, 0.0, 0.0, True), (7, "b", 1e300, 0.0, True), (8, "b", 1.0, 1.0, None), (9, "b", 1.0, 1.0, True)]
    df = spark.createDataFrame([(*p, "x", 1) for p in raw], POINTS)
    pts = distinct_positions(df, "trace_id", "line")
    assert rows(near_pairs(pts, 15.0)) == [(1, 9)]
    box = spark.createDataFrame([(1, "r", 2.0, -1.0, -1.0, 2.0, True, 0)], RANGES)
    assert rows(containing_ranges(pts, normal_ranges(box))) == [(1, 1), (6, 1), (9, 1)]


def test_inside_matches_brute_force_both_ways(spark):
    r = random.Random(4)
    pts = cloud(2)
    boxes = [(i, "b", r.uniform(-150, 150), r.uniform(-150, 150), r.uniform(-150, 150), r.uniform(-150, 150), True, 0) for i in range(25)] + [(90, "huge", -1e7, 1e7, -1e7, 1e7, True, 0), (91, "edge", 10.0, 12.0, 10.0, 10.5, True, 0)]
    bad = [(80, "n", None, 1.0, 0.0, 1.0, True, 0), (81, "nan", float("nan"), 1.0, 0.0, 1.0, True, 0), (82, "flat", 1.0, 1.0, 0.0, 5.0, True, 0), (83, "off", -9.0, 9.0, -9.0, 9.0, False, 0), (90, "huge", -1e7, 1e7, -1e7, 1e7, True, 0)]
    want = sorted((p[0], b[0]) for p in pts for b in boxes if min(b[2:4]) <= p[2] <= max(b[2:4]) and min(b[4:6]) <= p[3] <= max(b[4:6]))
    ranges = normal_ranges(spark.createDataFrame(boxes + bad, RANGES))
    points = distinct_positions(frame(spark, pts), "trace_id", "line")
    assert rows(containing_ranges(points, ranges)) == want
    assert rows(containing_ranges(points, ranges, broadcast_rows=0)) == want


def test_cover_is_disjoint_and_bounded(spark):
    ranges = spark.createDataFrame([(1, 0.0, 1000.0, 0.0, 700.0), (2, -3.0, 1e6, 5.0, 6.0)], "rid bigint, x0 double, x1 double, y0 double, y1 double")
    for rid, level, cx, cy, inner in cover(ranges, 64.0).select("rid", "level", "cx", "cy", "inner").collect():
        assert isinstance(inner, bool) and level >= 0
    assert all(n <= 500 for _, n in cover(ranges, 64.0).groupBy("rid").count().collect())


def test_empty(spark):
    none = spark.createDataFrame([], POINTS)
    pts = distinct_positions(none, "trace_id", "line")
    assert rows(near_pairs(pts, 15.0)) == []
    assert rows(containing_ranges(pts, normal_ranges(spark.createDataFrame([], RANGES)))) == []
