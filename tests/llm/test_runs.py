import math
import random

import numpy as np
import pytest

from lithoframe.llm.runs import agglomerate, collapse_runs

SCHEMA = "line string, trace bigint, x double, y double, fix_time timestamp, valid boolean, chunk int, grp string, n int"


def frame(spark, rows):
    import datetime as d

    t0 = d.datetime(2024, 1, 1)
    return spark.createDataFrame([(line, t, x, y, t0 + d.timedelta(seconds=t or 0), v, 3, "clash", 4) for line, t, x, y, v in rows], SCHEMA)


def brute(rows, limit, gap=math.inf):
    out = []
    for line in sorted({r[0] for r in rows if r[0] is not None}):
        once = {}
        for _, t, x, y, v in (r for r in rows if r[0] == line):
            if v and t is not None and x is not None and y is not None and math.isfinite(x) and math.isfinite(y):
                once.setdefault(t, (x, y))
        run = []
        for t in [*sorted(once), None]:
            if run and (t is None or math.hypot(once[t][0] - once[run[-1]][0], once[t][1] - once[run[-1]][1]) > limit or t - run[-1] > gap):
                if len(run) >= 2:
                    out.append((line, run[0], run[-1], len(run), float(run[-1] - run[0])))
                run = []
            if t is not None:
                run.append(t)
    return sorted(out)


def result(df):
    return sorted((r["grp"], r["first_ord"], r["last_ord"], r["n"], r["duration_s"]) for r in df.collect())


def walk(seed, n=400):
    r = random.Random(seed)
    rows = []
    for line in ("a", "b", None):
        x = y = 0.0
        for t in range(n):
            if r.random() < 0.3:
                x, y = x + r.choice([0.5, 5.0, 13.0]), y
            if r.random() < 0.9:
                rows.append((line, t, x, y, r.random() < 0.95))
            if r.random() < 0.05 and rows:
                rows.append(rows[-1])
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, parts", [(1, 3), (7, 40), (64, None), (4096, 1)])
def test_same_as_brute_force_whatever_the_chunks(spark, chunk, parts):
    rows = walk(5)
    got = collapse_runs(frame(spark, rows), "line", "trace", "x", "y", "fix_time", valid="valid", chunk=chunk, parts=parts)
    assert result(got) == brute(rows, 1.0)


def test_sparse_order_values(spark):
    """Order values like time stamps: the parts are counted by rows, so no task holds a line."""
    from pyspark.sql import functions as F

    rows = [(line, t, x, y, v) for line, t, x, y, v in walk(6)]
    far = frame(spark, rows).withColumn("trace", F.col("trace") * 1_000_003)
    got = collapse_runs(far, "line", "trace", "x", "y", "fix_time", valid="valid", chunk=16, parts=12)
    assert [(g, a, b, n) for g, a, b, n, _ in result(got)] == [(g, a * 1_000_003, b * 1_000_003, n) for g, a, b, n, _ in brute(rows, 1.0)]
    one = spark.range(20_000).select(F.lit("a").alias("line"), (F.col("id") * 10**9).alias("trace"), (F.col("id") / 10 * 50).cast("int").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("timestamp").alias("fix_time"))
    sizes = one.repartitionByRange(8, "line", "trace").groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
    assert sizes < 2 * 20_000 / 8
    still = collapse_runs(one.withColumn("x", F.lit(3.0)), "line", "trace", "x", "y", "fix_time", parts=8, chunk=100).collect()
    assert [(r["first_ord"], r["last_ord"], r["n"], r["duration_s"]) for r in still] == [(0, 19_999 * 10**9, 20_000, None)]


def test_copies_that_disagree(spark):
    rows = [("a", 1, 0.0, 9.0, True), ("a", 1, 5.0, 0.0, True), ("a", 2, 0.0, 9.5, True)]
    got = collapse_runs(frame(spark, rows), "line", "trace", "x", "y", "fix_time", valid="valid")
    assert result(got) == [("a", 1, 2, 2, 1.0)]


def test_between_means(spark):
    x = np.array([0.0, 0.6, 1.1, 1.7, 2.2, 9.0])
    rows = [("a", t, v, 0.0, True) for t, v in enumerate(x.tolist())]
    assert [r[1:4] for r in result(collapse_runs(frame(spark, rows), "line", "trace", "x", "y", "fix_time"))] == [(0, 4, 5)]
    runs = agglomerate(np.arange(6), x, np.zeros(6), 1.0, between="means")
    assert runs == [(0, 0), (1, 2), (3, 4), (5, 5)] or runs == [(0, 2), (3, 4), (5, 5)], runs

    def model(values, limit):  # the closest pair of neighbouring means first, until none is near enough
        parts = [[v] for v in values]
        while len(parts) > 1:
            d = [abs(sum(q) / len(q) - sum(p) / len(p)) for p, q in zip(parts, parts[1:])]
            if min(d) > limit:
                break
            k = d.index(min(d))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [len(p) for p in parts]

    r = random.Random(9)
    for _ in range(50):
        values = np.cumsum([r.choice([0.1, 0.3, 0.7, 1.3, 4.0]) * r.random() for _ in range(40)])
        got = agglomerate(np.arange(40), values, np.zeros(40), 0.8, between="means")
        assert [b - a + 1 for a, b in got] == model(values.tolist(), 0.8)
    got = result(collapse_runs(frame(spark, rows), "line", "trace", "x", "y", "fix_time", between="means", chunk=4096))
    assert [(g[1], g[2]) for g in got] == [q for q in runs if q[0] < q[1]]


def test_gap_limit(spark):
    rows = [("a", t, 0.0, 0.0, True) for t in (1, 2, 3, 9, 10)]
    for chunk in (2, 4096):
        got = collapse_runs(frame(spark, rows), "line", "trace", "x", "y", "fix_time", valid="valid", max_gap=3, chunk=chunk)
        assert result(got) == brute(rows, 1.0, 3) == [("a", 1, 3, 3, 2.0), ("a", 9, 10, 2, 1.0)]


def test_bad_rows_and_empty(spark):
    nan = float("nan")
    rows = [("a", 1, 0.0, 0.0, True), ("a", 2, nan, 0.0, True), ("a", 3, None, 0.0, True), ("a", 4, 50.0, 0.0, False), ("a", 5, 0.6, 0.8, True), ("a", None, 0.0, 0.0, True), (None, 6, 0.0, 0.0, True), ("a", -7, 0.0, 1.0, True), ("a", -6, 0.0, 1.0, None)]
    got = collapse_runs(frame(spark, rows), "line", "trace", "x", "y", "fix_time", valid="valid")
    assert result(got) == [("a", -7, 5, 3, 12.0)]
    assert result(collapse_runs(frame(spark, []), "line", "trace", "x", "y", "fix_time", valid="valid")) == []


def test_hot_copies_and_one_long_stand(spark):
    rows = [("a", 1, 0.0, 0.0, True)] * 3000 + [("a", t, 0.0, 0.0, True) for t in range(2, 3000)]
    got = collapse_runs(frame(spark, rows), "line", "trace", "x", "y", "fix_time", valid="valid", chunk=100)
    assert result(got) == [("a", 1, 2999, 2999, 2998.0)]


def test_agglomeration_alone():
    x = np.array([0.0, 0.5, 0.9, 9.0, 9.0])
    assert agglomerate(np.arange(5), x, np.zeros(5), 1.0) == [(0, 2), (3, 4)]
    assert agglomerate(np.arange(0), np.zeros(0), np.zeros(0), 1.0) == []
    assert agglomerate(np.array([0, 1, 5]), np.zeros(3), np.zeros(3), 1.0, 2) == [(0, 1), (2, 2)]
