"""Crooked lines: running distance, lookups along a line, shape, and calibration to navigation.

A line is the partition of every window here: its traces in order are what an answer is about. No
operator gathers more than a line's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import hypot, is_finite


def _by_trace():
    return Window.partitionBy("line").orderBy("trace")


def step_length() -> Column:
    return F.coalesce(hypot(F.col("x") - F.lag("x").over(_by_trace()), F.col("y") - F.lag("y").over(_by_trace())), F.lit(0.0))


def with_distance(line: DataFrame) -> DataFrame:
    """Adds the running distance along each line (line, trace, x, y)."""
    return line.withColumn("distance", F.sum(step_length()).over(_by_trace().rowsBetween(Window.unboundedPreceding, 0)))


def line_summary(line: DataFrame) -> DataFrame:
    """(line, traces, length, usable): usable from two traces and some length on."""
    s = with_distance(line).groupBy("line").agg(F.count(F.lit(1)).alias("traces"), F.max("distance").alias("length"))
    return s.withColumn("usable", (F.col("traces") >= 2) & (F.col("length") > 0))


def places(line: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, trace, x, y, distance, position) of wanted traces (line, trace) on their lines; those that aren't there have none."""
    placed = with_distance(line).withColumn("position", F.row_number().over(_by_trace()) - 1)
    return placed.join(wanted.select("line", "trace").distinct(), ["line", "trace"]).select("line", "trace", "x", "y", "distance", "position")


def bounds(line: DataFrame) -> DataFrame:
    """(line, x0, x1, y0, y1) over each line's finite places."""
    return line.where(is_finite("x") & is_finite("y")).groupBy("line").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def count_lines(summary: DataFrame, nav: DataFrame) -> DataFrame:
    """One row (lines, usable, navigated): usable ones of line_summary, and those with at least two control points (line, trace)."""
    control = nav.groupBy("line").agg((F.count(F.lit(1)) >= 2).alias("navigated"))
    met = summary.join(control, "line", "left")
    return met.agg(F.count(F.lit(1)).alias("lines"), F.count_if("usable").alias("usable"), F.count_if(F.coalesce("navigated", F.lit(False))).alias("navigated"))


def nearest_along(line: DataFrame, targets: DataFrame, position: str = "distance") -> DataFrame:
    """(line, qid, trace): the trace nearest to each target position of its line; ends clamp, the left one wins a tie, and of equal positions the first trace.

    line has (line, trace, position), targets (line, qid, target). Both are merged in one sorted pass.
    """
    both = line.select("line", F.col(position).alias("p"), "trace", F.lit(None).cast("bigint").alias("qid")).unionByName(targets.select("line", F.col("target").alias("p"), F.lit(None).cast("bigint").alias("trace"), "qid"))
    at = F.when(F.col("trace").isNotNull(), F.struct("p", "trace"))
    left = F.last(at, ignorenulls=True).over(Window.partitionBy("line").orderBy("p", F.col("trace").isNull(), F.col("trace").desc()).rowsBetween(Window.unboundedPreceding, 0))
    # the right one is the last one of the reversed order: a frame that ends at the row is one pass, one that starts there isn't
    right = F.last(at, ignorenulls=True).over(Window.partitionBy("line").orderBy(F.desc("p"), F.col("trace").isNull(), F.desc("trace")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.select("line", "qid", "p", left.alias("l"), right.alias("r")).where("qid IS NOT NULL")
    nearest = F.when(F.col("r").isNull(), F.col("l.trace")).when(F.col("l").isNull(), F.col("r.trace")).when(F.col("p") - F.col("l.p") <= F.col("r.p") - F.col("p"), F.col("l.trace")).otherwise(F.col("r.trace"))
    return found.select("line", "qid", nearest.alias("trace"))


def even_targets(line: DataFrame, width: int) -> DataFrame:
    """(line, qid, target): so many positions evenly spread over each line's distance (line, distance)."""
    ends = line.groupBy("line").agg(F.min("distance").alias("a"), F.max("distance").alias("b"))
    return ends.select("line", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("qid"), "a", "b").select("line", "qid", (F.col("a") + (F.col("b") - F.col("a")) * F.col("qid") / F.lit(float(max(width - 1, 1)))).alias("target"))


def nearest_to_point(line: DataFrame, x: float, y: float) -> DataFrame:
    """(line, trace, d2): each line's trace nearest to a point, the first one at a tie."""
    dx, dy = F.col("x") - x, F.col("y") - y
    return line.groupBy("line").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "trace")).alias("m")).select("line", F.col("m.trace").alias("trace"), F.col("m.d2").alias("d2"))


def cdp_monotonic(line: DataFrame) -> DataFrame:
    """(line, monotonic, descending): whether all traces have a CDP and it never turns and does move."""
    d = F.signum(F.col("cdp") - F.lag("cdp").over(_by_trace()))
    s = line.withColumn("d", d).groupBy("line").agg(F.bool_and(F.coalesce("has_cdp", F.lit(False))).alias("all"), F.coalesce(F.min("d"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("d"), F.lit(0.0)).alias("hi"))
    mono = F.col("all") & (F.col("lo") * F.col("hi") >= 0) & ((F.col("lo") != 0) | (F.col("hi") != 0))
    return s.select("line", mono.alias("monotonic"), (mono & (F.col("lo") < 0)).alias("descending"))


def axis_positions(line: DataFrame) -> DataFrame:
    """(line, trace, ordinal, cdp_position, distance): positions on the three axes; by CDP only on monotonic lines, negated on descending ones."""
    placed = with_distance(line).withColumn("ordinal", F.row_number().over(_by_trace()) - 1)
    return placed.join(cdp_monotonic(line), "line").select("line", "trace", "ordinal", F.when(F.col("monotonic"), F.when(F.col("descending"), -F.col("cdp")).otherwise(F.col("cdp"))).cast("double").alias("cdp_position"), "distance")


def _steps(values: DataFrame) -> DataFrame:
    """(spec, line, steps sorted): positive steps between consecutive valid places."""
    w = Window.partitionBy("spec", "line").orderBy("trace")
    d = hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return values.where("ok").withColumn("d", d).where("d > 0 AND d < double('Infinity')")


def coordinate_score(values: DataFrame) -> DataFrame:
    """(spec, line, valid_ratio, uniques, median_step, p95_step, length, score) of candidate coordinates (spec, line, trace, x, y, ok).

    The score is 100 (0.65 valid + 0.20 min(1, uniques / 32) + 0.15 continuity), where continuity
    falls from 1 to 0 as the 95th percentile of the steps goes from one to ten medians. The median is
    the upper one, the percentile the rounded rank, both by counting ranks rather than by lists.
    """
    all_ = values.groupBy("spec", "line").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("v"), F.count_distinct(F.when(F.col("ok"), F.struct("x", "y"))).alias("uniques"))
    steps = _steps(values)
    rank = F.row_number().over(Window.partitionBy("spec", "line").orderBy("d")) - 1
    m = F.count(F.lit(1)).over(Window.partitionBy("spec", "line"))
    ranked = steps.select("spec", "line", "d", rank.alias("r"), m.alias("m"))
    measured = ranked.groupBy("spec", "line").agg(
        F.max(F.when(F.col("r") == F.floor(F.col("m") / 2), F.col("d"))).alias("median_step"), F.max(F.when(F.col("r") == F.round((F.col("m") - 1) * 0.95), F.col("d"))).alias("p95_step"), F.sum("d").alias("length")
    )
    s = all_.join(measured, ["spec", "line"], "left").withColumn("valid_ratio", F.col("v") / F.col("n"))
    continuity = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (10 - F.col("p95_step") / F.col("median_step")) / 9)), F.lit(0.0))
    score = 100 * (0.65 * F.col("valid_ratio") + 0.20 * F.least(F.lit(1.0), F.col("uniques") / 32) + 0.15 * continuity)
    return s.select("spec", "line", "valid_ratio", "uniques", "median_step", "p95_step", F.coalesce("length", F.lit(0.0)).alias("length"), score.alias("score"))


def pick_coordinates(scores: DataFrame, priority: list[str]) -> DataFrame:
    """(line, spec, score): each line's best candidate with two places or more; equal scores keep the priority."""
    p = F.array_position(F.array(*(F.lit(s) for s in priority)), F.col("spec"))
    w = Window.partitionBy("line").orderBy(F.round("score", 9).desc(), p)
    return scores.where("uniques >= 2 AND valid_ratio > 0").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("line", "spec", "score")


def crookedness(line: DataFrame, scores: DataFrame) -> DataFrame:
    """(line, chord, deviation, sinuosity, crooked): the shape test of a line's places (line, trace, x, y), with its scores (line, valid_ratio, uniques, median_step, p95_step, length)."""
    ends = line.groupBy("line").agg(*(F.min_by(c, "trace").alias(f"{c}0") for c in "xy"), *(F.max_by(c, "trace").alias(f"{c}1") for c in "xy"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    off = F.when((dx == 0) & (dy == 0), hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).otherwise(F.abs(dy * (F.col("x") - F.col("x0")) - dx * (F.col("y") - F.col("y0"))) / hypot(dx, dy))
    shape = line.join(ends, "line").groupBy("line").agg(F.max(off).alias("deviation"), F.first(hypot(dx, dy)).alias("chord"))
    s = shape.join(scores, "line").withColumn("sinuosity", F.when(F.col("chord") > 0, F.col("length") / F.col("chord")))
    bent = F.coalesce(F.col("sinuosity") >= 1.01, F.lit(True)) | (F.col("deviation") >= F.greatest(3 * F.col("median_step"), 0.005 * F.col("length")))
    crooked = (F.col("valid_ratio") >= 0.9) & (F.col("uniques") >= 8) & (F.col("median_step") > 0) & (F.col("p95_step") <= 10 * F.col("median_step")) & bent
    return s.select("line", "chord", "deviation", "sinuosity", F.coalesce(crooked, F.lit(False)).alias("crooked"))


def interpolate(queries: DataFrame, nav: DataFrame) -> DataFrame:
    """(line, trace, x, y): the navigation polyline at each query's trace; queries outside its range have no row."""
    both = nav.select("line", "trace", F.struct("trace", "x", "y").alias("p"), F.lit(False).alias("q")).unionByName(queries.select("line", "trace", F.lit(None).cast("struct<trace:bigint,x:double,y:double>").alias("p"), F.lit(True).alias("q")))
    lo = F.last("p", ignorenulls=True).over(Window.partitionBy("line").orderBy("trace", "q").rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("p", ignorenulls=True).over(Window.partitionBy("line").orderBy(F.desc("trace"), "q").rowsBetween(Window.unboundedPreceding, 0))
    found = both.select("line", "trace", "q", lo.alias("a"), hi.alias("b")).where("q AND a IS NOT NULL AND b IS NOT NULL")
    f = F.when(F.col("b.trace") > F.col("a.trace"), (F.col("trace") - F.col("a.trace")) / (F.col("b.trace") - F.col("a.trace"))).otherwise(F.lit(0.0))
    return found.select("line", "trace", *((F.col(f"a.{c}") + f * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in "xy"))


def navigation_length(nav: DataFrame) -> DataFrame:
    return line_summary(nav).select("line", "length")


def calibration_pairs(line: DataFrame, nav: DataFrame) -> DataFrame:
    """(line, hx, hy, nx, ny): for every control point the trace with the nearest CDP inside the navigation's range, each trace once, with the navigation at that CDP."""
    span = nav.groupBy("line").agg(F.min("trace").alias("t0"), F.max("trace").alias("t1"))
    inside = line.where("has_cdp").join(span, "line").where("cdp BETWEEN t0 AND t1").select("line", F.col("cdp").cast("double").alias("distance"), "trace", "cdp", "x", "y")
    hits = nearest_along(inside, nav.select("line", F.col("trace").alias("qid"), F.col("trace").cast("double").alias("target"))).select("line", "trace").distinct()
    chosen = hits.join(inside.drop("distance"), ["line", "trace"])
    at = interpolate(chosen.select("line", F.col("cdp").cast("bigint").alias("trace")).distinct(), nav).select("line", F.col("trace").alias("cdp"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return chosen.join(at, ["line", "cdp"]).select("line", F.col("x").alias("hx"), F.col("y").alias("hy"), "nx", "ny")


def calibrate(pairs: DataFrame, nav: DataFrame) -> DataFrame:
    """(line, multiplier, offset_x, offset_y, residual, inliers, matches, accepted): the power of ten and translation that fit the pairs best.

    Medians average the middle two. Accepted if the median residual and half the pairs are within the
    tolerance (0.5 % of the line, 1 % for two pairs, 5 at least) and the runner-up is clearly worse.
    """
    tried = pairs.select("*", F.explode(F.array(*(F.lit(10.0**k) for k in range(-3, 4)))).alias("m"))
    off = tried.groupBy("line", "m").agg(F.median(F.col("nx") - F.col("hx") * F.col("m")).alias("ox"), F.median(F.col("ny") - F.col("hy") * F.col("m")).alias("oy"), F.count(F.lit(1)).alias("matches"))
    missed = tried.join(off, ["line", "m"]).join(navigation_length(nav), "line")
    missed = missed.withColumn("e", hypot(F.col("hx") * F.col("m") + F.col("ox") - F.col("nx"), F.col("hy") * F.col("m") + F.col("oy") - F.col("ny")))
    missed = missed.withColumn("tol", F.greatest(F.lit(5.0), F.col("length") * F.when(F.col("matches") == 2, 0.01).otherwise(0.005)))
    scores = missed.groupBy("line", "m", "ox", "oy", "matches", "tol").agg(F.median("e").alias("residual"), F.count_if(F.col("e") <= F.col("tol")).alias("inliers"))
    w = Window.partitionBy("line").orderBy("residual", F.desc("inliers"), F.abs(F.log10("m")))
    best = scores.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("residual").over(w)).where("rn = 1 AND matches >= 2")
    clear = (F.col("residual") <= 1e-9) | ((F.col("second") >= 2 * F.col("residual")) & (F.col("second") - F.col("residual") >= F.greatest(F.lit(1.0), F.col("tol") * 0.25)))
    enough = F.col("inliers") >= F.greatest(F.lit(2), F.ceil(F.col("matches") / 2))
    return best.select("line", F.col("m").alias("multiplier"), F.col("ox").alias("offset_x"), F.col("oy").alias("offset_y"), "residual", "inliers", "matches", ((F.col("residual") <= F.col("tol")) & enough & clear).alias("accepted"))


def apply_calibration(line: DataFrame, calibration: DataFrame) -> DataFrame:
    """The line in navigation coordinates, with its distance anew; lines without an accepted calibration drop out."""
    c = calibration.where("accepted").select("line", "multiplier", "offset_x", "offset_y")
    moved = line.join(c, "line").select("line", "trace", (F.col("x") * F.col("multiplier") + F.col("offset_x")).alias("x"), (F.col("y") * F.col("multiplier") + F.col("offset_y")).alias("y"))
    return with_distance(moved)


def match_line_names(files: DataFrame, nav_lines: DataFrame) -> DataFrame:
    """(file, line): the longest navigation line that a file's name equals or ends with behind '-', '_' or a blank. Case is ignored.

    Every suffix that could be a line's name becomes a join key, so no pair of file and line is tried in vain.
    """
    name = F.lower(F.regexp_replace(F.regexp_extract("file", r"([^/\\]+)$", 1), r"\.[^.]*$", ""))
    suffixes = F.expr("filter(transform(sequence(1, length(n)), i -> if(i = 1 OR substring(n, i - 1, 1) IN ('-', '_', ' '), substring(n, i), NULL)), s -> s IS NOT NULL)")
    keyed = files.select("file", name.alias("n")).withColumn("key", F.explode(suffixes))
    hits = keyed.join(nav_lines.select(F.lower("line").alias("key"), "line"), "key")
    return hits.groupBy("file").agg(F.max_by("line", F.struct(F.length("key"), "line")).alias("line"))


def parse_navigation(text: DataFrame) -> DataFrame:
    """(line, sp, trace, x, y, min_trace, max_trace) of whitespace text (value): at least seven columns, '#' starts a comment, blank lines are skipped; a short or non-numeric row raises an error."""
    body = F.trim(F.regexp_replace("value", r"#.*$", ""))
    c = F.split(body, r"\s+")
    number = lambda i, t: F.try_element_at(c, F.lit(i)).try_cast(t)
    parsed = text.where(body != "").select(F.element_at(c, 1).alias("line"), number(2, "double").alias("sp"), number(3, "bigint").alias("trace"), number(4, "double").alias("x"), number(5, "double").alias("y"), number(6, "bigint").alias("min_trace"), number(7, "bigint").alias("max_trace"), "value")
    bad = F.greatest(*(F.col(k).isNull().cast("int") for k in ("sp", "trace", "x", "y", "min_trace", "max_trace"))) == 1
    return parsed.withColumn("sp", F.when(bad, F.raise_error(F.concat(F.lit("not a navigation row: "), F.col("value"))).cast("double")).otherwise(F.col("sp"))).drop("value")


#: Order values of a line that are hashed together, then hashes of these, and so on.
_TOGETHER = 4096


def fingerprint(line: DataFrame) -> DataFrame:
    """(line, fingerprint): hash of the line's traces and places to the centimetre, in order.

    A tree of hashes: of traces by 4,096 trace numbers, of these by 4,096, then of the line's; so no list is long.
    """
    cm = lambda k: F.round(F.col(k) * 100).cast("bigint").cast("string")
    text = F.concat_ws(":", F.col("trace").cast("string"), cm("x"), cm("y"))
    level = line.select("line", F.col("trace").alias("k"), F.md5(text.cast("binary")).alias("h"))
    together = F.md5(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda s: s["h"])).cast("binary"))
    for _ in range(2):
        level = level.groupBy("line", F.floor(F.col("k") / _TOGETHER).alias("up")).agg(together.alias("h")).withColumnRenamed("up", "k")
    return level.groupBy("line").agg(together.alias("fingerprint"))
