"""Points near other points and points within rectangles, by cell coverage.

Both joins are equi-joins on grid cells. What a cell alone decides is accepted at once; only what
touches a border is tested exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.runtime import broadcast_if_small, finite

#: Cell sizes of the coverage grow by this factor from level to level.
LEVEL_FACTOR = 4
#: Stands for a null group, so that group is a plain join key and all joins share one exchange.
NO_GROUP = "\0"
#: A coverage of at most so many rows (about 10 MB as a hash table) is broadcast.
BROADCAST_COVER_ROWS = 100_000


def distinct_positions(df: DataFrame, id_col: str, group_col: str, x: str = "x", y: str = "y", valid: str | None = "valid") -> DataFrame:
    """The located points (id, grp, x, y), each delivered position once.

    Rows whose id is null, whose `valid` isn't true or whose position isn't finite have no place and
    are left out. If copies of an id disagree, each of its positions counts.
    """
    keep = finite(F.col(x)) & finite(F.col(y)) & F.col(id_col).isNotNull()
    if valid:
        keep = keep & F.col(valid)
    return df.where(keep).select(F.col(id_col).alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit(NO_GROUP)).alias("grp"), F.col(x).alias("x"), F.col(y).alias("y")).distinct()


def blocks_of(points: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(points with their cell cx, cy; one row with bounding box per cell and group).

    Points of one group in one cell form a block. Both joins meet blocks first and go back to the
    points of the blocks that met only, so a group that stands still costs one block.
    """
    pts = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return pts, pts.groupBy("cx", "cy", "grp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def near_pairs(points: DataFrame, distance: float, cell: float | None = None) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of different groups at most `distance` apart.

    points: the result of distinct_positions. A point without a group belongs to no known one and
    has no pairs. Blocks of different groups meet through the cells that their boxes, widened by the
    distance, touch. Blocks that lie within the distance as a whole are accepted without a test per
    pair; of the others each pair is tested exactly.
    """
    size = float(cell or 4 * distance)
    pts, blocks = blocks_of(points, size)
    home = blocks.select(*(F.col(c).alias(f"a_{c}") for c in blocks.columns))

    def reach(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(lo) - distance) / size), F.floor((F.col(hi) + distance) / size)))

    spread = (
        blocks.select(*(F.col(c).alias(f"b_{c}") for c in blocks.columns))
        .withColumn("a_cx", reach("b_x0", "b_x1"))
        .withColumn("a_cy", reach("b_y0", "b_y1"))
    )
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"a_{k}0") - F.col(f"b_{k}1"), F.col(f"b_{k}0") - F.col(f"a_{k}1"))
    far = lambda k: F.greatest(F.col(f"a_{k}1") - F.col(f"b_{k}0"), F.col(f"b_{k}1") - F.col(f"a_{k}0"))
    limit = distance * distance
    # Of both sides at once: a filter on one would sink below the shared exchange and split it in two.
    known = (F.least("a_grp", "b_grp") != NO_GROUP) & (F.greatest("a_grp", "b_grp") != NO_GROUP)
    met = (
        home.join(spread, ["a_cx", "a_cy"])
        .where((F.col("a_grp") < F.col("b_grp")) & known & (gap("x") * gap("x") + gap("y") * gap("y") <= limit * (1 + 1e-9)))
        .withColumn("inner", far("x") * far("x") + far("y") * far("y") <= limit * (1 - 1e-9))
        .select("a_cx", "a_cy", "a_grp", "b_cx", "b_cy", "b_grp", "b_x0", "b_x1", "b_y0", "b_y1", "inner")
    )
    a = pts.select(*(F.col(c).alias(f"a_{c}") for c in pts.columns))
    b = pts.select(*(F.col(c).alias(f"b_{c}") for c in pts.columns))
    off = lambda k: F.greatest(F.lit(0.0), F.col(f"b_{k}0") - F.col(f"a_{k}"), F.col(f"a_{k}") - F.col(f"b_{k}1"))
    left = (
        met.join(a, ["a_cx", "a_cy", "a_grp"])
        .where(F.col("inner") | (off("x") * off("x") + off("y") * off("y") <= limit * (1 + 1e-9)))
        .select("a_id", "a_x", "a_y", "b_cx", "b_cy", "b_grp", "inner")
    )
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    return (
        left.join(b, ["b_cx", "b_cy", "b_grp"])
        .where((F.col("inner") | (F.sqrt(dx * dx + dy * dy) <= distance)) & (F.col("a_id") != F.col("b_id")))
        .select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))
    )


def normal_ranges(df: DataFrame, id_col: str = "range_id", valid: str | None = "valid") -> DataFrame:
    """Rectangles (rid, x0, x1, y0, y1) with ordered bounds.

    Left out: null id, `valid` not true, a bound that isn't finite, no extent in x or y. A rectangle
    sent again counts once.
    """
    bounds = [F.col(c) for c in ("x_min", "x_max", "y_min", "y_max")]
    keep = reduce(lambda p, q: p & q, (finite(b) for b in bounds)) & (F.col("x_min") != F.col("x_max")) & (F.col("y_min") != F.col("y_max")) & F.col(id_col).isNotNull()
    if valid:
        keep = keep & F.col(valid)
    ordered = lambda f, k: f(F.col(f"{k}_min").cast("double"), F.col(f"{k}_max").cast("double"))
    return df.where(keep).select(F.col(id_col).alias("rid"), ordered(F.least, "x").alias("x0"), ordered(F.greatest, "x").alias("x1"), ordered(F.least, "y").alias("y0"), ordered(F.greatest, "y").alias("y1")).distinct()


def cover(ranges: DataFrame, finest: float, per_side: int = 4) -> DataFrame:
    """Disjoint cells (level, cx, cy) that cover each rectangle, with `inner` for cells wholly inside.

    The level follows the rectangle's size, so each has at most (per_side + 1)^2 cells however large
    it is. Border cells above the finest level are split once more into LEVEL_FACTOR^2 smaller cells,
    of which those outside are dropped.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.greatest(F.lit(0.0), F.ceil(F.log(side / (per_side * finest)) / F.log(F.lit(float(LEVEL_FACTOR))))).cast("int")

    def cells(df: DataFrame, split: bool) -> DataFrame:
        df = df.withColumn("size", F.lit(finest) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("level")))
        first, last = (lambda k: F.floor(F.col(f"{k}0") / F.col("size"))), (lambda k: F.floor(F.col(f"{k}1") / F.col("size")))
        if split:  # each border cell's children that touch the rectangle
            lo = lambda k: F.greatest(F.col(f"c{k}") * LEVEL_FACTOR, first(k))
            hi = lambda k: F.least(F.col(f"c{k}") * LEVEL_FACTOR + LEVEL_FACTOR - 1, last(k))
        else:
            lo, hi = first, last
        df = df.withColumns({"fx": lo("x"), "lx": hi("x"), "fy": lo("y"), "ly": hi("y")}).where("fx <= lx and fy <= ly")
        df = df.withColumn("cx", F.explode(F.sequence("fx", "lx"))).withColumn("cy", F.explode(F.sequence("fy", "ly")))
        within = lambda k: (F.col(f"c{k}") * F.col("size") >= F.col(f"{k}0")) & ((F.col(f"c{k}") + 1) * F.col("size") <= F.col(f"{k}1"))
        return df.withColumn("inner", within("x") & within("y")).select("rid", "x0", "x1", "y0", "y1", "level", "cx", "cy", "inner")

    top = cells(ranges.withColumn("level", level), False)
    fine = cells(top.where("not inner and level > 0").withColumn("level", F.col("level") - 1), True)
    return top.where("inner or level = 0").unionByName(fine)


def containing_ranges(points: DataFrame, ranges: DataFrame, cell: float = 64.0, broadcast_rows: int = BROADCAST_COVER_ROWS) -> DataFrame:
    """Pairs (id_a, id_b): point id and id of a rectangle that contains it, edges included.

    points: the result of distinct_positions; ranges: that of normal_ranges. A block lies in one cell
    of each level, so the blocks meet the coverage once for each level in use (a handful: the sizes
    grow by LEVEL_FACTOR). A block in an inner cell, or whose box is inside, is accepted whole; of
    the rest the points are tested. A coverage of at most `broadcast_rows` rows is broadcast, a
    larger one is joined by a shuffle, where adaptive execution splits hot cells.
    """
    pts, blocks = blocks_of(points, cell)
    covered = cover(ranges, cell)
    at = points.sparkSession
    levels = sorted(r[0] for r in covered.select("level").distinct().collect())  # at most one per power of LEVEL_FACTOR
    if not levels:
        return at.createDataFrame([], "id_a bigint, id_b bigint")
    keys = F.array(*(F.struct(F.lit(n).alias("level"), *(F.floor(F.col(c) / LEVEL_FACTOR**n).alias(f"k{c}") for c in ("cx", "cy"))) for n in levels))
    keyed = blocks.select("*", F.explode(keys).alias("k")).select("cx", "cy", "grp", "x0", "x1", "y0", "y1", "k.*")
    side = broadcast_if_small(covered.select("level", F.col("cx").alias("kcx"), F.col("cy").alias("kcy"), "rid", "inner", *(F.col(c).alias(f"r_{c}") for c in ("x0", "x1", "y0", "y1"))), broadcast_rows)
    apart = reduce(lambda p, q: p | q, (F.col(f"{k}1") < F.col(f"r_{k}0") for k in "xy")) | reduce(lambda p, q: p | q, (F.col(f"{k}0") > F.col(f"r_{k}1") for k in "xy"))
    whole = reduce(lambda p, q: p & q, ((F.col(f"{k}0") >= F.col(f"r_{k}0")) & (F.col(f"{k}1") <= F.col(f"r_{k}1")) for k in "xy"))
    met = keyed.join(side, ["level", "kcx", "kcy"]).where(F.col("inner") | ~apart).select("cx", "cy", "grp", "rid", (F.col("inner") | whole).alias("inner"), "r_x0", "r_x1", "r_y0", "r_y1")
    exact = F.col("x").between(F.col("r_x0"), F.col("r_x1")) & F.col("y").between(F.col("r_y0"), F.col("r_y1"))
    return met.join(pts, ["cx", "cy", "grp"]).where(F.col("inner") | exact).select(F.col("id").alias("id_a"), F.col("rid").alias("id_b"))
