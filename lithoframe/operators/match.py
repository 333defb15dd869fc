"""A/B trace matching by exact keys of falling strength, with ambiguity kept apart; classes, reports, sample axes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import is_finite
from lithoframe.operators.ordering import numbered
from lithoframe.runtime import durable

STRATEGIES = ("source_receiver_id", "source_receiver_xy", "cdp_signed_offset")
CLASSES = ("matched", "a_only", "b_only", "ambiguous", "invalid")
DEFAULT_CLASSES = ("matched", "a_only")


def micro(c: Column | str) -> Column:
    """A coordinate in millionths, as a whole number: equal to six decimals, and -0 is 0."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1_000_000).cast("bigint")


def id_conflicts(both: DataFrame, kind: str) -> DataFrame:
    """(id): numbers seen at different places, or with and without a place, over both files together. Number 0 is none."""
    i, x, y = f"{kind}_id", f"{kind}_x", f"{kind}_y"
    there = F.coalesce(F.col(f"has_{kind}"), F.lit(False)) & is_finite(x) & is_finite(y)
    seen = both.where(F.coalesce(F.col(i), F.lit(0)) != 0).groupBy(F.col(i).alias("id")).agg(F.count_distinct(F.when(there, F.struct(micro(x), micro(y)))).alias("places"), F.count_if(~there).alias("missing"))
    return seen.where("places > 1 OR (places > 0 AND missing > 0)").select("id")


def is_valid() -> Column:
    return F.coalesce(F.col("header_valid"), F.lit(False)) & (F.coalesce(F.col("header_error"), F.lit("")) == "")


def candidate_keys(df: DataFrame, source_conflicts: DataFrame, receiver_conflicts: DataFrame) -> DataFrame:
    """(side, ord, rank, key): the keys of every valid record, strongest first (rank 0). A conflicting number takes part in no number key."""
    df = df.join(source_conflicts.select(F.col("id").alias("source_id"), F.lit(True).alias("sc")), "source_id", "left").join(receiver_conflicts.select(F.col("id").alias("receiver_id"), F.lit(True).alias("rc")), "receiver_id", "left")
    numbered = (F.coalesce(F.col("source_id"), F.lit(0)) != 0) & (F.coalesce(F.col("receiver_id"), F.lit(0)) != 0) & F.col("sc").isNull() & F.col("rc").isNull()
    placed = F.col("has_source") & F.col("has_receiver")
    for c in ("source_x", "source_y", "receiver_x", "receiver_y"):
        placed = placed & is_finite(c)
    keys = F.array(
        F.when(numbered, F.struct(F.lit(0).alias("rank"), F.concat_ws(":", F.lit("id"), "source_id", "receiver_id").alias("key"))),
        F.when(placed, F.struct(F.lit(1).alias("rank"), F.concat_ws(":", F.lit("xy"), *(micro(c) for c in ("source_x", "source_y", "receiver_x", "receiver_y"))).alias("key"))),
        F.when(F.col("has_cdp") & F.col("has_offset") & is_finite("trace_offset"), F.struct(F.lit(2).alias("rank"), F.concat_ws(":", F.lit("cdp"), "cdp", micro("trace_offset")).alias("key"))),
    )
    return df.where(is_valid()).select("side", "ord", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("side", "ord", "k.rank", "k.key")


#: A's that one task settles in order; the set of taken B's is what it holds. More are settled in as many steps.
SERIAL_ROWS = 1_000_000


def _in_order(candidates: DataFrame) -> DataFrame:
    """(a, b, rank): the serial rule over candidates of at most SERIAL_ROWS A's, by one task that reads them in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set[int] = set()
        settled = None
        for batch in batches:
            won = []
            for a, b, rank in zip(*(c.to_pylist() for c in batch.columns)):
                if a != settled and b not in taken:
                    settled = a
                    taken.add(b)
                    won.append((a, b, rank))
            cols = list(zip(*won)) if won else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "rank"])

    rows = candidates.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("rank").cast("int").alias("rank"))
    return rows.repartition(1).sortWithinPartitions("a", "rank", "b").mapInArrow(work, "a bigint, b bigint, rank int")


def _serial(candidates: DataFrame) -> DataFrame:
    """(a, b, rank): the pairs that result when each A, in order, takes the first of its candidates (a, rank, b) that is still free.

    Records whose candidates nobody else wants are settled at once. The rest, few as a rule, are walked
    in order SERIAL_ROWS A's at a time, so chains of rivals may be of any length.
    """
    rivals = candidates.groupBy("b").agg(F.count_distinct("a").alias("n")).where("n > 1").select("b")
    contested = candidates.join(rivals, "b").select("a").distinct()
    # A's without rivals never meet those with: they share no B
    free = candidates.join(contested, "a", "left_anti").groupBy("a").agg(F.min_by("b", "rank").alias("b"), F.min("rank").alias("rank"))
    steps = -(-contested.count() // SERIAL_ROWS)
    if steps == 0:
        return free
    if steps == 1:
        return free.unionByName(_in_order(candidates.join(contested, "a", "left_semi")))
    step = numbered(contested, ["a"]).select("a", F.floor(F.col("n") / SERIAL_ROWS).alias("step"))
    rest, done = durable(candidates.join(step, "a")), free
    for k in range(steps):
        of_step = rest.where(F.col("step") == k)
        won = durable(_in_order(of_step if k == 0 else of_step.join(done.select("b"), "b", "left_anti")))
        done = done.unionByName(won)
    return done


def match(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes) of two files of records with a column ord that orders each of them.

    pairs: (a_ord, b_ord, strategy). classes: (side, ord, class) of every record; a record may be in
    two classes only as a B that is both matched and ambiguous. A key that isn't unique on both sides
    decides nothing: weaker keys are tried, and only if all fail is its whole group ambiguous, which
    also withdraws pairs already made for an A of the group. Without any key on either side, files of
    equal length with valid headers only are paired in order.
    """
    columns = "ord source_id receiver_id source_x source_y receiver_x receiver_y has_source has_receiver cdp has_cdp trace_offset has_offset header_valid header_error".split()
    both = a.select(F.lit("a").alias("side"), *columns).unionByName(b.select(F.lit("b").alias("side"), *columns))
    keys = candidate_keys(both, id_conflicts(both, "source"), id_conflicts(both, "receiver"))
    counts = keys.groupBy("key").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    known = durable(keys.join(counts, "key"))
    ka, kb = known.where("side = 'a'"), known.where("side = 'b'")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("ord")))
    unique = durable(known.where("na = 1 AND nb = 1").groupBy("key").agg(of("a").alias("a"), F.max("rank").alias("rank"), of("b").alias("b")).select("a", "rank", "b"))
    tentative = durable(_serial(unique))
    lost = ka.join(tentative.select(F.col("a").alias("ord")), "ord", "left_anti")
    group = lost.where("nb >= 1 AND (na > 1 OR nb > 1)").select("key").distinct()
    beaten = lost.where("na = 1 AND nb = 1").select("ord", "key").join(kb.select("key", F.col("ord").alias("b")), "key")
    amb_a = ka.join(group, "key", "left_semi").select("ord").unionByName(beaten.select("ord")).distinct()
    withdrawn = tentative.join(amb_a.select(F.col("ord").alias("a")), "a", "left_semi")
    pairs = tentative.join(amb_a.select(F.col("ord").alias("a")), "a", "left_anti")
    amb_b = kb.join(group, "key", "left_semi").select("ord").unionByName(beaten.select(F.col("b").alias("ord"))).unionByName(withdrawn.select(F.col("b").alias("ord"))).distinct()
    by_rank = F.element_at(F.array(*(F.lit(s) for s in STRATEGIES)), F.col("rank") + 1)
    found = pairs.select(F.col("a").alias("a_ord"), F.col("b").alias("b_ord"), by_rank.alias("strategy"))

    # the fallback: one row of facts decides it for all
    facts = both.agg((F.count_if(F.col("side") == "a") == F.count_if(F.col("side") == "b")).alias("equal"), F.coalesce(F.bool_and(is_valid()), F.lit(False)).alias("valid"))
    plain = facts.collect()[0]
    if plain["equal"] and plain["valid"] and not known.take(1):
        nth = lambda df, name: numbered(df.select(F.col("ord").alias(name)), [name])
        found = nth(a, "a_ord").join(nth(b, "b_ord"), "n").select("a_ord", "b_ord", F.lit("physical_trace_order").alias("strategy"))
        return found, found.select(F.lit("a").alias("side"), F.col("a_ord").alias("ord"), F.lit("matched").alias("class")).unionByName(found.select(F.lit("b"), F.col("b_ord"), F.lit("matched")).toDF("side", "ord", "class"))

    def classed(df: DataFrame, side: str, name: str) -> DataFrame:
        return df.select(F.lit(side).alias("side"), "ord", F.lit(name).alias("class"))

    keyed = known.select("side", "ord").distinct()
    invalid = both.select("side", "ord").join(keyed, ["side", "ord"], "left_anti").withColumn("class", F.lit("invalid"))
    out = invalid
    for side, amb in (("a", amb_a), ("b", amb_b)):
        hit = found.select(F.col(f"{side}_ord").alias("ord"))
        rest = keyed.where(F.col("side") == side).select("ord").join(amb, "ord", "left_anti").join(hit, "ord", "left_anti")
        out = out.unionByName(classed(hit, side, "matched")).unionByName(classed(amb, side, "ambiguous")).unionByName(classed(rest, side, f"{side}_only"))
    return found, out


def logical_rows(pairs: DataFrame, classes: DataFrame, allowed: tuple[str, ...] = DEFAULT_CLASSES) -> DataFrame:
    """(row, class, a_ord, b_ord): what a comparison shows, A's records in order with their partners, then B's without one."""
    a = classes.where("side = 'a'").select(F.col("ord").alias("a_ord"), "class").join(pairs.select("a_ord", "b_ord"), "a_ord", "left").withColumn("part", F.lit(0))
    b = classes.where("side = 'b' AND class <> 'matched'").select(F.lit(None).cast("bigint").alias("a_ord"), "class", F.col("ord").alias("b_ord"), F.lit(1).alias("part"))
    rows = a.select("a_ord", "class", "b_ord", "part").unionByName(b).where(F.col("class").isin(*allowed))
    return numbered(rows.withColumn("_o", F.coalesce("a_ord", "b_ord")), ["part", "_o", "class"], "row").select("row", "class", "a_ord", "b_ord")


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class", "side").agg(F.count(F.lit(1)).alias("n"))


# The columns of a comparison's report, in order. Numbers of traces are physical ones from 0.
SCHEMA_VERSION = "1.1"
_SUMMARY = "schema_version a_path b_path selection primary secondary sample_window_start sample_window_end strategy matched a_only b_only ambiguous_a ambiguous_b invalid_a invalid_b sample_axis_compatible axis_reason reason".split()
_ROW = "classification category a_trace b_trace pair_strategy key_strategy source_id receiver_id cdp offset key_source_x key_source_y key_receiver_x key_receiver_y".split()
_META = "trace_number source_id receiver_id cdp inline crossline source_x source_y receiver_x receiver_y midpoint_x midpoint_y header_offset computed_offset offset azimuth".split()
REPORT_COLUMNS = [*_SUMMARY, *_ROW, *(f"{s}_{c}" for s in "ab" for c in _META)]


def report(pairs: DataFrame, classes: DataFrame, a: DataFrame, b: DataFrame, axis: tuple[bool, str] = (True, ""), window: tuple[int, int] = (0, 0), **provenance: str) -> DataFrame:
    """REPORT_COLUMNS: a row for every pair and for every record that is in another class, each with the summary; a row "summary" alone if there is none.

    provenance: a_path, b_path, selection, primary, secondary. Only header words, never samples. Of a
    pair's key the parts it doesn't use are 0; rows without a pair have no key and the strategy "invalid".
    """
    if unknown := set(provenance) - {"a_path", "b_path", "selection", "primary", "secondary"}:
        raise ValueError(f"a report has no {', '.join(sorted(unknown))}")
    six = lambda c: micro(c) / F.lit(1e6)

    def side(df: DataFrame, s: str) -> DataFrame:
        there = set(df.columns)
        name = lambda c: "trace_offset" if c == "offset" else c
        return df.select(F.col("ord").alias(f"{s}_ord"), *((F.col(name(c)) if name(c) in there else F.lit(None).cast("double")).alias(f"{s}_{c}") for c in _META))

    matched = pairs.select("a_ord", "b_ord", F.lit("matched").alias("classification"), "strategy")
    alone = classes.where("class <> 'matched'").select(
        F.when(F.col("side") == "a", F.col("ord")).alias("a_ord"), F.when(F.col("side") == "b", F.col("ord")).alias("b_ord"),
        F.when(F.col("class").isin("ambiguous", "invalid"), F.concat_ws("_", "class", "side")).otherwise(F.col("class")).alias("classification"), F.lit("invalid").alias("strategy"),
    )
    rows = matched.unionByName(alone).join(side(a, "a"), "a_ord", "left").join(side(b, "b"), "b_ord", "left")
    names = ("matched", "a_only", "b_only", "ambiguous_a", "ambiguous_b", "invalid_a", "invalid_b")
    of_pair = F.col("classification") == "matched"
    counts = matched.unionByName(alone).agg(*(F.count_if(F.col("classification") == c).alias(c) for c in names), F.min(F.when(of_pair, F.col("strategy"))).alias("_s0"), F.max(F.when(of_pair, F.col("strategy"))).alias("_s1"))
    reason = F.when(F.col("matched") > 0, F.when(F.col("_s0") == "physical_trace_order", F.lit("paired in order, as headers have no usable keys")).otherwise(F.lit(""))).when(F.col("a_only") + F.col("b_only") + F.col("ambiguous_a") + F.col("ambiguous_b") == 0, F.lit("no valid headers to match by")).otherwise(F.lit("no pair"))
    said = {"schema_version": F.lit(SCHEMA_VERSION), **{c: F.lit(provenance.get(c, "")) for c in ("a_path", "b_path", "selection", "primary", "secondary")}, "sample_window_start": F.lit(window[0]), "sample_window_end": F.lit(window[1]), "sample_axis_compatible": F.lit(axis[0]), "axis_reason": F.lit(axis[1])}
    strategy = F.when(F.col("_s0").isNull(), F.lit("invalid")).when(F.col("_s0") == F.col("_s1"), F.col("_s0")).otherwise(F.lit("mixed"))
    summary = counts.select(*(said[c].alias(c) if c in said else strategy.alias(c) if c == "strategy" else reason.alias(c) if c == "reason" else F.col(c) for c in _SUMMARY))
    by, zero = F.col("_strategy"), F.lit(0)
    part = lambda c, s: F.when(of_pair, F.when(by == s, c).otherwise(zero))
    key = {
        **{c: part(F.col(f"a_{c}"), "source_receiver_id") for c in ("source_id", "receiver_id")}, "cdp": part(F.col("a_cdp"), "cdp_signed_offset"), "offset": part(six("a_offset"), "cdp_signed_offset"),
        **{f"key_{c}": part(six(f"a_{c}"), "source_receiver_xy") for c in ("source_x", "source_y", "receiver_x", "receiver_y")},
    }
    row = {
        "category": F.regexp_replace("classification", "^(ambiguous|invalid)_[ab]$", "$1"), "a_trace": F.col("a_trace_number"), "b_trace": F.col("b_trace_number"), "pair_strategy": by,
        "key_strategy": F.when(of_pair, by), **key,
    }
    typed = rows.withColumnRenamed("strategy", "_strategy")
    met = summary.join(typed, F.lit(True), "left").withColumn("classification", F.coalesce("classification", F.lit("summary")))
    return met.select(*(row[c].alias(c) if c in row else F.col(c) for c in REPORT_COLUMNS))


def write_report_json(rows: DataFrame, path: str) -> None:
    """The report as a folder: summary.json, one object, and rows as JSON lines. What isn't there is left out, trace 0 is kept."""
    first = rows.select(*_SUMMARY).limit(1).collect()[0].asDict()
    rows.where("classification <> 'summary'").drop(*_SUMMARY).write.mode("overwrite").json(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(first),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary.json")


def axis_reasons(pairs: DataFrame) -> DataFrame:
    """Adds compatible and reason to pairs with a_/b_ sample_count, sample_interval_us and delay_ms."""
    differ = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    reason = F.concat_ws(
        "; ", F.when(differ("sample_interval_us"), "sample interval mismatch"), F.when(differ("sample_count"), "sample count mismatch"), F.when(differ("delay_ms"), "delay mismatch; time origin mismatch")
    )
    return pairs.withColumn("reason", reason).withColumn("compatible", F.col("reason") == "")


def sample_of_b(sample_a: Column, dt_a: Column, dt_b: Column, n_b: Column) -> Column:
    """The sample of B at the time of a sample of A, clamped to B."""
    return F.greatest(F.lit(0), F.least(F.round(sample_a * dt_a / dt_b).cast("bigint"), n_b - 1))
