"""Per-trace statistics, spectra, gain and differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.operators.gathers import with_flags

MIN_SAMPLES, MAX_SAMPLES, FLOOR_DB = 32, 65_536, -80.0


def finite_only(samples: Column | str) -> Column:
    """The finite samples of an array column."""
    return F.filter(samples, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _sum(a: Column, f=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))


def order_statistic(sorted_: Column, k: Column) -> Column:
    return F.try_element_at(sorted_, k.cast("int") + 1)


def percentile_of(sorted_: Column, p: float) -> Column:
    """Linear percentile p in 0..100 of a sorted array; null for an empty one."""
    at = (F.size(sorted_) - 1) * F.lit(p / 100.0)
    lo, hi = F.floor(at), F.ceil(at)
    a, b = order_statistic(sorted_, lo), order_statistic(sorted_, hi)
    return a + (b - a) * (at - lo)


def trace_stats(df: DataFrame, samples: str = "samples") -> DataFrame:
    """(trace, n, finite, zeros, finite_ratio, zero_ratio, minimum, maximum, mean, rms, std, peak, p01, p05, p50, p95, p99).

    Non-finite samples count in n alone; the zero ratio is over the finite ones. Without any the statistics are null.
    """
    prepared = df.select("trace", F.size(samples).alias("n"), F.sort_array(finite_only(samples)).alias("s")).withColumn("k", F.size("s"))
    some = lambda c: F.when(F.col("k") > 0, c)
    mean = _sum(F.col("s")) / F.nullif(F.col("k"), F.lit(0))
    s = prepared.withColumns({"mean": mean, "zeros": F.size(F.filter("s", lambda v: v == 0)), "sq": _sum(F.col("s"), lambda v: v * v) / F.nullif(F.col("k"), F.lit(0))})
    spread = F.aggregate(F.col("s"), F.lit(0.0), lambda t, v: t + (v - F.col("mean")) * (v - F.col("mean"))) / F.nullif(F.col("k"), F.lit(0))
    first, last = F.try_element_at("s", F.lit(1)), F.try_element_at("s", F.lit(-1))
    return s.select(
        "trace", "n", F.col("k").alias("finite"), "zeros", F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias("finite_ratio"), F.try_divide("zeros", "k").alias("zero_ratio"),
        first.alias("minimum"), last.alias("maximum"), "mean", F.sqrt("sq").alias("rms"), F.sqrt(spread).alias("std"), F.greatest(F.abs(first), F.abs(last)).alias("peak"),
        *(some(percentile_of(F.col("s"), p)).alias(f"p{p:02d}") for p in (1, 5, 50, 95, 99)),
    )


def rms(samples: Column | str) -> Column:
    """Root mean square of the finite samples, null without any."""
    s = finite_only(samples)
    return F.sqrt(F.try_divide(_sum(s, lambda v: v * v), F.size(s)))


def agc(samples: Column | str) -> Column:
    """The samples over their root mean square; a silent trace stays as it is."""
    g = rms(samples)
    return F.transform(samples, lambda v: F.when(g > 0, v / g).otherwise(v))


def difference(a: Column | str, b: Column | str) -> Column:
    """a - b sample by sample; null for arrays of different length."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x - y))


def difference_shorter(a: Column, b: Column) -> Column:
    """a - b over the length of the shorter one, as exports take it."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x - y)


def symmetric_range(samples: Column | str) -> Column:
    """struct<lo, hi> around 0 by the largest finite magnitude; (-1, 1) if that is 0 or nothing is finite."""
    m = F.coalesce(F.array_max(F.transform(finite_only(samples), lambda v: F.abs(v))), F.lit(0.0))
    top = F.when(m > 0, m).otherwise(F.lit(1.0))
    return F.struct((-top).alias("lo"), top.alias("hi"))


def visual_scale(samples: Column | str, robust: bool = False) -> Column:
    """Peak magnitude, or the larger magnitude of the 1st and 99th percentile."""
    s = F.sort_array(finite_only(samples))
    if robust:
        return F.greatest(F.abs(percentile_of(s, 1)), F.abs(percentile_of(s, 99)))
    return F.greatest(F.abs(F.try_element_at(s, F.lit(1))), F.abs(F.try_element_at(s, F.lit(-1))))


def fft_length(n: int, keep_all: bool = True, cap: int = MAX_SAMPLES) -> int:
    """The power of two that holds n samples, or with keep_all False the largest one within them and the cap."""
    if n <= 0:
        return 0
    up = 1 << (n - 1).bit_length()
    return up if keep_all else min(cap, up if up == n else up >> 1)


def amplitudes(rows: np.ndarray, interval_us: float, keep_all: bool = True, cap: int = MAX_SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(which rows, frequencies, amplitudes) of traces of one length: mean taken off, symmetric Hann window, zeros up to a power of two; rows below MIN_SAMPLES finite samples are left out, None above MAX_SAMPLES or if no row is left."""
    good = np.isfinite(rows)
    at = np.flatnonzero(good.sum(1) >= MIN_SAMPLES)
    if not len(at) or rows.shape[1] > MAX_SAMPLES or not interval_us > 0:
        return None
    n = fft_length(rows.shape[1], keep_all, cap)
    s, g = (v[at] if keep_all else v[at, :n] for v in (np.where(good, rows, 0.0), good))
    mean = np.divide(s.sum(1), g.sum(1), out=np.full(len(at), np.nan), where=g.any(1))
    s = np.where(g, s - mean[:, None], 0.0) * np.hanning(s.shape[1])
    return at, np.fft.rfftfreq(n, interval_us * 1e-6), np.abs(np.fft.rfft(s, n, axis=1))


def amplitude(samples: np.ndarray, interval_us: float, keep_all: bool = True, cap: int = MAX_SAMPLES) -> tuple[np.ndarray, np.ndarray] | None:
    """(frequencies, amplitudes) of one trace; None if it has too few finite samples or too many samples."""
    got = amplitudes(np.asarray(samples, float)[None, :], interval_us, keep_all, cap)
    return (got[1], got[2][0]) if got else None


def decibels_of_rows(amp: np.ndarray) -> np.ndarray:
    """Relative to each row's largest amplitude but that of frequency 0, not below FLOOR_DB; all FLOOR_DB for a flat trace."""
    top = amp[:, 1:].max(1, initial=0.0)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        db = np.where(top > 1e-12, 20 * np.log10(amp / top), FLOOR_DB)
    return np.maximum(np.nan_to_num(db, nan=FLOOR_DB, neginf=FLOOR_DB), FLOOR_DB)


def decibels(amp: np.ndarray) -> np.ndarray:
    """decibels_of_rows of one trace."""
    return decibels_of_rows(np.asarray(amp, float)[None, :])[0]


def spectra(df: DataFrame, interval_us: float, samples: str = "samples", keep_all: bool = True) -> DataFrame:
    """(trace, bin, frequency, amplitude, db) of every trace that has enough finite samples. FFTs run on Arrow batches: SQL has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            traces, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            starts, out = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), []
            for n in np.unique(size):  # traces of one length at a time
                at = np.flatnonzero(size == n)
                got = amplitudes(flat[starts[at][:, None] + np.arange(n)], interval_us, keep_all)
                if got:
                    ok, f, a = got
                    out.append((np.repeat(traces[at[ok]], len(f)), np.tile(np.arange(len(f)), len(ok)), np.tile(f, len(ok)), a.ravel(), decibels_of_rows(a).ravel()))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names=["trace", "bin", "frequency", "amplitude", "db"])

    return df.select(F.col("trace").cast("bigint").alias("trace"), F.col(samples).alias("s")).mapInArrow(work, "trace bigint, bin int, frequency double, amplitude double, db double")


def mean_spectrum(spectra_: DataFrame) -> DataFrame:
    """(bin, frequency, amplitude, db): mean amplitudes over the traces, in decibels of the largest one beyond frequency 0."""
    mean = spectra_.groupBy("bin").agg(F.first("frequency").alias("frequency"), F.avg("amplitude").alias("amplitude"))
    top = mean.agg(F.max(F.when(F.col("bin") > 0, F.col("amplitude"))).alias("top"))
    db = F.greatest(F.lit(FLOOR_DB), 20 * F.log10(F.greatest(F.try_divide("amplitude", "top"), F.lit(1e-12))))
    return with_flags(mean, top).select("bin", "frequency", "amplitude", F.coalesce(db, F.lit(FLOOR_DB)).alias("db"))


def spectrum_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bin, frequency, db): decibels of A less those of B at A's frequencies, B interpolated and its ends held. Both are spectra of a few thousand bins at most."""
    from pyspark.sql import Window

    both = a.select("frequency", "bin", "db", F.lit(None).cast("struct<frequency:double,db:double>").alias("p")).unionByName(b.select("frequency", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("db"), F.struct("frequency", "db").alias("p")))
    lo = F.last("p", ignorenulls=True).over(Window.orderBy("frequency", F.col("bin").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("p", ignorenulls=True).over(Window.orderBy(F.desc("frequency"), F.col("bin").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    met = both.select("bin", "frequency", "db", lo.alias("l"), hi.alias("h")).where("bin IS NOT NULL")
    f = F.coalesce(F.try_divide(F.col("frequency") - F.col("l.frequency"), F.col("h.frequency") - F.col("l.frequency")), F.lit(0.0))
    at = F.when(F.col("l").isNull(), F.col("h.db")).when(F.col("h").isNull(), F.col("l.db")).otherwise(F.col("l.db") + (F.col("h.db") - F.col("l.db")) * f)
    return met.select("bin", "frequency", (F.col("db") - at).alias("db"))


def envelope(df: DataFrame, rows: int, samples: str = "samples") -> DataFrame:
    """(trace, row, run, first, last, lo, hi): the waveform of each output row, finite stretches apart."""
    from pyspark.sql import Window

    each = df.select("trace", F.size(samples).alias("n"), F.posexplode(samples).alias("i", "v"))
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    run = F.sum((~ok).cast("int")).over(Window.partitionBy("trace").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("run", run).where(ok).withColumn("row", F.floor(F.col("i") * rows / F.col("n")).cast("int"))
    return placed.groupBy("trace", "row", "run").agg(F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def analyse(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of traces A and B and of A - B: (id, role, ...columns of trace_stats but trace, note).

    pairs is (id, a_trace, b_trace), a and b are (trace, samples, interval_us, first_sample). The
    difference has statistics only where both are there with the same interval and window; note says what is in the way.
    """
    side = lambda df, s: df.select(F.col("trace").alias(f"{s}_trace"), *(F.col(c).alias(f"{s}_{c}") for c in ("samples", "interval_us", "first_sample")))
    met = pairs.select("id", "a_trace", "b_trace").join(side(a, "a"), "a_trace", "left").join(side(b, "b"), "b_trace", "left")
    differ = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    note = F.when(F.col("a_samples").isNull() | F.col("b_samples").isNull(), F.lit("a side is missing")).when(differ("interval_us"), F.lit("sample intervals differ")).when(differ("first_sample") | (F.size("a_samples") != F.size("b_samples")), F.lit("sample windows differ"))
    roles = F.array(
        F.struct(F.lit("A").alias("role"), F.col("a_samples").alias("samples"), F.lit(None).cast("string").alias("note")),
        F.struct(F.lit("B").alias("role"), F.col("b_samples").alias("samples"), F.lit(None).cast("string").alias("note")),
        F.struct(F.lit("A-B").alias("role"), F.when(note.isNull(), difference("a_samples", "b_samples")).alias("samples"), note.alias("note")),
    )
    each = met.select("id", F.explode(roles).alias("r")).select(F.struct("id", "r.role", "r.note").alias("trace"), "r.samples").where("samples IS NOT NULL OR trace.note IS NOT NULL")
    stats = trace_stats(each)
    return stats.select("trace.id", "trace.role", *(c for c in stats.columns if c != "trace"), "trace.note")
