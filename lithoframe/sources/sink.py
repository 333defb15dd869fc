"""Cropped SEG-Y export, byte for byte, and reports as CSV or JSON.

Traces are cropped and their headers patched in parallel; each task writes its run of traces into
its own place of the output file, which all executors reach, so nothing passes through the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators.ordering import numbered
from lithoframe.sources.segy import Layout, open_layout, register
from lithoframe.sources.words import BINARY_WORDS, SAMPLE_BYTES, TRACE_WORDS, encode_samples, read_word

RUN = 4096


def _put(raw: bytearray, byte: int, width: int, value: int, little: bool) -> None:
    raw[byte - 1 : byte - 1 + width] = (value & ((1 << 8 * width) - 1)).to_bytes(width, "little" if little else "big")


def reel_header(layout: Layout, samples: int, code: int | None = None) -> bytes:
    """The source's text, binary and extended headers, with count, interval, format and the fixed-length flag of the output."""
    with open(layout.path, "rb") as f:
        raw = bytearray(f.read(layout.data_start))
    for byte, value in ((3217, layout.interval_us), (3219, layout.interval_us), (3221, samples), (3223, samples), (3225, code or layout.code), (3503, 1)):
        _put(raw, byte, 2, value, layout.little)
    return bytes(raw)


def patch_trace(header: bytes, samples: int, interval_us: int, first: int, little: bool) -> bytes:
    """A trace header with the window's count and interval, and its delay moved on, held within 16 bits."""
    raw = bytearray(header)
    delay = int.from_bytes(raw[108:110], "little" if little else "big", signed=True)
    moved = delay + int(np.floor(first * interval_us / 1000.0 + 0.5))
    for byte, value in ((109, max(-32768, min(32767, moved))), (115, samples), (117, interval_us)):
        _put(raw, byte, 2, value, little)
    return bytes(raw)


def _write_runs(ordered: DataFrame, path: str, start: int, trace_bytes: int) -> int:
    """Writes (output_order, header, data) to the file, each task its runs; returns the traces written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as f:
            for batch in batches:
                for k, h, d in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(start + k * trace_bytes)
                    f.write(h + d)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    runs = ordered.repartition(F.floor(F.col("output_order") / RUN)).sortWithinPartitions("output_order")
    return runs.mapInArrow(work, "n bigint").agg(F.sum("n")).collect()[0][0] or 0


def _publish(temp: str, path: str, header: bytes, traces: int, trace_bytes: int, samples: int) -> None:
    """Reads the file back (length, layout, the first and the last trace's words) and puts it in place at once."""
    at = open_layout(temp)
    if at.size != len(header) + traces * trace_bytes or at.trace_bytes != trace_bytes or at.traces != traces or at.count != samples or at.data_start != len(header):
        raise ValueError(f"{temp}: {at.size} bytes with {at.traces} traces of {at.count} samples instead of {traces} of {samples}")
    with open(temp, "rb") as f:
        for k in (0, traces - 1):
            f.seek(at.data_start + k * trace_bytes + 114)
            said = f.read(4)
            if [read_word(said, i, 2, at.little, True) for i in (0, 2)] != [samples, at.interval_us]:
                raise ValueError(f"{temp}: trace {k} of the output names another sample count or interval")
    os.replace(temp, path)


def window_of(count: int, first: int, last: int | None) -> tuple[int, int]:
    """An inclusive sample window held within a trace; no end, or one beyond it, means the trace's. Raises ValueError if nothing is left."""
    first, last = max(0, first), count - 1 if last is None or not 0 <= last < count else last
    if first > last:
        raise ValueError(f"no sample in {first}..{last} of {count}")
    return first, last


def _not_source(path: str, *sources: str) -> None:
    for source in sources:
        if os.path.exists(path) and os.path.samefile(path, source):
            raise ValueError("the source can't be its own export")


def export_section(spark: SparkSession, source: str, traces: DataFrame, path: str, first: int = 0, last: int | None = None) -> int:
    """Copies traces (trace_number, output_order from 0 without gaps) with samples first..last into a new file; returns their number.

    Samples keep their bytes, the file its headers. A trace may be copied more than once. The source is
    never overwritten, and without any trace nothing is written (ValueError).
    """
    _not_source(path, source)
    register(spark)
    at = open_layout(source)
    first, last = window_of(at.count, first, last)
    n = last - first + 1
    raw = spark.read.format("segy").option("view", "raw").option("sample_start", first).option("sample_end", last).load(source).select("trace_number", "header", "raw_samples")

    def patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [patch_trace(h, n, at.interval_us, first, at.little) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, pa.binary()), b.column(2)], names=["output_order", "header", "data"])

    ordered = raw.join(traces.select("trace_number", "output_order"), "trace_number").select("output_order", "header", "raw_samples").mapInArrow(patched, "output_order bigint, header binary, data binary")
    return _finish(ordered, path, reel_header(at, n), 240 + n * at.width, n)


def export_difference(spark: SparkSession, a: str, b: str, pairs: DataFrame, path: str, first: int = 0, last: int | None = None) -> int:
    """A - B of pairs (a_trace, b_trace, output_order) as IEEE float32 on A's headers, over a window of the shorter trace; both need the same interval."""
    _not_source(path, a, b)
    register(spark)
    la, lb = open_layout(a), open_layout(b)
    if la.interval_us != lb.interval_us:
        raise ValueError(f"sample intervals differ: {la.interval_us} and {lb.interval_us}")
    first, last = window_of(min(la.count, lb.count), first, last)
    n = last - first + 1
    read = lambda p, view: spark.read.format("segy").option("view", view).option("sample_start", first).option("sample_end", last).load(p)
    heads = read(a, "raw").select(F.col("trace_number").alias("a_trace"), "header")
    sa, sb = (read(p, "samples").select(F.col("trace_number").alias(f"{k}_trace"), F.col("samples").alias(k)) for k, p in (("a", a), ("b", b)))
    met = pairs.join(heads, "a_trace").join(sa, "a_trace").join(sb, "b_trace").select("output_order", "header", F.zip_with("a", "b", lambda x, y: x - y).alias("d"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [patch_trace(h, n, la.interval_us, first, la.little) for h in batch.column(1).to_pylist()]
            data = [encode_samples(np.asarray(d, float), 5, la.little) for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(head, pa.binary()), pa.array(data, pa.binary())], names=["output_order", "header", "data"])

    return _finish(met.mapInArrow(encode, "output_order bigint, header binary, data binary"), path, reel_header(la, n, 5), 240 + 4 * n, n)


def _finish(ordered: DataFrame, path: str, header: bytes, trace_bytes: int, samples: int) -> int:
    temp = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(temp, "wb") as f:
            f.write(header)
        n = _write_runs(ordered, temp, len(header), trace_bytes)
        if n == 0:
            raise ValueError("no traces to export")
        _publish(temp, path, header, n, trace_bytes, samples)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return n


def write_traces(df: DataFrame, path: str, interval_us: int, samples: int, code: int = 5, little: bool = False, text: bytes = b"", extended: tuple[bytes, ...] = (), binary: dict[str, int] | None = None) -> int:
    """Writes rows (output_order from 0 without gaps, samples array<double>, and any columns named like header words) as a SEG-Y file; returns their number.

    Words are written as they are, unscaled; what isn't there, or null, is 0. Sample count and interval
    are those of the file unless columns name others. Traces are cut or filled with zeros to its length.
    """
    at = {w.name: w for w in TRACE_WORDS}
    named = [c for c in df.columns if c in at]
    head = bytearray(text.ljust(3200, b"\0")[:3200] + bytes(400))
    words = {"sample_interval_us": interval_us, "original_interval_us": interval_us, "sample_count": samples, "original_count": samples, "format_code": code, "fixed_length": 1, "extended_headers": len(extended), **(binary or {})}
    for w in BINARY_WORDS:
        _put(head, w.byte, w.width, words.get(w.name, 0), little)
    for block in extended:
        head += block.ljust(3200, b"\0")[:3200]
    width = SAMPLE_BYTES[code]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = "<" if little else ">"
        for batch in batches:
            n = batch.num_rows
            heads = np.zeros((n, 240), np.uint8)
            plain = {"sample_count": np.full(n, samples), "sample_interval_us": np.full(n, interval_us)}
            for k, c in enumerate(named):
                plain[c] = np.array([v or 0 for v in batch.column(k + 2).to_pylist()], np.int64)
            for c, v in plain.items():
                w = at[c]
                heads[:, w.byte - 1 : w.byte - 1 + w.width] = np.ascontiguousarray(v.astype(order + w.kind)).view(np.uint8).reshape(n, w.width)
            data = []
            for s in batch.column(1).to_pylist():
                v = np.zeros(samples)
                s = np.array(s or [], float)[:samples]
                v[: len(s)] = s
                data.append(encode_samples(v, code, little))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in heads], pa.binary()), pa.array(data, pa.binary())], names=["output_order", "header", "data"])

    rows = df.select(F.col("output_order").cast("bigint").alias("output_order"), F.col("samples").cast("array<double>").alias("samples"), *(F.col(c).cast("bigint").alias(c) for c in named))
    return _finish_as_told(rows.mapInArrow(encode, "output_order bigint, header binary, data binary"), path, bytes(head), 240 + samples * width)


def _finish_as_told(ordered: DataFrame, path: str, header: bytes, trace_bytes: int) -> int:
    """Writes a file whose trace headers may disagree with its reel header."""
    temp = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(temp, "wb") as f:
            f.write(header)
        n = _write_runs(ordered, temp, len(header), trace_bytes)
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    return n


def number_traces(df: DataFrame, *order: str) -> DataFrame:
    """(trace_number, output_order): a selection's traces in the order of its columns, from 0; any number of them."""
    return numbered(df.select("trace_number", *(c for c in order if c != "trace_number")), list(order), "output_order").select("trace_number", "output_order")


#: Columns of a gather list; numbers of traces and samples are given from 1.
GATHER_COLUMNS = "position trace_number source_id receiver_id cdp inline crossline source_x source_y receiver_x receiver_y midpoint_x midpoint_y trace_offset azimuth delay_ms sample_interval_us sample_count header_valid header_error".split()


def gather_list(gather: DataFrame) -> DataFrame:
    """The rows of a gather list, numbered from 1, values that aren't there as nulls."""
    there = {"source_x": "has_source", "source_y": "has_source", "receiver_x": "has_receiver", "receiver_y": "has_receiver", "midpoint_x": "has_midpoint", "midpoint_y": "has_midpoint", "trace_offset": "has_offset", "azimuth": "has_azimuth", "cdp": "has_cdp"}
    cols = [F.when(F.col(there[c]), F.col(c)).alias(c) if c in there else (F.col(c) + 1).alias(c) if c in ("position", "trace_number") else F.col(c) for c in GATHER_COLUMNS]
    return gather.select(*cols)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes a report as CSV with a header, or as JSON lines."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"kind is csv or json, not {kind}")
