"""SEG-Y files as a Spark data source.

    register(spark)
    spark.read.format("segy").option("view", "records").load("line.sgy")

Python data sources get no column pruning, so what is read is chosen by `view`: header views never
touch samples. The trace range and the sample window are options that bound the bytes read. A
partition is a run of traces and opens the file itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lithoframe.runtime import ship
from lithoframe.sources.words import BINARY_WORDS, SAMPLE_BYTES, SCALED_BY, TRACE_WORDS, decode_samples, decode_text, read_word, text_encoding

#: Bytes of trace data per partition, unless the option partition_traces says otherwise.
PARTITION_BYTES = 64 << 20
_BATCH = 4096
#: From so many extended text headers on, the count is taken for an accident: the data start behind the reel header, and text views refuse.
MAX_EXTENDED = 10_000
#: Sample formats that have a size but can't be decoded.
UNDECODED = (4,)

SCHEMAS = {
    "files": "path string, size bigint, little_endian boolean, sample_interval_us int, sample_count int, format_code int, sample_bytes int, extended_headers int, data_start bigint, trace_bytes bigint, trace_count bigint, trailing_bytes bigint, error string",
    "text_headers": "path string, header_index int, extended boolean, encoding string, line_no int, text string",
    "text_bytes": "path string, header_index int, extended boolean, encoding string, raw binary, text string",
    "binary_header": "path string, name string, byte_start int, width int, value bigint, unit string",
    "reel": "path string, little_endian boolean, " + ", ".join(f"{w.name} {'int' if w.kind != 'u4' else 'bigint'}" for w in BINARY_WORDS) + ", revision_major int, revision_minor int, raw binary, warnings array<string>",
    "trace_headers": "path string, trace_number bigint, name string, byte_start int, width int, value bigint, unit string",
    "traces": "path string, trace_number bigint, " + ", ".join(f"{w.name} {'double' if w.name in SCALED_BY else 'int'}" for w in TRACE_WORDS) + ", raw binary, warnings array<string>",
    "records": "path string, trace_number bigint, source_id int, receiver_id int, cdp int, trace_in_field int, inline int, crossline int, coordinate_scalar int, coordinate_units int, source_x double, source_y double, receiver_x double, receiver_y double, "
    "cdp_x double, cdp_y double, header_offset double, delay_ms int, sample_count int, sample_interval_us int, header_sample_count int, header_sample_interval_us int, header_valid boolean, header_error string",
    "samples": "path string, trace_number bigint, samples array<double>",
    "raw": "path string, trace_number bigint, header binary, raw_samples binary",
}


@dataclass
class Layout:
    """What the reel header says of a file."""

    path: str
    size: int
    little: bool
    interval_us: int
    count: int
    code: int
    extended: int

    @property
    def width(self) -> int:
        return SAMPLE_BYTES[self.code]

    @property
    def data_start(self) -> int:
        return 3600 + 3200 * self.extended * (self.extended < MAX_EXTENDED)

    @property
    def trace_bytes(self) -> int:
        return 240 + self.count * self.width

    @property
    def traces(self) -> int:
        return max(0, (self.size - self.data_start) // self.trace_bytes)


def open_layout(path: str) -> Layout:
    """Reads the reel header; big endian is tried first. Raises ValueError for a file that isn't SEG-Y or has no whole trace."""
    size = os.path.getsize(path)
    if size < 3600:
        raise ValueError(f"{path}: {size} bytes are too few for a SEG-Y file")
    with open(path, "rb") as f:
        head = f.read(3600)
    for little in (False, True):
        word = lambda byte, unsigned=True: read_word(head, byte - 1, 2, little, unsigned)  # noqa: B023, E731
        dt, ns, code = word(3217), word(3221), word(3225)
        if 1 <= dt <= 1_000_000 and 1 <= ns <= 65_535 and code in SAMPLE_BYTES:
            at = Layout(path, size, little, dt, ns, code, max(0, word(3505, False)))
            if at.data_start > size:
                raise ValueError(f"{path}: its traces would start at byte {at.data_start} of {size}")
            if at.traces < 1:
                raise ValueError(f"{path}: no whole trace")
            return at
    raise ValueError(f"{path}: no plausible binary header in either byte order")


def segy_paths(path: str) -> list[str]:
    """A file, or the SEG-Y files of a folder in natural order, each once whatever the case of its name."""
    import re

    if not os.path.isdir(path):
        return [path]
    names = [n for n in os.listdir(path) if n.lower().endswith((".sgy", ".segy"))]
    key = lambda n: [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", n.lower()) if p]
    once = {n.lower(): n for n in sorted(names, reverse=True)}
    return [os.path.join(path, n) for n in sorted(once.values(), key=key)]


@dataclass
class Run(InputPartition):
    layout: Layout | None
    first: int
    count: int
    path: str = ""
    error: str = ""


def scale_factor(scalar: np.ndarray) -> np.ndarray:
    """What a scalar word multiplies with: itself, one over its magnitude if negative, 1 if 0."""
    s = scalar.astype(float)
    return np.where(s > 0, s, np.where(s < 0, -1 / np.where(s == 0, 1, s), 1.0))


def text_blocks(at: Layout) -> Iterator[bytes]:
    """The bytes of the primary and then of the extended text headers. Raises ValueError if the count exceeds the header area."""
    if at.extended > (at.data_start - 3600) // 3200:
        raise ValueError(f"{at.path}: {at.extended} extended text headers exceed the header area")
    with open(at.path, "rb") as f:
        for k in (0, *range(3600, at.data_start, 3200)):
            f.seek(k)
            yield f.read(3200)


def reel_words(at: Layout) -> tuple[bytes, dict[str, int]]:
    """The 400 bytes of the binary header and its words."""
    with open(at.path, "rb") as f:
        f.seek(3200)
        raw = f.read(400)
    return raw, {w.name: read_word(raw, w.byte - 3201, w.width, at.little, w.unsigned) for w in BINARY_WORDS}


def reel_warnings(at: Layout, words: dict[str, int]) -> list[str]:
    """What of a binary header a reader of fixed-length traces should know."""
    trailing = (at.size - at.data_start) % at.trace_bytes
    found = {
        "no fixed trace length is declared; traces are read with one length": words["fixed_length"] == 0 and words["revision"] > 0,
        "the number of extended text headers is open; end marks aren't searched for": words["extended_headers"] < 0,
        f"up to {words['max_additional_headers']} additional trace headers are declared; 240 bytes are read": words["max_additional_headers"] > 0,
        f"sample format {words['format_code']} can't be decoded": words["format_code"] in UNDECODED,
        f"{trailing} bytes at the end belong to no whole trace": trailing > 0,
    }
    return [text for text, holds in found.items() if holds]


class SegyDataSource(DataSource):
    """Options: path, view (one of SCHEMAS), trace_start, trace_end (half open), sample_start, sample_end (inclusive), partition_traces, mapping (e.g. "receiver_id=13,inline=189"), encoding (of text headers, instead of the likelier one)."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        view = self.options.get("view", "records")
        if view not in SCHEMAS:
            raise ValueError(f"view is one of {', '.join(SCHEMAS)}, not {view}")
        return SCHEMAS[view]

    def reader(self, schema) -> SegyReader:
        return SegyReader(dict(self.options))


class SegyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.view, self.path = options.get("view", "records"), options["path"]
        at = lambda key: int(options[key]) if key in options else None
        self.trace_start, self.trace_end, self.sample_start, self.sample_end, self.run = (at(k) for k in ("trace_start", "trace_end", "sample_start", "sample_end", "partition_traces"))
        self.encoding = options.get("encoding")
        self.mapping = {k: int(v) for k, _, v in (m.partition("=") for m in options.get("mapping", "").split(",") if m)}

    def partitions(self) -> list[Run]:
        out = []
        for path in segy_paths(self.path):
            try:
                layout = open_layout(path)
            except (OSError, ValueError) as e:
                if self.view != "files":
                    raise
                out.append(Run(None, 0, 0, path, str(e)))
                continue
            if self.view in ("files", "text_headers", "text_bytes", "binary_header", "reel"):
                out.append(Run(layout, 0, 0, path))
                continue
            first, end = max(0, self.trace_start or 0), min(layout.traces, layout.traces if self.trace_end is None else self.trace_end)
            step = self.run or max(1, PARTITION_BYTES // layout.trace_bytes)
            out += [Run(layout, k, min(step, end - k), path) for k in range(first, end, step)]
        return out or [Run(None, 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        p, at = partition, partition.layout
        if self.view == "files":
            if p.path:
                row = (p.path, at.size, at.little, at.interval_us, at.count, at.code, at.width, at.extended, at.data_start, at.trace_bytes, at.traces, (at.size - at.data_start) % at.trace_bytes if at.size >= at.data_start else 0, None) if at else (p.path, *[None] * 11, p.error)
                yield tuple(row)
        elif at is None:
            return
        elif self.view in ("text_headers", "text_bytes"):
            for i, raw in enumerate(text_blocks(at)):
                encoding = self.encoding or text_encoding(raw)
                said = decode_text(raw, encoding)
                if self.view == "text_bytes":
                    yield (at.path, i, i > 0, encoding, raw, "\r\n".join(said))
                    continue
                for n, line in enumerate(said, 1):
                    yield (at.path, i, i > 0, encoding, n, line)
        elif self.view == "binary_header":
            for w, value in zip(BINARY_WORDS, reel_words(at)[1].values()):
                yield (at.path, w.name, w.byte, w.width, value, w.unit)
        elif self.view == "reel":
            raw, words = reel_words(at)
            yield (at.path, at.little, *words.values(), words["revision"] >> 8, words["revision"] & 255, raw, reel_warnings(at, words))
        else:
            for first in range(p.first, p.first + p.count, _BATCH):
                yield from getattr(self, f"_{self.view}")(at, first, min(_BATCH, p.first + p.count - first))

    def _blocks(self, at: Layout, first: int, n: int) -> np.ndarray:
        """Whole traces as rows of bytes."""
        with open(at.path, "rb") as f:
            f.seek(at.data_start + first * at.trace_bytes)
            return np.frombuffer(f.read(n * at.trace_bytes), np.uint8).reshape(n, at.trace_bytes)

    def _heads(self, at: Layout, first: int, n: int) -> np.ndarray:
        """Trace headers as rows of bytes; the file is mapped, so of large traces only the pages with headers are read."""
        if at.trace_bytes <= 2048:
            return self._blocks(at, first, n)[:, :240]
        mapped = np.memmap(at.path, np.uint8, "r", at.data_start + first * at.trace_bytes, ((n - 1) * at.trace_bytes + 240,))
        return np.array(np.lib.stride_tricks.as_strided(mapped, (n, 240), (at.trace_bytes, 1)))

    @staticmethod
    def _column(heads: np.ndarray, byte: int, kind: str, little: bool) -> np.ndarray:
        return np.ascontiguousarray(heads[:, byte - 1 : byte - 1 + int(kind[1])]).view(("<" if little else ">") + kind)[:, 0].astype(np.int64)

    def _trace_headers(self, at: Layout, first: int, n: int) -> Iterator[pa.RecordBatch]:
        heads, k = self._heads(at, first, n), len(TRACE_WORDS)
        values = np.stack([self._column(heads, w.byte, w.kind, at.little) for w in TRACE_WORDS], 1)
        per_word = lambda of, kind=None: pa.array([of(w) for w in TRACE_WORDS] * n, kind)
        cols = {"path": pa.array([at.path] * (n * k)), "trace_number": pa.array(np.repeat(np.arange(first, first + n), k)), "name": per_word(lambda w: w.name), "byte_start": per_word(lambda w: w.byte, pa.int32()), "width": per_word(lambda w: w.width, pa.int32()), "value": pa.array(values.ravel()), "unit": per_word(lambda w: w.unit)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def _traces(self, at: Layout, first: int, n: int) -> Iterator[pa.RecordBatch]:
        """One row per trace header, words under their scalars, and what disagrees with the reel header."""
        heads = self._heads(at, first, n)
        words = {w.name: self._column(heads, w.byte, w.kind, at.little) for w in TRACE_WORDS}
        ns, dt, units = (words[c] for c in ("sample_count", "sample_interval_us", "coordinate_units"))
        notes: list[list[str]] = [[] for _ in range(n)]
        for odd, say in (
            ((ns != 0) & (ns != at.count), lambda i: f"{ns[i]} samples, not the reel header's {at.count}, which hold"),
            ((dt != 0) & (dt != at.interval_us), lambda i: f"interval {dt[i]} us, not the reel header's {at.interval_us} us, which hold"),
            ((units < 0) | (units > 4), lambda i: f"unknown coordinate units {units[i]}"),
        ):
            for i in np.flatnonzero(odd):
                notes[i].append(say(i))
        cols = {"path": pa.array([at.path] * n), "trace_number": pa.array(np.arange(first, first + n))}
        for w in TRACE_WORDS:
            v = words[w.name]
            cols[w.name] = pa.array(v * scale_factor(words[SCALED_BY[w.name]])) if w.name in SCALED_BY else pa.array(v.astype(np.int32))
        cols |= {"raw": pa.array([h.tobytes() for h in heads], pa.binary()), "warnings": pa.array(notes, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def _records(self, at: Layout, first: int, n: int) -> Iterator[pa.RecordBatch]:
        heads = self._heads(at, first, n)
        where = {w.name: (w.byte, w.kind) for w in TRACE_WORDS} | {"receiver_id": (13, "i4")}

        def word(name: str) -> np.ndarray:
            byte, kind = where[name]
            byte = self.mapping.get(name, byte)
            return self._column(heads, byte, kind, at.little) if byte > 0 else np.zeros(n, np.int64)

        scale = scale_factor(word("coordinate_scalar"))
        ns, dt = word("sample_count"), word("sample_interval_us")
        error = np.where(ns == 0, "sample count is zero", np.where(dt == 0, "sample interval is zero", ""))
        i32 = lambda v: pa.array(v.astype(np.int32))
        cols = {
            "path": pa.array([at.path] * n), "trace_number": pa.array(np.arange(first, first + n)), **{c: i32(word(c)) for c in ("source_id", "receiver_id", "cdp", "trace_in_field", "inline", "crossline", "coordinate_scalar", "coordinate_units")},
            **{c: pa.array(word(c) * scale) for c in ("source_x", "source_y", "receiver_x", "receiver_y", "cdp_x", "cdp_y")}, "header_offset": pa.array(word("header_offset").astype(float)), "delay_ms": i32(word("delay_ms")),
            "sample_count": i32(np.where(ns == 0, at.count, ns)), "sample_interval_us": i32(np.where(dt == 0, at.interval_us, dt)), "header_sample_count": i32(ns), "header_sample_interval_us": i32(dt),
            "header_valid": pa.array(error == ""), "header_error": pa.array([e or None for e in error.tolist()], pa.string()),
        }
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def _window(self, at: Layout) -> tuple[int, int]:
        a, b = max(0, self.sample_start or 0), at.count - 1 if self.sample_end is None else min(self.sample_end, at.count - 1)
        if a > b:
            raise ValueError(f"no sample in {self.sample_start}..{self.sample_end} of {at.count}")
        return a, b

    def _cut(self, at: Layout, first: int, n: int, a: int, b: int) -> np.ndarray:
        """The bytes of samples a..b of traces, as rows; the file is mapped, so of a narrow window only its pages are read."""
        mapped = np.memmap(at.path, np.uint8, "r", at.data_start + first * at.trace_bytes, (n * at.trace_bytes,))
        return np.array(mapped.reshape(n, at.trace_bytes)[:, 240 + a * at.width : 240 + (b + 1) * at.width])

    def _samples(self, at: Layout, first: int, n: int) -> Iterator[pa.RecordBatch]:
        a, b = self._window(at)
        values = decode_samples(self._cut(at, first, n, a, b).tobytes(), at.code, at.little)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * (b - a + 1), b - a + 1, dtype=np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array([at.path] * n), pa.array(np.arange(first, first + n)), lists], names=["path", "trace_number", "samples"])

    def _raw(self, at: Layout, first: int, n: int) -> Iterator[pa.RecordBatch]:
        a, b = self._window(at)
        heads, data = self._heads(at, first, n), self._cut(at, first, n, a, b)
        yield pa.RecordBatch.from_arrays([pa.array([at.path] * n), pa.array(np.arange(first, first + n)), pa.array([h.tobytes() for h in heads], pa.binary()), pa.array([d.tobytes() for d in data], pa.binary())], names=["path", "trace_number", "header", "raw_samples"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and the package to its workers."""
    ship(spark)
    spark.dataSource.register(SegyDataSource)
