"""Cropped exports of whole sections, of boxes of a volume, and of many lines at once with a manifest."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import grid
from lithoframe.operators.identity import file_sha256
from lithoframe.sources.segy import Layout, open_layout, register
from lithoframe.sources.sink import export_difference, export_section, number_traces

MANIFEST = "crop_manifest.json"
#: Names that some file systems keep for devices.
DEVICES = re.compile(r"(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])", re.IGNORECASE)


def safe_name(name: str) -> bool:
    """Whether a name is that of a plain file in its folder, on any common system."""
    stem = name.split(".")[0]
    return bool(name) and name == name.strip() and not name.endswith(".") and not re.search(r"[<>:\"/\\|?*\x00-\x1f]", name) and not DEVICES.fullmatch(stem)


@dataclass
class Line:
    """One line of a batch: which traces (trace_number, each once) and samples of which file go where."""

    name: str
    source: str
    output: str
    traces: DataFrame
    first: int = 0
    last: int | None = None
    #: The file as it was when the line was planned.
    layout: Layout | None = None

    def planned(self) -> Line:
        self.layout = self.layout or open_layout(self.source)
        return self


@dataclass
class Outcome:
    name: str
    source: str
    output: str
    status: str = "not_started"
    error: str | None = None
    traces: int = 0
    first: int = 0
    last: int | None = None
    samples: int = 0
    bytes: int = 0
    format_code: int | None = None


@dataclass
class Result:
    status: str
    lines: list[Outcome]
    navigation: dict = field(default_factory=dict)
    completed: int = 0
    failed: int = 0
    began: str = ""
    ended: str = ""
    version: int = 1


def check_plan(lines: list[Line], navigation: str | None = None) -> None:
    """Raises ValueError for a batch that can't be right: empty, unsafe or repeated names, a source named twice, traces that aren't there or are named twice."""
    if not lines:
        raise ValueError("the batch is empty")
    reserved = {MANIFEST} | ({os.path.basename(navigation).lower()} if navigation else set())
    names, sources = set(), set()
    for line in lines:
        if not safe_name(line.output):
            raise ValueError(f"{line.output!r} isn't a safe file name")
        key, source = line.output.lower(), os.path.realpath(line.source).lower()
        if key in reserved:
            raise ValueError(f"{line.output!r} is reserved")
        if key in names:
            raise ValueError(f"output {line.output!r} is duplicated")
        if source in sources:
            raise ValueError(f"source {line.source!r} is duplicated")
        names.add(key)
        sources.add(source)
        if line.layout is not None:
            t = line.traces.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_number").alias("d"), F.min("trace_number").alias("a"), F.max("trace_number").alias("b")).first()
            if not t.n or t.n != t.d or t.a < 0 or t.b >= line.layout.traces:
                raise ValueError(f"line {line.name!r}: {t.n} traces, {t.d} of them different, from {t.a} to {t.b} of {line.layout.traces}")
            last = line.layout.count - 1 if line.last is None else line.last
            if not 0 <= line.first <= last < line.layout.count:
                raise ValueError(f"line {line.name!r}: samples {line.first} to {last} of {line.layout.count}")


def export_batch(spark: SparkSession, lines: list[Line], folder: str, navigation: str | None = None, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[str, int, float], None] | None = None) -> Result:
    """Exports each line into a folder of its own, copies the navigation file and writes a manifest of what became of them.

    A line that fails doesn't stop the others. Status: completed; partial, if a line or the navigation
    failed but a line is there; failed; cancelled, from which on no line is begun and finished ones stay.
    A source that changed since it was planned fails its line. progress gets (status, line, percent).
    """
    check_plan(lines, navigation)
    os.makedirs(folder)
    result = Result("running", [Outcome(x.name, x.source, os.path.join(folder, x.output), first=x.first, last=x.last) for x in lines], began=datetime.now(UTC).isoformat())
    tell = progress or (lambda *_: None)
    result.navigation = {"status": "not_present"}
    if navigation:
        try:
            copy = shutil.copy2(navigation, folder)
            result.navigation = {"status": "completed", "output": copy, "sha256": file_sha256(copy)}
        except OSError as e:
            result.navigation = {"status": "failed", "error": str(e)}
    stopped = False
    for k, (line, out) in enumerate(zip(lines, result.lines)):
        if stopped := stopped or cancelled():
            out.error = "cancelled before this line began"
            continue
        tell("exporting", k, 100.0 * k / len(lines))
        try:
            now = open_layout(line.source)
            if line.layout is not None and now != line.layout:
                raise ValueError(f"{line.source} changed after it was planned")
            out.traces = export_section(spark, line.source, number_traces(line.traces, "trace_number"), out.output, line.first, line.last)
            made = open_layout(out.output)
            out.samples, out.bytes, out.format_code = made.count, made.size, made.code
            if cancelled():  # it came meanwhile: the line counts as cancelled and leaves nothing
                os.unlink(out.output)
                out.status, out.error, stopped = "cancelled", "cancelled", True
                continue
            out.status = "completed"
        except Exception as e:  # whatever befalls one line, the others go on
            out.status, out.error = "failed", str(e)
        tell(out.status, k, 100.0 * (k + 1) / len(lines))
    result.completed, result.failed = (sum(o.status == s for o in result.lines) for s in ("completed", "failed"))
    whole = not result.failed and result.navigation["status"] != "failed"
    result.status = "cancelled" if stopped else "completed" if whole else "partial" if result.completed else "failed"
    result.ended = datetime.now(UTC).isoformat()
    part = os.path.join(folder, MANIFEST + ".part")
    with open(part, "w", encoding="utf-8") as f:
        json.dump(asdict(result), f, ensure_ascii=False, indent=1)
    os.replace(part, os.path.join(folder, MANIFEST))
    tell(result.status, len(lines), 100.0)
    return result


def _index(spark: SparkSession, path: str, inline_byte: int, crossline_byte: int) -> DataFrame:
    register(spark)
    records = spark.read.format("segy").option("view", "records").option("mapping", f"inline={inline_byte},crossline={crossline_byte}").load(path)
    return grid.grid_index(records)


def _numbered_pairs(pairs: DataFrame) -> DataFrame:
    """(a_trace, b_trace, output_order) in A's order."""
    order = number_traces(pairs.select(F.col("a_trace").alias("trace_number")), "trace_number")
    return pairs.join(order.withColumnRenamed("trace_number", "a_trace"), "a_trace").select("a_trace", "b_trace", "output_order")


def export_line(spark: SparkSession, source: str, axis: str, value: float, path: str, minus: str | None = None, first: int = 0, last: int | None = None, words: tuple[int, int] = (189, 193)) -> int:
    """The inline (axis "il") or crossline ("xl") nearest to a value, ordered across, as a file; with `minus` the difference to that volume, over the places both have."""
    across = grid.line_traces(_index(spark, source, *words), axis, value)
    if minus is None:
        return export_section(spark, source, across.select("trace_number", F.col("position").cast("bigint").alias("output_order")), path, first, last)
    other = grid.line_traces(_index(spark, minus, *words), axis, value)
    pairs = across.select(F.col("trace_number").alias("a_trace"), "across").join(other.select(F.col("trace_number").alias("b_trace"), "across"), "across")
    return export_difference(spark, source, minus, _numbered_pairs(pairs), path, first, last)


def export_box(spark: SparkSession, source: str, il: tuple[int, int], xl: tuple[int, int], path: str, minus: str | None = None, first: int = 0, last: int | None = None, words: tuple[int, int] = (189, 193)) -> int:
    """The traces of a box of lines, in the order of the file, as a file; with `minus` the difference to that volume's first trace of each place."""
    inside = grid.in_box(_index(spark, source, *words), il, xl)
    if minus is None:
        return export_section(spark, source, number_traces(inside, "trace_number"), path, first, last)
    pairs = grid.cell_pairs(inside, grid.in_box(_index(spark, minus, *words), il, xl)).select("a_trace", "b_trace")
    return export_difference(spark, source, minus, _numbered_pairs(pairs), path, first, last)
