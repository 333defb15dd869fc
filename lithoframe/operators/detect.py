"""What a SEG-Y file is: grid, crooked line or plain line, and where its headers keep inline and crossline.

The decision rests on a few thousand trace headers, so it is made with arrays on the driver: at most
MAX_HEADERS rows of 240 bytes, whatever the file's size.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import lines
from lithoframe.sources.segy import SegyReader, open_layout, register

MAX_HEADERS = 8192

# Limits and weights of the detection.
STANDARD = (189, 193)
COORDINATE_BYTES = (181, 185)
KEPT_FIELDS, REPORTED = 56, 8
FIELD_WEIGHTS = {"variation": 0.45, "nonzero": 0.20, "regular": 0.20, "magnitude": 0.15}
PAIR_WEIGHTS = {"one_axis": 0.34, "filled": 0.24, "distinct": 0.16, "step": 0.14, "fields": 0.12}
GRID_SCORE, GRID_CONFIDENCE = 75.0, 0.58
MAX_STEP = 100_000_000


@dataclass
class Pair:
    inline_byte: int
    crossline_byte: int
    score: float
    confidence: float = 0.0
    labels_guessed: bool = False
    detail: dict = field(default_factory=dict)


@dataclass
class Detection:
    pairs: list[Pair]
    score: float
    confidence: float
    ambiguous: bool
    headers: int


def sample_windows(traces: int, wanted: int = 3072) -> list[tuple[int, int]]:
    """Runs [start, end) of consecutive traces spread over the file, its ends included."""
    wanted = min(wanted if wanted > 0 else 3072, MAX_HEADERS)
    if traces <= wanted:
        return [(0, traces)] if traces else []
    n = 6 if wanted >= 6 * 64 else 4
    size = min(max(wanted // n, 64), traces)
    centres = np.floor(np.arange(n) * (traces - 1) / (n - 1) + 0.5).astype(int)
    starts = dict.fromkeys(int(min(max(c - size // 2, 0), traces - size)) for c in centres)
    return [(s, s + size) for s in starts]


def _commonest_share(steps: np.ndarray) -> float:
    steps = steps[(steps > 0) & (steps <= MAX_STEP)]
    return int(np.unique(steps, return_counts=True)[1].max()) if len(steps) else 0


def field_scores(values: np.ndarray, follows: np.ndarray) -> dict[str, np.ndarray]:
    """Features of candidate words (headers x fields); follows marks the headers that come right after the one before."""
    n = len(values)
    unique = np.array([len(np.unique(c)) for c in values.T])
    ratio = unique / n
    variation = np.select([unique < 2, ratio <= 0.35, ratio <= 0.70, ratio <= 0.92], [0.0, 1.0, 1 - (ratio - 0.35) / 0.70, 0.5 * (0.92 - ratio) / 0.22], 0.0)
    nonzero = np.minimum(1.0, 4 * (values != 0).mean(0))
    nonzero = np.where((values != 0).mean(0) >= 0.25, 1.0, nonzero)
    biggest = np.abs(values).max(0)
    magnitude = np.select([biggest <= 10**7, biggest <= 10**8, biggest <= 10**9], [1.0, 0.75, 0.35], 0.10)
    step = np.abs(np.diff(values, axis=0))[follows[1:]]
    changes = (step > 0).sum(0)
    constant = np.array([_commonest_share(s) for s in step.T]) / np.maximum(changes, 1)
    same = (step == 0).mean(0) if len(step) else np.zeros(values.shape[1])
    w = FIELD_WEIGHTS
    score = w["variation"] * variation + w["nonzero"] * nonzero + w["regular"] * np.maximum(constant, same) + w["magnitude"] * magnitude
    return {"score": score, "unique": unique, "changes": changes, "constant": constant}


def _runs_of(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of a sorted array starts and ends."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    return (np.r_[0, cuts], np.r_[cuts, len(group)]) if len(group) else (np.zeros(0, int), np.zeros(0, int))


def pair_metrics(a: np.ndarray, b: np.ndarray, group: np.ndarray, follows: np.ndarray, fallback: tuple[float, float]) -> dict[str, float]:
    """How much two words behave like the axes of a grid. Headers where both are 0 don't count."""
    on = (a != 0) | (b != 0)
    pa, pb, g = a[on], b[on], group[on]
    both = pa << 32 ^ pb & 0xFFFFFFFF  # words of 32 bits, so the pair is one of 64
    distinct = len(np.unique(both))
    fills = []
    for first, last in zip(*_runs_of(g)):
        cells = len(np.unique(both[first:last]))
        if cells >= 2:
            fills.append(min(1.0, cells / (len(np.unique(pa[first:last])) * len(np.unique(pb[first:last])))))
    at = np.flatnonzero(follows & on)
    da, db = np.abs(a[at] - a[at - 1]), np.abs(b[at] - b[at - 1])
    alone = (da > 0) != (db > 0)
    moved = (da > 0) | (db > 0)
    steps = []
    for d, other, else_ in ((da, db, fallback[0]), (db, da, fallback[1])):
        s = d[(d > 0) & (other == 0) & (d <= MAX_STEP)]
        steps.append(_commonest_share(s) / len(s) if len(s) else else_)
    return {
        "pairs": distinct, "duplicates": (len(both) - distinct) / len(both) if len(both) else 0.0, "one_axis": alone.sum() / moved.sum() if moved.any() else 0.0,
        "filled": float(np.mean(fills)) if fills else 0.0, "step": sum(steps) / 2,
    }


def detect_bytes(headers: np.ndarray, numbers: np.ndarray, group: np.ndarray, little: bool = False) -> Detection:
    """The likeliest inline and crossline words of headers (n x 240 bytes) with their trace numbers and sampling runs.

    Raises ValueError below 32 headers or without a plausible pair. The word that changes less often
    is called inline, unless the pair is the standard one.
    """
    n = len(headers)
    if n < 32:
        raise ValueError("too few traces to detect a geometry")
    kind = "<i4" if little else ">i4"
    values = np.stack([np.ascontiguousarray(headers[:, k : k + 4]).view(kind)[:, 0] for k in range(237)], 1).astype(np.int64)
    follows = np.r_[False, (np.diff(numbers) == 1) & (np.diff(group) == 0)]
    f = field_scores(values, follows)
    byte = np.arange(1, 238)
    f["score"] = np.minimum(1.0, f["score"] + np.where(np.isin(byte, STANDARD), 0.08, 0.0))
    kept = list(np.argsort(-f["score"], kind="stable")[:KEPT_FIELDS])
    kept += [b - 1 for b in STANDARD if b - 1 not in kept]
    out = []
    for i, j in combinations(kept, 2):
        if abs(i - j) < 4:  # views of the same word, shifted
            continue
        m = pair_metrics(values[:, i], values[:, j], group, follows, (f["constant"][i], f["constant"][j]))
        if m["pairs"] < 4:
            continue
        w = PAIR_WEIGHTS
        score = 88 * (w["one_axis"] * m["one_axis"] + w["filled"] * m["filled"] + w["distinct"] * (1 - min(1.0, m["duplicates"] / 0.20)) + w["step"] * m["step"] + w["fields"] * (f["score"][i] + f["score"][j]) / 2)
        standard = {i + 1, j + 1} == set(STANDARD)
        score += 8 * standard + sum((3 if (k + 1) % 4 == 1 else -2) - 6 * (k + 1 in COORDINATE_BYTES) for k in (i, j))
        score = min(100.0, score) * (0.55 if m["one_axis"] < 0.45 or m["filled"] < 0.20 else 1.0)
        il, xl = STANDARD if standard else ((j + 1, i + 1) if f["changes"][i] > f["changes"][j] else (i + 1, j + 1))
        out.append(Pair(il, xl, float(score), labels_guessed=not standard, detail=m))
    if not out:
        raise ValueError("no plausible pair of grid words")
    out = sorted(out, key=lambda p: -p.score)[:REPORTED]
    second = out[1].score if len(out) > 1 else 0.0
    margin = out[0].score - second
    hold = lambda v: min(1.0, max(0.0, v))
    confidence = hold(0.62 * out[0].score / 100 + 0.38 * hold(margin / 15)) + (0.10 if not out[0].labels_guessed and out[0].score >= 75 else 0.0)
    for k, p in enumerate(out):
        p.confidence = hold(0.65 * p.score / 100 + 0.35 * hold((margin if k == 0 else p.score - second) / 15))
    return Detection(out, out[0].score, min(1.0, confidence), out[0].score < 65 or margin < 3 or min(1.0, confidence) < GRID_CONFIDENCE, n)


def sampled_headers(path: str, wanted: int = 3072) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(headers, trace numbers, runs, little endian) of a file's sampling windows."""
    at = open_layout(path)
    reader = SegyReader({"path": path, "view": "raw"})
    windows = sample_windows(at.traces, wanted)
    heads = [reader._heads(at, a, b - a) for a, b in windows]
    numbers = np.concatenate([np.arange(a, b) for a, b in windows]) if windows else np.zeros(0, int)
    return np.concatenate(heads) if heads else np.zeros((0, 240), np.uint8), numbers, np.repeat(np.arange(len(windows)), [b - a for a, b in windows]), at.little


def route(spark: SparkSession, path: str, wanted: int = 3072) -> tuple[str, Detection | None]:
    """('regular_3d' | 'crooked_line' | 'line_2d', detection): the kind of a file."""
    try:
        found = detect_bytes(*sampled_headers(path, wanted))
    except ValueError:
        return "line_2d", None
    if found.score >= GRID_SCORE and max(found.confidence, found.pairs[0].confidence) >= GRID_CONFIDENCE:
        return "regular_3d", found
    register(spark)
    rec = spark.read.format("segy").option("view", "records").load(path)
    ends = (("cdp_xy", "cdp"), ("source_xy", "source"), ("group_xy", "receiver"))
    # on a crooked line a place is there if either word is not 0
    at = lambda p: (F.col(f"{p}_x") != 0) | (F.col(f"{p}_y") != 0)
    parts = [rec.select(F.lit(s).alias("spec"), F.lit(path).alias("line"), F.col("trace_number").alias("trace"), F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"), at(p).alias("ok")) for s, p in ends]
    scores = lines.coordinate_score(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    chosen = lines.pick_coordinates(scores, [s for s, _ in ends]).collect()
    if not chosen:
        return "line_2d", found
    spec = chosen[0]["spec"]
    line = parts[[s for s, _ in ends].index(spec)].where("ok").select("line", "trace", "x", "y")
    shape = lines.crookedness(line, scores.where(F.col("spec") == spec).drop("spec", "score")).collect()
    return ("crooked_line" if shape and shape[0]["crooked"] else "line_2d"), found


@dataclass
class RegularGrid:
    """A grid whose numbers follow from the trace number: `rows` lines of `length` traces, the fast axis running along each."""

    rows: int
    length: int
    fast_is_crossline: bool
    fast: tuple[int, int]
    slow: tuple[int, int]
    serpentine: bool
    headers_read: int = 0

    def at(self, trace: int) -> tuple[int, int]:
        """(inline, crossline) of a trace."""
        row, col = divmod(trace, self.length)
        col = self.length - 1 - col if self.serpentine and row % 2 else col
        f, s = self.fast[0] + col * self.fast[1], self.slow[0] + row * self.slow[1]
        return (s, f) if self.fast_is_crossline else (f, s)


def regular_grid(path: str, inline_byte: int = STANDARD[0], crossline_byte: int = STANDARD[1], checkpoints: int = 96) -> RegularGrid | None:
    """The grid of a file without gaps, from about a hundred headers whatever its size; None if it isn't one, and the grid has to be indexed by all headers.

    The first line's end is found by doubling and bisection; what follows from it is checked at traces
    spread over the file and at the ends of lines.
    """
    at, seen = open_layout(path), {}
    reader = SegyReader({"path": path, "view": "raw"})

    def read(trace: int) -> tuple[int, int]:
        if trace not in seen:
            h = reader._heads(at, trace, 1)
            seen[trace] = tuple(int(reader._column(h, b, "i4", at.little)[0]) for b in (inline_byte, crossline_byte))
        return seen[trace]

    n = at.traces
    if n < 4 or read(0) == (0, 0):
        return None
    steps = [b - a for a, b in zip(read(0), read(1))]
    if (steps[0] == 0) == (steps[1] == 0):
        return None
    fast = 1 if steps[1] else 0
    slow = 1 - fast
    left = lambda t: read(t)[slow] != read(0)[slow]
    end = 2
    while end < n and not left(end):
        end *= 2
    length = bisect_left(range(n), True, lo=end // 2, hi=min(end, n), key=left)
    if length >= n or length < 2 or n % length or n // length < 2:
        return None
    rows, second = n // length, read(length)
    grid = RegularGrid(rows, length, fast == 1, (read(0)[fast], steps[fast]), (read(0)[slow], second[slow] - read(0)[slow]), second[fast] == read(length - 1)[fast] != read(0)[fast])
    spread = np.unique(np.linspace(0, n - 1, checkpoints).round().astype(int)).tolist()
    borders = [r * length + d for r in np.unique(np.linspace(1, rows - 1, 8).round().astype(int)).tolist() for d in (-1, 0)]
    if grid.slow[1] == 0 or any(read(t) != grid.at(t) for t in (*spread, *borders)):
        return None
    grid.headers_read = len(seen)
    return grid


def regular_index(spark: SparkSession, grid: RegularGrid) -> DataFrame:
    """(trace_number, il, xl, row, col) of a regular grid, as grid.grid_index gives them, without reading any header."""
    t = spark.range(grid.rows * grid.length).select(F.col("id").alias("trace_number"), F.floor(F.col("id") / grid.length).alias("r"), (F.col("id") % grid.length).alias("c"))
    c = F.when(F.lit(grid.serpentine) & (F.col("r") % 2 == 1), F.lit(grid.length - 1) - F.col("c")).otherwise(F.col("c"))
    rank = lambda k, step, size: k if step > 0 else F.lit(size - 1) - k
    fast = ((grid.fast[0] + c * grid.fast[1]).cast("int"), rank(c, grid.fast[1], grid.length).cast("int"))
    slow = ((grid.slow[0] + F.col("r") * grid.slow[1]).cast("int"), rank(F.col("r"), grid.slow[1], grid.rows).cast("int"))
    (il, row), (xl, col) = (slow, fast) if grid.fast_is_crossline else (fast, slow)
    return t.select("trace_number", il.alias("il"), xl.alias("xl"), row.alias("row"), col.alias("col"))


def mapping_confidence(records, fields: dict[str, str]) -> dict[str, float]:
    """Confidence of each mapped field: the share of traces that have it, less where few values differ; offsets by their share alone."""
    one = records.agg(*(F.avg(F.when(F.col(c) != 0, 1.0).otherwise(0.0)).alias(f"c_{f}") for f, c in fields.items()), *((F.count_distinct(c) / F.count(F.lit(1))).alias(f"u_{f}") for f, c in fields.items())).collect()[0]
    return {f: (one[f"c_{f}"] or 0.0) * (1.0 if f == "offset" else 0.65 + 0.35 * min(1.0, one[f"u_{f}"] or 0.0)) for f in fields}
