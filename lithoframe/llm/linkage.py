"""Records of two sources that describe the same traces without a common key, matched with a confidence.

Records, their attributes and the tokens of the attributes' values form a graph. Random walks over it
train skip-gram vectors of the tokens; a record's vector is the weighted sum of its tokens'. Vectors
are blocked by several tables of random hyperplanes within tiles of the ground, the pairs of a block are compared exactly, and
what the pairs of a delivery have in common (clock, shift, swapped axes) reranks them. Labelled pairs
calibrate the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.runtime import durable, finite

#: Token vectors: rows of the hashed vocabulary and length.
SLOTS, DIM = 1 << 16, 48
#: Records the graph is sampled from for training; every record is encoded, hashed and compared.
SAMPLE = 20_000
WALKS, STEPS, WINDOW, NEGATIVES, EPOCHS, RATE = 2, 6, 2, 4, 1, 0.02
#: Numbers are compared modulo this (at most 1022), as deliveries drop or exchange leading digits.
MODULUS = 1000
#: Metres per cell of a token, by attribute.
PLACE, SPREAD, LENGTH = 250.0, 40.0, 15.0
#: Cells along a tile. Tokens of places repeat from tile to tile and blocks lie within one, so neither the vocabulary that the sample has to cover nor the hyperplanes grow with the area.
PERIOD = 16
#: Views (attributes whose vectors are added) with their number of tables: either end with the length between both, and the numbers with it.
VIEWS = ((("rec", "len"), 2), (("src", "len"), 2), (("sid", "rid", "len"), 1))
#: Hyperplanes of a table at least; where a tile has more than 2^BITS records their number grows with the logarithm of its records, and with every MORE of them each view gets another table.
BITS, MORE = 18, 4
#: Positions of a delivery may be shifted so far, shapes and offsets may differ so far (metres), clocks so far (seconds).
MAX_SHIFT, MAX_SHAPE, MAX_OFFSET, MAX_CLOCK = 90.0, 10.0, 4.0, 43_200
#: Metres from a tile's border up to which a record's partner may lie beyond it.
REACH = MAX_SHIFT + MAX_SHAPE
#: Metres from which the shift of one end against the other is taken for a slip.
SLIP = 100.0
#: Cost beyond which a pair isn't pursued: missing parts and unequal numbers cost 6 together.
MAX_MISS = 9.0
#: Bins in which the pairs of a delivery agree: seconds and metres.
CLOCK_BIN, SHIFT_BIN = 8.0, 16.0
#: Labelled pairs used for the calibration at most.
MAX_LABELS = 20_000

_ATTR = {"mid": 1, "vec": 2, "rec": 3, "src": 4, "len": 5, "sid": 6, "rid": 7}


def _slot(attr: int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    h = a.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(b).astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= np.uint64(attr * 0x1B873593)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)


def _hat1(attr: int, v: np.ndarray, size: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tokens of a value: the two nearest grid points, weighted by nearness."""
    q = v / size
    i = np.floor(q)
    f = q - i
    return [(_slot(attr, i), 1 - f), (_slot(attr, i + 1), f)]


def _hat2(attr: int, x: np.ndarray, y: np.ndarray, size: float, period: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tokens of a pair of values: the four grid points around it, weighted by nearness; they repeat after `period` points."""
    qx, qy = x / size, y / size
    i, j = np.floor(qx), np.floor(qy)
    fx, fy = qx - i, qy - j
    at = lambda k: np.mod(k, period) if period else k
    return [(_slot(attr, at(i + a), at(j + b)), (fx if a else 1 - fx) * (fy if b else 1 - fy)) for a in (0, 1) for b in (0, 1)]


def tokens(cols: dict[str, np.ndarray], only: set[str] | None = None) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """(slot, weight) edges of each attribute, or of some only; weight 0 where the attribute is missing.

    Swapped axes and turned directions leave the tokens as they are: places are ordered pairs, and
    a spread is the pair of its absolute components.
    """
    sx, sy, rx, ry, off = (np.nan_to_num(cols[c].astype(float), nan=0.0, posinf=0.0, neginf=0.0) for c in ("sx", "sy", "rx", "ry", "off"))
    has = {c: np.isfinite(cols[c].astype(float)) for c in ("sx", "rx", "off")}
    lo, hi = np.minimum, np.maximum
    dx, dy = np.abs(rx - sx), np.abs(ry - sy)
    mx, my = (rx + sx) / 2, (ry + sy) / 2
    both = has["sx"] & has["rx"]
    length = np.where(has["off"], np.abs(off), np.hypot(rx - sx, ry - sy))  # without an offset the ends tell it
    made = {
        "mid": (both, lambda t: _hat2(t, lo(mx, my), hi(mx, my), PLACE, PERIOD)),
        "vec": (both, lambda t: _hat2(t, lo(dx, dy), hi(dx, dy), SPREAD)),
        "rec": (has["rx"], lambda t: _hat2(t, lo(rx, ry), hi(rx, ry), PLACE, PERIOD)),
        "src": (has["sx"], lambda t: _hat2(t, lo(sx, sy), hi(sx, sy), PLACE, PERIOD)),
        "len": (has["off"] | both, lambda t: _hat1(t, length, LENGTH)),
        "sid": (cols["sid"] > 0, lambda t: [(_slot(t, cols["sid"] % MODULUS), np.ones(len(sx)))]),
        "rid": (cols["rid"] > 0, lambda t: [(_slot(t, cols["rid"] % MODULUS), np.ones(len(sx)))]),
    }
    return {k: [(s, w * ok) for s, w in edges(_ATTR[k])] for k, (ok, edges) in made.items() if only is None or k in only}


def train_vectors(cols: dict[str, np.ndarray], seed: int = 7) -> np.ndarray:
    """Token vectors (SLOTS x DIM, unit length) by skip-gram with negative sampling over random walks of the sampled records' graph.

    Tokens that the sample doesn't have keep their random start, so records still meet by them.
    """
    rng = np.random.default_rng(seed)
    vec = rng.standard_normal((SLOTS, DIM)).astype(np.float32) / math.sqrt(DIM)
    n = len(cols["sx"])
    if n < 2:
        return vec / np.linalg.norm(vec, axis=1, keepdims=True)
    edges = [e for group in tokens(cols).values() for e in group]
    slots, weights = np.stack([s for s, _ in edges], 1), np.stack([w for _, w in edges], 1)
    usable = np.flatnonzero(weights.sum(1) > 0)
    slots, weights = slots[usable], weights[usable]
    n = len(usable)
    if n == 0:
        return vec / np.linalg.norm(vec, axis=1, keepdims=True)
    cum = np.cumsum(weights, 1) / weights.sum(1, keepdims=True)
    flat = np.where(weights.ravel() > 0)[0]
    by_slot = flat[np.argsort(slots.ravel()[flat], kind="stable")]
    keys = slots.ravel()[by_slot]
    first, last = np.searchsorted(keys, np.arange(SLOTS), "left"), np.searchsorted(keys, np.arange(SLOTS), "right")

    def token_of(records: np.ndarray) -> np.ndarray:
        k = (cum[records] < rng.random((len(records), 1))).sum(1)
        return slots[records, np.minimum(k, slots.shape[1] - 1)]

    out = np.zeros_like(vec)
    for _ in range(EPOCHS):
        for _ in range(WALKS):
            at = rng.permutation(n)
            walk = []
            for _ in range(STEPS):  # record -> token -> record -> ...
                t = token_of(at)
                walk.append(t)
                at = by_slot[(first[t] + (rng.random(len(t)) * (last[t] - first[t])).astype(np.int64)).clip(0, len(by_slot) - 1)] // slots.shape[1]
            for i in range(STEPS):
                for j in range(max(0, i - WINDOW), min(STEPS, i + WINDOW + 1)):
                    if i == j:
                        continue
                    for part in range(0, n, 4096):
                        a, b = walk[i][part : part + 4096], walk[j][part : part + 4096]
                        neg = keys[rng.integers(0, len(keys), (len(a), NEGATIVES))]
                        va = vec[a]
                        g = 1 - 1 / (1 + np.exp(-np.einsum("nd,nd->n", va, out[b])))
                        gn = -1 / (1 + np.exp(-np.einsum("nd,nkd->nk", va, out[neg])))
                        da = g[:, None] * out[b] + np.einsum("nk,nkd->nd", gn, out[neg])
                        np.add.at(out, b, (RATE * g)[:, None] * va)
                        np.add.at(out, neg, (RATE * gn)[:, :, None] * va[:, None, :])
                        np.add.at(vec, a, RATE * da)
    vec -= vec[np.unique(keys)].mean(0)
    return vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)


def view_vectors(edges: dict, view: tuple[str, ...], vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of records under a view, whether the record has all its attributes)."""
    total, ok = None, None
    for attr in view:
        part = sum(vec[s] * w[:, None].astype(np.float32) for s, w in edges[attr])
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part = part / np.maximum(norm, 1e-9)
        total = part if total is None else total + part
        here = norm[:, 0] > 1e-9
        ok = here if ok is None else ok & here
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), ok


def centres(edges: dict, vec: np.ndarray) -> list[np.ndarray]:
    """The mean vector of the sampled records under each view: hyperplanes through it part the records evenly, those through 0 wouldn't."""
    out = []
    for view, _ in VIEWS:
        x, ok = view_vectors(edges, view, vec)
        out.append(x[ok].mean(0) if ok.any() else np.zeros(DIM, np.float32))
    return out


def hyperplanes(view: int, table: int, bits: int) -> np.ndarray:
    return np.random.default_rng(1000 * view + table).standard_normal((DIM, bits)).astype(np.float32)


def digests(df: DataFrame, line: str | None) -> DataFrame:
    """(id, sx, sy, rx, ry, off, sec, sid, rid, line): each record once, its columns as they are; what is missing or not finite is null.

    Records without an id are left out. If copies of a record disagree, the one that sorts first stands.
    """

    def place(end: str, axis: str) -> Column:
        x, y = F.col(f"{end}_x").cast("double"), F.col(f"{end}_y").cast("double")
        there = F.coalesce(F.col(f"has_{end}"), F.lit(False)) & finite(x) & finite(y)
        return F.when(there, x if axis == "x" else y)

    off, known = F.col("trace_offset").cast("double"), F.coalesce("has_offset", F.lit(False))
    number = lambda c: F.greatest(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), F.lit(0))
    columns = {
        "sx": place("source", "x"), "sy": place("source", "y"), "rx": place("receiver", "x"), "ry": place("receiver", "y"), "off": F.when(known & finite(off), F.abs(off)),
        "sec": (F.unix_micros(F.col("recorded_at").cast("timestamp")) / F.lit(1_000_000)).cast("bigint"), "sid": number("source_id"), "rid": number("receiver_id"),
        "line": F.xxhash64(line) if line else F.lit(0).cast("bigint"),
    }
    rows = df.where(F.col("record_id").isNotNull()).select(F.col("record_id").cast("bigint").alias("id"), F.struct(*(c.alias(k) for k, c in columns.items())).alias("d"))
    return rows.groupBy("id").agg(F.min("d").alias("d")).select("id", "d.*")


_EXACT = ("sx", "sy", "rx", "ry", "off", "sec", "sid", "rid")


def columns_of(batch: pa.RecordBatch, names: dict[str, str]) -> dict[str, np.ndarray]:
    """Columns of a batch as doubles with NaN for null, but the numbers as whole numbers."""
    out = {}
    for name, column in names.items():
        c = batch.column(batch.schema.get_field_index(column))
        out[name] = c.to_numpy(zero_copy_only=False).astype(np.int64) if name in ("sid", "rid", "line", "id") else c.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    return out


# In its blocks a record is known by two words, from which the join and a first comparison tell what can't be a pair:
# ground (four coordinates in steps of GRAIN modulo 2^12, the offset modulo 2^13 and which of them there are) and
# rest (second modulo 2^24, or NO_TIME; the numbers' last digits). What they can't tell goes on to the exact comparison.
GRAIN, _NO_TIME, _DAYS = 2.0, 1 << 24, 1 << 24


def words(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two words of each record."""
    with np.errstate(invalid="ignore"):
        step = lambda c, bits: np.mod(np.nan_to_num(np.rint(cols[c] / GRAIN)), float(1 << bits)).astype(np.int64)
        ground = step("off", 13) << 3
        for k, c in enumerate(("sx", "sy", "rx", "ry")):
            ground |= step(c, 12) << (16 + 12 * k)
        for k, c in enumerate(("sx", "rx", "off")):
            ground |= np.isfinite(cols[c]).astype(np.int64) << k
        second = np.where(np.isfinite(cols["sec"]), np.mod(np.nan_to_num(cols["sec"]), float(_DAYS)), float(_NO_TIME)).astype(np.int64)
    last = lambda c: np.where(cols[c] > 0, cols[c] % MODULUS, 1023)
    return ground, second << 20 | last("sid") << 10 | last("rid")


def may_be_one(ag: np.ndarray, ar: np.ndarray, bg: np.ndarray, br: np.ndarray) -> np.ndarray:
    """Whether records with these words can be a pair under the limits, all roundings in their favour."""
    u = lambda g, k: ((g >> (16 + 12 * k)) & 4095).astype(np.float64) * GRAIN
    span = GRAIN * 4096
    near = lambda d: (d + span / 2) % span - span / 2
    both = lambda k: ((ag & bg) >> k & 1).astype(bool)
    hs, hr = both(0), both(1)
    off = np.abs((((ag >> 3) & 8191) - ((bg >> 3) & 8191) + 4096) % 8192 - 4096) * GRAIN
    doff = np.where(both(2), np.maximum(off - GRAIN, 0.0), 0.0)
    same = [(ar >> k & 1023 == br >> k & 1023) & (ar >> k & 1023 != 1023) for k in (10, 0)]
    cost = sum(np.where(k, 0.0, 1.5) for k in same) + np.where(both(2), doff * doff / 2, 1.5)
    slack = GRAIN * math.sqrt(2)
    ok = np.zeros(len(ag), bool)
    for swapped in (False, True):
        b = (1, 0, 3, 2) if swapped else (0, 1, 2, 3)
        sx, sy, rx, ry = (near(u(bg, b[k]) - u(ag, k)) for k in range(4))
        shape = np.where(hs & hr, np.maximum(np.hypot(sx - rx, sy - ry) - 2 * slack, 0.0), 0.0)
        middle = np.hypot(np.where(hs, np.where(hr, (sx + rx) / 2, sx), np.where(hr, rx, 0.0)), np.where(hs, np.where(hr, (sy + ry) / 2, sy), np.where(hr, ry, 0.0)))
        for far, bent in ((middle, np.where(hs & hr, shape * shape / 18, 1.5)), (np.hypot(rx, ry), np.where(hs & hr & same[0], 1.5, np.inf)), (np.hypot(sx, sy), np.where(hs & hr & same[1], 1.5, np.inf))):
            far = np.maximum(far - slack, 0.0)
            ok |= (far <= MAX_SHIFT) & ((bent == 1.5) | (shape <= MAX_SHAPE)) & (cost + bent + far / 40 <= MAX_MISS)
    return ok


def tiles(view: tuple[str, ...], cols: dict[str, np.ndarray], wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tile hash, records in it) of a view: a square of the ground, or the numbers where the view has no place.

    wide adds the tiles beyond borders nearer than REACH, so a partner across the border is met in its own.
    """
    whole = lambda i: np.mod(i, float(1 << 40)).astype(np.int64)
    mixed = lambda i, j: (whole(i) * 0x9E3779B1 ^ whole(j) * 0x85EBCA77) * 0x27D4EB2F >> 8
    for attr, x, y in (("rec", "rx", "ry"), ("src", "sx", "sy")):
        if attr in view:
            size = PLACE * PERIOD
            u, v = np.nan_to_num(np.minimum(cols[x], cols[y])), np.nan_to_num(np.maximum(cols[x], cols[y]))
            i, j = np.floor(u / size), np.floor(v / size)
            for a in (-1, 0, 1) if wide else (0,):
                for b in (-1, 0, 1) if wide else (0,):
                    here = (np.floor((u + a * REACH) / size) == i + a) & (np.floor((v + b * REACH) / size) == j + b)
                    yield mixed(i + a, j + b), here
            return
    yield mixed(cols["sid"] % MODULUS, cols["rid"] % MODULUS), np.ones(len(cols["sid"]), bool)


def tables(n: int, bits: int) -> int:
    """Tables of a view that has n at BITS hyperplanes."""
    return min(8, n + -(-(bits - BITS) // MORE))


def blocked(df: DataFrame, vec, bits: int, wide: bool = True) -> DataFrame:
    """(key, id, ground, rest): each record in its block of every table of its views, with its words.

    A record is put under all views it has the attributes of. One side at least has to be wide (see tiles()).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, means = vec.value
        planes = [[hyperplanes(i, t, bits) for t in range(tables(n, bits))] for i, (_, n) in enumerate(VIEWS)]
        weights = 1 << np.arange(bits, dtype=np.int64)
        needed = {attr for view, _ in VIEWS for attr in view}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cols = columns_of(batch, {c: c for c in _EXACT})
            ground, rest = words(cols)
            edges = tokens(cols, needed)
            for i, (view, _) in enumerate(VIEWS):
                x, ok = view_vectors(edges, view, v)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                x = x - means[i]
                within = [(tile[at], np.flatnonzero(here[at])) for tile, here in tiles(view, cols, wide)]
                for t, plane in enumerate(planes[i]):
                    block = ((x[at] @ plane > 0) * weights).sum(1)
                    for tile, k in within:
                        if len(k):
                            key = block[k] | ((tile[k] & ((1 << (56 - bits)) - 1)) << np.int64(bits)) | ((np.int64(i) * 8 + t) << np.int64(56))
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, ids[at][k], ground[at][k], rest[at][k])], names=["key", "id", "ground", "rest"])

    return df.select("id", *_EXACT).mapInArrow(work, "key bigint, id bigint, ground bigint, rest bigint")


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id), each once and partitioned by b_id: the pairs that share a block and whose words don't rule them out."""
    left, right = (df.select("key", *(F.col(c).alias(f"{k}_{c}") for c in ("id", "ground", "rest"))) for k, df in (("a", a), ("b", b)))
    second = lambda w: F.shiftright(w, 20)
    dt = F.abs(second("b_rest") - second("a_rest"))
    no_time = (second("a_rest") == _NO_TIME) | (second("b_rest") == _NO_TIME)
    offset = lambda w: F.shiftright(w, 3).bitwiseAND(8191)
    doff = F.abs(offset("a_ground") - offset("b_ground"))
    steps = int(MAX_OFFSET / GRAIN) + 1
    one_lacks = F.col("a_ground").bitwiseAND(F.col("b_ground")).bitwiseAND(4) == 0
    met = left.join(right, "key").where(((dt <= MAX_CLOCK) | (dt >= _DAYS - MAX_CLOCK) | no_time) & ((doff <= steps) | (doff >= 8192 - steps) | one_lacks))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ai, ag, ar, bi, bg, br = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            ok = may_be_one(ag, ar, bg, br)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(ai[ok]), pa.array(bi[ok])], names=["a_id", "b_id"])

    pairs = met.select("a_id", "a_ground", "a_rest", "b_id", "b_ground", "b_rest").mapInArrow(sift, "a_id bigint, b_id bigint")
    return pairs.repartition("b_id").dropDuplicates(["a_id", "b_id"])


def cosines(a: dict[str, np.ndarray], b: dict[str, np.ndarray], vec: np.ndarray) -> np.ndarray:
    """The cosine of the vectors of each pair of records over the attributes that both have; 0 if none."""
    of_a, of_b = tokens(a), tokens(b)
    total_a = total_b = np.zeros((len(a["sx"]), DIM), np.float32)
    for attr in _ATTR:
        pa_, pb_ = (sum(vec[s] * w[:, None].astype(np.float32) for s, w in edges[attr]) for edges in (of_a, of_b))
        na, nb = (np.linalg.norm(p, axis=1, keepdims=True) for p in (pa_, pb_))
        both = (na > 1e-9) & (nb > 1e-9)
        total_a, total_b = (t + np.where(both, p / np.maximum(n, 1e-9), 0) for t, p, n in ((total_a, pa_, na), (total_b, pb_, nb)))
    norm = np.linalg.norm(total_a, axis=1) * np.linalg.norm(total_b, axis=1)
    return np.einsum("nd,nd->n", total_a, total_b) / np.maximum(norm, 1e-9)


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


_PAIR = "a_id bigint, b_id bigint, bin bigint, miss float, cos float"


def compared(pairs: DataFrame, da: DataFrame, db: DataFrame, vec) -> DataFrame:
    """(a_id, b_id, bin, miss, cos) of the pairs that keep the limits, from the records' columns as they are.

    bin stands for A's line, the axes' order and the cell of the clock's and the place's shift; miss is
    the cost of the differences, cos the cosine of the vectors. A pair that fits with either order of axes comes twice.
    """
    side = lambda df, k, names: df.select(F.col("id").alias(f"{k}_id"), *(F.col(c).alias(f"{k}_{c}") for c in names))
    met = pairs.join(side(db, "b", _EXACT), "b_id").join(side(da, "a", (*_EXACT, "line")), "a_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (columns_of(batch, {c: f"{k}_{c}" for c in (*_EXACT, "id")}) for k in "ab")
            line = batch.column(batch.schema.get_field_index("a_line")).to_numpy(zero_copy_only=False)
            clock, doff = b["sec"] - a["sec"], np.abs(a["off"] - b["off"])
            same = [(a[c] % MODULUS == b[c] % MODULUS) & (a[c] > 0) & (b[c] > 0) for c in ("sid", "rid")]
            plain = sum(np.where(k, 0.0, 1.5) for k in same) + np.where(np.isnan(doff), 1.5, doff * doff / 2) + np.where(np.isnan(clock), 1.5, 0.0)
            kept, fits = ~(np.abs(clock) > MAX_CLOCK) & ~(doff > MAX_OFFSET), []
            for swapped, order in enumerate((("sx", "sy", "rx", "ry"), ("sy", "sx", "ry", "rx"))):
                sx, sy, rx, ry = (b[c] - a[k] for c, k in zip(order, ("sx", "sy", "rx", "ry")))
                with np.errstate(invalid="ignore"):
                    shape = np.hypot(sx - rx, sy - ry)
                    # one end far off though its number is right: a slip of the pen, so the other end alone counts
                    for k, (u, v, other) in enumerate(((sx, sy, (rx, ry)), (rx, ry, (sx, sy)))):
                        slip = (shape > SLIP) & same[k] & (np.hypot(*other) <= MAX_SHIFT) & (np.hypot(u, v) > SLIP)
                        u[slip] = v[slip] = np.nan
                    shape = np.hypot(sx - rx, sy - ry)
                    mx, my = (np.where(np.isnan(s), np.where(np.isnan(r), 0.0, r), np.where(np.isnan(r), s, (s + r) / 2)) for s, r in ((sx, rx), (sy, ry)))
                    far = np.hypot(mx, my)
                    miss = plain + np.where(np.isnan(shape), 1.5, shape * shape / 18) + far / 40
                    ok = kept & (far <= MAX_SHIFT) & ~(shape > MAX_SHAPE) & (miss <= MAX_MISS)
                if swapped:  # a record without any place fits both ways; once is enough
                    ok &= ~(np.isnan(sx) & np.isnan(rx))
                k = np.flatnonzero(ok)
                where = [np.floor(np.nan_to_num(c[k], nan=-1e9) / size) for c, size in ((clock, CLOCK_BIN), (mx, SHIFT_BIN), (my, SHIFT_BIN))]
                fits.append((k, _hash(line[k], np.full(len(k), swapped), *where), miss[k]))
            used = np.unique(np.concatenate([f[0] for f in fits]))
            if not len(used):
                continue
            cos = np.zeros(len(line), np.float32)
            cos[used] = cosines({c: v[used] for c, v in a.items()}, {c: v[used] for c, v in b.items()}, vec.value[0])
            for k, bins, miss in fits:
                if len(k):
                    cols = (a["id"][k], b["id"][k], bins, miss.astype(np.float32), cos[k])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a_id", "b_id", "bin", "miss", "cos"])

    return met.mapInArrow(compare, _PAIR)


def best_pairs(pairs: DataFrame) -> DataFrame:
    """The best A record of each B record: (b_id, a_id, miss, cos, support, lead).

    Pairs of a delivery agree in clock and shift. The fit of all pairs in the same bin of A's line,
    clock and shift supports each of them, so a shifted delivery settles where its whole fits best.
    lead is the distance to the best other A record.
    """
    pairs = durable(pairs)
    votes = pairs.groupBy("bin").agg(F.log(F.sum(F.exp(-F.col("miss")))).alias("support"))
    scored = pairs.join(votes, "bin").withColumn("score", F.col("support") - F.col("miss")).drop("bin")
    of_b = Window.partitionBy("b_id")
    best = scored.withColumn("best", F.max(F.struct("score", (-F.col("a_id")).alias("a"))).over(of_b)).withColumn("other", F.max(F.when(F.col("a_id") != -F.col("best.a"), F.col("score"))).over(of_b))
    chosen = best.where(F.col("a_id") == -F.col("best.a")).groupBy("b_id", "a_id")
    lead = F.max("score") - F.coalesce(F.max("other"), F.max("score") - 10.0)
    return chosen.agg(F.min("miss").alias("miss"), F.max("cos").alias("cos"), F.max("support").alias("support"), lead.alias("lead"))


#: What is known before any label: weights of (cos, -miss, support, lead) and the bias. Labels move them, by as much as they weigh.
PRIOR = (4.0, 0.4, 0.2, 0.3, -2.5)


def calibrated(x: np.ndarray, y: np.ndarray, weight: float = 0.1) -> np.ndarray:
    """Weights (bias last) of a logistic regression whose penalty draws them to PRIOR, by Newton steps. Without labels it is PRIOR itself."""
    prior = np.array(PRIOR)
    x = np.hstack([x.reshape(-1, len(prior) - 1), np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + weight * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - weight * (w - prior))
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


def crowd(frames: list[DataFrame]) -> int:
    """Records of the fullest tile by either end, of both frames together; copies count."""
    ends = []
    for df in frames:
        for end in ("source", "receiver"):
            x, y = F.col(f"{end}_x"), F.col(f"{end}_y")
            i, j = (F.floor(f(x, y) / F.lit(PLACE * PERIOD)).alias(k) for k, f in (("i", F.least), ("j", F.greatest)))
            ends.append(df.where(F.col(f"has_{end}") & finite(x) & finite(y)).select(F.lit(end).alias("end"), i, j))
    return reduce(DataFrame.unionByName, ends).groupBy("end", "i", "j").count().agg(F.max("count")).first()[0] or 0


def link(a: DataFrame, b: DataFrame, labels: DataFrame | None = None, a_line: str = "line") -> DataFrame:
    """(a_record_id, b_record_id, confidence): the best A record of every B record that has one.

    Both frames have the columns of the record schema; extra ones are ignored. Copies count once. An
    A record may have several B records. Records of empty tables or without any usable attribute have
    no pairs. All views need the length, so a record with neither an offset nor both ends has none either.
    labels (a_record_id, b_record_id, same_trace) calibrate the confidence; of more than MAX_LABELS those
    with the smallest hashes are used.
    """
    spark = a.sparkSession
    da, db = digests(a, a_line), digests(b, None)
    rows = a.count() + b.count()
    share = F.pmod(F.xxhash64(F.col("record_id").cast("bigint")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(rows, 1)) * (1 << 30))
    sample = digests(a.where(share), None).unionByName(digests(b.where(share), None)).limit(2 * SAMPLE).toPandas().sort_values("id")
    sampled = {c: sample[c].to_numpy(float if c not in ("sid", "rid") else np.int64) for c in _EXACT}
    trained = train_vectors(sampled)
    vec = spark.sparkContext.broadcast((trained, centres(tokens(sampled), trained)))  # SLOTS x DIM floats and a few vectors
    bits = max(BITS, math.ceil(math.log2(max(crowd([a, b]), 2))))
    met = candidates(blocked(da, vec, bits, wide=False), blocked(db, vec, bits))
    best = durable(best_pairs(compared(met, da, db, vec)))
    features, x, y = ["cos", "miss", "support", "lead"], np.zeros((0, 4)), np.zeros(0)
    if labels is not None:
        known = labels.where("a_record_id is not null and b_record_id is not null and same_trace is not null").select(F.col("a_record_id").alias("la"), F.col("b_record_id").alias("b_id"), "same_trace").distinct()
        known = known.orderBy(F.xxhash64("la", "b_id")).limit(MAX_LABELS)
        seen = best.join(known, "b_id").where("same_trace or a_id = la").select(*features, ((F.col("a_id") == F.col("la")) & F.col("same_trace")).cast("int").alias("y")).toPandas()
        x, y = seen[features].to_numpy(float) * np.array([1, -1, 1, 1]), seen["y"].to_numpy(float)
    w = [float(v) for v in calibrated(x, y)]
    z = F.lit(w[4]) + F.col("cos") * w[0] - F.col("miss") * w[1] + F.col("support") * w[2] + F.col("lead") * w[3]
    return best.select(F.col("a_id").alias("a_record_id"), F.col("b_id").alias("b_record_id"), (1 / (1 + F.exp(-z))).alias("confidence"))
