import random
from datetime import datetime, timedelta

import numpy as np

from lithoframe.llm import linkage

COLS = "record_id bigint, line string, source_id int, receiver_id int, source_x double, source_y double, receiver_x double, receiver_y double, has_source boolean, has_receiver boolean, trace_offset double, has_offset boolean, recorded_at timestamp, confidence int, key string"


def survey(lines=4, shots=20, receivers=16):
    r = random.Random(1)
    t0 = datetime(2024, 2, 1)
    a, n = [], 0
    for line in range(lines):
        for s in range(shots):
            sx, sy = s * 50.0 + r.uniform(-2, 2), 3_000_000 + line * 400.0 + r.uniform(-2, 2)
            for k in range(receivers):
                rx, ry = s * 50.0 + (k - 8) * 25.0 + r.uniform(-2, 2) + 7, sy + 60 + r.uniform(-2, 2)
                off = ((rx - sx) ** 2 + (ry - sy) ** 2) ** 0.5
                a.append([n, f"L{line}", 1000 + line * shots + s, 2000 + line * 100 + s * 2 + k, sx, sy, rx, ry, True, True, off, True, t0 + timedelta(seconds=line * 600 + s * 9), 1, "x"])
                n += 1
    return a


def other(a):
    r = random.Random(2)
    b, truth = [], {}
    for x in a:
        if r.random() < 0.1:
            continue
        y = list(x)
        y[0] = 10**6 + x[0]
        delivery = int(x[1][1])
        shift = (0, 0) if delivery else (20.0, -25.0)
        for i in (4, 6):
            y[i] = x[i] + shift[0] + r.gauss(0, 1)
            y[i + 1] = x[i + 1] + shift[1] + r.gauss(0, 1)
        if delivery == 2:
            y[4], y[5], y[6], y[7] = y[5], y[4], y[7], y[6]
        y[10] = (x[10] + r.gauss(0, 0.5)) * (-1 if delivery == 1 else 1)
        y[12] = x[12] + timedelta(seconds=[-7200, 30, 3600, 28800][delivery] + r.randint(-1, 1))
        if delivery == 3:
            y[2], y[3] = y[2] - 777, y[3] + 333
        if r.random() < 0.05:
            y[8] = False
        b.append(y)
        truth[y[0]] = x[0]
    later = [[*y[:12], y[12] + timedelta(days=5), 1, "x"] for y in b[:40]]
    for i, y in enumerate(later):
        y[0] = 2 * 10**6 + i
    return b, later, truth


def test_pairs_of_noisy_deliveries(spark):
    a = survey()
    b, later, truth = other(a)
    df = lambda rows: spark.createDataFrame([tuple(x) for x in rows], COLS)
    labels = [(truth[y[0]], y[0], True) for y in b[:200]] + [(truth[y[0]] + 1, y[0], False) for y in b[200:400]]
    got = linkage.link(df(a + a[:30]), df(b + later + b[:30]), spark.createDataFrame(labels, "a_record_id bigint, b_record_id bigint, same_trace boolean")).where("confidence >= 0.5").collect()
    pairs = [(r["a_record_id"], r["b_record_id"]) for r in got]
    assert len(set(pairs)) == len(pairs)
    right = sum(truth.get(y) == x for x, y in pairs)
    assert right >= 0.9 * len(truth), (right, len(truth))
    assert right >= 0.95 * len(pairs), (right, len(pairs))
    assert not any(y >= 2 * 10**6 for _, y in pairs)


def test_odd_rows_and_empty_tables(spark):
    nan = float("nan")
    odd = [(1, None, None, None, nan, None, 1e300, 1.0, True, True, nan, True, None, 1, "x"), (None, "L", 1, 1, 0.0, 0.0, 0.0, 0.0, True, True, 1.0, True, datetime(2024, 1, 1), 1, "x"), (2, "L", 0, -5, 0.0, 0.0, 0.0, 0.0, None, None, 0.0, None, datetime(2024, 1, 1), 1, "x")]
    df = spark.createDataFrame(odd, COLS)
    assert linkage.link(df, df.where("false")).count() == 0
    assert linkage.link(df.where("false"), df.where("false")).count() == 0
    assert linkage.link(df, df).where("a_record_id IS NULL OR b_record_id IS NULL").count() == 0


def test_vectors_and_blocks():
    r = np.random.default_rng(0)
    n = 400
    cols = {"sx": r.uniform(0, 5000, n), "sy": r.uniform(3e6, 3.005e6, n), "off": r.uniform(10, 500, n), "sid": np.arange(1, n + 1), "rid": np.arange(1, n + 1)}
    cols["rx"], cols["ry"] = cols["sx"] + r.uniform(-300, 300, n), cols["sy"] + r.uniform(-300, 300, n)
    vec = linkage.train_vectors(cols)
    assert np.isfinite(vec).all() and np.allclose(np.linalg.norm(vec, axis=1), 1, atol=1e-3)
    near = {k: v + 1.0 if k in ("sx", "sy", "rx", "ry", "off") else v for k, v in cols.items()}
    swapped = near | {"sx": near["sy"], "sy": near["sx"], "rx": near["ry"], "ry": near["rx"]}
    e, f, g = (linkage.tokens(c) for c in (cols, near, swapped))
    x, y, z = (linkage.view_vectors(t, ("mid", "vec"), vec)[0] for t in (e, f, g))
    assert np.einsum("nd,nd->n", x, y).min() > 0.9 and np.allclose(y, z, atol=1e-5)
    assert np.median(np.einsum("nd,nd->n", x, np.roll(y, 1, 0))) < 0.7
    empty = {k: v[:0] for k, v in cols.items()}
    assert linkage.train_vectors(empty).shape == (linkage.SLOTS, linkage.DIM)


def block_recall(a, b, queries):
    """Share of the queries' nearest partners, found among all A records without the limits of the comparison, that are candidates of their blocks too."""
    da, db = a.toPandas(), b.where(queries).toPandas()
    sample = a.unionByName(b).where("id % 3 = 0").toPandas()
    cols = {c: sample[c].to_numpy(float if c not in ("sid", "rid") else np.int64) for c in linkage._EXACT}
    trained = linkage.train_vectors(cols)
    vec = a.sparkSession.sparkContext.broadcast((trained, linkage.centres(linkage.tokens(cols), trained)))
    met = {(r["a_id"], r["b_id"]) for r in linkage.candidates(linkage.blocked(a, vec, linkage.BITS, wide=False), linkage.blocked(b.where(queries), vec, linkage.BITS)).collect()}
    ends, best = ["sx", "sy", "rx", "ry"], []
    for r in db.to_dict("records"):
        p, o = da[ends].to_numpy(float), da["off"].to_numpy(float)
        either = [np.abs(p - np.array([r[c] for c in order], float)) for order in (ends, ["sy", "sx", "ry", "rx"])]
        far = np.fmin(*(np.nansum(e, 1) for e in either)) + 5 * np.abs(o - r["off"]) + np.minimum(np.abs(da["sec"].to_numpy(float) - r["sec"]) / 1e4, 100.0)
        best.append((int(da["id"].iloc[int(np.nanargmin(far))]), r["id"]))
    return sum(p in met for p in best), len(best)


def test_blocks_hold_the_best_partners(spark):
    a = survey()
    b, _, _ = other(a)
    da, db = (linkage.digests(spark.createDataFrame([tuple(x) for x in rows], COLS), line) for rows, line in ((a, "line"), (b, None)))
    found, all_ = block_recall(da, db, "id % 5 = 0")
    assert all_ > 150 and found >= 0.9 * all_, (found, all_)


def test_words_rule_out_no_pair():
    """Whatever the exact comparison keeps, the words let through: large places, far ends that slipped, missing parts."""
    r = np.random.default_rng(3)
    n = 20_000
    base = {c: r.uniform(-5e8, 5e8, n) for c in ("sx", "sy", "rx", "ry")} | {"off": r.uniform(0, 40_000, n), "sec": r.uniform(1.7e9, 1.8e9, n), "sid": r.integers(0, 4000, n), "rid": r.integers(0, 4000, n)}
    shift = {c: r.uniform(-60, 60, n) for c in "xy"}
    near = {c: base[c] + shift[c[1]] + r.normal(0, 3, n) for c in ("sx", "sy", "rx", "ry")} | {"off": base["off"] + r.uniform(-4, 4, n), "sec": base["sec"] + r.uniform(-43_000, 43_000, n), "sid": base["sid"] % 1000, "rid": base["rid"]}
    for c in ("sx", "rx"):
        gone = r.random(n) < 0.1
        near[c][gone] = near[c[0] + "y"][gone] = np.nan
    slip = r.random(n) < 0.1
    near["sx"][slip] += r.uniform(100, 1e6, slip.sum())
    near["off"][r.random(n) < 0.1] = np.nan
    near["sec"][r.random(n) < 0.1] = np.nan
    ok = linkage.may_be_one(*linkage.words(base), *linkage.words(near))
    sx, sy, rx, ry = (near[c] - base[c] for c in ("sx", "sy", "rx", "ry"))
    shape, doff = np.hypot(sx - rx, sy - ry), np.abs(near["off"] - base["off"])
    same = [(base[c] % 1000 == near[c] % 1000) & (base[c] > 0) & (near[c] > 0) for c in ("sid", "rid")]
    slipped = (shape > linkage.SLIP) & same[0] & (np.hypot(rx, ry) <= linkage.MAX_SHIFT) & (np.hypot(sx, sy) > linkage.SLIP)
    sx[slipped] = sy[slipped] = shape[slipped] = np.nan
    middle = [np.nanmean([s, t], 0) for s, t in ((sx, rx), (sy, ry))]
    far = np.hypot(*(np.nan_to_num(m) for m in middle))
    miss = sum(np.where(k, 0, 1.5) for k in same) + np.where(np.isnan(doff), 1.5, doff**2 / 2) + np.where(np.isnan(shape), 1.5, shape**2 / 18) + far / 40
    kept = (far <= linkage.MAX_SHIFT) & ~(shape > linkage.MAX_SHAPE) & ~(doff > linkage.MAX_OFFSET) & (miss <= linkage.MAX_MISS)
    assert kept.sum() > 5_000 and (ok | ~kept).all()
    stranger = {c: np.roll(v, 1) for c, v in near.items()}
    assert linkage.may_be_one(*linkage.words(base), *linkage.words(stranger)).mean() < 0.2


def test_long_offsets_and_many_lines(spark):
    """Offsets of 12 km, 3,000 lines and coordinates of 40 million metres are matched like any others."""
    r = random.Random(5)
    t0 = datetime(2024, 2, 1)
    a, b = [], []
    for line in range(3000):
        sx, sy = 4.0e7 + line % 60 * 500.0, 4.1e7 + line // 60 * 500.0
        for k in range(2):
            rx, ry = sx + 12_000 + k * 700.0 + r.uniform(-50, 50), sy + r.uniform(-300, 300)
            off = ((rx - sx) ** 2 + (ry - sy) ** 2) ** 0.5
            row = [line * 2 + k, f"L{line}", 1000 + line, 2000 + k, sx, sy, rx, ry, True, True, off, True, t0 + timedelta(seconds=line * 20), 1, "x"]
            a.append(tuple(row))
            g = lambda: r.gauss(0, 1)
            b.append((10**6 + row[0], "other", row[2], row[3], sx + 5 + g(), sy - 9 + g(), rx + 5 + g(), ry - 9 + g(), True, True, off + 0.3 * g(), True, row[12] + timedelta(seconds=60), 1, "x"))
    got = linkage.link(spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS)).where("confidence >= 0.5").collect()
    right = sum(x["b_record_id"] - 10**6 == x["a_record_id"] for x in got)
    assert right >= 0.93 * len(b) and right >= 0.98 * len(got), (right, len(got))


def test_labels_move_the_calibration_by_their_weight():
    assert np.allclose(linkage.calibrated(np.zeros((0, 4)), np.zeros(0)), linkage.PRIOR)
    x = np.array([[0.9, -1.0, 3.0, 5.0]])
    one, many = (linkage.calibrated(np.repeat(x, n, 0), np.zeros(n)) for n in (1, 400))
    score = lambda w: float(x[0] @ w[:4] + w[4])
    assert score(np.array(linkage.PRIOR)) > score(one) > score(many) and score(many) < 0


def area_recall(side, n):
    """Share of 5,000 shifted and noisy records that share a block of the views by place with their originals, on a square of `side` metres."""
    r = np.random.default_rng(0)
    cols = {"sx": r.uniform(0, side, n), "sy": r.uniform(3e6, 3e6 + side, n), "sid": r.integers(1, 1000, n), "rid": r.integers(1, 1000, n)}
    cols["rx"], cols["ry"] = cols["sx"] + r.uniform(-300, 300, n), cols["sy"] + r.uniform(-300, 300, n)
    cols["off"] = np.hypot(cols["rx"] - cols["sx"], cols["ry"] - cols["sy"])
    sample, some = ({k: v[at] for k, v in cols.items()} for at in (slice(0, linkage.SAMPLE), slice(-5_000, None)))
    noise = {k: r.normal(0, 1, 5_000) + (20.0 if k in ("sx", "rx") else -25.0 if k in ("sy", "ry") else 0.0) for k in ("sx", "sy", "rx", "ry", "off")}
    other = {k: v + noise.get(k, 0) for k, v in some.items()}
    vec = linkage.train_vectors(sample)
    edges = [linkage.tokens(c) for c in (some, other)]
    means, met = linkage.centres(linkage.tokens(sample), vec), np.zeros(5_000, bool)
    for i, (view, tables) in enumerate(linkage.VIEWS[:2]):
        x, y = (linkage.view_vectors(e, view, vec)[0] - means[i] for e in edges)
        for t in range(tables):
            plane = linkage.hyperplanes(i, t, linkage.BITS)
            met |= ((x @ plane > 0) == (y @ plane > 0)).all(1)
    return met.mean()


def test_blocks_hold_whatever_the_area():
    """In the large area the sample has one record for 32 cells."""
    small, large = area_recall(4_000.0, 40_000), area_recall(200_000.0, 400_000)
    assert large >= small - 0.03, (small, large)


def test_partners_meet_across_borders_of_tiles():
    size = linkage.PLACE * linkage.PERIOD
    x, y = np.array([size - 1.0, size + 2.0, 10.0, size * 1.5]), np.array([size * 3 - 1.0, size * 3.5, size * 3 + 30.0, size * 3.5])
    a = {"rx": x, "ry": y, "sx": x, "sy": y}
    for dx, dy in ((60.0, 60.0), (-60.0, 60.0), (60.0, -60.0), (-60.0, -60.0)):
        b = {"rx": x + dx, "ry": y + dy}
        own = next(linkage.tiles(("rec", "len"), a, False))[0]
        assert sum(h & (t == own) for t, h in linkage.tiles(("rec", "len"), b, True)).tolist() == [1, 1, 1, 1]
