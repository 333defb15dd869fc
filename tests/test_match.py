"""The matcher against a plain model that walks the records in order."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lithoframe.operators import match

SCHEMA = "ord bigint, source_id int, receiver_id int, source_x double, source_y double, receiver_x double, receiver_y double, has_source boolean, has_receiver boolean, cdp int, has_cdp boolean, trace_offset double, has_offset boolean, header_valid boolean, header_error string, rank int, key string"


def rec(o, s=0, r=0, sxy=None, rxy=None, cdp=None, off=None, valid=True):
    sx, sy = sxy or (0.0, 0.0)
    rx, ry = rxy or (0.0, 0.0)
    return (o, s, r, sx, sy, rx, ry, sxy is not None, rxy is not None, cdp or 0, cdp is not None, off, off is not None, valid, None if valid else "bad", 9, "clash")


def conflicts(records, k):
    places, missing = {}, set()
    for x in records:
        i, there, at = (x[1], x[7], x[3:5]) if k == "s" else (x[2], x[8], x[5:7])
        if i:
            places.setdefault(i, set()).add(at) if there else missing.add(i)
    return {i for i, p in places.items() if len(p) > 1 or i in missing}


def model(a, b):
    cs, cr = conflicts(a + b, "s"), conflicts(a + b, "r")

    def keys(x):
        out = []
        if x[13]:
            if x[1] and x[2] and x[1] not in cs and x[2] not in cr:
                out.append((0, (x[1], x[2])))
            if x[7] and x[8]:
                out.append((1, x[3:7]))
            if x[10] and x[12]:
                out.append((2, (x[9], x[11])))
        return out

    ka, kb = {x[0]: keys(x) for x in a}, {x[0]: keys(x) for x in b}
    if len(a) == len(b) and a and all(x[13] for x in a + b) and not any(ka.values()) and not any(kb.values()):
        return sorted((x[0], y[0], "physical_trace_order") for x, y in zip(a, b)), None
    of = lambda k, side: [o for o in sorted(side) if k in side[o]]
    used, pairs, amb_a, amb_b = set(), {}, set(), set()
    for o in sorted(ka):
        dup, taken = [], []
        for k in ka[o]:
            bs = of(k, kb)
            if not bs:
                continue
            if len(bs) > 1 or len(of(k, ka)) > 1:
                dup.append(k)
            elif bs[0] in used:
                taken.append(bs[0])
            else:
                used.add(bs[0])
                pairs[o] = (bs[0], k[0])
                break
        if o in pairs:
            continue
        for k in dup:
            amb_a |= {o, *of(k, ka)}
            amb_b |= set(of(k, kb))
        if taken:
            amb_a.add(o)
            amb_b |= set(taken)
    for o in list(pairs):
        if o in amb_a:
            amb_b.add(pairs.pop(o)[0])
    found = sorted((o, p, match.STRATEGIES[k]) for o, (p, k) in pairs.items())
    classes = [("a", x[0], "invalid") for x in a if not ka[x[0]]] + [("b", x[0], "invalid") for x in b if not kb[x[0]]]
    got_b = {p for p, _ in pairs.values()}
    for side, keyed, amb, hit in (("a", ka, amb_a, set(pairs)), ("b", kb, amb_b, got_b)):
        for o in keyed:
            if keyed[o]:
                classes += [(side, o, c) for c, there in (("matched", o in hit), ("ambiguous", o in amb), (f"{side}_only", o not in hit and o not in amb)) if there]
    return found, sorted(classes)


def both(spark, a, b):
    pairs, classes = match.match(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
    return rows(pairs.select("a_ord", "b_ord", "strategy")), rows(classes.select("side", "ord", "class"))


@pytest.mark.parametrize("seed", range(4))
def test_random_rivalry(spark, seed):
    r = random.Random(seed)
    place = lambda: (float(r.randrange(3)), 0.0) if r.random() < 0.7 else None
    make = lambda o: rec(o, r.randrange(4), r.randrange(4), place(), place(), r.choice([None, 1, 2, 3]), r.choice([None, 1.0, 2.0, -0.0, 0.0]), r.random() < 0.9)
    a, b = [make(i) for i in range(14)], [make(100 + i) for i in range(14)]
    assert both(spark, a, b) == model(a, b)


def test_number_conflict_falls_back_to_places(spark):
    a = [rec(0, 1, 1, (0.0, 0.0), (5.0, 0.0)), rec(1, 1, 2, (9.0, 0.0), (6.0, 0.0))]
    b = [rec(10, 1, 1, (0.0, 0.0), (5.0, 0.0)), rec(11, 1, 2, (9.0, 0.0), (6.0, 0.0))]
    pairs, _ = both(spark, a, b)
    assert pairs == [(0, 10, "source_receiver_xy"), (1, 11, "source_receiver_xy")]


def test_rivals_for_one_b(spark):
    # A0 takes B10 by number, so A1, which only finds B10 by place, is ambiguous with it
    a = [rec(0, 1, 1), rec(1, 0, 0, (3.0, 3.0), (4.0, 4.0))]
    b = [rec(10, 1, 1, (3.0, 3.0), (4.0, 4.0))]
    a[0] = rec(0, 1, 1, (3.0, 3.0), None)
    a, b = [rec(0, 7, 8, None, None, 5, 1.0), rec(1, 0, 0, None, None, 6, 2.0)], [rec(10, 7, 8, None, None, 6, 2.0)]
    assert both(spark, a, b) == model(a, b)
    assert ("b", 10, "matched") in both(spark, a, b)[1] and ("b", 10, "ambiguous") in both(spark, a, b)[1]


def test_keyless_files_pair_in_order(spark):
    a, b = [rec(i) for i in range(3)], [rec(10 + i) for i in range(3)]
    assert both(spark, a, b)[0] == [(0, 10, "physical_trace_order"), (1, 11, "physical_trace_order"), (2, 12, "physical_trace_order")]
    pairs, classes = both(spark, a, b[:2])
    assert pairs == [] and {c for _, _, c in classes} == {"invalid"}


def test_empty(spark):
    assert both(spark, [], []) == ([], [])
    assert both(spark, [rec(1, 1, 1)], [])[1] == [("a", 1, "a_only")]


def test_acceptance_counts(spark):
    """60 traces on either side with a doubled header, an empty one and a trace of new keys."""
    a = [rec(s * 12 + r, 1000 + s, 2000 + r, (s * 50.0, 0.0), (r * 20.0, s * 1.0), 3000 + (s + r) % 9, (r - 5) * 20.0) for s in range(5) for r in range(12)]
    a = [(*x[:5], x[2] * 1.0, 0.0, *x[7:]) for x in a]
    b = [(100 + x[0], *x[1:]) for x in a]
    a[1], b[1] = (1, *a[0][1:]), (101, *b[0][1:])
    a[2], b[2] = rec(2, valid=False), rec(102, valid=False)
    b[3] = (103, 9000, 9001, 1.5, 1.5, 2.5, 2.5, True, True, 1, True, 7.0, True, True, None, 9, "x")
    n = {}
    for side, _, c in both(spark, a, b)[1]:
        n[c, side] = n.get((c, side), 0) + 1
    assert n == {("matched", "a"): 56, ("matched", "b"): 56, ("a_only", "a"): 1, ("b_only", "b"): 1, ("ambiguous", "a"): 2, ("ambiguous", "b"): 2, ("invalid", "a"): 1, ("invalid", "b"): 1}


def test_a_long_chain_of_rivals(spark, monkeypatch):
    n = 10_000
    rows = [(i, 0, i - 1 if i % 3 else i) for i in range(1, n)] + [(i, 1, i + 1) for i in range(1, n)] + [(i, 2, i) for i in range(1, n, 2)]
    taken, want = set(), []
    for a, rank, b in sorted(rows):
        if (not want or want[-1][0] != a) and b not in taken:
            taken.add(b)
            want.append((a, b, rank))
    df = spark.createDataFrame(rows, "a bigint, rank int, b bigint")
    assert sorted(tuple(r) for r in match._serial(df).select("a", "b", "rank").collect()) == want
    monkeypatch.setattr(match, "SERIAL_ROWS", 3_000)
    assert sorted(tuple(r) for r in match._serial(df).select("a", "b", "rank").collect()) == want


def test_report_of_nothing_and_of_all_classes(spark, tmp_path):
    df = lambda x: spark.createDataFrame(x, SCHEMA).withColumn("trace_number", F.col("ord"))
    empty = match.report(*match.match(df([]), df([])), df([]), df([])).collect()
    assert [(r["classification"], r["strategy"], r["matched"], r["schema_version"]) for r in empty] == [("summary", "invalid", 0, "1.1")]
    a = [rec(0, 1, 1), rec(1, 2, 2), rec(2, 3, 3), rec(3, 3, 3), rec(4, valid=False)]
    b = [rec(0, 1, 1), rec(10, 8, 8), rec(11, 3, 3), rec(12, valid=False)]
    r = match.report(*match.match(df(a), df(b)), df(a), df(b), a_path="a.sgy")
    assert r.columns == match.REPORT_COLUMNS and len(r.columns) == 65
    assert sorted(x["classification"] for x in r.collect()) == ["a_only", "ambiguous_a", "ambiguous_a", "ambiguous_b", "b_only", "invalid_a", "invalid_b", "matched"]
    match.write_report_json(r, str(tmp_path / "r"))
    said = spark.read.json(str(tmp_path / "r" / "rows")).where("classification = 'matched'").collect()[0]
    assert (said["a_trace"], said["b_trace"]) == (0, 0) and spark.read.json(str(tmp_path / "r" / "summary.json")).collect()[0]["a_path"] == "a.sgy"
    with pytest.raises(ValueError):
        match.report(*match.match(df(a), df(b)), df(a), df(b), colour="x")
