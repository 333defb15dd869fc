import json
import os

import pytest

from lithoframe.operators import clip
from lithoframe.sources import batch
from lithoframe.sources.segy import open_layout
from test_segy import make, read


def some(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "trace_number bigint")


def line(spark, tmp_path, name, *numbers, **options):
    path = tmp_path / f"{name}.sgy"
    make(path)
    return batch.Line(name, str(path), f"{name}.sgy", some(spark, *numbers), **options).planned()


def test_one_failure_leaves_the_others(spark, tmp_path):
    nav = tmp_path / "survey.dat"
    nav.write_text("A 1 2 3 4 5 6")
    good = line(spark, tmp_path, "good", 6, 1, 2, first=2, last=7)
    gone = batch.Line("gone", str(tmp_path / "missing.sgy"), "gone.sgy", some(spark, 0))
    seen = []
    r = batch.export_batch(spark, [gone, good], str(tmp_path / "out"), str(nav), progress=lambda *x: seen.append(x[2]))
    assert (r.status, r.completed, r.failed) == ("partial", 1, 1) and [o.status for o in r.lines] == ["failed", "completed"]
    at = open_layout(r.lines[1].output)
    assert (at.traces, at.count, at.interval_us, at.code) == (3, 6, 2000, 5) and seen == sorted(seen) and seen[-1] == 100
    assert [x["trace_in_field"] for x in read(spark, r.lines[1].output, "records").orderBy("trace_number").collect()] == [11, 12, 12]
    said = json.loads((tmp_path / "out" / batch.MANIFEST).read_text())
    assert said["status"] == "partial" and said["navigation"]["sha256"] and len(said["lines"]) == 2
    assert (tmp_path / "out" / "survey.dat").read_bytes() == nav.read_bytes()


def test_cancelling_keeps_what_is_done(spark, tmp_path):
    lines = [line(spark, tmp_path, n, 0, 1) for n in ("first", "second", "third")]
    state = {"done": 0}

    def progress(status, k, percent):
        state["done"] = k

    r = batch.export_batch(spark, lines, str(tmp_path / "out"), cancelled=lambda: state["done"] >= 1, progress=progress)
    assert r.status == "cancelled" and [o.status for o in r.lines] == ["completed", "cancelled", "not_started"]
    assert os.path.exists(r.lines[0].output) and not os.path.exists(r.lines[1].output)
    assert json.loads((tmp_path / "out" / batch.MANIFEST).read_text())["status"] == "cancelled"


def test_bad_plans(spark, tmp_path):
    one = line(spark, tmp_path, "one", 0, 1)
    for name in ("..\\x.sgy", "../x.sgy", "C:\\x.sgy", batch.MANIFEST, "CON.sgy", "com1.sgy", "x.sgy ", "", "..", "a\tb"):
        with pytest.raises(ValueError):
            batch.export_batch(spark, [batch.Line("one", one.source, name, one.traces)], str(tmp_path / "out"))
    with pytest.raises(ValueError, match="duplicated"):
        batch.check_plan([one, batch.Line("two", str(tmp_path / "other.sgy"), "ONE.sgy", one.traces)])
    with pytest.raises(ValueError, match="duplicated"):
        batch.check_plan([one, batch.Line("two", one.source, "two.sgy", one.traces)])
    with pytest.raises(ValueError, match="reserved"):
        batch.check_plan([one], str(tmp_path / "one.sgy"))
    for bad in ((0, 0), (-1,), (8,), ()):
        with pytest.raises(ValueError):
            batch.check_plan([batch.Line("one", one.source, "one.sgy", some(spark, *bad), layout=one.layout)])
    with pytest.raises(ValueError):
        batch.check_plan([])


def test_navigation_failure_and_changed_source(spark, tmp_path):
    one = line(spark, tmp_path, "one", 0, 1)
    r = batch.export_batch(spark, [one], str(tmp_path / "a"), str(tmp_path / "missing.dat"))
    assert r.status == "partial" and r.completed == 1 and r.navigation["status"] == "failed"
    with open(one.source, "ab") as f:
        f.write(b"x")
    r = batch.export_batch(spark, [one], str(tmp_path / "b"))
    assert r.status == "failed" and "changed" in r.lines[0].error and not os.path.exists(r.lines[0].output)


def test_sections_and_boxes(spark, tmp_path):
    a, b, out = (tmp_path / n for n in ("a.sgy", "b.sgy", "out.sgy"))
    values = make(a, traces=12, change=lambda t: {189: (4, 1 + t // 4), 193: (4, 5 + t % 4)})
    make(b, traces=8, extended=1, change=lambda t: {189: (4, 1 + t // 4), 193: (4, 5 + t % 4)})
    assert batch.export_line(spark, str(a), "xl", 6.2, str(out)) == 3
    assert [r["samples"] for r in read(spark, out, "samples").orderBy("trace_number").collect()] == values[[1, 5, 9]].tolist()
    assert batch.export_line(spark, str(a), "il", 2, str(out), minus=str(b), first=3, last=5) == 4
    assert {v for r in read(spark, out, "samples").collect() for v in r["samples"]} == {0.0} and open_layout(str(out)).count == 3
    assert batch.export_box(spark, str(b), (2, 1), (8, 6), str(out)) == 6
    assert open_layout(str(out)).extended == 1 and read(spark, out, "text_headers").count() == 80
    assert batch.export_box(spark, str(a), (2, 3), (5, 6), str(out), minus=str(b)) == 2
    with pytest.raises(ValueError):
        batch.export_box(spark, str(a), (90, 91), (5, 6), str(out))


def test_names_are_safe_and_once(spark):
    names = ["A.sgy", "a.sgy", "a_2.sgy", "b?.sgy", "b*.sgy", "CON", "con.sgy", "x", None, "x", "manifest.json", ". ", "line."]
    got = {r["name"]: r["output"] for r in clip.safe_names(spark.createDataFrame([(n,) for n in names], "p string"), "p", ("MANIFEST.json",)).collect()}
    assert set(got) == set(names) - {None} and len({v.lower() for v in got.values()}) == len(got)
    assert got["a_2.sgy"] == "a_2.sgy" and got["x"] == "x" and got["manifest.json"] != "manifest.json" and got["A.sgy"].endswith(".sgy") and got["A.sgy"].lower() != "a.sgy"
    assert all(batch.safe_name(v) for v in got.values()), got
