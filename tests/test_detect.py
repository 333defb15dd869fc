import random

import pytest
from test_segy import make

from lithoframe.operators import detect, documents, identity


def cube(il_byte, xl_byte, il=8, xl=10):
    def change(t):
        i, x = divmod(t, xl)
        words = {189: (4, 0), 193: (4, 0), 21: (4, 0), 9: (4, t), 13: (4, 0), 181: (4, 500_000 + 25 * x), 185: (4, 6_000_000 + 25 * i), 73: (4, 0), 77: (4, 0), 81: (4, 0), 85: (4, 0), 37: (4, 0)}
        return words | {il_byte: (4, 100 + 2 * i), xl_byte: (4, 200 + 3 * x)}

    return il * xl, change


@pytest.mark.parametrize("bytes_", [(189, 193), (101, 137)])
@pytest.mark.parametrize("little", [False, True])
def test_grid_words_are_found(spark, tmp_path, bytes_, little):
    n, change = cube(*bytes_)
    path = str(tmp_path / "a.sgy")
    make(path, traces=n, change=change, little=little)
    found = detect.detect_bytes(*detect.sampled_headers(path))
    assert {found.pairs[0].inline_byte, found.pairs[0].crossline_byte} == set(bytes_)
    if bytes_ == (189, 193):
        assert (found.pairs[0].inline_byte, found.pairs[0].crossline_byte) == bytes_ and detect.route(spark, path)[0] == "regular_3d"


@pytest.mark.parametrize("bend, kind", [(lambda i: i * i, "crooked_line"), (lambda i: 10 * i, "line_2d")])
def test_lines(spark, tmp_path, bend, kind):
    r = random.Random(1)
    path = str(tmp_path / "l.sgy")
    make(path, traces=64, change=lambda t: {9: (4, r.randrange(1 << 20)), 13: (4, r.randrange(1 << 20)), 21: (4, 1000 + t), 37: (4, 0), 71: (2, 1), 73: (4, 0), 77: (4, 0), 81: (4, 0), 85: (4, 0), 181: (4, 100 * (t + 1)), 185: (4, bend(t)), 189: (4, 0), 193: (4, 0)})
    assert detect.route(spark, path)[0] == kind


def test_windows():
    assert detect.sample_windows(100) == [(0, 100)] and detect.sample_windows(0) == []
    w = detect.sample_windows(100_000, 600)
    assert len(w) == 6 and w[0][0] == 0 and w[-1][1] == 100_000 and all(b - a == 100 for a, b in w)
    with pytest.raises(ValueError):
        detect.detect_bytes(*[__import__("numpy").zeros(s, "uint8" if len(s) == 2 else int) for s in ((5, 240), (5,), (5,))])


def test_cached_records(spark, tmp_path):
    path, cache = str(tmp_path / "a.sgy"), str(tmp_path / "cache")
    make(path)
    first = identity.cached_records(spark, path, cache)
    assert first.count() == 8 and identity.cached_records(spark, path, cache).count() == 8
    key = identity.metadata_identity(path)
    with open(path, "r+b") as f:
        f.seek(3600 + 8)
        f.write(b"\0\0\1\0")
    assert identity.metadata_identity(path) != key and identity.metadata_identity(path, {"inline": 9}) != identity.metadata_identity(path)
    assert len(identity.file_sha256(path)) == 64


def test_documents(tmp_path):
    path = str(tmp_path / "plan.json")
    plan = documents.Plan()
    for n in ("a", "b", "c"):
        plan.add(documents.Job(n, "s.json", "r.csv"))
    plan.move("c", 0)
    documents.save(plan, path)
    assert documents.load(documents.Plan, path) == plan and [j.name for j in plan.jobs] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        plan.add(documents.Job("A", "", ""))
    (tmp_path / "bad.json").write_text('{"jobs": [], "more": 1}')
    with pytest.raises(ValueError, match="more"):
        documents.load(documents.Plan, str(tmp_path / "bad.json"))

    def work(job):
        if job.name == "a":
            raise RuntimeError("no source")

    report = documents.run(plan, work)
    assert [(r["job"], r["state"]) for r in report] == [("a", "failed"), ("c", "completed")] and plan.jobs[2].state == "pending"
    p = documents.Profiles()
    p.upsert(documents.Profile("x", {"cdp": 21}))
    p.upsert(documents.Profile("X", {"cdp": 25}))
    assert len(p.profiles) == 1 and p.find("x").mapping == {"cdp": 25} and p.find("y") is None
    session = documents.Session("a.sgy", {"cdp": 21}, documents.Selection("shot", [1.0]))
    documents.save(session, path)
    assert documents.load(documents.Session, path) == session


def test_regular_grids_and_others(spark, tmp_path):
    from test_segy import make, read

    from lithoframe.operators.grid import grid_index

    def file(name, place, traces=60):
        make(tmp_path / name, traces=traces, ns=600, change=lambda t: dict(zip((189, 193), ((4, v) for v in place(t)))))
        return str(tmp_path / name)

    layouts = {
        "rows": lambda t: (10 + t // 12 * 2, 100 + t % 12), "columns": lambda t: (50 - t % 12, 7 + t // 12), "snake": lambda t: (10 + t // 12, 100 + (t % 12 if t // 12 % 2 == 0 else 11 - t % 12)),
    }
    for name, place in layouts.items():
        path = file(f"{name}.sgy", place)
        grid = detect.regular_grid(path)
        assert grid and grid.headers_read <= 60 and [grid.at(t) for t in range(60)] == [place(t) for t in range(60)], name
        assert sorted(map(tuple, detect.regular_index(spark, grid).collect())) == sorted(map(tuple, grid_index(read(spark, path, "records")).collect())), name
    for k, place in enumerate((lambda t: (10 + t // 12, 100 + t % 12 + (t == 31)), lambda t: (0, 0), lambda t: (1, 1), lambda t: (1, t), lambda t: (t, t), lambda t: (10 + t // 11, 100 + t % 11))):
        assert detect.regular_grid(file(f"odd{k}.sgy", place)) is None, k


def test_runs_that_go_on_and_figures(tmp_path):
    plan = documents.Plan([documents.Job(n, "s", "r") for n in "abcd"])
    seen = []

    def work(job):
        seen.append(job.name)
        if job.name == "a":
            raise ValueError("no")
        return "partial" if job.name == "b" else None

    report = documents.run(plan, work, go_on=True, cancelled=lambda: len(seen) >= 3)
    assert [j.state for j in plan.jobs] == ["failed", "partial", "completed", "cancelled"] and [r["job"] for r in report] == ["c", "b", "a"]
    plan.update("b", documents.Job("B2", "s", "r"))
    assert [j.name for j in plan.jobs] == ["a", "B2", "c", "d"]
    with pytest.raises(ValueError):
        plan.update("c", documents.Job("D", "s", "r"))
    figure = documents.Figure("fig", {"a.sgy": "00"}, {"gain": 2.0}, "ff")
    path = documents.publish_figure(figure, b"png", str(tmp_path))
    assert documents.load(documents.Figure, f"{path}/figure.json") == figure
    for bad in ("fig", "../x", ""):
        with pytest.raises((ValueError, FileExistsError)):
            documents.publish_figure(documents.Figure(bad), b"", str(tmp_path))
