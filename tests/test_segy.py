import os

import numpy as np
import pytest

from lithoframe.sources import sink
from lithoframe.sources.segy import open_layout, register, segy_paths
from lithoframe.sources.words import SAMPLE_BYTES, decode_samples, decode_text, encode_samples, float_to_ibm, ibm_to_float, text_encoding


def make(path, traces=8, ns=16, code=5, little=False, dt=2000, extended=0, text="ascii", change=None):
    order = "little" if little else "big"
    card = "".join(f"C{i:2d} LINE TEST".ljust(80) for i in range(1, 41))
    head = bytearray(card.encode("cp037" if text == "ebcdic" else "ascii"))
    head += bytes(400)
    put = lambda raw, byte, width, v: raw.__setitem__(slice(byte - 1, byte - 1 + width), int(v).to_bytes(width, order, signed=v < 0))
    for byte, v in ((3217, dt), (3221, ns), (3225, code), (3505, extended)):
        put(head, byte, 2, v)
    values = np.array([[t * 3 + s for s in range(ns)] for t in range(traces)], float)
    with open(path, "wb") as f:
        f.write(head + bytes(head[:3200]) * extended)
        for t in range(traces):
            h = bytearray(240)
            words = {9: (4, 100 + t // 4), 13: (4, 10 + t % 4), 21: (4, 200 + t // 2), 37: (4, (t % 4 - 1) * 100), 71: (2, -10), 73: (4, 10_000 + 800 * (t // 4)), 77: (4, 20_000), 81: (4, 10_100), 85: (4, 20_000 + 50 * t), 89: (2, 1), 109: (2, 4), 115: (2, ns), 117: (2, dt), 189: (4, 1 + t // 4), 193: (4, 1 + t // 2)}
            if change:
                words |= change(t)
            for byte, (width, v) in words.items():
                put(h, byte, width, v)
            f.write(bytes(h) + encode_samples(values[t], code, little))
    return values


def read(spark, path, view, **options):
    register(spark)
    r = spark.read.format("segy").option("view", view)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(str(path))


@pytest.mark.parametrize("code", [c for c in SAMPLE_BYTES if c != 4])
@pytest.mark.parametrize("little", [False, True])
def test_formats(code, little):
    v = np.array([0.0, 1.0, 5.0, 100.0, 127.0])
    assert decode_samples(encode_samples(v, code, little), code, little).tolist() == v.tolist()


def test_ibm():
    assert ibm_to_float(np.array([0xC276A000], np.uint32))[0] == -118.625
    v = np.array([1.0, -118.625, 0.15625, 1e10, 0.0])
    assert np.allclose(ibm_to_float(float_to_ibm(v)), v, rtol=1e-6)
    assert np.isnan(decode_samples(bytes(8), 4, False)).all()


@pytest.mark.parametrize("code, little", [(5, False), (1, False), (3, True), (7, False)])
def test_views(spark, tmp_path, code, little):
    path = tmp_path / "a.sgy"
    values = make(path, code=code, little=little)
    got = read(spark, path, "samples", partition_traces=3).orderBy("trace_number").collect()
    assert [r["samples"] for r in got] == values.tolist()
    window = read(spark, path, "samples", sample_start=2, sample_end=4, trace_start=5, trace_end=7).orderBy("trace_number").collect()
    assert [r["samples"] for r in window] == values[5:7, 2:5].tolist()
    rec = read(spark, path, "records").orderBy("trace_number").collect()
    assert [r["source_id"] for r in rec] == [100] * 4 + [101] * 4 and rec[5]["source_x"] == 1080.0 and rec[3]["receiver_y"] == 2015.0 and rec[0]["header_offset"] == -100.0
    words = {r["name"]: r["value"] for r in read(spark, path, "trace_headers").where("trace_number = 6").collect()}
    assert words["inline"] == 2 and words["crossline"] == 4 and words["delay_ms"] == 4
    assert {r["name"]: r["value"] for r in read(spark, path, "binary_header").collect()}["format_code"] == code
    f = read(spark, path, "files").collect()[0]
    assert (f["trace_count"], f["little_endian"], f["trailing_bytes"]) == (8, little, 0)


def test_text_and_extended_headers(spark, tmp_path):
    path = tmp_path / "a.sgy"
    make(path, extended=2, text="ebcdic")
    lines = read(spark, path, "text_headers").orderBy("header_index", "line_no").collect()
    assert len(lines) == 120 and lines[0]["text"].rstrip() == "C 1 LINE TEST" and lines[0]["encoding"] == "ebcdic-cp037" and lines[-1]["extended"]
    assert text_encoding(bytes(3200)) == "ascii"


def test_invalid_headers_and_mapping(spark, tmp_path):
    path = tmp_path / "a.sgy"
    make(path, change=lambda t: {115: (2, 0)} if t == 2 else {117: (2, 0)} if t == 3 else {})
    rec = read(spark, path, "records", mapping="receiver_id=193,inline=0").orderBy("trace_number").collect()
    assert rec[2]["header_error"] == "sample count is zero" and rec[2]["sample_count"] == 16 and rec[2]["header_sample_count"] == 0
    assert rec[3]["header_error"] == "sample interval is zero" and rec[0]["header_valid"]
    assert rec[7]["receiver_id"] == 4 and rec[7]["inline"] == 0


def test_folder_keeps_broken_files(spark, tmp_path):
    for n in ("b10.sgy", "b9.SEGY"):
        make(tmp_path / n)
    (tmp_path / "bad.sgy").write_bytes(b"x" * 5000)
    (tmp_path / "note.txt").write_text("no")
    assert [os.path.basename(p) for p in segy_paths(str(tmp_path))] == ["b9.SEGY", "b10.sgy", "bad.sgy"]
    got = {os.path.basename(r["path"]): r["error"] for r in read(spark, tmp_path, "files").collect()}
    assert got["b9.SEGY"] is None and "no plausible" in got["bad.sgy"]


def test_trailing_bytes(tmp_path):
    path = tmp_path / "a.sgy"
    make(path)
    with open(path, "ab") as f:
        f.write(b"rest")
    assert open_layout(str(path)).traces == 8
    with pytest.raises(ValueError):
        open_layout(__file__ if os.path.getsize(__file__) < 3600 else os.devnull)


@pytest.mark.parametrize("code, little", [(1, False), (5, True), (7, False)])
def test_export_keeps_bytes(spark, tmp_path, code, little):
    path, out = tmp_path / "a.sgy", tmp_path / "out.sgy"
    values = make(path, code=code, little=little)
    picked = spark.createDataFrame([(6, 0), (1, 1), (6, 2)], "trace_number bigint, output_order bigint")
    assert sink.export_section(spark, str(path), picked, str(out), 3, 7) == 3
    got = read(spark, out, "samples").orderBy("trace_number").collect()
    assert [r["samples"] for r in got] == values[[6, 1, 6], 3:8].tolist()
    width = SAMPLE_BYTES[code]
    src, dst = path.read_bytes(), out.read_bytes()
    a = 3600 + 6 * (240 + 16 * width) + 240 + 3 * width
    assert dst[3600 + 240 : 3600 + 240 + 5 * width] == src[a : a + 5 * width]
    rec = read(spark, out, "records").orderBy("trace_number").collect()
    assert rec[0]["delay_ms"] == 10 and rec[0]["header_sample_count"] == 5 and rec[1]["source_id"] == 100
    assert not [p for p in os.listdir(tmp_path) if p.endswith(".part")]
    with pytest.raises(ValueError):
        sink.export_section(spark, str(path), picked, str(path))


def test_export_difference(spark, tmp_path):
    a, b, out = (tmp_path / n for n in ("a.sgy", "b.sgy", "d.sgy"))
    va, vb = make(a, ns=16), make(b, ns=12, code=1)
    pairs = spark.createDataFrame([(2, 5, 0), (3, 1, 1)], "a_trace bigint, b_trace bigint, output_order bigint")
    assert sink.export_difference(spark, str(a), str(b), pairs, str(out)) == 2
    got = read(spark, out, "samples").orderBy("trace_number").collect()
    assert [r["samples"] for r in got] == [(va[2, :12] - vb[5, :12]).tolist(), (va[3, :12] - vb[1, :12]).tolist()]


def test_gather_list(spark, data, tmp_path):
    from lithoframe.operators.gathers import ordered_gather
    from lithoframe.plans.views import records

    g = sink.gather_list(ordered_gather(records(spark, data).where("source_id <> 0"), ["source_id"], "offset"))
    assert g.columns == sink.GATHER_COLUMNS and g.agg({"position": "min"}).collect()[0][0] == 1
    sink.write_report(g, str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g")).count() == g.count()


def patched(path, *words, order="big"):
    raw = bytearray(path.read_bytes())
    for byte, width, v in words:
        raw[byte - 1 : byte - 1 + width] = (v & ((1 << 8 * width) - 1)).to_bytes(width, order)
    path.write_bytes(bytes(raw))


def test_typed_headers_and_warnings(spark, tmp_path):
    path = tmp_path / "a.sgy"
    own = {1: (4, 101), 41: (4, 1250), 45: (4, -500), 49: (4, 200), 69: (2, -10), 71: (2, 10), 73: (4, 100), 89: (2, 7), 115: (2, 15), 117: (2, 4000), 181: (4, 500), 197: (4, 1234), 201: (2, -10)}
    make(path, change=lambda t: own if t == 1 else {})
    patched(path, (3205, 4, -77), (3501, 2, 0x0100))
    reel = read(spark, path, "reel").collect()[0]
    assert reel["line_number"] == -77 and (reel["revision_major"], reel["revision_minor"]) == (1, 0) and len(reel["raw"]) == 400
    assert len(reel["warnings"]) == 1 and "fixed" in reel["warnings"][0]
    patched(path, (3503, 2, 1), (3507, 4, 2))
    assert ["additional" in w for w in read(spark, path, "reel").collect()[0]["warnings"]] == [True]
    t = {r["trace_number"]: r for r in read(spark, path, "traces").collect()}
    one = t[1]
    assert (one["trace_in_line"], one["receiver_elevation"], one["surface_elevation"], one["source_depth"], one["source_x"], one["cdp_x"]) == (101, 125.0, -50.0, 20.0, 1000.0, 5000.0)
    assert abs(one["shotpoint_number"] - 123.4) < 1e-9 and len(one["raw"]) == 240 and t[0]["warnings"] == []
    assert [w.split()[0] for w in one["warnings"]] == ["15", "interval", "unknown"]
    from lithoframe.operators.display import interpreted

    words = {(r["trace_number"], r["name"]): r for r in interpreted(read(spark, path, "trace_headers")).collect()}
    assert words[1, "receiver_elevation"]["scaled"] == 125.0 and words[0, "source_x"]["shown_unit"] == "length" and words[1, "coordinate_units"]["meaning"] == "unknown"
    named = {r["name"]: r for r in interpreted(read(spark, path, "binary_header")).collect()}
    assert named["revision"]["meaning"] == "1.0" and named["format_code"]["meaning"] == "IEEE float32" and named["sample_interval_us"]["shown_unit"] == "us"


def test_text_headers_are_decoded_as_told():
    card = "".join(f"C {i:2d} EBCDIC".ljust(80) for i in range(40))
    raw = card.encode("cp037")
    assert text_encoding(raw) == "ebcdic-cp037" and decode_text(raw) == decode_text(raw, "ebcdic-cp037") and "".join(decode_text(raw)) == card
    assert decode_text(raw, "ascii")[0].startswith("Ã@@ð@") and decode_text(b"\x81" * 3200, "ascii")[0] == "�" * 80 and decode_text(b"\0\r\n\t" * 800, "ascii") == [" " * 80] * 40
    for bad in ((raw[:-1], None), (raw, "utf-8")):
        with pytest.raises(ValueError):
            decode_text(*bad)


def test_layouts_that_cannot_be(spark, tmp_path):
    path = tmp_path / "a.sgy"
    make(path, traces=2)
    patched(path, (3505, 2, 20_000))
    assert open_layout(str(path)).data_start == 3600 and open_layout(str(path)).traces == 2
    with pytest.raises(Exception, match="exceed"):
        read(spark, path, "text_headers").collect()
    patched(path, (3505, 2, 500))
    with pytest.raises(ValueError, match="would start"):
        open_layout(str(path))
    patched(path, (3505, 2, -1))
    assert open_layout(str(path)).extended == 0 and any("end marks" in w for w in read(spark, path, "reel").collect()[0]["warnings"])
    patched(path, (3505, 2, 0), (3221, 2, 60_000))
    with pytest.raises(ValueError, match="no whole trace"):
        open_layout(str(path))
