"""Queries that write SEG-Y files of the test tables' records and read them back through the data source.

The files lie in the shared folder and are written once for a session and a data directory. The SQL
tells the same values from the tables alone, byte patterns included.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from lithoframe.operators import detect, identity
from lithoframe.operators.ordering import numbered
from lithoframe.operators.records import derive_geometry
from lithoframe.plans.views import REC, records
from lithoframe.runtime import local_folder
from lithoframe.sources import batch, sink
from lithoframe.sources.segy import open_layout, register

QUERIES, SQL = {}, {}
SAMPLES, DT_US = 12, 2000
#: Every format that can be decoded, each in one byte order.
FORMATS = {1: False, 2: True, 3: False, 5: False, 6: True, 7: False, 8: True, 9: False, 10: True, 11: False, 12: True, 15: False, 16: False}
_WRITTEN: dict[tuple, str] = {}

#: Opens a SQL oracle over the records, numbered from 0 as the file has them.
NUM = REC + ", num AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS n FROM rec), smp AS (SELECT n, s, (n * 7 + s * 5) % 101 AS v FROM num, generate_series(0, 11) g(s))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _path(spark, sf: str, name: str) -> str:
    key = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf}".encode()).hexdigest()[:16]
    folder = os.path.join(local_folder(spark), f"segy-{key}")
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, name)


def _once(spark, sf: str, name: str, write) -> str:
    """The path of a file, written by write(path) unless this session has it already."""
    path = _path(spark, sf, name)
    if (spark.sparkContext.applicationId, path) not in _WRITTEN or not os.path.exists(path):
        write(path)
        _WRITTEN[spark.sparkContext.applicationId, path] = path
    return path


def _rows(spark, sf):
    """Records as header words with samples: positions in hundredths (scalar -100), what is missing as 0."""
    rec = numbered(records(spark, sf), ["record_id"], "output_order")
    cents = lambda c, has: F.when(F.col(has) & F.col(c).isNotNull() & ~F.isnan(c), F.round(F.col(c) * 100)).cast("bigint").alias(c)
    samples = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda s: ((F.col("output_order") * 7 + s * 5) % 101).cast("double")).alias("samples")
    grid = [(F.floor(F.col("output_order") / 50) + 1).alias("inline"), (F.col("output_order") % 50 + 1).alias("crossline")]
    return rec.select("output_order", samples, "source_id", F.col("receiver_id").alias("trace_in_field"), F.when(F.col("has_cdp"), F.col("cdp")).alias("cdp"), *(cents(f"{e}_{k}", f"has_{e}") for e in ("source", "receiver") for k in "xy"), F.lit(-100).alias("coordinate_scalar"), F.lit(1).alias("coordinate_units"), (F.col("output_order") % 300 - 150).alias("header_offset"), F.lit(4).alias("delay_ms"), *grid)


def _cards(word: str, encoding: str) -> bytes:
    return "".join(f"C{n:2d} {word}".ljust(80) for n in range(1, 41)).encode(encoding)


def _file(spark, sf, code: int = 5, little: bool = False) -> str:
    return _once(spark, sf, f"code{code}.sgy", lambda p: sink.write_traces(_rows(spark, sf), p, DT_US, SAMPLES, code, little, _cards("FIRST", "ascii")))


def _little(spark, sf) -> str:
    """Little endian, EBCDIC, with an extended header, an open fixed-length flag and three stray bytes at the end."""

    def write(path: str) -> None:
        sink.write_traces(_rows(spark, sf), path, DT_US, SAMPLES, 3, True, _cards("EBCDIC", "cp037"), (_cards("MORE", "ascii"),), {"revision": 0x0102, "fixed_length": 0, "max_additional_headers": 4_000_000_000, "ensemble_fold": 40_000, "trace_sorting": -1, "measurement_system": 2, "job_id": -7})
        with open(path, "ab") as f:
            f.write(b"end")

    return _once(spark, sf, "little.sgy", write)


def _pattern(spark, sf) -> str:
    """Headers of a byte pattern with high bits set: byte k of trace n is 255 - (7 n + 3 k) mod 23."""

    def write(path: str) -> None:
        n = records(spark, sf).count()
        with open(_file(spark, sf), "rb") as f:
            head = f.read(3600)
        with open(path, "wb") as f:
            f.write(head)
            for t in range(n):  # a small file, of headers only but for one stretch of samples each
                f.write(bytes(255 - (7 * t + 3 * k) % 23 for k in range(1, 241)) + bytes(4 * SAMPLES))

    return _once(spark, sf, "pattern.sgy", write)


def _view(spark, path: str, view: str, **options):
    register(spark)
    r = spark.read.format("segy").option("view", view)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


@query(
    REC + """, n AS (SELECT count(*) AS n FROM rec)
SELECT 'first' AS file, false AS little_endian, 2000 AS sample_interval_us, 12 AS sample_count, 5 AS format_code, 4 AS sample_bytes, 0 AS extended_headers, 3600 AS data_start, 288 AS trace_bytes, n AS trace_count, 0 AS trailing_bytes, 3600 + 288 * n AS size FROM n
UNION ALL SELECT 'little', true, 2000, 12, 3, 2, 1, 6800, 264, n, 3, 6803 + 264 * n FROM n"""
)
def segy_layout(spark, sf):
    """What the reel headers of two files say of them."""
    both = [(_file(spark, sf), "first"), (_little(spark, sf), "little")]
    parts = [_view(spark, p, "files").select(F.lit(name).alias("file"), "little_endian", "sample_interval_us", "sample_count", "format_code", "sample_bytes", "extended_headers", "data_start", "trace_bytes", "trace_count", "trailing_bytes", "size") for p, name in both]
    return parts[0].unionByName(parts[1])


@query(
    """SELECT h AS header_index, h > 0 AS extended, CASE WHEN h = 0 THEN 'ebcdic-cp037' ELSE 'ascii' END AS encoding, CAST(n AS INTEGER) AS line_no,
rpad('C' || lpad(CAST(n AS VARCHAR), 2, ' ') || CASE WHEN h = 0 THEN ' EBCDIC' ELSE ' MORE' END, 80, ' ') AS text FROM (VALUES (0), (1)) x(h), generate_series(1, 40) g(n)"""
)
def segy_text(spark, sf):
    """Primary and extended text headers, each in the encoding found."""
    return _view(spark, _little(spark, sf), "text_headers").select("header_index", "extended", "encoding", "line_no", "text")


@query("SELECT h AS header_index, 'ascii' AS encoding, 3200 AS bytes, h = 1 AS readable, 3278 AS characters FROM (VALUES (0), (1)) x(h)")
def segy_text_chosen(spark, sf):
    """The same bytes decoded in a chosen encoding: readable only if it is theirs."""
    t = _view(spark, _little(spark, sf), "text_bytes", encoding="ascii")
    return t.select("header_index", "encoding", F.length("raw").alias("bytes"), F.col("text").startswith("C 1 MORE").alias("readable"), F.length("text").alias("characters"))


_REEL = {3201: -7, 3217: 2000, 3219: 2000, 3221: 12, 3223: 12, 3225: 3, 3227: 40000, 3229: -1, 3255: 2, 3501: 258, 3503: 0, 3505: 1, 3507: 4000000000}


@query(
    f"""WITH w AS (SELECT unnest([3201, 3205, 3209, 3213, 3215, 3217, 3219, 3221, 3223, 3225, 3227, 3229, 3231, 3233, 3235, 3237, 3239, 3241, 3243, 3245, 3247, 3249, 3251, 3253, 3255, 3257, 3259, 3501, 3503, 3505, 3507]) AS byte_start)
SELECT byte_start, CASE WHEN byte_start IN (3201, 3205, 3209, 3507) THEN 4 ELSE 2 END AS width, coalesce(v, 0) AS value FROM w LEFT JOIN (VALUES {", ".join(str(kv) for kv in _REEL.items())}) x(b, v) ON b = byte_start"""
)
def segy_binary_header(spark, sf):
    """Every word of a little-endian binary header."""
    return _view(spark, _little(spark, sf), "binary_header").select("byte_start", "width", "value")


@query("SELECT -7 AS job_id, 40000 AS ensemble_fold, -1 AS trace_sorting, 1 AS revision_major, 2 AS revision_minor, 4000000000 AS max_additional_headers, 400 AS bytes, 3 AS warnings")
def segy_reel(spark, sf):
    """A binary header as one row, with its warnings: no fixed length, additional headers, stray bytes."""
    return _view(spark, _little(spark, sf), "reel").select("job_id", "ensemble_fold", "trace_sorting", "revision_major", "revision_minor", "max_additional_headers", F.length("raw").alias("bytes"), F.size("warnings").alias("warnings"))


@query(
    REC + """, t AS (SELECT row_number() OVER () - 1 AS n FROM rec),
b4 AS (SELECT unnest([1, 5, 9, 13, 17, 21, 25, 37, 41, 45, 49, 53, 57, 61, 65, 73, 77, 81, 85, 181, 185, 189, 193, 197, 205, 219, 225]) AS b, 4 AS w),
b2 AS (SELECT unnest(list_concat([29, 31, 33, 35, 69, 71, 89, 201, 203, 209, 211, 213, 215, 217, 223, 229, 231], range(91, 181, 2))) AS b, 2 AS w),
v AS (SELECT n, b, w, list_sum(list_transform(range(b, b + w), lambda k: (255 - (7 * n + 3 * k) % 23) * CAST(pow(256, b + w - 1 - k) AS BIGINT))) AS u FROM t, (FROM b4 UNION ALL FROM b2))
SELECT n AS trace_number, b AS byte_start, w AS width, CAST(CASE WHEN b IN (31, 33, 91, 93, 95, 97, 115, 117, 127, 129, 131, 135, 137) OR b BETWEEN 141 AND 165 THEN u ELSE u - CAST(pow(256, w) AS BIGINT) END AS BIGINT) AS value FROM v"""
)
def segy_trace_headers(spark, sf):
    """Every word of every trace header, of bytes whose high bits are set."""
    return _view(spark, _pattern(spark, sf), "trace_headers").select("trace_number", "byte_start", "width", "value")


_CENTS = ", ".join(f"coalesce(round(CASE WHEN has_{e} AND NOT isnan({e}_{k}) THEN {e}_{k} END * 100) / 100, 0) AS {e}_{k}" for e in ("source", "receiver") for k in "xy")
_WORDS = f"n AS trace_number, source_id, coalesce(receiver_id, 0) AS receiver_id, CASE WHEN has_cdp THEN cdp ELSE 0 END AS cdp, CAST(n // 50 + 1 AS INTEGER) AS inline, CAST(n % 50 + 1 AS INTEGER) AS crossline, {_CENTS}, CAST(n % 300 - 150 AS DOUBLE) AS header_offset, 4 AS delay_ms"


def _rounded(df):
    return df.select("trace_number", "source_id", "receiver_id", "cdp", "inline", "crossline", *(F.round(f"{e}_{k}", 4).alias(f"{e}_{k}") for e in ("source", "receiver") for k in "xy"), "header_offset", "delay_ms")


@query(NUM + f" SELECT {_WORDS} FROM num")
def segy_records(spark, sf):
    """The prestack records of a file."""
    return _rounded(_view(spark, _file(spark, sf), "records"))


@query(NUM + f" SELECT {_WORDS}, 0 AS warnings FROM num")
def segy_typed_headers(spark, sf):
    """Trace headers as typed rows, under their scalars."""
    t = _view(spark, _file(spark, sf), "traces")
    return _rounded(t.withColumns({"receiver_id": F.col("trace_in_field"), "header_offset": F.col("header_offset").cast("double")}).select("*")).join(t.select("trace_number", F.size("warnings").alias("warnings")), "trace_number")


@query(NUM + ", g AS (SELECT n, source_id AS a, coalesce(receiver_id, 0) AS b FROM num) SELECT n AS trace_number, CAST(n // 50 + 1 AS INTEGER) AS receiver_id, 0 AS inline, a AS crossline FROM g")
def segy_mapping(spark, sf):
    """Records under another mapping: receiver from byte 189, no inline, crossline from byte 9."""
    return _view(spark, _file(spark, sf), "records", mapping="receiver_id=189,inline=0,crossline=9").select("trace_number", "receiver_id", "inline", "crossline")


@query(
    NUM + f""", w AS (SELECT {_WORDS} FROM num), k AS (SELECT *, receiver_x - source_x AS dx, receiver_y - source_y AS dy FROM w), d AS (SELECT *, sqrt(dx * dx + dy * dy) AS o FROM k)
SELECT trace_number, round(o, 4) AS computed_offset, round((source_x + receiver_x) / 2, 4) AS midpoint_x, header_offset AS trace_offset, o > 0 AS has_azimuth FROM d"""
)
def segy_geometry(spark, sf):
    """From a scanned file to derived records: offset between the ends, midpoint, the offset that holds, whether there is an azimuth."""
    mapped = {c: F.lit(True) for c in ("has_source", "has_receiver", "has_header_offset")}
    g = derive_geometry(_view(spark, _file(spark, sf), "records").withColumns(mapped))
    return g.select("trace_number", F.round("d_computed_offset", 4).alias("computed_offset"), F.round("d_midpoint_x", 4).alias("midpoint_x"), F.col("d_offset").alias("trace_offset"), F.col("d_azimuth").isNotNull().alias("has_azimuth"))


@query(NUM + f" SELECT code, n AS trace_number, count(*) AS samples, CAST(sum(v) AS DOUBLE) AS total, CAST(min_by(v, s) AS DOUBLE) AS first, CAST(max_by(v, s) AS DOUBLE) AS last, CAST(sum(v * s) AS DOUBLE) AS moment FROM smp, (SELECT unnest({list(FORMATS)}) AS code) GROUP BY 1, 2")
def segy_samples(spark, sf):
    """Samples of every trace in every format, some big and some little endian."""
    parts = []
    for code, little in FORMATS.items():
        s = _view(spark, _file(spark, sf, code, little), "samples")
        moment = F.aggregate(F.transform("samples", lambda v, i: v * i), F.lit(0.0), lambda x, y: x + y)
        parts.append(s.select(F.lit(code).alias("code"), "trace_number", F.size("samples").cast("bigint").alias("samples"), F.aggregate("samples", F.lit(0.0), lambda x, y: x + y).alias("total"), F.element_at("samples", 1).alias("first"), F.element_at("samples", -1).alias("last"), moment.alias("moment")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(NUM + " SELECT n AS trace_number, list(CAST(v AS DOUBLE) ORDER BY s)::VARCHAR AS samples FROM smp WHERE n BETWEEN 5 AND 499 AND s BETWEEN 3 AND 6 GROUP BY n")
def segy_window(spark, sf):
    """A range of traces, half open, with an inclusive sample window."""
    s = _view(spark, _file(spark, sf, 7), "samples", trace_start=5, trace_end=500, sample_start=3, sample_end=6)
    return s.select("trace_number", F.concat(F.lit("["), F.concat_ws(", ", F.transform("samples", lambda v: v.cast("string"))), F.lit("]")).alias("samples"))


@query(NUM + " SELECT n AS trace_number, 240 AS header_bytes, string_agg(printf('%04X', v), '' ORDER BY s) AS hex FROM smp GROUP BY n")
def segy_raw_bytes(spark, sf):
    """Headers and sample bytes as they are: int16, big endian."""
    return _view(spark, _file(spark, sf, 3), "raw").select("trace_number", F.length("header").alias("header_bytes"), F.hex("raw_samples").alias("hex"))


def _export_path(spark, sf, name: str) -> str:
    return _path(spark, sf, f"{name}-{uuid.uuid4().hex}.sgy")


@query(NUM + ", e AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS o FROM num WHERE source_id <> 0) SELECT o AS trace_number, any_value(source_id) AS source_id, 10 AS delay_ms, 5 AS samples, CAST(sum(v) AS DOUBLE) AS total FROM e JOIN num USING (n) JOIN smp USING (n) WHERE s BETWEEN 3 AND 7 GROUP BY o")
def segy_export(spark, sf):
    """A cropped export of the traces with a source number, in reverse, read back."""
    source = _file(spark, sf)
    picked = _view(spark, source, "records").where("source_id <> 0").select("trace_number", (-F.col("trace_number")).alias("o"))
    out = _export_path(spark, sf, "crop")
    sink.export_section(spark, source, sink.number_traces(picked, "o"), out, 3, 7)
    rec = _view(spark, out, "records").select("trace_number", "source_id", "delay_ms")
    return rec.join(_view(spark, out, "samples").select("trace_number", F.size("samples").alias("samples"), F.aggregate("samples", F.lit(0.0), lambda x, y: x + y).alias("total")), "trace_number")


@query(NUM + ", d AS (SELECT a.n, a.s, a.v - b.v AS d FROM smp a JOIN smp b ON b.n = a.n + 1 AND b.s = a.s) SELECT n AS trace_number, CAST(sum(d) AS DOUBLE) AS total, CAST(max(d) AS DOUBLE) AS top FROM d GROUP BY n")
def segy_difference(spark, sf):
    """Each trace minus the next one, from files in two formats and byte orders, written and read back."""
    a, b, out = _file(spark, sf), _little(spark, sf), _export_path(spark, sf, "difference")
    pairs = _view(spark, a, "records").where(F.col("trace_number") < open_layout(b).traces - 1).select(F.col("trace_number").alias("a_trace"), (F.col("trace_number") + 1).alias("b_trace"), F.col("trace_number").alias("output_order"))
    sink.export_difference(spark, a, b, pairs, out)
    return _view(spark, out, "samples").select("trace_number", F.aggregate("samples", F.lit(0.0), lambda x, y: x + y).alias("total"), F.array_max("samples").alias("top"))


@query(NUM + ", g AS (SELECT n, abs(n % 300 - 150) AS o FROM num WHERE source_id = (SELECT min(source_id) FROM num WHERE source_id <> 0)) SELECT row_number() OVER (ORDER BY o, n) - 1 AS trace_number, CAST(n % 300 - 150 AS DOUBLE) AS header_offset FROM g")
def segy_gather(spark, sf):
    """A shot gather by distance, whole, as a file of its own, read back."""
    source, out = _file(spark, sf), _export_path(spark, sf, "gather")
    rec = _view(spark, source, "records")
    first = rec.where("source_id <> 0").agg(F.min("source_id")).first()[0]
    g = rec.where(F.col("source_id") == first).select("trace_number", F.abs("header_offset").alias("o"))
    sink.export_section(spark, source, sink.number_traces(g, "o", "trace_number"), out)
    return _view(spark, out, "records").select("trace_number", "header_offset")


@query(NUM + ", c AS (SELECT n, n // 50 + 1 AS il, n % 50 + 1 AS xl FROM num) SELECT 'line' AS kind, n AS source_trace, xl - 1 AS trace_number FROM c WHERE il = 3 UNION ALL SELECT 'box', n, row_number() OVER (ORDER BY n) - 1 FROM c WHERE il BETWEEN 2 AND 9 AND xl BETWEEN 11 AND 17")
def segy_sections(spark, sf):
    """An inline and a box of the volume as files, told by what their headers say of the source."""
    source = _file(spark, sf)
    outs = {"line": _export_path(spark, sf, "line"), "box": _export_path(spark, sf, "box")}
    batch.export_line(spark, source, "il", 3.2, outs["line"])
    batch.export_box(spark, source, (9, 2), (11, 17), outs["box"], first=2, last=8)
    at = lambda k: _view(spark, outs[k], "records").select(F.lit(k).alias("kind"), ((F.col("inline") - 1) * 50 + F.col("crossline") - 1).cast("bigint").alias("source_trace"), "trace_number")
    return at("line").unionByName(at("box"))


@query(REC + ", n AS (SELECT count(*) AS n FROM rec) SELECT 'first' AS name, 'completed' AS status, n AS traces, 8 AS samples FROM n UNION ALL SELECT 'gone', 'failed', 0, 0 UNION ALL SELECT 'little', 'completed', n, 5 FROM n")
def segy_batch(spark, sf):
    """A batch of cropped lines of which one is missing, as its manifest tells."""
    import json

    a, b, folder = _file(spark, sf), _little(spark, sf), _path(spark, sf, f"batch-{uuid.uuid4().hex}")
    every = lambda p: _view(spark, p, "records").select("trace_number")
    lines = [batch.Line("first", a, "first.sgy", every(a), 1, 8).planned(), batch.Line("gone", a + ".missing", "gone.sgy", every(a)), batch.Line("little", b, "little.sgy", every(b), 0, 4).planned()]
    batch.export_batch(spark, lines, folder)
    with open(os.path.join(folder, batch.MANIFEST), encoding="utf-8") as f:
        said = json.load(f)
    return spark.createDataFrame([(o["name"], o["status"], o["traces"], o["samples"]) for o in said["lines"]], "name string, status string, traces bigint, samples int")


@query("SELECT 'regular_3d' AS kind, 189 AS inline_byte, 193 AS crossline_byte, false AS labels_guessed")
def segy_detection(spark, sf):
    """The kind of the file and where its headers keep inline and crossline."""
    kind, found = detect.route(spark, _file(spark, sf))
    best = found.pairs[0]
    return spark.createDataFrame([(kind, best.inline_byte, best.crossline_byte, best.labels_guessed)], "kind string, inline_byte int, crossline_byte int, labels_guessed boolean")


@query(REC + ", n AS (SELECT count(*) AS n FROM rec) SELECT true AS same, false AS under_other_mapping, false AS of_other_file, n AS cached FROM n")
def segy_identity(spark, sf):
    """Metadata identities of files and mappings, and the records kept under one."""
    a, b = _file(spark, sf), _little(spark, sf)
    one = identity.metadata_identity(a)
    kept = identity.cached_records(spark, a, _path(spark, sf, "cache"))
    row = (one == identity.metadata_identity(a), one == identity.metadata_identity(a, {"inline": 9}), one == identity.metadata_identity(b), kept.count())
    return spark.createDataFrame([row], "same boolean, under_other_mapping boolean, of_other_file boolean, cached bigint")


@query(NUM + ", l AS (SELECT count(*) // 50 * 50 AS m FROM num) SELECT n AS trace_number, CAST(n // 50 + 1 AS INTEGER) AS il, CAST(n % 50 + 1 AS INTEGER) AS xl, CAST(n // 50 AS INTEGER) AS row, CAST(n % 50 AS INTEGER) AS col FROM num, l WHERE n < m")
def segy_regular_grid(spark, sf):
    """The grid of a file without gaps, inferred from about a hundred headers: the whole lines of the records."""

    def write(path: str) -> None:
        rows = _rows(spark, sf)
        whole = rows.count() // 50 * 50
        sink.write_traces(rows.where(F.col("output_order") < whole), path, DT_US, SAMPLES)

    grid = detect.regular_grid(_once(spark, sf, "whole.sgy", write))
    return detect.regular_index(spark, grid)
