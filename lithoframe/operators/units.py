"""Recorded coordinate words into metres, or seconds of arc on geographic lines, in SQL alone.

A unit and a scale are read from the trace (scalar, unit code, note), the file's remark and its
measurement system, in that order. Where the line has navigation, the outcome must fit it; if it
doesn't, the unit and power of ten that do fit stand instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Wording of units in notes and remarks, lower case, with the unit meant.
ALIASES = {
    "m": "m|meter|meters|metre|metres|米|м|метр|метры",
    "km": "km|kilometre|kilometres|kilometer|kilometers|公里|км",
    "dm": "dm|decimetre|decimetres|decimeter|decimeters|дм",
    "cm": "cm|centimetre|centimetres|centimeter|centimeters|zentimeter|см|厘米",
    "ft": "ft|feet|foot|international feet|ft (intl)|fuß|英尺|футы",
    "usft": "us survey feet|u.s. survey feet|survey feet|usft|u.s. ft|us ft|ftus",
    "yd": "yd|yard|yards|ярды|码",
    "arcsec": "geographic, sec|seconds of arc|arc seconds|arcsec|arcseconds",
    "deg": "decimal degrees|geographic, degrees|degrees|deg",
    "dms": "geographic, dms|deg min sec|dddmmss|dms",
}
#: Metres, or seconds of arc, per unit; dms is read digit by digit.
FACTORS = {"m": "1e0", "km": "1000e0", "dm": "0.1e0", "cm": "0.01e0", "ft": "0.3048e0", "usft": "(1200e0 / 3937e0)", "yd": "0.9144e0", "arcsec": "1e0", "deg": "3600e0", "dms": "1e0"}
#: Share of the distance from the origin by which a position may miss the navigation.
FIT = "0.03e0"
#: Traces per bucket of the join with the navigation.
BUCKET = 32


def _phrase(column: str) -> str:
    """SQL: the first wording of a unit in a text, or ''."""
    words = sorted((w for names in ALIASES.values() for w in names.split("|")), key=len, reverse=True)
    pattern = "|".join(w.replace(".", "[.]").replace("(", "[(]").replace(")", "[)]") for w in words)
    return f"regexp_extract(lower(coalesce({column}, '')), '(?:^|[^a-zа-я])({pattern})(?:$|[^a-zа-я])', 1)"


def _seconds(v: str) -> str:
    """SQL: seconds of arc of a signed DDDMMSS value."""
    a = f"abs({v})"
    return f"(sign({v}) * (floor({a} / 10000) * 3600 + floor(({a} - floor({a} / 10000) * 10000) / 100) * 60 + ({a} - floor({a} / 100) * 100)))"


def units_sql(coordinates: str, files: str, navigation: str, dialect: str = "spark") -> str:
    """The query over three relations; dialect 'duckdb' spells the bucket range and the array of files otherwise."""
    series = (lambda a, b: f"explode(sequence({a}, {b}))") if dialect == "spark" else (lambda a, b: f"unnest(generate_series({a}, {b}))")
    unnest = (lambda e: f"explode({e})") if dialect == "spark" else (lambda e: f"unnest({e})")
    array = lambda items: ("array(" if dialect == "spark" else "list_value(") + ", ".join(f"'{i}'" for i in items) + ")"
    finite = "isfinite({0})" if dialect == "duckdb" else "({0} IS NOT NULL AND NOT isnan({0}) AND abs({0}) < double('Infinity'))"
    ok = lambda c: finite.format(c)
    alias = ", ".join(f"('{w}', '{u}')" for u, names in ALIASES.items() for w in names.split("|"))
    factor = "CASE {0} " + " ".join(f"WHEN '{u}' THEN {f}" for u, f in FACTORS.items()) + " END"
    long = lambda e: f"CAST(floor({e}) AS BIGINT)"
    return f"""
WITH alias(phrase, unit) AS (SELECT * FROM (VALUES {alias}) AS v(phrase, unit)),
rows0 AS (SELECT DISTINCT coord_id, file_id, line, trace, x, y, coalesce(scalar, 0) AS sc, coalesce(units, 0) AS un, unit_note
          FROM {coordinates} WHERE valid AND coord_id IS NOT NULL AND {ok('x')} AND {ok('y')}),
noted AS (SELECT r.*, a.unit AS note_unit FROM (SELECT *, {_phrase('unit_note')} AS phrase FROM rows0) r LEFT JOIN alias a ON a.phrase = r.phrase),
files0 AS (SELECT file_id, max(measurement_system) AS ms, max(coord_text) AS coord_text FROM {files} WHERE file_id IS NOT NULL GROUP BY file_id),
files1 AS (SELECT f.file_id, f.ms, a.unit AS text_unit,
             CASE regexp_extract(lower(coalesce(coord_text, '')), '(divide|multiply) xy by ([0-9]+)', 1)
               WHEN 'divide' THEN 1e0 / CAST(regexp_extract(lower(coord_text), '(divide|multiply) xy by ([0-9]+)', 2) AS DOUBLE)
               WHEN 'multiply' THEN CAST(regexp_extract(lower(coord_text), '(divide|multiply) xy by ([0-9]+)', 2) AS DOUBLE) END AS text_scale
           FROM (SELECT *, {_phrase('coord_text')} AS phrase FROM files0) f LEFT JOIN alias a ON a.phrase = f.phrase),
-- a note holds between the first and the last trace that bear it, and for all rows of its codes if no other note is there
spans AS (SELECT file_id, un, sc, note_unit AS span_unit, min(trace) AS t0, max(trace) AS t1, count(*) AS n FROM noted WHERE note_unit IS NOT NULL GROUP BY file_id, un, sc, note_unit),
span1 AS (SELECT file_id, un, sc, max(span_unit) AS span_unit, min(t0) AS t0, max(t1) AS t1, count(*) AS kinds FROM spans GROUP BY file_id, un, sc),
told AS (SELECT r.coord_id, r.line, r.trace, r.x, r.y, f.text_unit,
           coalesce(r.note_unit, CASE WHEN s.kinds = 1 AND r.trace BETWEEN s.t0 AND s.t1 THEN s.span_unit END,
                    CASE r.un WHEN 2 THEN 'arcsec' WHEN 3 THEN 'deg' WHEN 4 THEN 'dms' END, f.text_unit, CASE WHEN f.ms = 2 THEN CASE WHEN s.kinds = 1 AND s.span_unit = 'usft' THEN 'usft' ELSE 'ft' END ELSE 'm' END) AS unit,
           CASE WHEN s.kinds = 1 THEN s.span_unit END AS other_unit,
           CASE WHEN r.sc > 0 THEN CAST(r.sc AS DOUBLE) WHEN r.sc < 0 THEN -1e0 / r.sc ELSE coalesce(f.text_scale, 1e0) END AS scale
         FROM noted r LEFT JOIN files1 f ON f.file_id = r.file_id LEFT JOIN span1 s ON s.file_id = r.file_id AND s.un = r.un AND s.sc = r.sc),
nav0 AS (SELECT line, trace, avg(x) AS x, avg(y) AS y, min(min_trace) AS lo, max(max_trace) AS hi FROM {navigation}
         WHERE line IS NOT NULL AND trace IS NOT NULL AND {ok('x')} AND {ok('y')} GROUP BY line, trace),
nav1 AS (SELECT *, lead(trace) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(trace) OVER w AS before,
           max(greatest(abs(x) / 180, abs(y) / 90)) OVER (PARTITION BY line) <= 1 AS geo,
           min(least(trace, coalesce(lo, trace))) OVER (PARTITION BY line) AS first_trace, max(greatest(trace, coalesce(hi, trace))) OVER (PARTITION BY line) AS last_trace
         FROM nav0 WINDOW w AS (PARTITION BY line ORDER BY trace)),
-- stretches [a, b) of traces with the straight line that holds there; the outer ones reach to the line's ends
nav2 AS (SELECT line, geo, trace AS t0, x AS x0, y AS y0, (x1 - x) / (t1 - trace) AS vx, (y1 - y) / (t1 - trace) AS vy,
           CASE WHEN before IS NULL THEN first_trace - {BUCKET} ELSE trace END AS a, CASE WHEN t1 = max(t1) OVER (PARTITION BY line) THEN last_trace + {BUCKET} ELSE t1 END AS b
         FROM nav1 WHERE t1 IS NOT NULL),
nav3 AS (SELECT *, {series(long(f'a / {BUCKET}.0'), long(f'b / {BUCKET}.0'))} AS bucket FROM nav2),
met AS (SELECT r.*, n.geo, CASE WHEN n.geo THEN 3600 ELSE 1 END * (n.x0 + n.vx * (r.trace - n.t0)) AS rx, CASE WHEN n.geo THEN 3600 ELSE 1 END * (n.y0 + n.vy * (r.trace - n.t0)) AS ry
        FROM (SELECT *, {long(f'trace / {BUCKET}.0')} AS bucket FROM told) r LEFT JOIN nav3 n ON n.line = r.line AND n.bucket = r.bucket AND r.trace >= n.a AND r.trace < n.b),
scaled AS (SELECT *, CASE WHEN unit = 'dms' THEN {_seconds('(x * scale)')} ELSE x * scale * {factor.format('unit')} END AS dx,
             CASE WHEN unit = 'dms' THEN {_seconds('(y * scale)')} ELSE y * scale * {factor.format('unit')} END AS dy,
             sqrt(rx * rx + ry * ry) AS far, sqrt(x * x + y * y) AS raw FROM met),
-- what the records say stands alone where it fits the navigation or there is none; else other kinds of unit are tried too
tried AS (SELECT coord_id, x, y, rx, ry, far, raw, unit, other_unit, text_unit, scale, {unnest(f"CASE WHEN raw > 0 AND far > 0 AND (geo <> (unit IN ('arcsec', 'deg', 'dms')) OR sqrt((dx - rx) * (dx - rx) + (dy - ry) * (dy - ry)) > {FIT} * far) THEN CASE WHEN geo THEN {array(['told, but unfit', 'arcsec', 'deg', 'dms', 'dms1', 'dms10', 'dms100'])} ELSE {array(['told, but unfit', 'm', 'ft', 'yd'])} END ELSE {array(['told'])} END")} AS kind FROM scaled),
-- the factor of each kind: for a unit the power of ten that brings it nearest
sized AS (SELECT coord_id, x, y, rx, ry, far, kind, kind LIKE 'dms%' OR (kind LIKE 'told%' AND unit = 'dms') AS by_digits,
            CASE kind WHEN 'told' THEN scale * {factor.format('unit')} WHEN 'told, but unfit' THEN scale * {factor.format('unit')} WHEN 'dms' THEN scale WHEN 'dms1' THEN 1e0 WHEN 'dms10' THEN 0.1e0 WHEN 'dms100' THEN 0.01e0
              ELSE f * pow(10e0, round(log10(far / (raw * f)))) END AS mul
          FROM (SELECT *, CASE kind WHEN 'deg' THEN 3600e0 WHEN 'yd' THEN 0.9144e0
                  WHEN 'ft' THEN CASE WHEN 'usft' IN (unit, coalesce(other_unit, ''), CASE WHEN coalesce(other_unit, '') = 'ft' OR unit = 'ft' THEN '' ELSE coalesce(text_unit, '') END) THEN {FACTORS['usft']} ELSE {FACTORS['ft']} END
                  ELSE 1e0 END AS f FROM tried) t),
placed AS (SELECT coord_id, x, y, rx, ry, far, kind, CASE WHEN by_digits THEN {_seconds('(x * mul)')} ELSE x * mul END AS px, CASE WHEN by_digits THEN {_seconds('(y * mul)')} ELSE y * mul END AS py FROM sized),
ranked AS (SELECT coord_id, x, y, kind, px, py, CASE kind WHEN 'told' THEN 0e0 WHEN 'told, but unfit' THEN {FIT} * far ELSE sqrt((px - rx) * (px - rx) + (py - ry) * (py - ry)) END AS off FROM placed),
common AS (SELECT coord_id, x, y, min_by(px, off) AS x_exact, min_by(py, off) AS y_exact, min_by(kind, off) NOT LIKE 'told%' AS mended FROM ranked GROUP BY coord_id, x, y)
SELECT coord_id, x, y, x_exact, y_exact, CAST(round(round(x_exact, 6)) AS BIGINT) AS x_common, CAST(round(round(y_exact, 6)) AS BIGINT) AS y_common, mended FROM common
"""


def common_units(coordinates: DataFrame, files: DataFrame, navigation: DataFrame) -> DataFrame:
    """(coord_id, x, y, x_exact, y_exact, x_common, y_common, mended), one row per valid trace sent.

    Traces that are invalid, without id or without a finite position are left out; copies count once.
    A trace without a file or navigation takes what it says of itself, and metres if it says nothing.
    mended tells that the navigation overruled the records. x_common and y_common are rounded to
    whole metres, or whole seconds of arc on geographic lines, halves away from zero.
    """
    return coordinates.sparkSession.sql(units_sql("{coordinates}", "{files}", "{navigation}"), coordinates=coordinates, files=files, navigation=navigation)
