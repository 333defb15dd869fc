import pytest

from lithoframe.operators.units import common_units

C = "coord_id bigint, file_id bigint, line string, trace bigint, x double, y double, scalar int, units int, unit_note string, valid boolean, raw string, unit int"
F_ = "file_id bigint, line string, measurement_system int, coord_text string, phrase string"
N = "line string, sp double, trace bigint, x double, y double, min_trace bigint, max_trace bigint"


def run(spark, coords, files=(), nav=()):
    df = common_units(spark.createDataFrame([(*c, "x", 1) for c in coords], C), spark.createDataFrame([(*f, "x") for f in files], F_), spark.createDataFrame(list(nav), N))
    return {r["coord_id"]: (r["x_common"], r["y_common"]) for r in df.collect()}


@pytest.mark.parametrize(
    "scalar, units, note, text, system, want",
    [
        (1, 1, None, None, 1, (1000, 2000)), (-10, 1, None, None, 1, (100, 200)), (10, 1, None, None, 1, (10_000, 20_000)), (0, 1, None, "DIVIDE XY BY 100", 1, (10, 20)), (None, None, None, None, None, (1000, 2000)),
        (1, 1, None, None, 2, (305, 610)), (1, 1, "UNITS: FT (INTL)", None, 1, (305, 610)), (1, 0, None, "COORDS IN YARDS", 0, (914, 1829)), (-1000, 1, "xy/km", None, 0, (1000, 2000)), (1, 1, "Zentimeter", None, 0, (10, 20)),
        (1, 2, None, None, 0, (1000, 2000)), (-100, 3, None, None, 0, (36_000, 72_000)), (1, 4, None, None, 0, (600, 1200)), (1, 0, "DDDMMSS", None, 0, (600, 1200)), (1, 0, "坐标单位：英尺", None, 0, (305, 610)), (1, 0, "координаты, м", None, 2, (1000, 2000)),
        (1, 1, None, "C21 survey feet, DIVIDE XY BY 10", 0, (305, 610)),
    ],
)
def test_told_units(spark, scalar, units, note, text, system, want):
    assert run(spark, [(1, 7, "L", 5, 1000.0, 2000.0, scalar, units, note, True)], [(7, "L", system, text)]) == {1: want}


def test_survey_feet_differ(spark):
    got = run(spark, [(1, 7, "L", 5, 9_000_000.0, 9_000_000.0, 1, 1, "US SURVEY FEET", True), (2, 8, "M", 5, 9_000_000.0, 9_000_000.0, 1, 1, "international feet", True)])
    assert got[2][0] == 2_743_200 and got[1][0] == 2_743_205


def test_navigation_overrules(spark):
    nav = [("L", 1.0, 0, 30_480.0, 60_960.0, 0, 10), ("L", 2.0, 10, 30_500.0, 60_980.0, 0, 10)]
    got = run(spark, [(i, 7, "L", i, 100_000.0, 200_000.0, 1, 1, None, True) for i in (0, 5)], [(7, "L", 1, None)], nav)
    assert got == {0: (30_480, 60_960), 5: (30_480, 60_960)}


def test_geographic_by_navigation(spark):
    nav = [("L", 1.0, 0, 7.5, 40.25, 0, 10), ("L", 2.0, 10, 7.5001, 40.2501, 0, 10)]
    assert run(spark, [(1, 7, "L", 3, 75_000.0, 402_500.0, None, None, None, True)], [(7, "L", 0, None)], nav) == {1: (27_000, 144_900)}


def test_rows_left_out_and_copies(spark):
    c = [(1, 7, "L", 1, 1.0, 1.0, -10, 1, None, True), (1, 7, "L", 1, 1.0, 1.0, -10, 1, None, True), (2, 7, "L", 1, float("nan"), 1.0, 1, 1, None, True), (3, 7, "L", 1, 1.0, None, 1, 1, None, True), (4, 7, "L", 1, 1.0, 1.0, 1, 1, None, False), (None, 7, "L", 1, 1.0, 1.0, 1, 1, None, True), (5, None, None, None, 5.0, 5.0, 1, 1, "", True)]
    assert run(spark, c) == {1: (0, 0), 5: (5, 5)}


def test_halves_go_away_from_zero(spark):
    assert run(spark, [(1, 7, "L", 1, 25.0, -25.0, -10, 1, None, True)]) == {1: (3, -3)}


def test_empty(spark):
    assert run(spark, []) == {}
