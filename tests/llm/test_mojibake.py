import pytest

from lithoframe.llm.mojibake import normal_line, repair, train

CLEAN = [
    "C 1 Länge der Auslage 1216 m, Schlüssel [441], Größe geprüft", "C 2 Système d'unités : mètres, décalage 2526 m, tâche achevée", "C 3 Координаты в метрах, масштаб 85", "C 4 坐标单位：米，比例因子 2221",
    "C 5 WEATHERED LAYER ±6.1 M, VELOCITY 3515 M/S", "C 6 DATUM: LOCAL GRID, UNITS [M], SCALAR -100", "C 7 SYMBOLS USED: Å = ANGSTROM, Â = MEAN AMPLITUDE", "C 8 @@@@@@@@@@@@@@@@@@@@", "C 9 QC: 12 BAD TRACES (EDITED), 7 NOISY!",
]


def spoil(line, written, read):
    return line.encode(written).decode(read)


BAD = [
    (1, "utf-8", "cp1252"), (0, "utf-8", "latin-1"), (0, "cp1252", "cp1251"), (1, "cp850", "cp1252"), (0, "utf-8", "mac-roman"), (1, "utf-8", "latin-1"), (2, "cp1251", "latin-1"), (2, "koi8-r", "cp1251"), (2, "utf-8", "latin-1"), (3, "gb18030", "latin-1"),
    (4, "utf-8", "latin-1"), (5, "cp037", "cp500"), (5, "cp037", "latin-1"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, "\r\n".join(CLEAN), 1, 2) for i in range(60)]
    for k, (line, written, read) in enumerate(BAD):
        lines = list(CLEAN)
        lines[line] = spoil(lines[line], written, read)
        rows.append((100 + k, "\r\n".join(lines), 1, 2))
    twice = list(CLEAN)
    twice[0] = spoil(spoil(twice[0], "utf-8", "latin-1"), "utf-8", "latin-1")
    lost = list(CLEAN)
    lost[1] = lost[1].encode("latin-1").decode("utf-8", "replace")
    rows += [(200, "\r\n".join(twice), 1, 2), (201, "\n".join(lost), 1, 2), (202, None, 1, 2), (203, "", 1, 2), (204, "\0" * 80, 1, 2), (205, "  \r\n ", 1, 2), (100, rows[60][1], 1, 2)]
    return spark.createDataFrame(rows, "header_id bigint, text string, bad_lines int, how int")


def test_found_and_restored(table):
    got = {r["header_id"]: r for r in repair(table).collect()}
    assert sorted(got) == [*range(100, 100 + len(BAD)), 200, 201]
    clean = "\r\n".join(CLEAN)
    for i in [*range(100, 100 + len(BAD)), 200]:
        assert got[i]["restored"] == clean and got[i]["restored_lines"] == 1, got[i]
    assert got[201]["restored_lines"] == 0 and "�" in got[201]["restored"]


def test_copies_and_empty(table):
    assert repair(table).where("header_id = 100").count() == 2
    assert repair(table.where("false")).count() == 0


def test_model_knows_no_size(spark, table):
    model = train(table)
    assert model.cost(normal_line(CLEAN[0])) < model.cost(normal_line(spoil(CLEAN[0], "utf-8", "latin-1")))


def test_long_text(spark):
    text = "Ein sehr langer Text über Größe. " * 3000
    df = spark.createDataFrame([(1, text), (2, spoil(text, "utf-8", "latin-1"))] + [(i, text[:66]) for i in range(3, 40)], "header_id bigint, text string")
    got = {r["header_id"]: r["restored"] for r in repair(df).collect()}
    assert got.get(2) == text


def test_a_third_garbled_alike(spark):
    clean = ["C 1 MESSGEBIET: SÜDLICHES BECKEN, GRÖSSE 12 KM²", "C 2 REGIÃO SÃO VANDRI, OPERAÇÃO 4", "C 3 DIREÇÃO DA EMBARCAÇÃO 12°, V", "C 4 Площадь съёмки: северный прогиб", "C 5 Atténuation à 9 dB, côté bâbord", "C 6 SHOT POINT INTERVAL 25 M"]
    rows = [(i, "\n".join(spoil(c, "cp1252", "cp1251") if i < 40 and k in (0, 1) else c for k, c in enumerate(clean))) for i in range(120)]
    got = {r["header_id"]: r["restored"] for r in repair(spark.createDataFrame(rows, "header_id bigint, text string")).collect()}
    assert sorted(got) == list(range(40))
    assert set(got.values()) == {"\n".join(clean)}


def test_many_layers(spark):
    clean = "Grüße aus München, Größe geprüft"
    rows = [(i, clean) for i in range(30)]
    for layers in range(1, 8):
        text = clean
        for _ in range(layers):
            text = spoil(text, "utf-8", "latin-1")
        rows.append((100 + layers, text))
    got = {r["header_id"]: (r["restored"], r["restored_lines"]) for r in repair(spark.createDataFrame(rows, "header_id bigint, text string")).collect()}
    assert got == {100 + k: (clean, 1) for k in range(1, 8)}


def test_order_and_the_way_of_lookup_do_not_matter(spark, table):
    from pyspark.sql import functions as F

    plain = sorted(tuple(r) for r in repair(table).collect())
    shuffled = table.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5))
    assert sorted(tuple(r) for r in repair(shuffled).collect()) == plain
    assert sorted(tuple(r) for r in repair(table, held=(0, 0)).collect()) == plain


def test_digits_within_characters_stay():
    assert normal_line("A 12 ±3.4 é5") == "A 9 ±9.9 é9" and normal_line("\x819\x810 x") == "\x819\x819 x" and normal_line("é12ü 12ü 1") == "é12ü 9ü 9"


def test_stores_have_a_bound(table, monkeypatch):
    from lithoframe.llm import mojibake

    model = train(table)
    monkeypatch.setattr(mojibake, "MEMORY", 50)
    before = [model.chain(spoil(CLEAN[k], w, r)) for k, w, r in BAD]
    assert len(model.memory) < 5_000 and [model.chain(spoil(CLEAN[k], w, r)) for k, w, r in BAD] == before
