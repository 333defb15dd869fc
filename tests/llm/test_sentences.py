import pytest

from lithoframe.llm.sentences import sentence_spans, split_sentences


def cut(text):
    return [text[a:b] for a, b, _ in sentence_spans(text)]


@pytest.mark.parametrize(
    "sentences, sep",
    [
        (["Amplitudes fell by 45.73 dB vs. the test line.", "dt was 196 microseconds on reel 613."], " "),
        (["Midpoints near St. Arvan bank fall outside.", "The U.S. crew joined in block No. 559.", "See Fig. 120 for the fold."], "  "),
        (["Recording stopped at 9 p.m.", "Recording resumed at 9 a.m. on the second day.", "Vol. 9 describes it, cf. p. 9."], "\xa0"),
        (["Offsets, azimuths, etc. were recomputed.", "The bins hold points, etc.", "A weak reflector hides."], " "),
        (["The noise rose ... then it vanished.", "Nobody knows why the cable turned...", "The end."], " "),
        (["What happened at shot 9?!", "(Channel 643 was spare.)", "The correction (see Sec. 5.3) removes it."], " "),
        (['"The navigation is fine."', 'The observer wrote "Stop. Reload the tape." and left.', 'He asked, "Which line is next?" and got no answer.'], " "),
        (["Einige Kanäle, z. B. 978 und 239, sind verrauscht.", "Die Überdeckung ist in der 9. Zone zu gering.", "Am 3. März endete es zwischen Spur 4 und 9.", "Das Feld, d. h. alles."], " "),
        (["„Alles in Ordnung.“", "Der Beobachter schrieb: „Halt. Band wechseln.“ und ging."], " "),
        (["«\xa0Tout est prêt.\xa0»", "Attention au décalage\xa0!", "L'observateur a noté «\xa0Arrêt. Changer la bande.\xa0» puis il est sorti."], " "),
        (["Los datos vienen de EE. UU. y usan pies.", "¡No cambie el factor!", "¿Está completa la cinta 9?", "Algunas trazas, p. ej. la 9, tienen ruido."], " "),
        (["Использовались азимуты, выносы и т. п. данные.", "Учтены шумы и т. д.", "См. рис. 9 и табл. 4.", "Шаг равен 9,9 м, т. е. меньше.", "Съёмка 2024 г. выполнена."], " "),
        (["Ποια ίχνη λείπουν;", "Ο θόρυβος αυξήθηκε, π.χ. στο ίχνος 8.", "Σταμάτησε στις 12:14· ο καιρός ήταν κακός."], " "),
        (["क्या अनुरेख 9 खराब है?", "दूरी 9.9 कि.मी. है और दिशा ठीक है।", 'प्रेक्षक ने लिखा, "रुको। टेप बदलो।" और चला गया।', "शोर बढ़ा... फिर कम हो गया।"], " "),
        (["هل الأثر رقم 557 تالف؟", "كتب المراقب: «توقف. بدّل الشريط.» ثم خرج.", "بلغ الإزاحة ٠.٥ متراً، أي أقل."], " "),
        (["잡음이 커졌다... 그리고 사라졌다.", '관측자는 "정지. 테이프 교체."라고 적었다.', "605번 트레이스가 불량인가?"], " "),
        (["偏移距为4.44米；方位角为32.0度。", "“导航正常。”", "观测员写道：“停机。更换磁带。”，随后离开｡", "操作员问：「下一条线是哪条？」没有人回答．", "为什么第195炮重复了？！", "噪声先升高……然后消失了。"], ""),
        (["「航法は正常です。」", "観測員は「停止。テープ交換。」と記録した。", "版v0.0.7は正しい。"], ""),
        (["ระยะห่างคือ 4.5 เมตรตามแผนงาน", "ปืนลมหมายเลข 963 หยุดทำงาน", "แนว OSK-0000045 ถูกบันทึก"], " "),
        (["- turn to next line", "- Compass 750 replaced.", "Depth back to 2.3 m."], "\n"),
        (["C 1 Länge der Auslage 891 m", "C10 Nr. 7", "C11 MUTE AT 0.3 S [OUTER], 9.2 S [INNER]"], "\n"),
        (["11:02 ==== restart ====", "1. All channels live.", "23) speed 21.5 kn 👍", "• (a note"], "\r\n"),
    ],
)
def test_boundaries(sentences, sep):
    if sep == "\n" and sentences[2].startswith("Depth"):
        text = "- turn to next line\n- Compass 750 replaced. Depth back to 2.3 m."
    else:
        text = sep.join(sentences)
    assert cut(text) == sentences


def test_layout():
    text = "\t## Results v2.3.3\n\nThe second\ncable was (as\nplanned) fine. It\nended\r\n \r\n  Last one \n"
    assert cut(text) == ["## Results v2.3.3", "The second\ncable was (as\nplanned) fine.", "It\nended", "Last one"]
    assert cut('An open " quote here. Next one.\n\nAnd ( an open bracket. Done.') == ['An open " quote here.', "Next one.", "And ( an open bracket.", "Done."]
    assert cut("All in (one. Two) sentence.") == ["All in (one. Two) sentence."]


@pytest.mark.parametrize("text", [None, "", "  \n\t ", "　"])
def test_nothing(text):
    assert sentence_spans(text) == []


def test_long_text_is_cut_whole():
    text = "One sentence of it here. " * 20_000
    assert len(sentence_spans(text)) == 20_000 and len(sentence_spans("x" * 300_000)) == 1


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 4), (1, "A b. C d.", 4), (2, None, 4), (3, " ", 4), (None, "E.", 4), (5, "👍 ok. Then é.", 4)], "doc_id bigint, text string, end_char int")
    got = sorted(((r["doc_id"] or -1), r["sentence_no"], r["end_char"]) for r in split_sentences(df).collect())
    assert got == [(-1, 0, 2), (1, 0, 4), (1, 0, 4), (1, 1, 9), (1, 1, 9), (5, 0, 5), (5, 1, 13)]
    assert split_sentences(df.where("false")).count() == 0
    assert {r["sentence"] for r in split_sentences(df, with_text=True).where("doc_id = 5").collect()} == {"👍 ok.", "Then é."}


@pytest.mark.parametrize(
    "text",
    ["He met Gov. Smith.", "We saw Gen. Lee there.", "Then Rev. Jones spoke.", "Guten Tag, Hr. Müller kam.", "Hier wohnt Mme. Durand.", "Il Sig. Rossi parla.", "It ran from Jan. 5 to Feb. 9.", "El Lic. Gómez firmó.", "The Corp. Building is tall.", "We climbed Mt. Everest."],
)
def test_titles_months_and_names(text):
    assert cut(text) == [text]
    assert cut(f"{text} {text}") == [text, text]


def test_words_like_titles_end_sentences():
    assert cut("He works for Acme Corp. The firm pays.") == ["He works for Acme Corp.", "The firm pays."]
    assert cut("The depth is 5 m. Then the line ends.") == ["The depth is 5 m.", "Then the line ends."]
    assert cut("It took 9 ms. Then it ran at 3 rev. Nothing else.") == ["It took 9 ms.", "Then it ran at 3 rev.", "Nothing else."]
    assert cut("Offsets etc. dx was 9. The values etc. km count.") == ["Offsets etc.", "dx was 9.", "The values etc. km count."]


def test_levels_of_lists():
    text = "Head\n- a. B.\n  1) c\n  wrapped\n  2) d\n    - e\n- f\n\nEnd"
    assert [(text[a:b], level) for a, b, level in sentence_spans(text)] == [("Head", 0), ("- a.", 1), ("B.", 1), ("1) c\n  wrapped", 2), ("2) d", 2), ("- e", 3), ("- f", 1), ("End", 0)]
