"""Sentence boundaries in texts of any language, script and layout.

A pushdown automaton runs over the marks of a text (terminators, quotation marks, brackets, line
breaks, blanks between Thai letters). Its stacks hold open quotations and brackets, and the levels of
a list by the indents of its marks; tries of abbreviations and a few rules by script decide what a
full stop means. Ends are code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations of many languages by what follows them, written in small letters and without blanks.
#: A word or name always follows: their full stop never ends a sentence.
ABBREVIATIONS_OPEN = """
e.g i.e cf vs approx ca st dr mr mrs messrs mx prof profs viz resp incl excl esp ibid seq
z.b d.h u.a s.o s.u bzw vgl evtl ggf ggfs inkl exkl einschl zzgl abzgl bspw sog ehem insb insbes allg vorl versch i.d.r i.a m.e v.a z.t z.zt s.a u.u o.g
env p.ex c.-à-d n.b p.ej aprox p.es ad.es cioè.a.d m.in tzn tzw np bijv d.w.z m.b.t o.a bkz örn
т.е т.н т.к т.о ок напр см ср гл им ул акад проф доц инж тов
π.χ δηλ βλ कि.मी डॉ श्री प्रो
""".split()
#: Titles and parts of names: a capitalised one before a capital letter never ends a sentence.
ABBREVIATIONS_TITLE = """
ms gov gen rev hon sen rep capt cpt cmdr cdr col lt sgt cpl pvt maj adm brig supt insp det pres amb atty fr br sr jr mt mts ft pt ste sta sto ave blvd
hr hrn frl fam dipl ing mag dkfm stud
m mm mme mmes mlle mlles mgr me pr cie boul
d dña sres sra sras srta srtas dra drs dras lic arq abog gral excmo excma ilmo ilma fdo av avda
exmo exma profa eng
sig sigg sig.ra sig.na dott dott.ssa prof.ssa avv geom rag on mons
dhr mevr mw ir drs
p pani ks inż dn sn
г гр
κ κα κκ
""".split()
#: Words of a firm's or an institution's name: the name goes on before a capital letter, unless the word there usually opens a sentence.
ABBREVIATIONS_NAME = "corp bros assoc dept univ inst mfg intl natl govt cos llc plc gmbh dept.of".split()
#: Words that open a sentence behind such a name.
OPENERS = "the a an it its he she we they i you this that these those there in on at by for from with as if when while after before since once during all both each no not and but or so then however".split()
#: A number always follows; before anything else they are ordinary words.
ABBREVIATIONS_NUMBER = """
fig figs sec secs vol vols no nos nr nrs p pp eq eqs ref refs ch chs abb tab tabl art arts chap par para n ed pl pt pts ex
jan feb mar apr jun jul aug sep sept oct okt nov dec dez mär janv févr avr juil déc ene abr ago set dic genn febbr
núm pág págs cap caps tít mapa z.hd bd bde kap ziff anm taf seite
рис табл стр с
σελ αρ κεφ τομ पृ
""".split()
#: May stand at the end of a sentence as well: what follows decides.
ABBREVIATIONS_CLOSE = """
etc usw usf et.al inc ltd co jr sr sra a.m p.m u.s u.k u.s.a u.n e.u ee.uu ud uds min max hrs ecc enz m.a.w atd itd itp
т.п т.д и.др г гг руб тыс млн κ.λπ κτλ u.dgl u.ä o.ä e.v a.d b.c a.c d.c n.chr v.chr
""".split()
#: Words before a number with a full stop that make it an ordinal (German dates and ranks).
ORDINAL_LEADS = "am der die das den dem des vom zum zur im ab bis beim seit ein eine einer einem einen".split()
#: Units: short words of consonants only that aren't the symbol of a quantity.
UNITS = "km cm mm nm kg mg ms ns hz khz mhz db kn kw kv".split()

CLOSE_OF = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"'}
CLOSERS = "»”“」』)）]】》\""
HARD = "。｡．！？।॥؟۔;…"  # ends that need no blank behind them
_MARK = (
    r"(?P<brk>(?:[^\S\r\n\u2028\u2029]*(?:\r\n|[\r\n\u2028\u2029]))+)"
    r"|(?P<end>[.!?。｡．！？।॥؟۔;…]+|(?<=\p{Greek});)"
    r"|(?P<open>[«„「『(（\[【《])|(?P<close>[»”」』)）\]】》])|(?P<both>[“\"])"
    r"|(?<=\p{Thai})(?P<thai>[^\S\r\n]+)(?=\p{Thai}|\p{Lu}\p{Ll})"
)
_ITEM = r"[^\S\r\n]*(?:(?:[-–—•*▪●○‣·+]|\d{1,4}[.)]|\(\d{1,4}\)|\p{L}\)|#{1,6})[^\S\r\n]|\d{1,2}:\d{2}(?::\d{2})?(?=\s)|C ?\d{1,3}(?=\s))"


def _trie(words: list[str], kind: int, root: dict) -> None:
    for word in words:
        at = root
        for c in reversed(word.rstrip(".")):
            at = at.setdefault(c, {})
        at[""] = kind


@lru_cache(maxsize=1)
def _tools():
    import regex

    root: dict = {}
    _trie(ABBREVIATIONS_OPEN, 1, root)
    _trie(ABBREVIATIONS_CLOSE, 2, root)
    _trie(ABBREVIATIONS_NUMBER, 3, root)
    names: dict = {}
    _trie(ABBREVIATIONS_TITLE, 4, names)
    _trie(ABBREVIATIONS_NAME, 5, names)
    begun = {".".join(parts[:k]) + "." + parts[k] for parts in (w.split(".") for w in (*ABBREVIATIONS_OPEN, *ABBREVIATIONS_CLOSE)) for k in range(1, len(parts))}
    return regex.compile(_MARK), regex.compile(_ITEM), (root, names), regex.compile(r"\p{Lo}"), begun


def _abbreviation(text: str, dot: int, start: int, root: dict) -> tuple[int, int]:
    """(kind, where it begins) of the longest abbreviation that the full stop at `dot` closes; kind 0 if none."""
    at, i, kind, begin = root, dot - 1, 0, dot
    while i >= start:
        c = text[i].lower()
        if c.isspace() and i + 1 < dot and text[i - 1 : i] == ".":  # blanks within, as in "z. B."
            i -= 1
            continue
        if c not in at:
            break
        at = at[c]
        if "" in at and (i == start or not (text[i - 1].isalnum() or text[i - 1] in "._/\\-")):
            kind, begin = at[""], i
        i -= 1
    return kind, begin


def _word_before(text: str, i: int, start: int) -> tuple[int, int]:
    """Bounds of the letters and digits that end before i."""
    j = i
    while j > start and (text[j - 1].isalnum() or "̀" <= text[j - 1] <= "ͯ"):
        j -= 1
    return j, i


def sentence_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, list level) of every sentence, in code points; end is behind its last non-blank character.

    The level is 0 outside of lists, 1 for an item at the outermost indent, and one more for each indent
    within. None for null, empty and blank texts.
    """
    if not text or text.isspace():
        return []
    mark, item, tries, caseless, begun = _tools()
    n = len(text)
    spans: list[tuple[int, int, int]] = []
    levels: list[int] = []  # indents of the list marks around the present sentence
    start = 0  # of the present sentence
    stack: list[tuple[str, bool, int]] = []  # closing characters, opened at a sentence's start, where

    def emit(end: int) -> None:
        nonlocal start
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            spans.append((a, b, len(levels)))
        start = end
        stack.clear()

    def list_item(m) -> None:
        """A list mark stands at the start of a line: lists further in are over, and one may begin."""
        indent = len(m.group()) - len(m.group().lstrip())
        while levels and levels[-1] > indent:
            levels.pop()
        if not levels or levels[-1] < indent:
            levels.append(indent)

    def block_end(i: int) -> int:
        """Where an open quotation or bracket must have closed: the next empty line or list mark."""
        for m in mark.finditer(text, i):
            if m.lastgroup == "brk" and (breaks(m) > 1 or item.match(text, m.end())):
                return m.start()
        return n

    def breaks(m) -> int:
        s = m.group()
        return s.count("\n") + s.count("\r") - s.count("\r\n") + s.count("\u2028") + s.count("\u2029")

    limit = -1  # block_end, found when first needed
    pos = 0
    first = item.match(text, 0)
    if first:
        list_item(first)
    skip = first.end() if first else 0  # a full stop of the mark itself ends nothing
    while m := mark.search(text, pos):
        kind, i, j = m.lastgroup, m.start(), m.end()
        pos = j
        if kind == "brk":
            nxt = item.match(text, j)
            if breaks(m) > 1 or nxt:
                emit(i)
                limit = -1
                if nxt:
                    skip = nxt.end()
                    list_item(nxt)
                elif breaks(m) > 1:
                    levels.clear()
            elif not stack and i > start and "฀" <= text[i - 1] <= "๿" and j < n and "฀" <= text[j] <= "๿":
                emit(i)  # a wrapped blank between two Thai sentences
            continue
        if i < skip:
            pos = max(pos, skip) if kind == "end" else pos
            continue
        if kind == "thai":
            if not stack:
                emit(i)
            continue
        c = text[i]
        if kind == "both":
            closes = any(c in closing for closing, _, _ in stack)
            kind = "close" if closes else "open"
            if c == '"' and not closes and i > 0 and text[i - 1].isdigit():
                continue  # inches
        if kind == "open":
            if limit < i:
                limit = block_end(i)
            closing = CLOSE_OF[c]
            if any(text.find(x, j, limit) >= 0 for x in closing):  # a mark that never closes opens nothing
                stack.append((closing, not text[start:i].strip() or (start < skip and not text[skip:i].strip()), i))
            continue
        if kind == "close":
            while stack and c not in stack[-1][0] and any(c in s[0] for s in stack):
                stack.pop()
            if not (stack and c in stack[-1][0]):
                continue
            _, at_start, _ = stack.pop()
            if stack:
                continue
            k = i - 1
            while k > start and (text[k].isspace() or text[k] in CLOSERS):
                k -= 1
            if text[k] not in ".!?。｡．！？।॥؟۔…" and not (text[k] == ";" and k and "Ͱ" <= text[k - 1] <= "Ͽ"):
                continue
            while j < n and text[j] in CLOSERS and text[j] != "“":
                j += 1
            if _closed_ends(text, j, n, at_start, caseless):
                emit(j)
            pos = j
            continue
        # a terminator
        run = m.group()
        if stack:
            continue
        # closing marks without an opening belong to the sentence
        e = j
        while e < n and text[e] in "»”」』)）]】》":
            e += 1
        nxt = e
        while nxt < n and text[nxt].isspace():
            nxt += 1
        if nxt >= n:
            break
        spaced = nxt > e
        follows = text[nxt]
        ellipsis = run.startswith(("..", "…")) and run.strip(".…") == ""
        if ellipsis:
            k = nxt
            while k < n - 1 and text[k] in "«„“\"「『(（[¿¡":
                k += 1
            if not text[k].isupper():
                continue
            if not spaced and run[0] == ".":
                continue
        elif run == ".":
            if not spaced and not _run_on(text, i, nxt, n):
                continue
            if spaced and _holds(text, i, start, nxt, n, tries, begun):
                continue
        elif run == "．" and i and text[i - 1].isdigit() and j < n and text[j].isdigit():
            continue
        elif run[-1] in "!?." and not spaced and follows.isascii() and not follows.isupper():
            continue
        elif run == ";" and not spaced and follows.isascii():
            continue
        emit(e)
        pos = e
    emit(n)
    return spans


def _opens(text: str, k: int, n: int) -> bool:
    """Whether a sentence of a script with capitals may open at k."""
    while k < n - 1 and text[k] in "«„“\"「『(（[¿¡#*-•":
        k += 1
        while k < n - 1 and text[k].isspace():
            k += 1
    c = text[k]
    if c.isupper() or c.istitle():
        return True
    return _symbol(text, k) or (not c.isascii() and c.isalpha() and not c.islower())


def _symbol(text: str, k: int) -> bool:
    """Whether a word of two or three small consonants stands at k, which opens a sentence as the symbol of a quantity ("dt", "dx")."""
    e = k
    while e < len(text) and text[e].isalpha() and e - k < 4:
        e += 1
    word = text[k:e]
    return 2 <= len(word) <= 3 and word.isascii() and word.islower() and not set(word) & set("aeiouy") and word not in UNITS


def _run_on(text: str, dot: int, nxt: int, n: int) -> bool:
    """Whether a sentence ends at a full stop with no blank behind it: a word, then a capitalised word."""
    follows = text[nxt]
    if "\u3040" <= follows <= "\u9fff":
        return not text[dot - 1 : dot].isascii()
    word = text[max(0, dot - 2) : dot]
    return follows.isupper() and nxt + 1 < n and (text[nxt + 1].islower() or text[nxt + 1].isspace() or text[nxt + 1] in "'’") and len(word) == 2 and (word.islower() and word.isalpha() or word[-1].isdigit() or word[-1] in CLOSERS)


def _a_name(text: str, begin: int, start: int, nxt: int, end: int) -> bool:
    """Whether a title goes on as a name: the word behind is capitalised and doesn't open a sentence, and none of several letters in capitals stands before (headings)."""
    word = text[nxt:end]
    if word.lower() in OPENERS or (len(word) > 1 and word.isupper()):
        return False
    k = begin
    while k > start and text[k - 1].isspace():
        k -= 1
    return not (k > start and text[k - 1].isdigit())  # behind a number it is a unit


def _holds(text: str, dot: int, start: int, nxt: int, n: int, tries: tuple[dict, dict], begun: set) -> bool:
    """Whether the full stop at `dot`, with a blank behind it, leaves the sentence open."""
    root, names = tries
    kind, _ = _abbreviation(text, dot, start, root)
    if kind == 1:
        return True
    if kind == 3 and text[nxt].isdigit():
        return True
    named, begin = _abbreviation(text, dot, start, names)
    if named and text[begin].isupper() and text[nxt].isupper():
        e = nxt
        while e < n and text[e].isalpha():
            e += 1
        if named == 4 and not (kind and dot - begin <= 2) and _a_name(text, begin, start, nxt, e):
            return True
        if named == 5 and text[nxt:e].lower() not in OPENERS:
            return True
    a, _ = _word_before(text, dot, start)
    word = text[a:dot]
    e = nxt
    while e < n and text[e].isalpha():
        e += 1
    if text[e : e + 1] == "." and len(word) <= 3 and f"{word}.{text[nxt:e]}".lower() in begun:
        return True  # the first part of an abbreviation of several
    k = a
    while k > start and text[k - 1].isspace():
        k -= 1
    if kind == 2:
        if word.lower() in ("co", "sr", "sra", "jr", "max") and not word[0].isupper():
            return False
        return not _opens(text, nxt, n)
    if len(word) == 1 and word.isupper() and word.isascii() and (a == start or text[a - 1].isspace()) and not (k > start and text[k - 1].isdigit()):
        return text[nxt].isupper()  # an initial; behind a number it is a unit
    if word.isdigit() and len(word) <= 2 and text[a - 1 : a] not in (",", "."):
        c, d = _word_before(text, k, start)
        if c < d and text[c:d].lower() in ORDINAL_LEADS and text[nxt].isalpha():
            return True
    return False


def _closed_ends(text: str, j: int, n: int, at_start: bool, caseless) -> bool:
    """Whether a sentence ends behind a quotation or bracket that closed at j with a terminator within."""
    nxt = j
    while nxt < n and text[nxt].isspace():
        nxt += 1
    if nxt >= n:
        return True
    c = text[nxt]
    if c in ",;:.!?，、；：。！？،؛।·—–":
        return False
    if caseless.match(c):  # no capitals tell: only a quotation that is a sentence of its own ends here
        if "가" <= c <= "힣" and nxt == j:
            return False  # a particle
        return at_start and not (nxt == j and c in "とっ")
    if c.islower():
        return _symbol(text, nxt)
    return at_start or _opens(text, nxt, n)


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id_col, sentence_no, start_char, end_char, list_level[, sentence]), one row per sentence, in order from 0.

    Texts are processed whole. Null, empty and blank texts have no rows; rows of the same id are
    split each on its own.
    """
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "sentence_no", "start_char", "end_char", "list_level", *(["sentence"] if with_text else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, begin, end, level, said = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b, depth) in enumerate(sentence_spans(text)):
                    at.append(row)
                    number.append(k)
                    begin.append(a)
                    end.append(b)
                    level.append(depth)
                    if with_text:
                        said.append(text[a:b])
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(level, pa.int32())]
            if with_text:
                columns.append(pa.array(said, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", sentence string" if with_text else ""
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"`{id_col}` {kind}, sentence_no int, start_char bigint, end_char bigint, list_level int{more}")
