"""Text decoded with the wrong character encoding: found, and restored by round trips.

Every line is re-encoded under candidate encodings, strictly decoded as others, and the result is
taken if its garbling cost is lower by a margin; this repeats for nested layers. The cost is that of
a character-pair model counted over the lines of the table that no round trip improves, plus what is
strange in any language, so that a large garbled share doesn't become the norm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.runtime import durable

#: Encodings a text may have been written in or read with.
ENCODINGS = (
    "latin-1 cp1252 utf-8 cp437 cp850 cp852 mac-roman iso8859-15 cp1250 iso8859-2 cp1251 koi8-r cp866 iso8859-5 cp1253 cp1254 cp1257 "
    "gb18030 big5 cp932 euc_jp euc_kr cp037 cp500 cp273 cp1026 cp1140"
).split()
#: Those that leave ASCII as it is and have one byte a character, and those that don't have letters where ASCII has them.
SINGLE = "latin-1 cp1252 cp437 cp850 cp852 mac-roman iso8859-15 cp1250 iso8859-2 cp1251 koi8-r cp866 iso8859-5 cp1253 cp1254 cp1257".split()
EBCDIC = "cp037 cp500 cp273 cp1026 cp1140".split()
#: Nats by which a round trip must lower the cost of a line.
MARGIN = 3.0
#: Weight of what is strange in any language next to the corpus.
WEIGHT = 1.0
#: Slots of each of two rows of pair counts, of which the smaller count holds; the model's size is fixed, however many characters the corpus has.
PAIR_SLOTS = 1 << 20
CHAR_SLOTS = 1 << 16
#: Weight of the single-character model where a pair is rare.
BACKOFF = 2.0
#: Entries of each store of a worker (lines, pairs of characters), which starts afresh when full. What is stored can be worked out again, so results don't depend on it.
MEMORY = 200_000
#: Garbled lines that a worker may hold: so many, of so many characters together. Beyond, texts get theirs by a join.
HELD_LINES, HELD_CHARS = 200_000, 16 << 20

# Digits with bytes above ASCII on both sides may belong to a multi-byte character, so they stay.
_DIGITS, _BLANKS, _RULERS = re.compile(r"(?<![0-9])(?:[0-9]++(?![^\x00-\x7f])|(?<![^\x00-\x7f])[0-9]++)"), re.compile(r"[ \t\r\n]+"), re.compile(r"([^\w\s])\1+")
_BREAK = re.compile(r"(\r\n|\n|\r)")
_WORD = (1 << 64) - 1
_CONTROL = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f\\ufffd\\ue000-\\uf8ff]")


def normal_line(line: str) -> str:
    """The line with numbers, blanks and runs of a mark made alike, as the model sees it."""
    return _RULERS.sub(r"\1", _BLANKS.sub(" ", _DIGITS.sub("9", line))).strip(" ")


def _pairs(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the first characters and, twice over, of the pairs of a normal line, its ends included."""
    codes = np.frombuffer(f"\x02{line}\x03".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (codes[:-1] % CHAR_SLOTS).astype(np.int64), ((mixed >> np.uint64(44)) % PAIR_SLOTS).astype(np.int64), ((mixed >> np.uint64(20)) % PAIR_SLOTS).astype(np.int64)


def _pair_slots(a: int, b: int) -> tuple[int, int]:
    """The two slots of one pair, as _pairs has them."""
    mixed = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) & _WORD
    mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & _WORD
    return (mixed >> 44) % PAIR_SLOTS, (mixed >> 20) % PAIR_SLOTS


def _script(c: str) -> str:
    if c < "\x80":
        return "Latin" if c.isalpha() else ""
    if not c.isalpha() or c in "ªº":
        return ""
    return "Latin" if c < "\u0250" else "Greek" if c < "\u0400" else "Cyrillic" if c < "\u0530" else "other"


def strangeness(pair: str) -> float:
    """Nats by which a pair of characters is unlikely in any language, whatever the corpus holds: what a garbled share can't outvote."""
    a, b = pair
    if a < "\x80" and b < "\x80":
        return 0.0
    sa, sb = _script(a), _script(b)
    cost = 0.0
    if b >= "\x80":
        if _CONTROL.match(b) or "\u2500" <= b <= "\u25ff" or "\uff61" <= b <= "\uff9f":
            cost += 4.0  # control characters, box drawing, half-width kana
        elif not sb:
            cost += 1.0
        else:
            cost += 0.25 if sb == "Cyrillic" else 0.5
    if sa and sb:
        if sa != sb:
            cost += 4.0
        elif a.islower() and b.isupper():
            cost += 3.0
        elif sa == "Latin" and a >= "\x80" and b >= "\x80":
            cost += 1.5
    elif (sa and b >= "\x80" or sb and a >= "\x80") and (a if sb else b) not in "°²³–—’“”«»：，。、；（）·ªº…":
        cost += 2.0  # a sign within or beside a word
    return WEIGHT * cost


class PairModel:
    """Cost of a line in nats under counts of characters and character pairs."""

    def __init__(self, chars: np.ndarray, pairs: np.ndarray, pairs2: np.ndarray) -> None:
        self.chars, self.pairs, self.pairs2, self.total = chars, pairs, pairs2, float(chars.sum()) + 1.0
        self.memory: dict[str, float] = {}
        self.strange: dict[str, frozenset[int]] = {}
        #: Normal lines that no round trip makes cheaper.
        self.clean: set[str] = set()
        self.known = {chr(slot) for slot in np.flatnonzero(chars)} | set("0123456789 \t\r\n")
        #: What a character that the corpus doesn't have costs at least.
        self.unknown = math.log((self.total + 0.01 * CHAR_SLOTS) / 0.01)

    def _store(self) -> dict[str, float]:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        return self.memory

    def _known_cost(self, pair: str) -> float:
        one = self.memory.get(pair)
        if one is None:
            one = self.memory[pair] = self._pair_cost(pair)
        return one

    def cost(self, line: str, limit: float = math.inf) -> float:
        """Cost of a line; infinite as soon as it is known to reach the limit."""
        memory, cost, last = self._store(), 0.0, "\x02"
        for c in (*line, "\x03"):
            one = memory.get(last + c)
            if one is None:
                one = memory[last + c] = self._pair_cost(last + c)
            cost += one
            if cost >= limit:
                return math.inf
            last = c
        return cost

    def unknown_bytes(self, encoding: str) -> frozenset[int]:
        """Bytes from 128 on that a single-byte encoding has no character for, or one that the corpus doesn't have."""
        found = self.strange.get(encoding)
        if found is None:
            chars = ((k, bytes([k]).decode(encoding, "ignore")) for k in range(128, 256))
            found = self.strange[encoding] = frozenset(k for k, c in chars if not c or c not in self.known)
        return found

    def _pair_cost(self, pair: str) -> float:
        a, b = map(ord, pair)
        row, row2 = _pair_slots(a, b)
        alone = (int(self.chars[b % CHAR_SLOTS]) + 0.01) / (self.total + 0.01 * CHAR_SLOTS)
        found = min(int(self.pairs[row]), int(self.pairs2[row2]))
        return strangeness(pair) - math.log((found + BACKOFF * alone) / (int(self.chars[a % CHAR_SLOTS]) + BACKOFF))

    def garbled(self, line: str) -> bool:
        """Whether some round trip lowers the line's cost by the margin."""
        return self.step(line, MARGIN)[0] >= MARGIN

    def step(self, line: str, enough: float = math.inf) -> tuple[float, tuple[str, str] | None, str]:
        """(drop, (read with, written in), text) of the best round trip, or of the first that drops the cost enough; drop 0 and no pair if none is cheaper.

        Where both encodings share ASCII the trip is tried on the normal line, as digits and blanks stay
        what they are; between those of one byte a character it exchanges single characters, so only the
        pairs around these are weighed.
        """
        alike = normal_line(line)
        text = f"\x02{alike}\x03"
        around = Counter((x, y) for x, y in zip(text, text[1:]) if x > "\x7f" or y > "\x7f")
        base = self.cost(alike)
        at_stake = sum(n * self._known_cost(x + y) for (x, y), n in around.items())
        still = base - at_stake  # what stays as it is
        high = "".join(sorted({c for c in alike if c > "\x7f"}))
        controls, blanks = len(_CONTROL.findall(line)), alike.count(" ")  # an inner layer may hold control characters, but not more than the outer one
        least, how, best = base, None, line

        def take(cost: float, read: str, written: str) -> None:
            nonlocal least, how, best
            if cost < least:
                try:
                    whole = line.encode(read).decode(written)
                except UnicodeError:
                    return
                if whole != line and len(_CONTROL.findall(whole)) <= controls:
                    least, how, best = cost, (read, written), whole

        def whole_trip(data: bytes, read: str, written: str) -> None:
            if written in EBCDIC and read not in EBCDIC and blanks > controls:
                return  # its blanks would become control characters
            try:
                text = data.decode(written)
            except UnicodeError:
                return
            if text in seen:
                return
            seen.add(text)
            if len(set(text) - self.known) * self.unknown <= least and len(_CONTROL.findall(text)) <= controls:
                moved = read in EBCDIC or written in EBCDIC  # else digits, blanks and rulers stay what they were
                take(self.cost(normal_line(text) if moved else text, least), read, written)

        seen, exchanged, coded = {alike}, {high}, set()
        for read in ENCODINGS:
            try:
                data = (high if read in SINGLE else line if read in EBCDIC else alike).encode(read)
            except UnicodeError:
                continue
            if (read in SINGLE, data) in coded:
                continue
            coded.add((read in SINGLE, data))
            if base - least >= enough:
                break
            exact, bytes_ = line.encode(read), set(data)
            whole = exact if read in EBCDIC else alike.encode(read)
            for written in ENCODINGS if high or read in EBCDIC else EBCDIC:
                if read not in SINGLE or written not in SINGLE:
                    whole_trip(exact if written in EBCDIC else whole, read, written)
                    continue
                if len(bytes_ & self.unknown_bytes(written)) * self.unknown >= at_stake:
                    continue  # what it saves, its strange characters cost again
                try:
                    to = data.decode(written)
                except UnicodeError:
                    continue
                if to in exchanged:
                    continue
                exchanged.add(to)
                limit = least - still
                if len(set(to) - self.known) * self.unknown > limit:
                    continue
                table, cost = dict(zip(high, to)), 0.0
                for (x, y), n in around.items():
                    pair = table.get(x, x) + table.get(y, y)
                    cost += n * self._known_cost(pair)
                    if cost >= limit:
                        break
                else:
                    take(still + cost, read, written)
        return base - least, how, best

    def _greedy(self, line: str) -> tuple[list[tuple[str, str]], str]:
        """Round trips until none lowers the cost by the margin. As costs aren't negative, there is an end, however many layers there are."""
        steps: list[tuple[str, str]] = []
        while (alike := normal_line(line)) not in self.clean:
            drop, how, text = self.step(line)
            if how is None or drop < MARGIN:
                if how is None:
                    if len(self.clean) >= MEMORY:
                        self.clean.clear()
                    self.clean.add(alike)
                break
            steps.append(how)
            line = text
        return steps, line

    def chain(self, line: str) -> list[tuple[str, str]]:
        """The round trips, in order, that together lower the line's cost the most.

        Bytes hardly ever are UTF-8 by accident, but an inner layer of it may look worse than another
        encoding's text. So of a garbled line the trips to UTF-8 are followed as far as they go, and from
        each layer the cheapest trips on; the cheapest end is taken.
        """
        steps, end = self._greedy(line)
        if not steps:
            return steps
        cost, path, text = self.cost(normal_line(end)), [], line
        while True:
            inner: dict[str, str] = {}
            for read in ENCODINGS:
                try:
                    inner.setdefault(text.encode(read).decode("utf-8"), read)
                except UnicodeError:
                    continue
            inner.pop(text, None)
            if not inner:  # every layer of UTF-8 makes the text shorter, so there is an end
                return steps
            text = min(inner, key=lambda t: (self.cost(normal_line(t)), t))
            path.append((inner[text], "utf-8"))
            rest, end = self._greedy(text)
            if (other := self.cost(normal_line(end))) < cost:
                steps, cost = [*path, *rest], other


class _Alike:
    """normal_line with the lines met lately remembered."""

    def __init__(self) -> None:
        self.memory: dict[str, str] = {}

    def __call__(self, line: str) -> str:
        found = self.memory.get(line)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = self.memory[line] = normal_line(line)
        return found


def _lines(df: DataFrame, text_col: str) -> DataFrame:
    """(line, raw, n): the normal lines of all texts, of each the smallest line that is alike, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            if exact:
                raw = list(exact)
                yield pa.RecordBatch.from_arrays([pa.array([normal_line(x) for x in raw], pa.string()), pa.array(raw, pa.string()), pa.array(list(exact.values()), pa.int64())], names=["line", "raw", "n"])
            exact.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                exact.update(filter(None, _BREAK.split(text or "")[::2]))
                if len(exact) > MEMORY:
                    yield from flush()
        yield from flush()

    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "line string, raw string, n bigint")
    return counted.where("line <> ''").groupBy("line").agg(F.min("raw").alias("raw"), F.sum("n").alias("n"))


_PAGE = 1 << 12


def _counted(lines: DataFrame, judge=None) -> PairModel:
    """The model of counted lines; with judge (a broadcast model) only of those that no round trip improves under it.

    Counts come as pages of _PAGE slots, summed over the cluster: what reaches the driver is CHAR_SLOTS + 2 PAIR_SLOTS numbers at most.
    """
    sizes = (CHAR_SLOTS, PAIR_SLOTS, PAIR_SLOTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(n, np.int64) for n in sizes]
        for batch in batches:
            for line, raw, n in zip(*(c.to_pylist() for c in batch.columns)):
                if judge is not None and judge.value.garbled(raw):
                    continue
                for into, slots in zip(counts, _pairs(line)):
                    np.add.at(into, slots, n)
        rows = [(k, p, page.tobytes()) for k, of in enumerate(counts) for p, page in enumerate(of.reshape(-1, _PAGE)) if page.any()]
        kinds, pages, data = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(pages, pa.int32()), pa.array(data, pa.binary())], names=["kind", "page", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_PAGE, np.int64)
        for data in table.column("data").to_pylist():
            total += np.frombuffer(data, np.int64)
        return pa.table({"kind": table.column("kind")[:1], "page": table.column("page")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    schema = "kind int, page int, data binary"
    out = [np.zeros(n, np.int64) for n in sizes]
    for k, p, data in lines.select("line", "raw", "n").mapInArrow(count, schema).groupBy("kind", "page").applyInArrow(add, schema).collect():
        out[k][p * _PAGE : (p + 1) * _PAGE] = np.frombuffer(data, np.int64)
    return PairModel(*out)


def _distinct_lines(df: DataFrame, text_col: str) -> DataFrame:
    return durable(_lines(df, text_col)).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "line")


def _trained(lines: DataFrame) -> PairModel:
    first = _counted(lines)
    model = _counted(lines, lines.sparkSession.sparkContext.broadcast(first))
    return model if model.chars.any() else first


def train(df: DataFrame, text_col: str = "text") -> PairModel:
    """The model of the lines of all texts, but for those that a round trip improves under a first model, of all lines.

    So frequent garbling doesn't become the norm.
    """
    return _trained(_distinct_lines(df, text_col))


def _verdicts(lines: DataFrame, model) -> DataFrame:
    """(line, how): the normal lines that round trips improve, each searched once, by the smallest line that is alike; how holds "read with>written in", layer by layer."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(line, [f"{r}>{w}" for r, w in steps]) for line, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (steps := model.value.chain(raw))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([h for _, h in found], pa.list_(pa.string()))], names=["line", "how"])

    return lines.select("line", "raw").mapInArrow(search, "line string, how array<string>")


def _restore(line: str, steps: list[tuple[str, str]]) -> str | None:
    for read, written in steps:
        try:
            line = line.encode(read).decode(written)
        except UnicodeError:
            return None
    return line


def mend(text: str, how_of, model: PairModel, alike=normal_line) -> tuple[int, int, str, str] | None:
    """(bad lines, restored lines, text with these mended, how) of a text, None if no line is bad; how_of gives the verdict on a normal line, None if it is clean."""
    parts = _BREAK.split(text)
    bad = mended = 0
    how: dict[str, None] = {}
    for i in range(0, len(parts), 2):
        line = parts[i]
        if not line or line.isspace():
            continue
        steps = how_of(alike(line))
        if not steps:
            bad += "\ufffd" in line
            continue
        bad += 1
        pairs = [tuple(h.split(">")) for h in steps]
        fixed = _restore(line, pairs)
        if fixed is None:  # alike, but with other bytes
            pairs = model.chain(line)
            fixed = _restore(line, pairs)
        if fixed is not None and fixed != line:
            parts[i] = fixed
            mended += "\ufffd" not in fixed
            how[" ".join(f"{r}>{w}" for r, w in pairs)] = None
    return (bad, mended, "".join(parts), "; ".join(how)) if bad else None


def repair(df: DataFrame, id_col: str = "header_id", text_col: str = "text", held: tuple[int, int] = (HELD_LINES, HELD_CHARS)) -> DataFrame:
    """(id_col, bad_lines, restored_lines, restored, how): the garbled texts, one row per row of df that has one.

    bad_lines counts the lines that a round trip improves or that hold a replacement character;
    restored_lines those that were restored wholly. restored is the whole text with these lines
    mended and the others as they were; how lists the round trips ("read with>written in"), layer
    by layer. Null and empty texts are never garbled. Model and search see every line of every text;
    each line that differs in more than digits, blanks and rulers is searched once, so the order of
    rows doesn't matter.
    """
    lines = _distinct_lines(df, text_col)
    model = df.sparkSession.sparkContext.broadcast(_trained(lines))
    bad = durable(_verdicts(lines, model))
    size = bad.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("c")).first()
    kind = dict(df.dtypes)[id_col]
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if size["n"] <= held[0] and size["c"] <= held[1]:
        known = df.sparkSession.sparkContext.broadcast({r["line"]: r["how"] for r in bad.collect()})
        work = _mender(model, id_col, lambda _: known.value.get)
        return texts.mapInArrow(work, f"`{id_col}` {kind}, bad_lines int, restored_lines int, restored string, how string")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = _Alike()
        for batch in batches:
            of, line = [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {alike(x) for x in _BREAK.split(text)[::2]}
                of += [t] * len(found)
                line += found
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(line, pa.string())], names=["t", "line"])

    texts = texts.where("text <> ''").withColumn("t", F.sha2("text", 256))
    each = texts.select("t", "text").dropDuplicates(["t"]).mapInArrow(keys, "t string, line string")
    of_text = each.join(bad, "line").groupBy("t").agg(F.collect_list(F.struct("line", "how")).alias("found"))  # as long as a text at most
    work = _mender(model, id_col, lambda found: {f["line"]: f["how"] for f in found or ()}.get)
    return texts.join(of_text, "t", "left").select("id", "text", "found").mapInArrow(work, f"`{id_col}` {kind}, bad_lines int, restored_lines int, restored string, how string")


def _mender(model, id_col: str, verdicts):
    """Mends batches of (id, text[, found]); verdicts(found) gives the lookup of a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = _Alike()
        for batch in batches:
            at, found = [], []
            extra = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for row, (text, f) in enumerate(zip(batch.column(1).to_pylist(), extra)):
                if text and (got := mend(text, verdicts(f), model.value, alike)):
                    at.append(row)
                    found.append(got)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "bad_lines", "restored_lines", "restored", "how"])

    return work
