"""Byte-level BPE encoding and decoding of whole corpora with a public vocabulary.

Merges are applied per pre-token: its symbols form a doubly linked list, candidate merges wait in a
priority queue by merge rank, and entries whose symbols have changed since are skipped as stale.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are unless a caller says otherwise.
TOKENIZER_DIR = "/opt/tokenizers"
#: Splits a text into pre-tokens before any merge (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered with their ids by each worker; the store starts afresh when full.
MEMORY = 200_000


def _letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary file stands for: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """One byte-level vocabulary: ids of texts and texts of ids."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _letters(), model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.single = [0] * 256
        for letter, b in letters.items():
            self.single[b] = vocab[letter]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pieces = regex.compile(PATTERN).findall
        self.memory: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: a neighbour was merged since
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((merged, ids[k])):
                    heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], merged))):
                heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for a null or empty text.

        Strings of special tokens in the text are ordinary text. Lone surrogates, which UTF-8 can't
        hold, are encoded as the replacement character.
        """
        out: list[int] = []
        if not text:
            return out
        memory = self.memory
        for piece in self.pieces(text):
            got = memory.get(piece)
            if got is None:
                try:
                    data = piece.encode("utf-8")
                except UnicodeEncodeError:
                    data = piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")
                got = tuple(self.merge(data))
                if len(piece) <= 256:  # a long one is hardly met twice
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[piece] = got
            out.extend(got)
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids: their vocabulary strings in a row. Ids outside the vocabulary have none; bytes that aren't UTF-8 become U+FFFD."""
        known = self.bytes_of
        return b"".join(known.get(i, b"") for i in ids or ()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _served(df: DataFrame, tokenizer_dir: str, name: str) -> str:
    """Has Spark serve a vocabulary file to every executor; returns the name it goes by there."""
    path, sc = f"{tokenizer_dir}/{name}.json", df.sparkSession.sparkContext
    served = getattr(sc, "_lithoframe_files", set())
    if path not in served:
        sc.addFile(path)
        sc._lithoframe_files = served | {path}
    return f"{name}.json"


def _here(file: str) -> ByteBpe:
    return load(SparkFiles.get(file))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, ids array<int>), one row per row of df; null and empty texts have the empty list. Texts are never cut."""
    file = _served(df, tokenizer_dir, name)
    kind = dict(df.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _here(file)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, n_tokens bigint), one row per row of df; 0 for null and empty texts."""
    file = _served(df, tokenizer_dir, name)
    kind = dict(df.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _here(file)
        for batch in batches:
            n = pa.array([len(bpe.encode(t)) for t in batch.column(1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[id_col, "n_tokens"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"`{id_col}` {kind}, n_tokens bigint")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, text), one row per row of df; a null or empty list has the empty text."""
    file = _served(df, tokenizer_dir, name)
    kind = dict(df.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _here(file)
        for batch in batches:
            text = pa.array([bpe.decode(i) for i in batch.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=[id_col, "text"])

    return df.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(work, f"`{id_col}` {kind}, text string")
