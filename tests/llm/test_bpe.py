import os
import random

import pytest

from lithoframe.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no vocabulary here")


def texts():
    r = random.Random(2)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x400, 0x460), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640), (9, 10, 13, 32, 0xA0, 0x3000)]
    made = ["".join(chr(r.choice(r.choice(pools))) for _ in range(r.randrange(40))) for _ in range(500)]
    return [*made, "", " ", "\n\n  x", "<|endoftext|>", "don't we'll", "a" * 5000, "naïve café ≤ 154 ns", "第887道是坏道吗？", "👷🏽‍♂️🚢"]


def test_same_ids_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    own = bpe.load(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    for text in texts():
        assert own.encode(text) == t.encode(text, add_special_tokens=False).ids, text


def test_round_trip_and_defined_cases(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts())] + [(900, None, 5), (901, "", 5), (902, "twice", 5), (902, "twice", 5), (None, "no id", 5)], "doc_id bigint, text string, ids int")
    ids = bpe.encode_texts(df)
    assert ids.count() == df.count()
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got[900] == [] and got[901] == []
    back = sorted((r["doc_id"] or -1, r["text"]) for r in bpe.decode_ids(ids).collect())
    assert back == sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    assert n[900] == 0 and n[3] == len(got[3])
    assert bpe.encode_texts(df.where("false")).count() == 0


def test_decode_unknown_ids():
    own = bpe.load(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    assert own.decode(None) == "" and own.decode([10**9]) == "" and own.decode(own.encode("é")[:1]) in ("é", "�")
