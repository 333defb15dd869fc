import random
from collections import Counter, defaultdict

import pytest

from lithoframe.llm.packing import pack, plan_slots


def check(sizes, got, capacity):
    room, parts = defaultdict(int), defaultdict(list)
    for doc, piece, start, n, container in got:
        room[container] += n
        parts[doc].append((piece, start, n))
    assert all(v <= capacity for v in room.values())
    for doc, pieces in parts.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert sum(n for _, _, n in pieces) == max(0, sizes[doc] or 0)
        assert len(pieces) == max(1, -(-(sizes[doc] or 0) // capacity))
        assert all(start == sum(n for _, _, n in pieces[:i]) for i, (_, start, _) in enumerate(pieces))
    assert set(parts) == set(sizes)
    return room


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    r = random.Random(seed)
    cap = r.choice([7, 50, 512])
    hist = Counter(r.choice([r.randint(1, cap), cap // 3 + 1, 1 + cap // 7]) for _ in range(2000))
    slots, n = plan_slots(dict(hist), cap)
    room, placed = Counter(), Counter()
    for length, rank, items, first, each in slots:
        assert placed[length] == rank
        placed[length] += items
        for k in range(items):
            room[first + k // each] += length
    assert placed == hist and max(room.values()) <= cap and set(room) == set(range(n))
    total = sum(k * v for k, v in hist.items())
    assert n >= -(-total // cap)
    # best fit, longest first, never needs more than 11/9 of the best and a few
    alone = sum(v for k, v in hist.items() if 2 * k > cap)
    assert n <= max(-(-total // cap), alone) * 11 / 9 + 6


def test_pack(spark):
    r = random.Random(9)
    sizes = {i: r.choice([0, 0, r.randint(1, 100), r.randint(1, 700), 37, None]) for i in range(900)}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in sizes.items()], "doc_id bigint, n_tokens bigint, len int, rank int")
    budgets = spark.createDataFrame([(1, 100, "a"), (2, 512, "b"), (3, 0, "none"), (4, None, "none"), (None, 9, "none"), (2, 512, "again")], "budget_id int, capacity_tokens int, purpose string")
    out = pack(df, budgets).collect()
    assert {x["budget_id"] for x in out} == {1, 2}
    for b, cap in ((1, 100), (2, 512)):
        room = check(sizes, [tuple(x)[1:] for x in out if x["budget_id"] == b], cap)
        total = sum(v or 0 for v in sizes.values())
        assert max(room) + 1 <= -(-total // cap) * 1.05 + 1


def test_hot_length_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(7, 3)] * 500 + [(8, 0)] * 5, "doc_id bigint, n_tokens bigint")
    one = spark.createDataFrame([(1, 10, "x")], "budget_id int, capacity_tokens int, purpose string")
    out = pack(df, one).collect()
    assert len(out) == 505
    load = Counter()
    for x in out:
        load[x["container_id"]] += x["n_tokens"]
    assert max(load.values()) == 9 and len(load) == 167
    assert pack(df.where("false"), one).count() == 0 and pack(df, one.where("false")).count() == 0
