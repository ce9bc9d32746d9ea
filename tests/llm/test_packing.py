import random
from collections import Counter, defaultdict
from itertools import combinations

from recitant.llm import packing as P


def test_filling_is_the_best():
    chance = random.Random(6)
    for _ in range(60):
        items = [chance.randint(1, 12) for _ in range(chance.randint(0, 8))]
        gap, counts = chance.randint(0, 30), Counter(items)
        best = max(sum(c) for r in range(len(items) + 1) for c in combinations(items, r) if sum(c) <= gap)
        got = P.best_filling(gap, counts, sorted(counts, reverse=True))
        assert sum(got) == best and not Counter(got) - counts


def test_plan_uses_every_item_once():
    chance = random.Random(7)
    histogram = {s: chance.randint(1, 50) for s in chance.sample(range(1, 200), 60)}
    for capacities in ([200], [64, 128, 200]):
        used = Counter()
        for capacity, times, need in P.plan(histogram, capacities):
            held = sum(s * k for s, k in need.items())
            assert held <= capacity and all(held > c for c in capacities if c < capacity)
            for s, k in need.items():
                used[s] += k * times
        assert used == histogram
    assert P.plan({}, [10]) == []


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ITEMS", 50)  # several salts
    chance = random.Random(8)
    sizes = {k: chance.choice([7, 7, 7, 13, 40, 64, 65, 200, 0]) for k in range(800)}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()] + [(9000, None), (9001, -3)], "doc_id bigint, n_tokens int")
    kinds = spark.createDataFrame([("small", 64), ("large", 130)], "container_kind string, capacity_tokens int")
    rows = P.pack(df, "doc_id", "n_tokens", kinds).collect()
    for kind, capacity in (("small", 64), ("large", 130)):
        own = [r for r in rows if r.container_kind == kind]
        held, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            held[r.container_id] += r.n_tokens
            pieces[r.doc_id].append((r.piece_no, r.start_token, r.n_tokens))
        assert max(held.values()) <= capacity
        assert {k for k, n in sizes.items() if n > 0} == set(pieces)
        for k, parts in pieces.items():
            parts.sort()
            assert sum(n for _, _, n in parts) == sizes[k] and (len(parts) == 1 or sizes[k] > capacity)
            assert [s for _, s, _ in parts] == [sum(n for _, _, n in parts[:i]) for i in range(len(parts))]
        assert len(held) * capacity - sum(held.values()) <= 0.06 * sum(held.values())
    joint = P.pack(df, "doc_id", "n_tokens", kinds, joint=True).collect()
    assert {r.doc_id for r in joint} == {k for k, n in sizes.items() if n > 0}
    assert P.pack(df.where("false"), "doc_id", "n_tokens", kinds).count() == 0
    assert P.pack(df, "doc_id", "n_tokens", kinds.where("false")).count() == 0
