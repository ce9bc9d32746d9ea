import random

from recitant.operators import ranks


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 7)
    chance = random.Random(4)
    rows = [(chance.choice(["a", "b", None]), chance.choice([1, None]), chance.choice([None, *range(60)]), k, chance.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, h int, o int, k bigint, v int")
    for n, group in enumerate((["g"], ["g", "h"])):
        got = {r.k: (r.place, r.before) for r in ranks.with_sum_before(ranks.with_rank(df, group, "o", "k", "place"), group, "o", "k", "v", "before").collect()}
        for key in {r[: n + 1] for r in rows}:
            own = sorted((r for r in rows if r[: n + 1] == key), key=lambda r: (-1 if r[2] is None else r[2], r[3]))
            for place, r in enumerate(own, 1):
                assert got[r[3]] == (place, sum(x[4] for x in own[: place - 1]))
    assert ranks.with_rank(df.where("false"), ["g"], "o", "k", "p").count() == 0
