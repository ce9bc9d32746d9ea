import random

import pyarrow as pa
import pytest

from recitant.llm import splitting as S


def check(text, pieces, size, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert c == b - overlap and d > b
    assert all(b - a <= size for a, b in pieces)


def sample(chance, n):
    return "".join(chance.choice(["word ", "Ünï ", "end. ", "x", "\n", "\n\n", "汉字。", "é"]) for _ in range(n))


def spans(text, size, overlap, span=1 << 20, halo=1 << 14):
    """All pieces of a text, range by range, as ``pieces`` stitches them."""
    raw = S.encoded(text)
    item = S.Item(pa.BufferReader(b"head" + raw + b"tail"), 4, len(raw), span, halo)
    out, base = [], 0
    for no in range(max(1, -(-len(raw) // span))):
        chars, found = item.range(no, size, max(0, min(overlap, (size - 1) // 2)))
        for x in found:
            assert S.decoded((b"head" + raw)[x["from"] : x["to"]]) == text[base + x["a"] : base + x["b"]]
            out.append((base + x["a"], base + x["b"]))
        base += chars
    return out


def test_pieces_tile_the_text():
    chance = random.Random(2)
    for _ in range(120):
        text, size = sample(chance, chance.randint(20, 400)), chance.randint(5, 90)
        overlap = chance.randint(0, (size - 1) // 2)
        if len(text) > size:
            for span, halo in ((1 << 20, 1 << 14), (97, 30), (500, 8)):
                check(text, spans(text, size, overlap, span, halo), size, overlap)


def test_natural_cuts():
    text = "First sentence here. Second one is here.\n\nNew paragraph starts. And goes on and on."
    (_, end), *_ = spans(text, 60, 5)
    assert text[:end].endswith("here.") and text[end:].startswith("\n\nNew")
    assert spans("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]
    text = "e\u0301" * 30
    assert all(text[b : b + 1] != "\u0301" for _, b in spans(text, 11, 2))


def test_halos_widen_and_marks_stay_with_their_letters():
    text = ("word" * 40 + " ") * 30  # blanks lie further apart than the first halo
    assert all(text[b - 1] == " " or b == len(text) for _, b in spans(text, 400, 0, 700, 16))
    marked = "e\u0301\u0323" * 500  # no boundary in any range
    for span in (100, 101, 102, 333):
        assert all(marked[b : b + 1] not in ("\u0301", "\u0323") for _, b in spans(marked, 60, 0, span, 8))
        check(marked, spans(marked, 60, 3, span, 8), 60, 3)


def test_rows(spark):
    limits = spark.createDataFrame([("a", 10, 2), ("b", 1000, 5), ("c", 10, None)], "limit_id string, max_chars int, overlap_chars int")
    rows = [(1, "x" * 25, "a", "z"), (1, "x" * 25, "a", "z"), (2, "x" * 10, "a", "z"), (3, None, "a", "z"), (4, "y" * 25, "b", None), (5, "y" * 25, None, None), (6, "y" * 25, "none", None), (7, "", "a", None), (8, "é" * 11, "c", None)]
    df = spark.createDataFrame(rows, "k bigint, text string, limit_id string, path string")
    made = S.split_rows(df, limits, ["k"]).orderBy("k", "piece_no").collect()
    assert [(r.k, r.piece_no, r.n_pieces, r.piece_start, r.piece_end) for r in made] == [(1, 1, 3, 0, 10), (1, 2, 3, 8, 18), (1, 3, 3, 16, 25), (8, 1, 2, 0, 10), (8, 2, 2, 10, 11)]
    assert made[0].piece == "x" * 10 and made[4].piece == "é"
    assert S.split_rows(df.where("false"), limits, ["k"]).count() == 0


def test_long_rows_are_worked_on_in_ranges(spark):
    limits = spark.createDataFrame([("a", 900, 50)], "limit_id string, max_chars int, overlap_chars int")
    text = "Ünï word here. And another one.\n" * 120_000  # several ranges
    df = spark.createDataFrame([(1, text, "a")], "k bigint, text string, limit_id string")
    made = S.split_rows(df, limits, ["k"]).orderBy("piece_no").collect()
    check(text, [(r.piece_start, r.piece_end) for r in made], 900, 50)
    assert all(r.piece == text[r.piece_start : r.piece_end] for r in made) and [r.piece_no for r in made] == list(range(1, len(made) + 1))


@pytest.mark.parametrize("overlap", [0, 7])
def test_files_in_ranges(spark, tmp_path, overlap):
    chance = random.Random(4)
    text = sample(chance, 4000).lstrip()
    (tmp_path / "big one.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "small.txt").write_text("tiny", encoding="utf-8")
    rows = S.split_files(spark, [str(tmp_path)], 60, overlap, span=1000, halo=200).orderBy("piece_no").collect()
    assert {r.path.rpartition("/")[2] for r in rows} == {"big one.txt"}
    assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
    assert all(text[r.piece_start : r.piece_end] == r.piece for r in rows)
    check(text, [(r.piece_start, r.piece_end) for r in rows], 60, overlap)


def test_broken_bytes(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"abc \xff\xfe def " * 20)
    rows = S.split_files(spark, [str(tmp_path)], 50, 0, span=100, halo=20).orderBy("piece_no").collect()
    assert "".join(r.piece for r in rows) == "abc \ufffd\ufffd def " * 20
