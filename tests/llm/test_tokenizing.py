import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recitant.llm import tokenizing as T

PATH = os.path.join(T.TOKENIZERS, T.BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
HARD = ["", " ", "  a  b \n\n c", "don't  I'll  ", "naïve 你好，世界。 สวัสดี 👩‍🔬🇺🇪", "<|endoftext|> x", "a​b c\r\n\r\n d", "१२३ ३.५", "\x00\x01", "x" * 3000, " \n \n", "'s 's ''s"]


def direct(text):
    return T._tokenizer(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pieces_give_the_library_ids(text):
    flat, counts = T.PieceTable(PATH).encode([text])
    assert flat.tolist() == direct(text) and counts.tolist() == [len(flat)]


def test_table_may_be_emptied(monkeypatch):
    monkeypatch.setattr(T, "TABLE_PIECES", 3)
    flat, counts = T.PieceTable(PATH).encode(HARD)
    assert flat.tolist() == [x for t in HARD for x in direct(t)]


def test_round_trip_and_defaults(spark):
    rows = [(k, t, "extra") for k, t in enumerate([*HARD, None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    coded = T.encode(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {k: direct(t) if t else [] for k, t, _ in rows}
    assert {r.doc_id: r.text for r in T.decode(coded, "doc_id", "ids").collect()} == {k: t or "" for k, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert T.encode(df.where("false"), "doc_id", "text").count() == 0


def test_offsets_cover_split_characters(spark):
    text = "a 👩‍🔬 naïve 龘"
    row = T.encode_with_offsets(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()
    assert row.ids == direct(text) and row.starts[0] == 0 and row.ends[-1] == len(text)
    table = T.token_bytes(PATH)
    for i, a, b in zip(row.ids, row.starts, row.ends):
        assert table[i] in text[a:b].encode() and b > a
    assert T.character_spans(np.array([], dtype=int), b"", np.array([1]))[0].size == 0


def test_decoding_a_cut_character(spark):
    ids = direct("龘")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids[:1]), (2, []), (3, None)], "k int, ids array<int>")
    assert {r.k: r.text for r in T.decode(df, "k", "ids").collect()} == {1: "�", 2: "", 3: ""}
