"""Problem 7: encoding of a corpus with a public byte-level BPE tokenizer, and its exact inverse.

Byte-level BPE first cuts a text into words and then merges inside each word. No word holds a blank that
follows a non-blank, so a text may be cut before every such blank run and its pieces encoded apart. The
pieces of natural text repeat, hence each Arrow batch hands only its unseen distinct pieces to the
tokenizers library and gathers the ids of all others from a table.

Defined results: a null and an empty text give an empty list; strings of special tokens are ordinary text;
every row gives one row; other columns pass unread.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..tables import spread

#: Folder of the public tokenizers' files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"

#: Pieces kept per Python worker before the table is emptied; bounds memory, changes no result.
TABLE_PIECES = 400_000

_pieces = re.compile(r"\s*\S+|\s+").findall


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class PieceTable(dict):
    """Piece to its ids as a tuple; unseen pieces are encoded in bulk."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def learn(self, pieces: set[str]) -> None:
        unseen = list(pieces.difference(self))
        if len(self) + len(unseen) > TABLE_PIECES:
            self.clear()
            unseen = list(pieces)
        for at in range(0, len(unseen), 4096):
            part = unseen[at : at + 4096]
            for piece, code in zip(part, _tokenizer(self.path).encode_batch(part, add_special_tokens=False)):
                self[piece] = tuple(code.ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        ids, counts = array("i"), np.zeros(len(texts), dtype=np.int64)
        for at in range(0, len(texts), 256):
            cut = [_pieces(t) for t in texts[at : at + 256]]
            self.learn(set(chain.from_iterable(cut)))
            before = len(ids)
            for k, pieces in enumerate(cut, at):
                ids.extend(chain.from_iterable(map(self.__getitem__, pieces)))
                counts[k] = len(ids) - before
                before = len(ids)
        return np.frombuffer(ids, dtype=np.int32) if ids else np.zeros(0, dtype=np.int32), counts


@lru_cache(maxsize=4)
def piece_table(path: str) -> PieceTable:
    """One table per Python worker and tokenizer."""
    return PieceTable(path)


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, and the byte it stands for.

    Printable Latin-1 stands for itself; the other bytes take the code points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by reversing the byte table; special tokens are their own UTF-8."""
    model = json.load(open(path, encoding="utf-8"))
    table = byte_characters()
    out = [b""] * (1 + max(chain(model["model"]["vocab"].values(), (t["id"] for t in model["added_tokens"]))))
    for token, k in model["model"]["vocab"].items():
        out[k] = bytes(table[c] for c in token)
    for token in model["added_tokens"]:
        out[token["id"]] = token["content"].encode()
    return out


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, key: str, text: str, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) for every row of ``df``."""
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = piece_table(path).encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(flat, counts)], [key, "ids"])

    pairs = spread(df.select(key, text), key)
    return pairs.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens int) for every row of ``df``."""
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts = piece_table(path).encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int32))], [key, "n_tokens"])

    pairs = spread(df.select(key, text), key)
    return pairs.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_tokens int")


def character_spans(ids: np.ndarray, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 code point of each token. Tokens that share a split character all cover it."""
    ends = np.cumsum(lengths[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
    if not len(ends):
        return ends, ends
    leads = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    starts = np.concatenate([[0], ends[:-1]])
    return leads[starts] - 1, leads[ends - 1]


def encode_with_offsets(df: DataFrame, key: str, text: str, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids, starts, ends): code-point span of each token."""
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(b) for b in token_bytes(path)], dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            flat, counts = piece_table(path).encode(texts)
            spans, at = [], 0
            for t, n in zip(texts, counts):
                spans.append(character_spans(flat[at : at + n], t.encode(), lengths))
                at += n
            join = lambda k: np.concatenate([np.zeros(0), *(s[k] for s in spans)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(flat, counts), _lists(join(0), counts), _lists(join(1), counts)],
                [key, "ids", "starts", "ends"],
            )

    pairs = spread(df.select(key, text), key)
    return pairs.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, key: str, ids: str, tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the inverse of encode. Bytes are joined over all tokens before they become characters, so
    a character split over tokens comes back whole; a list that ends inside a character gives U+FFFD there.
    Null and empty lists give an empty text; an unknown id raises."""
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, x or ())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")
