"""Problem 9: text statistics of documents, and what a document is: prose, list, table or junk.

Counts of code-point classes and repetition are taken with numpy over an Arrow batch at a time; only line and word
tables are built per document. No document looks at another one, so the whole is one scan without shuffle.

Terms. A word is a code point of a script written without spaces (Thai, kana, Han), or a run of other
non-blank code points that holds a letter or digit. A symbol is a code point of the Unicode categories S*
or one of ``# * / \\ | @ & % _ { } [ ]``. Lines and paragraphs (divided by blank lines) count if not blank.

Repetition. ``ngram_coverage`` has for n = 2 to 10 the share of the words' characters that lies in the n-gram which covers
the most. ``repeated_share`` is the share of the words that lies in runs of RUN words (a third of a shorter text) which
stand in the text before. Both go by equal words in lower case without outer signs. The kind of a document comes from these
statistics, the shares of duplicate lines and paragraphs and the shape of the lines by the rules of ``kind_of``.

Defined results: null, empty and blank texts have counts 0, shares 0.0 and no kind (null); repeated rows
give repeated rows; shares are rounded to 4 places.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..tables import spread

SYMBOLS = "#*/\\|@&%_{}[]"
NO_SPACES = ((0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))
OTHER, LETTER, MARK, DIGIT, BLANK, SYMBOL, SINGLE = range(7)

_ended = re.compile(r"[.!?…。！？।॥؟۔\u037e][”’\"'»“«)\]」』]*$")
_paragraphs = re.compile(r"\n\s*\n")
_words = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿]|[^\s฀-๿぀-ヿ㐀-䶿一-鿿]+")
_edges = re.compile(r"^[\W_]+|[\W_]+$")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if chr(c).isspace():
            table[c] = BLANK
        elif kind[0] in "LMN":
            table[c] = {"L": LETTER, "M": MARK, "N": DIGIT}[kind[0]]
        elif kind[0] == "S" or chr(c) in SYMBOLS:
            table[c] = SYMBOL
    return table


@lru_cache(maxsize=1)
def singles() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for a, b in NO_SPACES:
        table[a : b + 1] = True
    return table


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """Per text: chars, letters (letters, marks, digits), symbols, solid (non-blank), words, singles."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, dtype=np.int64)
    kind, single = classes()[points], singles()[points]
    of = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    alnum = (kind == LETTER) | (kind == DIGIT)
    run = (kind != BLANK) & ~single
    begins = run & ~np.concatenate([[False], run[:-1]])
    ids = np.cumsum(begins)
    worded = np.zeros(int(ids[-1]) + 1 if len(ids) else 1, dtype=bool)
    worded[ids[run & alnum]] = True
    return {
        "chars": lengths,
        "letters": of((kind == LETTER) | (kind == MARK) | (kind == DIGIT)),
        "digits": of(kind == DIGIT),
        "symbols": of(kind == SYMBOL),
        "solid": of(kind != BLANK),
        "singles": of(single & alnum),
        "words": of(begins & worded[ids]) + of(single & alnum),
    }


def word_list(text: str) -> list[str]:
    return [w for w in _words.findall(text) if any(c.isalpha() or unicodedata.category(c)[0] == "N" for c in w)]


class Bare(dict):
    """Token to its small letters without outer signs; a token is looked at once as long as it is remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:  # bounds memory, changes no result
            self.clear()
        made = self[token] = _edges.sub("", token).lower()
        return made


bare_of = Bare().__getitem__

SIZES = range(2, 11)
#: Words of a run that counts as repeated, a third of a shorter text.
RUN = 20
_mix, _base, _mask = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF)


def _repeats(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run number, place) of the places ``at`` whose code another place has too, by run, then place."""
    own = code[at]
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    shared = np.zeros(len(own), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    begins = np.concatenate([[True], ~same])[shared] if len(own) else np.zeros(0, dtype=bool)
    pairs = ((np.cumsum(begins).astype(np.uint64)) << np.uint64(32)) | at[order[shared]].astype(np.uint64)
    pairs.sort()
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & _mask).astype(np.int64)


def repetition(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """For texts as lists of words: their n-gram coverages (a column for each n of SIZES) and repeated shares.

    The texts lie end to end, and every n-gram has a 64-bit number in which its text counts. An n-gram can repeat only
    where its first n - 1 words do, so each n looks at the places that the one before left."""
    numbers: dict[str, int] = {}
    flat = [w for words in texts for w in words]
    known = np.fromiter((numbers.setdefault(w, len(numbers)) for w in flat), dtype=np.uint64, count=len(flat))
    counts = np.array([len(words) for words in texts], dtype=np.int64)
    text, ends = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts)
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)))])
    part = (known + np.uint64(1)) * _mix
    part ^= part >> np.uint64(29)
    seed = (np.arange(len(texts), dtype=np.uint64) + np.uint64(1)) * _base
    code = part + seed[text] if len(flat) else part
    covered, repeated = np.zeros((len(texts), len(SIZES))), np.zeros(len(texts))
    at = np.arange(len(flat))
    by_size: dict[int, list[int]] = {}
    for k, n in enumerate(counts.tolist()):
        if n >= 12 and len(set(texts[k])) < n:
            by_size.setdefault(min(RUN, n // 3), []).append(k)
    for n in range(2, RUN + 1):
        at = at[at + n <= ends[text[at]]]
        if not len(at):
            break
        longer = np.zeros_like(code)
        longer[at] = code[at] * _base + part[at + n - 1]
        code = longer
        run, at_ = _repeats(code, at)
        if n in SIZES and len(run):
            first = np.concatenate([[True], run[1:] != run[:-1]])
            begin = np.where(first, at_, np.maximum(at_, np.concatenate([[0], at_[:-1] + n])))
            sums = np.add.reduceat(chars[at_ + n] - chars[begin], np.flatnonzero(first))
            np.maximum.at(covered[:, n - SIZES[0]], text[at_[first]], sums)
        if own := by_size.get(n):
            later = np.concatenate([[False], run[1:] == run[:-1]]) if len(run) else np.zeros(0, dtype=bool)
            edge = np.zeros(len(flat) + 1, dtype=np.int64)
            np.add.at(edge, at_[later], 1)
            np.add.at(edge, at_[later] + n, -1)
            inside = np.concatenate([[0], np.cumsum(edge.cumsum()[:-1] > 0)])
            for k in own:
                repeated[k] = (inside[ends[k]] - inside[ends[k] - counts[k]]) / counts[k]
        at = np.sort(at_)
    total = chars[ends] - chars[ends - counts] if len(texts) else np.zeros(0)
    return covered / np.maximum(total, 1)[:, None], repeated


# ---- kind
# The words of page furniture.
FURNITURE = frozenset("home menu next previous page contents top share login log in accept cookies skip back up close search sign subscribe".split())
_marker = re.compile(r"(?:[-*•◦·–—+▪‣○●■]|\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})[.)]|\[[ xX]?\]|[（(]\d{1,3}[)）]|[①-⑳])\s*\S")
_contents = re.compile(r"(?:\.{3,}|…{2,}|·{3,}|\s{3,}|_{3,}|\. \.[ .]*)\s*(?:\d{1,4}|[ivxlc]{1,6})$")
_index = re.compile(r"[^\d,]{2,}(?:[,，、]\s*\d{1,4}(?:[-–]\d{1,4})?)+$")
_glossary = re.compile(r"[^:：.!?。]{1,40}\s?(?::|：| [–—-]) ?\S.{0,80}$")
_cell = re.compile(r"</?(?:table|tr|td|th|thead|tbody)\b[^>]*>", re.I)
_rule = re.compile(r"[\s|+:=\-_─━┼│┌┐└┘├┤┬┴&\\]+$")
_gap = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
_vowels = re.compile(r"[aeiouyäöüåæøáéíóúàèìòùâêîôûãõıœ]", re.I)
_ascii_signs = re.compile(r"[#*|\\<>{}\[\]_~^=+/@%&$]")
_dense = re.compile("[\u0e00-\u0e7f\u3040-\U0010ffff]")
_coded = re.compile(r"[A-Za-z0-9+/=%&_\-]{40,}")
_latin = re.compile(r"[a-zA-Z]+")
_stops = frozenset(",;.!?…،؛؟。，；！？।、")


def _table_share(lines: list[str], text: str) -> float:
    """Share of lines that are rows of cells in the best of the notations."""
    n = len(lines)
    if n < 2:
        return 0.0
    best = 0.0
    if "<t" in text.lower():
        best = sum(bool(_cell.search(x)) for x in lines) / n
    rules = sum(bool(_rule.match(x)) for x in lines)
    for mark in ("|", "\t", ";", ",", "&", "││"):
        if mark == "&" and "\\\\" not in text and "tabular" not in text:
            continue
        numbers = [x.count(mark) for x in lines if not _rule.match(x)]
        if not numbers:
            continue
        common, often = Counter(c for c in numbers if c).most_common(1)[0] if any(numbers) else (0, 0)
        if common and (common >= 2 or mark in "\t|"):
            if mark in ",;":
                cells = [c.strip() for x in lines if x.count(mark) == common for c in x.split(mark)]
                spaced = sum(x.count(mark + " ") for x in lines)
                if spaced > 0.3 * sum(numbers) or sum(map(len, cells)) > 30 * len(cells):
                    continue
                quoted = sum('"' in x for x in lines)
                often += quoted if mark == "," else 0
            best = max(best, min(1.0, (often + rules) / n))
    if n >= 3:  # columns of fixed width
        wide = Counter(m.end() for x in lines for m in _gap.finditer(x))
        if wide and sum(wide.values()) <= 12 * n and sum(bool(_ended.search(x)) for x in lines) < 0.5 * n:
            columns = [c for c, k in wide.items() if k >= 0.6 * n]
            if columns:
                best = max(best, sum(bool(_gap.search(x)) for x in lines) / n)
            elif sum(len(_gap.findall(x)) >= 1 for x in lines) > 0.8 * n and not any(map(_contents.search, lines)):
                first = Counter(c for x in lines for c in [m.end() for m in _gap.finditer(x)])
                if first.most_common(1)[0][1] >= 0.5 * n:
                    best = max(best, 0.8)
    return best


#: Share of a text that may repeat what stands before it; three times the same is above it.
REPEATED = 0.66
#: Share of a text that one phrase of five words or more may cover.
DOMINANT = 0.45
#: Words of a window in which words are counted as few, so that the length of a text doesn't matter.
WINDOW = 400


class Measures(NamedTuple):
    """The statistics of one text, unrounded, and its parts."""

    letters: int
    symbols: int
    solid: int
    singles: int
    digits: int
    words: int
    lines: list[str]  # as written but for outer blanks
    common_word_share: float
    punct_line_share: float
    dup_line_share: float
    dup_paragraph_share: float
    coverage: np.ndarray
    repeated_share: float


def says_the_same(m: Measures) -> bool:
    """Whether a text says the same over and over: runs of words, whole paragraphs or lines, or one phrase make most of it,
    or no one of them alone but runs and paragraphs together."""
    if m.words < 12:
        return False
    if m.repeated_share > REPEATED or m.coverage[3:].max() > DOMINANT or m.coverage[1:3].max() > REPEATED:
        return True
    long_lines = sum(map(len, m.lines)) > 12 * len(m.lines) >= 48
    if long_lines and max(m.dup_line_share, m.dup_paragraph_share) > REPEATED:
        return True
    return long_lines and (1 - m.repeated_share) * (1 - m.dup_paragraph_share) < 1 - REPEATED


def kind_of(text: str, m: Measures) -> str | None:
    """prose, list, table or junk; None for a blank text."""
    solid, letters, symbols, lines = m.solid, m.letters, m.symbols, m.lines
    if not solid:
        return None
    n = len(lines)
    # -- nothing that could be read
    strange = len(_ascii_signs.findall(text))  # wrong decodings give other signs than these
    table = _table_share(lines, text)
    if solid >= 20 and letters < 0.35 * solid and strange + m.digits > 0.15 * solid and table < 0.6:
        return "junk"
    tokens = text.split()
    longs = sum(map(len, _coded.findall(text)))
    if longs > 0.5 * solid and m.singles < 0.2 * solid:
        return "junk"
    if table >= 0.6:
        return "table"
    # -- the same over and over
    if says_the_same(m):
        return "junk"
    number: Counter[str] = Counter()
    for token, times in Counter(tokens).items():
        if word := bare_of(token):
            number[word] += times
    total = sum(number.values())
    if total >= 12:
        if sum(number[w] for w in FURNITURE) > 0.6 * total:
            return "junk"
        if max(number.values()) > 0.4 * total:
            return "junk"
        if len(number) < 0.12 * total:  # no window has more words than the whole, so only then theirs can be few
            row = [w for w in map(bare_of, tokens) if w]
            parts = max(1, total // WINDOW)
            edges = [total * k // parts for k in range(parts + 1)]
            if sum(len(set(row[x:y])) for x, y in zip(edges, edges[1:])) < 0.12 * total:
                return "junk"
    if total >= 8:
        # -- letters that make no words
        latin = [(w, k) for w, k in number.items() if w.isascii() and w.isalpha() and len(w) > 2]
        size = sum(k for _, k in latin)
        if size > 0.6 * total and sum(k for w, k in latin if not _vowels.search(w)) > 0.5 * size:
            return "junk"
        # -- words broken by signs
        if strange > 0.04 * solid and symbols > 0.1 * solid:
            if sum(1 for t in tokens if len(t) > 2 and any(c in "@#%^*=|\\~§¤°¬¶<>{}[]+_$" for c in t[1:-1])) > 0.3 * len(tokens):
                return "junk"
        # -- a salad of scripts
        if len({_script(w) for w in number}) >= 4:
            scripts = [_script(w) for w in (_edges.sub("", t) for t in tokens) if w]
            if sum(a != b for a, b in zip(scripts, scripts[1:])) > 0.45 * (len(scripts) - 1):
                return "junk"
    if strange > 0.06 * solid and symbols > 0.15 * solid and m.words and letters < 0.75 * solid:
        return "junk"
    # -- one short entry a line
    if n >= 3:
        stopped = sum(x.rstrip()[-1:] in _stops for x in lines) / n
        entries = [x for x in lines if _is_entry(x, stopped < 0.15)]
        if len(entries) >= 0.6 * n and sum(map(len, entries)) >= 0.6 * sum(map(len, lines)):
            return "list"
    return "prose"


def _script(word: str) -> str:
    c = ord(word[0])
    for name, top in (("latin", 0x36F), ("greek", 0x3FF), ("cyrillic", 0x52F), ("arabic", 0x77F), ("devanagari", 0x97F), ("thai", 0xE7F), ("latin", 0x1FFF), ("han", 0x303F), ("kana", 0x30FF), ("han", 0x9FFF)):
        if c <= top:
            return name
    return "hangul"


def _is_entry(line: str, bare: bool) -> bool:
    """``bare``: whether lines of the text hardly ever end in a stop, so that a short line without a mark at
    its begin can be an entry rather than a line of verse."""
    line = line.strip()
    if len(line) > 140:
        return False
    dense = len(_dense.findall(line)) > 0.3 * len(line)
    if _contents.search(line) or _index.match(line) and len(line) <= 110:
        return True
    ended = line[-1] not in ";；" and bool(_ended.search(line))
    if _marker.match(line):
        return len(line) <= (40 if dense else 120) and not (ended and (line[0] in "–—" or len(line) > (16 if dense else 45)))
    if ended or not bare:
        return False
    if _glossary.match(line) and len(line) <= (40 if dense else 110):
        return True
    return len(line) <= (20 if dense else 70)


def measured(texts: list[str], common: frozenset[str] = frozenset()) -> list[Measures]:
    """The statistics of texts; ``common`` are the common words in lower case."""
    c = {k: v.tolist() for k, v in counts(texts).items()}
    words = [[w for w in map(bare_of, _words.findall(t)) if w] for t in texts]
    coverage, repeated = repetition(words)
    out = []
    for k, t in enumerate(texts):
        u = t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t
        lines = [x for x in (y.strip(" ") for y in u.split("\n")) if x.strip()]
        bare = [x.strip() for x in lines]
        paragraphs = [x for x in map(str.strip, _paragraphs.split(u)) if x] if "\n" in u else bare
        share = lambda part, whole: part / whole if whole else 0.0
        out.append(
            Measures(
                *(c[x][k] for x in ("letters", "symbols", "solid", "singles", "digits", "words")), lines, share(sum(w in common for w in words[k]), c["words"][k]), share(sum(bool(_ended.search(x)) for x in bare), len(bare)),
                share(len(bare) - len(set(bare)), len(bare)), share(len(paragraphs) - len(set(paragraphs)), len(paragraphs)), coverage[k], float(repeated[k]),
            )
        )
    return out


COLUMNS = (
    "word_count long, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double, dup_line_share double, dup_paragraph_share double, "
    "ngram_coverage array<double>, repeated_share double, doc_kind string"
)


def statistics(df: DataFrame, key: str, text: str, common_words: list[str]) -> DataFrame:
    """(key, word_count, mean_word_length, symbol_ratio, punct_line_share, common_word_share, dup_line_share,
    dup_paragraph_share, ngram_coverage array of nine, repeated_share, doc_kind)."""
    kind = dict(df.dtypes)[key]
    common = frozenset(w.lower() for w in common_words if w)
    names = [key, *(x.split()[0] for x in COLUMNS.split(", "))]
    types = [pa.int64(), *[pa.float64()] * 6, pa.list_(pa.float64()), pa.float64(), pa.string()]

    def share(x: float) -> float:
        return math.floor(x * 10_000 + 0.5) / 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows = [
                    (
                        m.words, share(m.letters / m.words) if m.words else 0.0, share(m.symbols / m.solid) if m.solid else 0.0, share(m.punct_line_share), share(m.common_word_share), share(m.dup_line_share),
                        share(m.dup_paragraph_share), np.round(m.coverage, 4), round(m.repeated_share, 4), kind_of(t, m),
                    )
                    for t, m in zip(texts, measured(texts, common))
                ]
                columns = list(zip(*rows)) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, y) for x, y in zip(columns, types))], names)

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")
