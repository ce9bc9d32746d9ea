"""Problem 5: one consistent form for text that looks the same.

First every character gets its compatibility form where that looks the same (widths, ligatures, presentation
forms, kinds of blanks), characters that can't be seen are deleted, and accents are composed. Then look-alike
letters: the letters of a token that look like letters of another script span a lattice, which has for each
of them all letters of its class. Viterbi searches the tokens' scripts under character bigram scores of the
scripts, letters that only one script has, and a cost for a change of script between tokens; inside a token
that holds such letters of two scripts it searches letter by letter, again under bigram scores. The lattice hangs on the classes alone,
never on which member was written, so texts that look the same always get the same form. A text whose
distinctive letters are all of one script needs no search: its best path is that script.

Defined results: null gives null, other texts lose their outer blanks; joiners inside emoji sequences stay;
line breaks are kept apart from blanks, runs of blanks become one; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, spread
from .encoding import SUSPICIOUS
from .samples import LATIN, clean_sentences

# Letters that look the same, Latin, Cyrillic and Greek; a dot where a script has none.
CLASSES = [
    "aа.", "cс.", "eе.", "iі.", "jј.", "oоο", "pрρ", "sѕ.", "xх.", "yу.", "hһ.", "dԁ.", "qԛ.", "wԝ.", "vѵν",
    "AАΑ", "BВΒ", "CС.", "EЕΕ", "HНΗ", "IІΙ", "JЈ.", "KКΚ", "MМΜ", "N.Ν", "OОΟ", "PРΡ", "SЅ.", "TТΤ", "XХΧ", "Y.Υ", "Z.Ζ",
]
SCRIPTS = 3
SWITCH, FORCED = 2.0, 8.0

_to = [str.maketrans({member: cls[s] for cls in CLASSES for member in cls if member != "." and cls[s] != "."}) for s in range(SCRIPTS)]
_members = ["".join(cls[s] for cls in CLASSES if cls[s] != ".") for s in range(SCRIPTS)]
_ranges = [((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)), ((0x400, 0x52F),), ((0x370, 0x3FF), (0x1F00, 0x1FFF))]
_own = ["".join(re.escape(chr(c)) for a, b in r for c in range(a, b + 1) if chr(c).isalpha() and unicodedata.normalize("NFD", chr(c))[0] not in _members[s]) for s, r in enumerate(_ranges)]
_distinct = [re.compile(f"[{x}]") for x in _own]
_own_set = [frozenset(chr(c) for a, b in r for c in range(a, b + 1) if chr(c).isalpha() and unicodedata.normalize("NFD", chr(c))[0] not in _members[s]) for s, r in enumerate(_ranges)]
_letters_of = [frozenset(chr(c) for a, b in r for c in range(a, b + 1) if chr(c).isalpha()) for r in _ranges]
_token = re.compile("[A-Za-zÀ-ɏḀ-ỿͰ-ԯἀ-῿̀-ͯ]+")
_blanks = re.compile("[ \t]+")
_edges = re.compile(" ?\n ?")


@lru_cache(maxsize=1)
def plain_forms() -> dict[str, str]:
    """What is put for a character whose look-alike form is another one."""
    table: dict[int, str] = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Zs",):
            table[code] = " "
        elif kind == "Cf" and code != 0x200D or 0xFE00 <= code <= 0xFE0F or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
            table[code] = ""
        elif c in "\x85  \x0b\x0c":
            table[code] = "\n"
        else:
            form = unicodedata.decomposition(c)
            if form.startswith(("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")):
                plain = unicodedata.normalize("NFKC", c)
                if not plain.startswith(" "):
                    table[code] = plain
    table.update({0x2010: "-", 0x2011: "-", 0x037E: ";"})
    table.pop(0x20, None)
    return {chr(code): form for code, form in table.items()}


_joiner = re.compile("(?<![←-⯿\U0001f000-\U0001faff])‍|‍(?![←-⯿\U0001f000-\U0001faff])")


def plain(text: str) -> str:
    """The text in plain forms, without ignorable characters, accents composed, blanks in order."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        table = plain_forms()
        for c in table.keys() & set(text):
            text = text.replace(c, table[c])
        if "‍" in text:
            text = _joiner.sub("", text)
        text = unicodedata.normalize("NFC", text)
    elif "\x0b" in text or "\x0c" in text:
        text = text.replace("\x0b", "\n").replace("\x0c", "\n")
    return _edges.sub("\n", _blanks.sub(" ", text)).strip()


#: Code points whose tokens are told apart before they are taken apart; bounds memory, changes no result.
COUNTED_CHARS = 4_000_000


class Scripts:
    """Character bigram scores of the three scripts."""

    def __init__(self, tables: list[dict[str, float]]):
        self.tables = tables

    def score(self, token: str, script: int) -> float:
        """Mean log probability of the bigrams of a token in its form in a script."""
        table = self.tables[script]
        word = f" {token.translate(_to[script]).lower()} "
        return sum(table.get(word[k : k + 2], -9.0) for k in range(len(word) - 1)) / (len(word) - 1)


#: Languages whose clean sentences each script's bigrams are counted in.
_languages = (LATIN, ["ru"], ["el"])
_script_of = {lang: s for s, own in enumerate(_languages) for lang in own}


class Grams:
    """Character bigrams of the words of clean sentences, by script. Each distinct token is taken apart once."""

    def __init__(self):
        self.grams: list[Counter[str]] = [Counter() for _ in range(SCRIPTS)]
        self._tokens: list[Counter[str]] = [Counter() for _ in range(SCRIPTS)]
        self._held = 0

    def add(self, lang: str, text: str) -> None:
        if (script := _script_of.get(lang)) is None:
            return
        for sentence in clean_sentences([text], lang, SUSPICIOUS):
            self._tokens[script].update(sentence.split())
        self._held += len(text)
        if self._held > COUNTED_CHARS:
            self.settle()

    def settle(self) -> None:
        """Counts the bigrams of the tokens that were added."""
        for grams, tokens in zip(self.grams, self._tokens):
            for token, n in tokens.items():
                for w in _token.findall(unicodedata.normalize("NFD", token).lower()):
                    w = f" {w} "
                    for k in range(len(w) - 1):
                        grams[w[k : k + 2]] += n
        self._tokens, self._held = [Counter() for _ in range(SCRIPTS)], 0


def _scores(grams: list[dict[str, int]]) -> Scripts:
    totals = [sum(own.values()) + 1 for own in grams]
    return Scripts([{g: max(-9.0, math.log(n / total)) for g, n in own.items()} for own, total in zip(grams, totals)])


def train(texts: dict[str, list[str]]) -> Scripts:
    counts = Grams()
    for lang, own in texts.items():
        for text in own:
            counts.add(lang, text)
    counts.settle()
    return _scores(counts.grams)


def train_on(df: DataFrame, key: str, lang: str, text: str) -> Scripts:
    """``train`` on all rows. Tasks count their own rows and sums of counts are shuffled and collected: at most the square of
    a script's letters, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Grams()
        for batch in batches:
            for spoken, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spoken and t:
                    counts.add(spoken, t)
        counts.settle()
        rows = [(s, g, n) for s, own in enumerate(counts.grams) for g, n in own.items()]
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["script", "gram", "n"])

    parts = spread(df.select(key, lang, text), key).mapInArrow(run, "script int, gram string, n bigint")
    grams: list[dict[str, int]] = [{} for _ in range(SCRIPTS)]
    for script, gram, n in parts.groupBy("script", "gram").agg(F.sum("n").alias("n")).collect():
        grams[script][gram] = n
    return _scores(grams)


_class_of = {member: cls for cls in CLASSES for member in cls if member != "."}
#: Weight of a bigram, and cost of a change of script, within a token.
BIGRAM, CHANGE = 0.3, 1.0


def _letters(token: str, scripts: Scripts) -> str:
    """A token with distinctive letters of two scripts, letter by letter: each letter that has look-alikes may be of any script
    that has its class, and bigram scores of the scripts decide, with a cost for a change of script."""
    states, forms, back = [0.0] * SCRIPTS, [" "] * SCRIPTS, []
    for c in token:
        owner = next((s for s in range(SCRIPTS) if _distinct[s].match(c)), None)
        cls = _class_of.get(c)
        came, now, here = [], [], [c.translate(_to[s]).lower() for s in range(SCRIPTS)]
        for s in range(SCRIPTS):
            paths = [states[t] + BIGRAM * (scripts.tables[s].get(forms[t] + here[s], -9.0) if t == s or forms[t] == " " else -9.0) - CHANGE * (t != s and forms[t] != " ") for t in range(SCRIPTS)]
            best = max(range(SCRIPTS), key=lambda t: (paths[t], t == s, -t))
            came.append(best)
            now.append(paths[best] if owner in (None, s) and (cls is None or cls[s] != ".") else paths[best] - 100.0)
        states, forms = now, here
        back.append(came)
    s, out = max(range(SCRIPTS), key=lambda s: (states[s], -s)), []
    for k in range(len(token) - 1, -1, -1):
        out.append(token[k].translate(_to[s]))
        s = back[k][s]
    return "".join(reversed(out))


def undecided(text: str | None) -> int:
    """Tokens with letters of a script other than Latin that all could be Latin, in a text no letter of which is of one script
    alone: they are put into Latin letters for comparison, and nothing tells whether they are meant so."""
    if not text or text.isascii():
        return 0
    text = unicodedata.normalize("NFD", plain(text))
    if any(not _own_set[s].isdisjoint(text) for s in range(SCRIPTS)):
        return 0
    foreign = _letters_of[1] | _letters_of[2]
    return sum(not foreign.isdisjoint(t) for t in _token.findall(text))


def canonical(text: str | None, scripts: Scripts) -> str | None:
    """The one form of everything that looks like ``text``."""
    if text is None:
        return None
    text = plain(text)
    if text.isascii():
        return text
    chars = set(text)
    scripts_here = [s for s in range(SCRIPTS) if not chars.isdisjoint(_letters_of[s])]
    if scripts_here in ([], [0]):
        return text
    present = [s for s in range(SCRIPTS) if not chars.isdisjoint(_own_set[s])]
    if len(present) == 1 and scripts_here == present:
        return text
    text = unicodedata.normalize("NFD", text)
    if len(present) < 2:  # letters that all could be of any script are taken as Latin
        return unicodedata.normalize("NFC", text.translate(_to[present[0] if present else 0]))
    tokens = [m.span() for m in _token.finditer(text)]
    states, back = [0.0] * SCRIPTS, []
    for a, b in tokens:
        token = text[a:b]
        own = [len(_distinct[s].findall(token)) for s in range(SCRIPTS)]
        if sum(own):
            emission = [-FORCED * (sum(own) - own[s]) for s in range(SCRIPTS)]
        else:
            emission = [scripts.score(token, s) for s in range(SCRIPTS)]
        best = max(range(SCRIPTS), key=lambda s: (states[s], -s))
        came = [s if states[s] >= states[best] - SWITCH else best for s in range(SCRIPTS)]
        states = [max(states[s], states[best] - SWITCH) + emission[s] for s in range(SCRIPTS)]
        back.append((came, own))
    state = max(range(SCRIPTS), key=lambda s: (states[s], -s))
    parts, end = [], len(text)
    for (a, b), (came, own) in zip(reversed(tokens), reversed(back)):
        token = text[a:b]
        parts.append(text[b:end])
        parts.append(_letters(token, scripts) if sum(x > 0 for x in own) > 1 else token.translate(_to[state]))
        state, end = came[state], a
    parts.append(text[:end])
    return unicodedata.normalize("NFC", "".join(reversed(parts)))


_run = re.compile("[A-Za-zÀ-ɏͰ-ԯ]+")
_second = re.compile("[Ͱ-ԯ]")
#: Where letters of two scripts touch.
_seam = re.compile("[A-Za-zÀ-ɏ][Ͱ-ԯ]|[Ͱ-Ͽ][A-Za-zÀ-ɏЀ-ԯ]|[Ѐ-ԯ][A-Za-zÀ-ɏͰ-Ͽ]")


def one_script_words(text: str) -> str:
    """The text with the look-alike letters of each word that mixes scripts put into the one script that has
    letters of its own in the word (Latin if none has). Lengths and places stay."""
    if text.isascii() or not _second.search(text) or not _seam.search(text):
        return text

    def fold(found: re.Match) -> str:
        word = set(found.group())
        if sum(not word.isdisjoint(x) for x in _letters_of) < 2:
            return found.group()
        own = [s for s in range(SCRIPTS) if not word.isdisjoint(_own_set[s])]
        return found.group() if len(own) > 1 else found.group().translate(_to[own[0] if own else 0])

    return _run.sub(fold, text)


def _digest(*parts: str | None) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        raw = (p or "").encode("utf-8", "surrogatepass")
        h.update(len(raw).to_bytes(8, "little"))
        h.update(raw)
    return h.digest()


def canonical_texts(df: DataFrame, keys: list[str], columns: list[str], scripts: Scripts) -> DataFrame:
    """(*keys, *columns, undecided int) with each of ``columns`` in its one form, and how many of their tokens no letter
    assigns to a script."""
    kinds, width = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(width + c).to_pylist() for c in range(len(columns))]
            forms = [pa.array([canonical(t, scripts) for t in own], pa.string()) for own in texts]
            open_ = pa.array([sum(map(undecided, row)) for row in zip(*texts)], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(width)), *forms, open_], [*keys, *columns, "undecided"])

    return spread(df.select(*keys, *columns), *keys).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + "".join(f", `{c}` string" for c in columns) + ", undecided int")


def forms(df: DataFrame, keys: list[str], columns: list[str], scripts: Scripts) -> DataFrame:
    """(*keys, form binary, written binary): 128-bit digests of the columns' one form and of their characters
    as written; null counts as empty in both."""
    kinds, width = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(zip(*(batch.column(width + c).to_pylist() for c in range(len(columns)))))
            form = pa.array([_digest(*(canonical(t, scripts) for t in row)) for row in texts], pa.binary())
            written = pa.array([_digest(*row) for row in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(width)), form, written], [*keys, "form", "written"])

    return spread(df.select(*keys, *columns), *keys).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", form binary, written binary")


def look_alike_pairs(df: DataFrame, key: str, group: str, columns: list[str], scripts: Scripts) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows of one group that look the same and are not written the same.

    Only digests are shuffled. Forms that are written in one way alone, however often, leave first. Of the others each
    writing is one row, and rows of unequal writings are joined; their members come in last, so no two copies of one
    writing ever meet.
    """
    narrow = cut(forms(df, [key, group], columns, scripts))
    writings = narrow.groupBy(group, "form", "written").agg(F.count("*").alias("_n"))
    varied = writings.groupBy(group, "form").agg(F.count("*").alias("_k")).where("_k > 1").select(group, "form")
    own = writings.select(group, "form", "written").join(varied, [group, "form"])
    pairs = own.withColumnRenamed("written", "_lo").join(own.withColumnRenamed("written", "_hi"), [group, "form"]).where("_lo < _hi")
    members = lambda x: narrow.select(group, "form", F.col("written").alias(x), F.col(key).alias(f"_key{x}"))
    both = pairs.join(members("_lo"), [group, "form", "_lo"]).join(members("_hi"), [group, "form", "_hi"])
    return both.select(F.least("_key_lo", "_key_hi").alias(f"{key}_a"), F.greatest("_key_lo", "_key_hi").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b")).distinct()
