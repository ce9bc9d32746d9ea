"""Problem 6: text that was decoded with the wrong character encoding.

A decoding chain is a list of steps (wrong, right): the text was read as ``wrong`` where its bytes were
``right``. A segment (sentence or line) with suspicious characters gets every chain whose steps its
characters allow; each candidate is compressed by zstandard with the dictionary of each language of its
script, and the chain of minimum description length is taken: compressed bytes plus the code of each step.
No chain at all costs nothing, so a text is left as it is unless a decoding pays. A dictionary holds the
commonest pairs of words (windows of characters where no blanks part words) of the clean sentences of all texts with the label
of its language, as many as fit, laid end to end where they overlap (``train_on``).

UTF-8 read as a single-byte set is undone inside a segment for each maximal valid byte sequence, so that
places inside intact text are found; the other chains take each maximal run that the wrong set can encode.

Defined results: null and empty texts stay; U+FFFD and broken remains of a wrong decoding count as found but
cannot be restored; repeated rows give repeated rows.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import spread
from .samples import LATIN, SCRIPT_CLASS, SCRIPT_OF, clean_sentences

#: Bytes that describe a step of a chain: a UTF-8 text read as another set is the likelier mistake, and has the shorter code.
UTF8_COST, PAIR_COST = 1, 2
#: Bytes of clean text in the dictionary of one language.
DICTIONARY_BYTES = 40_000
#: Languages that part words by no blanks, and the characters of a piece in them; elsewhere a piece is a pair of words.
SOLID, PIECE_CHARS = ("zh", "ja", "th"), 3
#: Words or characters that a task holds before it hands counts on; bounds memory, changes no result.
COUNTED_UNITS = 1_000_000
#: Code points of the segments that a worker remembers; bounds memory, changes no result.
REMEMBERED = 4_000_000
LEVEL = 3
#: Times that a part of a name is seen, at any number of names, before the dictionary of names takes it.
NAME_TIMES = 4

# Sets that UTF-8 bytes are read as, and other pairs (read as, written as).
UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "cp866", "koi8-r", "cp1256", "cp874"]
WIDE_READ_AS = ["cp932", "gbk", "cp949", "big5"]
OTHER_PAIRS = [
    *(("cp1252", x) for x in "cp1251 koi8-r cp866 iso8859-5 mac_cyrillic cp1253 iso8859-7 cp737 cp1254 cp1250 iso8859-2 iso8859-9 cp1256 iso8859-6 cp874 gbk big5 cp932 euc_jp cp949 mac_roman cp850 cp437".split()),
    *(("cp1251", x) for x in "koi8-r cp866 iso8859-5 mac_cyrillic cp1252 cp1253 gbk cp949 cp932".split()),
    *(("koi8-r", x) for x in "cp1251 cp866 iso8859-5".split()),
    *(("cp866", x) for x in "cp1251 koi8-r".split()),
    *(("cp1253", x) for x in "cp737 iso8859-7 cp1252 cp1251 cp869".split()),
    *(("cp1250", x) for x in "cp1252 cp1254".split()),
    *(("cp437", x) for x in "cp1252 cp850 cp1254 cp1251".split()),
    *(("cp850", x) for x in "cp1252 cp1254".split()),
    *(("mac_roman", x) for x in "cp1252 cp1254 cp1251 cp1253".split()),
    *(("gbk", x) for x in "cp949 cp932 big5 euc_jp".split()),
    *(("cp932", x) for x in "gbk cp949 big5 euc_jp".split()),
    *(("cp949", x) for x in "gbk cp932 big5".split()),
    *(("big5", x) for x in "gbk cp932 cp949".split()),
    ("cp1254", "cp1252"),
    ("cp874", "cp1252"),
    ("iso8859-7", "cp737"),
]

_continued = "\x80-\x9f\xa0-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# Letters of other scripts that look like Latin ones, and those Latin letters.
LOOKALIKES = "аеорсухіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅ" + "οΟαΑΒΕΖΗΙΚΜΝΡΤΥΧνρυι"
LATIN_FORMS = "aeopcyxijshdqwvABEKMHOPCTYXIJS" + "oOaABEZHIKMNPTYXvpui"
_fold = str.maketrans(LOOKALIKES, LATIN_FORMS)
_strange = "".join(chr(c) for a, b in ((0x0370, 0x03FF), (0x0400, 0x045F)) for c in range(a, b + 1) if chr(c) not in LOOKALIKES and chr(c).isalpha())

_wide_remains = "繝繧縺蜈譁隱蟷豁螢莠蛻郢驛逕謌锛銆鐨鈥涓鍦鏄浜鎴鍙缁瀛"

# Letters as which quotation marks are read, at the begin or behind the end of what is quoted; signs that stand in no word.
_read_quotes, _no_letters = "ÆÕÓÔÒöæôòùû", "¿¡•†‡‰"

#: Characters and pairs that running text of no language shows; only what matches is looked at closely. Each
#: match is one character, found by its class and then judged with what stands before it.
SUSPICIOUS = re.compile(
    f"[\x80-\u08ff\u1e00-\u2fff\ufffdｦ-ﾟ{_wide_remains}](?:"
    f"(?<=[\x80-\x84\x86-\x9f¤¦¨¬¯±-´µ¸¹¼-¾¢¥©®ÐÞÝðþý×÷ƒ‡ˆ‰˜†‹›ŠŽŸ\ufffdĂăĹĺĎďŃŘřŤťţŢđĆĐ─-▟⌐-⌡√≤≥∩≈≠∂∏∑∫∞◊‗‚ЂЃЄЇЉ-Џђѓєїљ-џҐґЎўｦ-ﾟ{_wide_remains}])"
    "|(?<=[¡-ª¬-º¼-¾][А-я])|(?<=[а-яё][А-Я])|(?<=[α-ώ][Α-Ω])"
    "|(?<=[ÂÃÄÅÎÏÒÓÔÕØÙÑàáâãäåæçèéêëìíîï][¡-ºˆ¼-¾€‚ƒ„†‡ˆ‰Š‹ŒŽ•–—˜™š›žŸ\xad])|(?<=[ÂÃÄÅÎÏÒÓÔÕØÙ][‘’“”…»«œ\xa0])"
    f"|(?<=[À-ÖØ-öø-ÿ]{{3}})|(?<=[a-z][À-ÖØ-Þ])(?=[a-z])|(?<=[A-Za-z][{_strange}])|(?<=[{_strange}])(?=[A-Za-zÀ-ÿ])|(?<=[А-яЁё][°±µ¶·№»])(?=[А-я])"
    "|(?<=[Α-ώ][¡-·À-ÿ£¥])|(?<=[‚„][Ä-ÿ])"
    f"|(?<=[,.!?…][{_read_quotes}])(?![^\\W\\d_])|(?<=(?<![^\\W\\d_])[{_read_quotes}])(?=[A-Z][a-zà-ÿ ])|(?<=[A-Za-zÀ-ÿ][{_no_letters}])(?=[a-zà-ÿ]))"
)


@lru_cache(maxsize=1)
def _pair_tables() -> np.ndarray:
    """The rules of SUSPICIOUS as bits of each character up to U+FFFF, none of which a later one matches: bit 31 for odd
    characters, bits 0 to 14 for the first characters of pairs, bits 15 to 30 for the second, a bit a rule."""
    odd, first, second = (np.zeros(0x10000, dtype=np.uint32) for _ in range(3))
    plane = "".join(map(chr, range(0x10000)))

    def members(chars: str) -> list[int]:
        return list(map(ord, re.findall(f"[{chars}]", plane)))

    odd[members(f"\x80-\x84\x86-\x9f¤¦¨¬¯±-´µ¸¹¼-¾¢¥©®ÐÞÝðþý×÷ƒ‡ˆ‰˜†‹›ŠŽŸ\ufffdĂăĹĺĎďŃŘřŤťţŢđĆĐ─-▟⌐-⌡√≤≥∩≈≠∂∏∑∫∞◊‗‚ЂЃЄЇЉ-Џђѓєїљ-џҐґЎўｦ-ﾟ{_wide_remains}")] = 1
    letter = "À-ÖØ-öø-ÿ"
    rules = [
        ("¡-ª¬-º¼-¾", "А-я"), ("а-яё", "А-Я"), ("α-ώ", "Α-Ω"),
        ("ÂÃÄÅÎÏÒÓÔÕØÙÑàáâãäåæçèéêëìíîï", "¡-ºˆ¼-¾€‚ƒ„†‡ˆ‰Š‹ŒŽ•–—˜™š›žŸ\xad"), ("ÂÃÄÅÎÏÒÓÔÕØÙ", "‘’“”…»«œ\xa0"),
        (letter, letter), ("a-z", "À-ÖØ-Þ"), ("A-Za-z", _strange), (_strange, "A-Za-zÀ-ÿ"), ("А-яЁё", "°±µ¶·№»"), ("Α-ώ", "¡-·À-ÿ£¥"), ("‚„", "Ä-ÿ"), (",.!?…", _read_quotes), (_read_quotes, "A-Z"), ("A-Za-zÀ-ÿ", _no_letters),
    ]
    for bit, (a, b) in enumerate(rules):
        first[members(a)] |= 1 << bit
        second[members(b)] |= 1 << bit
    return odd << np.uint32(31) | second << np.uint32(15) | first


def suspicious(texts: list[str]) -> np.ndarray:
    """For each text at how many places SUSPICIOUS may match, never fewer than it does. One pass over all texts."""
    out = np.zeros(len(texts), dtype=np.int64)
    at = [k for k, t in enumerate(texts) if t and not t.isascii()]
    for part in range(0, len(at), 256):
        own = at[part : part + 256]
        points = np.frombuffer("\n".join([texts[k] for k in own] + [""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(texts[k]) + 1 for k in own])[:-1]])
        bits = _pair_tables()[np.minimum(points, 0xFFFF)]
        hit = bits >> np.uint32(31) != 0
        hit[1:] |= (bits[:-1] & (bits[1:] >> np.uint32(15)) & np.uint32(0x7FFF)) != 0
        out[own] = np.add.reduceat(hit, starts, dtype=np.int64)
    return out


#: Remains of a wrong decoding that no chain undoes.
BROKEN = re.compile(
    "\ufffd|â€|Ã[\x80-\xbf\xa0©¨ƒ‚„†‡ˆ‰Š‹ŒŽ–—˜™š›žŸ€]|Â[\xa0«»°·¿¡]|à[¤¥¸¹][\x80-\xbf‚-™ ]|ï»¿|Ð[\xa0-¿][ÐÑ]|锟斤拷|ã[€\x81\x82ƒ‚][\x80-¿‚-™]"
    f"|√[©®†Ø§∂∫ºÆ°≠±]|├[│⌐¼®ª│í║▒]|ΓÇ|‚Ä[ôúùò¶ì]|[bdfghjklmnqrtuvwz][{_strange}]|[{_strange}][bdfghjklmnqrtvwz]|[a-z][ÆÕ][st]\\b|[\x80-\x84\x86-\x9f]"
    f"|[,.!?…][{_read_quotes}](?![^\\W\\d_])|(?<![^\\W\\d_])[{_read_quotes}](?=[A-Z][a-zà-ÿ ])|(?<=[A-Za-zÀ-ÿ])[{_no_letters}](?=[a-zà-ÿ])"
)


def is_broken(text: str) -> bool:
    return bool(SUSPICIOUS.search(text)) and bool(BROKEN.search(text))


@lru_cache(maxsize=64)
def byte_of(charset: str) -> dict[str, int]:
    """Character to byte of a single-byte set; undefined bytes stand for the control of the same number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(maxsize=64)
def byte_map(charset: str):
    """``byte_of`` in the form that the codecs take."""
    at = {b: c for c, b in byte_of(charset).items()}
    return codecs.charmap_build("".join(at.get(b, "\ufffe") for b in range(256)))


@lru_cache(maxsize=64)
def utf8_runs(charset: str) -> re.Pattern:
    """Runs of valid multi-byte UTF-8 sequences as they look when read as ``charset``."""
    at = {b: c for c, b in byte_of(charset).items()}
    part = lambda a, b: "[" + "".join(re.escape(at[x]) for x in range(a, b + 1) if x in at) + "]"
    tail = part(0x80, 0xBF)
    return re.compile(f"(?:{part(0xC2, 0xDF)}{tail}|{part(0xE0, 0xEF)}{tail}{tail}|{part(0xF0, 0xF4)}{tail}{tail}{tail})+")


@lru_cache(maxsize=64)
def high_characters(charset: str) -> frozenset[str]:
    return frozenset(c for c, b in byte_of(charset).items() if b >= 0x80)


@lru_cache(maxsize=64)
def encodable_runs(charset: str) -> re.Pattern:
    high = "".join(re.escape(c) for c, b in byte_of(charset).items() if b >= 0x80)
    return re.compile(f"[\\x00-\\x7f{high}]*[{high}][\\x00-\\x7f{high}]*")


#: What restored text may hold: letters and marks of the languages' scripts, of names, and punctuation.
ALLOWED = re.compile(
    "[\t\n\r -~\xa0-ÿŒœŸŠšŽžğĞışİŞĀāąćčďđęěłŁńňőŐřśťůűźżŻŚĆČ΄-ώА-яЁё،؛؟ء-ْ٠-٩ऀ-ॿก-๛\u200b-\u200f‐-‧\u202f‰‹›€№™→∞≤≥≠、-〟ぁ-ヿ㐀-䶿一-鿿가-힣！-｠ｰ]*"
)


def plausible(text: str, base: set[str] = frozenset()) -> bool:
    """Whether all characters that are not among ``base`` may come out of a restoration."""
    return ALLOWED.fullmatch("".join(set(text) - base)) is not None


def undo_utf8(text: str, charset: str) -> str:
    table = byte_map(charset)

    def fix(found: re.Match) -> str:
        try:
            fixed = codecs.charmap_encode(found.group(), "strict", table)[0].decode("utf-8")
        except UnicodeDecodeError:
            return found.group()
        if ALLOWED.fullmatch(fixed) or SUSPICIOUS.search(fixed):
            return fixed
        return found.group()

    return utf8_runs(charset).sub(fix, text)


def undo_wide(text: str, wrong: str, right: str) -> str:
    """Whole-text step for multi-byte wrong sets."""
    try:
        return text.encode(wrong).decode(right)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


@lru_cache(maxsize=256)
def _readings(wrong: str, right: str) -> tuple[dict[int, str], frozenset[str]] | None:
    """For two single-byte sets: what each high character of ``wrong`` is in ``right``, and the characters whose byte
    ``right`` has not; None if ``right`` has more than one byte a character."""
    try:
        if len(b"\xb0\xa1".decode(right)) < 2 or len(b"\x82\xa0".decode(right)) < 2:
            return None
    except UnicodeDecodeError:
        pass
    if right in WIDE_READ_AS or right == "euc_jp":
        return None
    table, missing = {}, set()
    for c, b in byte_of(wrong).items():
        try:
            table[ord(c)] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            missing.add(c)
    return table, frozenset(missing)


def undo_pairs(text: str, wrong: str, rights: list[str], allowed=lambda changed: True) -> Iterator[tuple[str, str]]:
    """(right, text with every run that ``wrong`` can encode read as ``right``) where that changes it. A run that holds a
    byte which ``right`` has not stays. ``allowed`` is asked, for a single-byte ``right`` and before the text is made, about
    the table of changed characters."""
    if wrong in WIDE_READ_AS:
        for right in rights:
            if (fixed := undo_wide(text, wrong, right)) != text:
                yield right, fixed
        return
    high = high_characters(wrong).intersection(text)
    if not high:
        return
    parts: list[str] = []
    between: list[str] = []
    raws: list[bytes] = []
    for right in rights:
        reading = _readings(wrong, right)
        if reading and reading[1].isdisjoint(high):
            changed = {ord(c): reading[0][ord(c)] for c in high}
            if allowed(changed) and (fixed := text.translate(changed)) != text:
                yield right, fixed
            continue
        if not parts:
            table, last = byte_map(wrong), 0
            for found in encodable_runs(wrong).finditer(text):
                between.append(text[last : found.start()])
                parts.append(found.group())
                last = found.end()
            between.append(text[last:])
            raws = [codecs.charmap_encode(x, "strict", table)[0] for x in parts]
        read = _read_all(raws, parts, right, "\n" in text)
        if read != parts:
            yield right, "".join(chain.from_iterable(zip(between, read))) + between[-1]


_FAILED = "\uf8ff"
codecs.register_error("recitant-failed", lambda error: (_FAILED, error.end))


def _read_all(raws: list[bytes], texts: list[str], right: str, lines: bool) -> list[str]:
    """Each of some byte strings read as ``right``; its text as it is where it can't be. They are read at one go, parted by
    line feeds, which no multi-byte character of these sets holds (``lines``: whether the strings hold some themselves); a
    string that fails somewhere shows a private mark."""
    if not lines:
        read = b"\n".join(raws).decode(right, "recitant-failed").split("\n")
        if len(read) == len(raws):
            return [own if _FAILED in x else x for own, x in zip(texts, read)]
    out = []
    for raw, own in zip(raws, texts):
        try:
            out.append(raw.decode(right))
        except UnicodeDecodeError:
            out.append(own)
    return out


def undo_pair(text: str, wrong: str, right: str) -> str:
    return next((fixed for _, fixed in undo_pairs(text, wrong, [right])), text)


_rights: dict[str, list[str]] = {}
for _wrong, _right in OTHER_PAIRS:
    _rights.setdefault(_wrong, []).append(_right)


_wide_runs = re.compile(r"[^\s\x00-\x7f]+(?:[\x21-\x7e]?[^\s\x00-\x7f]+)*[\x21-\x7e]?")


def undo_wide_utf8(text: str, wrong: str) -> str:
    """Runs without blanks whose bytes in a wide set are valid UTF-8."""
    def fix(found: re.Match) -> str:
        run = found.group()
        for end in (len(run), len(run) - 1):
            try:
                return run[:end].encode(wrong).decode("utf-8") + run[end:]
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return run

    return _wide_runs.sub(fix, text)


_invisible = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\ufe00-\ufe0f]")
_ranges = [(re.compile(f"[{chars}]"), name) for name, chars in SCRIPT_CLASS.items()] + [(re.compile("[A-Za-zÀ-ɏ]"), "Latin")]


_scripts: dict[str, str] = {}  # of the characters seen so far


def scripts_of(times: Counter[str]) -> list[str]:
    """Languages whose dictionaries may fit a text with these characters: those of the script that has the most letters,
    Latin before others."""
    counts: dict[str, int] = {}
    for c, n in times.items():
        name = _scripts.get(c)
        if name is None:
            name = _scripts[c] = next((name for rule, name in _ranges if rule.match(c)), "")
        if name:
            counts[name] = counts.get(name, 0) + n
    latin = counts.pop("Latin", 0)
    best = max(SCRIPT_CLASS, key=lambda name: counts.get(name, 0)) if counts else ""
    return [x for x, s in SCRIPT_OF.items() if s == best] if counts.get(best, 0) > latin else LATIN


class Repairer:
    """Picks the chain of minimum description length. Dictionaries: language to clean text."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self.alphabet = frozenset("".join(d.decode("utf-8", "ignore") for d in dictionaries.values())) | frozenset(map(chr, range(32, 127))) | frozenset("\t\r\n")
        self._compressors: dict = {}
        self._seen: dict[str, tuple[str, str]] = {}  # segments of re-ingested texts come again
        self._held = 0

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.__init__(state)

    def size(self, text: str) -> int:
        """Description length of a text: bytes under the dictionary that compresses it best."""
        import zstandard

        raw, best = text.encode("utf-8", "surrogatepass"), 1 << 30
        for lang in scripts_of(Counter(text)):
            if lang not in self._compressors:
                content = self.dictionaries.get(lang)
                if content:
                    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    d.precompute_compress(level=LEVEL)
                    self._compressors[lang] = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
                else:
                    self._compressors[lang] = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            best = min(best, len(self._compressors[lang].compress(raw)))
        return best

    def candidates(self, text: str) -> dict[str, str]:
        """Restored text to chain step, for every step whose wrong set has a suspicious character; a step whose set
        has none leaves them all."""
        out: dict[str, str] = {}
        odd, base = set(SUSPICIOUS.findall(text)), set(text)
        fits = lambda charset: not odd.isdisjoint(high_characters(charset))
        for charset in UTF8_READ_AS:
            if fits(charset) and (fixed := undo_utf8(text, charset)) != text and fixed not in out and plausible(fixed, base):
                out[fixed] = f"{charset}>utf-8"
        for charset in WIDE_READ_AS:
            if (fixed := undo_wide_utf8(text, charset)) != text and fixed not in out and plausible(fixed, base):
                out[fixed] = f"{charset}>utf-8"
        times, known = Counter(text), self.alphabet
        bound = sum(n for c, n in times.items() if c not in known)

        def allowed(changed: dict[int, str]) -> bool:
            """Whether the text with these characters changed is plausible and has no more unknown characters than before."""
            if ALLOWED.fullmatch("".join(set(changed.values()) - base)) is None:
                return False
            return bound + sum(times[chr(c)] * ((new not in known) - (chr(c) not in known)) for c, new in changed.items()) <= bound

        for wrong, rights in _rights.items():
            if wrong not in WIDE_READ_AS and not fits(wrong):
                continue
            for right, fixed in undo_pairs(text, wrong, rights, allowed):
                if fixed not in out and plausible(fixed, base):
                    out[fixed] = f"{wrong}>{right}"
        return out

    def unknown(self, text: str) -> int:
        """Characters that no dictionary has."""
        strange = set(text).difference(self.alphabet)
        return sum(map(text.count, strange)) if strange else 0

    def segment(self, text: str) -> tuple[str, str]:
        """(restored text, chain) of one segment; the chain is empty where nothing pays.

        The text as it is may also be described with look-alike letters, widths and blanks in their plain
        form, for these come from no decoding. Steps are searched breadth first. Every step of a chain must pay: a
        step is followed by another if it was a UTF-8 step, after which suspicious characters can stay, and if it made the
        description shorter; so the search ends."""
        best, taken = text, ""
        cost = self.size(text)
        folded = _invisible.sub("", unicodedata.normalize("NFKC", text.translate(_fold)))
        if folded != text:
            cost = min(cost, self.size(folded))
        layer, seen = [(cost, text, "")], {text}
        while layer:
            following = []
            for before, base, steps in layer:
                bound, signs = self.unknown(base), len(SUSPICIOUS.findall(base))
                found = self.candidates(base)
                ranked = sorted((self.unknown(fixed), fixed, step) for fixed, step in found.items() if fixed not in seen)
                for strange, fixed, step in ranked:
                    if strange > bound or len(SUSPICIOUS.findall(fixed)) > signs:
                        continue
                    seen.add(fixed)
                    steps_now = f"{steps} {step}".strip()
                    now = self.size(fixed) + cost_of(steps_now)
                    if now < cost:
                        best, cost, taken = fixed, now, steps_now
                    if now < before and step.endswith("utf-8") and SUSPICIOUS.search(fixed):
                        following.append((now, fixed, steps_now))
            layer = sorted(following)
        return best, taken

    def remembered(self, text: str) -> tuple[str, str]:
        """``segment``, once for equal segments as long as they are remembered."""
        if text not in self._seen:
            self._held += len(text)
            if self._held > REMEMBERED:
                self._seen.clear()
                self._held = len(text)
            self._seen[text] = self.segment(text)
        return self._seen[text]

    def again(self, text: str, chains: dict[str, int]) -> tuple[str, str] | None:
        """A chain that this text has used, if it leaves the segment clean and pays; else None."""
        for steps in sorted(chains, key=lambda c: (-chains[c], c)):
            fixed = undo(text, steps)
            if fixed != text and not SUSPICIOUS.search(fixed) and plausible(fixed, set(text)) and self.unknown(fixed) == 0 and self.size(fixed) < self.size(text):
                return fixed, steps
        return None

    def text(self, text: str) -> tuple[str, list[str]]:
        """(restored text, chains used) of a text of any length, segment by segment."""
        _, parts, chains = self.parts(text)
        return "".join(parts), chains

    def parts(self, text: str) -> tuple[list[str], list[str], list[str]]:
        """(segments as they are, restored, chains used) of a text."""
        if text.isascii() or not SUSPICIOUS.search(text):
            return [text], [text], []
        parts = _segments.split(text)
        written = list(parts)
        chains: dict[str, int] = {}
        left = []
        for k in range(0, len(parts), 2):
            if parts[k] and SUSPICIOUS.search(parts[k]):
                parts[k], steps = self.again(parts[k], chains) or self.remembered(parts[k])
                if steps:
                    chains[steps] = chains.get(steps, 0) + 1
                if SUSPICIOUS.search(parts[k]):
                    left.append(k)
        for k in left:  # a chain that this text has paid for costs nothing more
            for steps in sorted(chains, key=lambda c: (-chains[c], c)):
                fixed = undo(parts[k], steps)
                if fixed != parts[k] and plausible(fixed, set(parts[k])) and len(SUSPICIOUS.findall(fixed)) < len(SUSPICIOUS.findall(parts[k])) and self.size(fixed) <= self.size(parts[k]):
                    parts[k] = fixed
                    break
        return written, parts, sorted(chains)


def cost_of(chain: str) -> int:
    return sum(UTF8_COST if step.endswith("utf-8") else PAIR_COST for step in chain.split())


def undo(text: str, chain: str) -> str:
    """``text`` with the steps of a chain undone."""
    for step in chain.split():
        wrong, right = step.split(">")
        if right == "utf-8":
            text = undo_wide_utf8(text, wrong) if wrong in WIDE_READ_AS else undo_utf8(text, wrong)
        else:
            text = undo_pair(text, wrong, right)
    return text


_segments = re.compile(r"((?<=[.!?…।؟])[ \t]+|(?<=[.!?])[\"”’»)\]]*[ \t\xa0]+(?=[A-Z¿¡«“])|[\r\n]+)")


def last_bytes(content: bytes) -> bytes:
    """The last DICTIONARY_BYTES bytes, from the begin of a character on."""
    begin = max(0, len(content) - DICTIONARY_BYTES)
    while begin < len(content) and content[begin] & 0xC0 == 0x80:
        begin += 1
    return content[begin:]


def train(samples: dict[str, list[str]]) -> Repairer:
    """Dictionaries from labelled texts: clean sentences, the common ones last as zstandard wants them."""
    dictionaries = {}
    for lang, texts in samples.items():
        content = " ".join(dict.fromkeys(clean_sentences(texts, lang, SUSPICIOUS))).encode()
        if content:
            dictionaries[lang] = last_bytes(content)
    return Repairer(dictionaries)


class Pieces:
    """Counts of the pieces of clean sentences, by language. Units (words or characters) are numbered as they come."""

    def __init__(self):
        self._units: dict[str, array] = {}
        self._numbers: dict[str, dict[str, int]] = {}
        self.held = 0

    def add(self, lang: str, text: str) -> None:
        if lang not in self._units:
            self._units[lang], self._numbers[lang] = array("q"), defaultdict(count(1).__next__)  # 0 parts sentences
        own, number = self._units[lang], self._numbers[lang].__getitem__
        before = len(own)
        for sentence in clean_sentences([text], lang, SUSPICIOUS):
            own.extend(map(number, sentence if lang in SOLID else sentence.split()))
            own.append(0)
        self.held += len(own) - before

    def counts(self) -> Iterator[tuple[str, list[str], np.ndarray]]:
        """(language, pieces, how often each is seen)."""
        for lang, units in self._units.items():
            width, names = PIECE_CHARS if lang in SOLID else 2, ["", *self._numbers[lang]]
            ids, bits = np.array(units, dtype=np.int64), len(names).bit_length()
            columns = [ids[k : len(ids) - width + 1 + k] for k in range(width)] if len(ids) >= width else []
            if not columns:
                continue
            code, whole = np.zeros(len(columns[0]), dtype=np.int64), np.ones(len(columns[0]), dtype=bool)
            for column in columns:
                code = code << bits | column
                whole &= column > 0
            kinds, times = np.unique(code[whole], return_counts=True)
            parts = [map(names.__getitem__, (kinds >> bits * (width - 1 - k) & (1 << bits) - 1).tolist()) for k in range(width)]
            yield lang, list(map(("" if lang in SOLID else " ").join, zip(*parts))), times


def joined(pieces: list[tuple[str, ...]], blank: str) -> bytes:
    """Pieces, the commonest first, as one text with the common ones last. Each is there once: behind a piece comes the
    commonest one left that begins with its end."""
    following, at = defaultdict(list), Counter()
    for p in pieces:
        following[p[:-1]].append(p)
    used: set[tuple[str, ...]] = set()
    out = []
    for p in pieces:
        if p in used:
            continue
        used.add(p)
        units, end = list(p), p[1:]
        while True:
            own = following.get(end, ())
            while at[end] < len(own) and own[at[end]] in used:
                at[end] += 1
            if at[end] == len(own):
                break
            after = own[at[end]]
            used.add(after)
            units.append(after[-1])
            end = after[1:]
        out.append(blank.join(units))
    return blank.join(reversed(out)).encode()


def dictionary(pieces: list[tuple[str, ...]], blank: str) -> bytes:
    """``joined`` of as many of the commonest pieces as fit into DICTIONARY_BYTES, by bisection."""
    best, low, high = b"", 0, len(pieces)
    while low < high:
        middle = (low + high + 1) // 2
        content = joined(pieces[:middle], blank)
        if len(content) <= DICTIONARY_BYTES:
            best, low = content, middle
        else:
            high = middle - 1
    return best


def train_on(df: DataFrame, key: str, lang: str, text: str) -> Repairer:
    """Dictionaries from all rows. Tasks count the pieces of their own rows, sums are shuffled, and of each language the commonest
    are collected, as many as could fit: a piece brings at least its last word or character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Pieces()
        for batch in batches:
            for spoken, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spoken and t:
                    seen.add(spoken, t)
                if seen.held > COUNTED_UNITS:
                    yield from counted(seen)
                    seen = Pieces()
        yield from counted(seen)

    def counted(seen: Pieces) -> Iterator[pa.RecordBatch]:
        for spoken, pieces, times in seen.counts():
            yield pa.RecordBatch.from_arrays([pa.array([spoken] * len(pieces), pa.string()), pa.array(pieces, pa.string()), pa.array(times, pa.int64())], ["lang", "piece", "n"])

    parts = spread(df.select(key, lang, text), key).mapInArrow(run, "lang string, piece string, n bigint")
    brings = F.when(F.col("lang").isin(*SOLID), F.octet_length(F.expr("right(piece, 1)"))).otherwise(F.octet_length(F.substring_index("piece", " ", -1)) + 1)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "piece")
    common = parts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DICTIONARY_BYTES)
    fitting = common.withColumn("bytes", F.sum(brings).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("bytes") <= DICTIONARY_BYTES + 1)
    ranked: dict[str, list[tuple[int, str]]] = {}
    for spoken, piece, rank in fitting.select("lang", "piece", "rank").collect():
        ranked.setdefault(spoken, []).append((rank, piece))
    dictionaries = {}
    for spoken, own in sorted(ranked.items()):
        pieces = [tuple(p) if spoken in SOLID else tuple(p.split(" ")) for _, p in sorted(own)]
        if content := dictionary(pieces, "" if spoken in SOLID else " "):
            dictionaries[spoken] = content
    return Repairer(dictionaries)


def name_parts(names: Iterable[tuple[str, int]]) -> Counter[str]:
    """How often each part of (name, times) is seen in names that are not garbled as far as their signs tell."""
    parts: Counter[str] = Counter()
    for name, n in names:
        if not BROKEN.search(name) and all(undo_utf8(name, c) == name for c in UTF8_READ_AS) and plausible(name):
            for part in name.split():
                parts[part] += n
    return parts


def _of_parts(parts: Iterable[tuple[str, int]]) -> Repairer:
    known = sorted((n, part) for part, n in parts if n >= NAME_TIMES)
    return Repairer({"en": last_bytes(" ".join(part for _, part in known).encode())} if known else {})


def train_names(names: list[str]) -> Repairer:
    """A dictionary of the parts of names that occur often enough not to be garbled themselves."""
    return _of_parts(name_parts(Counter(names).items()).items())


def train_names_on(df: DataFrame, key: str, name: str) -> Repairer:
    """``train_names`` on all rows; the commonest parts are collected, no more than fit into the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = name_parts(Counter(x for x in batch.column(1).to_pylist() if x).items())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["part", "n"])

    parts = spread(df.select(key, name), key).mapInArrow(run, "part string, n bigint")
    known = parts.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") >= NAME_TIMES)
    return _of_parts(map(tuple, known.orderBy(F.desc("n"), F.desc("part")).limit(DICTIONARY_BYTES // 2 + 1).collect()))


#: Letters of names that elsewhere would be suspicious.
_name_letters = re.compile(r"\bŠ|[ěĚńćğ]|(?<=[A-ZÀ-ÞŁŞĞŠ])[ŃĆĞŘŠŽĐ]")


def is_broken_name(name: str) -> bool:
    """A name has no noise signs, so whatever is suspicious in it comes from a wrong decoding."""
    return bool(SUSPICIOUS.search(_name_letters.sub("", name)))


def repair(df: DataFrame, keys: list[str], text: str, repairer: Repairer, broken=is_broken) -> DataFrame:
    """(*keys, restored string, chains array<string>, garbled boolean) for every row. ``garbled`` is true if a
    chain was undone or broken remains are there, false for null and empty texts; ``restored`` is the text
    itself where nothing was undone."""
    kinds = dict(df.dtypes)
    names = [*keys, "restored", "chains", "garbled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            restored, chains, garbled = [], [], []
            texts = batch.column(len(keys)).to_pylist()
            for t, close in zip(texts, suspicious(texts).tolist()):
                fixed, used = repairer.text(t) if close else (t, [])
                restored.append(fixed)
                chains.append(used)
                garbled.append(bool(close) and (bool(used) or broken(t)))
            columns = [*(batch.column(c) for c in range(len(keys))), pa.array(restored, pa.string()), pa.array(chains, pa.list_(pa.string())), pa.array(garbled, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", restored string, chains array<string>, garbled boolean"
    return spread(df.select(*keys, text), *keys).mapInArrow(run, schema)
