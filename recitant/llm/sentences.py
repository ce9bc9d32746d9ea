"""Problem 3: sentence ends in all languages and scripts, by a finite transducer.

A lexer turns each place where a sentence might end into class symbols: of the token before it, of the mark itself (blank
line, closing mark, quotation mark, Thai blank), and of what follows. A class is looked up for a token alone (a kind of
abbreviation, an initial, a number, a word that begins sentences, a month, a reporting clause, a letter case); no rule is
decided there. The rules over the symbols are compiled into the tables ``STEP[state, symbol]`` and ``EMIT[state, symbol]``: a
state holds the kind of quotation that the text is in and, within a place, the symbols read so far, so the token behind a
mark decides as a lookahead in the state. As a place begins and ends without such memory, its three symbols are composed
to one letter, a function over the nine states of quotation (``LETTERS``).

Texts of an Arrow batch are laid end to end and cut into blocks of equal length. Each block becomes a function from states
to states, the functions are composed by a parallel prefix scan (doubling), and each block then emits from its true
start state. A long text can be lexed in windows with halos by many tasks; only letters then meet for the scan.

Abbreviations are those of the lists below and those that collocation statistics over all chapters find:
types which are followed by a full stop nearly always, and then mostly by what can't begin a sentence.

Defined results: null, empty and blank texts have no sentence; a paragraph without a closing mark is one
sentence; a quotation that is not closed in its paragraph counts as not opened; equal rows give equal rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .encoding import LATIN_FORMS, LOOKALIKES

# Abbreviations, in lower case and without the last full stop.
#: A name or the rest of the sentence follows.
LEADING = frozenset(
    "mr mrs ms dr prof capt lt col gen sgt rev hon messrs sen gov pres rep maj cmdr adm amb supt atty det insp fr eq eqn def thm prop lem cor sr sra srta dra dña d hr fr herrn frl sig sigg sig.ra sig.na avv dott dott.ssa mme mlle mgr me dhr mevr mw drs ir ing "
    "инж проф акад тов г-н г-жа им ул κ κα κος δρ καθ sn doç yrd av e.g i.e viz cf approx aprox ca circa env c.-à-d p.ex p.ej p.es z.b d.h bzw evtl ggf inkl vgl sog hrsg "
    "bijv bv fa avda av profa d.w.z o.a m.a.w т.е напр тыс млн млрд ок π.χ δηλ örn yak bkz m.e v.a u.a i.d.r ex ej es mt".split()
)
#: A number follows; before a capital letter they end a sentence.
BEFORE_NUMBER = frozenset(
    "no nos nr nro núm núms num n nº fig figs sec secs sect ch chap vol vols p pp pág págs pag pagg blz s bd kap abb art tel стр рис гл с т d h д σελ αρ κεφ sf say cap cáp tab "
    "jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
#: They end a sentence before a capital letter.
TRAILING = frozenset(
    "etc usw ecc enz vs vb др пр т.д т.п и.т.д co bros inc ltd corp jr p.m a.m ph.d m.d b.c a.d κ.λπ κ.ά ibid ff cie cía hnos gebr f.lli s.a s.p.a gmbh ag şti ort π.μ μ.μ u.s.w e.a ltda irmãos e.d".split()
)
#: Words that begin a sentence and are no part of a name.
STARTERS = frozenset(
    "the a an in on at by for from of as and but no not this that these those there he she it we they you i his her our my their its one everyone someone nobody years long somewhere without then "
    "der die das ein eine kein keine niemand in am an um auf mit und aber er sie es wir unser unsere ihr sein "
    "le la les un une des il elle nous notre son sa personne comme des de du dans sur avec et mais "
    "el los las una nadie su nuestra nuestro por en con y pero como o os as um uma ninguém seu sua nosso nossa na no lo gli i nessuno suo sua nostra come all nella "
    "de het een niemand haar zijn onze op и в на но он она мы никто наша её его ο η το οι τα κανείς ένας μια στο bir bu o hiç kimse bütün".split()
)
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split())
ORDINAL_BEFORE = frozenset("am der die das dem den des vom zum im bis ab seit jeder jedes jede beim zur".split())
#: Reporting clauses where letter case doesn't show that the sentence goes on.
REPORTING = re.compile(
    r"[^。！？\n]{0,14}?(?:低声说|说道|问道|答道|回答|喊道|叫道|说|问|喊|答|叫)[了着]?[。，！？,]"
    r"|[」』”]?と[^。\n]{0,30}"
    r"|\s*(?:[가-힣]+\s+){0,4}(?:말했다|물었다|속삭였다|대답했다|외쳤다|소리쳤다|했다)[.,]"
    r"|\s*(?:라고|하고|이라고)"
    r"|\s*(?:[ऀ-ॿ]+\s+){1,5}?(?:कहा|पूछा|फुसफुसाया|फुसफुसाई|चिल्लाया|चिल्लाई|बोला|बोली|बोले|जवाब दिया)\s*[।,]"
    r"|\s*(?:قال|قالت|قالوا|سأل|سألت|همس|همست|صاح|صاحت|صرخ|أجاب|أجابت|رد|ردت|هتف)\b"
    r"|\s*[ก-๛]{0,18}?(?:พูด|ถาม|กระซิบ|ตอบ|ตะโกน|กล่าว)"
)

EVENT = re.compile(
    r"(?P<par>[^\S\r\n]*(?:\r\n|[\r\n])[^\S\r\n]*(?:\r\n|[\r\n])\s*)"
    r"|(?P<term>(?:[.!?…。！？｡।॥؟۔\u037e]|(?<=[\u0370-\u03ff\u1f00-\u1fff]);)+[)\]）】〕]*)"
    r"|(?P<quote>[“”„\"«»「」『』‘]|(?<![^\W\d_])['’]|['’](?![^\W\d_]))"
    r"|(?P<thai>(?<=[฀-๿])\s+(?=\S)|(?<=[^\W\d_])\s+(?=[฀-๿]))"
)
_closers = re.compile(r"[)\]）】〕”’\"'»」』“«]*")
_lead = re.compile(r"[^\w\s]*(?:[“„«»\"'‘(\[¿¡「『]\s?)?[^\w\s]*")
_token = re.compile(r"\S+$")
_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
MARKS = ".!?…。！？｡।॥؟۔\u037e"
WIDE = "。！？｡।॥"
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿、-〿＀-￯]")

_unseen = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\ufe00-\ufe0f]+")
_ascii_letter = re.compile("[A-Za-z]")
_latin = str.maketrans(LOOKALIKES, LATIN_FORMS)

# ---- symbols
# Of the token before a full stop.
WORD, LEAD, NUMBERED, TRAIL, INITIAL, ALWAYS, DOTTED, SAINT, NAME_SAINT, LINE_NUMBER, NUMBER, ORDINAL, HANGUL, ANY = range(14)
# Of the mark.
STOP, MARK, ARABIC, OTHER_MARK, WIDE_MARK = range(5)
# Of what follows it: after a blank, then without one.
END, COMMA, CLOSER, LOWER, UPPER, STARTER, DIGIT, MONTH, OTHER, TIGHT_OPEN, TIGHT_CJK, TIGHT_HANGUL, TIGHT_ALPHA, TIGHT_CLOSER, TIGHT = range(15)
# Before a quotation mark: whether a sentence has ended there, then whether the mark stands within a sentence.
NOT_ENDED, ENDED, THAI_ENDED = range(3)
# Behind a closing one.
Q_NONE, Q_END, Q_GOES_ON, Q_LOWER, Q_UPPER, Q_REPORT, Q_OTHER = range(7)
FAMILIES = {"“": 0, "”": 0, "„": 0, '"': 0, "«": 0, "»": 0, "‘": 1, "’": 1, "'": 1, "「": 2, "」": 2, "『": 3, "』": 3}
OPEN, CLOSE, BOTH = range(3)

#: The three kinds of places as triples of symbols (kind, before, mark, behind), and those that are one symbol.
RESET, PAR, SKIP = ("reset",), ("par",), ("skip",)


def places() -> Iterator[tuple]:
    yield from (RESET, PAR, SKIP)
    yield from (("term", left, mark, right) for left in range(14) for mark in range(5) for right in range(15))
    yield from (("quote", (ended, inside), (family, how), (after, thai)) for ended in range(3) for inside in range(2) for family in range(4) for how in range(3) for after in range(7) for thai in range(2))
    yield from (("thai", left, 0, right) for left in range(2) for right in range(4))


# ---- rules
def belongs(left: int, right: int) -> bool:
    """Whether a full stop after a token of class ``left`` belongs to the token, given what follows."""
    if left in (LEAD, ALWAYS, SAINT, LINE_NUMBER):
        return True
    if left in (INITIAL, DOTTED, NAME_SAINT, ORDINAL):
        return right != STARTER
    return left == NUMBERED and right == DIGIT or left == NUMBER and right == MONTH


def ends_at_mark(left: int, mark: int, right: int) -> bool:
    """Whether a sentence ends at a closing mark outside quotations."""
    if mark == WIDE_MARK:
        return right != TIGHT_CLOSER
    if right in (END, COMMA, CLOSER, LOWER, TIGHT, TIGHT_CLOSER):
        return False
    if right == TIGHT_OPEN:
        return mark in (MARK, ARABIC)
    if right == TIGHT_CJK:
        return mark in (MARK, ARABIC)
    if right == TIGHT_HANGUL:
        return mark == STOP and left == HANGUL or mark == ARABIC
    if right == TIGHT_ALPHA:
        return mark == ARABIC
    return not (mark == STOP and belongs(left, right))


def ends_at_quote(ended: int, how: int, after: int, thai_goes_on: int) -> int:
    """0: the sentence goes on behind a closing quotation mark; 1: it ends, as far as a script without letter case tells;
    2: it ends."""
    if how == OPEN or ended == NOT_ENDED or after == Q_NONE:
        return 0
    final = {Q_END: 2, Q_UPPER: 2, Q_OTHER: 1}.get(after, 0)
    return (0 if thai_goes_on else 2) if final and ended == THAI_ENDED else final


N_STATES = 9


def compile_rules() -> tuple[np.ndarray, np.ndarray, dict[tuple, list[int]]]:
    """STEP and EMIT over single symbols, and the symbols of each place. State 0 is outside; 1 + 2 * family + inside is within
    a quotation that began at a sentence start (inside 0) or within a sentence (inside 1). Further states are those nine
    with the symbols of the place that were read before."""
    symbols: dict[tuple, int] = {}
    memory: dict[tuple, int] = {(): 0}
    spelled: dict[tuple, list[int]] = {}
    for place in places():
        parts = [(place[0], k, x) for k, x in enumerate(place[1:])] or [place]
        spelled[place] = [symbols.setdefault(x, len(symbols)) for x in parts]
        for k in range(1, len(parts)):
            memory.setdefault(tuple(parts[:k]), len(memory))
    shape = (N_STATES * len(memory), len(symbols))
    step, emit = np.repeat(np.arange(shape[0], dtype=np.uint16)[:, None], shape[1], axis=1), np.zeros(shape, dtype=bool)
    for place, codes in spelled.items():
        parts = [(place[0], k, x) for k, x in enumerate(place[1:])]
        for state in range(N_STATES):
            for k in range(len(parts) - 1):
                step[memory[tuple(parts[:k])] * N_STATES + state, codes[k]] = memory[tuple(parts[: k + 1])] * N_STATES + state
            to, out = _rule(place, state)
            at = memory[tuple(parts[:-1])] * N_STATES + state
            step[at, codes[-1]], emit[at, codes[-1]] = to, out
    return step, emit, spelled


def _rule(place: tuple, state: int) -> tuple[int, bool]:
    """(state behind a place, whether a sentence ends there)."""
    kind = place[0]
    if kind == "skip":
        return state, False
    if kind in ("reset", "par"):
        return 0, kind == "par"
    if kind == "term":
        return state, state == 0 and ends_at_mark(*place[1:])
    if kind == "thai":
        return state, state == 0 and place[1] == 0 and place[3] == 0
    (ended, inside), (family, how), (after, thai) = place[1:]
    final = ends_at_quote(ended, how, after, thai)
    if how == OPEN:
        return (1 + 2 * family + inside, False) if state == 0 else (state, False)
    if state and (state - 1) // 2 == family:
        return 0, final == 2 or final == 1 and (state - 1) % 2 == 0
    if state == 0:
        return (1 + 2 * family + inside, False) if how == BOTH and family == 0 else (0, how == CLOSE and final > 0)
    return state, False


STEP, EMIT, SPELLED = compile_rules()
#: Number of each place as a letter.
LETTERS = {place: k for k, place in enumerate(SPELLED)}


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The function of each letter over the states of quotation: its symbols' steps one after the other."""
    to, out = np.zeros((N_STATES, len(LETTERS)), dtype=np.uint8), np.zeros((N_STATES, len(LETTERS)), dtype=bool)
    for place, k in LETTERS.items():
        state = np.arange(N_STATES)
        for symbol in SPELLED[place]:
            out[:, k] |= EMIT[state, symbol]
            state = STEP[state, symbol]
        to[:, k] = state
    return to, out


TO, OUT = compose()
_RESET, _PAR, _SKIP = LETTERS[RESET], LETTERS[PAR], LETTERS[SKIP]


def prefix_states(letters: np.ndarray, block: int = 64) -> np.ndarray:
    """The state before each letter, starting outside.

    Blocks are composed to functions column by column, the block functions by doubling; every step is one
    gather over all blocks at once.
    """
    n = len(letters)
    blocks = max(1, -(-n // block))
    padded = np.full(blocks * block, _SKIP, dtype=np.uint16)
    padded[:n] = letters
    grid = padded.reshape(blocks, block)
    functions = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (blocks, N_STATES)).copy()
    for column in range(block):
        functions = TO[functions, grid[:, column, None]]
    shift = 1
    while shift < blocks:  # inclusive scan: later function after earlier function
        functions[shift:] = np.take_along_axis(functions[shift:], functions[:-shift].copy(), axis=1)
        shift *= 2
    states = np.zeros((blocks, block), dtype=np.uint8)
    state = np.concatenate([[0], functions[:-1, 0]]).astype(np.uint8)
    for column in range(block):
        states[:, column] = state
        state = TO[state, grid[:, column]]
    return states.reshape(-1)[:n]


# ---- lexer
_dotted = re.compile(r"(?:[^\W\d_]{1,3}\.)+-?[^\W\d_]{1,3}")
_arabic_short = re.compile(r"[؀-ۿ]{1,2}")
#: No token that a rule knows is longer, whatever the text.
LONGEST = 40


def class_before(text: str, at: int, learned: frozenset[str]) -> int:
    """Class of the token that ends at ``at``."""
    left = text[max(0, at - LONGEST) : at]
    found = _token.search(left)
    if not found:
        return WORD
    token = _unseen.sub("", found.group())
    if not token.isascii() and _ascii_letter.search(token):  # look-alike letters in a Latin word
        token = token.translate(_latin)
    token = token.lstrip("([{“„«»\"'‘「『¿¡*_")
    word = token.lower()
    before = left[: found.start()]
    if word.isdigit():
        line = re.search(r"(?:^|[\r\n])[^\S\r\n]*$", before)
        if line and (found.start() > 0 or at <= LONGEST):
            return LINE_NUMBER
        previous = _token.search(before.rstrip())
        return ORDINAL if previous and previous.group().lower() in ORDINAL_BEFORE and int(word) <= 31 else NUMBER
    if _arabic_short.fullmatch(word) or "ऀ" <= word[-1:] <= "ॿ":
        return ALWAYS
    if len(token) == 1 and token.isalpha():
        if token.isupper():
            return INITIAL
        if "a" <= word <= "z":
            return ALWAYS
        if word in LEADING or word in ("г", "д") and not before.rstrip()[-1:].isdigit() and not before.rstrip().endswith("."):
            return LEAD
        return NUMBERED
    if word == "st":
        previous = _token.search(before.rstrip())
        return NAME_SAINT if previous and previous.group()[:1].isupper() else SAINT
    tail = re.split(r"[-–/’']", word)[-1] if word not in LEADING else word
    if word in TRAILING or tail in TRAILING:
        return TRAIL
    if word in LEADING or tail in LEADING and tail != word or word in learned:
        return LEAD
    if word in BEFORE_NUMBER:
        return NUMBERED
    if _dotted.fullmatch(word):
        return DOTTED
    return HANGUL if "가" <= word[-1:] <= "힣" else WORD


def class_behind(text: str, at: int, end: int, mark: str) -> tuple[int, int]:
    """(class of what follows a closing mark that ends at ``end``, where its first letter is)."""
    n = len(text)
    if mark[-1] in WIDE or mark[-1] == "…" and mark[0] in WIDE:
        return (TIGHT_CLOSER if text[end : end + 1] in ("”", "’", "」", "』", '"', "»") and end < n else OTHER), end
    after = hidden.end() if (hidden := _unseen.match(text, end)) else end
    if after >= n:
        return END, after
    follow = text[after]
    if not follow.isspace():
        if follow in "“„«‘「『":
            return (TIGHT_CJK if follow in "「『" else TIGHT_OPEN), after
        if "가" <= follow <= "힣":
            return TIGHT_HANGUL, after
        if CJK.match(follow):
            return (TIGHT_CJK if follow not in "、，」』）" else TIGHT), after
        return (TIGHT_ALPHA if follow.isalpha() else TIGHT), after
    here = after
    while here < n and text[here].isspace():
        here += 1
    if here >= n:
        return END, here
    if text[here] in ",;:、，；：،)]":
        return COMMA, here
    if text[here] in "»”’" and not (text[here] == "»" and here + 1 < n and text[here + 1].isalpha()):
        return CLOSER, here
    lead = _lead.match(text, here).end()
    first = text[lead] if lead < n else ""
    if first.islower():
        return LOWER, lead
    if first.isdigit():
        return DIGIT, lead
    word = _word.match(text, lead)
    follower = word.group().lower() if word else ""
    if follower in MONTHS:
        return MONTH, lead
    if follower in STARTERS and not text.startswith(".", lead + len(follower)):
        return STARTER, lead
    return (UPPER if first.isupper() else OTHER), lead


def class_behind_quote(text: str, after: int) -> int:
    """Class of what follows a closing quotation mark that ends at ``after``."""
    n, here = len(text), after
    while here < n and text[here].isspace():
        here += 1
    if here >= n:
        return Q_END
    spaced, mark = here > after, text[here]
    lead = _lead.match(text, here).end()
    first = text[lead] if lead < n else ""
    if mark in ",;:、，；：،-–—":
        return Q_UPPER if mark in "-–—" and spaced and first.isupper() else Q_GOES_ON
    if mark in MARKS and not spaced:
        return Q_GOES_ON
    if first.islower():
        return Q_LOWER
    if first.isupper() or first.isdigit():
        return Q_UPPER if spaced or mark in "“„«»「『\"" else Q_GOES_ON
    return Q_REPORT if REPORTING.match(text, after) or REPORTING.match(text, here) else Q_OTHER


_blank_line = re.compile(r"\n\s*\n\s*$")


def _after_blank_line(text: str, at: int, core: int) -> bool:
    """Whether a blank line lies between ``core`` and ``at``."""
    return text.count("\n", core, at) > 1 and _blank_line.search(text, core, at) is not None


def lex(text: str, learned: frozenset[str] = frozenset()) -> tuple[list[int], list[int], list[int]]:
    """Letters of a text, and for each where a sentence that it ends would end, and where its place begins."""
    letters: list[int] = []
    ends: list[int] = []
    begins: list[int] = []
    n = len(text)
    for found in EVENT.finditer(text):
        kind, at, end = found.lastgroup, found.start(), found.end()
        if kind == "par":
            place, stop = PAR, at
        elif kind == "term":
            run, stop = found.group().rstrip(")]）】〕"), end
            right, lead = class_behind(text, at, end, run)
            if right in (END, COMMA, CLOSER, LOWER, TIGHT):
                continue  # no rule ends a sentence here
            mark = WIDE_MARK if run[-1] in WIDE or run[-1] == "…" and run[0] in WIDE else STOP if run == "." else MARK if run[-1] in "!?" else ARABIC if run[-1] in "؟۔" else OTHER_MARK
            place = ("term", class_before(text, at, learned) if mark == STOP else ANY, mark, right)
        elif kind == "thai":
            follow = text[end] if end < n else ""
            right = 1 if follow.isdigit() else 2 if follow in ")]”’»," else 3 if "\n" in found.group() and re.search(r"\n\s*\n", found.group()) else 0
            place, stop = ("thai", int(text[at - 1].isdigit()), 0, right), at
        else:
            mark = found.group()
            previous = text[at - 1] if at else " "
            follow = text[end] if end < n else " "
            if mark in "'’":
                opens = mark == "'" and (previous.isspace() or previous in "([“\"") and follow.isalpha()
                if not (opens or previous in ".,!?…" and not follow.isalpha()):
                    continue
                how = OPEN if opens else CLOSE
            elif mark in "„‘「『":
                how = OPEN
            elif mark in "”」』":
                how = CLOSE
            else:
                left = previous.isspace() or previous in "([{—–-：:，,「『¿¡"
                right = follow.isspace() or follow in ".,;:!?)]}…。，！？、；：»”’"
                if mark == "«" and follow in "\xa0\u202f" and (left or previous.isspace()):
                    left, right = True, False
                elif mark == "»" and previous in "\xa0\u202f" and right:
                    left, right = False, True
                elif mark == "“" and not left and not right and not previous.isspace():
                    left = True
                how = OPEN if left and not right else CLOSE if right and not left else BOTH
            core = at
            while core > 0 and (text[core - 1].isspace() or text[core - 1] in "”’\"'»」』)]）"):
                core -= 1
            thai = core > 0 and "฀" <= text[core - 1] <= "๿"
            ended = THAI_ENDED if thai else ENDED if core > 0 and (text[core - 1] in MARKS or text[core - 1] == ";" and core > 1 and "\u0370" <= text[core - 2] <= "\u1fff") else NOT_ENDED
            inside = not (core == 0 or text[core - 1] in MARKS or _after_blank_line(text, at, core)) and not (at and thai and previous.isspace())
            stop, after, thai_goes_on = end, Q_NONE, 0
            if how != OPEN:
                stop = _closers.match(text, end).end() if follow in ")]）】〕" else end
                if ended and (follow.isspace() or end >= n or CJK.match(follow) or how == BOTH or stop > end or follow in "“„«「『—"):
                    after = class_behind_quote(text, stop)
                    if thai:
                        following = text[stop:].lstrip()[:1]
                        thai_goes_on = int(following.isdigit() or bool(following) and stop < n and not text[stop].isspace())
            place = ("quote", (ended, int(inside)), (FAMILIES[mark], how), (after, thai_goes_on))
        letters.append(LETTERS[place])
        ends.append(stop)
        begins.append(at)
    return letters, ends, begins


def emitted(code: np.ndarray) -> np.ndarray:
    """Whether a sentence ends at each letter. Quotations that are open at the end of their paragraph are taken as not
    opened, and the scan is repeated."""
    while True:
        states = prefix_states(code)
        unclosed = np.flatnonzero(((code == _PAR) | (code == _RESET)) & (states > 0))
        if not len(unclosed):
            return OUT[states, code]
        entered = np.flatnonzero((states == 0) & (TO[states, code] > 0))  # the openers that took effect
        code[entered[np.searchsorted(entered, unclosed) - 1]] = _SKIP


def sentence_ends(texts: list[str | None], learned: frozenset[str] = frozenset()) -> list[list[int]]:
    """Of each text, the number of code points up to the end of each of its sentences."""
    letters: list[int] = []
    ends: list[int] = []
    bounds = [0]
    for text in texts:
        s, e, _ = lex(text, learned) if text else ([], [], [])
        letters += s
        ends += e
        letters.append(_RESET)
        ends.append(0)
        bounds.append(len(letters))
    emits = emitted(np.array(letters, dtype=np.uint16))
    out = []
    for k, text in enumerate(texts):
        if not text:
            out.append([])
            continue
        at, last, own = np.flatnonzero(emits[bounds[k] : bounds[k + 1]]) + bounds[k], 0, []
        for x in [ends[j] for j in at] + [len(text.rstrip())]:
            if x > last and not text[last:x].isspace():
                own.append(x)
                last = x
        out.append(own)
    return out


# ---- abbreviations by collocation
_stopped = re.compile(r"(?<![^\s(\[“„«\"'‘])([^\W\d_]{2,6})(\.?)(?![\w.])")
#: Code points whose tokens are told apart before they are looked at; bounds memory, changes no result.
COUNTED_CHARS = 4_000_000
#: How often an abbreviation is seen, its share with a full stop, and the share of those before what can't begin a sentence.
STOPPED_TIMES, STOPPED_SHARE, INSIDE_SHARE = 10, 0.9, 0.5


class StopCounts:
    """Of each type of two to six letters: how often it is seen, with a full stop, and with one before a small letter, digit
    or comma. No match reaches over a blank, so each distinct token is looked at once."""

    def __init__(self):
        self.whole, self.stopped, self.inside = Counter(), Counter(), Counter()
        self._tokens, self._followed, self._held = Counter(), Counter(), 0

    def add(self, text: str) -> None:
        own = text.split()
        self._tokens.update(own)
        self._followed.update((t, after[0]) for t, after in zip(own, own[1:]) if t[-1] == ".")
        self._held += len(text)
        if self._held > COUNTED_CHARS:
            self.settle()

    def settle(self) -> None:
        """Counts the types of the tokens that were added."""
        for token, n in self._tokens.items():
            for found in _stopped.finditer(token):
                word = found[1].lower()
                self.whole[word] += n
                if found[2]:
                    self.stopped[word] += n
        for (token, following), n in self._followed.items():
            if following.islower() or following.isdigit() or following in ",;:":
                for found in _stopped.finditer(token):
                    if found[2] and found.end() == len(token):
                        self.inside[found[1].lower()] += n
        self._tokens, self._followed, self._held = Counter(), Counter(), 0


def _learned(counts: Iterable[tuple[str, int, int, int]]) -> frozenset[str]:
    return frozenset(w for w, whole, n, inside in counts if n >= STOPPED_TIMES and n >= STOPPED_SHARE * whole and inside > INSIDE_SHARE * n and w not in TRAILING and w not in BEFORE_NUMBER)


def learned_abbreviations(texts: Iterable[str]) -> frozenset[str]:
    """Types of two to six letters that texts show as abbreviations: seen at least ten times, nine times in ten with a
    full stop, and after the full stop mostly a small letter, digit or comma."""
    counts = StopCounts()
    for text in texts:
        counts.add(text)
    counts.settle()
    return _learned((w, counts.whole[w], n, counts.inside[w]) for w, n in counts.stopped.items())


def learned_abbreviations_of(df: DataFrame, key: str, text: str) -> frozenset[str]:
    """``learned_abbreviations`` of all rows. Tasks count their own rows, sums of counts are shuffled, and only types that
    pass are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = StopCounts()
        for batch in batches:
            for t in batch.column(1).to_pylist():
                if t:
                    counts.add(t)
            if len(counts.whole) > 200_000:
                counts.settle()
                yield counted(counts)
                counts = StopCounts()
        counts.settle()
        yield counted(counts)

    def counted(counts: StopCounts) -> pa.RecordBatch:
        words = list(counts.whole)
        columns = [pa.array([c[w] for w in words], pa.int64()) for c in (counts.whole, counts.stopped, counts.inside)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], ["word", "whole", "stopped", "inside"])

    parts = spread(df.select(key, text), key).mapInArrow(run, "word string, whole bigint, stopped bigint, inside bigint")
    sums = parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("whole", "stopped", "inside")))
    passed = sums.where((F.col("stopped") >= STOPPED_TIMES) & (F.col("stopped") >= F.lit(STOPPED_SHARE) * F.col("whole")) & (F.col("inside") > F.lit(INSIDE_SHARE) * F.col("stopped")))
    return _learned(map(tuple, passed.collect()))


def sentence_ends_of(df: DataFrame, key: str, text: str, learned: frozenset[str] = frozenset()) -> DataFrame:
    """(key, sent_end int), a row for each sentence."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ends = sentence_ends(part.column(1).to_pylist(), learned)
                counts = np.array([len(e) for e in ends])
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([keys, pa.array([x for e in ends for x in e], pa.int32())], [key, "sent_end"])

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, sent_end int")


#: Code points of a window of a long text, and of the halos on both sides of it.
WINDOW, WINDOW_HALO = 1 << 20, 1 << 12


def long_sentence_ends_of(df: DataFrame, key: str, text: str, learned: frozenset[str] = frozenset(), window: int = WINDOW, halo: int = WINDOW_HALO) -> DataFrame:
    """``sentence_ends_of`` for tables with giant texts: windows of a text are lexed by tasks of their own; their letters, a
    small part of the text, meet in one task for the scan. A window counts the places that begin in it; what decides
    about a place lies within the halos. ``key`` is unique."""
    kind = dict(df.dtypes)[key]
    cuts = df.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / window).cast("int"))).alias("no"))
    begin = F.col("no") * window
    parts = cuts.select(key, "no", begin.alias("begin"), F.least(begin, F.lit(halo)).alias("lead"), F.substring(text, F.greatest(begin - halo, F.lit(0)) + 1, F.lit(window) + halo + F.least(begin, F.lit(halo))).alias("part"))
    parts = parts.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism), key, "no")

    def lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no, begin, lead, part in zip(*(batch.column(c).to_pylist() for c in range(1, 5))):
                letters, ends, solid = [], [], []
                own = range(lead, lead + window)
                for letter, end, at in zip(*lex(part, learned)):
                    if at in own:
                        letters.append(letter)
                        ends.append(end - lead + begin)
                        bare = len(part[:end].rstrip())
                        solid.append(bare - lead + begin if bare > 0 else -1)
                bare = len(part[lead : lead + window].rstrip())
                rows.append((no, letters, ends, solid, bare + begin if bare else -1))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "no", "letters", "ends", "solid", "last_solid"])

    tables = parts.select(key, "no", "begin", "lead", "part").mapInArrow(lexed, f"`{key}` {kind}, no int, letters array<int>, ends array<int>, solid array<int>, last_solid int")

    def scanned(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        code = np.array([x for r in rows for x in r["letters"]] + [_RESET], dtype=np.uint16)
        emits, own, last, seen, k = emitted(code), [], 0, 0, 0
        for r in rows:
            for end, solid in zip(r["ends"], r["solid"]):
                if emits[k] and end > last and max(seen, solid) > last:
                    own.append(end)
                    last = end
                k += 1
            seen = max(seen, r["last_solid"])
        if seen > last:
            own.append(seen)
        return pa.table({key: pa.array([rows[0][key]] * len(own), table.schema.field(key).type), "sent_end": pa.array(own, pa.int32())})

    return tables.groupBy(key).applyInArrow(scanned, f"`{key}` {kind}, sent_end int")


def sentences_of(df: DataFrame, keys: list[str], text: str, unique: bool = False, learned: frozenset[str] = frozenset()) -> DataFrame:
    """(*keys, sent_no int, sent_start int, sent_end int, sentence string); sent_no counts from 1. With ``unique`` one row of
    each key is looked at."""
    kinds, width = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(width).to_pylist()
                rows: list[tuple[int, int, int, int, str]] = []
                for k, ends in enumerate(sentence_ends(texts, learned)):
                    start = 0
                    for no, end in enumerate(ends, 1):
                        piece = texts[k][start:end]
                        begin = start + len(piece) - len(piece.lstrip())
                        rows.append((k, no, begin, end, texts[k][begin:end]))
                        start = end
                at_ = pa.array([r[0] for r in rows], pa.int32())
                columns = [pa.array([r[c] for r in rows], pa.int32()) for c in (1, 2, 3)] + [pa.array([r[4] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at_) for c in range(width)), *columns], [*keys, "sent_no", "sent_start", "sent_end", "sentence"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sent_no int, sent_start int, sent_end int, sentence string"
    return spread(df.select(*keys, text), *keys, unique=unique).mapInArrow(run, schema)
