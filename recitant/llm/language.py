"""Problem 4: the language of every source and of every stretch of text, with a confidence.

Words are found by script; a script narrows the languages that a word may be in (one for most scripts). For
Latin words each language scores the word's character trigrams, bounded so that a name or a borrowed word
can't outweigh its neighbours. Viterbi with a switching penalty then labels the words of a text. It runs over
all texts of a batch at once, step by step through the word positions, the longest texts first, so that a
step is a few array operations over all texts that have that many words.

The trigram tables are trained on a bounded, labelled sample (samples.py); labels that the first table
contradicts are dropped and the table is trained again.

Defined results: a text without letters of the languages has no segment; a source without words has the language null and confidence 0.0; words of scripts of none of
the languages are passed over; confidence is the mean margin of the words' own scores mapped to 0..1.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..tables import spread
from .canonical import one_script_words
from .encoding import SUSPICIOUS, Repairer, suspicious
from .samples import ALPHABETS, LANGUAGES, LATIN, clean_sentences
from .sentences import sentence_ends

#: Cost of a switch, and bound of what one word can say against a language, in nats.
SWITCH = 7.0
BOUND = 4.0
#: What a letter outside a language's alphabet says against it, and the weight of the languages' mean
#: distribution in each language's own, in trigrams: a language with little training text stays neutral.
STRANGE = 1.5
PRIOR = 400.0
#: The same for whole words, in words.
WORD_PRIOR = 1_000.0
#: Words that a batch of texts labels at once; bounds memory, changes no result.
BATCH_WORDS = 2_500_000

_word = re.compile(
    r"[A-Za-zÀ-ɏḀ-ỿ̀-ͯ]+|[Ѐ-ԯ]+|[Ͱ-Ͽἀ-῿]+|[؀-ۿ]+|[ऀ-ॿ]+|[฀-๿]+|[가-힣]+|[぀-ヿ㐀-䶿一-鿿々]+"
)
_ascii_word = re.compile("[A-Za-z]+")
_latin_word = re.compile("[A-Za-zÀ-ɏḀ-ỿ\u0300-\u036f]+")
_other_script = re.compile("[Ͱ-ԯἀ-῿؀-ۿऀ-ॿ฀-๿가-힣぀-ヿ㐀-䶿一-鿿々]")
_kana = re.compile("[぀-ヿ]")
BLANK_LINE = "\n\n"  # other blank lines may stay inside a paragraph, where the sentence rules see them
N = len(LANGUAGES)
AT = {lang: k for k, lang in enumerate(LANGUAGES)}
_alone = {"Ѐ": "ru", "Ͱ": "el", "؀": "ar", "ऀ": "hi", "฀": "th", "가": "ko"}
_latin_at = [AT[x] for x in LATIN]


def trigrams(word: str) -> list[str]:
    w = f" {word.lower()} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


class Rows(dict):
    """Word to the number of its score vector; unseen words are scored when asked for."""

    def __init__(self, score):
        super().__init__()
        self.score, self.vectors = score, []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.vectors)
        self.vectors.append(self.score(word))
        return at


class Model:
    """Trigram scores of the Latin languages, and whole words seen often in one of them."""

    def __init__(self, table: dict[str, np.ndarray], floor: np.ndarray, words: dict[str, np.ndarray]):
        self.table, self.floor, self.words = table, floor, words
        self.rows = Rows(self._score)

    def __getstate__(self):
        return self.table, self.floor, self.words

    def __setstate__(self, state):
        self.__init__(*state)

    def _score(self, word: str) -> np.ndarray:
        """0 is best; -BOUND is the worst that a word says against a language of its script."""
        out = np.full(N, -2 * BOUND, dtype=np.float32)
        c = word[0]
        if c < "Ͱ" or "Ḁ" <= c <= "ỿ":
            grams = trigrams(word)
            score = sum((self.table.get(g, self.floor) for g in grams), np.zeros(len(LATIN)))
            score = score / math.sqrt(len(grams))
            if (seen := self.words.get(word.lower())) is not None:
                score = score + seen
            if not word.isascii():
                score = score - STRANGE * np.array([any(c not in ALPHABETS[x] for c in word.lower() if c > "z") for x in LATIN])
            out[_latin_at] = np.maximum(score - score.max(), -BOUND)
        elif "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or c == "々":
            size = min(3.0, len(word) / 2)
            if _kana.search(word):
                out[AT["ja"]] = 0
            else:
                out[AT["zh"]], out[AT["ja"]] = 0, -0.6 * size
        else:
            for first in ("가", "฀", "ऀ", "؀", "Ѐ", "Ͱ"):
                if c >= first:
                    out[AT[_alone[first]]] = 0
                    break
        return out

    def vectors_of(self, words: list[str]) -> np.ndarray:
        return np.stack([self.rows.vectors[self.rows[w]] for w in words])

    def vectors(self) -> np.ndarray:
        return np.stack(self.rows.vectors) if self.rows.vectors else np.zeros((1, N), dtype=np.float32)

    def trim(self) -> None:
        if len(self.rows) > 300_000:
            self.rows = Rows(self._score)


def train(samples: dict[str, list[str]], common_words: dict[str, list[str]]) -> Model:
    """Trigram log probabilities from clean sentences; the common words of each language count with them."""
    sentences = [(lang, s) for lang in LATIN for s in dict.fromkeys(clean_sentences(samples.get(lang, []), lang, SUSPICIOUS))]
    model = _fit(sentences, common_words)
    kept = []
    for lang, sentence in sentences:
        total = model.vectors_of(_word.findall(sentence))[:, _latin_at].sum(axis=0)
        if LATIN[int(total.argmax())] == lang:
            kept.append((lang, sentence))
    return _fit(kept, common_words)


def _fit(sentences: list[tuple[str, str]], common_words: dict[str, list[str]]) -> Model:
    grams = {lang: Counter() for lang in LATIN}
    words = {lang: Counter() for lang in LATIN}
    for lang, sentence in sentences:
        for w in _word.findall(sentence):
            grams[lang].update(trigrams(w))
            words[lang][w.lower()] += 1
    for lang in LATIN:
        for w in common_words.get(lang, []):
            for g in trigrams(w):
                grams[lang][g] += 5
            words[lang][w.lower()] += 5
    kinds = set().union(*grams.values())
    size = np.array([max(1, sum(grams[x].values())) for x in LATIN], dtype=np.float64)
    counted = {g: np.array([grams[x][g] for x in LATIN], dtype=np.float64) for g in kinds}
    trust = size / (size + PRIOR)  # what a language's own counts weigh in the mean, by how many there are
    mean = {g: float((c / size * trust).sum() / trust.sum()) + 1e-6 for g, c in counted.items()}
    table = {g: np.log((c + PRIOR * mean[g]) / (size + PRIOR)) for g, c in counted.items()}
    floor = np.full(len(LATIN), math.log(PRIOR * 1e-6 / (size.max() + PRIOR)))
    size = np.array([sum(words[x].values()) + 1 for x in LATIN])
    known = {}
    for w in set().union(*words.values()):
        counts = np.array([words[x][w] for x in LATIN])
        if counts.sum() >= 3:
            rate = (counts + 0.3) / (size + WORD_PRIOR)
            known[w] = 0.7 * np.log(rate / rate.max())
    return Model(table, floor, known)


def viterbi(rows: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Best label of each word. ``rows`` are vector numbers of all texts end to end, ``starts`` their begins
    with the end appended."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = starts[:-1][order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    labels = np.zeros(len(rows), dtype=np.uint8)
    if not longest:
        return labels
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
    best = vectors[rows[begins[: active[0]]]].astype(np.float32)
    stays, tops = [], []
    width = vectors.shape[1]
    final = np.zeros((len(sizes), width), dtype=np.float32)
    for t in range(1, longest):
        n = int(active[t])
        if n < len(best):
            final[n : len(best)] = best[n:]
            best = best[:n]
        top = best.argmax(axis=1)
        jump = best[np.arange(n), top] - SWITCH
        stay = best >= jump[:, None]
        best = np.where(stay, best, jump[:, None]) + vectors[rows[begins[:n] + t]]
        if t % 64 == 0:
            best -= best.max(axis=1, keepdims=True)
        stays.append(np.packbits(stay, axis=1))
        tops.append(top.astype(np.uint8))
    final[: len(best)] = best
    state = final.argmax(axis=1).astype(np.uint8)
    for t in range(longest - 1, -1, -1):
        n = int(active[t])
        labels[begins[:n] + t] = state[:n]
        if t:
            stay = np.unpackbits(stays[t - 1], axis=1, count=width)[np.arange(n), state[:n]]
            state[:n] = np.where(stay, state[:n], tops[t - 1])
    return labels


def _labels(rows: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``viterbi`` where the texts whose words are all Latin are searched among the Latin languages alone. A text all of
    whose words are best in one language needs no search: no path is better than staying in it."""
    if not len(rows):
        return np.zeros(0, dtype=np.uint8)
    best = vectors.argmax(axis=1).astype(np.uint8)[rows]
    latin = vectors[:, _latin_at].max(axis=1) == 0
    filled = np.flatnonzero(np.diff(starts) > 0)
    alone = np.zeros(len(starts) - 1, dtype=bool)
    alone[filled] = np.logical_and.reduceat(latin[rows], starts[filled])
    open_ = np.zeros(len(starts) - 1, dtype=bool)
    open_[filled] = np.minimum.reduceat(best, starts[filled]) != np.maximum.reduceat(best, starts[filled])
    labels = best
    for chosen, columns in ((alone & open_, _latin_at), (~alone & open_, list(range(N)))):
        mask = np.repeat(chosen, np.diff(starts))
        if mask.any():
            bounds = np.concatenate([[0], np.cumsum(np.diff(starts)[chosen])])
            labels[mask] = np.array(columns, dtype=np.uint8)[viterbi(rows[mask], bounds, np.ascontiguousarray(vectors[:, columns]))]
    return labels


def label_words(texts: list[str], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[int]]]:
    """(text number, labels, margins, word numbers at which its paragraphs begin) for all texts; margins are
    those of the words' own scores."""
    at = 0
    while at < len(texts):
        rows, starts, marks, first, number = array("i"), [0], [], at, model.rows.__getitem__
        while at < len(texts) and (len(rows) < BATCH_WORDS or at == first):
            begins = []
            find = (_ascii_word if texts[at].isascii() else _word if _other_script.search(texts[at]) else _latin_word).findall
            for part in texts[at].split(BLANK_LINE):
                begins.append(len(rows) - starts[-1])
                rows.extend(map(number, find(part)))
            marks.append(begins)
            starts.append(len(rows))
            at += 1
        flat, begins, vectors = np.frombuffer(rows, dtype=np.int32) if rows else np.zeros(0, dtype=np.int32), np.array(starts), model.vectors()
        labels = _labels(flat, begins, vectors)
        own = vectors[flat, labels] if len(flat) else np.zeros(0)
        for k in range(first, at):
            a, b = starts[k - first], starts[k - first + 1]
            yield k, labels[a:b], own[a:b], marks[k - first]
        model.trim()


def confidence(own: np.ndarray) -> float:
    """1 where every word is best in the language, 0 where every word speaks against it to the bound."""
    return round(float(1 + own.mean() / BOUND), 4) if len(own) else 0.0


_code = re.compile(r"[<>{}=|\\]|https?://|::|\(\)|\$\S")
_marked = re.compile(r"\]\(|\]\[|\[\[|\{\{|<[a-z/!]|\\[a-z]")
#: Code points to a sign of code, and words to a sign of markup, below which a sentence is code or markup.
CODE_CHARS, MARKUP_WORDS = 20, 6
_final = re.compile(r"[.!?…。！？।؟۔;;][”’\"'»“«)\]」』]*$")


def whole_sentences(text: str, labels: np.ndarray, ends: list[int]) -> set[str]:
    """Languages of the whole sentences of a text whose sentences end at ``ends``: text with a closing mark (or in
    Thai), at least three words (six characters in scripts without spaces), four of five of them in that
    language, no code."""
    out: set[str] = set()
    spans = [m.span() for m in _word.finditer(text)]
    k, last = 0, 0
    for end in ends:
        first = k
        while k < len(spans) and spans[k][0] < end:
            k += 1
        sentence = text[last:end].strip()
        last = end
        if k == first:
            continue
        own = labels[first:k]
        if (own == own[0]).all():
            lang, share = int(own[0]), 1.0
            name = LANGUAGES[lang]
            weight = k - first if name not in ("zh", "ja", "th") else sum(b - a for a, b in spans[first:k])
        else:
            weights = np.zeros(N)
            for j in range(first, k):
                weights[labels[j]] += 1 if LANGUAGES[labels[j]] not in ("zh", "ja", "th") else spans[j][1] - spans[j][0]
            lang = int(weights.argmax())
            name, weight, share = LANGUAGES[lang], weights[lang], weights[lang] / weights.sum()
        if name in out or share < 0.8 or weight < (6 if name in ("zh", "ja", "th") else 2 if name in ("ko", "hi", "ar") else 3):
            continue
        if CODE_CHARS * len(_code.findall(sentence)) > len(sentence) or MARKUP_WORDS * len(_marked.findall(sentence)) > k - first:
            continue
        if name == "th" or _final.search(sentence):
            out.add(name)
    return out


def languages_of(texts: list[str], model: Model) -> list[set[str]]:
    """For each text the languages in which it has a whole sentence.

    Blank lines end sentences, so paragraphs can be looked at alone: for each language that has words in a
    text, its paragraphs are taken, the smallest that may hold a sentence first, twice as many each time, until one
    has a whole sentence or all were looked at.
    """
    found: list[set[str]] = [set() for _ in texts]
    wanted: dict[int, dict[str, list[int]]] = {}
    shown: dict[int, tuple[np.ndarray, list[int], list[str]]] = {}
    for k, labels, _, begins in label_words(texts, model):
        if not len(labels):
            continue
        bounds = [*begins, len(labels)]
        shown[k] = (labels, bounds, texts[k].split(BLANK_LINE))
        if labels.min() == labels.max():
            held = [b - a for a, b in zip(bounds, bounds[1:])]
            wanted[k] = {LANGUAGES[labels[0]]: sorted((p for p, n in enumerate(held) if n), key=lambda p: (held[p] < 8, held[p]))}
            continue
        wanted[k] = {}
        for lang in np.unique(labels).tolist():
            held = np.add.reduceat(np.append(labels == lang, False), np.minimum(begins, len(labels)), dtype=np.int64)
            held[np.diff(bounds) == 0] = 0
            order = np.lexsort((held, held < 8))  # the smallest that will do first
            wanted[k][LANGUAGES[lang]] = order[held[order] > 0].tolist()
    size, seen = 1, set()
    while wanted:
        look = []
        for k, languages in wanted.items():
            for lang, parts in languages.items():
                for p in parts[:size]:
                    if (k, p) not in seen:
                        seen.add((k, p))
                        look.append((k, p))
                del parts[:size]
        for (k, p), ends in zip(look, sentence_ends([shown[k][2][p] for k, p in look])):
            labels, begins, parts = shown[k]
            found[k] |= whole_sentences(parts[p], labels[begins[p] : begins[p + 1]], ends)
        wanted = {k: rest for k, languages in wanted.items() if (rest := {x: y for x, y in languages.items() if y and x not in found[k]})}
        size *= 2
    return found


def sentence_languages(df: DataFrame, keys: list[str], text: str, model: Model, repairer: Repairer | None = None) -> DataFrame:
    """(*keys, lang): every language in which a text has at least one whole sentence. Garbled text is
    restored first if a repairer is given."""
    kinds, width = dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _restored(batch.column(width).to_pylist(), repairer)
            rows = [(k, lang) for k, spoken in enumerate(languages_of(texts, model)) for lang in sorted(spoken)]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(width)), pa.array([r[1] for r in rows], pa.string())], [*keys, "lang"])

    return spread(df.select(*keys, text), *keys).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lang string")


def _restored(texts: list[str | None], repairer: Repairer | None) -> list[str]:
    """Texts as they are labelled: words of one script, texts with any suspicious place restored."""
    plain = [one_script_words(t) if t else "" for t in texts]
    return [repairer.text(t)[0] if places else t for t, places in zip(plain, suspicious(plain).tolist())] if repairer else plain


class Places:
    """Places in a restored text as places in the text as it is. Within a segment that was restored, a begin is the
    segment's begin and an end its end; others are the same place."""

    def __init__(self, written: list[str], restored: list[str]):
        self.changed = [a != b for a, b in zip(written, restored)]
        self.to = np.concatenate([[0], np.cumsum([len(x) for x in written])])
        self.from_ = np.concatenate([[0], np.cumsum([len(x) for x in restored])])

    def begin(self, place: int) -> int:
        k = int(np.searchsorted(self.from_, place, side="right")) - 1
        return int(self.to[k] + (0 if self.changed[k] else place - self.from_[k]))

    def end(self, place: int) -> int:
        k = int(np.searchsorted(self.from_, place, side="left")) - 1
        return int(self.to[k + 1] if self.changed[k] else self.to[k] + place - self.from_[k])


def segments(df: DataFrame, key: str, text: str, model: Model, repairer: Repairer | None = None) -> DataFrame:
    """(key, seg_no int, seg_start int, seg_end int, lang, confidence double, n_words int): maximal runs of words in one
    language, as code-point spans of the text. Garbled sentences are labelled by what they were before; a run that begins or
    ends within one begins or ends with it."""
    kind = dict(df.dtypes)[key]
    names = [key, "seg_no", "seg_start", "seg_end", "lang", "confidence", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [one_script_words(t) if t else "" for t in batch.column(1).to_pylist()]
            places: dict[int, Places] = {}
            for k, found in enumerate(suspicious(texts).tolist()) if repairer else ():
                if found:
                    written, restored, chains = repairer.parts(texts[k])
                    if chains:
                        texts[k], places[k] = "".join(restored), Places(written, restored)
            rows: list[tuple] = []
            for k, labels, own, _ in label_words(texts, model):
                if not len(labels):
                    continue
                spans = [m.span() for m in _word.finditer(texts[k])]
                edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                for no, (a, b) in enumerate(zip(edges, edges[1:]), 1):
                    begin, end = spans[a][0], spans[b - 1][1]
                    if k in places:
                        begin, end = places[k].begin(begin), places[k].end(end)
                    rows.append((k, no, begin, end, LANGUAGES[labels[a]], confidence(own[a:b]), b - a))
            types = [pa.int32()] * 3 + [pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), *(pa.array([r[c + 1] for r in rows], t) for c, t in enumerate(types))], names
            )

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, seg_no int, seg_start int, seg_end int, lang string, confidence double, n_words int")
