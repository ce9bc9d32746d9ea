"""Language labels, and the labelled texts on which models of this subpackage are trained: all of them, or a bounded sample."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the training sample: rows drawn by hash from the whole table, then rows kept per language.
SAMPLE_ROWS = 8_000
ROWS_PER_LANGUAGE = 40

# Spellings of the languages' names and codes.
SPELLINGS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "ru": "ru rus russian русский",
    "el": "el ell gre greek ελληνικά ελληνικα",
    "tr": "tr tur turkish türkçe turkce",
    "ar": "ar ara arabic العربية عربي",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "zh": "zh zho chi chinese 中文 汉语 漢語 mandarin",
    "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어",
    "th": "th tha thai ไทย ภาษาไทย",
}
#: Letters beyond a to z that words of a Latin language hold.
ALPHABETS = {"en": "éïèêâç", "de": "äöüßéẞ", "fr": "àâäçéèêëîïôöùûüÿœæ", "es": "áéíóúüñ", "pt": "áâãàçéêíóôõúü", "it": "àèéìíîòóùú", "nl": "éëïóöüáèêä", "tr": "çğıöşüâîûi̇"}
LANGUAGES = list(SPELLINGS)
SCRIPT_OF = {"ru": "Cyrillic", "el": "Greek", "ar": "Arabic", "hi": "Devanagari", "zh": "Han", "ja": "Han", "ko": "Hangul", "th": "Thai"}
LATIN = [x for x in LANGUAGES if x not in SCRIPT_OF]
SCRIPT_CLASS = {
    "Cyrillic": "Ѐ-ԯ",
    "Greek": "Ͱ-Ͽἀ-῿",
    "Arabic": "؀-ۿ",
    "Devanagari": "ऀ-ॿ",
    "Han": "぀-ヿ㐀-䶿一-鿿々",
    "Hangul": "가-힣",
    "Thai": "฀-๿",
}


def labelled(label: Column) -> Column:
    """The language that a label names in any spelling; null if it is missing or names none."""
    table = F.create_map(*(F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)))
    clean = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    first = F.regexp_extract(clean, r"^([^-_ (/]+)", 1)
    return F.coalesce(F.element_at(table, clean), F.element_at(table, first))


#: Files of a table from which the sample is drawn, chosen by the hash of their names.
SAMPLE_FILES = 64
_drawn: dict[tuple, dict[str, list[str]]] = {}


def training_texts(chapters: DataFrame, sources: DataFrame) -> dict[str, list[str]]:
    """Texts by labelled language, at most ROWS_PER_LANGUAGE each, chosen by hash among SAMPLE_ROWS of SAMPLE_FILES files, so that
    a corpus is not read as a whole for a sample. They are drawn once in a session for the same files."""
    spark, files = chapters.sparkSession, sorted(chapters.inputFiles())
    key = (spark.sparkContext.applicationId, tuple(files), tuple(sorted(sources.inputFiles())))
    if files and key in _drawn:
        return _drawn[key]
    if len(files) > SAMPLE_FILES:
        chosen = sorted(files, key=lambda f: hashlib.md5(f.encode()).digest())[:SAMPLE_FILES]
        chapters = spark.read.schema(chapters.schema).parquet(*chosen)
    total = chapters.count()  # from the files' footers
    keep = F.pmod(F.xxhash64("chapter_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, total))) + 1)
    drawn = chapters.where(keep & (F.length("text") > 200)).select("chapter_id", "source_id", "text")
    known = sources.select("source_id", labelled(F.col("language_tag")).alias("lang")).where("lang IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("chapter_id"), "chapter_id"))
    rows = drawn.join(known, "source_id").withColumn("rank", rank).where(F.col("rank") <= ROWS_PER_LANGUAGE).select("lang", "text").collect()
    out: dict[str, list[str]] = {}
    for lang, text in rows:
        out.setdefault(lang, []).append(text)
    if files:
        _drawn[key] = out
    return out


def labelled_texts(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """(chapter_id, lang, text) of all chapters whose source names its language."""
    known = sources.select("source_id", labelled(F.col("language_tag")).alias("lang")).where("lang IS NOT NULL")
    return chapters.where("text IS NOT NULL").join(known, "source_id").select("chapter_id", "lang", "text")


_split = re.compile(r"(?<=[.!?…。！？।؟])[\"”’»“«)\]」』]*\s+|[\r\n]+|(?<=[。！？])")


#: The same for texts without full-width marks, by the first character of what parts sentences.
_split_blank = re.compile(r"[\"”’»“«)\]」』\s](?:(?<=[.!?…।؟][\"”’»“«)\]」』])[\"”’»“«)\]」』]*\s+|(?<=[.!?…।؟]\s)\s*|(?<=[\r\n])[\r\n]*)")
_wide_mark = re.compile("[。！？]")
_markup = re.compile(r"[<>{}\\|*_#=~`\[\]]")
_no_letters = bytes(c for c in range(128) if not chr(c).isalpha())
_latin_runs = "A-Za-zÀ-ɏ"
_runs = {lang: re.compile(f"[{SCRIPT_CLASS.get(SCRIPT_OF.get(lang, ''), _latin_runs)}]+") for lang in ("", *LANGUAGES)}


def clean_sentences(texts: list[str], lang: str, suspicious: re.Pattern) -> list[str]:
    """Sentences in the script of the language, without signs of markup or of a wrong decoding."""
    own = _runs[lang if lang in SCRIPT_OF else ""]
    out = []
    for text in texts:
        for sentence in (_split if _wide_mark.search(text) else _split_blank).split(text):
            plain = sentence.isascii()
            held = (0 if lang in SCRIPT_OF else len(sentence.encode().translate(None, _no_letters))) if plain else sum(map(len, own.findall(sentence)))
            if held <= 10 or _markup.search(sentence):  # less than 0.85 of 13 letters
                continue
            letters = held if plain else sum(map(str.isalpha, sentence))
            if letters > 12 and held >= 0.85 * letters and (plain or not suspicious.search(sentence)):
                out.append(sentence)
    return out
