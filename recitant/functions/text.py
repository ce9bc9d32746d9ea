"""Text functions as Catalyst expressions. Lengths are code points; blanks are Unicode blanks.

Only entity decoding has no built-in counterpart: it is an Arrow function that sees only texts with ``&``.
All functions give null for null unless stated otherwise.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Unicode blanks as the inside of a character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends: every character that ends a line, CR LF as one.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
GROUP_SEPARATOR = " / "
_BLANK = "\ue000"  # stands for a line that was blank from the start

# Words that mark short sections, words before a section's number, names of front and back matter, provider
# order, progress lines.
SHORT_SECTIONS = ["title page", "table of contents", "copyright", "acknowledg", "dedication", "map", "maps", "cover", "foreword", "afterword", "synopsis", "about the author", "about the publisher"]
NUMBERED_SECTIONS = ["chapter", "part", "epilogue", "prologue"]
FRONT_SECTIONS = [
    "title page", "table of contents", "maps", "cover", "dedication", "copyright", "acknowledgements", "about the author", "also by the author", "about the publisher",
    "continue the adventure",
]
PROVIDER_PRIORITY = ["CUDAExecutionProvider", "DmlExecutionProvider", "ROCMExecutionProvider", "CPUExecutionProvider"]
PROGRESS = r"^\[(\d+)/(\d+)\]\s+([0-9.]+)% .* eta=([0-9.]+)s"


@pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities decoded; rows without ``&`` never leave the JVM."""
    return F.when(F.instr(c, "&") > 0, _unescape(F.when(F.instr(c, "&") > 0, c))).otherwise(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, without outer blanks."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def or_else(c: Column, fallback: str) -> Column:
    return F.when(c == "", F.lit(fallback)).otherwise(c)


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case, all else as single hyphens; ``document`` if nothing stays."""
    return or_else(F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), "document")


def file_component(c: Column) -> Column:
    """A title as part of a file name; ``Document`` if nothing stays."""
    v = collapse(unescape(c))
    v = F.replace(v, F.lit(":"), F.lit(" -"))
    v = F.regexp_replace(v, r'[<>:"/\\|?*]', "-")
    v = F.regexp_replace(v, rf"[{WS}]*-[{WS}]*", " - ")
    v = F.regexp_replace(F.regexp_replace(v, f"[{WS}]+", " "), "^[ .-]+|[ .-]+$", "")
    return or_else(v, "Document")


def clean_plain(c: Column) -> Column:
    v = F.replace(unescape(c), F.lit("\r\n"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(v, "[ \\t]+", " "), r"\n{3,}", "\n\n"))


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?s)\A---[{WS}]*\n.*?\n---[{WS}]*\n", "")


def _without(rule: str):
    return lambda x: F.regexp_replace(x, rule, "")


def clean_markdown(c: Column) -> Column:
    """Markdown to running text: fences out, links and code to their text, tags to blanks; then line by line
    without heading, quote, bullet and number marks; rules and table rules out; blank lines at most one."""
    v = without_front_matter(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    for rule, put in (
        (r"(?s)```.*?```", "\n"), (r"(?s)~~~.*?~~~", "\n"), (r"`([^`]+)`", "$1"), (r"!\[[^\]]*\]\([^)]+\)", " "),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", " "),
    ):
        v = F.regexp_replace(v, rule, put)

    # Each rule goes over all lines in a step of its own, so that no rule is evaluated more than once a line.
    lines = F.transform(F.transform(F.split(v, LINE_END), strip), lambda x: F.when(x == "", F.lit(_BLANK)).otherwise(x))
    for rule in (rf"^#{{1,6}}[{WS}]*", rf"^>[{WS}]*", rf"^[-*+][{WS}]+", rf"^\p{{Nd}}+\.[{WS}]+"):
        lines = F.transform(lines, _without(rule))
    lines = F.filter(lines, lambda x: ~x.rlike(rf"^[-|:{WS}]+\z"))
    lines = F.filter(F.transform(lines, lambda x: collapse(F.translate(x, "|_*", "  "))), lambda x: x != "")
    return strip(F.regexp_replace(F.translate(F.array_join(lines, "\n"), _BLANK, ""), r"\n{3,}", "\n\n"))


def group_parts(c: Column) -> Column:
    """The levels of a group path; an empty list for null."""
    return F.coalesce(F.filter(F.transform(F.split(c, GROUP_SEPARATOR), strip), lambda x: x != ""), F.array().cast("array<string>"))


def group_path(parts: Column) -> Column:
    """Levels joined; null if none holds anything."""
    kept = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, GROUP_SEPARATOR))


def group_leaf(c: Column) -> Column:
    """The last level; ``Chapter`` for null and empty paths."""
    return F.when(c.isNull() | (c == ""), F.lit("Chapter")).otherwise(F.element_at(group_parts(c), -1))


def repair_title(c: Column) -> Column:
    """A title without numbers and section words, as letters and digits only, for matching files."""
    v = F.translate(c, "’“”", "'\"\"")
    v = F.regexp_replace(v, rf"^\p{{Nd}}+[{WS}]*[-.][{WS}]*", "")
    numbered, front = "|".join(NUMBERED_SECTIONS), "|".join(FRONT_SECTIONS)
    for rule in (rf"(?i)^({numbered})[{WS}]+[\p{{L}}\p{{N}}_]+[{WS}]*[-:][{WS}]*", rf"(?i)^({numbered})[{WS}]+[\p{{L}}\p{{N}}_]+[{WS}]+", rf"(?i)^({front})[{WS}]*[-:][{WS}]*"):
        v = F.regexp_replace(v, rule, "")
    return F.regexp_replace(F.lower(v), "[^a-z0-9]+", "")


def track_number(stem: Column, fallback: Column) -> Column:
    """The digits at the begin of a file's stem, else the fallback."""
    return F.coalesce(F.regexp_extract(stem, r"^(\d+)", 1).try_cast("int"), fallback)


def is_short_section(c: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SHORT_SECTIONS)), lambda k: F.contains(F.lower(strip(c)), k))


def clock(seconds: Column) -> Column:
    """``XhYYm`` or ``XmYYs``, downwards, not below zero."""
    total = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    hours, minutes = F.floor(total / 3600).cast("long"), F.floor((total % 3600) / 60).cast("long")
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).otherwise(F.format_string("%dm%02ds", minutes, total % 60))


def provider_list(raw: Column, fallback: list[str] | None = None) -> Column:
    """Entries of a comma-separated list; the fallback if none holds anything."""
    parsed = F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != "")
    return F.when(F.size(F.coalesce(parsed, F.array().cast("array<string>"))) > 0, parsed).otherwise(F.array(*map(F.lit, fallback or PROVIDER_PRIORITY)))


def resolve_provider(available: Column, wanted: Column) -> Column:
    """The first wanted entry that is available, else the CPU's, else the first available; null if none is."""
    cpu = F.lit("CPUExecutionProvider")
    return F.coalesce(F.get(F.array_intersect(wanted, available), F.lit(0)), F.when(F.array_contains(available, cpu), cpu), F.get(available, F.lit(0)))


def provider_record(selected: Column, available: Column, wanted: Column) -> Column:
    """A choice of provider as JSON."""
    return F.to_json(F.struct(selected.alias("selected"), available.alias("available"), wanted.alias("requested")))


def part_name(base: Column, part: Column, multi: Column, stem: Column, leaf: Column, numbered: Column) -> Column:
    """Name of an output part without folder and suffix. ``stem`` is a wished final name or null, ``leaf`` the
    name that a single part gets without one, ``numbered`` whether a single part may still get followers."""

    def tight(c: Column) -> Column:
        return F.trim(F.regexp_replace(file_component(c), rf"[{WS}]*-[{WS}]*", "-"))

    rule = rf"^(\d+)[{WS}]*-[{WS}]*(.+)$"
    wished, own = file_component(stem), tight(base)
    first = F.when(numbered & stem.isNotNull() & wished.rlike(rule), F.concat(F.regexp_extract(wished, rule, 1), F.lit("-01 - "), strip(F.regexp_extract(wished, rule, 2)))).otherwise(F.coalesce(stem, leaf))
    later = F.when(
        stem.isNotNull() & (own == tight(stem)) & own.rlike(rule), F.format_string("%s-%02d - %s", F.regexp_extract(own, rule, 1), part, strip(F.regexp_extract(own, rule, 2)))
    ).otherwise(F.format_string("%02d-%s", part, base))
    return F.when(~multi & (part == 1), first).otherwise(later)


def temporary_part_name(part: Column, stem: Column) -> Column:
    return F.when(stem.isNull() | (stem == ""), F.format_string("_part-%02d", part)).otherwise(F.format_string("tmp-%s-part-%02d", file_component(stem), part))


def is_true(c: Column) -> Column:
    """Whether a setting is switched on; false for null."""
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "on", "debug"), F.lit(False))


def output_paths(root: Column, parts: Column) -> Column:
    """array<struct<wav, mp3>>: the files of an output, numbered where there are several. A single output's name loses its
    suffix, if it has one, for the new one."""
    single = F.regexp_replace(root, r"(?<=[^/])\.[^./]+$", "")
    names = F.when(parts <= 1, F.array(single)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1)).cast("int")), lambda k: F.format_string("%s-part%02d", root, k)))
    return F.transform(names, lambda n: F.struct(F.concat(n, F.lit(".wav")).alias("wav"), F.concat(n, F.lit(".mp3")).alias("mp3")))


def cache_name(source_path: Column) -> Column:
    """The file in which a source's chapters are cached."""
    return F.concat(slug(source_path), F.lit(".json"))


def stem(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def quarantine_name(path: Column) -> Column:
    """One flat name for a replaced file: its path from the root, parts joined by two underscores."""
    return F.replace(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit("__"))
