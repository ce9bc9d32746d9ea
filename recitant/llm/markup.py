"""Problem 1: HTML, Markdown, wiki and LaTeX markup in text, to clean text that keeps its structure.

A text is parsed into a document tree of mixed notations. Its elements are HTML elements, LaTeX environments, fences,
wiki tables and templates, display formulas, and what the line notations stand for: a heading, list item, quotation, row
or rule begins an element of that kind. Block elements, blank lines and line notations divide the text; what lies
between two divisions is a leaf block, and its path is the elements around it. A linear-chain conditional random field
labels the leaf blocks of a text: prose, prose with inline markup, heading, list item, code, formula, table cell or row, or
furniture without content. Its features are the path (each ancestor, the parent, the depth, the place among the siblings),
the constructs that the leaf holds, signs that look like markup, and the shape of its text. It is trained on labelled
pages: random trees written out in one of the notations, cut at random places, in the letters of several scripts, with
signs among them that stand only for themselves. Training is stochastic gradient ascent of the likelihood
(forward-backward), decoding is by Viterbi.

Defined results: null stays null and holds no markup; empty and blank texts hold none; a text without any
sign of a notation is one run of prose by construction and isn't decoded; repeated rows give repeated rows.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..tables import spread

LABELS = ["prose", "inline", "heading", "list", "code", "formula", "table", "furniture"]
AT = {x: k for k, x in enumerate(LABELS)}

# Element names.
TAGS = (
    "a abbr article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn dialog div dl dt em fieldset figcaption figure font footer "
    "form gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img includeonly input ins kbd label legend li link main map mark math menu meta mfrac mi mn mo mrow msqrt msub msup mtext nav nobr "
    "noinclude noscript nowiki object ol onlyinclude option p picture poem pre q ref references rp rt ruby s samp script section select small source span strike strong style sub summary sup svg "
    "syntaxhighlight table tbody td textarea tfoot th thead time timeline title tr track tt u ul var video audio wbr"
).split()
#: Elements that divide a text into blocks.
BLOCKS = frozenset(
    "article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form gallery h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol "
    "option p poem pre section select summary syntaxhighlight table tbody td textarea tfoot th thead title tr ul video audio math".split()
)
VOID = frozenset("hr col img input link meta source track wbr".split())
#: What an element's content is, for the elements whose content isn't running text.
KIND = {
    "pre": "code", "syntaxhighlight": "code", "textarea": "code", "fence": "code", "verbatim": "code", "lstlisting": "code", "math": "formula", "equation": "formula", "equation*": "formula", "align": "formula",
    "align*": "formula", "displaymath": "formula", "gather": "formula", "display": "formula", "array": "formula", "table": "table", "tabular": "table", "wikitable": "table", "row": "table", "ul": "list", "ol": "list", "dl": "list", "menu": "list",
    "itemize": "list", "enumerate": "list", "description": "list", "item": "list", "heading": "heading", "template": "furniture", "raw": "furniture", "rule": "furniture",
}
#: Constructs that plain text may hold as well.
_plain = frozenset(x + y for x in ("path", "number", "quote", "bullet", "rule", "wiki_item", "wiki_cell", "setext", "reference_text") for y in ("", "^", "="))
_raw_text = {"fence", "pre", "syntaxhighlight", "verbatim", "lstlisting", "textarea"}

_tag = rf"</?(?:{'|'.join(TAGS)})(?=[\s/>])[^<>]*>"
#: (construct, strings one of which must be in the text, pattern, what stays of it)
CONSTRUCTS: list[tuple[str, tuple[str, ...], re.Pattern, object]] = [
    ("comment", ("<!--",), re.compile(r"<!--.*?(?:-->|\Z)", re.S), ""),
    ("doctype", ("<!", "<?"), re.compile(r"<![A-Za-z\[][^<>]*>|<\?[a-z][^<>]*\?>"), ""),
    ("style", ("<st", "<sc", "<ST", "<SC"), re.compile(r"<(style|script)\b[^<>]*>.*?</\1>", re.S | re.I), ""),
    ("ref", ("<ref",), re.compile(r"<ref\b[^<>]*(?:/>|>.*?</ref>)", re.S | re.I), ""),
    ("break", ("<br", "<BR", "<hr"), re.compile(r"<[bh]r\b[^<>]*>", re.I), "\n"),
    ("tag", ("<",), re.compile(_tag, re.I), ""),
    ("entity", ("&",), re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"), lambda m: html.unescape(m.group())),
    ("image", ("![",), re.compile(r"!\[([^\[\]]*)\](?:\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[[^\[\]]*\])"), r"\1"),
    ("link", ("](", "]["), re.compile(r"\[([^\[\]]+)\](?:\([^()\s]*(?:\([^()]*\))?(?:\s+\"[^\"]*\")?\)|\[[^\[\]]*\])"), r"\1"),
    ("autolink", ("<http", "<mailto"), re.compile(r"<(?:https?://|mailto:)[^<>\s]+>"), ""),
    ("footnote_text", ("[^",), re.compile(r"^\[\^[^\[\]\s]+\]:[ \t]*", re.M), ""),
    ("reference_text", ("]:",), re.compile(r"^[ \t]{0,3}\[[^\[\]^]+\]:[ \t]*\S+.*$", re.M), ""),
    ("footnote", ("[^",), re.compile(r"\[\^[^\[\]\s]+\]"), ""),
    ("fence", ("```", "~~~"), re.compile(r"^[ \t]*(?:```+|~~~+)[^\n`]*$", re.M), ""),
    ("strike", ("~~",), re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S), r"\1"),
    ("code_span", ("`",), re.compile(r"(?<!`)(`+)(?!`)([^`\n]+(?:\n[^`\n]+)?)(?<!`)\1(?!`)"), r"\2"),
    ("strong", ("**", "__"), re.compile(r"(\*\*\*|\*\*|___|__)(?=\S)((?:(?!\n\s*\n).)+?)(?<=\S)\1", re.S), r"\2"),
    ("star", ("*",), re.compile(r"(?<![\w*\\/])\*(?![\s*])((?:(?!\n\s*\n)[^*])+?)(?<![\s*])\*(?![\w*])|(?<=[぀-鿿가-힣])\*(?![\s*])([^*\n]+?)(?<![\s*])\*(?=[぀-鿿가-힣])", re.S), lambda m: m[1] or m[2]),
    ("underline", ("_",), re.compile(r"(?<![A-Za-z0-9_\\/])_(?![\s_])((?:(?!\n\s*\n)[^_])+?)(?<![\s_])_(?![A-Za-z0-9_])", re.S), r"\1"),
    ("atx", ("#",), re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M), r"\1"),
    ("setext", ("==", "--"), re.compile(r"(?<=\S\n)[ \t]{0,3}(?:=+|-{2,})[ \t]*$", re.M), ""),
    ("rule", ("---", "***", "___", "* *", "- -"), re.compile(r"^[ \t]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M), ""),
    ("quote", (">",), re.compile(r"^[ \t]{0,3}(?:>[ \t]?)+", re.M), ""),
    ("bullet", ("- ", "* ", "+ "), re.compile(r"^[ \t]*[-*+][ \t]+(?=\S)(?:\[[ xX]\][ \t]+)?", re.M), "• "),
    ("number", (". ", ") "), re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)", re.M), None),
    ("pipe_row", ("|",), re.compile(r"^[ \t]*\|.*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M), lambda m: "" if re.fullmatch(r"[\s|:\-]+", m[0]) else "\t".join(c.strip() for c in m[0].strip().strip("|").split("|"))),
    ("escape", ("\\",), re.compile(r"\\([*_`\[\]()#+!>~|.-])"), r"\1"),
    ("wiki_category", ("[[",), re.compile(r"\[\[(?:Category|File|Image|Kategorie|Catégorie|Categoría)\s*:[^\[\]]*\]\]", re.I), ""),
    ("wiki_link", ("[[",), re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    ("wiki_external", ("[http", "[//", "[mailto"), re.compile(r"\[(?:https?:|mailto:|//)\S+?(?:\s+([^\[\]]*))?\]"), lambda m: m[1] or ""),
    ("template", ("{{",), re.compile(r"\{\{([^{}]*)\}\}"), lambda m: _template(m[1])),
    ("wiki_table", ("{|", "|}", "|-"), re.compile(r"^[ \t]*(?:\{\|.*|\|\}|\|-.*|\|\+.*)$", re.M), ""),
    ("wiki_cell", ("|", "!"), re.compile(r"^[ \t]*[|!](?![-}+|])[ \t]*(?=\S)(?!.*\|[ \t]*$)", re.M), ""),
    ("latex_quotes", ("``",), re.compile(r"``([^`'\n]*(?:\n(?!\s*\n)[^`'\n]*)?)''"), r"“\1”"),
    ("wiki_quotes", ("''",), re.compile(r"'{2,5}"), ""),
    ("wiki_heading", ("==",), re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M), r"\2"),
    ("wiki_item", (";", ":", "*", "#"), re.compile(r"^(?:[*#:;]{2,}|[*#])[ \t]*(?=[^\s*#:;-])|^[:;][ \t]*(?=[^\s\-:;)(])", re.M), "• "),
    ("magic", ("__",), re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__"), ""),
    ("path", (":\\",), re.compile(r"\b[A-Za-zС]:(?:\\[\w.\-]+)+\\?"), None),
    ("environment", ("\\begin", "\\end"), re.compile(r"\\(?:begin|end)[ \t]*\{[a-zA-Z]+\*?\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?"), ""),
    ("display_math", ("$$", "\\["), re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S), lambda m: (m[1] or m[2]).strip()),
    ("math", ("$", "\\("), re.compile(r"\\\((.+?)\\\)|(?<![\w\\$])\$(?=[^\s\d$])([^$\n]*?[\\^_={}+<>/-][^$\n]*?|[A-Za-z])(?<!\s)\$(?!\d)|(?<![\w\\$])\$(?=\d)([^$\n]*?(?:\\[a-zA-Z]+|[\^_=])[^$\n]*?)(?<!\s)\$(?!\d)", re.S), lambda m: m[1] or m[2] or m[3]),
    ("dropped", ("\\",), re.compile(r"\\(?:footnote|cite[tp]?|label|ref|pageref|index|vspace|hspace|includegraphics|bibliography|usepackage|documentclass|input|include)\*?(?:\[[^\]]*\])*\{(?:[^{}]|\{[^{}]*\})*\}"), ""),
    ("sectioning", ("\\",), re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph|title|author|caption)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}"), r"\1"),
    ("item", ("\\item",), re.compile(r"\\item(?:\[[^\]]*\])?[ \t]*"), "• "),
    ("command", ("\\",), re.compile(r"(?<![A-Za-z]:)(?<!\\)\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])*\{((?:[^{}]|\{[^{}]*\})*)\}"), lambda m: "…" if m[0].startswith(("\\ldots", "\\dots")) else m[1]),
    ("group", ("{\\",), re.compile(r"\{\\[a-zA-Z]+[ \t]+([^{}]*)\}"), r"\1"),
    ("switch", ("\\",), re.compile(r"\\(?:noindent|par|ldots|dots|quad|qquad|bigskip|medskip|smallskip|newpage|clearpage|centering|hline|maketitle|tableofcontents|LaTeX|TeX|newline|linebreak|textbackslash|indent|hfill|vfill|appendix|and|today)\b[ \t]*"), lambda m: "…" if "dots" in m[0] else ""),
    ("latex_escape", ("\\",), re.compile(r"\\[&%$#{}_](?!\w*\\)|(?<=\S)\\\\(?=\s|$)|\\[,;](?!\w)|\\ (?=\S)|(?<=\w)~(?=\\)", re.M), lambda m: m[0][1] if m[0][:1] == "\\" and m[0][1:2] in "&%$#{}_" else " "),
    ("cut_command", ("\\",), re.compile(r"(?<![A-Za-z]:)(?<![\\\w])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{(?![^{}]*\})|\{\\[a-zA-Z]+\s(?![^{}]*\})|^[^{}\n]*\}\s*$", re.M), None),
    ("cut_link", ("[http",), re.compile(r"\[https?://\S+(?=\s*\Z)|\[https?://\S+[^\]\n]*$", re.M), None),
    ("cut_tag", ("<",), re.compile(rf"</?(?:{'|'.join(TAGS)})(?:\s[^<>]*)?\Z", re.I), ""),
    ("latex_comment", ("%",), re.compile(r"^%.*$", re.M), ""),
]

# Signs that look like markup; features only.
SIGNS: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("s_amp", ("&",), re.compile(r"&(?![#\w]+;)")),
    ("s_dollar", ("$",), re.compile(r"\$\s?\d|\d\s?\$")),
    ("s_star_math", ("*",), re.compile(r"\w\s?\*\s?\w")),
    ("s_star", ("*",), re.compile(r"(?<!\w)\*\w")),
    ("s_under_word", ("_",), re.compile(r"\w_\w")),
    ("s_under", ("_",), re.compile(r"(?<!\w)_\w")),
    ("s_less", ("<",), re.compile(r"<\s?\d|\s<\s")),
    ("s_angle", ("<",), re.compile(rf"<(?!/?(?:{'|'.join(TAGS)})\b)[a-z]+>")),
    ("s_more", (">",), re.compile(r"\s>\s")),
    ("s_hash", ("#",), re.compile(r"#\d|\w#")),
    ("s_square", ("[",), re.compile(r"\[\w+\](?![\[(:])")),
    ("s_brace", ("{",), re.compile(r"(?<![\\{])\{\w+\}")),
    ("s_tilde", ("~",), re.compile(r"\s~\s")),
    ("s_bar", ("|",), re.compile(r"\w\s\|\s\w")),
    ("s_caret", ("^",), re.compile(r"\w\^\w")),
    ("s_equal", ("=",), re.compile(r"\s=\s")),
    ("s_backtick", ("`",), re.compile("`")),
    ("s_backslash", ("\\",), re.compile(r"\\")),
    ("s_url", ("://", "@"), re.compile(r"https?://\S+|\w@\w")),
]
_may = re.compile(r"[<&*_#`\[{\\|$=~^]|''|%|(?m:^[ \t]*(?:[-+>;:]\s?\S|\d{1,3}[.)]\s))|(?m:^[ \t]*[-=]{2,}[ \t]*$)")
_open = re.compile(rf"<(/?)({'|'.join(TAGS)})(?=[\s/>])[^<>]*?(/?)>", re.I)
_raw = re.compile(r"<(style|script)\b[^<>]*>.*?(?:</\1>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_env = re.compile(r"\\(begin|end)[ \t]*\{([a-zA-Z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_fence = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*$", re.M)
_display = re.compile(r"(?m:^)[ \t]*(?:\$\$(?:(?!\$\$|\n\s*\n).)+\$\$|\\\[(?:(?!\n\s*\n).)+?\\\])[ \t]*(?m:$)", re.S)
_template_block = re.compile(r"\{\{[^{}]*\n[^{}]*\}\}")
_blank = re.compile(r"\n(?:[^\S\n]*\n)+")
#: (first characters, element, whether it ends with its line, pattern of the mark), the first that fits.
LINES: list[tuple[str, str, bool, re.Pattern]] = [
    ("#", "heading:atx", True, re.compile(r"[ \t]{0,3}#{1,6}[ \t]+\S")),
    ("=", "heading:wiki", True, re.compile(r"[ \t]*(={1,6})[ \t]*[^=\n].*?[ \t]*\1[ \t]*$")),
    ("\\", "heading:latex", True, re.compile(r"[ \t]*\\(?:part|chapter|(?:sub){0,2}section|paragraph|title)\*?(?:\[[^\]\n]*\])?\{")),
    ("\\", "item:latex", False, re.compile(r"[ \t]*\\item\b")),
    ("-_", "rule:line", True, re.compile(r"[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")),
    ("*", "rule:stars", True, re.compile(r"[ \t]{0,3}(?:\*[ \t]*){3,}$")),
    ("-*+", "item:bullet", False, re.compile(r"[ \t]*[-*+][ \t]+(?=\S)")),
    ("0123456789", "item:number", False, re.compile(r"[ \t]*\d{1,3}[.)][ \t]+(?=\S)")),
    (">", "quote", False, re.compile(r"[ \t]{0,3}>[ \t]?")),
    ("|:-", "row:rule", True, re.compile(r"[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$")),
    ("|", "row:pipe", True, re.compile(r"[ \t]*\|.*\|[ \t]*$")),
    ("|{", "row:wiki", True, re.compile(r"[ \t]*(?:\{\||\|\}|\|-|\|\+)")),
    ("|!", "row:cell", True, re.compile(r"[ \t]*[|!](?![-}+|])[ \t]*(?=\S)")),
    ("*#:;", "item:wiki", False, re.compile(r"(?:[*#:;]{2,}|[*#])[ \t]*(?=[^\s*#:;-])|[:;][ \t]*(?=[^\s\-:;)(])")),
    ("[", "note", False, re.compile(r"[ \t]{0,3}\[\^?[^\[\]\n]+\]:[ \t]*\S")),
    ("=-", "under", True, re.compile(r"[ \t]{0,3}(?:=+|-{2,})[ \t]*$")),
]
_starts = "".join(sorted(set("".join(x for x, *_ in LINES))))
_ended = re.compile(r"[.!?…。！？।؟][\"”’»“«)\]」』]*\s*$")
_codeish = re.compile(r"[;{}]\s*$|^\s*(?:def|for|if|while|return|import|print|var|let|const|function|#include|int|class)\b|\w+\(.*\)\s*[;:]?\s*$|^\s*\w+\s*=\s*\S+$", re.M)


def _template(content: str) -> str:
    parts = content.split("|")
    name = parts[0].strip().lower()
    if name in ("lang", "transl") and len(parts) > 2:
        return parts[-1]
    return parts[1] if name in ("main", "see also", "nowrap", "quote", "small") and len(parts) > 1 else ""


def constructs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, construct) of all constructs, as they lie in the text."""
    found = []
    for name, needed, rule, _ in CONSTRUCTS:
        if any(x in text for x in needed):
            found += [(m.start(), m.end(), name) for m in rule.finditer(text)]
    paths = [(a, b) for a, b, name in found if name == "path"]
    return [x for x in found if x[2] == "path" or not any(a <= x[0] < b for a, b in paths)]


class Leaf(NamedTuple):
    """A leaf block: its span, the elements around it from the outermost, the number of its row of cells (-1 for none)."""

    start: int
    end: int
    path: tuple[str, ...]
    row: int


def tree(text: str) -> list[Leaf]:
    """The leaf blocks of a text whose line ends are line feeds. An end tag closes the innermost open element of its name;
    a stray one, a void element and an element without content are leaves of their own."""
    marks: list[tuple[int, int, str, str]] = []  # (start, end, what, name)
    taken: list[tuple[int, int]] = []

    def free(a: int) -> bool:
        return not any(x <= a < y for x, y in taken)

    def whole(rule: re.Pattern, name: str) -> None:
        for m in rule.finditer(text):
            if free(m.start()):
                taken.append(m.span())
                marks.append((*m.span(), "whole", name))

    if "```" in text or "~~~" in text:
        fences = list(_fence.finditer(text))
        while fences:
            head = fences.pop(0)
            tail = next((k for k, x in enumerate(fences) if x[1][:3] == head[1][:3] and x[0].strip() == x[1]), None)
            if tail is None:
                marks.append((*head.span(), "line", "rule:fence"))
                continue
            taken.append((head.start(), fences[tail].end()))
            marks += [(*head.span(), "open", "fence"), (*fences[tail].span(), "close", "fence")]
            del fences[: tail + 1]
    if "<!--" in text or "<s" in text or "<S" in text:
        for m in _raw.finditer(text):
            if free(m.start()):
                alone = not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip() and not text[m.end() : (text + "\n").find("\n", m.end())].strip()
                if alone or m[1]:
                    taken.append(m.span())
                    marks.append((*m.span(), "whole", "raw"))
    if "{{" in text:
        whole(_template_block, "template")
    if "$$" in text or "\\[" in text:
        whole(_display, "display")
    if "\\" in text:
        marks += [(*m.span(), "open" if m[1] == "begin" else "close", m[2]) for m in _env.finditer(text) if free(m.start())]
    if "<" in text:
        for m in _open.finditer(text):
            name = m[2].lower()
            if name in BLOCKS and free(m.start()):
                marks.append((*m.span(), "close" if m[1] else "void" if m[3] or name in VOID else "open", name))
    marks += [(*m.span(), "blank", "") for m in _blank.finditer(text)]
    at = 0
    for line in text.split("\n"):
        lead = line.lstrip(" \t")
        if lead and lead[0] in _starts and free(at):
            for firsts, name, single, rule in LINES:
                if lead[0] in firsts and rule.match(line):
                    marks.append((at, at, "single" if single else "line", name))
                    marks += [(at + len(line), at + len(line), "stop", "")] if single else []
                    break
        at += len(line) + 1
    order = {"stop": 0, "close": 1, "blank": 2, "single": 3, "line": 3, "open": 4, "void": 4, "whole": 4}
    marks.sort(key=lambda m: (m[0], order[m[2]], m[1]))

    leaves: list[Leaf] = []
    stack: list[tuple[str, int]] = []  # (element, leaves before it)
    begin, rows = 0, 0
    line = ""  # the line element that is open

    def path() -> tuple[str, ...]:
        return (*(x for x, _ in stack), *([line] if line else []))

    def leaf(a: int, b: int, where: tuple[str, ...]) -> None:
        piece = text[a:b]
        if inner := piece.strip():
            a += len(piece) - len(piece.lstrip())
            leaves.append(Leaf(a, a + len(inner), where, rows if {"tr", "row:pipe"} & set(where) else -1))

    for a, b, what, name in marks:
        inside = bool(stack) and stack[-1][0] in _raw_text
        if inside and not (what == "close" and name == stack[-1][0]) or a < begin:
            continue
        if what == "blank":
            leaf(begin, a, path())
            begin, line = b, ""
            continue
        if what in ("single", "line"):
            if name == "under":  # an underlined heading is the line above it
                above = text.rfind("\n", 0, max(0, a - 1)) + 1
                if line or a == 0 or not text[above : a - 1].strip() or above < begin:
                    name = "rule:line"
                else:
                    leaf(begin, above, path())
                    begin, line = above, "heading:under"
                    continue
            leaf(begin, a, path())
            begin, line = a, name
            rows += name == "row:pipe"
            if name == "rule:fence":
                leaf(a, b, path())
                begin, line = b, ""
            continue
        if what == "stop":
            leaf(begin, a, path())
            begin, line = a, ""
            continue
        leaf(begin, a, path())
        begin = b
        if what == "whole" or what == "void":
            leaf(a, b, (*path(), name))
        elif what == "open":
            rows += name == "tr"
            line = ""
            stack.append((name, len(leaves)))
            if name == "p" and any(x == "p" for x, _ in stack[:-1]):  # paragraphs don't nest
                del stack[next(k for k, (x, _) in enumerate(stack) if x == "p")]
        else:
            line = ""
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if found is None:
                leaf(a, b, (*path(), "stray"))
            else:
                empty = stack[found][1] == len(leaves)
                del stack[found:]
                if empty:
                    leaf(a, b, (*path(), name, "empty"))
    leaf(begin, len(text), path())
    for name, before in stack:  # elements that the text opens and neither closes nor fills
        if before == len(leaves):
            found = [m for m in marks if m[2] == "open" and m[3] == name]
            leaf(found[-1][0], found[-1][1], (name, "empty"))
    return sorted(leaves)


def shape_of(piece: str) -> list[str]:
    """Features of a leaf's text alone."""
    n = len(piece)
    letters = sum(map(str.isalpha, piece))
    out = ["ended" if _ended.search(piece) else "open", "short" if n < 60 else "long", "wordless" if letters < 0.4 * n else "worded"]
    if "\n" in piece:
        out.append("lines")
    if piece[:1].isupper():
        out.append("upper")
    elif piece[:1].isdigit():
        out.append("digit")
    return out


def leaves(text: str) -> tuple[list[Leaf], list[list[str]]]:
    """The leaf blocks of a text and their features."""
    blocks = tree(text)
    own: list[set[str]] = [set() for _ in blocks]
    starts, ends = [x.start for x in blocks], [x.end for x in blocks]

    def touched(a: int, b: int) -> range:
        first = bisect_right(ends, a)
        return range(first, max(first, bisect_left(starts, max(a + 1, b))))

    for a, b, name in constructs(text):
        for k in touched(a, b):
            own[k].add(name)
            if a <= starts[k]:
                own[k].add(f"{name}^")
                if b >= ends[k]:
                    own[k].add(f"{name}=")
    for name, needed, rule in SIGNS:
        if any(x in text for x in needed):
            for m in rule.finditer(text):
                for k in touched(m.start(), m.end()):
                    own[k].add(name)
    for m in _open.finditer(text) if "<" in text else ():
        for k in touched(m.start(), m.end()):
            own[k].add(f"tag:{m[2].lower()}")
    features = []
    for k, (block, held) in enumerate(zip(blocks, own)):
        place = [f"in:{x}" for x in dict.fromkeys(block.path)]
        if block.path:
            parent = block.path[-1]
            before, after = k and blocks[k - 1].path == block.path, k + 1 < len(blocks) and blocks[k + 1].path == block.path
            place += [f"parent:{parent}", f"depth:{min(3, len(block.path))}", f"{parent}:{'many' if before or after else 'one'}"]
            place += [f"kind:{KIND[y]}" for x in dict.fromkeys(block.path) if (y := x.partition(":")[0]) in KIND]
        piece = text[block.start : block.end]
        shape = shape_of(piece)
        if block.path and _raw_text.intersection(block.path) and _codeish.search(piece):
            shape.append("codeish")
        if any(x not in _plain and not x.startswith(("s_", "tag:")) for x in held):
            place.append("construct")
        bare = not held and not block.path
        features.append(["bias", *sorted(held), *place, *shape, *(["clean"] if bare else ["signs"] if all(x.startswith("s_") for x in held) and not block.path else [])])
    return blocks, features


class Field:
    """The conditional random field: feature weights per label, and transition weights."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((len(LABELS) + 1, len(LABELS)))  # last row: from the begin

    def scores(self, features: list[list[str]]) -> np.ndarray:
        zero = np.zeros(len(LABELS))
        get = self.weights.get
        return np.array([sum((w for f in fs if (w := get(f)) is not None), zero) for fs in features])

    def decode(self, features: list[list[str]]) -> list[int]:
        scores = self.scores(features)
        best, back = scores[0] + self.moves[-1], []
        for s in scores[1:]:
            paths = best[:, None] + self.moves[:-1]
            came = paths.argmax(axis=0)
            back.append(came)
            best = paths[came, np.arange(len(LABELS))] + s
        state, out = int(best.argmax()), []
        for came in reversed(back):
            out.append(state)
            state = int(came[state])
        out.append(state)
        return out[::-1]

    def learn(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 10, batch: int = 32, seed: int = 7) -> None:
        """AdaGrad steps along the gradient of the log likelihood of a batch of pages, worked on side by side."""
        L, chance = len(LABELS), np.random.default_rng(seed)
        number = {f: k for k, f in enumerate(dict.fromkeys(f for features, _ in pages for fs in features for f in fs))}
        coded = [[np.array([number[f] for f in fs], dtype=np.int64) for fs in features] for features, _ in pages]
        weights, past, moved = np.zeros((len(number), L)), np.full((len(number), L), 1e-2), np.full_like(self.moves, 1e-2)
        lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
        for _ in range(rounds):
            order = chance.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = sorted(order[at : at + batch].tolist(), key=lambda k: -len(coded[k]))
                sizes = np.array([len(coded[k]) for k in own])
                longest, rows = int(sizes[0]), [x for k in own for x in coded[k]]
                flat, counts = np.concatenate(rows), np.array([len(x) for x in rows])
                inside = np.arange(longest)[None, :] < sizes[:, None]  # pages by places, filled from the left
                scores, truth = np.zeros((len(own), longest, L)), np.zeros((len(own), longest, L))
                scores[inside] = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
                labels = np.zeros((len(own), longest), dtype=np.int64)
                labels[inside] = [y for k in own for y in pages[k][1]]
                np.put_along_axis(truth, labels[:, :, None], 1.0, axis=2)
                truth *= inside[:, :, None]
                steps = self.moves[:-1]
                ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
                ahead[:, 0] = scores[:, 0] + self.moves[-1]
                for t in range(1, longest):
                    ahead[:, t] = scores[:, t] + lse(ahead[:, t - 1, :, None] + steps, 1)
                for t in range(longest - 2, -1, -1):
                    on = inside[:, t + 1]
                    behind[on, t] = lse(steps + (scores[on, t + 1] + behind[on, t + 1])[:, None, :], 2)
                total = lse(ahead[:, 0] + behind[:, 0], 1)
                chances = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
                step = np.zeros_like(self.moves)
                step[-1] = (truth[:, 0] - chances[:, 0]).sum(axis=0)
                for t in range(1, longest):
                    on = inside[:, t]
                    pairs = np.exp(ahead[on, t - 1, :, None] + steps + (scores[on, t] + behind[on, t])[:, None, :] - total[on, None, None])
                    step[:-1] += truth[on, t - 1].T @ truth[on, t] - pairs.sum(axis=0)
                moved += step**2
                self.moves += 0.3 * step / np.sqrt(moved)
                used, back = np.unique(flat, return_inverse=True)
                slope = np.zeros((len(used), L))
                np.add.at(slope, back, np.repeat((truth - chances)[inside], counts, axis=0))
                past[used] += slope**2
                weights[used] += 0.3 * slope / np.sqrt(past[used])
        self.weights = {f: weights[k] for f, k in number.items()}


# ---- labelled pages
#: Letters of which words are made: Latin more often than others.
_letters = ["abcdefghiklmnoprstuvz", "abcdefghiklmnoprstuvz", "abcdeéghiklmñoprstuüvz", "абвгдежзиклмнопрстуя", "αβγδεζηικλμνοπρστω", "ابتجدرسعفقلمنهوي", "कखगतदनपमरलसह", "กขคงจชดตนบปมยรลว", "一二三山水火木金土日月年人大小上下中", "가나다라마바사아자하고도로", "‚Ì•ƒ“…^ŒŠ‹ÂÃ©®¶¢¥ˆ‡Žœ°"]  # the last: what a wrong decoding leaves
_wide = 8  # from here on scripts without spaces or with wide marks


class Writer:
    """Random content in the letters of one script; ``without`` names the constructs that it leaves out."""

    def __init__(self, chance: random.Random, without: frozenset[str] = frozenset()):
        self.chance, self.script, self.without = chance, chance.randrange(len(_letters)), without
        self.close = self.script == _wide

    def word(self, most: int = 8) -> str:
        return "".join(self.chance.choice(_letters[self.script]) for _ in range(self.chance.randint(1, most if not self.close else 3)))

    def ascii(self) -> str:
        return "".join(self.chance.choice(_letters[0]) for _ in range(self.chance.randint(2, 8)))

    def number(self) -> str:
        return str(self.chance.randint(1, 10 ** self.chance.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return ("" if self.close else " ").join(self.word() for _ in range(self.chance.randint(low, high)))

    def title(self) -> str:
        return self.words(1, 5).capitalize()

    def join(self, *parts: str) -> str:
        return ("" if self.close and self.chance.random() < 0.8 else " ").join(x for x in parts if x)

    def sentence(self, inner: str = "") -> str:
        pick = self.chance.random()
        text = self.join(self.words(2, 8).capitalize(), inner, self.words(0, 6) if self.chance.random() < 0.85 else "")
        if self.close:
            return f"「{text}。」" if pick < 0.2 else text + self.chance.choice("。。！？")
        end = self.chance.choice([".", ".", ".", "!", "?", "…"])
        return f"“{text},” {self.words(2, 3)}{end}" if pick < 0.2 else f"‘{text}{end}’" if pick < 0.25 else text + end

    def sign(self) -> str:
        """Signs that stand for themselves: one, or some with words between them."""
        made = self._sign()
        while self.chance.random() < 0.35:
            made = f"{made}{self.chance.choice([' ', ' ', ', ', '; ', ' & '])}{self.words(1, 2) + ' ' if self.chance.random() < 0.6 else ''}{self._sign()}"
        return made

    def _sign(self) -> str:
        c, n, w, a = self.chance, self.number, self.word, self.ascii
        money, letter, capital = c.choice("$€£$"), a()[0], a()[0].upper()
        host, path = f"{a()}.{c.choice(['org', 'net', 'example', 'com'])}", lambda mark, k: mark.join(a() for _ in range(k))
        return c.choice(
            [
                lambda: f"{money}{n()}", lambda: f"{n()} {money}", lambda: f"{money}{n()},{c.randint(100, 999)}", lambda: f"{money}{n()} – {w()} {money}{n()}", lambda: f"{n()} %", lambda: f"{w().capitalize()} & {w().capitalize()}", lambda: f"{w().capitalize()} & {w(3).capitalize()}.",
                lambda: f"{capital}&{a()[0].upper()}", lambda: f"{a()[:2].upper()}&{capital}-{w()}", lambda: f"{w()} & {w()}", lambda: f"#{n()}", lambda: f"{capital}#", lambda: f"{n()} * {n()}", lambda: f"{letter}*{a()[0]}", lambda: f"{n()}*{letter}*{a()[0]}",
                lambda: f"{letter}^{c.randint(2, 9)}", lambda: f"{n()} = {n()}", lambda: f"{n()} < {n()}", lambda: f"{n()} > {n()}", lambda: f"{letter} < {a()[0]}", lambda: f"{letter} > {a()[0]}", lambda: f"{n()} ~ {n()}", lambda: f"~{n()}", lambda: path("_", 2), lambda: path("_", 3), lambda: f"{a()}_{n()}",
                lambda: "".join(c.choice([letter, n(), c.choice("*_#-+")]) for _ in range(c.randint(3, 7))).strip("*_#-+") or letter, lambda: f"{capital}:\\{path(chr(92), c.randint(2, 4))}", lambda: f"/{path('/', 3)}", lambda: f"https://{host}/{path('/', c.randint(1, 2))}", lambda: f"https://{host}/{a()}.{n()}", lambda: f"http://www.{host}",
                lambda: f"{a()}@{host}", lambda: f"<{w()}>", lambda: f"<{c.choice(['laughs', 'noise', 'empty', 'unknown', 'coughs'])}>", lambda: f"[{w()}]", lambda: f"[{n()}]", lambda: f"{{{w()}}}", lambda: f"*{w()}", lambda: f"_{w()}", lambda: f"{w()}*", lambda: f"~ {w()} {w()} ~", lambda: f"{w()} | {w()}", lambda: f"{n()} | {w()}",
                lambda: "".join(c.choice(";:8=") + c.choice(["", "-", "^"]) + c.choice(")(*|P")), lambda: "<3",
            ]
        )()

    #: Inline constructs by notation; each takes the writer and gives one with random content.
    INLINE = {
        "html": {
            "pair": lambda w: (lambda t: f"<{t}>{w.words(1, 4)}</{t}>")(w.chance.choice("b i em strong small u s sub sup tt cite kbd mark q big del ins code".split())),
            "span": lambda w: f'<{(t := w.chance.choice(["span", "font", "abbr"]))} {w.ascii()}="{w.ascii()}{w.number()}">{w.words(1, 6)}</{t}>',
            "anchor": lambda w: f'<a href="{w.ascii()}.{w.chance.choice(["html", "xhtml"])}#{w.ascii()}">{w.words(1, 3)}</a>', "note": lambda w: f'<sup><a href="#{w.ascii()}">{w.number()}</a></sup>', "break": lambda w: f"{w.word()}<br{w.chance.choice(['', '/', ' /'])}>{w.word()}",
            "entity": lambda w: f"{w.word()}&{w.chance.choice(['nbsp', 'amp', 'mdash', 'ndash', 'hellip', 'ldquo', 'rdquo', 'rsquo', 'lsquo', 'eacute', 'uuml', 'lt', 'gt', 'quot', 'copy', 'shy', '#8212', '#160', '#x2014', '#xE9'])};{w.word()}", "escaped": lambda w: f"&lt;{(t := w.chance.choice(['b', 'i', 'em', 'p']))}&gt;{w.words(1, 3)}&lt;/{t}&gt;",
            "comment": lambda w: f"<!-- {w.words(1, 4)} -->", "open_tag": lambda w: f"<{w.chance.choice(['small', 'i', 'b', 'span', 'em'])}>{w.words(1, 4)}", "ruby": lambda w: f"<ruby>{w.word()}<rt>{w.word()}</rt></ruby>", "image": lambda w: f'<img src="{w.ascii()}.jpg" alt="{w.words(1, 2)}"/>',
        },
        "markdown": {
            "strong": lambda w: f"**{w.words(1, 5)}**", "under_strong": lambda w: f"__{w.words(1, 4)}__", "star": lambda w: f"*{w.words(1, 5)}*", "under": lambda w: f"_{w.words(1, 5)}_", "both": lambda w: f"***{w.words(1, 3)}***", "code": lambda w: f"`{w.words(1, 3)}`", "strike": lambda w: f"~~{w.words(1, 3)}~~",
            "link": lambda w: f"[{w.words(1, 3)}]({w.ascii()}.{w.chance.choice(['md', 'html'])}{w.chance.choice(['', '#' + w.ascii()])})", "web_link": lambda w: f"[{w.words(1, 3)}](https://{w.ascii()}.org/{w.ascii()})", "reference": lambda w: f"[{w.words(1, 3)}][{w.ascii()}{w.number()}]", "picture": lambda w: f"![{w.words(1, 2)}]({w.ascii()}/{w.ascii()}.png)",
            "footnote": lambda w: f"{w.word()}[^{w.number()}]", "escape": lambda w: f"\\{w.chance.choice('*_#[')}{w.word()}", "long_strong": lambda w: f"**{w.sentence()}**", "long_star": lambda w: f"*{w.sentence()}*", "autolink": lambda w: f"<https://{w.ascii()}.org/{w.ascii()}>",
        },
        "wiki": {
            "link": lambda w: f"[[{w.words(1, 3)}]]", "named": lambda w: f"[[{w.words(1, 3)}|{w.words(1, 3)}]]", "bold": lambda w: f"'''{w.words(1, 4)}'''", "italic": lambda w: f"''{w.words(1, 4)}''", "both": lambda w: f"'''''{w.words(1, 3)}'''''", "lang": lambda w: f"{{{{{w.ascii()}|{w.ascii()[:2]}|{w.word()}}}}}", "template": lambda w: f"{w.word()}{{{{{w.ascii()} {w.ascii()}}}}}", "external": lambda w: f"[https://{w.ascii()}.org/{w.ascii()}{w.number()} {w.words(1, 3)}]",
            "bare_external": lambda w: f"[https://{w.ascii()}.org/{w.ascii()}{w.number()}]", "nowiki": lambda w: f"<nowiki>{w.words(1, 3)}</nowiki>", "ref": lambda w: f"{w.word()}<ref>{w.words(1, 4)}, {w.number()}</ref>", "named_ref": lambda w: f'{w.word()}<ref name="{w.ascii()}"/>', "long_italic": lambda w: f"''{w.sentence()}''",
        },
        "latex": {
            "command": lambda w: f"\\{w.chance.choice(['textbf', 'emph', 'textit', 'texttt', 'underline', 'textsc', 'mbox'])}{{{w.words(1, 4)}}}", "switch": lambda w: f"{{\\{w.chance.choice(['it', 'bf', 'em', 'small', 'itshape', 'sc'])} {w.words(1, 5)}}}", "footnote": lambda w: f"{w.word()}\\footnote{{{w.words(1, 5)}}}", "cite": lambda w: f"{w.word()}~\\{w.chance.choice(['cite', 'ref', 'citep'])}{{{w.ascii()}{w.number()}}}",
            "dots": lambda w: f"{w.word()}\\{w.chance.choice(['ldots', 'dots'])}{{}} {w.word()}", "math": lambda w: f"${w.ascii()[0]}_{{{w.number()}}} \\{w.chance.choice(['le', 'ge', 'in', 'approx'])} {w.ascii()[0]}^{w.chance.randint(2, 9)}$", "round_math": lambda w: f"\\({w.ascii()[0]}+{w.number()}={w.ascii()[0]}\\)", "letter": lambda w: f"${w.ascii()[0]}$", "quotes": lambda w: f"``{w.words(1, 5)}''", "quotes_comma": lambda w: f"``{w.words(1, 4)},''\\, {w.words(1, 2)}",
            "percent": lambda w: f"{w.number()}\\% {w.word()}", "ampersand": lambda w: f"{w.word()} \\& {w.word()}", "line": lambda w: f"{w.word()} \\\\ {w.word()}", "open": lambda w: f"\\noindent {w.words(1, 3)}", "long": lambda w: f"\\{w.chance.choice(['textit', 'emph', 'textbf'])}{{{w.sentence()}}}", "long_switch": lambda w: f"{{\\{w.chance.choice(['it', 'bf', 'em'])} {w.sentence()}}}",
        },
    }

    def inline(self, notation: str) -> str:
        known = [x for x in self.INLINE[notation] if f"{notation}:{x}" not in self.without]
        return self.INLINE[notation][self.chance.choice(known)](self)

    def prose(self, low: int = 1, high: int = 4, signs: float = 0.3) -> str:
        made = [self.sentence(self.sign() if self.chance.random() < signs else "") for _ in range(self.chance.randint(low, high))]
        return self.wrapped(("" if self.close else " ").join(made))

    def wrapped(self, text: str) -> str:
        """Now and then with lines broken at blanks."""
        if self.chance.random() < 0.75:
            return text
        return "".join("\n" if c == " " and self.chance.random() < 0.1 else c for c in text)

    def marked(self, notation: str) -> str:
        """Prose some sentences of which hold inline markup."""
        made = [self.sentence(self.sign() if self.chance.random() < 0.2 else "") for _ in range(self.chance.choice([0, 0, 1, 2, 3]))]
        for _ in range(self.chance.choice([1, 1, 1, 2])):
            own = self.inline(notation)
            made.insert(self.chance.randint(0, len(made)), own if self.chance.random() < 0.15 else self.sentence(own))
        return self.wrapped(("" if self.close else " ").join(made))


Block = list[tuple[str, str]]


def _block(w: Writer, notation: str, kind: str) -> Block:
    """(text, label) of the lines of a block of one kind; a null label goes with its neighbour."""
    c, n = w.chance, w.number
    text = lambda low=1, high=4: w.words(low, high).capitalize()
    some = lambda low, high, one: [one(k) for k in range(1, c.randint(low, high) + 1)]
    code = lambda: c.choice([f"{w.ascii()}({w.ascii()}, {n()})", f"{w.ascii()} = {n()}", f"{w.ascii()}({n()});", f"if {w.ascii()} > {n()}:", w.words(1, 4), f"{w.ascii()}[{n()}] * {w.ascii()}"])
    formula = lambda: c.choice([f"{w.ascii()[0]}^2 + {w.ascii()[0]}_{{{n()}}} = {n()}", f"\\frac{{{w.ascii()[0]}}}{{{n()}}}", f"\\sum_{{{w.ascii()[0]}=1}}^{{{n()}}} {w.ascii()[0]}", f"{w.ascii()[0]} = {n()} {w.ascii()[0]}"])
    lines = lambda xs, label: [(x, label) for x in xs]
    attributes = lambda: c.choice(["", "", f' class="{w.ascii()}"', f' id="{w.ascii()}{n()}"', f' {w.ascii()}="{w.ascii()}"'])
    inner = lambda: w.inline(notation) if c.random() < 0.25 else text(1, 4)
    if kind == "quote" and notation in ("html", "markdown"):
        body = w.prose(1, 3, 0.1)
        return lines([f"> {x}" for x in body.split("\n")], "inline") if notation == "markdown" else [(f"<blockquote{attributes()}>{body}</blockquote>", "inline")]
    if notation == "html":
        return {
            "paragraph": lambda: [(w.marked(notation) if c.random() < 0.5 else c.choice([f"<p{attributes()}>{w.prose()}</p>", f"<div{attributes()}>{w.prose()}</div>", f"<p>{w.marked(notation)}</p>", f"<p{attributes()}>{w.prose(1, 2)}", f"{w.prose(1, 2)}</p>", f"<center>{text()}</center>", f"<poem>\n{w.prose(1, 2)}\n</poem>", f"<section><p>{w.prose()}</p></section>", f"<{(k := c.choice(['header', 'footer', 'aside', 'article', 'figcaption', 'td']))}>{w.prose(1, 2)}</{k}>"]), "inline")],
            "heading": lambda: [(f"<h{(k := c.randint(1, 6))}{attributes()}>{inner()}</h{k}>", "heading")],
            "list": lambda: c.choice([
                lambda: [(f"<{(k := c.choice(['ul', 'ol']))}>", None), *lines(some(1, 4, lambda k: f"<li{attributes()}>{inner()}</li>"), "list"), (f"</{k}>", None)], lambda: [(f"<{(k := c.choice(['ul', 'ol', 'menu']))}>" + "".join(some(1, 4, lambda k: f"<li>{inner()}</li>")) + f"</{k}>", "list")],
                lambda: [("<dl>" + "".join(some(1, 3, lambda k: f"<dt>{text(1, 2)}</dt><dd>{text()}</dd>")) + "</dl>", "list")],
            ])(),
            "code": lambda: [(c.choice([f"<pre>{code()}</pre>", "<pre><code>" + "\n".join(some(1, 3, lambda k: code())) + "</code></pre>", f'<syntaxhighlight lang="{w.ascii()}">{code()}</syntaxhighlight>', f"<code>{code()}</code>"]), "code")],
            "formula": lambda: [(c.choice([f"<math>{w.ascii()[0]} = {n()}</math>", f"<math><mi>{w.ascii()[0]}</mi><mo>=</mo><mn>{n()}</mn></math>", f"<math><mrow><mi>{w.word()}</mi></mrow><mn>{n()}</mn></math>"]), "formula")],
            "table": lambda: c.choice([
                lambda: [(f"<table{attributes()}>", None), *lines(some(1, 3, lambda k: f"<tr><{(d := c.choice(['td', 'th']))}>{inner()}</{d}><td>{n()}</td></tr>"), "table"), ("</table>", None)], lambda: [("<table>" + "".join(some(1, 3, lambda k: f"<tr><td>{inner()}</td><td>{n()}</td></tr>")) + "</table>", "table")],
            ])(),
            "furniture": lambda: [(c.choice([f"<style>.{w.ascii()} {{ {w.ascii()}: {n()} }}</style>", f"<script>{w.ascii()}({n()});</script>", f"<!-- {text()} -->", f'<img src="{w.ascii()}.jpg" alt="{text()}"/>', f"<hr{c.choice(['', '/', ' /'])}>", f"<div{attributes()}>", "</div>", f'<a id="{w.ascii()}"/>', f"<{c.choice(['ul', 'table', 'section'])}>", f"</{c.choice(['ul', 'table', 'section', 'p'])}>", f'<meta name="{w.ascii()}" content="{w.ascii()}"/>']), "furniture")],
        }[kind]()
    if notation == "markdown":
        mark = c.choice("-*+")
        return {
            "paragraph": lambda: [(w.marked(notation), "inline")],
            "heading": lambda: c.choice([lambda: [(f"{'#' * c.randint(1, 6)} {inner()}{c.choice(['', '', ' #', ' ##'])}", "heading")], lambda: [(text(), "heading"), (c.choice("=-") * c.randint(3, 14), "heading")]])(),
            "list": lambda: c.choice([
                lambda: lines(some(2, 5, lambda k: f"{c.choice(['', '', '  '])}{mark} {c.choice([text(), text(), w.prose(1, 1, 0.1), inner()])}"), "list"), lambda: lines(some(2, 5, lambda k: f"{k}{c.choice('..)')} {text()}"), "list"), lambda: lines(some(2, 4, lambda k: f"- [{c.choice(' x')}] {text()}"), "list"), lambda: lines(some(1, 1, lambda k: f"{mark} {inner()}"), "list"),
            ])(),
            "code": lambda: [(f"{(f := c.choice(['```', '~~~']))}{c.choice(['', '', w.ascii()])}", None), *lines(some(1, 4, lambda k: code()), "code"), (f, None)],
            "formula": lambda: c.choice([lambda: [(f"$${formula()}$$", "formula")], lambda: [("$$", None), (formula(), "formula"), ("$$", None)]])(),
            "table": lambda: lines([f"| {text()} | {text()} |", c.choice(["| --- | --- |", "|----|:----:|", "|:--|--:|"]), *some(1, 3, lambda k: f"| {n()} | {inner()} |")], "table"),
            "furniture": lambda: [(c.choice(["---", "- - -", "-----", f"[{w.ascii()}{n()}]: https://{w.ascii()}.org/{w.ascii()}", f"![{text()}]({w.ascii()}/{w.ascii()}.png)", f"[^{n()}]: {text()}"]), "furniture")],
        }[kind]()
    if notation == "wiki":
        return {
            "paragraph": lambda: [(w.marked(notation), "inline")],
            "heading": lambda: [(f"{(k := '=' * c.randint(1, 5))} {inner()} {k}", "heading")],
            "list": lambda: c.choice([lambda: lines(some(1, 4, lambda k: f"{c.choice(['*', '**', '##'])} {inner()}"), "list"), lambda: lines(some(2, 4, lambda k: f"# {inner()}") + [f"# {inner()}"], "list"), lambda: lines(some(1, 4, lambda k: f"{c.choice('*#')}{inner()}"), "list"), lambda: [(f";{inner()}", "list"), (f":{c.choice([inner(), w.prose(1, 1, 0.1)])}", "list")], lambda: [(f":{c.choice(['', ' '])}{w.prose(1, 1, 0.1)}", "list")]])(),
            "code": lambda: [(c.choice([f"<syntaxhighlight>{code()}</syntaxhighlight>", f"<pre>{code()}</pre>"]), "code")],
            "formula": lambda: [(f"<math>{formula()}</math>", "formula")],
            "table": lambda: [(f'{{| class="{w.ascii()}"', None), *[x for _ in range(c.randint(1, 3)) for x in (("|-", "table"), (f"{c.choice('!|')} {inner()}", "table"), (f"| {n()}", "table"))], ("|}", None)],
            "furniture": lambda: c.choice([lambda: [(f"[[{c.choice(['Category', 'File', 'Image'])}:{text()}]]", "furniture")], lambda: [(f"[[File:{w.ascii()} {n()}.jpg|thumb|{text()}]]", "furniture")], lambda: [(f"{{{{{w.ascii()}|{text()}}}}}", "furniture")], lambda: [(f"{{{{{w.ascii()} {w.ascii()}", "furniture"), *lines(some(1, 3, lambda k: f"| {w.ascii()} = {text()}"), "furniture"), ("}}", "furniture")], lambda: [(f"__{c.choice(['TOC', 'NOTOC', 'FORCETOC'])}__", "furniture")], lambda: [("----", "furniture")]])(),
        }[kind]()
    return {
        "paragraph": lambda: [(w.marked(notation), "inline")],
        "heading": lambda: [(f"\\{c.choice(['section', 'subsection', 'chapter', 'part', 'paragraph'])}{c.choice(['', '*'])}{{{inner()}}}", "heading")],
        "list": lambda: [(f"\\begin{{{(k := c.choice(['itemize', 'enumerate', 'description']))}}}", None), *lines(some(1, 4, lambda k: f"\\item {c.choice([text(), inner(), w.prose(1, 1, 0.1)])}"), "list"), (f"\\end{{{k}}}", None)],
        "code": lambda: [(f"\\begin{{{(k := c.choice(['verbatim', 'lstlisting']))}}}", None), *lines(some(1, 3, lambda k: code()), "code"), (f"\\end{{{k}}}", None)],
        "formula": lambda: c.choice([lambda: [(f"\\[ {formula()} \\]", "formula")], lambda: [(f"$${formula()}$$", "formula")], lambda: [(f"\\begin{{{(k := c.choice(['equation', 'align', 'gather', 'equation*']))}}}", None), (formula(), "formula"), (f"\\end{{{k}}}", None)]])(),
        "table": lambda: [(f"\\begin{{tabular}}{{{c.choice(['ll', 'lr', 'l|r'])}}}", None), *lines(some(1, 3, lambda k: f"{inner()} & {n()} \\\\"), "table"), ("\\end{tabular}", None)],
        "furniture": lambda: [(c.choice([f"\\label{{{w.ascii()}:{n()}}}", f"\\includegraphics{c.choice(['', f'[{w.ascii()}={n()}cm]'])}{{{w.ascii()}}}", "\\newpage", "\\bigskip", "\\tableofcontents", f"\\usepackage{{{w.ascii()}}}", f"\\vspace{{{n()}pt}}", f"% {text()}"]), "furniture")],
    }[kind]()


KINDS = ["paragraph"] * 6 + ["heading", "heading", "list", "list", "code", "formula", "table", "furniture", "furniture", "quote"]


def labelled_pages(number: int = 1500, seed: int = 11, without: frozenset[str] = frozenset(), alone: frozenset[str] = frozenset()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, its labelled spans) of random pages. ``without`` leaves inline constructs out, ``alone`` uses no others."""
    chance, pages = random.Random(seed), []
    left = without | (frozenset(f"{x}:{y}" for x, ys in Writer.INLINE.items() for y in ys) - alone if alone else frozenset())
    while len(pages) < number:
        w = Writer(chance, left)
        notation = chance.choice(["html", "markdown", "wiki", "latex"])
        if all(f"{notation}:{x}" in left for x in w.INLINE[notation]):
            continue
        share, rows = chance.choice([0.0, 0.0, 0.15, 0.15, 0.4, 0.6, 0.8]), []
        for _ in range(chance.randint(1, 12)):
            if chance.random() < share:
                kind = chance.choice(["paragraph"] if alone else KINDS)
                if alone and notation == "html":
                    rows += [(w.marked(notation), "inline")]
                else:
                    rows += _block(w, notation, kind if kind != "quote" or notation in ("html", "markdown") else "paragraph")
            else:
                rows += [(chance.choice(["***", "* * *", "~", "⁂", "* * * * *"]) if chance.random() < 0.06 else w.title() if chance.random() < 0.15 else w.prose(), "prose")]
            rows.append(("", None) if chance.random() < 0.8 else ("", "") if chance.random() < 0.5 else ("\r", "\r"))
        text, spans = "", []
        for x, label in rows:
            if x == "\r":
                continue
            spans.append((len(text), len(text) + len(x), label or ""))
            text += x + "\n"
        if chance.random() < 0.3 and len(text) > 40:  # as a chunk that begins or ends within a page
            breaks = [m.end() for m in re.finditer(r"\s", text)]
            a, b = sorted(chance.sample(breaks, 2)) if len(breaks) > 2 else (0, len(text))
            if chance.random() < 0.5:
                a = 0
            text, spans = text[a:b], [(max(0, x - a), min(b, y) - a, label) for x, y, label in spans if y > a and x < b]
        if any(label for *_, label in spans):
            pages.append((text.strip("\n"), [(x, y, label) for x, y, label in spans if label]) if not text.startswith("\n") else (text, [(x, y, label) for x, y, label in spans if label]))
    return pages


def labels_of(blocks: list[Leaf], spans: list[tuple[int, int, str]]) -> list[int]:
    """The label of each leaf block: that of the spans which hold most of it, furniture where none does."""
    out = []
    for block in blocks:
        weight: dict[str, int] = {}
        for a, b, label in spans:
            if (both := min(b, block.end) - max(a, block.start)) > 0:
                weight[label] = weight.get(label, 0) + (both if label != "prose" else both / 1e6)  # prose beside markup isn't bare
        out.append(AT[max(weight, key=weight.get) if weight else "furniture"])
    return out


def lessons(pages: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """(features, labels) of pages that have leaf blocks."""
    made = ((leaves(text), spans) for text, spans in pages)
    return [(features, labels_of(blocks, spans)) for (blocks, features), spans in made if blocks]


@lru_cache(maxsize=4)
def trained(number: int = 1500, without: frozenset[str] = frozenset()) -> Field:
    """The field, trained on the labelled pages; some seconds on the driver."""
    field = Field()
    field.learn(lessons(labelled_pages(number, without=without)))
    return field


def label(text: str, field: Field) -> tuple[list[Leaf], list[int]]:
    """Leaf blocks of a text whose line ends are line feeds, and their labels."""
    blocks, features = leaves(text)
    return blocks, field.decode(features) if blocks else []


def unified(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def holds_markup(text: str | None, field: Field) -> bool:
    if not text or not _may.search(text):
        return False
    _, labels = label(unified(text), field)
    return any(x != AT["prose"] for x in labels)


# ---- clean text
HEADING, BULLET, FORMULA = "§ ", "• ", "⟨{}⟩"
_number_mark = re.compile(r"\s*(\d{1,3}[.)])[ \t]+")
_spaces = re.compile(r"[ \t]{2,}")
_within = re.compile(r"<(?:br|hr)\b[^<>]*>", re.I)


def plain(piece: str, cells: bool = False) -> str:
    """A leaf without its constructs; inline formulas in angle brackets, inline code as it is."""
    stored: list[str] = []

    def store(value: str) -> str:
        stored.append(value)
        return f"\ue000{len(stored) - 1}\ue001"

    for name, needed, rule, keep in CONSTRUCTS:
        if keep is None or not any(n in piece for n in needed):
            continue
        if name in ("math", "display_math"):
            piece = rule.sub(lambda m: store(FORMULA.format(next(g for g in m.groups() if g).strip())), piece)
        elif name == "code_span":
            piece = rule.sub(lambda m: store(m[2]), piece)
        elif name == "bullet" or name == "wiki_item" or name == "item":
            piece = rule.sub("", piece)
        else:
            piece = rule.sub(keep, piece)
            if name in ("strong", "tag", "command"):
                piece = rule.sub(keep, piece)
    piece = re.sub(r"\{\{[^{}]*\}\}", "", piece)
    if cells:
        piece = re.sub(r"[ \t]*(?<!\\)(?:&|\|\|)[ \t]*", "\t", piece)
    for _ in range(3):
        piece = re.sub("\ue000(\\d+)\ue001", lambda m: stored[int(m[1])], piece)
    return "\n".join(_spaces.sub(" ", x).strip(" ") for x in piece.split("\n")).strip()


def block_text(piece: str, kind: str, path: tuple[str, ...]) -> str:
    """What stays of a leaf block: headings begin with a section sign, list items with a bullet or their number, code is set
    in by four blanks, formulas stand in angle brackets, the cells of a row are parted by tabs."""
    if kind == "code":
        bare = html.unescape(re.sub(_tag, "", piece, flags=re.I)) if "<" in piece or "&" in piece else piece
        return "\n".join("    " + x for x in bare.strip("\n").split("\n"))
    if kind == "formula":
        bare = re.sub(_tag, " ", piece, flags=re.I)
        bare = re.sub(r"^\s*(?:\$\$|\\\[|\\\()|(?:\$\$|\\\]|\\\))\s*$", "", html.unescape(bare))
        return FORMULA.format(" ".join(bare.split()))
    if kind == "heading":
        rule = re.sub(r"\n[ \t]*[=-]+[ \t]*$", "", piece)
        kept = " ".join(plain(rule).split())
        return HEADING + kept if kept else ""
    if kind == "list":
        number = _number_mark.match(piece)
        kept = plain(piece[number.end() :] if number else piece)
        return (number[1] + " " if number else BULLET) + kept if kept else ""
    if kind == "table":
        return plain(piece, cells=True)
    return plain(piece)


def clean(text: str | None, field: Field) -> tuple[str | None, list[tuple[str, str]]]:
    """(clean text, its blocks as (kind, text)). Blocks never run into each other: cells of a row are parted by tabs, rows
    and items of a list by line ends, all others by blank lines; prose beside prose keeps what stood between. A line
    break element is a line end."""
    if not text:
        return text, []
    text = unified(text)
    if not _may.search(text):
        return text, [("prose", p.strip()) for p in re.split(r"\n\s*\n", text) if p.strip()]
    leaves_, labels = label(text, field)
    if all(x == AT["prose"] for x in labels):
        return text, [("prose", text[x.start : x.end]) for x in leaves_]
    parts: list[str] = []
    blocks: list[tuple[str, str]] = []
    last: tuple[Leaf, str] | None = None
    for block, x in zip(leaves_, labels):
        kind = {"inline": "prose", "furniture": ""}.get(LABELS[x], LABELS[x])
        piece = text[block.start : block.end]
        made = piece if x == AT["prose"] else block_text(piece, kind, block.path) if kind else ""
        if not made.strip():
            continue
        if last:
            before, kind_before = last
            gap = text[before.end : block.start]
            if kind == kind_before == "table" and block.row == before.row and block.row >= 0:
                parts.append("\t")
            elif kind == kind_before and kind in ("list", "table"):
                parts.append("\n")
            elif kind == kind_before == "code" and not _blank.search(gap) and block.path == before.path:
                parts.append("\n")
            elif not gap.strip() and gap and kind == kind_before == "prose":
                parts.append(gap)
            else:
                parts.append("\n\n")
        parts.append(made)
        blocks.append((kind, made.strip("\n") if kind == "code" else made))
        last = (block, kind)
    return "".join(parts), blocks


def find(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys) of the rows whose text holds markup."""
    field, kinds, width = trained(), dict(df.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([holds_markup(t, field) for t in batch.column(width).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in range(width)], keys)

    return spread(df.select(*keys, text), *keys).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys))


def convert(df: DataFrame, keys: list[str], text: str, unique: bool = False) -> DataFrame:
    """(*keys, clean string, blocks array<struct<kind, text>>) for every row, or with ``unique`` for one row of each key."""
    field, kinds, width = trained(), dict(df.dtypes), len(keys)
    block = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [clean(t, field) for t in batch.column(width).to_pylist()]
            blocks = pa.array([[{"kind": k, "text": t} for k, t in b] for _, b in out], block)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(width)), pa.array([c for c, _ in out], pa.string()), blocks], [*keys, "clean", "blocks"])

    return spread(df.select(*keys, text), *keys, unique=unique).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", clean string, blocks array<struct<kind: string, text: string>>")
