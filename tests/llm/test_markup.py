import itertools

import pytest

from recitant.llm import markup as M

MARKED = [
    "Zor <b>tamel</b> rin.", "Pelu vost&eacute; mar.", "Dorin <!-- later --> vasel.", "Tal **menu** ro.", "Mar *vesto* lin.", "Sol _kemi_ dran.", "### Vel moru", "- kel\n- dom\n- rin", "Vom [tel](mar.html#s2) dor.", "Nel[^7] vor.",
    "```\nz = f(2)\n```", "| k | m |\n| --- | --- |\n| 3 | 4 |", "Dra [[vel|mor]] kin.", "Vor '''mel''' tor.", "{{note|Vel dor}}", "=== Kel mor ===", r"Mel \emph{tor} rin.", r"Vel $y_{3} \ge z^4$ mor.", r"\subsection{Vel mor}", "\\begin{enumerate}\n\\item kel\n\\end{enumerate}",
    r"Mor {\bf kelta} rin.", "``Vel mor'' kin.", "~~dor~~ kel", "[https://kel.org/m4 dor] vel",
]
PLAIN = [
    "Kel paid $7 for mor and $19 for vel.", "Dor #8 and vel_04_last_kel went.", "Vel fell from €2,400 to €1,100 – a drop.", "If m < n and n > k, dor.", "Mor said <coughs>, and kel.", "Vel wrote [mor] near K&M, dor.", r"Mor lay at D:\kel\mor\vel, dor.",
    "k^3 = 27, so k is 3.", "Vel is *mor, kel is _dor.", "Mor F# vel 7 * 2 kel.", "At door 6 | row K, vel.", "For Kel & Mor they sang.", "See https://kel.net/vel or write to mor@kel.org.", "At 11 ~ 14 degrees {vel} mor.", "Row [9] of <3 kel ;-)", "Vel mor kin.",
]


@pytest.fixture(scope="module")
def field():
    return M.trained()


def accuracy(field, pages):
    pairs = [(g, y) for features, labels in M.lessons(pages) for g, y in zip(field.decode(features), labels)]
    return sum(g == y for g, y in pairs) / len(pairs), pairs


def test_held_out_pages(field):
    assert accuracy(field, M.labelled_pages(200, seed=99))[0] >= 0.95


def test_held_out_constructs():
    """Constructs that no training page holds are still told from prose."""
    out = frozenset(["html:entity", "html:anchor", "markdown:strike", "markdown:link", "wiki:italic", "wiki:ref", "latex:quotes", "latex:switch", "latex:cite"])
    field = M.trained(600, out)
    _, pairs = accuracy(field, M.labelled_pages(150, seed=5, alone=out))
    marked = [g != M.AT["prose"] for g, y in pairs if y != M.AT["prose"]]
    bare = [g == M.AT["prose"] for g, y in pairs if y == M.AT["prose"]]
    assert sum(marked) >= 0.8 * len(marked) and sum(bare) >= 0.9 * len(bare)


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(field, text):
    assert M.holds_markup(text, field)
    assert M.holds_markup(f"Kel mor vel, dor.\n\n{text}\n\nVel mor $4 kin.", field)


@pytest.mark.parametrize("text", PLAIN)
def test_signs_stand_for_themselves(field, text):
    assert not M.holds_markup(text, field)
    assert M.clean(text, field)[0] == text


def test_leaf_blocks_and_their_paths():
    text = '<div><ul>\n<li>a <b>x</b></li>\n<li>b</li>\n</ul><p>c</p></div>\n\nd e\nf\n\n# g\n- h\n  i\n\n```\nj\n\nk\n```\n<hr/>'
    got = [(text[x.start : x.end], x.path) for x in M.tree(text)]
    assert got == [
        ("a <b>x</b>", ("div", "ul", "li")), ("b", ("div", "ul", "li")), ("c", ("div", "p")), ("d e\nf", ()), ("# g", ("heading:atx",)), ("- h\n  i", ("item:bullet",)), ("j\n\nk", ("fence",)), ("<hr/>", ("hr",)),
    ]
    for text in ("", "</p>", "<ul>", "<table><tr><td>", "\\begin{x}", "```", "a\n---\nb", "{{a\n|b", "$$", "| a |\n|", "<p><p><p>x</div></p>", "=\n=\n="):
        spans = [(x.start, x.end) for x in M.tree(text)]
        assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:])) and all(a < b for a, b in spans)


def test_decoding_is_the_best_path(field):
    features = M.leaves("# Kel\nVel <b>mor</b> dor.\n- kin")[1]
    scores = field.scores(features)
    best = max(itertools.product(range(len(M.LABELS)), repeat=3), key=lambda p: field.moves[-1, p[0]] + sum(scores[k, x] for k, x in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])))
    assert field.decode(features) == list(best)


ROUND_TRIPS = {
    "<h1>Kel</h1><p>Vel mor.</p><ul><li>a</li><li>b</li></ul>": "§ Kel\n\nVel mor.\n\n• a\n• b",
    "<p>Vel.</p><p>Mor.</p>": "Vel.\n\nMor.",
    "<table><tr><td>A</td><td>B</td></tr><tr><td>C</td><td>D</td></tr></table>": "A\tB\nC\tD",
    r"5\% of kel; then vel; a \& b": "5% of kel; then vel; a & b",
    "<p>Vel<br/>mor.</p>": "Vel\nmor.",
    "| k | m |\n| --- | --- |\n| 3 | 4 |": "k\tm\n3\t4",
    "1. kel\n2. mor\n3. dor": "1. kel\n2. mor\n3. dor",
    "<pre>a &lt; b\n  c</pre>": "    a < b\n      c",
    "\\[ a^2 = b \\]": "⟨a^2 = b⟩",
    "Kel mor vel\n===========": "§ Kel mor vel",
    "\\section{Kel mor}\n\nVel \\textbf{dor} rin.": "§ Kel mor\n\nVel dor rin.",
    "\\begin{itemize}\n\\item kel\n\\item mor\n\\end{itemize}": "• kel\n• mor",
    "Vel ``mor'' kin.": "Vel “mor” kin.",
}


@pytest.mark.parametrize("text", ROUND_TRIPS)
def test_conversion(field, text):
    assert M.clean(text, field)[0] == ROUND_TRIPS[text]


def test_conversion_of_a_page(field):
    text = "# Kel dor\n\nVel <b>mor</b> &amp; *kin*, at [dor](x.md)[^1].\n\n- kel\n- vel\n\n```\nx = a_b\n```\n\nMor $x_1 = 2$ vel.\n\n[[Category:Kel]]\n\nKel paid $5 & left."
    clean, blocks = M.clean(text, field)
    assert clean.split("\n\n") == ["§ Kel dor", "Vel mor & kin, at dor.", "• kel\n• vel", "    x = a_b", "Mor ⟨x_1 = 2⟩ vel.", "Kel paid $5 & left."]
    assert [k for k, _ in blocks] == ["heading", "prose", "list", "list", "code", "prose", "prose"]


def test_defined_results(spark, field):
    assert M.clean(None, field) == (None, []) and M.clean("", field) == ("", []) and not M.holds_markup(" \n ", field)
    rows = [(1, "<p>a</p>", "x"), (1, "<p>a</p>", "x"), (2, None, None), (3, "", "x"), (4, "plain", "x"), (5, "word <i>x</i> " * 5000, "x")]
    df = spark.createDataFrame(rows, "k bigint, text string, clean string")
    assert sorted(r.k for r in M.find(df, ["k"], "text").collect()) == [1, 1, 5]
    made = {r.k: r.clean for r in M.convert(df, ["k"], "text").collect()}
    assert made[1] == "a" and made[2] is None and made[3] == "" and made[4] == "plain" and "<" not in made[5]
    assert M.find(df.where("false"), ["k"], "text").count() == 0
