"""Pieces of SQL from which the oracles are put together. They state the same rules a second time, in another
engine's terms."""

WS = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
J = "(chr(1) || chr(1))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def slug(x: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'document')"


def file_component(x: str) -> str:
    v = f"regexp_replace(replace({collapse(x)}, ':', ' -'), '[<>:\"/\\\\|?*]', '-', 'g')"
    v = f"regexp_replace(regexp_replace({v}, '[{WS}]*-[{WS}]*', ' - ', 'g'), '[{WS}]+', ' ', 'g')"
    return f"coalesce(nullif(regexp_replace({v}, '^[ .-]+|[ .-]+$', '', 'g'), ''), 'Document')"


def sentences(x: str) -> str:
    marked = f"regexp_replace({collapse(x)}, '([.!?]) ([A-Z0-9\"''])', '\\1' || chr(2) || '\\2', 'g')"
    return f"list_filter(string_split({marked}, chr(2)), lambda z: z <> '')"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n[{WS}]*\\n+'), lambda y: {strip('y')}), lambda y: y <> '')"


def append(a: str, x: str, limit: int, joint: str) -> str:
    head = f"{a}[1:len({a}) - 1]"
    return (
        f"CASE WHEN {a}[-1] = '' THEN list_append({head}, {x}) WHEN length({a}[-1]) + length({joint}) + length({x}) > {limit} THEN list_append({a}, {x}) "
        f"ELSE list_append({head}, {a}[-1] || {joint} || {x}) END"
    )


def pack_words(s: str, limit: int) -> str:
    return f"list_reduce(list_transform(string_split({s}, ' '), lambda w: [w]), lambda b, w: {append('b', 'w[1]', limit, chr(39) + ' ' + chr(39))}, [''])"


def pack_sentences(p: str, limit: int) -> str:
    step = f"CASE WHEN a[-1] = '' AND length(s[1]) > {limit} THEN list_concat(list_concat(a[1:len(a) - 1], {pack_words('s[1]', limit)}), ['']) ELSE {append('a', 's[1]', limit, chr(39) + ' ' + chr(39))} END"
    return f"list_filter(list_reduce(list_transform({sentences(p)}, lambda z: [z]), lambda a, s: {step}, ['']), lambda z: z <> '')"


def chunks(t: str, limit: int) -> str:
    step = f"CASE WHEN length(p[1]) > {limit} THEN list_concat(list_concat(list_filter(c, lambda z: z <> ''), {pack_sentences('p[1]', limit)}), ['']) ELSE {append('c', 'p[1]', limit, J)} END"
    folded = f"list_reduce(list_transform({paragraphs(t)}, lambda z: [z]), lambda c, p: {step}, [''])"
    return f"list_transform(list_filter({folded}, lambda z: z <> ''), lambda z: replace(z, {J}, ' '))"


def clean_markdown(x: str) -> str:
    v = f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '(?s)\\A---[{WS}]*\\n.*?\\n---[{WS}]*\\n', '')"
    for rule, put in ((r"(?s)```.*?```", "chr(10)"), (r"(?s)~~~.*?~~~", "chr(10)"), (r"`([^`]+)`", r"'\1'"), (r"!\[[^\]]*\]\([^)]+\)", "' '"), (r"\[([^\]]+)\]\([^)]+\)", r"'\1'"), (r"<[^>]+>", "' '")):
        v = f"regexp_replace({v}, '{rule}', {put}, 'g')"
    y = strip("l")
    for rule in (rf"^#{{1,6}}[{WS}]*", rf"^>[{WS}]*", rf"^[-*+][{WS}]+", rf"^\p{{Nd}}+\.[{WS}]+"):
        y = f"regexp_replace({y}, '{rule}', '')"
    bare = collapse(f"replace(replace(replace({y}, '|', ' '), '_', ' '), '*', '')")
    line = f"CASE WHEN {strip('l')} = '' THEN '' WHEN regexp_full_match({y}, '[-|:{WS}]+') OR {bare} = '' THEN NULL ELSE {bare} END"
    lines = f"list_filter(list_transform(regexp_split_to_array({v}, '{LINE_END}'), lambda l: {line}), lambda l: l IS NOT NULL)"
    joined = f"array_to_string({lines}, chr(10))"
    return strip(f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def short_section(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({strip(x)}), '{w}')" for w in words) + ")"


def stem(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"


def padded(x: str, width: int) -> str:
    return f"lpad(({x})::VARCHAR, greatest({width}, length(({x})::VARCHAR))::INT, '0')"


def parts_by_length(source: str, keys: str, limit: int) -> str:
    """Common table expressions up to ``cut_parts`` (keys, k, part): the texts of ``source`` cut to the limit by recursion."""
    window = f"substr(rest, 1, {limit})"
    end = f"CASE WHEN length(rest) <= {limit} THEN length(rest) ELSE coalesce(nullif(length(regexp_extract({window}, '(?s)^(.+\n\n)', 1)), 0), nullif(length(regexp_extract({window}, '(?s)^(.+ )', 1)), 0), {limit}) END"
    return f"""walk AS (
        SELECT {keys}, text AS rest, 0 AS k, NULL::VARCHAR AS part FROM {source} WHERE length(text) > {limit}
        UNION ALL SELECT {keys}, regexp_replace(substr(rest, {end} + 1), '^[{WS}]+', ''), k + 1, {strip(f"substr(rest, 1, {end})")} FROM walk WHERE rest <> ''),
    cut_parts AS (
        SELECT {keys}, k, part FROM walk WHERE part <> '' UNION ALL SELECT {keys}, 1, text FROM {source} WHERE length(text) <= {limit}
        UNION ALL SELECT {keys}, 1, text FROM {source} WHERE length(text) > {limit} AND {strip('text')} = '')"""


def retry_halves(x: str) -> str:
    """[first, second] halves of a text that failed."""
    def halves(items: str) -> str:
        return f"[array_to_string({items}[1:greatest(1, len({items}) // 2)], ' '), array_to_string({items}[greatest(1, len({items}) // 2) + 1:], ' ')]"

    middle = f"greatest(1, length({x}) // 2)::INT"
    words = f"list_filter(string_split({collapse(x)}, ' '), lambda z: z <> '')"
    return f"CASE WHEN len({sentences(x)}) > 1 THEN {halves(sentences(x))} WHEN len({words}) > 1 THEN {halves(words)} ELSE [{strip(f'substr({x}, 1, {middle})')}, {strip(f'substr({x}, {middle} + 1)')}] END"


def repair_title(x: str, numbered: list[str], front: list[str]) -> str:
    v = f"replace(replace(replace({x}, chr(8217), chr(39)), chr(8220), chr(34)), chr(8221), chr(34))"
    v = f"regexp_replace({v}, '^\\p{{Nd}}+[{WS}]*[-.][{WS}]*', '')"
    word = "[\\p{L}\\p{N}_]+"
    for rule in (f"^({'|'.join(numbered)})[{WS}]+{word}[{WS}]*[-:][{WS}]*", f"^({'|'.join(numbered)})[{WS}]+{word}[{WS}]+", f"^({'|'.join(front)})[{WS}]*[-:][{WS}]*"):
        v = f"regexp_replace({v}, '{rule}', '', 'i')"
    return f"regexp_replace(lower({v}), '[^a-z0-9]+', '', 'g')"
