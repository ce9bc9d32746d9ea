"""SQL for those queries that SQL can express."""

BLANK = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SINGLE = r"\x{0e00}-\x{0e7f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"

SQL: dict[str, str] = {
    "p2_found": """
        WITH items AS (
            SELECT 'chapters' AS rec_table, chapter_id AS rec_id, text, limit_id FROM chapters
            UNION ALL SELECT 'chunks', chunk_id, text, limit_id FROM chunks)
        SELECT DISTINCT rec_table, rec_id FROM items JOIN size_limits USING (limit_id) WHERE length(text) > max_chars""",
    "p2_joined": """
        WITH items AS (
            SELECT 'chapters' AS rec_table, chapter_id AS rec_id, text, limit_id FROM chapters
            UNION ALL SELECT 'chunks', chunk_id, text, limit_id FROM chunks)
        SELECT DISTINCT rec_table, rec_id, text, true AS within FROM items JOIN size_limits USING (limit_id) WHERE length(text) > max_chars""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_offsets": "SELECT doc_id, coalesce(length(text), 0) AS chars, true AS gapless FROM documents",
    "p9_stats": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS u FROM documents),
        w AS (
            SELECT doc_id, t,
                list_filter(regexp_extract_all(t, '[{SINGLE}]|[^{BLANK}{SINGLE}]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS words,
                list_filter(list_transform(string_split(u, chr(10)), lambda x: regexp_replace(x, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')), lambda x: x <> '') AS lines,
                list_filter(list_transform(regexp_split_to_array(u, '\n[{BLANK}]*\n'), lambda x: regexp_replace(x, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')), lambda x: x <> '') AS paras
            FROM d),
        c AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words WHERE word <> '')
        SELECT doc_id, len(words)::BIGINT AS word_count,
            CASE WHEN len(words) = 0 THEN 0.0 ELSE round(length(regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')) / len(words), 4) END AS mean_word_length,
            CASE WHEN regexp_replace(t, '[{BLANK}]', '', 'g') = '' THEN 0.0
                ELSE round(length(regexp_replace(t, '[^\p{{S}}#*/\\|@&%_{{}}\[\]]', '', 'g')) / length(regexp_replace(t, '[{BLANK}]', '', 'g')), 4) END AS symbol_ratio,
            CASE WHEN len(lines) = 0 THEN 0.0
                ELSE round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？।॥؟۔\x{{037e}}][”’"''»“«)\]」』]*$'))) / len(lines), 4) END AS punct_line_share,
            CASE WHEN len(words) = 0 THEN 0.0
                ELSE round(len(list_filter(words, lambda x: list_contains(common, lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))))) / len(words), 4) END AS common_word_share,
            CASE WHEN len(lines) = 0 THEN 0.0 ELSE round((len(lines) - len(list_distinct(lines))) / len(lines), 4) END AS dup_line_share,
            CASE WHEN len(paras) = 0 THEN 0.0 ELSE round((len(paras) - len(list_distinct(paras))) / len(paras), 4) END AS dup_paragraph_share
        FROM w, c""",
}
