"""Queries of the engine's own operators over the project's tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import events, jobs, layout, render, repair, resume
from ..operators.ranks import with_rank
from ..sources import epub, markdown
from ..streaming import phases as stream
from ..tables import bounded_broadcast, spread, table
from . import sql as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LIMIT = jobs.effective_chars()
WS = s.WS


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            SQL[function.__name__] = oracle
        return function

    return register


def _texts(spark: SparkSession, sf_dir: str, name: str, key: str, *more: str) -> DataFrame:
    """Texts of a table by key, on all cores even where the table is one small file."""
    return spread(table(spark, sf_dir, name).select(key, "text", *more), key)


# ---- text to chunks
@query(f"""
    SELECT doc_id, len(c)::BIGINT AS chunk_count, coalesce(list_max(list_transform(c, lambda z: length(z))), 0)::BIGINT AS max_chunk_chars,
        len(list_filter(c, lambda z: length(z) > {LIMIT}))::BIGINT AS oversize_chunks, array_to_string(c, chr(10)) AS chunks
    FROM (SELECT doc_id, {s.chunks('text', LIMIT)} AS c FROM documents WHERE text IS NOT NULL)""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    packed = _texts(spark, sf_dir, "documents", "doc_id").where("text IS NOT NULL").select("doc_id", chunking.chunks(F.col("text"), LIMIT).alias("c"))
    return packed.select(
        "doc_id", F.size(c).cast("long").alias("chunk_count"), F.coalesce(F.array_max(F.transform(c, F.length)), F.lit(0)).cast("long").alias("max_chunk_chars"),
        F.size(F.filter(c, lambda x: F.length(x) > LIMIT)).cast("long").alias("oversize_chunks"), F.array_join(c, "\n").alias("chunks"),
    )


@query(f"SELECT chapter_id, unnest(list_transform(range(1, len(c) + 1), lambda k: k::BIGINT)) AS chunk_no, unnest(c) AS chunk FROM (SELECT chapter_id, {s.chunks('text', LIMIT)} AS c FROM chapters WHERE text IS NOT NULL)")
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every chapter, numbered within it."""
    return _texts(spark, sf_dir, "chapters", "chapter_id").select("chapter_id", F.posexplode(chunking.chunks(F.col("text"), LIMIT)).alias("pos", "chunk")).select("chapter_id", (F.col("pos") + 1).cast("long").alias("chunk_no"), "chunk")


@query(f"SELECT doc_id, len(x)::BIGINT AS n_sentences, coalesce(list_max(list_transform(x, lambda z: length(z))), 0)::BIGINT AS longest FROM (SELECT doc_id, {s.sentences('text')} AS x FROM documents WHERE text IS NOT NULL)")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    split = _texts(spark, sf_dir, "documents", "doc_id").where("text IS NOT NULL").select("doc_id", chunking.sentences(F.col("text")).alias("x"))
    return split.select("doc_id", F.size(x).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(x, F.length)), F.lit(0)).cast("long").alias("longest"))


_sections = f"""
    WITH l AS (SELECT chapter_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT chapter_id, regexp_split_to_array(text, '{s.LINE_END}') AS ls FROM chapters WHERE text IS NOT NULL)),
    m AS (SELECT *, length(line) < 120 AND {s.strip('line')} <> '' AND regexp_full_match(line, '[A-Z0-9][A-Za-z0-9 ,:''\"()/-]{{0,118}}') AS heading FROM l),
    g AS (SELECT *, sum(heading::INT) OVER (PARTITION BY chapter_id ORDER BY i) AS g FROM m),
    b AS (SELECT chapter_id, g, max(CASE WHEN heading THEN line END) AS heading,
        {s.strip("regexp_replace(string_agg(CASE WHEN " + s.strip('line') + " = '' THEN '' ELSE line END, chr(10) ORDER BY i) FILTER (WHERE NOT heading), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS body
        FROM g GROUP BY chapter_id, g)"""


@query(f"{_sections} SELECT chapter_id, count(*)::BIGINT AS n_sections, count(heading)::BIGINT AS n_headed, sum(length(body))::BIGINT AS body_chars FROM b WHERE coalesce(body, '') <> '' GROUP BY chapter_id")
def chapter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by headings in running text."""
    made = chunking.with_sections(_texts(spark, sf_dir, "chapters", "chapter_id"), "text", "s").where(F.size("s") > 0)
    return made.select(
        "chapter_id", F.size("s").cast("long").alias("n_sections"), F.size(F.filter("s", lambda x: x["heading"].isNotNull())).cast("long").alias("n_headed"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"])).alias("body_chars"),
    )


@query(f"""{_sections}, c AS (SELECT chapter_id, g, heading, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS k FROM (SELECT chapter_id, g, heading, {s.chunks('body', LIMIT)} AS cs FROM b WHERE coalesce(body, '') <> ''))
    SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY g, k)::INT AS chunk_no, heading, chunk FROM c""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all sections with their heading, numbered over the chapter."""
    made = chunking.with_sections(_texts(spark, sf_dir, "chapters", "chapter_id"), "text", "s").select("chapter_id", F.flatten(F.transform("s", lambda x: F.transform(chunking.chunks(x["body"], LIMIT), lambda c: F.struct(x["heading"].alias("heading"), c.alias("chunk"))))).alias("c"))
    return made.select("chapter_id", F.posexplode("c").alias("pos", "x")).select("chapter_id", (F.col("pos") + 1).alias("chunk_no"), "x.heading", "x.chunk")


@query(f"SELECT chunk_id, h[1] AS first, h[2] AS second FROM (SELECT DISTINCT chunk_id, {s.retry_halves('text')} AS h FROM chunks WHERE text IS NOT NULL)")
def retry_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halves in which each chunk would be spoken after a failure."""
    h = chunking.retry_halves(F.col("text"))
    own = spread(table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", "text"), "chunk_id", unique=True)
    return own.withColumn("h", h).select("chunk_id", F.get("h", F.lit(0)).alias("first"), F.get("h", F.lit(1)).alias("second"))


# ---- Markdown
@query(f"SELECT chapter_id, {s.clean_markdown('text')} AS clean FROM chapters")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "chapters", "chapter_id").select("chapter_id", text.clean_markdown(F.col("text")).alias("clean"))


@query()
def clean_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "chapters", "chapter_id").select("chapter_id", text.clean_plain(F.col("text")).alias("clean"))


_lines = f"regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '{s.LINE_END}')"
_level = "coalesce(" + ", ".join(f"CASE WHEN len(list_filter(ls, lambda l: regexp_matches({s.strip('l')}, '^#{{{k}}}[{WS}]+.'))) > 1 THEN {k} END" for k in range(1, 5)) + ", 4)"


@query(f"SELECT chapter_id, ({_level})::BIGINT AS level FROM (SELECT chapter_id, {_lines} AS ls FROM chapters WHERE text IS NOT NULL)")
def md_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading level that would divide each text."""
    return markdown.heading_levels(_texts(spark, sf_dir, "chapters", "chapter_id"), "chapter_id", "text")


_md = f"""
    WITH d AS (SELECT chapter_id, coalesce(title, 'Untitled') AS fallback, text, {_lines} AS ls FROM chapters WHERE text IS NOT NULL),
    v AS (SELECT chapter_id, fallback, text, ls, {_level} AS level FROM d),
    l AS (SELECT chapter_id, fallback, level, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM v),
    m AS (SELECT *, CASE WHEN regexp_matches({s.strip('line')}, '^#{{1,6}}[{WS}]+.') THEN length(regexp_extract({s.strip('line')}, '^(#{{1,6}})', 1)) <= level ELSE false END AS heading FROM l),
    g AS (SELECT *, sum(heading::INT) OVER (PARTITION BY chapter_id ORDER BY i) AS g FROM m),
    b AS (SELECT chapter_id, g, any_value(fallback) AS fallback, max(CASE WHEN heading THEN {s.strip("regexp_replace(" + s.strip('line') + ", '^#{1,6}[" + WS + "]+', '')")} END) AS title,
        string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT heading) AS raw FROM g GROUP BY chapter_id, g),
    c AS (SELECT chapter_id, g, coalesce(title, fallback) AS title, {s.clean_markdown("coalesce(raw, '')")} AS text FROM b),
    k AS (SELECT * FROM c WHERE text <> ''),
    e AS (SELECT chapter_id, 0 AS g, fallback AS title, {s.clean_markdown('text')} AS text FROM v WHERE chapter_id NOT IN (SELECT chapter_id FROM k))"""


@query(f"""{_md}
    SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY g) AS part_no, title, text FROM (SELECT * FROM k UNION ALL SELECT * FROM e)""")
def md_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's text read as a Markdown document of its own."""
    named = _texts(spark, sf_dir, "chapters", "chapter_id", "title").withColumn("fallback", F.coalesce("title", F.lit("Untitled")))
    return markdown.chapters(named, ["chapter_id"], "text", "fallback")


@query(f"""{_md.replace("WITH d AS", "WITH RECURSIVE d AS", 1)},
    src AS (SELECT chapter_id, g, title, text FROM (SELECT * FROM k UNION ALL SELECT * FROM e)), {s.parts_by_length('src', 'chapter_id, g, title', 1_500)},
    n AS (SELECT *, count(*) OVER (PARTITION BY chapter_id, g) AS n, row_number() OVER (PARTITION BY chapter_id, g ORDER BY k) AS j FROM cut_parts)
    SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY g, j) AS part_no, CASE WHEN n > 1 THEN title || ' ' || j ELSE title END AS title, part AS text FROM n""")
def md_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with chapters of at most 1,500 code points."""
    named = _texts(spark, sf_dir, "chapters", "chapter_id", "title").withColumn("fallback", F.coalesce("title", F.lit("Untitled")))
    return markdown.chapters(named, ["chapter_id"], "text", "fallback", max_chars=1_500)


@query(f"""
    WITH RECURSIVE src AS (SELECT chapter_id, coalesce(title, 'Untitled') AS title, {s.clean_markdown('text')} AS text FROM chapters WHERE text IS NOT NULL), {s.parts_by_length('src', 'chapter_id, title', 1_500)},
    n AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY k) AS j FROM cut_parts)
    SELECT chapter_id, j AS part_no, CASE WHEN j > 1 THEN title || ' ' || j ELSE title END AS title, part AS text FROM n""")
def md_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as one chapter, in parts of at most 1,500 code points."""
    named = _texts(spark, sf_dir, "chapters", "chapter_id", "title").withColumn("fallback", F.coalesce("title", F.lit("Untitled")))
    return markdown.chapters(named, ["chapter_id"], "text", "fallback", single=True, max_chars=1_500)


@query(f"""
    WITH RECURSIVE src AS (SELECT chapter_id, text FROM chapters WHERE text IS NOT NULL), {s.parts_by_length('src', 'chapter_id', 4_000)}
    SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY k)::INT AS part_no, part FROM cut_parts""")
def limited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut to 4,000 code points at blank lines, else spaces."""
    return markdown.limited_parts(table(spark, sf_dir, "chapters"), "chapter_id", "text", 4_000)


# ---- titles and names
@query(f"SELECT chapter_id, {s.slug('title')} AS slug FROM chapters")
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_id", text.slug(F.col("title")).alias("slug"))


@query(f"SELECT chapter_id, {s.file_component('title')} AS name FROM chapters")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_id", text.file_component(F.col("title")).alias("name"))


@query(f"SELECT chapter_id, {s.short_section('title', text.SHORT_SECTIONS)} AS is_short FROM chapters")
def short_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_id", text.is_short_section(F.col("title")).alias("is_short"))


@query(f"""
    WITH p AS (SELECT chapter_id, group_path, list_filter(list_transform(string_split(group_path, ' / '), lambda l: {s.strip('l')}), lambda l: l <> '') AS parts FROM chapters)
    SELECT chapter_id, coalesce(len(parts), 0)::BIGINT AS depth, CASE WHEN group_path IS NULL OR group_path = '' THEN 'Chapter' ELSE parts[-1] END AS leaf,
        CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' / ') END AS path FROM p""")
def group_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("group_path")
    return table(spark, sf_dir, "chapters").select("chapter_id", F.size(text.group_parts(g)).cast("long").alias("depth"), text.group_leaf(g).alias("leaf"), text.group_path(text.group_parts(g)).alias("path"))


@query(f"""
    SELECT part, stem, multi, numbered, CASE
        WHEN NOT multi AND part = 1 THEN CASE WHEN numbered AND regexp_matches(w, '^[0-9]+[ ]*-[ ]*.') THEN regexp_extract(w, '^([0-9]+)', 1) || '-01 - ' || trim(regexp_replace(w, '^[0-9]+ *- *', '')) ELSE stem END
        WHEN regexp_matches(t, '^[0-9]+-.') THEN regexp_extract(t, '^([0-9]+)', 1) || '-' || lpad(part::VARCHAR, 2, '0') || ' - ' || regexp_replace(t, '^[0-9]+-', '')
        ELSE lpad(part::VARCHAR, 2, '0') || '-' || stem END AS name
    FROM (SELECT job_id, part_no::BIGINT AS part, stem, multi, numbered, w, trim(regexp_replace(w, ' *- *', '-', 'g')) AS t FROM (
        SELECT DISTINCT p.job_id, p.part_no, j.output_name AS stem, c.n > 1 AS multi, p.part_no = 1 AS numbered, {s.file_component('j.output_name')} AS w
        FROM manifest_parts p JOIN (SELECT DISTINCT job_id, output_name FROM chapter_jobs) j USING (job_id) JOIN (SELECT job_id, count(*) AS n FROM manifest_parts GROUP BY job_id) c USING (job_id)))""")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of all parts, by their jobs' output names."""
    parts, named = table(spark, sf_dir, "manifest_parts"), table(spark, sf_dir, "chapter_jobs").select("job_id", F.col("output_name").alias("stem")).distinct()
    several = parts.groupBy("job_id").agg((F.count("*") > 1).alias("multi"))
    rows = parts.select("job_id", "part_no").join(named, "job_id").join(several, "job_id").distinct().withColumn("numbered", F.col("part_no") == 1)
    name = text.part_name(F.col("stem"), F.col("part_no"), F.col("multi"), F.col("stem"), F.col("stem"), F.col("numbered"))
    return rows.select(F.col("part_no").cast("long").alias("part"), "stem", "multi", "numbered", name.alias("name"))


@query("SELECT DISTINCT mp3_path, coalesce(try_cast(regexp_extract(regexp_extract(mp3_path, '([^/]*)$', 1), '^([0-9]+)', 1) AS INT), part_no)::BIGINT AS track FROM manifest_parts")
def track_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.element_at(F.split("mp3_path", "/"), -1)
    return table(spark, sf_dir, "manifest_parts").select("mp3_path", text.track_number(stem, F.col("part_no")).cast("long").alias("track")).distinct()


@query("""
    SELECT p_partkey, CASE WHEN r > 1 THEN p_name || '-c' || lpad(r::VARCHAR, greatest(3, length(r::VARCHAR))::INT, '0') ELSE p_name END AS unique_name
    FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)""")
def unique_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.unique_names(table(spark, sf_dir, "part"), [], "p_name", "p_partkey")


# ---- layout
@query(f"""
    WITH w AS (SELECT *, list_filter(string_split({s.collapse("coalesce(text, '')")}, ' '), lambda x: x <> '') AS ws FROM chapters)
    SELECT chapter_id, title, group_path, length(coalesce(text, ''))::BIGINT AS chars, len(ws)::BIGINT AS words, array_to_string(ws[1:20], ' ') AS preview FROM w""")
def chapter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.summaries(table(spark, sf_dir, "chapters"))


@query(f"SELECT chapter_id FROM chapters WHERE text IS NOT NULL AND {s.strip('text')} <> ''")
def spoken_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spoken(table(spark, sf_dir, "chapters")).select("chapter_id")


_spoken = f"text IS NOT NULL AND {s.strip('text')} <> ''"


@query(f"""
    SELECT chapter_id, source_id, chapter_index, group_path, row_number() OVER (PARTITION BY source_id ORDER BY chapter_index, chapter_id) AS place,
        row_number() OVER (PARTITION BY source_id, group_path ORDER BY chapter_index, chapter_id) AS number_in_group FROM chapters WHERE {_spoken}""")
def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.numbered(table(spark, sf_dir, "chapters"))


def _folders(chapters: str) -> str:
    """Common table expressions up to ``dirs`` (source_id, group_path, directory)."""
    return f"""f AS (SELECT source_id, group_path, min((chapter_index, chapter_id)) AS seen FROM {chapters} WHERE group_path <> '' GROUP BY ALL),
    p AS (SELECT *, list_filter(list_transform(string_split(group_path, ' / '), lambda l: {s.strip('l')}), lambda l: l <> '') AS parts FROM f),
    n AS (SELECT source_id, group_path, seen, parts, unnest(range(1, len(parts) + 1)) AS depth FROM p),
    o AS (SELECT source_id, group_path, seen, depth, array_to_string(parts[1:depth - 1], ' / ') AS parent, parts[depth] AS name FROM n),
    b AS (SELECT source_id, parent, depth, name, row_number() OVER (PARTITION BY source_id, parent, depth ORDER BY seen) AS place FROM (SELECT source_id, parent, depth, name, min(seen) AS seen FROM o GROUP BY source_id, parent, depth, name)),
    dirs AS (SELECT source_id, group_path, string_agg({s.padded('place', 2)} || '-' || {s.slug('name')}, '/' ORDER BY depth) AS directory FROM o JOIN b USING (source_id, parent, depth, name) GROUP BY ALL)"""


@query(f"WITH {_folders('chapters')} SELECT * FROM dirs")
def group_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_directories(table(spark, sf_dir, "chapters"))


@query("""
    WITH r AS (SELECT source_id, group_path, title, row_number() OVER (PARTITION BY source_id, group_path ORDER BY chapter_index, chapter_id) AS k FROM chapters)
    SELECT source_id, group_path, count(*) AS n_titles, string_agg(coalesce(title, ''), '; ' ORDER BY k) FILTER (WHERE k <= 10) AS first_titles FROM r GROUP BY ALL""")
def grouped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grouped_titles(table(spark, sf_dir, "chapters"))


@query("""
    WITH p AS (SELECT source_id, chapter_id, count(*) AS n_chunks, min(chunk_index) AS pos FROM (SELECT DISTINCT chunk_id, source_id, chapter_id, chunk_index FROM chunks) GROUP BY ALL)
    SELECT source_id, chapter_id, n_chunks, (coalesce(sum(n_chunks) OVER (PARTITION BY source_id ORDER BY pos, chapter_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_chunk FROM p""")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.chunk_offsets(table(spark, sf_dir, "chunks"))


def _navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as a navigation tree of two levels."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    listed = region.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("all"))  # one row an entry at the top
    r = listed.select(F.posexplode("all").alias("pos", "x")).select("x.r_regionkey", "x.r_name", (F.col("pos") + 1).alias("at"))
    n = nation.join(r, nation.n_regionkey == r.r_regionkey).withColumn("own", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    top = r.select(F.array("r_name").alias("path"), F.array("at").alias("places"), F.lit(True).alias("has_children"))
    return top.unionByName(n.select(F.array("r_name", "n_name").alias("path"), F.array("at", "own").alias("places"), F.lit(False).alias("has_children")))


@query(f"""
    WITH r AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region), d AS (SELECT *, lpad(k::VARCHAR, 2, '0') || '-' || {s.file_component('r_name')} AS folder FROM r)
    SELECT r_name AS group_path, folder AS directory FROM d UNION ALL SELECT r_name || ' / ' || n_name, folder FROM nation JOIN d ON n_regionkey = r_regionkey""")
def navigation_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _navigation(spark, sf_dir)
    return layout.navigation_directories(nodes, nodes.select(text.group_path(F.col("path")).alias("group_path")))


@query("""
    SELECT n_nationkey::BIGINT AS page, n_name AS own_title, coalesce(r_name, n_name) AS title FROM nation
    LEFT JOIN (SELECT r_regionkey * 2 AS target, max_by(r_name, r_regionkey) AS r_name FROM region GROUP BY 1) t ON n_nationkey = target""")
def contents_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the title of the contents' last entry for them, else their own."""
    entries = table(spark, sf_dir, "region").groupBy((F.col("r_regionkey") * 2).alias("target")).agg(F.max_by("r_name", "r_regionkey").alias("entry"))
    pages = table(spark, sf_dir, "nation")
    return pages.join(bounded_broadcast(entries, 10_000), pages.n_nationkey == F.col("target"), "left").select(F.col("n_nationkey").cast("long").alias("page"), F.col("n_name").alias("own_title"), F.coalesce("entry", "n_name").alias("title"))


# ---- jobs
@query(f"SELECT chapter_id, source_id, title, length(text)::BIGINT AS estimated_chars, greatest(1, (length(text) + {LIMIT - 1}) // {LIMIT})::BIGINT AS estimated_chunks FROM chapters WHERE text IS NOT NULL")
def job_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.estimates(table(spark, sf_dir, "chapters").where("text IS NOT NULL"))


@query(f"""
    WITH j AS (SELECT DISTINCT job_id, attempt, preferred_provider, estimated_chunks, estimated_chars, coalesce(chapter_title, '') AS t, pow(0.8, greatest(attempt - 1, 0)) AS shrink FROM chapter_jobs)
    SELECT job_id, attempt, CASE WHEN preferred_provider = '{jobs.CPU}' THEN greatest(350, trunc((CASE WHEN {s.short_section('t', text.SHORT_SECTIONS)} THEN 1080 ELSE 900 END) * shrink))
        ELSE greatest(450, trunc((CASE WHEN estimated_chunks >= 12 OR estimated_chars >= 12000 THEN 950 ELSE 1350 END) * shrink)) END::BIGINT AS max_chars FROM j""")
def worker_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = jobs.worker_chars(F.coalesce("preferred_provider", F.lit(jobs.GPU)), F.coalesce("chapter_title", F.lit("")), F.col("estimated_chunks"), F.col("estimated_chars"), F.col("attempt"))
    return table(spark, sf_dir, "chapter_jobs").select("job_id", "attempt", size.alias("max_chars")).distinct()


def _names(navigation: str) -> str:
    return f"""
    WITH sp AS (SELECT * FROM chapters WHERE {_spoken}), {_folders('sp')},
    k AS (SELECT chapter_id, source_id, nullif(group_path, '') AS group_path, {s.file_component("coalesce(title, '')")} AS t, row_number() OVER (PARTITION BY source_id ORDER BY chapter_index, chapter_id) AS chapter_index FROM sp),
    l AS (SELECT k.*, CASE WHEN k.group_path IS NULL THEN root ELSE concat_ws('/', root, coalesce(directory, {s.file_component('k.group_path')})) END AS output_subdir
        FROM k LEFT JOIN dirs USING (source_id, group_path) LEFT JOIN (SELECT source_id, {s.slug(s.stem('source_path'))} AS root FROM sources) USING (source_id)),
    nav AS ({navigation}),
    e AS (SELECT l.*, CASE WHEN group_path IS NULL THEN place END AS entry FROM l LEFT JOIN nav USING (source_id, t)),
    c AS (SELECT *, coalesce(entry, row_number() OVER (PARTITION BY source_id, output_subdir, CASE WHEN group_path IS NOT NULL THEN 0 WHEN entry IS NULL THEN 1 ELSE 2 END ORDER BY chapter_index)) AS no FROM e),
    m AS (SELECT *, {s.padded('no', 2)} || '-' || t AS name FROM c),
    d AS (SELECT *, row_number() OVER (PARTITION BY source_id, output_subdir, name ORDER BY chapter_index) AS same FROM m)
    SELECT chapter_id, chapter_index, output_subdir, CASE WHEN same > 1 THEN name || '-c' || {s.padded('chapter_index', 3)} ELSE name END AS output_name FROM d"""


@query(_names("SELECT NULL::BIGINT AS source_id, NULL::VARCHAR AS t, NULL::BIGINT AS place WHERE false"))
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.output_names(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "sources"))


@query(_names(f"SELECT source_id, {s.file_component('title')} AS t, min(chapter_index + 100)::BIGINT AS place FROM chapters WHERE group_path IS NULL AND length(title) < 20 GROUP BY ALL"))
def output_names_by_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where short titles without a group are entries of the contents."""
    chapters = table(spark, sf_dir, "chapters")
    entries = chapters.where((F.length("title") < 20) & F.col("group_path").isNull()).select("source_id", "title", (F.col("chapter_index") + 100).alias("place"))
    return jobs.output_names(chapters, table(spark, sf_dir, "sources"), entries)


@query(f"SELECT source_path, {s.slug('source_path')} || '.json' AS cache FROM sources")
def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file in which each source's chapters are cached."""
    return table(spark, sf_dir, "sources").select("source_path", text.cache_name(F.col("source_path")).alias("cache"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stands in for the folder of sound files: every file that a manifest names, as long as its part lasts."""
    parts = table(spark, sf_dir, "manifest_parts")
    return parts.select(F.explode(F.array("mp3_path", "wav_path")).alias("path"), (F.coalesce("duration_seconds", F.lit(0.0)) * 16_000).cast("long").alias("length")).where("path IS NOT NULL")


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.complete(table(spark, sf_dir, "manifest_parts"), _listing(spark, sf_dir))


_complete = """SELECT job_id FROM manifest_parts GROUP BY job_id HAVING bool_and(coalesce(mp3_path, '') <> '' AND mp3_path IN (SELECT path FROM (SELECT unnest([mp3_path, wav_path]) AS path, trunc(coalesce(duration_seconds, 0) * 16000) AS n FROM manifest_parts) WHERE n > 0 AND path IS NOT NULL)
    AND (coalesce(wav_path, '') = '' OR wav_path IN (SELECT path FROM (SELECT unnest([mp3_path, wav_path]) AS path, trunc(coalesce(duration_seconds, 0) * 16000) AS n FROM manifest_parts) WHERE n > 0 AND path IS NOT NULL)))"""


@query(f"SELECT DISTINCT job_id, attempt FROM chapter_jobs WHERE job_id NOT IN ({_complete})")
def jobs_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pending(table(spark, sf_dir, "chapter_jobs"), _done(spark, sf_dir)).select("job_id", "attempt").distinct()


@query(f"SELECT source_path, count(DISTINCT job_id) AS n_skipped FROM chapter_jobs WHERE job_id IN ({_complete}) GROUP BY source_path")
def jobs_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs.skipped(table(spark, sf_dir, "chapter_jobs"), _done(spark, sf_dir))
    return done.groupBy("source_path").agg(F.count_distinct("job_id").alias("n_skipped"))


@query(f"SELECT job_id FROM chapter_jobs EXCEPT ALL ({_complete})")
def jobs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts but one of each finished job, as a bag difference."""
    return table(spark, sf_dir, "chapter_jobs").select("job_id").exceptAll(_done(spark, sf_dir))


_key = "(estimated_chunks, estimated_chars, chapter_index, job_id)"


@query(f"""
    WITH k AS (SELECT source_path, max({_key}) AS k FROM chapter_jobs WHERE preferred_provider IS NULL OR preferred_provider = '{jobs.GPU}' GROUP BY source_path)
    SELECT source_path, k[4] AS job_id, k[1] AS estimated_chunks, k[2] AS estimated_chars FROM k""")
def gpu_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.gpu_pick(table(spark, sf_dir, "chapter_jobs"), ["source_path"])


@query(f"""
    WITH t AS (SELECT *, CASE WHEN preferred_provider = '{jobs.CPU}' THEN 1 WHEN preferred_provider IS NULL AND ({s.short_section("coalesce(chapter_title, '')", text.SHORT_SECTIONS)} OR (estimated_chars <= 12000 AND estimated_chunks <= 2)) THEN 2
        ELSE 4 END AS tier FROM chapter_jobs), k AS (SELECT source_path, min((tier, estimated_chunks, estimated_chars, chapter_index, job_id)) AS k FROM t GROUP BY source_path)
    SELECT source_path, k[1] AS tier, k[5] AS job_id, k[2] AS estimated_chunks, k[3] AS estimated_chars FROM k""")
def cpu_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a CPU worker idle for two minutes would take of each source once the GPUs have stopped."""
    return jobs.cpu_pick(table(spark, sf_dir, "chapter_jobs"), ["source_path"], allowed_chunks=2)


_device = "coalesce((regexp_matches(lower(line_text), 'cuda|cudnn|cublas|out of memory') OR event_kind = 'timeout') AND starts_with(worker_name, 'gpu'), false)"


@query(f"""
    WITH j AS (SELECT job_id, max(attempt) AS attempt, max_by(coalesce(preferred_provider, ''), attempt) AS provider, max_by(fallback_locked, attempt) AS locked FROM chapter_jobs GROUP BY job_id),
    f AS (SELECT job_id, bool_or({_device}) AS g FROM runner_log WHERE event_kind IN ('worker_exception', 'timeout', 'retry') GROUP BY job_id)
    SELECT job_id, (attempt + 1)::BIGINT AS attempt, CASE WHEN g THEN '{jobs.CPU}' ELSE nullif(provider, '') END AS preferred_provider, g AS fallback_locked FROM j JOIN f USING (job_id) WHERE attempt <= 2 AND NOT coalesce(locked, false)""")
def next_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = jobs.next_attempts(table(spark, sf_dir, "chapter_jobs"), events.gpu_failures(table(spark, sf_dir, "runner_log")))
    return again.withColumn("attempt", F.col("attempt").cast("long"))


@query(f"""
    SELECT DISTINCT coalesce(preferred_provider, '') AS wish, worker, CASE WHEN list_contains(available, wish2[1]) THEN wish2[1] WHEN list_contains(available, '{jobs.CPU}') THEN '{jobs.CPU}' ELSE available[1] END AS provider
    FROM (SELECT preferred_provider, coalesce([preferred_provider], ['{jobs.GPU}']) AS w, CASE WHEN preferred_provider IS NULL THEN ['{jobs.GPU}'] ELSE [preferred_provider] END AS wish2,
        worker, CASE WHEN worker LIKE 'gpu%' THEN ['{jobs.GPU}', '{jobs.CPU}'] ELSE ['{jobs.CPU}'] END AS available FROM chapter_jobs, (SELECT unnest(['gpu-1', 'cpu-1']) AS worker))""")
def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider that each worker would use for each wish."""
    wishes = table(spark, sf_dir, "chapter_jobs").select(F.coalesce("preferred_provider", F.lit("")).alias("wish")).distinct()
    both = wishes.select("wish", F.explode(F.array(F.lit("gpu-1"), F.lit("cpu-1"))).alias("worker"))
    available = F.when(F.startswith("worker", F.lit("gpu")), F.array(F.lit(jobs.GPU), F.lit(jobs.CPU))).otherwise(F.array(F.lit(jobs.CPU)))
    return both.select("wish", "worker", text.resolve_provider(available, text.provider_list(F.col("wish"))).alias("provider"))


# ---- parts and manifests
_samples = "SELECT chapter_id, chunk_index, 1600 * length(text) + CASE WHEN row_number() OVER (PARTITION BY chapter_id ORDER BY chunk_index DESC) = 1 THEN 0 ELSE 6000 END AS n FROM (SELECT DISTINCT chunk_id, chapter_id, chunk_index, text FROM chunks) WHERE text IS NOT NULL"
PART = render.part_limit(minutes=1)


def _chunk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("chunk_id", "chapter_id", "chunk_index", F.length("text").alias("chars")).dropDuplicates(["chunk_id"])
    last = F.row_number().over(Window.partitionBy("chapter_id").orderBy(F.desc("chunk_index"))) == 1
    return own.select("chapter_id", "chunk_index", render.padded(F.col("chars").cast("long") * 1600, last).alias("samples"))


@query(f"""
    WITH RECURSIVE x AS ({_samples}), o AS (SELECT chapter_id, chunk_index::BIGINT AS c, n, row_number() OVER (PARTITION BY chapter_id ORDER BY chunk_index) AS r FROM x),
    w AS (SELECT chapter_id, r, c, 1 AS part, n AS run FROM o WHERE r = 1
        UNION ALL SELECT o.chapter_id, o.r, o.c, CASE WHEN w.run >= {PART} THEN w.part + 1 ELSE w.part END, CASE WHEN w.run >= {PART} THEN o.n ELSE w.run + o.n END FROM w JOIN o ON o.chapter_id = w.chapter_id AND o.r = w.r + 1)
    SELECT chapter_id, part::BIGINT AS part_no, min(c) AS start_chunk, max(c) AS end_chunk, max(run)::BIGINT AS samples FROM w GROUP BY chapter_id, part""")
def packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of at least a minute of every chapter's job."""
    return render.packed_parts(_chunk_samples(spark, sf_dir), ["chapter_id"], PART)


@query(f"""
    WITH RECURSIVE x AS (SELECT s.chapter_id, s.chunk_index, s.n, h.heading FROM ({_samples}) s JOIN (SELECT DISTINCT chapter_id, chunk_index, heading FROM chunks) h ON h.chapter_id = s.chapter_id AND h.chunk_index = s.chunk_index),
    o AS (SELECT chapter_id, chunk_index::BIGINT AS c, n, heading AS g, row_number() OVER (PARTITION BY chapter_id ORDER BY chunk_index) AS r FROM x),
    w AS (SELECT chapter_id, r, c, g, 1 AS seq, 1 AS part, n AS run FROM o WHERE r = 1
        UNION ALL SELECT o.chapter_id, o.r, o.c, o.g, CASE WHEN o.g IS DISTINCT FROM w.g OR w.run >= {PART // 4} THEN w.seq + 1 ELSE w.seq END, CASE WHEN o.g IS DISTINCT FROM w.g THEN 1 WHEN w.run >= {PART // 4} THEN w.part + 1 ELSE w.part END,
            CASE WHEN o.g IS DISTINCT FROM w.g OR w.run >= {PART // 4} THEN o.n ELSE w.run + o.n END FROM w JOIN o ON o.chapter_id = w.chapter_id AND o.r = w.r + 1)
    SELECT chapter_id, max(part)::BIGINT AS part_no, min(c) AS start_chunk, max(c) AS end_chunk, max(run)::BIGINT AS samples, any_value(g) AS "group" FROM w GROUP BY chapter_id, seq""")
def grouped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a quarter of a minute that end where the heading changes, numbered anew under each."""
    headed = table(spark, sf_dir, "chunks").select("chapter_id", "chunk_index", "heading").distinct()
    return render.packed_parts(_chunk_samples(spark, sf_dir).join(headed, ["chapter_id", "chunk_index"]), ["chapter_id"], PART // 4, "heading")


@query(f"""
    WITH RECURSIVE x AS ({_samples}), o AS (SELECT chapter_id, chunk_index::BIGINT AS c, n, row_number() OVER (PARTITION BY chapter_id ORDER BY chunk_index) AS r FROM x),
    w AS (SELECT chapter_id, r, c, 1 AS part, n AS run FROM o WHERE r = 1
        UNION ALL SELECT o.chapter_id, o.r, o.c, CASE WHEN w.run >= {PART} THEN w.part + 1 ELSE w.part END, CASE WHEN w.run >= {PART} THEN o.n ELSE w.run + o.n END FROM w JOIN o ON o.chapter_id = w.chapter_id AND o.r = w.r + 1),
    p AS (SELECT chapter_id, part, min(c) AS a, max(c) AS b FROM w GROUP BY ALL), q AS (SELECT *, (part - 1) // 2 + 1 AS run_no, max(part) OVER (PARTITION BY chapter_id) AS l, min(a) OVER (PARTITION BY chapter_id) AS f FROM p)
    SELECT chapter_id, run_no::BIGINT AS run_no, (max(part) + 1)::BIGINT AS next_part, (max(b) + 1)::BIGINT AS next_chunk, (max(b) - min(f) + 1)::BIGINT AS completed_chunks, max(part) < max(l) AS partial FROM q GROUP BY chapter_id, run_no""")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chapter's job goes on if a run ends after two parts."""
    return resume.points(packed_parts(spark, sf_dir), ["chapter_id"], 2)


@query("""
    SELECT chapter_id, count(*) AS chunk_count, string_agg(chunk_index || ':' || coalesce(heading, '') || ':' || coalesce(length(text), 0) || ':' || md5(coalesce(text, '')), '|' ORDER BY chunk_index, chunk_id) AS chunks FROM (SELECT DISTINCT chunk_id, chapter_id, chunk_index, heading, text FROM chunks) GROUP BY chapter_id""")
def manifest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every chapter's manifest, shown in one line."""
    made = render.manifest_chunks(table(spark, sf_dir, "chunks").withColumn("title", F.col("heading")), ["chapter_id"], "title")
    line = lambda c: F.concat_ws(":", c["index"].cast("string"), F.coalesce(c["heading"], F.lit("")), F.coalesce(c["chars"], F.lit(0)).cast("string"), F.md5(F.coalesce(c["text"], F.lit(""))))
    return made.select("chapter_id", F.size("chunks").cast("long").alias("chunk_count"), F.array_join(F.transform("chunks", line), "|").alias("chunks"))


@query(f"""
    WITH j AS (SELECT DISTINCT job_id, source_path FROM chapter_jobs)
    SELECT DISTINCT p.job_id, p.part_no, {s.stem('mp3_path')} AS title, coalesce(try_cast(nullif(regexp_extract({s.stem('mp3_path')}, '^([0-9]+)', 1), '') AS INT), part_no)::VARCHAR AS tracknumber,
        CASE WHEN coalesce(group_path, '') = '' THEN source_title ELSE list_filter(list_transform(string_split(group_path, ' / '), lambda l: {s.strip('l')}), lambda l: l <> '')[-1] END AS album,
        nullif(author, '') AS artist, nullif(author, '') AS albumartist, nullif(published_date, '') AS date, nullif(source_title, '') AS comment, nullif(publisher, '') AS publisher
    FROM manifest_parts p JOIN j USING (job_id) JOIN sources USING (source_path)""")
def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every part's sound file."""
    of = table(spark, sf_dir, "chapter_jobs").select("job_id", "source_path").distinct()
    rows = table(spark, sf_dir, "manifest_parts").join(of, "job_id").join(table(spark, sf_dir, "sources"), "source_path")
    stem = text.stem(F.col("mp3_path"))
    made = render.tags(stem, text.track_number(stem, F.col("part_no")), F.col("source_title"), F.col("author"), F.col("publisher"), F.col("published_date"), F.col("group_path"))
    return rows.select("job_id", "part_no", made.alias("t")).select("job_id", "part_no", "t.*").distinct()


@query(r"""
    WITH n AS (SELECT job_id, output_name, count(DISTINCT part_no) AS n FROM (SELECT DISTINCT job_id, output_name FROM chapter_jobs) JOIN manifest_parts USING (job_id) GROUP BY ALL)
    SELECT job_id, CASE WHEN n <= 1 THEN regexp_replace(output_name, '([^/])\.[^./]+$', '\1') || '.mp3' ELSE array_to_string(list_transform(range(1, n + 1), lambda k: output_name || '-part' || lpad(k::VARCHAR, greatest(2, length(k::VARCHAR))::INT, '0') || '.mp3'), '|') END AS files FROM n""")
def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of every finished job by its number of parts."""
    named = table(spark, sf_dir, "chapter_jobs").select("job_id", "output_name").distinct().join(table(spark, sf_dir, "manifest_parts"), "job_id").groupBy("job_id", "output_name").agg(F.count_distinct("part_no").alias("n"))
    return named.select("job_id", F.array_join(F.transform(text.output_paths(F.col("output_name"), F.col("n")), lambda f: f["mp3"]), "|").alias("files"))


@query("SELECT DISTINCT mp3_path AS root, wav_path AS target, CASE WHEN duration_seconds > 20 THEN '_quarantine/' || replace(regexp_replace(wav_path, '^/+', ''), '/', '__') END AS quarantined FROM manifest_parts WHERE wav_path IS NOT NULL")
def quarantine_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of MP3 files to the places of their WAV files, of which those longer than 20 seconds are there already."""
    parts = table(spark, sf_dir, "manifest_parts").where("wav_path IS NOT NULL")
    moves = parts.select(F.col("mp3_path").alias("root"), F.col("wav_path").alias("target")).distinct()
    return repair.move_plan(moves, parts.where("duration_seconds > 20").select(F.col("wav_path").alias("path")), "_quarantine")


@query("SELECT lang, word, lower(trim(word)) IN ('1', 'true', 'yes', 'on', 'debug') AS is_on FROM common_words")
def settings_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words would switch a setting on."""
    return table(spark, sf_dir, "common_words").select("lang", "word", text.is_true(F.col("word")).alias("is_on"))


@query("""
    SELECT job_id, count(*) AS part_count, (max(end_chunk) - min(start_chunk) + 1)::BIGINT AS chunk_count, round(sum(duration_seconds), 3) AS duration_seconds,
        string_agg(part_no::VARCHAR || ':' || start_chunk || '-' || end_chunk || ':' || coalesce(group_path, ''), ',' ORDER BY part_no, start_chunk) AS parts FROM manifest_parts GROUP BY job_id""")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested manifests, their parts shown in one line."""
    line = lambda p: F.concat(p["part"].cast("string"), F.lit(":"), p["start_chunk"].cast("string"), F.lit("-"), p["end_chunk"].cast("string"), F.lit(":"), F.coalesce(p["group"], F.lit("")))
    return render.manifests(table(spark, sf_dir, "manifest_parts")).withColumn("parts", F.array_join(F.transform("parts", line), ",")).withColumn("duration_seconds", F.round("duration_seconds", 3))


@query("""
    WITH o AS (SELECT DISTINCT chunk_id, chapter_id, chunk_index, coalesce(heading, '') AS h FROM chunks), l AS (SELECT *, lag(h) OVER (PARTITION BY chapter_id ORDER BY chunk_index, chunk_id) AS p FROM o)
    SELECT chapter_id, string_agg(h, ' | ' ORDER BY chunk_index, chunk_id) FILTER (WHERE p IS NULL OR p <> h) AS headings FROM l GROUP BY chapter_id""")
def heading_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings that each chapter's chunks pass through."""
    return render.heading_runs(table(spark, sf_dir, "chunks"), ["chapter_id"]).select("chapter_id", F.array_join("headings", " | ").alias("headings"))


@query("""
    WITH g AS (SELECT job_id, part_no, start_chunk, coalesce(group_path, '') AS g, lag(coalesce(group_path, '')) OVER (PARTITION BY job_id ORDER BY part_no, start_chunk) AS p FROM manifest_parts)
    SELECT job_id, count(*) AS n_parts, count(*) FILTER (WHERE p IS NULL OR p <> g) AS n_group_runs FROM g GROUP BY job_id""")
def group_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the group changes over a job's parts."""
    before = F.lag("g").over(Window.partitionBy("job_id").orderBy("part_no", "start_chunk"))
    parts = table(spark, sf_dir, "manifest_parts").select("job_id", "part_no", "start_chunk", F.coalesce("group_path", F.lit("")).alias("g")).withColumn("p", before)
    return parts.groupBy("job_id").agg(F.count("*").alias("n_parts"), F.count_if(F.col("p").isNull() | (F.col("p") != F.col("g"))).alias("n_group_runs"))


@query("SELECT DISTINCT chunk_id, 1600 * length(coalesce(text, ''))::BIGINT AS n_samples, 24000::INT AS sample_rate FROM chunks")
def rendered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub voice over every chunk."""
    return render.rendered(table(spark, sf_dir, "chunks"), ["chunk_id"], "text", unique=True)


@query("SELECT vec_id, list_transform(embedding, lambda x: trunc(greatest(-1.0, least(1.0, x::DOUBLE)) * 32767)::INT) AS pcm FROM embeddings")
def pcm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", render.pcm16(F.transform("embedding", lambda x: x.cast("double"))).alias("pcm"))


@query("""
    SELECT vec_id, flatten(list_transform(range(1, len(embedding) // 2 + 1), lambda i: [trunc(greatest(-1.0, least(1.0, embedding[i]::DOUBLE)) * 32767)::INT, trunc(greatest(-1.0, least(1.0, embedding[i + len(embedding) // 2]::DOUBLE)) * 32767)::INT])) AS pcm FROM embeddings""")
def stereo_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each vector as two channels."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    half = F.floor(F.size("embedding") / 2).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"), half.alias("h")).select("vec_id", render.interleaved(F.array(F.slice("e", F.lit(1), F.col("h")), F.slice("e", F.col("h") + 1, F.col("h")))).alias("pcm"))


@query("""
    WITH k AS (SELECT vec_id, embedding, list_filter(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN abs(embedding[i]) > 0.1 THEN i END), lambda i: i IS NOT NULL) AS loud FROM embeddings)
    SELECT vec_id, (CASE WHEN len(loud) = 0 THEN len(embedding) ELSE least(loud[-1] + 2, len(embedding)) - greatest(loud[1] - 2, 1) + 1 END)::BIGINT AS n FROM k""")
def trimmed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sounds, without their silent ends but for two samples of padding."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(render.trimmed(F.col("embedding"), 1000, 0.1, 2)).cast("long").alias("n"))


# ---- events
@query(rf"""
    WITH l AS (SELECT DISTINCT *, trim(line_text) AS t FROM runner_log), p AS (SELECT *, regexp_extract(t, '^\[(\d+)/(\d+)\]\s+([0-9.]+)% .* eta=([0-9.]+)s', ['a', 'b', 'c', 'd']) AS m, CASE WHEN starts_with(t, '{{') AND json_valid(t) THEN t END AS j FROM l)
    SELECT event_id, job_id, worker_name, event_kind, try_cast(nullif(m.a, '') AS BIGINT) AS progress_current, try_cast(nullif(m.b, '') AS BIGINT) AS progress_total, try_cast(nullif(m.c, '') AS DOUBLE) AS percent, try_cast(nullif(m.d, '') AS DOUBLE) AS eta_seconds,
        coalesce(json_extract_string(j, '$.heartbeat') = 'true', false) AS is_heartbeat, coalesce(json_extract_string(j, '$.worker_job_done') = 'true', false) AS is_done, try_cast(json_extract_string(j, '$.completed_chunks') AS BIGINT) AS completed_chunks FROM p""")
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.parsed(events.once(table(spark, sf_dir, "runner_log")))


_phase = """CASE WHEN contains(lower(line_text), '[run:bootstrap] loading onnxruntime...') THEN 'bootstrap_onnxruntime' WHEN contains(lower(line_text), '[run:bootstrap] loading kokoro_onnx...') THEN 'bootstrap_model_load'
    WHEN contains(lower(line_text), '[run:bootstrap] creating kokoro session...') THEN 'bootstrap_session' WHEN contains(lower(line_text), '[run:warmup] start') THEN 'warmup' WHEN contains(lower(line_text), '[run:warmup] done') THEN 'chapter_load'
    WHEN starts_with(trim(line_text), '[') AND contains(line_text, '/') AND contains(lower(line_text), 'chapter=') AND contains(lower(line_text), 'chunk=') THEN 'render' END"""


@query(f"SELECT event_id, job_id, coalesce(last_value({_phase} IGNORE NULLS) OVER (PARTITION BY job_id, worker_name ORDER BY logged_at, event_id ROWS UNBOUNDED PRECEDING), 'spawn') AS phase FROM (SELECT DISTINCT * FROM runner_log)")
def event_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.phases(table(spark, sf_dir, "runner_log"))


@query(f"SELECT event_id, worker_name, logged_at + INTERVAL 12 SECOND AS ready_at FROM (SELECT DISTINCT * FROM runner_log) WHERE {_device}")
def worker_rests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until when GPU workers rest after a failure."""
    return events.rests(table(spark, sf_dir, "runner_log"))


@query(f"""
    WITH e AS (SELECT DISTINCT * FROM runner_log), g AS (SELECT event_id, job_id, (epoch_us(logged_at) - lag(epoch_us(logged_at)) OVER w) / 1000000 AS gap_seconds,
        coalesce(last_value({_phase} IGNORE NULLS) OVER (PARTITION BY job_id, worker_name ORDER BY logged_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'spawn') AS phase FROM e WINDOW w AS (PARTITION BY job_id, worker_name ORDER BY logged_at, event_id))
    SELECT event_id, job_id, gap_seconds FROM g WHERE gap_seconds > CASE WHEN phase LIKE 'bootstrap%' OR phase = 'warmup' THEN 20 ELSE 35 END""")
def event_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences by limits of 35 seconds, 20 before rendering; the tables have none as long as the defaults."""
    return events.silences(table(spark, sf_dir, "runner_log"), 35.0, 20.0)


@query("SELECT worker_name, max_by(event_id, (logged_at, event_id)) AS event_id, max_by(event_kind, (logged_at, event_id)) AS event_kind, count(DISTINCT event_id) AS n_events FROM runner_log GROUP BY worker_name")
def worker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.last_states(table(spark, sf_dir, "runner_log"), ["worker_name"])


@query("SELECT event_kind, count(DISTINCT event_id) AS n_events, count(DISTINCT job_id) AS n_jobs, count(DISTINCT worker_name) AS n_workers FROM runner_log GROUP BY event_kind")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.summary(table(spark, sf_dir, "runner_log"))


@query(r"""
    WITH s AS (SELECT job_id, max(estimated_chunks) AS chunks FROM chapter_jobs GROUP BY job_id),
    e AS (SELECT job_id, max((starts_with(trim(line_text), '{') AND json_valid(line_text) AND json_extract_string(CASE WHEN json_valid(line_text) THEN line_text END, '$.worker_job_done') = 'true')::INT) AS done,
        max(try_cast(nullif(regexp_extract(trim(line_text), '^\[(\d+)/(\d+)\]\s+([0-9.]+)% .* eta=([0-9.]+)s', 1), '') AS BIGINT)) AS cur FROM runner_log GROUP BY job_id),
    j AS (SELECT chunks, coalesce(done, 0) AS done, least(chunks, coalesce(cur, 0)) AS cur FROM s LEFT JOIN e USING (job_id))
    SELECT count(*) AS n_jobs, sum(done)::BIGINT AS n_done, sum(chunks)::BIGINT AS n_chunks, sum(CASE WHEN done = 1 THEN chunks ELSE cur END)::BIGINT AS n_chunks_done, round(sum(CASE WHEN done = 1 THEN chunks ELSE cur END) * 100.0 / sum(chunks), 1)::DOUBLE AS percent FROM j""")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.batch_progress(table(spark, sf_dir, "chapter_jobs"), table(spark, sf_dir, "runner_log"))


_progress = r"regexp_extract(trim(line_text), '^\[(\d+)/(\d+)\]\s+([0-9.]+)% .* eta=([0-9.]+)s', ['a', 'b', 'c', 'd'])"


@query(f"""
    WITH s AS (SELECT job_id, source_path, max(estimated_chunks) AS chunks FROM chapter_jobs GROUP BY ALL), l AS (SELECT DISTINCT * FROM runner_log),
    e AS (SELECT job_id, coalesce(bool_or(starts_with(trim(line_text), '{{') AND json_valid(line_text) AND json_extract_string(CASE WHEN json_valid(line_text) THEN line_text END, '$.worker_job_done') = 'true'), false) AS done,
        max(try_cast(nullif({_progress}.a, '') AS BIGINT)) AS cur, max((logged_at, event_id)) FILTER (WHERE event_kind IN ('worker_exception', 'timeout')) AS bad, max((logged_at, event_id)) FILTER (WHERE event_kind NOT IN ('worker_exception', 'timeout')) AS good,
        min(epoch_us(logged_at)) AS begun, max(epoch_us(logged_at)) AS ended FROM l GROUP BY job_id),
    j AS (SELECT source_path, chunks, coalesce(done, false) AS done, least(chunks, coalesce(cur, 0)) AS cur, bad IS NOT NULL AND (good IS NULL OR bad > good) AS failed, begun, ended FROM s LEFT JOIN e USING (job_id)),
    t AS (SELECT source_path, count(*) AS n_jobs, count(*) FILTER (WHERE done) AS n_done, count(*) FILTER (WHERE NOT done AND NOT failed AND cur > 0) AS n_running, count(*) FILTER (WHERE failed AND NOT done) AS n_failed, sum(chunks) AS total,
        sum(CASE WHEN done THEN chunks WHEN NOT failed AND cur > 0 THEN cur ELSE 0 END) AS made, coalesce((max(ended) - min(begun)) / 1000000, 0.0) AS took FROM j GROUP BY source_path)
    SELECT source_path, n_jobs, n_done, n_running, n_failed, CASE WHEN total > 0 THEN round(made * 100.0 / total, 1) ELSE 100.0 END::DOUBLE AS percent, CASE WHEN made > 0 THEN round(took / made, 3) ELSE 0.0 END AS average_seconds, CASE WHEN made > 0 THEN round(took / made * (total - made), 3) ELSE 0.0 END AS eta_seconds FROM t""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's jobs are, and how long they will take."""
    queue, log = table(spark, sf_dir, "chapter_jobs"), table(spark, sf_dir, "runner_log")
    of = queue.select("job_id", "source_path").distinct()
    at = F.unix_micros(F.col("logged_at").cast("timestamp"))
    took = log.join(of, "job_id").groupBy("source_path").agg(((F.max(at) - F.min(at)) / 1_000_000).alias("took"))
    states = events.job_states(queue, log).join(of, "job_id").join(took, "source_path", "left")
    return events.batch_summary(states, ["source_path"], F.coalesce("took", F.lit(0.0)))


@query(f"""
    WITH RECURSIVE l AS (SELECT DISTINCT event_id, job_id, worker_name, epoch_us(logged_at) AS t, {_progress} AS m FROM runner_log),
    o AS (SELECT event_id, job_id, worker_name, t, m.a::BIGINT AS c, m.b::BIGINT AS n, row_number() OVER (PARTITION BY job_id, worker_name ORDER BY t, event_id) AS r FROM l WHERE m.a <> ''),
    w AS (SELECT *, true AS shown, t AS st, c AS sc, n AS sn FROM o WHERE r = 1
        UNION ALL SELECT o.*, NOT h, CASE WHEN h THEN w.st ELSE o.t END, CASE WHEN h THEN w.sc ELSE o.c END, CASE WHEN h THEN w.sn ELSE o.n END
        FROM w JOIN o ON o.job_id = w.job_id AND o.worker_name IS NOT DISTINCT FROM w.worker_name AND o.r = w.r + 1, LATERAL (SELECT o.n = w.sn AND (o.c = w.sc OR o.c < o.n AND o.t - w.st < 30000000) AS h))
    SELECT event_id, job_id FROM w WHERE shown""")
def shown_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress lines that are shown, one in 30 seconds."""
    return events.shown_progress(table(spark, sf_dir, "runner_log"), 30.0)


@query(r"""
    WITH p AS (SELECT DISTINCT event_id, worker_name, regexp_extract(trim(line_text), '^\[(\d+)/(\d+)\]\s+([0-9.]+)% .* eta=([0-9.]+)s', ['a', 'b', 'c', 'd']) AS m FROM runner_log),
    q AS (SELECT *, floor(m.d::DOUBLE)::BIGINT AS t FROM p WHERE m.a <> '')
    SELECT event_id, '[' || coalesce(worker_name, '?') || '] chunk ' || m.a || '/' || m.b || ' | eta ' || CASE WHEN t >= 3600 THEN (t // 3600) || 'h' || lpad(((t % 3600) // 60)::VARCHAR, 2, '0') || 'm' ELSE (t // 60) || 'm' || lpad((t % 60)::VARCHAR, 2, '0') || 's' END AS shown FROM q""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.progress_lines(table(spark, sf_dir, "runner_log"))


@query(f"SELECT job_id, max_by(phase, (logged_at, event_id)) AS phase FROM (SELECT job_id, logged_at, event_id, {_phase} AS phase FROM runner_log) WHERE phase IS NOT NULL GROUP BY job_id")
def streamed_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last phase of every job by a stream over the log."""
    found = stream.last_phases(stream.events(spark, f"{sf_dir}/runner_log.parquet"))
    return stream.run_to_table(spark, found, "phases", "job_id", "phase_at").select("job_id", "phase")


@query(f"""
    SELECT event_id, job_id, coalesce(last_value({_phase} IGNORE NULLS) OVER w, 'spawn') AS phase, coalesce((epoch_us(logged_at) - lag(epoch_us(logged_at)) OVER w) / 1000000 >
        CASE WHEN coalesce(last_value({_phase} IGNORE NULLS) OVER (PARTITION BY job_id, worker_name ORDER BY logged_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'spawn') SIMILAR TO 'bootstrap.*|warmup' THEN 20 ELSE 35 END, false) AS silent
    FROM (SELECT DISTINCT * FROM runner_log) WINDOW w AS (PARTITION BY job_id, worker_name ORDER BY logged_at, event_id ROWS UNBOUNDED PRECEDING)""")
def streamed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase of every run after each event, and its silences, by a stateful stream over the log."""
    found = stream.watched(stream.events(spark, f"{sf_dir}/runner_log.parquet"), 35.0, 20.0, timer=False)
    return stream.run_appended(spark, found, "runs").where("event_id IS NOT NULL").select("event_id", "job_id", "phase", "silent")


# ---- sources and repair
@query("""
    SELECT DISTINCT lower(regexp_extract(source_path, '(\\.[^./]*)$', 1)) AS suffix, regexp_matches(lower(source_path), '\\.(md|markdown|epub)$') AS supported, count(DISTINCT source_path) AS n_sources FROM sources GROUP BY ALL""".replace("\\\\", "\\"))
def source_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes of all inputs, and whether a reader takes them."""
    suffix = F.lower(F.regexp_extract("source_path", r"(\.[^./]*)$", 1))
    return table(spark, sf_dir, "sources").groupBy(suffix.alias("suffix")).agg(F.count_distinct("source_path").alias("n_sources")).select("suffix", F.col("suffix").isin(*markdown.SUFFIXES, *epub.SUFFIXES).alias("supported"), "n_sources")


@query(f"""
    WITH c AS (SELECT chapter_id, source_id, chapter_index, {s.slug('title')} AS k FROM chapters WHERE title IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id, k ORDER BY chapter_index, chapter_id) AS n FROM c),
    t AS (SELECT job_id, source_id, {s.slug('chapter_title')} AS k, row_number() OVER (PARTITION BY source_id, {s.slug('chapter_title')} ORDER BY job_id) AS n FROM (SELECT DISTINCT job_id, source_path, chapter_title FROM chapter_jobs WHERE chapter_title IS NOT NULL) JOIN (SELECT source_id, source_path FROM sources) USING (source_path))
    SELECT chapter_id, job_id FROM r JOIN t USING (source_id, k, n)""")
def repair_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and jobs of the same source with the same plain title, one to one in order."""
    chapters = table(spark, sf_dir, "chapters").where("title IS NOT NULL").select("chapter_id", "source_id", "chapter_index", text.slug(F.col("title")).alias("k"))
    left = with_rank(chapters, ["source_id", "k"], "chapter_index", "chapter_id", "n")
    known = table(spark, sf_dir, "sources").select("source_id", "source_path")
    made = table(spark, sf_dir, "chapter_jobs").where("chapter_title IS NOT NULL").select("job_id", "source_path", "chapter_title").distinct().join(known, "source_path")
    right = with_rank(made.select("job_id", "source_id", text.slug(F.col("chapter_title")).alias("k")), ["source_id", "k"], "job_id", "job_id", "n")
    return left.join(right, ["source_id", "k", "n"]).select("chapter_id", "job_id")


@query(f"SELECT chapter_id, {s.repair_title('title', text.NUMBERED_SECTIONS, text.FRONT_SECTIONS)} AS title FROM chapters")
def repair_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_id", text.repair_title(F.col("title")).alias("title"))


@query("SELECT r_name || '.epub' AS source_path, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS chapter_index, n_name AS title, n_name || chr(10) || 'About ' || n_name || ' & more' AS text, r_name AS group_path FROM nation JOIN region ON n_regionkey = r_regionkey")
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each region with a page for each nation, written and read again."""
    pages = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = pages.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("pages"))

    return epub.chapters(epub.books(epub.archives(listed.select("r_name", F.transform("pages", lambda p: F.struct(p["n_name"].alias("title"), F.concat(F.lit("About "), p["n_name"], F.lit(" & more")).alias("text"))).alias("pages"))))).withColumn("chapter_index", F.col("chapter_index").cast("long"))
