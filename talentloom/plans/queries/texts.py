"""Filters and text functions, on documents, pages, résumés and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import extract as X
from talentloom.functions import text as T
from talentloom.functions.numeric import bind
from talentloom.operators import metrics
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.registry import joined, joined_sql, query


@query("flt_is_empty", f"""
    SELECT doc_id, length({Q.strip('text')}) < 50 AS is_empty, length(text) AS char_count FROM documents""")
def flt_is_empty(t):
    return t.documents.select("doc_id", T.is_empty_document(F.col("text")).alias("is_empty"), F.length("text").cast("long").alias("char_count"))


@query("flt_has_jd", """
    SELECT application_id, jd_id IS NOT NULL AND regexp_matches(coalesce(j.text, ''), '\\S') AS has_jd
    FROM applications LEFT JOIN (SELECT * FROM jds) AS j USING (jd_id)""")
def flt_has_jd(t):
    real = t.jds.filter(~T.is_blank(F.col("text"))).select("jd_id", F.lit(True).alias("has_jd"))
    return t.applications.join(real, "jd_id", "left").select("application_id", F.coalesce("has_jd", F.lit(False)).alias("has_jd"))


@query("flt_drop_null", "SELECT * FROM jobs WHERE role IS NOT NULL AND features IS NOT NULL AND row_id IS NOT NULL")
def flt_drop_null(t):
    return t.jobs.na.drop()


@query("flt_small_classes", """
    SELECT role, count(*) AS rows FROM jobs WHERE role IS NOT NULL GROUP BY role HAVING count(*) < 30""")
def flt_small_classes(t):
    return metrics.small_classes(t.jobs, "role", rules.MIN_CLASS_ROWS)


@query("flt_drop_rare", """
    SELECT row_id, role FROM jobs WHERE role IS NULL OR role NOT IN (
        SELECT role FROM jobs WHERE role IS NOT NULL GROUP BY role HAVING count(*) < 15)""")
def flt_drop_rare(t):
    return metrics.drop_rare_classes(t.jobs.select("row_id", "role"), "role", 15)


@query("flt_valid_range", """
    WITH spans AS (SELECT o_orderkey, (1960 + o_orderkey % 75)::INT AS s, (1965 + o_custkey % 70)::INT AS e FROM orders)
    SELECT o_orderkey AS id, s AS start_year, e AS end_year FROM spans
    WHERE s BETWEEN 1970 AND 2026 AND e BETWEEN s AND 2027""")
def flt_valid_range(t):
    span = F.struct((F.lit(1960) + F.col("o_orderkey") % 75).cast("int").alias("start"),
                    (F.lit(1965) + F.col("o_custkey") % 70).cast("int").alias("end"))
    kept = t.orders.select("o_orderkey", F.inline(X.valid_ranges(F.array(span), 2026)))
    return kept.select(F.col("o_orderkey").alias("id"), F.col("start").alias("start_year"), F.col("end").alias("end_year"))


def _sections_rows(t):
    return t.resumes.select("resume_id", F.inline(T.split_sections(F.col("text"))))


SECTION_ROWS = f"""
    ln AS (SELECT resume_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM resumes),
    hd AS (SELECT *, lower(regexp_extract(line, {Q.q('(?i)' + rules.SPLIT_HEADING)}, 1)) AS h FROM ln),
    ids AS (SELECT *, sum(CASE WHEN h <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY n) AS sid FROM hd),
    blk AS (SELECT resume_id, sid, coalesce(max(h) FILTER (WHERE h <> ''), 'header') AS section,
                   {Q.strip("string_agg(line, chr(10) ORDER BY n) FILTER (WHERE h = '')")} AS body FROM ids GROUP BY resume_id, sid
            HAVING count(*) FILTER (WHERE h = '') > 0),
    secs AS (SELECT resume_id, section, arg_max(body, sid) AS body, min(sid) AS place FROM blk GROUP BY resume_id, section)"""


@query("txt_section_split", f"WITH {SECTION_ROWS} SELECT resume_id, section, body FROM secs")
def txt_section_split(t):
    return _sections_rows(t)


@query("flt_nonempty_sections", f"WITH {SECTION_ROWS} SELECT resume_id, section FROM secs WHERE regexp_matches(body, '\\S')")
def flt_nonempty_sections(t):
    return _sections_rows(t).filter(~T.is_blank(F.col("body"))).select("resume_id", "section")


@query("win_section_ids", f"""
    WITH {SECTION_ROWS} SELECT resume_id, n::BIGINT AS line_no, sid::BIGINT AS section_no FROM ids""")
def win_section_ids(t):
    heading = "(?iU)" + rules.SPLIT_HEADING
    at = F.filter(F.transform(T.lines(F.col("text")), lambda l, i: F.when(l.rlike(heading), i)), lambda i: i.isNotNull())
    # one text is one row: headings up to a line are counted inside it, no window and no shuffle
    running = bind(at, lambda heads: F.transform(T.lines(F.col("text")), lambda l, i: F.size(F.filter(heads, lambda h: h <= i))))
    return t.resumes.select("resume_id", F.posexplode(running).alias("n", "sid")).select(
        "resume_id", (F.col("n") + 1).cast("long").alias("line_no"), F.col("sid").cast("long").alias("section_no"))


@query("flt_contact_line", f"""
    WITH ln AS (SELECT resume_id, unnest(list_transform(string_split(text, chr(10)), lambda l: {Q.strip('l')})) AS line FROM resumes)
    SELECT resume_id, line, count(*) AS times FROM ln WHERE line <> '' AND NOT (regexp_matches(line, '[@:|0-9]|http|www\\.')
      OR len(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda w: list_contains({Q.lit_list(rules.NOT_A_NAME)}, w))) > 0)
    GROUP BY resume_id, line""")
def flt_contact_line(t):
    rows = t.resumes.select("resume_id", F.explode(F.transform(T.lines(F.col("text")), T.strip)).alias("line"))
    kept = rows.filter((F.col("line") != "") & ~X.is_contact_line(F.col("line")))
    return kept.groupBy("resume_id", "line").agg(F.count("*").alias("times"))


# --- text functions -------------------------------------------------------------------------------

def clean_sql(x: str, trailing: bool = False, bounded: bool = False) -> str:
    tail = "\\s" if trailing else "\\s?"
    for p in [f"http\\S+{tail}", "\\b(?:RT|cc)\\b" if bounded else "RT|cc", f"#\\S+{tail}", "@\\S+", rules.PUNCTUATION, "[^\\x00-\\x7f]"]:
        x = f"regexp_replace({x}, {Q.q(p)}, ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return x if trailing else f"trim({x}, ' ')"


@query("txt_clean", f"""
    SELECT 'page' AS kind, page_id AS id, md5({clean_sql('html')}) AS cleaned, length({clean_sql('html')}) AS chars FROM pages
    UNION ALL SELECT 'resume', resume_id, md5({clean_sql('text')}), length({clean_sql('text')}) FROM resumes""")
def txt_clean(t):
    cleaned = T.clean(F.col("text"))
    both = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")).unionByName(
        t.resumes.select(F.lit("resume").alias("kind"), F.col("resume_id").alias("id"), "text"))
    return both.select("kind", "id", cleaned.alias("c")).select("kind", "id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("chars"))


@query("txt_clean_nb", f"SELECT page_id, md5({clean_sql('html', trailing=True)}) AS cleaned FROM pages")
def txt_clean_nb(t):
    return t.pages.select("page_id", F.md5(T.clean_trailing(F.col("html"))).alias("cleaned"))


@query("txt_sanitize_latin1", f"""
    SELECT 'd' AS kind, doc_id AS id, md5({Q.latin1('text')}) AS plain FROM documents
    UNION ALL SELECT 'r', resume_id, md5({Q.latin1('text')}) FROM resumes""")
def txt_sanitize_latin1(t):
    both = t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        t.resumes.select(F.lit("r").alias("kind"), F.col("resume_id").alias("id"), "text"))
    return both.select("kind", "id", F.md5(T.to_latin1(F.col("text"))).alias("plain"))


@query("txt_keywords", f"""
    SELECT doc_id, len(k)::BIGINT AS keywords, md5(array_to_string(list_sort(k), ' ')) AS digest
    FROM (SELECT doc_id, {Q.keywords('text')} AS k FROM documents)""")
def txt_keywords(t):
    k = t.documents.select("doc_id", T.keywords(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("keywords"), F.md5(F.array_join(F.sort_array("k"), " ")).alias("digest"))


@query("txt_display_case", f"""
    SELECT row_id, {Q.display('role')} AS shown_role, {Q.display('features')} AS shown FROM jobs""")
def txt_display_case(t):
    return t.jobs.select("row_id", T.display_case(F.col("role")).alias("shown_role"), T.display_case(F.col("features")).alias("shown"))


@query("txt_capitalize_words", """
    SELECT row_id, array_to_string(list_transform(regexp_split_to_array(features, '\\s+'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown FROM jobs""")
def txt_capitalize_words(t):
    return t.jobs.select("row_id", T.capitalize_words(F.col("features")).alias("shown"))


@query("txt_truncate", """
    SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS snippet,
           md5(text[1:500]) AS first_500, md5(text[1:4000]) AS first_4000 FROM documents""")
def txt_truncate(t):
    return t.documents.select("doc_id", T.snippet(F.col("text")).alias("snippet"), F.md5(F.substring("text", 1, 500)).alias("first_500"),
                              F.md5(F.substring("text", 1, 4000)).alias("first_4000"))


_N = Q.format_counts("text")


@query("txt_count_pattern", " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, {key} AS id, ({_N['unusual']})::BIGINT AS unusual, ({_N['pipes']})::BIGINT AS pipes, ({_N['capitals']})::BIGINT AS capitals,
        ({_N['paragraphs']})::BIGINT AS paragraphs, ({_N['blank_runs']})::BIGINT AS blank_runs FROM {table}"""
    for kind, key, table in (("d", "doc_id", "documents"), ("r", "resume_id", "resumes"))))
def txt_count_pattern(t):
    from talentloom.functions.score import format_counts
    both = t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        t.resumes.select(F.lit("r").alias("kind"), F.col("resume_id").alias("id"), "text"))
    n = both.select("kind", "id", format_counts(F.col("text")).alias("n"))
    return n.select("kind", "id", *[F.col(f"n.{k}").cast("long").alias(k) for k in ("unusual", "pipes", "capitals", "paragraphs", "blank_runs")])


@query("txt_bullets", f"""
    SELECT resume_id, {Q.nonblank_lines('text')} AS total, {Q.bullet_lines('text')} AS bullets FROM resumes""")
def txt_bullets(t):
    n = t.resumes.select("resume_id", T.line_counts(F.col("text")).alias("n"))
    return n.select("resume_id", F.col("n.total").cast("long").alias("total"), F.col("n.bullets").cast("long").alias("bullets"))


# --- set functions on lists -------------------------------------------------------------------------

@query("set_intersect", f"""
    SELECT doc_id, {joined_sql('list_sort(list_filter(' + Q.lit_list(rules.ACTION_VERBS + rules.STOPWORDS) + ', lambda v: list_contains(w, v)))')} AS shared
    FROM (SELECT doc_id, {Q.words('text')} AS w FROM documents)""")
def set_intersect(t):
    listed = F.array(*[F.lit(v) for v in rules.ACTION_VERBS + rules.STOPWORDS])
    return t.documents.select("doc_id", joined(F.sort_array(F.array_intersect(listed, T.long_words(F.col("text"))))).alias("shared"))


@query("set_except", f"""
    SELECT resume_id, {joined_sql('list_sort(list_filter(' + Q.lit_list(rules.EXPECTED_SECTIONS) + ', lambda e: NOT list_contains(s, e)))')} AS absent
    FROM (SELECT resume_id, {Q.sections('text')} AS s FROM resumes)""")
def set_except(t):
    expected = F.array(*[F.lit(v) for v in rules.EXPECTED_SECTIONS])
    return t.resumes.select("resume_id", joined(F.sort_array(F.array_except(expected, X.sections(F.col("text"))))).alias("absent"))


@query("set_add_synonyms", f"""
    SELECT resume_id, {joined_sql("list_sort(list_distinct(CASE WHEN list_contains(s, 'summary') OR list_contains(s, 'objective') THEN list_concat(s, ['summary', 'objective']) ELSE s END))")} AS found
    FROM (SELECT resume_id, {Q.sections('text')} AS s FROM resumes)""")
def set_add_synonyms(t):
    from talentloom.functions.score import with_synonyms
    s = t.resumes.select("resume_id", X.sections(F.col("text")).alias("s"))
    return s.select("resume_id", joined(F.sort_array(with_synonyms(F.col("s")))).alias("found"))
