"""Facts from résumé texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import extract as X
from talentloom.operators import skills as K
from talentloom.plans import match as M
from talentloom.plans.inputs import AS_OF_YEAR
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.registry import joined, joined_sql, query


def _one(name, value, check):
    """A query that shows ``value(text)`` of every résumé."""
    query(name, f"SELECT resume_id, {check} AS found FROM resumes")(lambda t: t.resumes.select("resume_id", value(F.col("text")).alias("found")))


@query("ext_email", f"""
    SELECT 'r' AS kind, resume_id AS id, {Q.email('text')} AS found FROM resumes
    UNION ALL SELECT 'd', doc_id, {Q.email('text')} FROM documents""")
def ext_email(t):
    return t.resumes.select(F.lit("r").alias("kind"), F.col("resume_id").alias("id"), X.email(F.col("text")).alias("found")).unionByName(
        t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), X.email(F.col("text")).alias("found")))


@query("ext_phone", f"""
    SELECT 'r' AS kind, resume_id AS id, {Q.phone('text')} AS found FROM resumes
    UNION ALL SELECT 'd', doc_id, {Q.phone('text')} FROM documents""")
def ext_phone(t):
    return t.resumes.select(F.lit("r").alias("kind"), F.col("resume_id").alias("id"), X.phone(F.col("text")).alias("found")).unionByName(
        t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), X.phone(F.col("text")).alias("found")))


_one("ext_phone_us", lambda c: X.phone_us(c), f"nullif(regexp_extract(text, {Q.q(rules.PHONE_US)}), '')")
_one("ext_name", lambda c: X.name(c), Q.name("text"))
_one("ext_name_bigram", lambda c: X.name_bigram(c), f"nullif(regexp_extract(text, {Q.q(rules.NAME_BIGRAM)}), '')")
_one("ext_sections", lambda c: joined(X.sections(c)), joined_sql(Q.sections("text")))
_one("ext_degrees", lambda c: joined(X.degrees(c)), joined_sql(Q.degrees("text")))
_one("ext_fields", lambda c: joined(X.study_fields(c)), joined_sql(Q.fields("text")))
_one("ext_institutions", lambda c: joined(X.institutions(c)), joined_sql(Q.institutions("text")))
_one("ext_titles", lambda c: joined(X.job_titles(c)), joined_sql(Q.titles("text")))
_one("ext_highest_degree", lambda c: X.highest_degree(X.education(c)).cast("long"),
     f"({Q.degree_level('array_to_string(' + Q.education('text') + ', chr(10))')})::BIGINT")


@query("ext_contact", f"SELECT resume_id, {Q.name('text')} AS name, {Q.email('text')} AS email, {Q.phone('text')} AS phone FROM resumes")
def ext_contact(t):
    return t.resumes.select("resume_id", X.contact(F.col("text")).alias("c")).select("resume_id", "c.name", "c.email", "c.phone")


# Whole-word lists: every name and spelling of the taxonomy, and the study fields with a few more.
SKILL_LIST = ["Python", "SQL", "Machine Learning", "Java", "C++", "Node.js", "Power BI", "Tableau", "git", "Docker", "SQL", "Linux",
              "Communication", "natural language\nprocessing", "C#", "Go", "excel", "steady work"]
KEYWORD_LIST = rules.STUDY_FIELDS + ["Science", "Education", "information technology", "Design", "Project Management"]


def _escape(s: str) -> str:
    return "".join(ch if ch.isalnum() or ch.isspace() else "\\" + ch for ch in s)


def _lit(s: str) -> str:
    return "(" + " || chr(10) || ".join(Q.q(p) for p in s.split("\n")) + ")"


_one("ext_skills_list", lambda c: joined(X.listed_skills(c, SKILL_LIST)), joined_sql("list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {_lit('(?i)' + chr(92) + 'b' + _escape(s) + chr(92) + 'b')}) THEN {_lit(s)} END" for s in SKILL_LIST) + "], lambda s: s IS NOT NULL)"))
_one("ext_education_kw", lambda c: joined(X.listed_keywords(c, KEYWORD_LIST)), joined_sql("list_filter([" + ", ".join(
    f"nullif(regexp_extract(text, {Q.q('(?i)' + chr(92) + 'b' + _escape(k) + chr(92) + 'b')}), '')" for k in KEYWORD_LIST) + "], lambda s: s IS NOT NULL)"))

SECTION = Q.experience_section_ctes("resumes", "resume_id")


@query("ext_experience_section", f"WITH {SECTION} SELECT r.resume_id, section FROM (SELECT resume_id FROM resumes) AS r LEFT JOIN es USING (resume_id)")
def ext_experience_section(t):
    return t.resumes.select("resume_id", X.experience_section(F.col("text")).alias("section"))


@query("win_first_span", f"""
    WITH {SECTION} SELECT s.resume_id, first_h::BIGINT AS first_line, stop::BIGINT AS stop_line FROM es_start s LEFT JOIN es_stop USING (resume_id)""")
def win_first_span(t):
    def first(rows, pattern, after):
        return F.array_min(F.transform(rows, lambda l, i: F.when(l.rlike(X.ANY_CASE + pattern) & (i + 1 > after), i + 1)))
    rows = t.resumes.select("resume_id", F.split("text", "\n").alias("rows"))
    start = rows.withColumn("first_line", first(F.col("rows"), rules.EXPERIENCE_HEADING, F.lit(0)).cast("long")).filter("first_line IS NOT NULL")
    return start.select("resume_id", "first_line", first(F.col("rows"), rules.OTHER_HEADING, F.col("first_line")).cast("long").alias("stop_line"))


YEARS = f"coalesce({Q.years_max('coalesce(section, text)')}, CASE WHEN section IS NULL THEN 0 ELSE {Q.years_sum('section')} END)"


@query("ext_years", f"WITH {SECTION} SELECT r.resume_id, {YEARS} AS years FROM (SELECT * FROM resumes) AS r LEFT JOIN es USING (resume_id)")
def ext_years(t):
    return t.resumes.select("resume_id", X.experience_years(F.col("text"), AS_OF_YEAR).alias("years"))


_one("agg_years_max", lambda c: X.years_max(c), Q.years_max("text"))
_one("agg_years_sum", lambda c: X.years_sum(c, AS_OF_YEAR), Q.years_sum("text"))


@query("ext_jd_years", f"SELECT jd_id, {Q.jd_years('text')} AS years FROM jds")
def ext_jd_years(t):
    return t.jds.select("jd_id", X.jd_years(F.col("text")).alias("years"))


@query("ext_skills", f"""
    WITH {Q.forms_ctes()}, {Q.skills_ctes('resumes', 'resume_id', 'rs')}
    SELECT r.resume_id, coalesce(found, '') AS found FROM (SELECT resume_id FROM resumes) AS r LEFT JOIN (
        SELECT resume_id, string_agg(skill, '; ' ORDER BY skill) AS found FROM rs GROUP BY resume_id) USING (resume_id)""")
def ext_skills(t):
    return t.skill_rules.attach(t.resumes.select("resume_id"), t.resumes, "resume_id", "text").select("resume_id", joined(F.col("skills")).alias("found"))


@query("join_taxonomy_phrases", f"""
    WITH {Q.forms_ctes()}, {Q.skills_ctes('resumes', 'resume_id', 'rs')}, {Q.skills_ctes('jds', 'jd_id', 'js')}
    SELECT 'resume' AS kind, resume_id AS id, skill FROM rs UNION ALL SELECT 'jd', jd_id, skill FROM js""")
def join_taxonomy_phrases(t):
    forms = K.taxonomy_forms(t.taxonomy_entries, "entry")
    texts = t.resumes.select(F.lit("resume").alias("kind"), F.col("resume_id").alias("id"), "text").unionByName(
        t.jds.select(F.lit("jd").alias("kind"), F.col("jd_id").alias("id"), "text"))
    said = texts.withColumn("key", F.struct("kind", "id"))
    return K.phrase_hits(said, "key", "text", forms).select("key.kind", "key.id", F.col("canonical").alias("skill"))


@query("ext_all", f"""
    WITH {SECTION}, {Q.forms_ctes()}, {Q.skills_ctes('resumes', 'resume_id', 'rs')}
    SELECT r.resume_id, {Q.name('text')} AS name, {Q.email('text')} AS email, {Q.phone('text')} AS phone,
           coalesce(found, '') AS skills, {joined_sql(Q.education('text'))} AS education, {YEARS} AS years,
           {joined_sql(Q.titles('text'))} AS titles, {joined_sql(Q.sections('text'))} AS sections
    FROM (SELECT * FROM resumes) AS r LEFT JOIN es USING (resume_id) LEFT JOIN (
        SELECT resume_id, string_agg(skill, '; ' ORDER BY skill) AS found FROM rs GROUP BY resume_id) USING (resume_id)""")
def ext_all(t):
    f = M.facts(t.resumes, "resume_id", "text", t.skill_rules, AS_OF_YEAR)
    return f.select("resume_id", "contact.name", "contact.email", "contact.phone", joined(F.col("skills")).alias("skills"),
                    joined(F.col("education")).alias("education"), "years", joined(F.col("titles")).alias("titles"),
                    joined(F.col("sections")).alias("sections"))
