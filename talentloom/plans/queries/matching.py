"""Pairs of résumés and openings: joins, scores, gaps, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import extract as X
from talentloom.functions import score as S
from talentloom.functions import text as T
from talentloom.functions.numeric import round1
from talentloom.operators import gap as G
from talentloom.operators import skills as K
from talentloom.operators.joins import skew_join
from talentloom.plans import match as M
from talentloom.plans import report as R
from talentloom.plans.inputs import AS_OF_YEAR
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.extraction import SECTION, YEARS
from talentloom.plans.queries.registry import joined, joined_sql, query
from talentloom.session import stored

# --- check side: everything about a pair, as common table expressions ------------------------------------

_VERBS = Q.overlap_count(Q.lit_list(rules.ACTION_VERBS), "kw")
SKILL_CTES = f"""
    {Q.forms_ctes()}, {Q.skills_ctes('resumes', 'resume_id', 'rs')}, {Q.skills_ctes('jds', 'jd_id', 'js')},
    {Q.keyed_ctes('rs', 'resume_id', 'rk')}, {Q.keyed_ctes('js', 'jd_id', 'jk')}"""
PAIR_CTES = f"""
    jreal AS (SELECT * FROM jds WHERE regexp_matches(text, '\\S')),
    pairs AS (SELECT application_id, resume_id, a.jd_id AS jd_id, j.jd_id IS NOT NULL AS has_jd, j.jd_id AS real_jd
              FROM applications a LEFT JOIN jreal j ON a.jd_id = j.jd_id)"""
OVERLAP_CTES = f"""
    {SKILL_CTES}, {PAIR_CTES},
    hit AS (SELECT application_id, list_sort(list({Q.display('rk.shown')})) AS matched, count(*) AS n FROM pairs JOIN jk ON real_jd = jk.jd_id
            JOIN rk ON rk.resume_id = pairs.resume_id AND rk.k = jk.k GROUP BY application_id),
    mis AS (SELECT application_id, list_sort(list({Q.display('jk.shown')})) AS missing FROM pairs JOIN jk ON real_jd = jk.jd_id
            LEFT JOIN rk ON rk.resume_id = pairs.resume_id AND rk.k = jk.k WHERE rk.k IS NULL GROUP BY application_id),
    ext AS (SELECT application_id, list_sort(list({Q.display('rk.shown')})) AS extra FROM pairs JOIN rk ON rk.resume_id = pairs.resume_id
            LEFT JOIN jk ON jk.jd_id = real_jd AND jk.k = rk.k WHERE has_jd AND jk.k IS NULL GROUP BY application_id),
    alone AS (SELECT resume_id, list_sort(list_distinct(list({Q.display('skill')}))) AS extra FROM rs GROUP BY resume_id),
    jn AS (SELECT jd_id, count(*) AS n FROM jk GROUP BY jd_id),
    ov AS (SELECT p.application_id, coalesce(matched, []) AS matched, coalesce(missing, []) AS missing,
                  coalesce(CASE WHEN has_jd THEN ext.extra ELSE alone.extra END, []) AS extra,
                  {Q.round1('coalesce(hit.n, 0)::DOUBLE / greatest(coalesce(jn.n, 0), 1)::DOUBLE * 100')} AS skill_pct
           FROM pairs p LEFT JOIN hit USING (application_id) LEFT JOIN mis USING (application_id) LEFT JOIN ext USING (application_id)
           LEFT JOIN alone ON alone.resume_id = p.resume_id LEFT JOIN jn ON jn.jd_id = p.real_jd)"""
WORD_CTES = f"""
    jw AS (SELECT jd_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT jd_id, {Q.words('text')} AS w FROM jds)),
    jf0 AS (SELECT jd_id, word, count(*) AS freq, min(pos) - 1 AS first_pos FROM jw GROUP BY jd_id, word)"""
MISSING_CTES = f"""
    {WORD_CTES},
    mk AS (SELECT application_id, list(word ORDER BY freq DESC, first_pos) AS words FROM (
        SELECT application_id, word, freq, first_pos, row_number() OVER (PARTITION BY application_id ORDER BY freq DESC, first_pos) AS rn
        FROM pairs JOIN jf0 ON jf0.jd_id = real_jd JOIN resumes r ON r.resume_id = pairs.resume_id
        WHERE freq >= 2 AND NOT contains(lower(r.text), word)) WHERE rn <= 15 GROUP BY application_id)"""
FACT_CTES = f"""
    {SECTION},
    rf0 AS (SELECT r.resume_id, text, {Q.sections('text')} AS secs, {Q.keywords('text')} AS kw, {Q.name('text')} AS name, {Q.email('text')} AS email,
                   {Q.phone('text')} AS phone, {Q.education('text')} AS education, {Q.titles('text')} AS titles, {YEARS} AS years,
                   {Q.nonblank_lines('text')} AS total_lines, {Q.bullet_lines('text')} AS bullets, {Q.count_re('lower(text)', rules.NUMBERS)} AS numbers
            FROM (SELECT * FROM resumes) AS r LEFT JOIN es USING (resume_id)),
    rf1 AS (SELECT *, {Q.missing_sections('secs')} AS missing_secs, {_VERBS} AS verbs, regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AS has_words,
                   {Q.degree_level("array_to_string(education, chr(10))")} AS level,
                   (name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT AS contacts FROM rf0),
    rf AS (SELECT *, (6 - len(missing_secs))::DOUBLE / 6 * 100 AS s_sec, {Q.length_score('text')} AS s_len, {Q.bullet_score('total_lines', 'bullets')} AS s_bul,
                  CASE WHEN NOT has_words THEN 0 ELSE {Q.round1('least(verbs::DOUBLE / 8, 1) * 100 * 0.5::DOUBLE + least(least(numbers, 15)::DOUBLE / 5, 1) * 100 * 0.3::DOUBLE + least(len(kw)::DOUBLE / 40, 1) * 100 * 0.2::DOUBLE')} END AS rich,
                  {Q.round1('contacts::DOUBLE / 3 * 100')} AS s_con, {Q.formatting_score('text')} AS s_fmt FROM rf1)"""
JD_CTES = f"""
    jf AS (SELECT jd_id, {Q.keywords('text')} AS kw, {Q.jd_years('text')} AS jy, {Q.degree_level('text')} AS jl FROM jds)"""
DENSITY = "CASE WHEN len(jf.kw) = 0 THEN 50.0::DOUBLE ELSE " + Q.overlap_count("jf.kw", "rf.kw") + "::DOUBLE / len(jf.kw)::DOUBLE * 100 END"
SEMANTIC_CTES = f"""
    rdoc AS (SELECT resume_id AS id, text FROM resumes), jdoc AS (SELECT jd_id AS id, text FROM jds),
    {Q.tfidf_ctes('rdoc', 'id', 'tr')}, {Q.tfidf_ctes('jdoc', 'id', 'tj', corpus='rdoc')},
    sem AS (SELECT application_id, sum(tr.w * tj.w) AS cosine FROM pairs JOIN tj ON tj.id = real_jd JOIN tr ON tr.id = pairs.resume_id AND tr.term = tj.term
            GROUP BY application_id)"""
_SEM = "round(least(greatest(coalesce(cosine, 0), 0), 1) * 100, 2)"
_EXP = """CASE WHEN NOT has_jd THEN CASE WHEN years > 0 THEN 75 ELSE 40 END WHEN jy IS NULL THEN 50 WHEN years >= jy THEN 100
          WHEN years >= jy * 0.7::DOUBLE THEN 75 WHEN years >= jy * 0.5::DOUBLE THEN 50 ELSE 25 END::DOUBLE"""
_EDU = """CASE WHEN NOT has_jd THEN CASE WHEN level >= 3 THEN 80 WHEN level >= 1 THEN 55 ELSE 35 END WHEN jl = 0 THEN 50
          WHEN level >= jl THEN 100 WHEN level >= jl - 1 THEN 70 ELSE 30 END::DOUBLE"""
_W1 = ["0.20", "0.15", "0.15", "0.25", "0.10", "0.15"]
_W2 = ["0.25", "0.15", "0.15", "0.15", "0.15", "0.15"]
_PARTS = ["s_sec", "s_len", "s_bul", "kw_score", "s_con", "s_fmt"]
_ATS = ("CASE WHEN has_jd THEN " + " + ".join(f"{p} * {w}::DOUBLE" for p, w in zip(_PARTS, _W1))
        + " ELSE " + " + ".join(f"{p} * {w}::DOUBLE" for p, w in zip(_PARTS, _W2)) + " END")
_N = Q.format_counts("text")
FEEDBACK = "list_concat(" + ", ".join([
    Q.messages(("len(missing_secs) > 0", Q.fb("sections", "array_to_string(missing_secs, ', ')"))),
    Q.messages(("length(text) < 200", Q.fb("very_short", "length(text)")), ("length(text) BETWEEN 200 AND 399", Q.fb("short", "length(text)")),
               ("length(text) BETWEEN 4001 AND 8000", Q.fb("long", "length(text)")), ("length(text) > 8000", Q.fb("very_long", "length(text)"))),
    Q.messages(("s_bul = 0", Q.fb("no_lines")), ("s_bul = 30", Q.fb("few_bullets")), ("s_bul = 60", Q.fb("some_bullets")), ("s_bul = 70", Q.fb("all_bullets"))),
    Q.messages(("has_jd AND kw_score < 30", Q.fb("low_density", "round_even(kw_score, 0)::INT")), ("NOT has_jd AND NOT has_words", Q.fb("no_words")),
               ("NOT has_jd AND has_words AND verbs < 3", Q.fb("few_verbs", "verbs")), ("NOT has_jd AND has_words AND numbers < 2", Q.fb("few_numbers"))),
    Q.messages(("name IS NULL", Q.fb("no_name")), ("email IS NULL", Q.fb("no_email")), ("phone IS NULL", Q.fb("no_phone"))),
    Q.messages((f"{_N['unusual']} > 5", Q.fb("unusual", _N["unusual"])), (f"{_N['pipes']} > 10", Q.fb("pipes")), (f"{_N['capitals']} > 10", Q.fb("capitals")),
               (f"{_N['paragraphs']} > 2", Q.fb("paragraphs")), (f"{_N['blank_runs']} > 2", Q.fb("blank_runs"))),
]) + ")"
MATCH_CTES = f"""
    {OVERLAP_CTES}, {FACT_CTES}, {JD_CTES}, {MISSING_CTES}, {SEMANTIC_CTES},
    sc0 AS (SELECT p.application_id, p.resume_id, p.jd_id, has_jd, rf.* EXCLUDE (resume_id, kw), jy, jl, CASE WHEN has_jd THEN {_SEM} ELSE 0 END AS semantic,
                   CASE WHEN has_jd THEN {DENSITY} ELSE rich END AS kw_score, CASE WHEN has_jd THEN skill_pct ELSE 0 END AS skill_pct,
                   matched, missing, extra, coalesce(mk.words, []) AS missing_keywords
            FROM pairs p JOIN rf ON rf.resume_id = p.resume_id LEFT JOIN jf ON jf.jd_id = p.real_jd LEFT JOIN ov ON ov.application_id = p.application_id
            LEFT JOIN mk ON mk.application_id = p.application_id LEFT JOIN sem ON sem.application_id = p.application_id),
    sc1 AS (SELECT *, {_EXP} AS experience_match, {_EDU} AS education_match, {Q.round1(_ATS)} AS ats_total, {FEEDBACK} AS feedback FROM sc0),
    sc AS (SELECT *, CASE WHEN has_jd THEN {Q.round1("semantic * 0.40::DOUBLE + skill_pct * 0.30::DOUBLE + experience_match * 0.15::DOUBLE + education_match * 0.15::DOUBLE")}
                     ELSE ats_total END AS overall FROM sc1)"""


def matches(t, missing_words=False, applications=None, resumes=None):
    applications = stored(t.applications, "applications") if applications is None else applications
    resumes = stored(t.resumes.select("resume_id", "text"), "resumes") if resumes is None else resumes  # their texts are read up to four times
    return M.match(applications, resumes, t.jds, t.skill_rules, AS_OF_YEAR, missing_words=missing_words)


# --- whole scores ------------------------------------------------------------------------------------------

@query("sc_overall", f"""
    WITH {MATCH_CTES} SELECT application_id, resume_id, jd_id, has_jd, overall, {Q.round1('semantic')} AS semantic, skill_pct, experience_match, education_match, ats_total FROM sc""")
def sc_overall(t):
    return matches(t).select("application_id", "resume_id", "jd_id", "has_jd", "overall", "semantic", "skill_pct", "experience_match", "education_match", "ats_total")


@query("join_pairs", f"""
    WITH {MATCH_CTES} SELECT application_id, overall, ats_total, len(matched)::BIGINT AS matched, len(missing)::BIGINT AS missing, len(extra)::BIGINT AS extra,
           len(missing_keywords)::BIGINT AS missing_keywords, len(feedback)::BIGINT AS messages FROM sc""")
def join_pairs(t):
    m = matches(t, missing_words=True)
    return m.select("application_id", "overall", "ats_total", *[F.size(c).cast("long").alias(n) for c, n in (
        ("matched", "matched"), ("missing", "missing"), ("extra", "extra"), ("missing_keywords", "missing_keywords"), ("feedback", "messages"))])


@query("sc_gap", f"""
    WITH {MATCH_CTES} SELECT application_id, {joined_sql('matched')} AS matched, {joined_sql('missing')} AS missing, {joined_sql('extra')} AS extra,
           {joined_sql('missing_keywords')} AS missing_keywords, skill_pct FROM sc""")
def sc_gap(t):
    return matches(t, missing_words=True).select("application_id", *[joined(F.col(c)).alias(c) for c in ("matched", "missing", "extra", "missing_keywords")], "skill_pct")


@query("sc_ats", f"""
    WITH {MATCH_CTES} SELECT application_id, ats_total, {Q.round1('s_sec')} AS section_score, s_len AS length_score, s_bul AS bullet_score,
           {Q.round1('kw_score')} AS keyword_score, s_con AS contact_score, s_fmt AS formatting_score, {joined_sql('missing_secs')} AS missing_sections FROM sc""")
def sc_ats(t):
    return matches(t).select("application_id", "ats_total", "section_score", "length_score", "bullet_score", "keyword_score", "contact_score",
                             "formatting_score", joined(F.col("missing_sections")).alias("missing_sections"))


@query("sc_feedback", f"WITH {MATCH_CTES} SELECT application_id, {joined_sql('feedback')} AS feedback FROM sc")
def sc_feedback(t):
    return matches(t).select("application_id", joined(F.col("feedback")).alias("feedback"))


@query("sc_feedback_severity", f"""
    WITH {MATCH_CTES}, m AS (SELECT unnest(feedback) AS msg FROM sc)
    SELECT CASE WHEN regexp_matches(lower(msg), 'missing|very|excessive') THEN 'warning' ELSE 'info' END AS severity, count(*) AS messages FROM m GROUP BY 1""")
def sc_feedback_severity(t):
    m = matches(t).select(F.explode("feedback").alias("msg"))
    return m.groupBy(S.severity(F.col("msg")).alias("severity")).agg(F.count("*").alias("messages"))


@query("sc_band", f"""
    WITH {MATCH_CTES} SELECT {Q.band('overall')} AS band, CASE WHEN overall >= 75 THEN 'high' WHEN overall >= 50 THEN 'medium' ELSE 'low' END AS band3, count(*) AS rows
    FROM sc GROUP BY 1, 2""")
def sc_band(t):
    return matches(t).groupBy(S.band(F.col("overall")).alias("band"), S.band3(F.col("overall")).alias("band3")).agg(F.count("*").alias("rows"))


@query("agg_skill_counts", f"""
    WITH {OVERLAP_CTES}, n AS (SELECT len(matched) AS a, len(missing) AS b, len(extra) AS c FROM ov JOIN pairs USING (application_id) WHERE has_jd)
    SELECT 'matched' AS kind, sum(a)::BIGINT AS skills FROM n UNION ALL SELECT 'missing', sum(b)::BIGINT FROM n UNION ALL SELECT 'extra', sum(c)::BIGINT FROM n""")
def agg_skill_counts(t):
    o = _overlaps(t)
    kinds = ("matched", "missing", "extra")
    sizes = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.col(f"gap.{k}")).cast("long").alias("n")) for k in kinds])
    return o.select(F.inline(sizes)).groupBy("kind").agg(F.sum("n").alias("skills"))


@query("agg_skill_summary", f"""
    WITH {Q.forms_ctes()}, {Q.skills_ctes('resumes', 'resume_id', 'rs')}, names AS (SELECT DISTINCT canonical AS skill, category FROM forms)
    SELECT category, skill, grouping_id(category, skill)::BIGINT AS level, count(*) AS resumes FROM rs JOIN names USING (skill) GROUP BY GROUPING SETS ((category, skill), (category), ())""")
def agg_skill_summary(t):
    """How many résumés name each skill, the skills of each category, any skill: three levels in one aggregation."""
    forms = K.taxonomy_forms(t.taxonomy_entries, "entry")
    hits = K.phrase_hits(t.resumes, "resume_id", "text", forms)
    named = hits.join(forms.select("canonical", "category").distinct(), "canonical").withColumnRenamed("canonical", "skill")
    return named.groupingSets([["category", "skill"], ["category"], []], "category", "skill").agg(F.grouping_id().alias("level"), F.count("*").alias("resumes"))


# --- parts of a pair ---------------------------------------------------------------------------------------

def _skill_keys(t, table, key, blank=True):
    texts = getattr(t, table).select(key, "text")
    texts = texts if blank else texts.filter(~T.is_blank(F.col("text")))
    return t.skill_rules.attach(texts.select(key), texts, key, "text").select(key, "skill_keys")


def _overlaps(t):
    """Applications with an opening and their skill overlap; only key lists travel."""
    openings = _skill_keys(t, "jds", "jd_id", blank=False).withColumnRenamed("skill_keys", "jd_keys")
    pairs = skew_join(t.applications, openings, "jd_id", "application_id", "inner")
    both = skew_join(pairs, _skill_keys(t, "resumes", "resume_id"), "resume_id", "application_id", "inner", count_on=t.applications)
    return both.select("application_id", K.skill_overlap(F.col("skill_keys"), F.col("jd_keys")).alias("gap"))


@query("join_skill_overlap", f"""
    WITH {OVERLAP_CTES} SELECT application_id, {joined_sql('matched')} AS matched, {joined_sql('missing')} AS missing, {joined_sql('extra')} AS extra, skill_pct
    FROM ov JOIN pairs USING (application_id) WHERE has_jd""")
def join_skill_overlap(t):
    return _overlaps(t).select("application_id", *[joined(F.col(f"gap.{c}")).alias(c) for c in ("matched", "missing", "extra")],
                               F.col("gap.overlap_pct").alias("skill_pct"))


@query("join_alias_normalize", f"""
    WITH {SKILL_CTES}, spelled AS (SELECT resume_id AS id, trim(unnest(regexp_split_to_array(text, '[,;/\\n]'))) AS skill FROM resumes)
    SELECT id, skill, coalesce(canonical, lower(skill)) AS skill_key, count(*) AS times FROM spelled LEFT JOIN am ON am.alias = lower(skill) WHERE skill <> ''
    GROUP BY ALL""")
def join_alias_normalize(t):
    return _normalized(t, K.alias_table(t.spark, t.taxonomy_entries, "entry"))


def _normalized(t, aliases):
    spelled = t.resumes.select(F.col("resume_id").alias("id"), F.explode(F.split("text", r"[,;/\n]")).alias("skill")).withColumn("skill", F.trim("skill"))
    keyed = K.normalize_rows(spelled.filter("skill <> ''"), "skill", aliases, "id")
    return keyed.groupBy("id", "skill", "skill_key").agg(F.count("*").alias("times"))


@query("join_alias_closure", f"""
    WITH RECURSIVE links AS (SELECT alias, target FROM (
            SELECT a AS alias, c AS target, 1 AS p, 0 AS e FROM (VALUES {", ".join(f"({Q.q(k)}, {Q.q(v)})" for k, v in rules.SKILL_ALIASES.items())}) AS b(a, c)
            UNION ALL SELECT lower(trim(raw)), lower(trim(name)), 2, entry FROM taxonomy WHERE pos > 0)
        WHERE alias <> target QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p, e) = 1),
    walk AS (SELECT alias, target, 1 AS depth FROM links UNION ALL
             SELECT w.alias, l.target, depth + 1 FROM walk w JOIN links l ON l.alias = w.target WHERE depth <= (SELECT count(*) FROM links)),
    ends AS (SELECT alias, arg_max(target, depth) AS canonical FROM walk GROUP BY alias),
    spelled AS (SELECT resume_id AS id, trim(unnest(regexp_split_to_array(text, '[,;/\\n]'))) AS skill FROM resumes)
    SELECT id, skill, coalesce(canonical, lower(skill)) AS skill_key, count(*) AS times FROM spelled LEFT JOIN ends ON ends.alias = lower(skill) WHERE skill <> ''
    GROUP BY ALL""")
def join_alias_closure(t):
    """As join_alias_normalize, along whole chains of aliases."""
    return _normalized(t, K.alias_closure(K.alias_links(t.spark, t.taxonomy_entries, "entry")))


def _keyword_pairs(t):
    openings = t.jds.filter(~T.is_blank(F.col("text"))).select("jd_id", T.keywords(F.col("text")).alias("jd_keywords"))
    pairs = skew_join(t.applications, openings, "jd_id", "application_id", "inner")
    people = t.resumes.select("resume_id", T.keywords(F.col("text")).alias("keywords"))
    return skew_join(pairs, people, "resume_id", "application_id", "inner", count_on=t.applications)


KW_CTES = f"""{PAIR_CTES}, rw AS (SELECT resume_id, {Q.keywords('text')} AS kw FROM resumes), jq AS (SELECT jd_id, {Q.keywords('text')} AS kw FROM jreal),
    rx AS (SELECT resume_id, unnest(kw) AS w FROM rw), jx AS (SELECT jd_id, unnest(kw) AS w FROM jq),
    shared AS (SELECT application_id, count(*) AS n FROM pairs JOIN jx ON jx.jd_id = real_jd JOIN rx ON rx.resume_id = pairs.resume_id AND rx.w = jx.w GROUP BY 1)"""


@query("join_keyword_overlap", f"""
    WITH {KW_CTES} SELECT application_id, coalesce(n, 0)::BIGINT AS shared FROM pairs LEFT JOIN shared USING (application_id) WHERE has_jd""")
def join_keyword_overlap(t):
    return _keyword_pairs(t).select("application_id", F.size(F.array_intersect("jd_keywords", "keywords")).cast("long").alias("shared"))


@query("sc_kw_density", f"""
    WITH {KW_CTES} SELECT application_id, CASE WHEN len(kw) = 0 THEN 50 ELSE {Q.round1('coalesce(n, 0)::DOUBLE / len(kw)::DOUBLE * 100')} END AS density
    FROM pairs JOIN jq ON jq.jd_id = real_jd LEFT JOIN shared USING (application_id)""")
def sc_kw_density(t):
    return _keyword_pairs(t).select("application_id", round1(S.keyword_density(F.col("keywords"), F.col("jd_keywords"))).alias("density"))


def _missing_words(t):
    openings = G.repeated_words(t.jds, "jd_id", "text")
    pairs = skew_join(t.applications, openings, "jd_id", "application_id", "inner")
    people = t.resumes.select("resume_id", "text")
    both = skew_join(pairs, people, "resume_id", "application_id", "inner", count_on=t.applications)
    return both


@query("join_missing_keyword", f"""
    WITH {PAIR_CTES}, {WORD_CTES} SELECT application_id, word FROM pairs JOIN jf0 ON jf0.jd_id = real_jd JOIN resumes r ON r.resume_id = pairs.resume_id
    WHERE freq >= 2 AND NOT contains(lower(r.text), word)""")
def join_missing_keyword(t):
    return _missing_words(t).select("application_id", F.explode(G.absent_words(F.col("text"), F.col("repeated"))).alias("word"))


@query("agg_missing_keywords", f"""
    WITH {PAIR_CTES}, {MISSING_CTES} SELECT application_id, array_to_string(words, '; ') AS missing_keywords FROM mk""")
def agg_missing_keywords(t):
    return _missing_words(t).select("application_id", G.missing_keywords(F.col("text"), F.col("repeated")).alias("w")).filter(F.size("w") > 0).select(
        "application_id", joined(F.col("w")).alias("missing_keywords"))


@query("agg_word_freq", f"""
    WITH w AS (SELECT doc_id, unnest(k) AS word, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, {Q.words('text')} AS k FROM documents))
    SELECT doc_id, word, count(*) AS freq, min(pos) - 1 AS first_pos FROM w GROUP BY doc_id, word""")
def agg_word_freq(t):
    return G.word_frequency(t.documents, "doc_id", "text")


@query("agg_missing_sections", f"""
    WITH s AS (SELECT {Q.missing_sections('secs')} AS m FROM (SELECT {Q.sections('text')} AS secs FROM resumes)), u AS (SELECT unnest(m) AS section FROM s)
    SELECT section, count(*) AS resumes FROM u GROUP BY section""")
def agg_missing_sections(t):
    return t.resumes.select(F.explode(S.missing_sections(X.sections(F.col("text")))).alias("section")).groupBy("section").agg(F.count("*").alias("resumes"))


@query("join_role_leakage", """
    SELECT row_id, len(list_filter(r, lambda w: list_contains(f, w)))::DOUBLE / greatest(len(r), 1)::DOUBLE AS overlap FROM (
        SELECT row_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(role, '')), '\\s+'), lambda w: w <> '')) AS r,
               regexp_split_to_array(lower(coalesce(features, '')), '\\s+') AS f FROM jobs)""")
def join_role_leakage(t):
    from talentloom.operators.quality import role_overlap
    return t.jobs.select("row_id", role_overlap(F.col("role"), F.col("features")).alias("overlap"))


# --- parts of one text ---------------------------------------------------------------------------------------

@query("sc_sections", f"""
    SELECT resume_id, (6 - len(m))::DOUBLE / 6 * 100 AS score, {joined_sql('m')} AS missing, {joined_sql(Q.messages(("len(m) > 0", Q.fb("sections", "array_to_string(m, ', ')"))))} AS feedback
    FROM (SELECT resume_id, {Q.missing_sections('s')} AS m FROM (SELECT resume_id, {Q.sections('text')} AS s FROM resumes))""")
def sc_sections(t):
    s = t.resumes.select("resume_id", X.sections(F.col("text")).alias("s"))
    f = F.col("s")
    return s.select("resume_id", S.section_score(f).alias("score"), joined(S.missing_sections(f)).alias("missing"), joined(S.section_feedback(f)).alias("feedback"))


@query("sc_length", f"""
    SELECT doc_id AS id, {Q.length_score('text')} AS score FROM documents UNION ALL SELECT -1 - resume_id, {Q.length_score('text')} FROM resumes""")
def sc_length(t):
    both = t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(t.resumes.select((-1 - F.col("resume_id")).alias("id"), "text"))
    return both.select("id", S.length_score(F.col("text")).alias("score"))


@query("sc_bullets", f"SELECT resume_id, {Q.bullet_score('n', 'b')} AS score FROM (SELECT resume_id, {Q.nonblank_lines('text')} AS n, {Q.bullet_lines('text')} AS b FROM resumes)")
def sc_bullets(t):
    return t.resumes.select("resume_id", T.line_counts(F.col("text")).alias("n")).select("resume_id", S.bullet_score(F.col("n")).alias("score"))


@query("sc_kw_richness", f"WITH {FACT_CTES} SELECT resume_id, rich AS score, verbs::BIGINT AS verbs, numbers::BIGINT AS numbers, len(kw)::BIGINT AS keywords FROM rf")
def sc_kw_richness(t):
    k = t.resumes.select("resume_id", T.keywords(F.col("text")).alias("kw"), T.has_words(F.col("text")).alias("has_words"), T.count_numbers(F.col("text")).alias("numbers"))
    k = k.withColumn("verbs", S.action_verb_count(F.col("kw")))
    return k.select("resume_id", S.richness(F.col("has_words"), F.col("verbs"), F.col("numbers"), F.size("kw")).alias("score"),
                    F.col("verbs").cast("long").alias("verbs"), F.col("numbers").cast("long").alias("numbers"), F.size("kw").cast("long").alias("keywords"))


@query("sc_contact", f"WITH {FACT_CTES} SELECT resume_id, s_con AS score FROM rf")
def sc_contact(t):
    return t.resumes.select("resume_id", X.contact(F.col("text")).alias("c")).select("resume_id", S.contact_score(F.col("c")).alias("score"))


@query("sc_formatting", f"""
    SELECT doc_id AS id, {Q.formatting_score('text')} AS score FROM documents UNION ALL SELECT -1 - resume_id, {Q.formatting_score('text')} FROM resumes""")
def sc_formatting(t):
    both = t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(t.resumes.select((-1 - F.col("resume_id")).alias("id"), "text"))
    return both.select("id", S.format_counts(F.col("text")).alias("n")).select("id", S.formatting_score(F.col("n")).alias("score"))


@query("sc_experience", f"""
    WITH {PAIR_CTES}, {SECTION}, y AS (SELECT r.resume_id, {YEARS} AS years FROM (SELECT * FROM resumes) AS r LEFT JOIN es USING (resume_id)),
    jf AS (SELECT jd_id, {Q.jd_years('text')} AS jy FROM jreal)
    SELECT application_id, {_EXP} AS score FROM pairs p JOIN y USING (resume_id) LEFT JOIN jf ON jf.jd_id = real_jd""")
def sc_experience(t):
    openings = t.jds.filter(~T.is_blank(F.col("text"))).select("jd_id", X.jd_years(F.col("text")).alias("jy"), F.lit(True).alias("has_jd"))
    people = t.resumes.select("resume_id", X.experience_years(F.col("text"), AS_OF_YEAR).alias("years"))
    pairs = skew_join(t.applications, openings, "jd_id", "application_id")
    both = skew_join(pairs, people, "resume_id", "application_id", "inner", count_on=t.applications)
    return both.select("application_id", S.experience_match(F.col("years"), F.col("jy"), F.coalesce("has_jd", F.lit(False))).alias("score"))


@query("sc_education", f"""
    WITH {PAIR_CTES}, e AS (SELECT resume_id, {Q.degree_level('array_to_string(' + Q.education('text') + ', chr(10))')} AS level FROM resumes),
    jf AS (SELECT jd_id, {Q.degree_level('text')} AS jl FROM jreal)
    SELECT application_id, {_EDU} AS score FROM pairs p JOIN e USING (resume_id) LEFT JOIN jf ON jf.jd_id = real_jd""")
def sc_education(t):
    openings = t.jds.filter(~T.is_blank(F.col("text"))).select("jd_id", X.degree_level(F.col("text")).alias("jl"), F.lit(True).alias("has_jd"))
    people = t.resumes.select("resume_id", X.education(F.col("text")).alias("education")).select("resume_id", X.highest_degree(F.col("education")).alias("level"))
    pairs = skew_join(t.applications, openings, "jd_id", "application_id")
    both = skew_join(pairs, people, "resume_id", "application_id", "inner", count_on=t.applications)
    return both.select("application_id", S.education_match(F.col("level"), F.col("jl"), F.coalesce("has_jd", F.lit(False))).alias("score"))


# --- report ----------------------------------------------------------------------------------------------------

def _fmt(col: str) -> str:
    return f"printf('%d.%d/100', floor({col})::INT, (round_even(({col} - floor({col})) * 10, 0))::INT)"


def _rep(section: str, order: int, label: str, value: str, when: str, score: str | None = None) -> str:
    return (f"SELECT application_id, resume_id, jd_id, '{section}' AS section, {order} AS ord, {Q.q(label)} AS label, {Q.latin1('(' + value + ')')} AS value, "
            f"{Q.band(score) if score else 'NULL::INT'} AS band FROM sc2 WHERE {when}")


_JD_SCORES = [("Overall Match Score", "overall"), ("Semantic Similarity", "sem1"), ("Skill Overlap", "skill_pct"), ("Experience Match", "experience_match"), ("Education Match", "education_match")]
_ATS_SCORES = [("Section Coverage", "sec1"), ("Resume Length", "s_len"), ("Bullet Points", "s_bul"), ("Keyword / Quality Density", "kw1"),
               ("Contact Info Completeness", "s_con"), ("Formatting Cleanliness", "s_fmt")]
_L = "array_to_string({}, ', ')"
REPORT = f"""
    WITH {MATCH_CTES}, sc2 AS (SELECT *, {Q.round1('semantic')} AS sem1, {Q.round1('s_sec')} AS sec1, {Q.round1('kw_score')} AS kw1,
        concat_ws(' | ', email, phone) AS cts FROM sc) """ + " UNION ALL ".join([
    _rep("overview", 0, "Candidate", "name", "name IS NOT NULL"), _rep("overview", 1, "Contact", "cts", "cts <> ''"),
    _rep("overview", 2, "Estimated Experience", "'~' || round_even(years, 0)::INT::VARCHAR || ' years'", "years > 0"),
    _rep("overview", 3, "Highest Education", _L.format("education[1:3]"), "len(education) > 0"),
    _rep("overview", 4, "Detected Roles", _L.format("titles[1:5]"), "len(titles) > 0"),
    *[_rep("scores", i, l, _fmt(c), "has_jd", c) for i, (l, c) in enumerate(_JD_SCORES)],
    _rep("scores", 0, "Mode", "'Analysis Mode: Resume-Only (No Job Description provided)'", "NOT has_jd"),
    _rep("scores", 1, "ATS Resume Quality Score", _fmt("overall"), "NOT has_jd", "overall"),
    _rep("scores", 5, "ATS Formatting Score", _fmt("ats_total"), "true", "ats_total"),
    *[_rep("ats", i, l, _fmt(c), "true", c) for i, (l, c) in enumerate(_ATS_SCORES)],
    _rep("skills", 0, "Skill Overlap Percentage", _fmt("skill_pct"), "has_jd", "skill_pct"),
    _rep("skills", 1, "Matched Skills", _L.format("matched"), "has_jd AND len(matched) > 0"),
    _rep("skills", 2, "Missing Skills from JD", f"CASE WHEN len(missing) > 0 THEN {_L.format('missing')} ELSE 'No critical skills missing for target JD!' END", "has_jd"),
    _rep("skills", 3, "Missing High-Frequency Keywords", _L.format("missing_keywords"), "has_jd AND len(missing_keywords) > 0"),
    _rep("skills", 1, "Extracted Skills", f"CASE WHEN len(extra) > 0 THEN {_L.format('extra')} ELSE 'No explicit technical skills extracted.' END", "NOT has_jd"),
    f"""SELECT application_id, resume_id, jd_id, 'feedback', n - 1, CASE WHEN regexp_matches(lower(m), 'missing|very|excessive') THEN 'warning' ELSE 'info' END, {Q.latin1('m')}, NULL
        FROM (SELECT application_id, resume_id, jd_id, generate_subscripts(feedback, 1) AS n, unnest(feedback) AS m FROM sc2)""",
])


@query("sink_report", f"SELECT application_id, resume_id, jd_id, section, ord::INT AS ord, label, value, band FROM ({REPORT})")
def sink_report(t):
    return R.report_lines(matches(t, missing_words=True))
