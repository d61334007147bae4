"""Facts, match scores and reports: the whole analysis as three plans.

Facts are computed once per text, not once per pair.  Pairs are applications: rows
``(application_id, resume_id, jd_id)``, ``jd_id`` null for an analysis without an opening.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import extract as X
from talentloom.functions import score as S
from talentloom.functions import text as T
from talentloom.functions.numeric import round1
from talentloom.operators import gap as G
from talentloom.operators import vectors as V
from talentloom.operators.joins import skew_join
from talentloom.operators.skills import SkillRules, overlap_parts, plain_extras, shown_pairs
from talentloom.session import stored


def text_facts(docs: DataFrame, doc_id: str, text: str, as_of_year: int) -> DataFrame:
    """What a text alone says about its author: a projection."""
    c = F.col(text)
    return docs.select(
        doc_id, c.alias("text"),
        X.contact(c).alias("contact"), X.sections(c).alias("sections"), X.education(c).alias("education"),
        X.experience_years(c, as_of_year).alias("years"), X.job_titles(c).alias("titles"),
    ).withColumn("level", X.highest_degree(F.col("education")))


def facts(docs: DataFrame, doc_id: str, text: str, skills: SkillRules, as_of_year: int) -> DataFrame:
    """Everything a text says about its author, with the skills found by the phrase index."""
    return skills.attach(text_facts(docs, doc_id, text, as_of_year), docs, doc_id, text)


def structure(facts_: DataFrame) -> DataFrame:
    """Add what the structure score needs from the text alone."""
    c = F.col("text")
    measured = facts_.select(
        "*", T.keywords(c).alias("keywords"), T.has_words(c).alias("has_words"),
        T.count_numbers(T.blank_if_null(c)).alias("numbers"), T.line_counts(T.blank_if_null(c)).alias("line_counts"),
        S.format_counts(c).alias("format_counts"),
    ).withColumn("verbs", S.action_verb_count(F.col("keywords")))
    richness = S.richness(F.col("has_words"), F.col("verbs"), F.col("numbers"), F.size("keywords"))
    return measured.select(
        *[k for k in measured.columns if k not in ("has_words", "numbers", "line_counts", "format_counts", "verbs")],
        S.section_score(F.col("sections")).alias("section_score"), S.length_score(c).alias("length_score"),
        S.bullet_score(F.col("line_counts")).alias("bullet_score"), richness.alias("richness"),
        S.contact_score(F.col("contact")).alias("contact_score"),
        S.formatting_score(F.col("format_counts")).alias("formatting_score"),
        S.missing_sections(F.col("sections")).alias("missing_sections"),
        F.concat(S.section_feedback(F.col("sections")), S.length_feedback(c), S.bullet_feedback(F.col("line_counts"))).alias("feedback_head"),
        S.richness_feedback(F.col("has_words"), F.col("verbs"), F.col("numbers")).alias("richness_feedback"),
        F.concat(S.contact_feedback(F.col("contact")), S.formatting_feedback(F.col("format_counts"))).alias("feedback_tail"),
    )


def opening_facts(jds: DataFrame, jd_id: str, text: str, skills: SkillRules) -> DataFrame:
    """What an opening asks for; blank openings drop out (an application to one has no opening)."""
    c = F.col(text)
    real = jds.filter(~T.is_blank(c))
    asked = real.select(jd_id, T.keywords(c).alias("jd_keywords"), X.jd_years(c).alias("jd_years"), X.degree_level(c).alias("jd_level"))
    said = skills.attach(asked, real, jd_id, text).withColumnRenamed("skill_keys", "jd_skill_keys").drop("skills")
    repeated = G.repeated_words(jds, jd_id, text).withColumnRenamed("repeated", "jd_repeated")
    return said.join(repeated, jd_id, "left").withColumn("has_jd", F.lit(True))


def match(applications: DataFrame, resumes: DataFrame, jds: DataFrame, skills: SkillRules, as_of_year: int,
          hot_rows: int | None = None, missing_words: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """One scored row per application.

    ``resumes(resume_id, text)``, ``jds(jd_id, text)``.  Facts, term counts, skills and their shown names are taken where a text lies.
    What travels to the applications are facts and vectors; the text itself moves once, and only for ``missing_words``, the words
    an opening repeats and the text lacks. Those meet the bare applications first, so no scored row is shuffled again.
    ``vocab`` is that of the résumés given unless a fitted one is passed. All joins with applications spread hot keys.
    """
    tune = {} if hot_rows is None else {"min_rows": hot_rows}
    wanted = jds.select("jd_id", F.col("text"))
    resume_terms = V.term_counts(resumes, "resume_id", "text")
    vocab = V.vocabulary(resume_terms) if vocab is None else vocab
    jd_vectors = V.tfidf(V.term_counts(wanted, "jd_id", "text"), vocab, "jd_id").toDF("jd_id", "jd_terms", "jd_weights")
    resume_vectors = V.tfidf(resume_terms, vocab, "resume_id")

    openings = opening_facts(wanted, "jd_id", "text", skills).withColumn("jd_skill_keys", shown_pairs(F.col("jd_skill_keys")))
    openings = stored(openings.join(jd_vectors, "jd_id", "left"), "openings")
    told = structure(text_facts(resumes, "resume_id", "text", as_of_year)).drop("text")
    listed = skills.attach(told, resumes, "resume_id", "text")
    people = listed.withColumn("skill_keys", shown_pairs(F.col("skill_keys"))).withColumn("plain_extras", plain_extras(F.col("skills"))).drop("skills")
    people = people.join(resume_vectors, "resume_id", "left")
    sent = applications
    if missing_words:
        asked = openings.filter(F.size("jd_repeated") > 0).select("jd_id", "jd_repeated")
        asking = skew_join(applications.select("application_id", "resume_id", "jd_id"), asked, "jd_id", "application_id", "inner", **tune).drop("jd_id")
        met = skew_join(asking, resumes.select("resume_id", "text"), "resume_id", "application_id", "inner", count_on=applications, **tune)
        lacking = met.select("application_id", G.missing_keywords(F.col("text"), F.col("jd_repeated")).alias("missing_keywords"))
        none = F.array().cast("array<string>")
        sent = applications.join(lacking, "application_id", "left").withColumn("missing_keywords", F.coalesce("missing_keywords", none))
    pairs = skew_join(sent, openings.drop("jd_repeated"), "jd_id", "application_id", "left", count_on=applications, **tune)
    return score_pairs(skew_join(pairs, people, "resume_id", "application_id", "inner", count_on=applications, **tune))


def score_pairs(joined: DataFrame) -> DataFrame:
    """Scores of joined rows; a projection."""
    none = F.array().cast("array<string>")
    has_jd = F.coalesce("has_jd", F.lit(False))
    cosine = V.sparse_dot(F.col("terms"), F.col("weights"), F.col("jd_terms"), F.col("jd_weights"))
    density = S.keyword_density(F.col("keywords"), F.col("jd_keywords"))
    gap = overlap_parts(F.col("skill_keys"), F.col("jd_skill_keys"))
    alone = {"matched": none, "missing": none, "extra": F.col("plain_extras"), "overlap_pct": F.lit(0.0)}
    asked = [k for k in joined.columns if k == "missing_keywords"]
    step = joined.select(
        "application_id", "resume_id", "jd_id", has_jd.alias("has_jd"), "contact", "education", "years", "titles", "level",
        *[k for k in joined.columns if k.endswith("_score")], "missing_sections", "feedback_head", "richness_feedback", "feedback_tail",
        F.when(has_jd, V.similarity_score(cosine)).otherwise(0.0).alias("semantic"),
        F.when(has_jd, density).otherwise(F.col("richness")).alias("keyword_score"),
        *[F.when(has_jd, gap[k]).otherwise(alone[k]).alias(k) for k in gap],
        S.experience_match(F.col("years"), F.col("jd_years"), has_jd).alias("experience_match"),
        S.education_match(F.col("level"), F.col("jd_level"), has_jd).alias("education_match"), *asked,
    )
    parts = {"sections": F.col("section_score"), "length": F.col("length_score"), "bullets": F.col("bullet_score"),
             "keywords": F.col("keyword_score"), "contact": F.col("contact_score"), "formatting": F.col("formatting_score")}
    scored = step.withColumn("ats_total", round1(S.structure_total(parts, F.col("has_jd"))))
    composite = S.weighted({"semantic": F.col("semantic"), "skills": F.col("overlap_pct"),
                            "experience": F.col("experience_match"), "education": F.col("education_match")}, rules.MATCH_WEIGHTS)
    keyword_feedback = F.when(F.col("has_jd"), S.density_feedback(F.col("keyword_score"))).otherwise(F.col("richness_feedback"))
    return scored.select(
        "application_id", "resume_id", "jd_id", "has_jd",
        F.when(F.col("has_jd"), round1(composite)).otherwise(F.col("ats_total")).alias("overall"),
        round1(F.col("semantic")).alias("semantic"), F.col("overlap_pct").alias("skill_pct"),
        "experience_match", "education_match", "ats_total",
        round1(F.col("section_score")).alias("section_score"), "length_score", "bullet_score",
        round1(F.col("keyword_score")).alias("keyword_score"), "contact_score", "formatting_score",
        "missing_sections", F.concat("feedback_head", keyword_feedback, "feedback_tail").alias("feedback"),
        "matched", "missing", "extra", "contact", "education", "years", "titles", "level", *asked,
    )
