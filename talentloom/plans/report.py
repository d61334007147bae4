"""The report of an application as a long table (section, ord, label, value, band)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions import score as S
from talentloom.functions import text as T
from talentloom.operators.joins import skew_join

# --- fixed values: how many items of a list a report shows
SHOWN = {"education": 3, "titles": 5, "jobs": 8}


def _line(section: str, order: int, label: str, value: Column, score: Column | None = None, when: Column | None = None) -> Column:
    row = F.struct(
        F.lit(section).alias("section"), F.lit(order).alias("ord"), F.lit(label).alias("label"), value.cast("string").alias("value"),
        (F.lit(None).cast("int") if score is None else S.band(score)).alias("band"))
    return row if when is None else F.when(when, row)


def _score(section: str, order: int, label: str, column: str, when: Column | None = None) -> Column:
    value = F.concat(F.col(column).cast("decimal(5,1)").cast("string"), F.lit("/100"))
    return _line(section, order, label, value, F.col(column), when)


def report_lines(matches: DataFrame) -> DataFrame:
    """Lines of scored applications; a projection and an explode, no shuffle.  Empty fields leave no line.

    Values become Latin-1 and messages get their label once they are rows, in generated code; a function of arrays would interpret all it holds.
    """
    jd, alone = F.col("has_jd"), ~F.col("has_jd")
    contact = F.concat_ws(" | ", "contact.email", "contact.phone")

    def joined(column: str, limit: int | None = None) -> Column:
        return F.array_join(F.slice(column, 1, limit) if limit else F.col(column), ", ")

    def filled(column: str) -> Column:
        return F.size(column) > 0

    ats = [("Section Coverage", "section_score"), ("Resume Length", "length_score"), ("Bullet Points", "bullet_score"),
           ("Keyword / Quality Density", "keyword_score"), ("Contact Info Completeness", "contact_score"),
           ("Formatting Cleanliness", "formatting_score")]
    matched = [("Overall Match Score", "overall"), ("Semantic Similarity", "semantic"), ("Skill Overlap", "skill_pct"),
               ("Experience Match", "experience_match"), ("Education Match", "education_match")]
    fixed = F.array(
        _line("overview", 0, "Candidate", F.col("contact.name"), when=F.col("contact.name").isNotNull()),
        _line("overview", 1, "Contact", contact, when=contact != ""),
        _line("overview", 2, "Estimated Experience", F.concat(F.lit("~"), F.rint("years").cast("int").cast("string"), F.lit(" years")),
              when=F.col("years") > 0),
        _line("overview", 3, "Highest Education", joined("education", SHOWN["education"]), when=filled("education")),
        _line("overview", 4, "Detected Roles", joined("titles", SHOWN["titles"]), when=filled("titles")),
        *[_score("scores", i, label, col, jd) for i, (label, col) in enumerate(matched)],
        _line("scores", 0, "Mode", F.lit("Analysis Mode: Resume-Only (No Job Description provided)"), when=alone),
        _score("scores", 1, "ATS Resume Quality Score", "overall", alone),
        _score("scores", 5, "ATS Formatting Score", "ats_total"),
        *[_score("ats", i, label, col) for i, (label, col) in enumerate(ats)],
        _score("skills", 0, "Skill Overlap Percentage", "skill_pct", jd),
        _line("skills", 1, "Matched Skills", joined("matched"), when=jd & filled("matched")),
        _line("skills", 2, "Missing Skills from JD", F.when(filled("missing"), joined("missing")).otherwise(
            "No critical skills missing for target JD!"), when=jd),
        _line("skills", 3, "Missing High-Frequency Keywords", joined("missing_keywords"), when=jd & filled("missing_keywords")),
        _line("skills", 1, "Extracted Skills", F.when(filled("extra"), joined("extra")).otherwise(
            "No explicit technical skills extracted."), when=alone),
    )
    tips = F.transform("feedback", lambda m, i: F.struct(
        F.lit("feedback").alias("section"), i.alias("ord"), F.lit(None).cast("string").alias("label"), m.alias("value"),
        F.lit(None).cast("int").alias("band")))
    told = matches.select("application_id", "resume_id", "jd_id", fixed.alias("fixed"), tips.alias("tips"))
    rows = told.select("application_id", "resume_id", "jd_id", F.inline(F.concat("fixed", "tips"))).filter(F.col("section").isNotNull())
    label = F.when(F.col("section") == "feedback", S.severity(F.col("value"))).otherwise(F.col("label"))
    return rows.withColumns({"label": label, "value": T.to_latin1(F.col("value"))})


def job_lines(jobs: DataFrame) -> DataFrame:
    """Report lines of recommended jobs (resume_id, rank, role, score): the first eight."""
    return jobs.filter(F.col("rank") <= SHOWN["jobs"]).select(
        "resume_id", F.lit("jobs").alias("section"), F.col("rank").cast("int").alias("ord"), T.to_latin1(F.col("role")).alias("label"),
        F.concat(F.col("score").cast("decimal(5,1)").cast("string"), F.lit("%")).alias("value"), S.band(F.col("score")).alias("band"))


def _suggestion(section: str = "suggestions") -> dict[str, Column]:
    return {"section": F.lit(section), "ord": F.col("ord").cast("int"), "label": T.to_latin1(F.concat(F.lit("["), "category", F.lit("] "), F.upper("severity"))),
            "value": T.to_latin1(F.col("suggestion")), "band": S.severity_rank(F.col("severity"))}


def suggestion_lines(parsed: DataFrame, reply_id: str) -> DataFrame:
    """Report lines of parsed suggestions."""
    return parsed.filter(F.col("ord").isNotNull()).select(reply_id, *[c.alias(n) for n, c in _suggestion().items()])


def advice_lines(parsed: DataFrame, reply_id: str) -> DataFrame:
    """Report lines of whole replies: the summary as line 0, then each suggestion and, where one is given, its reason. A reply without suggestions has none."""
    none = F.lit(None).cast("int")
    told = F.struct(*[c.alias(n) for n, c in _suggestion().items()])
    why = F.struct(F.lit("suggestions").alias("section"), F.col("ord").cast("int").alias("ord"), F.lit("Why").alias("label"), T.to_latin1(F.col("explanation")).alias("value"), none.alias("band"))
    summary = F.struct(F.lit("suggestions").alias("section"), F.lit(0).alias("ord"), F.lit("Summary").alias("label"), T.to_latin1(F.col("summary")).alias("value"), none.alias("band"))
    lines = F.array(F.when((F.col("ord") == 1) & (F.col("summary") != ""), summary), told, F.when(F.col("explanation") != "", why))
    return parsed.filter(F.col("ord").isNotNull()).select(reply_id, F.inline(F.filter(lines, lambda r: r.isNotNull())))


def application_report(matches: DataFrame, applications: DataFrame, jobs: DataFrame, parsed: DataFrame, reply_id: str) -> DataFrame:
    """One report for each application: its own lines, the jobs recommended to its résumé, and the reply about that résumé.

    Lines of a résumé are packed first - a handful each - and then meet its applications, with résumés of many applications spread.
    """
    def packed(lines: DataFrame, key: str) -> DataFrame:
        return lines.groupBy(F.col(key).alias("resume_id")).agg(F.collect_list(F.struct("section", "ord", "label", "value", "band")).alias("lines"))

    ids = ["application_id", "resume_id", "jd_id"]
    parts = [report_lines(matches)]
    for lines, key in ((job_lines(jobs), "resume_id"), (advice_lines(parsed, reply_id), reply_id)):
        met = skew_join(applications.select(*ids), packed(lines, key), "resume_id", "application_id", "inner")
        parts.append(met.select(*ids, F.inline("lines")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_report(lines: DataFrame, path: str, file_format: str = "parquet") -> None:
    lines.write.partitionBy("section").mode("overwrite").format(file_format).save(path)
