"""Scores, Column -> Column.  Messages are arrays of strings in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import text as T
from talentloom.functions.numeric import constant_list, round1


def _message(key: str, value: Column | None = None) -> Column:
    template = rules.FEEDBACK[key]
    if value is None:
        return F.lit(template)
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def _messages(*conditions: tuple[Column, Column]) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(msg)).otherwise(none) for cond, msg in conditions])


# --- sections -------------------------------------------------------------------------------------

def with_synonyms(found: Column) -> Column:
    """Having a summary or an objective counts as having both."""
    either = constant_list(["summary", "objective"])
    return F.when(F.arrays_overlap(found, either), F.array_union(found, either)).otherwise(found)


def missing_sections(found: Column, expected: Sequence[str] = rules.EXPECTED_SECTIONS) -> Column:
    return F.sort_array(F.array_except(constant_list(expected), with_synonyms(found)))


def section_score(found: Column, expected: Sequence[str] = rules.EXPECTED_SECTIONS) -> Column:
    hit = F.size(F.array_intersect(constant_list(expected), with_synonyms(found)))
    return hit.cast("double") / F.lit(float(max(len(expected), 1))) * F.lit(100.0)


def section_feedback(found: Column) -> Column:
    missing = missing_sections(found)
    return _messages((F.size(missing) > 0, _message("sections", F.array_join(missing, ", "))))


# --- length ---------------------------------------------------------------------------------------

def length_score(c: Column) -> Column:
    n = F.length(T.blank_if_null(c))
    return (
        F.when(n < rules.LENGTH_MIN, 20.0).when(n < rules.LENGTH_IDEAL_MIN, 60.0)
        .when(n <= rules.LENGTH_IDEAL_MAX, 100.0).when(n <= rules.LENGTH_MAX, 80.0).otherwise(40.0)
    )


def length_feedback(c: Column) -> Column:
    n = F.length(T.blank_if_null(c))
    return _messages(
        (n < rules.LENGTH_MIN, _message("very_short", n)),
        ((n >= rules.LENGTH_MIN) & (n < rules.LENGTH_IDEAL_MIN), _message("short", n)),
        ((n > rules.LENGTH_IDEAL_MAX) & (n <= rules.LENGTH_MAX), _message("long", n)),
        (n > rules.LENGTH_MAX, _message("very_long", n)),
    )


# --- bullets --------------------------------------------------------------------------------------

def _bullet_ratio(counts: Column) -> Column:
    return counts["bullets"].cast("double") / counts["total"].cast("double")


def bullet_score(counts: Column) -> Column:
    """From :func:`text.line_counts`."""
    ratio = _bullet_ratio(counts)
    return (
        F.when(counts["total"] == 0, 0.0).when(ratio < F.lit(0.1), 30.0).when(ratio < F.lit(0.25), 60.0)
        .when(ratio > F.lit(0.8), 70.0).otherwise(100.0)
    )


def bullet_feedback(counts: Column) -> Column:
    score = bullet_score(counts)
    return _messages(
        (score == 0.0, _message("no_lines")), (score == 30.0, _message("few_bullets")),
        (score == 60.0, _message("some_bullets")), (score == 70.0, _message("all_bullets")),
    )


# --- keywords -------------------------------------------------------------------------------------

def keyword_density(resume_keywords: Column, jd_keywords: Column) -> Column:
    """Share of the opening's keywords found, 50 when it has none."""
    shared = F.size(F.array_intersect(jd_keywords, resume_keywords)).cast("double")
    total = F.size(jd_keywords).cast("double")
    return F.when(total == 0, F.lit(50.0)).otherwise(shared / total * F.lit(100.0))


def density_feedback(density: Column) -> Column:
    return _messages((density < 30, _message("low_density", F.rint(density).cast("int"))))


def action_verb_count(resume_keywords: Column, verbs: Sequence[str] = rules.ACTION_VERBS) -> Column:
    return F.size(F.array_intersect(constant_list(verbs), resume_keywords))


def richness(has_words: Column, verbs: Column, numbers: Column, keyword_count: Column) -> Column:
    """Keyword quality without an opening: verbs 50 %, numbers 30 %, variety 20 %."""
    verb_part = F.least(verbs.cast("double") / F.lit(8.0), F.lit(1.0)) * F.lit(100.0)
    number_part = F.least(F.least(numbers, F.lit(15)).cast("double") / F.lit(5.0), F.lit(1.0)) * F.lit(100.0)
    variety = F.least(keyword_count.cast("double") / F.lit(40.0), F.lit(1.0)) * F.lit(100.0)
    combined = verb_part * F.lit(0.50) + number_part * F.lit(0.30) + variety * F.lit(0.20)
    return F.when(~has_words, F.lit(0.0)).otherwise(round1(combined))


def richness_feedback(has_words: Column, verbs: Column, numbers: Column) -> Column:
    return _messages(
        (~has_words, _message("no_words")),
        (has_words & (verbs < 3), _message("few_verbs", verbs)),
        (has_words & (numbers < 2), _message("few_numbers")),
    )


# --- contact --------------------------------------------------------------------------------------

def _present(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), 1).otherwise(0)


def contact_score(contact: Column) -> Column:
    parts = _present(contact["name"]) + _present(contact["email"]) + _present(contact["phone"])
    return round1(parts.cast("double") / F.lit(3.0) * F.lit(100.0))


def contact_feedback(contact: Column) -> Column:
    return _messages(*[(_present(contact[k]) == 0, _message("no_" + k)) for k in ("name", "email", "phone")])


# --- formatting -----------------------------------------------------------------------------------

def format_counts(c: Column) -> Column:
    c = T.blank_if_null(c)
    return F.struct(
        T.count_unusual(c).alias("unusual"), T.count_char(c, "|").alias("pipes"),
        T.count_capital_words(c).alias("capitals"), T.count_long_paragraphs(c).alias("paragraphs"),
        T.count_blank_runs(c).alias("blank_runs"),
    )


# --- fixed values: count that is still fine, points lost beyond it
_FORMAT_RULES = {
    "unusual": (5, 15.0), "pipes": (10, 10.0), "capitals": (10, 10.0),
    "paragraphs": (2, 10.0), "blank_runs": (2, 5.0),
}


def formatting_score(counts: Column) -> Column:
    score = F.lit(100.0)
    for key, (limit, points) in _FORMAT_RULES.items():
        score = score - F.when(counts[key] > limit, points).otherwise(0.0)
    return F.greatest(score, F.lit(0.0))


def formatting_feedback(counts: Column) -> Column:
    return _messages(*[
        (counts[key] > limit, _message(key, counts[key] if key == "unusual" else None))
        for key, (limit, _) in _FORMAT_RULES.items()
    ])


# --- composites -----------------------------------------------------------------------------------

def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of part x weight, added in the order of the weights."""
    total = None
    for key, weight in weights.items():
        term = parts[key] * F.lit(weight)
        total = term if total is None else total + term
    return total


def structure_total(parts: dict[str, Column], has_jd: Column) -> Column:
    return (
        F.when(has_jd, weighted(parts, rules.STRUCTURE_WEIGHTS_WITH_JD))
        .otherwise(weighted(parts, rules.STRUCTURE_WEIGHTS_ALONE))
    )


def experience_match(years: Column, required: Column, has_jd: Column) -> Column:
    alone = F.when(years > 0, 75.0).otherwise(40.0)
    against = (
        F.when(required.isNull() | years.isNull(), 50.0).when(years >= required, 100.0)
        .when(years >= required * F.lit(0.7), 75.0).when(years >= required * F.lit(0.5), 50.0).otherwise(25.0)
    )
    return F.when(has_jd, against).otherwise(alone)


def education_match(level: Column, required: Column, has_jd: Column) -> Column:
    """``required`` is the highest level the opening names, 0 when it names none."""
    alone = F.when(level >= 3, 80.0).when(level >= 1, 55.0).otherwise(35.0)
    against = (
        F.when(required == 0, 50.0).when(level >= required, 100.0)
        .when(level >= required - 1, 70.0).otherwise(30.0)
    )
    return F.when(has_jd, against).otherwise(alone)


def band(score: Column) -> Column:
    """1 best … 4 worst: 75 / 50 / 25."""
    return F.when(score >= 75, 1).when(score >= 50, 2).when(score >= 25, 3).otherwise(4)


def band3(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def severity(message: Column) -> Column:
    return F.when(F.lower(message).rlike("|".join(rules.WARNING_WORDS)), "warning").otherwise("info")


def severity_rank(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low == "high", 1).when(low == "medium", 2).otherwise(3)
