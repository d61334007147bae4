"""From text to facts, Column -> Column.  Everything is computed inside the row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import text as T
from talentloom.functions.numeric import bind, constant_list, constant_pairs

ANY_CASE = "(?iU)"


def _any_of(pairs: Sequence[tuple[Column, str]]) -> Column:
    """The names whose condition holds, in the given order.

    Joined from one-element arrays instead of filtering one array: that stays in generated code,
    where parts the conditions share (the lower-cased text) are computed once.
    """
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(F.lit(name))).otherwise(none) for cond, name in pairs])


#: The other characters that a match without case takes for an ASCII letter (i, s, k); lower-casing a text does not turn them all into it.
_FOLDED = "\u0131\u0130\u017f\u212a"


def _mentions(c: Column, words: Sequence[str]) -> Column:
    """May a pattern that cannot do without one of these lower-case words match? A plain search, which spares most texts the pattern."""
    low = F.lower(c)
    found = [F.contains(low, F.lit(w)) for w in words] + [F.contains(c, F.lit(ch)) for ch in _FOLDED]
    return reduce(lambda a, b: a | b, found)


def _matches_of(c: Column, pattern: str, words: Sequence[str] | None, use: Callable[[Column], Column] = lambda found: found) -> Column:
    """All matches of a pattern without case, which is tried only where one of the words it needs stands; and what ``use`` makes of them.

    The test stays outside of any function of arrays: in generated code the text is lower-cased once for all words.
    """
    found = use(T.all_matches(c, ANY_CASE + pattern))
    return found if words is None else F.when(_mentions(c, words), found).otherwise(F.array().cast("array<string>"))


# --- contact --------------------------------------------------------------------------------------

def email(c: Column) -> Column:
    c = T.blank_if_null(c)
    return F.when(F.contains(c, F.lit("@")), T.first_match(c, "(?U)" + rules.EMAIL))


def phone(c: Column) -> Column:
    """The first phone-shaped match decides: null if it has fewer than seven digits."""
    found = T.strip(F.regexp_extract(T.blank_if_null(c), "(?U)" + rules.PHONE, 0))
    return F.when(F.length(F.regexp_replace(found, r"(?U)\D", "")) >= 7, found)


def phone_us(c: Column) -> Column:
    return T.first_match(T.blank_if_null(c), "(?U)" + rules.PHONE_US)


def is_contact_line(line: Column) -> Column:
    """Lines that carry an address, a link, a label, digits or a word that is never a name."""
    words = F.transform(F.split(T.strip(line), r"(?U)\s+"), F.lower)
    return line.rlike(r"(?U)@|http|www\.|:|\||\d") | F.arrays_overlap(words, constant_list(rules.NOT_A_NAME))


def name(c: Column) -> Column:
    """First of the five opening lines that looks like a full name of two to four words."""
    opening = F.transform(F.slice(F.filter(T.lines(T.blank_if_null(c)), lambda l: l.rlike(r"(?U)\S")), 1, 5), T.strip)
    shaped = F.filter(opening, lambda l: l.rlike(r"^[A-Za-z'.\-]+(?U:\s+[A-Za-z'.\-]+){1,3}$"))
    return T.capitalize_words(F.get(F.filter(shaped, lambda l: ~is_contact_line(l)), F.lit(0)))


def name_bigram(c: Column) -> Column:
    return T.first_match(T.blank_if_null(c), "(?U)" + rules.NAME_BIGRAM)


def contact(c: Column) -> Column:
    return F.struct(name(c).alias("name"), email(c).alias("email"), phone(c).alias("phone"))


# --- sections -------------------------------------------------------------------------------------

def sections(c: Column) -> Column:
    c = T.blank_if_null(c)
    return _any_of([(_mentions(c, rules.SECTION_WORDS[n]) & c.rlike(ANY_CASE + p), n) for n, p in rules.SECTION_PATTERNS.items()])


def experience_section(c: Column) -> Column:
    """Text between the first experience heading and the next other heading; null if empty."""
    heading, other = ANY_CASE + rules.EXPERIENCE_HEADING, ANY_CASE + rules.OTHER_HEADING

    def first(rows: Column, pattern: str) -> Column:
        return F.array_min(F.transform(rows, lambda l, i: F.when(l.rlike(pattern), i)))

    def until_other(after: Column) -> Column:
        body = F.slice(after, F.lit(1), F.coalesce(first(after, other), F.size(after)))
        return F.array_join(F.filter(body, lambda l: ~l.rlike(heading)), "\n")

    def after_heading(rows: Column) -> Column:
        return F.slice(rows, first(rows, heading) + 2, F.size(rows))

    # a plain test first: most texts of a mixed corpus have no such heading
    mentions = c.rlike(r"(?im)^\s*(?:work|professional|employment|experience)")
    rows = F.when(mentions, T.lines(c))
    return F.nullif(bind(bind(rows, after_heading), until_other), F.lit(""))


# --- experience -----------------------------------------------------------------------------------

def _range_years(c: Column, pattern: str, as_of_year: int) -> Column:
    spans = F.arrays_zip(
        T.all_matches(c, ANY_CASE + pattern, 1).alias("start"),
        T.all_matches(c, ANY_CASE + pattern, 2).alias("end"),
    )
    typed = F.transform(spans, lambda s: F.struct(
        s["start"].try_cast("int").alias("start"),
        F.when(s["end"] == "", F.lit(as_of_year)).otherwise(s["end"].try_cast("int")).alias("end"),
    ))
    return valid_ranges(typed, as_of_year)


def valid_ranges(spans: Column, as_of_year: int) -> Column:
    """Keep ranges with 1970 <= start <= now and start <= end <= now + 1."""
    return F.filter(spans, lambda s: s["start"].between(rules.EARLIEST_YEAR, as_of_year)
                    & s["end"].between(s["start"], as_of_year + 1))


def year_ranges(section: Column, as_of_year: int) -> Column:
    """All valid year ranges; "Jan 2018 - 2020" has both shapes and is listed twice."""
    section = T.blank_if_null(section)
    return F.concat(*[_range_years(section, p, as_of_year) for p in (rules.MONTH_YEAR_RANGE, rules.YEAR_RANGE)])


def years_max(c: Column) -> Column:
    """Largest "N years" mention."""
    found = T.all_matches(T.blank_if_null(c), ANY_CASE + rules.YEARS_MENTION, 1)
    return F.array_max(F.transform(found, lambda y: y.try_cast("double")))


def years_sum(section: Column, as_of_year: int) -> Column:
    """Sum of range lengths; overlapping jobs are added, as the rule has it."""
    return F.aggregate(year_ranges(section, as_of_year), F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).cast("double")


def merged_years(section: Column, as_of_year: int) -> Column:
    """Years covered by the ranges when overlaps count once (option, not the default)."""
    def add(acc, s):
        start = F.greatest(s["start"], acc["until"])
        return F.struct(
            (acc["total"] + F.greatest(s["end"] - start, F.lit(0))).alias("total"),
            F.greatest(acc["until"], s["end"]).alias("until"),
        )
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("until"))
    ordered = F.sort_array(year_ranges(section, as_of_year))
    return F.aggregate(ordered, zero, add, lambda acc: acc["total"]).cast("double")


def experience_years(c: Column, as_of_year: int, merge_intervals: bool = False) -> Column:
    """Years of experience, never null: explicit mentions first, then ranges of the section."""
    ranges = merged_years if merge_intervals else years_sum
    return bind(experience_section(c), lambda section: F.coalesce(
        years_max(F.coalesce(section, c)), ranges(section, as_of_year)))


def jd_years(c: Column) -> Column:
    """Years an opening asks for, or null."""
    c = T.blank_if_null(c)
    return F.coalesce(*[T.first_match(c, ANY_CASE + p, 1).try_cast("double") for p in rules.JD_YEARS])


# --- education ------------------------------------------------------------------------------------

def degrees(c: Column) -> Column:
    c = T.blank_if_null(c)
    # a look at the first letter spares the word-boundary test on most characters
    firsts = ["(?=[pd])", "(?=m)", "(?=b)", "(?=a)", "(?=[dc])"]
    return F.array_distinct(F.concat(*[_matches_of(c, f + p, w) for f, p, w in zip(firsts, rules.DEGREE_PATTERNS, rules.DEGREE_WORDS)]))


def study_fields(c: Column, fields: Sequence[str] = rules.STUDY_FIELDS) -> Column:
    """Fields named anywhere, also inside longer words."""
    low = F.lower(T.blank_if_null(c))
    return _any_of([(F.contains(low, F.lit(k)), f) for k, f in {f.lower(): f for f in fields}.items()])


def institutions(c: Column) -> Column:
    c = T.blank_if_null(c)
    named = reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in rules.INSTITUTION_WORDS])
    return F.when(named, F.array_distinct(T.all_matches(c, "(?U)" + rules.INSTITUTION))).otherwise(F.array().cast("array<string>"))


def education(c: Column) -> Column:
    return F.array_distinct(F.concat(degrees(c), study_fields(c), institutions(c)))


def degree_level(c: Column, undot: bool = False) -> Column:
    """Highest degree level named in a text, 0 if none."""
    low = F.lower(T.blank_if_null(c))
    levels = rules.DEGREE_LEVELS
    if undot:
        low = F.replace(low, F.lit("."), F.lit(""))
        levels = {k.replace(".", ""): v for k, v in levels.items()}
    named = bind(low, lambda t: F.array_max(F.transform(
        F.filter(constant_pairs(levels), lambda d: F.contains(t, d["k"])), lambda d: d["v"])))
    return F.coalesce(named, F.lit(0))


def highest_degree(items: Column, undot: bool = False) -> Column:
    """Highest level over education items; no keyword holds a line break, so one joined text will do."""
    return degree_level(F.array_join(items, "\n"), undot)


# --- titles and keyword lists ----------------------------------------------------------------------

def job_titles(c: Column) -> Column:
    c = T.blank_if_null(c)
    # the first letters spare the alternatives on most words; white space in front, which a pattern also takes, is stripped anyway
    firsts = ["(?=[sjlpcwfbmdaqte][eurthoalincpd])", "(?=[petomshf])", "(?=[cvs])"]

    def named(first: str, pattern: str, words: Sequence[str]) -> Column:
        return _matches_of(c, first + pattern, words, lambda found: F.filter(F.transform(found, T.strip), lambda t: t != ""))

    return F.array_distinct(F.concat(*[named(f, p, w) for f, p, w in zip(firsts, rules.TITLE_PATTERNS, rules.TITLE_WORDS)]))


def _whole_word(keyword: str) -> str:
    escaped = "".join(ch if ch.isalnum() or ch.isspace() else "\\" + ch for ch in keyword)
    return ANY_CASE + r"\b" + escaped + r"\b"


def listed_skills(c: Column, skills: Sequence[str]) -> Column:
    """Skills of a list found as whole words, in list order, repeats in the list kept.

    A literal pattern per skill: compiled once per task, unlike a pattern column.  The plain
    substring test in front spares the regular expression on most texts.
    """
    c = T.blank_if_null(c)
    low = F.lower(c)
    return _any_of([(F.contains(low, F.lit(s.lower())) & c.rlike(_whole_word(s)), s) for s in skills])


def listed_keywords(c: Column, keywords: Sequence[str]) -> Column:
    """Like :func:`listed_skills`, but each hit as the text spells it."""
    c = T.blank_if_null(c)
    low = F.lower(c)
    none = F.array().cast("array<string>")

    def hit(k: str) -> Column:
        found = F.regexp_extract(c, _whole_word(k), 0)
        return F.when(F.contains(low, F.lit(k.lower())) & (found != ""), F.array(found)).otherwise(none)

    return F.concat(*[hit(k) for k in keywords])
