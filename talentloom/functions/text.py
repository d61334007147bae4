"""Text functions, Column -> Column.

All of them are projections: no shuffle, no Python worker.  ``(?U)`` gives regular expressions
Unicode meaning for letters, digits and spaces, independent of the Java version.  A null text
counts as an empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions.numeric import bind, constant_list


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (``F.trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null (``regexp_extract`` alone gives an empty string)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def is_blank(c: Column) -> Column:
    """True when nothing but white space is left; stops at the first other character."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def is_empty_document(c: Column, min_chars: int = rules.MIN_TEXT_CHARS) -> Column:
    return F.length(strip(blank_if_null(c))) < min_chars


# --- cleaning -------------------------------------------------------------------------------------

def clean(c: Column, word_bounded: bool = False) -> Column:
    """Text for the classifier: links, RT/cc, tags, handles, punctuation, non-ASCII become spaces.

    RT/cc go wherever they stand, also inside words ("account" -> "a ount"), as the models were
    trained that way; ``word_bounded=True`` removes them only as words.
    """
    retweet = r"\b(?:RT|cc)\b" if word_bounded else "RT|cc"
    steps = [r"(?U)http\S+\s?", retweet, r"(?U)#\S+\s?", r"(?U)@\S+", rules.PUNCTUATION, r"[^\x00-\x7f]"]
    c = blank_if_null(c)
    for pattern in steps:
        c = F.regexp_replace(c, pattern, " ")
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_trailing(c: Column) -> Column:
    """Older variant: a link or tag is removed only with the white space after it; no final strip."""
    steps = [r"(?U)http\S+\s", "RT|cc", r"(?U)#\S+\s", r"(?U)@\S+", rules.PUNCTUATION, r"[^\x00-\x7f]"]
    c = blank_if_null(c)
    for pattern in steps:
        c = F.regexp_replace(c, pattern, " ")
    return F.regexp_replace(c, r"\s+", " ")


def to_latin1(c: Column) -> Column:
    """Typographic characters to their plain form, anything else outside Latin-1 to ``?``.

    A text with as many bytes as characters is ASCII and stays as it is.
    """
    said = c = blank_if_null(c)
    for char, plain in rules.LATIN1_ONE_TO_MANY.items():
        c = F.replace(c, F.lit(char), F.lit(plain))
    one = rules.LATIN1_ONE_TO_ONE
    c = F.translate(c, "".join(one), "".join(one.values()))
    return F.when(F.octet_length(said) == F.length(said), said).otherwise(F.regexp_replace(c, r"[^\x{0}-\x{FF}]", "?"))


# --- words ----------------------------------------------------------------------------------------

WORD_OF_FOUR = r"(?<![\p{L}\p{N}_])[a-z]{4,}+(?![\p{L}\p{N}_])"


def long_words(c: Column) -> Column:
    """Lower-cased words of four or more letters a-z, in order, with repeats."""
    return all_matches(F.lower(blank_if_null(c)), WORD_OF_FOUR)


def keywords(c: Column, stopwords: Sequence[str] = rules.STOPWORDS) -> Column:
    """Distinct long words without stopwords."""
    return F.array_except(long_words(c), constant_list(stopwords))


def tokens(c: Column) -> Column:
    """Tokens of the text vectoriser: lower-cased runs of two or more word characters."""
    return all_matches(F.lower(blank_if_null(c)), r"[\p{L}\p{N}_]{2,}")


def has_words(c: Column) -> Column:
    return blank_if_null(c).rlike(r"[\p{L}\p{N}_]")


# --- case -----------------------------------------------------------------------------------------

def title_case(c: Column) -> Column:
    """Capital after every non-letter: "c++ node.js" -> "C++ Node.Js" (``initcap`` knows spaces only)."""
    pieces = all_matches(c, r"\p{L}+|\P{L}+")
    return F.array_join(F.transform(pieces, F.initcap), "")


def display_case(c: Column) -> Column:
    """Title case, but only for names that came all in lower case."""
    return F.when(c == F.lower(c), title_case(c)).otherwise(c)


def capitalize_words(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"(?U)\s+"), F.initcap), " ")


def snippet(c: Column, chars: int = rules.SNIPPET_CHARS) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


# --- counting -------------------------------------------------------------------------------------

def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def count_unusual(c: Column) -> Column:
    """Counted one by one: a plain search for each character is cheaper than a pattern over the whole text, and ASCII needs none."""
    counted = sum((count_char(c, char) for char in rules.UNUSUAL_CHARS[1:-1]), F.lit(0))
    return F.when(F.octet_length(c) == F.length(c), F.lit(0)).otherwise(counted)


def count_capital_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?=[A-Z])(?<![\p{L}\p{N}_])[A-Z]{4,}+(?![\p{L}\p{N}_])"))


def count_blank_runs(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\n{4,}"))


def count_long_paragraphs(c: Column, chars: int = 500) -> Column:
    return F.size(F.filter(F.split(c, "\n\n"), lambda p: F.length(p) > chars))


def count_numbers(c: Column) -> Column:
    """Numbers that quantify something: 20, 20%, 5+, 10k (on lower-cased text)."""
    return F.regexp_count(F.lower(c), F.lit("(?U)" + rules.NUMBERS))


def line_counts(c: Column) -> Column:
    """struct(total, bullets): non-blank lines and lines that open with a bullet."""
    return bind(lines(c), lambda rows: F.struct(
        F.size(F.filter(rows, lambda l: l.rlike(r"(?U)\S"))).alias("total"),
        F.size(F.filter(rows, lambda l: l.rlike("(?U)" + rules.BULLET_LINE))).alias("bullets"),
    ))


# --- sections -------------------------------------------------------------------------------------

def split_sections(c: Column) -> Column:
    """array<struct<section, body>>: text under each heading line, "header" before the first.

    A repeated heading replaces the earlier body and keeps the earlier place.  A heading with no
    line after it yields no section.  All in the row: heading positions cut the line array.
    """
    heading = "(?iU)" + rules.SPLIT_HEADING
    named = F.transform(lines(blank_if_null(c)), lambda l: F.struct(
        l.alias("line"), F.lower(F.regexp_extract(strip(l), heading, 1)).alias("name")))

    def starts(rows: Column) -> Column:
        marked = F.transform(rows, lambda r, i: F.struct((i + 1).alias("at"), r["name"].alias("name")))
        header = F.array(F.struct(F.lit(0).alias("at"), F.lit("header").alias("name")))
        return F.concat(header, F.filter(marked, lambda h: h["name"] != ""))

    def blocks(rows: Column) -> Column:
        return bind(starts(rows), lambda heads: F.filter(
            F.transform(heads, lambda h, k: F.struct(
                h["name"].alias("section"),
                F.slice(rows, h["at"] + 1, F.coalesce(F.get(heads, k + 1)["at"], F.size(rows) + 1) - h["at"] - 1).alias("rows"),
            )),
            lambda b: F.size(b["rows"]) > 0,
        ))

    def last_bodies(kept: Column) -> Column:
        names = F.array_distinct(F.transform(kept, lambda b: b["section"]))
        return F.transform(names, lambda n: F.struct(n.alias("section"), strip(F.array_join(F.transform(
            F.element_at(F.filter(kept, lambda b: b["section"] == n), -1)["rows"], lambda r: r["line"]), "\n")).alias("body")))

    return bind(named, lambda rows: bind(blocks(rows), last_bodies))
