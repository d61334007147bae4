"""Quality rules: a threshold table compiled into one projection, without user functions.

Measures of a document (a null text counts as empty, so all are 0):

* ``n_words``, ``word_chars``: words and the code points in them;
* ``n_symbols``: characters of ``[#*$%&|<>]``;
* ``n_lines``, ``n_dup_lines``: lines (split at ``\\n``) with a word, and those equal to an earlier line;
* ``n_repeat_words``: words inside three-word windows that occur at least twice in the text, the first included;
* ``n_stop_words``: words of the stop list, whatever their case;
* ``n_shouts``: words that end in two exclamation marks.

Nothing here shuffles: a row depends on its own text alone, so empty tables, repeated rows, null
ids and extra columns pass through (``measured`` and ``judged`` keep every column of the input; a
measure replaces an input column of the same name only in the output of ``judged_rows``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import SPACE, WORD, fresh, or_empty

MIN_WORDS = 50
#: Bits for a window's place in its text; 2**27 words are more than a string of Spark can hold apart.
PLACE_BITS = 27
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this", "are", "at", "not",
    "der", "die", "das", "und", "ist", "ein", "eine", "den", "von", "zu", "mit", "für", "dem", "nicht", "im", "auf", "des",
    "le", "la", "les", "de", "et", "un", "une", "est", "que", "dans", "pour", "du", "par", "pas", "au", "en",
    "el", "los", "las", "y", "del", "es", "no", "una", "para", "con", "se",
]


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= part / whole <= high``; an open end is None, and so is a whole of 0."""

    name: str
    part: str
    whole: str | None
    low: float | None
    high: float | None


RULES = [
    Rule("length", "n_words", None, MIN_WORDS, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("shouts", "n_shouts", "n_words", None, 0.2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.5),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouts"]


def passes(rule: Rule, measure: dict[str, Column]) -> Column:
    value = measure[rule.part].cast("double")
    if rule.whole is not None:
        value = value / F.nullif(measure[rule.whole], F.lit(0)).cast("double")
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low)
    if rule.high is not None:
        ok = ok & (value <= rule.high)
    return F.coalesce(ok, F.lit(True))


def verdict(measure: dict[str, Column], rules: list[Rule] = RULES) -> Column:
    """The threshold table as one condition."""
    kept = F.lit(True)
    for rule in rules:
        kept = kept & passes(rule, measure)
    return kept


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measures, and the names under which they were added.

    The word list and the sorted windows become columns of their own before a lambda looks
    into them, so that they are made once for a row and not once for an element.
    """
    name = {m: fresh(docs, m) for m in [*MEASURES, "words_", "grams_", "maybe_", "sorted_", "lines_"]}
    words, grams, maybe, ordered, lines = (F.col(f"`{name[x]}`") for x in ("words_", "grams_", "maybe_", "sorted_", "lines_"))
    value = or_empty(F.col(f"`{text}`"))
    window = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    df = docs.withColumns({
        name["words_"]: F.regexp_extract_all(value, F.lit(WORD), F.lit(0)),
        name["lines_"]: F.filter(F.split(value, "\n"), lambda line: line.rlike(WORD)),
        name["word_chars"]: F.char_length(F.regexp_replace(value, SPACE, "")).cast("long"),
        name["n_symbols"]: F.regexp_count(value, F.lit("[#*$%&|<>]")).cast("long"),
    })
    # a window is first told by bits of its hash with its place in the low bits, so that sorting longs brings equal ones together
    df = df.withColumn(name["grams_"], F.when(F.size(words) >= 4, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.shiftleft(F.xxhash64(*window(i)), PLACE_BITS).bitwiseOR(i.cast("long"))))))
    same = lambda x, y: F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.lit(False))
    df = df.withColumn(name["maybe_"], F.filter(grams, lambda g, j: same(g, F.get(grams, j - 1)) | same(g, F.get(grams, j + 1))))
    # those that agree in the bits are compared as text; a word has no space in it, so three of them joined by spaces stand for the window
    place = lambda g: g.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    df = df.withColumn(name["sorted_"], F.when(F.size(maybe) > 0, F.sort_array(F.transform(
        maybe, lambda g: F.struct(F.concat_ws(" ", *window(place(g))).alias("g"), place(g).alias("i"))))))
    alike = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    twice = F.filter(ordered, lambda s, j: alike(s, F.get(ordered, j - 1)) | alike(s, F.get(ordered, j + 1)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    df = df.withColumns({
        name["n_words"]: F.size(words).cast("long"),
        name["n_lines"]: F.size(lines).cast("long"),
        name["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        name["n_repeat_words"]: F.when(ordered.isNotNull(), F.size(covered)).otherwise(F.lit(0)).cast("long"),
        name["n_stop_words"]: F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        name["n_shouts"]: F.regexp_count(value, F.lit(r"!!(?![^\x20\x09-\x0D])")).cast("long"),
    })
    return df.drop(*(name[x] for x in ("words_", "grams_", "maybe_", "sorted_", "lines_"))), {m: name[m] for m in MEASURES}


def judged(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> tuple[DataFrame, str]:
    """``docs`` with one boolean column more, true where every rule passes; and that column's name."""
    df, name = measured(docs, text)
    flag = fresh(df, "kept")
    return df.withColumn(flag, verdict({m: F.col(f"`{n}`") for m, n in name.items()}, rules)).select(*[f"`{c}`" for c in docs.columns], f"`{flag}`"), flag


def kept_rows(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their columns unchanged.

    A filter would be pushed below the projections that build the word lists, and build them anew for each
    word; a generator of one or no row stays above them.
    """
    df, flag = judged(docs, text, rules)
    return df.withColumn(flag, F.explode(F.when(F.col(f"`{flag}`"), F.array(F.lit(1))))).drop(flag)


def judged_rows(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``."""
    df, name = measured(docs.select("doc_id", "text"))
    m = {k: F.col(v) for k, v in name.items()}
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return df.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & verdict(m)).alias("kept"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
per_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
per_word AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars, count(*) FILTER (WHERE lower(word) IN ({_STOPS})) AS stops,
  count(*) FILTER (WHERE word LIKE '%!!') AS shouts FROM pos GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(p.n, 0)::BIGINT AS n_words, coalesce(p.chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_lines, 0)::BIGINT AS n_lines,
  coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(p.stops, 0)::BIGINT AS n_stop_words,
  coalesce(p.shouts, 0)::BIGINT AS n_shouts
  FROM d LEFT JOIN per_word p USING (doc_id) LEFT JOIN per_line l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_symbols / n_words::DOUBLE <= 0.2
  AND n_stop_words / n_words::DOUBLE >= 0.05 AND n_shouts / n_words::DOUBLE <= 0.2
  AND (n_lines = 0 OR n_dup_lines / n_lines::DOUBLE <= 0.5) AS kept FROM f
"""
