"""Building blocks of the check queries, in the SQL dialect of DuckDB.

Written from the contracts, not from the Spark plans: other functions, other shapes (joins and
grouping where the plans work inside the row).
"""

from __future__ import annotations

import re

from talentloom import rules
from talentloom.plans.inputs import AS_OF_YEAR, CTES, TAXONOMY


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_inputs(sql: str) -> str:
    """Prepend the derived tables a query names."""
    used = [n for n in CTES if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{n} AS ({CTES[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}'))"


def lit_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


STOP = lit_list(rules.STOPWORDS)


def keywords(x: str) -> str:
    return f"list_filter(list_distinct({words(x)}), lambda w: NOT list_contains({STOP}, w))"


def overlap_count(a: str, b: str) -> str:
    return f"len(list_filter(list_distinct({a}), lambda w: list_contains({b}, w)))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def round1(x: str) -> str:
    """One decimal by exact remainder: 10x = 8x + 2x with its rounding error."""
    s, a, b = "(v * 8.0::DOUBLE + v * 2.0::DOUBLE)", "(v * 8.0::DOUBLE)", "(v * 2.0::DOUBLE)"
    err = f"(({a} - ({s} - ({s} - {a}))) + ({b} - ({s} - {a})))"
    tie = f"({s} - floor({s}) = 0.5::DOUBLE)"
    body = (f"CASE WHEN {tie} AND {err} > 0 THEN floor({s}) + 1 WHEN {tie} AND {err} < 0 THEN floor({s}) "
            f"ELSE round_even({s}, 0) END / 10.0::DOUBLE")
    return f"list_transform([({x})::DOUBLE], lambda v: {body})[1]"


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
            f"lambda p: upper(p[1]) || lower(p[2:])), '')")


def display(x: str) -> str:
    return f"CASE WHEN {x} = lower({x}) THEN {title_case(x)} ELSE {x} END"


def find_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def first_seen(x: str) -> str:
    """Distinct list items in order of first appearance."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def sections(x: str) -> str:
    arms = ", ".join(f"CASE WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN '{n}' END" for n, p in rules.SECTION_PATTERNS.items())
    return f"list_filter([{arms}], lambda s: s IS NOT NULL)"


def degrees(x: str) -> str:
    return first_seen("list_concat(" + ", ".join(find_all(x, "(?i)" + p) for p in rules.DEGREE_PATTERNS) + ")")


def fields(x: str) -> str:
    return f"list_filter({lit_list(rules.STUDY_FIELDS)}, lambda f: contains(lower({x}), lower(f)))"


def institutions(x: str) -> str:
    return first_seen(find_all(x, rules.INSTITUTION))


def education(x: str) -> str:
    return f"list_transform([list_concat({degrees(x)}, {fields(x)}, {institutions(x)})], lambda l: {first_seen('l')})[1]"


def titles(x: str) -> str:
    found = "list_concat(" + ", ".join(find_all(x, "(?i)" + p) for p in rules.TITLE_PATTERNS) + ")"
    return f"list_transform([list_transform({found}, lambda t: {strip('t')})], lambda l: {first_seen('l')})[1]"


def degree_level(x: str) -> str:
    arms = ", ".join(f"CASE WHEN contains(lower({x}), {q(k)}) THEN {v} ELSE 0 END" for k, v in rules.DEGREE_LEVELS.items())
    return f"greatest({arms})"


def email(x: str) -> str:
    return f"nullif(regexp_extract({x}, {q(rules.EMAIL)}), '')"


def phone(x: str) -> str:
    found = strip(f"regexp_extract({x}, {q(rules.PHONE)})")
    return f"CASE WHEN length(regexp_replace({found}, '[^0-9]', '', 'g')) >= 7 THEN {found} END"


def name(x: str) -> str:
    """By lines as rows of a list: first five, filters, first."""
    top5 = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')[1:5]"
    words_ = "regexp_split_to_array(l, '\\s+')"
    ok = (f"NOT regexp_matches(l, '[@:|0-9]|http|www\\.') AND len({words_}) BETWEEN 2 AND 4 "
          f"AND len(list_filter({words_}, lambda w: list_contains({lit_list(rules.NOT_A_NAME)}, lower(w)))) = 0 "
          f"AND len(list_filter({words_}, lambda w: NOT regexp_full_match(w, '[A-Za-z''.-]+'))) = 0")
    best = f"list_filter({top5}, lambda l: {ok})[1]"
    return (f"array_to_string(list_transform(regexp_split_to_array({best}, '\\s+'), lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def experience_section_ctes(table: str, key: str) -> str:
    """CTE text: (key, section) by line rows and windows."""
    return f"""
        es_lines AS (SELECT {key}, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM {table}),
        es_flag AS (SELECT *, regexp_matches(line, {q('(?i)' + rules.EXPERIENCE_HEADING)}) AS h, regexp_matches(line, {q('(?i)' + rules.OTHER_HEADING)}) AS o FROM es_lines),
        es_start AS (SELECT {key}, min(n) AS first_h FROM es_flag WHERE h GROUP BY {key}),
        es_stop AS (SELECT f.{key}, min(n) AS stop FROM es_flag f JOIN es_start s USING ({key}) WHERE o AND n > first_h GROUP BY f.{key}),
        es AS (SELECT f.{key}, nullif(string_agg(line, chr(10) ORDER BY n), '') AS section FROM es_flag f JOIN es_start s USING ({key})
               LEFT JOIN es_stop t USING ({key}) WHERE n > first_h AND n < coalesce(stop, 1000000000) AND NOT h GROUP BY f.{key})"""


def years_sum(x: str) -> str:
    def side(p):
        starts, ends = find_all(x, "(?i)" + p, 1), find_all(x, "(?i)" + p, 2)
        return (f"coalesce(list_sum(list_transform(list_zip({starts}, {ends}), lambda z: CASE WHEN z[1]::INT BETWEEN {rules.EARLIEST_YEAR} AND {AS_OF_YEAR} "
                f"AND coalesce(nullif(z[2], '')::INT, {AS_OF_YEAR}) BETWEEN z[1]::INT AND {AS_OF_YEAR + 1} "
                f"THEN coalesce(nullif(z[2], '')::INT, {AS_OF_YEAR}) - z[1]::INT ELSE 0 END)), 0)")
    return f"({side(rules.MONTH_YEAR_RANGE)} + {side(rules.YEAR_RANGE)})::DOUBLE"


def years_max(x: str) -> str:
    return f"list_max(list_transform({find_all(x, '(?i)' + rules.YEARS_MENTION, 1)}, lambda y: y::DOUBLE))"


def jd_years(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {q('(?i)' + p)}, 1), '')::DOUBLE" for p in rules.JD_YEARS) + ")"


PHRASE_TOKEN = "[\\p{L}\\p{N}_+#.]*[\\p{L}\\p{N}_+#]"
LONGEST_FORM = max(len(form.split()) for name, others, _ in TAXONOMY for form in (name, *others))


def forms_ctes() -> str:
    """CTE text: forms(form, canonical) and alias map am(alias, canonical)."""
    builtin = ", ".join(f"({q(k)}, {q(v)})" for k, v in rules.SKILL_ALIASES.items())
    return f"""
        tx AS (SELECT * FROM taxonomy),
        forms AS (SELECT form, name AS canonical, category FROM (
            SELECT *, array_to_string(regexp_extract_all(lower(raw), {q(PHRASE_TOKEN)}), ' ') AS form FROM tx)
            QUALIFY row_number() OVER (PARTITION BY form ORDER BY entry, pos) = 1),
        am AS (SELECT alias, canonical FROM (
            SELECT lower(trim(name)) AS alias, lower(trim(name)) AS canonical, 0 AS p, entry AS e FROM tx
            UNION ALL SELECT a, c, 1, 0 FROM (VALUES {builtin}) AS b(a, c)
            UNION ALL SELECT lower(trim(raw)), lower(trim(name)), 2, entry FROM tx WHERE pos > 0)
            QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p, e) = 1)"""


def skills_ctes(table: str, key: str, out: str) -> str:
    """CTE text: out(key, skill) by exploding lines into tokens and joining runs of all lengths of the taxonomy."""
    grams = " UNION ALL ".join(
        f"SELECT DISTINCT {key}, array_to_string(toks[i:i+{n}], ' ') AS form FROM (SELECT {key}, toks, unnest(range(1, len(toks) + 1 - {n})) AS i FROM {out}_tok)"
        for n in range(LONGEST_FORM))
    return f"""
        {out}_tok AS (SELECT {key}, regexp_extract_all(line, {q(PHRASE_TOKEN)}) AS toks FROM (
            SELECT {key}, unnest(string_split(lower(text), chr(10))) AS line FROM {table})),
        {out}_gram AS ({grams}),
        {out} AS (SELECT DISTINCT {key}, canonical AS skill FROM {out}_gram JOIN forms USING (form))"""


def keyed_ctes(skills: str, key: str, out: str) -> str:
    """CTE text: out(key, k, shown), the first spelling per normalised skill."""
    return f"""
        {out} AS (SELECT {key}, coalesce(am.canonical, lower(trim(skill))) AS k, skill AS shown FROM {skills}
            LEFT JOIN am ON am.alias = lower(trim(skill))
            QUALIFY row_number() OVER (PARTITION BY {key}, coalesce(am.canonical, lower(trim(skill))) ORDER BY skill) = 1)"""


def missing_sections(found: str) -> str:
    f = f"CASE WHEN list_contains({found}, 'summary') OR list_contains({found}, 'objective') THEN list_concat({found}, ['summary', 'objective']) ELSE {found} END"
    return f"list_sort(list_filter({lit_list(rules.EXPECTED_SECTIONS)}, lambda e: NOT list_contains({f}, e)))"


def length_score(x: str) -> str:
    return f"(CASE WHEN length({x}) < 200 THEN 20 WHEN length({x}) < 400 THEN 60 WHEN length({x}) <= 4000 THEN 100 WHEN length({x}) <= 8000 THEN 80 ELSE 40 END)::DOUBLE"


def nonblank_lines(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(l, '\\S')))"


def bullet_lines(x: str) -> str:
    pats = ["^\\s*[-•●◦▪→►]", "^\\s*\\d+[.)]\\s", "^\\s*[a-z][.)]\\s"]
    cond = " OR ".join(f"regexp_matches(l, {q(p)})" for p in pats)
    return f"len(list_filter(string_split({x}, chr(10)), lambda l: {cond}))"


def bullet_score(total: str, bullets: str) -> str:
    r = f"({bullets}::DOUBLE / {total}::DOUBLE)"
    return f"(CASE WHEN {total} = 0 THEN 0 WHEN {r} < 0.1::DOUBLE THEN 30 WHEN {r} < 0.25::DOUBLE THEN 60 WHEN {r} > 0.8::DOUBLE THEN 70 ELSE 100 END)::DOUBLE"


def count_re(x: str, pattern: str) -> str:
    return f"len({find_all(x, pattern)})"


def format_counts(x: str) -> dict[str, str]:
    caps = f"len(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{4,}}')))"
    return {
        "unusual": count_re(x, rules.UNUSUAL_CHARS), "pipes": f"length({x}) - length(replace({x}, '|', ''))", "capitals": caps,
        "paragraphs": f"len(list_filter(string_split({x}, chr(10) || chr(10)), lambda p: length(p) > 500))",
        "blank_runs": count_re(x, "\\n{4,}"),
    }


def formatting_score(x: str) -> str:
    n = format_counts(x)
    return (f"greatest(100 - CASE WHEN {n['unusual']} > 5 THEN 15 ELSE 0 END - CASE WHEN {n['pipes']} > 10 THEN 10 ELSE 0 END "
            f"- CASE WHEN {n['capitals']} > 10 THEN 10 ELSE 0 END - CASE WHEN {n['paragraphs']} > 2 THEN 10 ELSE 0 END "
            f"- CASE WHEN {n['blank_runs']} > 2 THEN 5 ELSE 0 END, 0)::DOUBLE")


def band(x: str) -> str:
    return f"CASE WHEN {x} >= 75 THEN 1 WHEN {x} >= 50 THEN 2 WHEN {x} >= 25 THEN 3 ELSE 4 END"


def fb(key: str, value: str | None = None) -> str:
    t = rules.FEEDBACK[key]
    if value is None:
        return q(t)
    a, b = t.split("{}")
    return f"{q(a)} || ({value})::VARCHAR || {q(b)}"


def messages(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in pairs) + "], lambda m: m IS NOT NULL)"


def latin1(x: str) -> str:
    for k, v in rules.LATIN1_ONE_TO_MANY.items():
        x = f"replace({x}, {q(k)}, {q(v)})"
    for k, v in rules.LATIN1_ONE_TO_ONE.items():
        x = f"replace({x}, {q(k)}, {q(v)})"
    return f"regexp_replace({x}, '[^\\x00-\\xFF]', '?', 'g')"


def tfidf_ctes(docs: str, key: str, out: str, corpus: str | None = None, grams2: bool = False, sublinear: bool = False,
               top: int | None = None) -> str:
    """CTE text: out(key, term, w) with unit length per document."""
    corpus = corpus or docs

    def counts(table: str) -> str:
        one = f"SELECT {key}, t.toks, unnest(range(1, len(t.toks) + 1)) AS i FROM (SELECT {key}, {tokens('text')} AS toks FROM {table}) t"
        uni = f"SELECT {key}, toks[i] AS term FROM ({one})"
        if grams2:
            uni += f" UNION ALL SELECT {key}, toks[i] || ' ' || toks[i + 1] FROM ({one}) WHERE i < len(toks)"
        return f"SELECT {key}, term, count(*) AS tf FROM ({uni}) GROUP BY {key}, term"

    tf = "1 + ln(tf)" if sublinear else "tf"
    cut = f" ORDER BY sum(tf) DESC, term LIMIT {top}" if top else ""
    same = docs == corpus
    return f"""
        {out}_c AS ({counts(docs)}), {out}_b AS ({f'SELECT * FROM {out}_c' if same else counts(corpus)}),
        {out}_v AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM {corpus}))::DOUBLE / (1 + count(*))::DOUBLE) + 1 AS idf FROM {out}_b GROUP BY term{cut}),
        {out}_r AS (SELECT {key}, term, ({tf}) * idf AS raw FROM {out}_c JOIN {out}_v USING (term)),
        {out} AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS w FROM {out}_r)"""
