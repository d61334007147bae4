"""Golden values of scores, skills and gaps; invariants of the match plan."""

import pytest
from pyspark.sql import functions as F

from places import SMALL
from talentloom.functions import score as S
from talentloom.functions import text as T
from talentloom.operators import gap as G
from talentloom.operators import skills as K
from talentloom.plans import match as M
from talentloom.plans import report as R
from talentloom.plans.inputs import AS_OF_YEAR, Inputs


def test_section_score(value):
    five = ["contact", "summary", "skills", "experience", "education"]
    assert value(S.section_score, five) == 100.0 and value(S.missing_sections, five) == []
    assert value(S.section_score, []) == 0.0
    assert value(S.missing_sections, []) == ["contact", "education", "experience", "objective", "skills", "summary"]


@pytest.mark.parametrize("n,score", [(5, 20), (199, 20), (200, 60), (400, 100), (4000, 100), (4001, 80), (8000, 80), (8001, 40)])
def test_length_score(value, n, score):
    assert value(S.length_score, "x" * n) == score


def test_bullets(value):
    text = "\nSummary\nI am.\n\nExperience\n- Built\n- Designed\n- Led\n\nSkills\nPython\n "
    assert value(lambda c: S.bullet_score(T.line_counts(c)), text) == 100.0
    assert value(lambda c: S.bullet_score(T.line_counts(c)), " ") == 0.0
    assert value(lambda c: S.bullet_score(T.line_counts(c)), "1. a\n2) b\na) c") == 70.0


@pytest.mark.parametrize("parts,score", [(0, 0.0), (1, 33.3), (2, 66.7), (3, 100.0)])
def test_contact(spark, parts, score):
    row = [("n" if parts > 0 else None, "e" if parts > 1 else None, "p" if parts > 2 else None)]
    df = spark.createDataFrame(row, "name string, email string, phone string").select(F.struct("*").alias("c"))
    assert df.select(S.contact_score(F.col("c"))).first()[0] == score


@pytest.mark.parametrize("years,score", [(10.0, 100), (7.0, 75), (5.0, 50), (4.0, 25)])
def test_experience(value, years, score):
    assert value(lambda y: S.experience_match(y, F.lit(10.0), F.lit(True)), years) == score
    assert value(lambda y: S.experience_match(y, F.lit(10.0), F.lit(False)), years) == 75
    assert value(lambda y: S.experience_match(y, F.lit(None).cast("double"), F.lit(True)), years) == 50


@pytest.mark.parametrize("level,required,score", [(4, 4, 100), (3, 4, 70), (2, 4, 30), (0, 0, 50)])
def test_education(value, level, required, score):
    assert value(lambda a, b: S.education_match(a, b, F.lit(True)), level, required) == score


def test_bands(value):
    assert [value(S.band, x) for x in (75.0, 50.0, 25.0, 24.9)] == [1, 2, 3, 4]


def small_rules(spark):
    entries = [("AWS", [], "c"), ("AWS Lambda", ["lambda"], "c"), ("C++", ["cpp"], "c"), ("C#", [], "c"), ("Spring Boot", ["spring"], "c"), ("Python", [], "c"), ("Java", [], "c"), ("SQL", [], "c"), ("Docker", [], "c"),
               ("React", [], "c"), ("Machine Learning", ["ml"], "c"), ("JavaScript", ["js"], "c"), ("Natural Language Processing", ["nlp"], "c"),
               ("Care of the very old at home", ["very old at home care"], "c")]
    table = spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "entry int, name string, aliases array<string>, category string")
    return K.SkillRules(K.taxonomy_forms(table, "entry"), K.alias_table(spark, table, "entry"))


@pytest.fixture(scope="module")
def rules(spark):
    return small_rules(spark)


def overlap(spark, rules, mine, theirs):
    rows = spark.createDataFrame([("a", s) for s in mine] + [("b", s) for s in theirs], "side string, skill string")
    keyed = {r["side"]: r["skill_keys"] for r in K.skill_lists(rows, "side", "skill", rules.aliases).collect()}
    both = spark.createDataFrame([(keyed["a"], keyed["b"])], "a array<struct<key: string, name: string>>, b array<struct<key: string, name: string>>")
    return both.select(K.skill_overlap(F.col("a"), F.col("b")).alias("o")).first()["o"]


def test_overlap_through_aliases(spark, rules):
    o = overlap(spark, rules, ["ML", "Python", "JS"], ["Machine Learning", "JavaScript", "React"])
    assert (o["matched"], o["missing"], o["extra"], o["overlap_pct"]) == (["JS", "ML"], ["React"], ["Python"], 66.7)
    same = overlap(spark, rules, ["Python", "Java"], ["Python", "Java"])
    assert same["overlap_pct"] == 100.0 and same["missing"] == []


def test_alias_precedence(spark):
    taxonomy = spark.createDataFrame([(0, "rest", ["api"], "c"), (1, "Kube", ["k8s", "kb"], "c"), (2, "Other", ["kb"], "c")],
                                     "entry int, name string, aliases array<string>, category string")
    m = {r["alias"]: r["canonical"] for r in K.alias_table(spark, taxonomy, "entry").collect()}
    assert m["rest"] == "rest"          # a canonical name stands for itself
    assert m["k8s"] == "kubernetes"     # built-in alias before the taxonomy's
    assert m["kb"] == "kube"            # first entry wins
    assert m["api"] == "api"


def test_phrases_overlap_and_stop_at_line_ends(spark, rules):
    df = spark.createDataFrame([(1, "AWS Lambda, C++ & c#; spring\nboot. natural-language processing")], "id int, text string")
    assert rules.with_skills(df, "id", "text").first()["skills"] == ["AWS", "AWS Lambda", "C#", "C++", "Natural Language Processing", "Spring Boot"]
    rows = K.phrase_hits(df, "id", "text", rules.forms)
    assert sorted(r["canonical"] for r in rows.collect()) == ["AWS", "AWS Lambda", "C#", "C++", "Natural Language Processing", "Spring Boot"]


def test_long_phrases_and_texts_without_any(spark, rules):
    df = spark.createDataFrame([(1, "Care of the very old at home, and more"), (2, "very old at home care"), (3, None), (4, "care of the very old")], "id int, text string")
    got = {r["id"]: r["skills"] for r in rules.with_skills(df, "id", "text").collect()}
    assert got == {1: ["Care of the very old at home"], 2: ["Care of the very old at home"], 3: [], 4: []}


def test_large_dictionary(spark):
    table = spark.range(50_000).select(F.col("id").alias("entry"), F.concat(F.lit("trade number "), "id").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("c").alias("category"))
    big = K.SkillRules(K.taxonomy_forms(table, "entry"), K.alias_table(spark, table, "entry"))
    df = spark.createDataFrame([(1, "trade number 49999 or Trade number 7")], "id int, text string")
    assert big.with_skills(df, "id", "text").first()["skills"] == ["trade number 49999", "trade number 7"]


def test_missing_keywords(spark):
    jd = spark.createDataFrame([(1, "team data data team cloud costs costs costs pipe pipe")], "id int, text string")
    words = G.repeated_words(jd, "id", "text").first()["repeated"]
    assert words == ["costs", "team", "data", "pipe"]
    df = spark.createDataFrame([("I love databases", words)], "t string, w array<string>")
    assert df.select(G.missing_keywords(F.col("t"), F.col("w"))).first()[0] == ["costs", "team", "pipe"]


def _match(spark, apps, resumes, jds, **kw):
    return M.match(spark.createDataFrame(apps, "application_id long, resume_id long, jd_id long"),
                   spark.createDataFrame(resumes, "resume_id long, text string"),
                   spark.createDataFrame(jds, "jd_id long, text string"), small_rules(spark), AS_OF_YEAR, **kw)


GOOD = ("John Doe\njohn@example.com\n123-456-7890\n\nSummary\nExperienced developer.\n\nExperience\n- Developed scalable APIs and microservices for 5 years."
        "\n- Managed team of 4 engineers.\n\nEducation\nBachelor of Science in Computer Science.\n\nSkills\nPython, Java, SQL, AWS, Docker")


def test_match_with_and_without_opening(spark):
    apps = [(1, 1, 1), (2, 1, None), (3, 2, 1), (4, 1, 2)]
    rows = {r["application_id"]: r for r in _match(spark, apps, [(1, GOOD), (2, "bad")], [(1, "Python developer, 5 years of experience, bachelor"), (2, "  ")]).collect()}
    assert rows[1]["has_jd"] and rows[1]["experience_match"] == 100.0 and rows[1]["education_match"] == 100.0 and rows[1]["skill_pct"] == 100.0
    assert not rows[2]["has_jd"] and rows[2]["overall"] == rows[2]["ats_total"] and rows[2]["contact_score"] == 100.0
    assert rows[2]["missing"] == [] and "Python" in rows[2]["extra"]
    assert rows[3]["ats_total"] < rows[1]["ats_total"] and rows[3]["contact_score"] == 0.0
    assert not rows[4]["has_jd"] and rows[4]["overall"] == rows[2]["overall"]


def test_hot_resume_and_hot_opening_give_the_same_result(spark):
    """One résumé and one opening hold most pairs: the salted joins change nothing."""
    apps = [(i, 0 if i % 3 else i % 5, 1 if i % 2 else i % 4) for i in range(120)]
    resumes, jds = [(i, GOOD.replace("John", f"John{chr(97 + i)}")) for i in range(5)], [(i, f"Python role {i}, {i + 2} years experience") for i in range(4)]
    keep = ("application_id", "overall", "skill_pct", "semantic", "ats_total")
    plain = sorted(_match(spark, apps, resumes, jds).select(*keep).collect())
    salted = sorted(_match(spark, apps, resumes, jds, hot_rows=10).select(*keep).collect())
    assert len(plain) == 120 and plain == salted


def test_match_invariants_and_report(spark):
    t = Inputs(spark, SMALL)
    m = M.match(t.applications, t.resumes.select("resume_id", "text"), t.jds, t.skill_rules, AS_OF_YEAR).cache()
    assert m.count() == t.applications.count()
    scores = ["overall", "semantic", "skill_pct", "experience_match", "education_match", "ats_total", "keyword_score"]
    assert m.filter(" OR ".join(f"{c} < 0 OR {c} > 100 OR {c} IS NULL" for c in scores)).count() == 0
    assert m.filter("size(array_intersect(matched, missing)) > 0").count() == 0
    lines = R.report_lines(m)
    assert lines.filter("value IS NULL").count() == 0
    assert lines.filter("section = 'feedback' AND label NOT IN ('warning', 'info')").count() == 0
    m.unpersist()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scored_rows_meet_nothing_more_and_names_are_shown_once(spark):
    """The words that a text lacks meet the bare applications, and no name is put into its shown form for a pair."""
    m = _match(spark, [(1, 1, 1), (2, 1, None)], [(1, GOOD)], [(1, "Kotlin teams; teams use Python and kotlin")])
    rows = {r["application_id"]: r for r in m.collect()}
    assert rows[1]["missing_keywords"] == ["kotlin", "teams"] and rows[2]["missing_keywords"] == []
    plan = _plan(m).splitlines()
    assert "resume_id" in next(line for line in plan if "Join" in line)
    above = "".join(plan[:next(i for i, line in enumerate(plan) if "Join" in line)])
    assert "initcap" not in above


def test_phrases_are_sought_once(spark):
    docs = spark.createDataFrame([(1, GOOD)], "id long, text string")
    assert "posexplode" not in _plan(small_rules(spark).attach(docs.select("id"), docs, "id", "text"))


def test_report_values_become_latin1_as_rows(spark):
    m = _match(spark, [(1, 1, None)], [(1, GOOD.replace("John Doe", "John Doe—漢"))], [(1, "Python")])
    lines = R.report_lines(m)
    inline = next(line for line in _plan(lines).splitlines() if "inline(" in line)
    assert "regexp_replace" not in inline and "filter(" not in inline
    assert lines.filter("section IS NULL OR value IS NULL OR label IS NULL").count() == 0


# --- phrase index and vectors ---


@pytest.mark.parametrize("limit", [1000, 0])
def test_phrase_index_equals_a_scan(spark, limit):
    """Sent out and joined by shuffles; forms inside forms, repeated tokens, line ends, a token that stands everywhere."""
    import random
    import re

    from talentloom.operators import skills as K

    rng = random.Random(3)
    words = ["a", "b", "c", "d+", "e.f", "of"]
    forms = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)} | {"of", "a a", "a a a"})
    texts = [(i, " ".join(rng.choices(words + ["of", "\n", "zz"], k=rng.randint(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (82, "of " * 3000)]
    table = spark.createDataFrame([(f, f.upper()) for f in forms], "form string, canonical string")
    got = K.phrase_hits(spark.createDataFrame(texts, "key int, text string"), "key", "text", table, limit).collect()

    def said(text):
        tokens = re.findall(r"[\w+#.]*[\w+#]|\n", (text or "").lower())
        return {f.upper() for f in forms for n in [len(f.split())] if any(tokens[i:i + n] == f.split() for i in range(len(tokens)))}

    assert sorted(map(tuple, got)) == sorted((i, f) for i, text in texts for f in said(text))


def test_counts_and_cosine_in_the_row(spark):
    from talentloom.operators import vectors as V

    rows = [(["b", "a", "b"], ["b", "c"]), ([], ["a"]), (["x"] * 400 + [f"t{i}" for i in range(300)], ["x", "t7", "t8", "zz"]), (None, ["a"]), (["é", "e"], ["e", "é", "f"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(V.run_counts(F.col("a")).alias("a"), V.run_counts(F.col("b")).alias("b"))

    def part(c, name):
        return F.transform(F.col(c), lambda e: e[name].cast("double") if name == "tf" else e[name])

    got = df.select("a", V.sparse_dot(part("a", "term"), part("a", "tf"), part("b", "term"), part("b", "tf")).alias("dot")).collect()
    for (a, b), r in zip(rows, got):
        want = {w: (a or []).count(w) for w in a or []}
        assert a is None or [(e["term"], e["tf"]) for e in r["a"]] == sorted(want.items())
        assert r["dot"] == sum(n * b.count(w) for w, n in want.items())


def test_a_report_belongs_to_one_application(spark):
    """Jobs and the reply of a résumé stand in the report of each of its applications; empty summary and reason leave no line."""
    t = Inputs(spark, SMALL)
    few = t.applications.filter("resume_id IN (1, 2, 4)")
    scored = M.match(few, t.resumes.select("resume_id", "text"), t.jds, t.skill_rules, AS_OF_YEAR)
    jobs = spark.createDataFrame([(1, k, f"role {k}", 90.0 - k, "") for k in range(1, 11)], "resume_id long, rank int, role string, score double, snippet string")
    columns = "reply_id long, ord int, summary string, category string, severity string, original string, suggestion string, explanation string, error string"
    parsed = spark.createDataFrame([(1, 1, "good", "Skills", "high", "", "add x", "since y", None), (1, 2, "good", "Impact", "low", "", "cut z", "", None), (2, 1, "", "General", "medium", "", "say w", "", None),
                                    (4, None, "only", None, None, None, None, None, None)], columns)
    rows = R.application_report(scored, few, jobs, parsed, "reply_id").collect()
    assert {r.application_id for r in rows} == {r.application_id for r in scored.collect()}
    for a in few.collect():
        mine = [r for r in rows if r.application_id == a.application_id]
        assert all((r.resume_id, r.jd_id) == (a.resume_id, a.jd_id) for r in mine) and any(r.section == "scores" for r in mine)
        assert sum(r.section == "jobs" for r in mine) == (8 if a.resume_id == 1 else 0)
        told = sorted((r.ord, r.label, r.value, r.band) for r in mine if r.section == "suggestions")
        assert told == {1: [(0, "Summary", "good", None), (1, "Why", "since y", None), (1, "[Skills] HIGH", "add x", 1), (2, "[Impact] LOW", "cut z", 3)], 2: [(1, "[General] MEDIUM", "say w", 2)], 4: []}[a.resume_id]
