"""Golden values of text functions and extraction."""

import pytest
from pyspark.sql import functions as F

from talentloom.functions import extract as X
from talentloom.functions import text as T
from talentloom.functions.numeric import round1


@pytest.mark.parametrize("x", [12.45, 0.15, 0.25, 0.35, 2.5, 33.333, 66.66666, 99.95, 0.05, 12.05, 47.85, 8.649999999, 100.0])
def test_round1_follows_binary_value(value, x):
    assert value(round1, x) == round(x, 1)


@pytest.mark.parametrize("text,expected", [
    ("Contact me at john@example.com for info", "john@example.com"), ("No email here", None),
    ("jane.doe+tag@company.co.uk is my email", "jane.doe+tag@company.co.uk"),
])
def test_email(value, text, expected):
    assert value(X.email, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Call me at (123) 456-7890", "(123) 456-7890"), ("No phone here", None), ("from 2018-2023 at", "2018-2023"),
    ("id 123456 then 555-123-4567", None),
])
def test_phone(value, text, expected):
    assert value(X.phone, text) == expected


def test_name(value):
    assert value(X.name, "Resume\njohn@x.org\n  mary-jane o'NEIL \nBob Stone") == "Mary-jane O'neil"
    assert value(X.name, "a\nb\nc\nd\ne\nJohn Doe") is None
    assert value(X.name, "Senior Engineer\nhttpx www.y z") is None


def test_sections(value):
    text = "\n   Education\n BS\n\n Experience\n x\n Skills\n Python"
    assert value(X.sections, text) == ["skills", "experience", "education"]
    assert value(X.sections, "Just some random text") == []


@pytest.mark.parametrize("text,years", [
    ("I have 5 years of experience in software", 5.0), ("Software Engineer | 2018 - 2023", 0.0), ("Fresh graduate", 0.0),
    ("Experience\nJan 2018 - Mar 2020", 2.0), ("Experience\nJan 2018 - 2020", 4.0), ("Experience\nJan 2018 - Present", 16.0),
    ("Experience\n2018 - 2020", 2.0), ("Experience\nJan 2018 to Mar 2020", 2.0), ("Experience\n1950 - 1960", 0.0),
    ("Experience\nEducation\n2010 - 2014", 0.0), ("Experience:\na\nWork History\n3 yrs\nSkills\n9 years", 3.0),
])
def test_years(value, text, years):
    assert value(lambda c: X.experience_years(c, 2026), text) == years


def test_years_merged(value):
    text = "Experience\n2010 - 2014\n2012 - 2015\n2018 - 2019"
    assert value(lambda c: X.experience_years(c, 2026), text) == 8.0
    assert value(lambda c: X.experience_years(c, 2026, merge_intervals=True), text) == 6.0


def test_degrees(value):
    text = "B.S. in CS; Bachelor of Science; BSc; will be B.Tech."
    assert value(X.degrees, text) == ["B.S", "Bachelor of Science", "BSc", "be", "B.Tech"]
    assert value(X.degree_level, "B.S") == 0
    assert value(X.degree_level, "needs a B.S. degree") == 3
    assert value(lambda c: X.degree_level(c, undot=True), "B.S") == 3
    assert value(X.highest_degree, ["Diploma", "MBA", "Finance"]) == 4


def test_titles(value):
    assert "Senior Developer" in value(X.job_titles, "I worked as a Software Engineer and later as a Senior Developer")
    found = value(X.job_titles, "Project Manager at XYZ Corp, previously Product Director")
    assert found == ["Manager", "Director", "Project Manager", "Product Director"]


def test_listed_skills(value):
    assert value(lambda c: X.listed_skills(c, ["SQL", "C++", "python", "SQL"]), "C++11, Python and sql") == ["SQL", "C++", "python", "SQL"]
    assert value(lambda c: X.listed_skills(c, ["C++"]), "C++ and") == []
    assert value(lambda c: X.listed_keywords(c, ["data science", "law"]), "Data Science; lawyer") == ["Data Science"]


def test_clean(value):
    assert value(T.clean, "account #x @y http://z ") == "a ount"
    assert value(lambda c: T.clean(c, word_bounded=True), "account RT x") == "account x"
    assert value(T.clean_trailing, "http://z") == "http z"


def test_latin1(value):
    assert value(T.to_latin1, "a—b “q” → ok… ™ é 漢") == 'a-b "q" -> ok... (TM) é ?'
    assert value(T.to_latin1, None) == ""


def test_case(value):
    assert value(T.title_case, "c++ node.js o'neil") == "C++ Node.Js O'Neil"
    assert value(T.display_case, "ML") == "ML"
    assert value(T.display_case, "machine learning") == "Machine Learning"


def test_keywords_respect_accents(value):
    assert sorted(value(T.keywords, "Étudiant should build pipelines; pipelines, abcé abcd_ data")) == ["build", "data", "pipelines"]


def test_split_sections(value):
    text = "intro\nSkills:\nPython\nSummary\none\nskills\nSQL\nEducation"
    rows = [(r["section"], r["body"]) for r in value(T.split_sections, text)]
    assert rows == [("header", "intro"), ("skills", "SQL"), ("summary", "one")]
    assert [r["section"] for r in value(T.split_sections, "Skills\nx")] == ["skills"]


def test_null_texts(value):
    for f in (X.sections, X.job_titles, X.education, T.keywords, T.split_sections):
        assert value(f, None) in ([],) or f is T.split_sections
    assert value(lambda c: X.experience_years(c, 2026), None) == 0.0
    assert value(T.is_empty_document, None) is True


def test_facts_do_not_depend_on_partitioning(spark):
    from places import SMALL
    from talentloom.plans.inputs import Inputs

    resumes = Inputs(spark, SMALL).resumes
    pick = [X.name(F.col("text")).alias("n"), X.education(F.col("text")).alias("e")]
    one = {tuple(map(str, r)) for r in resumes.coalesce(1).select("resume_id", *pick).collect()}
    many = {tuple(map(str, r)) for r in resumes.repartition(7).select("resume_id", *pick).collect()}
    assert one == many


def test_patterns_are_tried_only_where_a_word_they_need_stands(spark):
    """Letters that a match without case takes for i, s and k count as those; plain searches stand before the patterns."""
    rows = ["Analy\u017ft", "\u212a\u0131 eng\u0131neer", "per\u017fonal details", "D\u0130PLOMA", "none of it"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1)
    found = df.select(X.job_titles(F.col("t")).alias("a"), X.sections(F.col("t")).alias("b"), X.degrees(F.col("t")).alias("c"))
    told = [tuple(r) for r in found.collect()]
    assert [t[0] for t in told] == [["Analy\u017ft"], ["eng\u0131neer"], [], [], []]
    assert told[2][1] == ["contact"] and told[3][2] == ["D\u0130PLOMA"] and told[4] == ([], [], [])
    assert "contains" in found._jdf.queryExecution().optimizedPlan().toString().lower()
