"""What a report of many applications must not do over again: texts, looks at terms, lines outside generated code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from places import SMALL
from talentloom import rules
from talentloom.functions import extract as X
from talentloom.functions import text as T
from talentloom.operators import vectors as V
from talentloom.plans.inputs import Inputs
from talentloom.plans.queries import matching, reports
from talentloom.plans.report import report_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dot_products_looked_up_and_merged_are_the_same(spark, monkeypatch):
    """Sums agree to the last bit with one pass over both lists, whichever way is taken; empty, null and disjoint vectors give 0, and a term
    that stands several times meets as many as there are in the other list."""
    rng = random.Random(3)

    def vector():
        terms = sorted(rng.sample([f"t{i}" for i in range(120)], rng.choice([0, 1, 5, 100])))
        return terms, [rng.random() for _ in terms]

    rows = [(i, *vector(), *vector()) for i in range(60)] + [(60, None, None, ["a"], [1.0]), (61, ["a"], [1.0], None, None), (62, ["a"], [0.5], ["b"], [1.0])]
    rows += [(63, ["a", "a", "b"], [0.1, 0.2, 0.3], ["a", "b"], [0.5, 0.7]), (64, ["a", "b", "b"], [0.1, 0.2, 0.3], ["b", "b", "b"], [0.5, 0.6, 0.7]), (65, ["b"], [0.1], ["a", "b", "b"], [0.5, 0.6, 0.7])]
    df = spark.createDataFrame(rows, "id int, a array<string>, x array<double>, b array<string>, y array<double>")
    want = {}
    for k, a, x, b, y in rows:
        i, j, total = 0, 0, 0.0
        while i < len(a or []) and j < len(b or []):
            total += x[i] * y[j] if a[i] == b[j] else 0.0
            i, j = i + (a[i] <= b[j]), j + (a[i] >= b[j])
        want[k] = total
    for few in (0, 64, 1000):
        monkeypatch.setattr(V, "FEW_SHARED", few)
        got = {r.id: r.d for r in df.select("id", V.sparse_dot(F.col("a"), F.col("x"), F.col("b"), F.col("y")).alias("d")).collect()}
        assert got == want
    assert any(len(set(a or []) & set(b or [])) > 64 for _, a, _, b, _ in rows)


def test_texts_are_put_together_once(spark):
    """All that reads the texts of résumés reads them from one stored table, not each time from the given one."""
    inputs = Inputs(spark, SMALL)
    assert "customer" not in _plan(matching.matches(inputs, missing_words=True))
    assert "customer" not in _plan(reports.sink_application_report(inputs))


def test_report_lines_are_made_in_generated_code(spark):
    """The step that makes rows of the lines stands in generated code, which a function of arrays in it would rule out."""
    scored = matching.matches(Inputs(spark, SMALL), missing_words=True).limit(5)
    path = matching.stored(scored, "scored")
    lines = [x for x in _plan(report_lines(path)).split("\n") if "Generate inline" in x]
    assert lines and all("*(" in x for x in lines)


@pytest.mark.parametrize("c", ["t", "upper(t)"])
def test_titles_are_those_of_the_plain_patterns(spark, c):
    """Tests of first letters and of words change nothing, with other forms of i, s and k and words put together too."""
    rng = np.random.default_rng(5)
    words = ["Senior", "LEAD", "ſenior", "Staff", "chief", "Software", "Full-Stack", "full stack", "Data", "ML", "ai", "QA", "test", "Engineer", "Architect", "ſcientist", "Manager", "DİRECTOR", "Project",
             "HR", "Finance", "Head", "VP", "SVP", "cto", "CİO", "cıo", "a", "acme", "x1", "_", "9", "—", "Specialist", "Administrator", "Engineers", "Technical", "Officer", "Consultant"]
    parts = [" ", "  ", "\n", "\t", "", ", ", "-", " "]
    texts = [("".join(words[w] + parts[p] for w, p in zip(rng.integers(0, len(words), n), rng.integers(0, len(parts), n))),) for n in rng.integers(1, 12, 3000)]
    df = spark.createDataFrame([*texts, (None,), ("",)], "t string").select(F.expr(c).alias("t"))
    every = F.concat(*[T.all_matches(T.blank_if_null(F.col("t")), X.ANY_CASE + p) for p in rules.TITLE_PATTERNS])
    plain = F.array_distinct(F.filter(F.transform(every, T.strip), lambda t: t != ""))
    titles = X.job_titles(F.col("t"))
    assert df.filter(~titles.eqNullSafe(plain)).collect() == [] and df.filter(F.size(titles) > 0).count() > 1000
    assert "transform(concat" not in str(titles)  # there the text would be lower-cased for each word
