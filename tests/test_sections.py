"""Section similarity over every application, against plain Python."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import pytest

from talentloom.plans.queries.vectors import sim_sections

RESUMES = [(1, "Skills\npython spark data\nEducation\nlaw school"), (2, "Skills\nEducation"), (3, "plain words about spark"), (4, "Skills\n  "), (5, "nobody applied spark")]
JDS = [(10, "python data wanted"), (11, "law school spark wanted"), (12, "skills education")]
APPLICATIONS = [(100, 1, 11), (101, 1, 10), (102, 1, 10), (103, 2, 12), (104, 3, 10), (105, 3, 11), (106, 4, 10), (107, 1, None)]
#: What the reference compares for each résumé.
SECTIONS = {1: {"skills": "python spark data", "education": "law school"}, 2: {"overall": "Skills\nEducation"}, 3: {"header": "plain words about spark"}, 4: {}}


def test_every_application_has_its_sections(spark):
    t = SimpleNamespace(resumes=spark.createDataFrame(RESUMES, "resume_id long, text string"), jds=spark.createDataFrame(JDS, "jd_id long, text string"),
                        applications=spark.createDataFrame(APPLICATIONS, "application_id long, resume_id long, jd_id long"))
    words = lambda s: re.findall(r"\w\w+", s.lower())
    df = Counter(w for _, text in RESUMES for w in set(words(text)))

    def vector(text):
        v = {w: n * (math.log((1 + len(RESUMES)) / (1 + df[w])) + 1) for w, n in Counter(words(text)).items() if w in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    jds, want = dict(JDS), {}
    for a, r, j in APPLICATIONS:
        for section, body in SECTIONS[r].items() if j else ():
            v, w = vector(body), vector(jds[j])
            want[a, r, j, section] = 100 * sum(x * w.get(k, 0) for k, x in v.items())
    rows = sim_sections(t).collect()
    got = {(r.application_id, r.resume_id, r.jd_id, r.section): r.similarity for r in rows}
    assert len(rows) == len(want) and set(got) == set(want)
    assert got == pytest.approx(want, abs=0.006)


def test_vectors_of_sections_do_not_travel_with_applications(spark, monkeypatch):
    """Only ids and the short vectors of openings move with the applications; sections are joined last."""
    from talentloom.operators import joins
    t = SimpleNamespace(resumes=spark.createDataFrame(RESUMES, "resume_id long, text string"), jds=spark.createDataFrame(JDS, "jd_id long, text string"),
                        applications=spark.createDataFrame(APPLICATIONS, "application_id long, resume_id long, jd_id long"))
    moved, join = [], joins.skew_join
    monkeypatch.setattr(joins, "skew_join", lambda many, *a, **k: moved.append(set(many.columns)) or join(many, *a, **k))
    sim_sections(t)
    assert moved and not any({"section", "terms", "weights"} & columns for columns in moved)
