"""The whole report of an application: its lines, the jobs of its résumé, the reply about it."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import suggestions as G
from talentloom.plans import report as R
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.aggregates import PARSED
from talentloom.plans.queries.matching import REPORT, matches
from talentloom.plans.queries.registry import query
from talentloom.plans.queries.vectors import TOPN, recommended
from talentloom.session import stored

# The reply about a résumé has the résumé's id.
_JOBS = f"""{TOPN} SELECT resume_id, 'jobs' AS section, rank AS ord, role AS label,
    printf('%d.%d%%', floor(score)::INT, round_even((score - floor(score)) * 10, 0)::INT) AS value, {Q.band('score')} AS band FROM recs WHERE rank <= 8"""
_ADVICE = f"""WITH {PARSED} SELECT reply_id AS resume_id, 'suggestions' AS section, 0 AS ord, 'Summary' AS label, summary AS value, NULL::INT AS band FROM p WHERE ord = 1 AND summary <> ''
    UNION ALL SELECT reply_id, 'suggestions', ord, '[' || category || '] ' || upper(severity), suggestion, CASE lower(severity) WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END FROM p WHERE ord IS NOT NULL
    UNION ALL SELECT reply_id, 'suggestions', ord, 'Why', explanation, NULL FROM p WHERE explanation <> ''"""


@query("sink_application_report", f"""
    WITH whole AS (SELECT application_id, resume_id, jd_id, section, ord::INT AS ord, label, value, band FROM ({REPORT})),
    told AS (SELECT resume_id, section, ord::INT AS ord, label, value, band FROM ({_JOBS}) UNION ALL SELECT resume_id, section, ord::INT, label, value, band FROM ({_ADVICE}))
    SELECT * FROM whole UNION ALL SELECT application_id, a.resume_id, jd_id, section, ord, label, value, band FROM applications a JOIN told USING (resume_id)""")
def sink_application_report(t):
    applications, resumes = stored(t.applications, "applications"), stored(t.resumes.select("resume_id", "text"), "resumes")
    parsed = G.parse_replies(t.replies, "reply_id", "json", 3)
    scored = matches(t, missing_words=True, applications=applications, resumes=resumes)
    return R.application_report(scored, applications, recommended(t, resumes), parsed, "reply_id").withColumn("band", F.col("band").cast("int"))
