"""Counts, metrics, data checks, suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import score as S
from talentloom.functions import text as T
from talentloom.operators import metrics as A
from talentloom.operators import quality as D
from talentloom.operators import suggestions as G
from talentloom.plans.report import suggestion_lines
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.registry import query
from talentloom.session import stored


@query("agg_value_counts", "SELECT source, count(*) AS rows FROM documents GROUP BY source ORDER BY rows DESC, source")
def agg_value_counts(t):
    return A.value_counts(t.documents, "source").orderBy(F.desc("rows"), "source")


@query("agg_class_share", """
    SELECT category, count(*) AS rows, round((count(*) * 100)::DECIMAL(30, 6) / (SELECT count(*) FROM resumes), 1)::DOUBLE AS percent FROM resumes GROUP BY category""")
def agg_class_share(t):
    return A.class_share(t.resumes, "category")


@query("agg_nunique", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def agg_nunique(t):
    return t.documents.agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("agg_nunique_sketches")
def agg_nunique_sketches(t):
    """Distinct customers of each month and order status, merged from one stored sketch a day."""
    daily = stored(A.distinct_sketches(t.orders.withColumn("day", F.to_date("o_orderdate")), ["day", "o_orderstatus"], "o_custkey"), "sketches")
    return A.merged_distinct(daily.withColumn("month", F.date_trunc("month", "day").cast("date")), ["month", "o_orderstatus"])


@query("agg_shape_nulls", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM jobs" for c in ("row_id", "role", "features")))
def agg_shape_nulls(t):
    return A.shape_nulls(t.jobs)


@query("agg_avg_length", "SELECT avg(length(coalesce(features, ''))) AS avg_chars FROM jobs")
def agg_avg_length(t):
    return A.average_length(t.jobs, "features")


@query("agg_first_per_role", """
    SELECT role, arg_min(features, row_id) FILTER (WHERE features IS NOT NULL) AS features FROM jobs WHERE role IS NOT NULL GROUP BY role""")
def agg_first_per_role(t):
    return A.first_per_role(t.jobs, "role", "features", "row_id")


@query("agg_max_class", "SELECT max(n) AS max_rows FROM (SELECT count(*) AS n FROM resumes GROUP BY category)")
def agg_max_class(t):
    return A.value_counts(t.resumes, "category").agg(F.max("rows").alias("max_rows"))


@query("top_counts", "SELECT role, count(*) AS rows FROM jobs WHERE role IS NOT NULL GROUP BY role ORDER BY rows DESC, role LIMIT 10")
def top_counts(t):
    return A.value_counts(t.jobs.filter("role IS NOT NULL"), "role").orderBy(F.desc("rows"), "role").limit(10)


# --- classification metrics on rule-made predictions -----------------------------------------------

@query("agg_confusion", "SELECT y, yhat, count(*) AS rows FROM predictions GROUP BY y, yhat")
def agg_confusion(t):
    return A.confusion(t.predictions, "y", "yhat")


@query("agg_accuracy", "SELECT avg((y = yhat)::INT) AS accuracy FROM predictions")
def agg_accuracy(t):
    return A.accuracy(t.predictions, "y", "yhat")


def _report(preds: str, y: str = "y", yhat: str = "yhat") -> str:
    return f"""
        k AS (SELECT {y} AS c FROM {preds} UNION SELECT {yhat} FROM {preds}),
        n AS (SELECT c, (SELECT count(*) FROM {preds} p WHERE p.{y} = c AND p.{yhat} = c) AS tp, (SELECT count(*) FROM {preds} p WHERE p.{y} = c) AS ty,
                     (SELECT count(*) FROM {preds} p WHERE p.{yhat} = c) AS tp_all FROM k),
        pr AS (SELECT c, ty, CASE WHEN tp_all = 0 THEN 0 ELSE tp::DOUBLE / tp_all::DOUBLE END AS p, CASE WHEN ty = 0 THEN 0 ELSE tp::DOUBLE / ty::DOUBLE END AS r FROM n),
        f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2.0::DOUBLE * p * r / (p + r) END AS f1 FROM pr)"""


@query("agg_class_report", f"""
    WITH {_report('predictions')} SELECT c AS class, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, ty AS support FROM f""")
def agg_class_report(t):
    r = A.class_report(t.predictions, "y", "yhat")
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("agg_f1_macro_weighted", f"WITH {_report('predictions')} SELECT round(avg(f1), 9) AS f1_macro, round(sum(f1 * ty) / sum(ty), 9) AS f1_weighted FROM f")
def agg_f1_macro_weighted(t):
    return A.f1_scores(t.predictions, "y", "yhat").select(*[F.round(c, 9).alias(c) for c in ("f1_macro", "f1_weighted")])


# Four rule classifiers over the labelled documents; one "fails", two tie.
_RUNS = {"a_long": "CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END", "b_all": "1", "c_all": "1", "d_none": "0"}


@query("agg_best_model", "WITH lab AS (SELECT l.quality AS y, d.n_chars AS n_chars FROM documents d JOIN labels l USING (doc_id)), "
       + ", ".join(f"p_{m} AS (SELECT y, {e} AS yhat FROM lab), w_{m} AS (WITH {_report('p_' + m)} SELECT sum(f1 * ty) / sum(ty) AS s FROM f)" for m, e in _RUNS.items())
       + ", runs AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, s FROM w_{m}" for m in _RUNS if m != "a_long") + ")"
       + " SELECT model, round(s, 9) AS f1_weighted FROM runs ORDER BY s DESC, model LIMIT 1")
def agg_best_model(t):
    lab = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(F.col("quality").alias("y"), "n_chars")
    runs = [A.f1_scores(lab.select("y", F.expr(e).alias("yhat")), "y", "yhat").select(
        F.lit(m).alias("model"), "f1_weighted", F.lit("failed" if m == "a_long" else None).cast("string").alias("error")) for m, e in _RUNS.items()]
    return A.best_model(reduce(lambda a, b: a.unionByName(b), runs)).select("model", F.round("f1_weighted", 9).alias("f1_weighted"))


# --- data checks --------------------------------------------------------------------------------------

_OVERLAP = """SELECT row_id, len(list_filter(r, lambda w: list_contains(f, w)))::DOUBLE / greatest(len(r), 1)::DOUBLE AS s FROM (
        SELECT row_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(role, '')), '\\s+'), lambda w: w <> '')) AS r,
               regexp_split_to_array(lower(coalesce(features, '')), '\\s+') AS f FROM jobs)"""
_VERDICT = "CASE WHEN leaky_percent > 50 THEN 'confirmed' WHEN leaky_percent > 20 THEN 'possible' ELSE 'none' END"
_LEAK = f"""ov0 AS ({_OVERLAP}), lk0 AS (SELECT count(*) AS sampled, avg(s) AS avg_overlap, avg((s >= 0.5)::INT) * 100 AS leaky_percent FROM ov0),
    lk AS (SELECT *, {_VERDICT} AS verdict FROM lk0)"""


@query("agg_leakage_report", f"WITH {_LEAK} SELECT sampled, round(avg_overlap, 9) AS avg_overlap, round(leaky_percent, 9) AS leaky_percent, verdict FROM lk")
def agg_leakage_report(t):
    r = D.leakage_report(t.jobs, "role", "features", "row_id")
    return r.select("sampled", F.round("avg_overlap", 9).alias("avg_overlap"), F.round("leaky_percent", 9).alias("leaky_percent"), "verdict")


def _row(source, check, key, value, status, tail=""):
    return f"SELECT '{source}' AS source, '{check}' AS \"check\", {key} AS key, ({value})::DOUBLE AS value, {status} AS status {tail}"


@query("ev_quality_report", f"""
    WITH {_LEAK}, rc AS (SELECT category, count(*) AS n FROM resumes GROUP BY category), jc AS (SELECT role, count(*) AS n FROM jobs WHERE role IS NOT NULL GROUP BY role) """
       + " UNION ALL ".join([
           _row("resumes", "rows", "''", "count(*)", "'info'", "FROM resumes"), _row("resumes", "columns", "''", "3", "'info'"),
           _row("resumes", "avg_chars", "'text'", "round(avg(length(coalesce(text, ''))))", "'info'", "FROM resumes"),
           *[_row("resumes", "nulls", f"'{c}'", f"count(*) FILTER (WHERE {c} IS NULL)", "'info'", "FROM resumes") for c in ("resume_id", "text", "category")],
           _row("resumes", "classes", "''", "count(*)", "'info'", "FROM rc"),
           _row("resumes", "small_classes", "''", "count(*) FILTER (WHERE n < 30)", "CASE WHEN count(*) FILTER (WHERE n < 30) > 0 THEN 'warning' ELSE 'ok' END", "FROM rc"),
           _row("resumes", "class_rows", "category", "n", "CASE WHEN n < 30 THEN 'warning' ELSE 'ok' END", "FROM rc"),
           _row("jobs", "rows", "''", "count(*)", "'info'", "FROM jobs"), _row("jobs", "columns", "''", "3", "'info'"),
           _row("jobs", "roles", "''", "count(*)", "'info'", "FROM jc"),
           "SELECT * FROM (" + _row("jobs", "top_role", "role", "n", "'info'", "FROM jc ORDER BY n DESC, role LIMIT 10") + ")",
           _row("jobs", "leakage_avg", "verdict", "round(avg_overlap, 6)", "CASE WHEN verdict = 'none' THEN 'ok' ELSE 'warning' END", "FROM lk"),
           _row("jobs", "leakage_percent", "verdict", "round(leaky_percent, 6)", "CASE WHEN verdict = 'none' THEN 'ok' ELSE 'warning' END", "FROM lk"),
       ]))
def ev_quality_report(t):
    return D.resume_checks(t.resumes, "category", "text").unionByName(D.job_checks(t.jobs, "role", "features", "row_id"))


# --- lists --------------------------------------------------------------------------------------------

@query("sort_skills", """
    SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '; ') AS kinds FROM events GROUP BY user_id""")
def sort_skills(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), "; ").alias("kinds"))


@query("lim_first_k", f"SELECT doc_id, array_to_string({Q.words('text')}[1:4], '; ') AS opening FROM documents")
def lim_first_k(t):
    return t.documents.select("doc_id", F.array_join(F.slice(T.long_words(F.col("text")), 1, 4), "; ").alias("opening"))


@query("set_union_all", "SELECT lang, count(*) AS rows, count(DISTINCT doc_id) AS docs FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE lang = 'en') GROUP BY lang")
def set_union_all(t):
    both = A.union_all([t.documents.select("doc_id", "lang"), t.documents.filter("lang = 'en'").select("doc_id", "lang")])
    return both.groupBy("lang").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))


# --- suggestions --------------------------------------------------------------------------------------

@query("llm_prompt_rows", """
    SELECT application_id, md5('## Resume:' || chr(10) || r.text[1:4000] || chr(10) || chr(10) || '## Job Description:' || chr(10) || coalesce(j.text, '')[1:2000]
        || chr(10) || chr(10) || 'Provide up to 10 improvement suggestions.') AS prompt
    FROM applications a JOIN resumes r USING (resume_id) LEFT JOIN jds j ON j.jd_id = a.jd_id""")
def llm_prompt_rows(t):
    from talentloom.operators.joins import skew_join
    # only the part of a text that a request holds travels to the join
    openings = t.jds.select("jd_id", F.substring("text", 1, 2000).alias("jd_text"))
    people = t.resumes.select("resume_id", F.substring("text", 1, 4000).alias("text"))
    pairs = skew_join(t.applications, openings, "jd_id", "application_id")
    both = skew_join(pairs, people, "resume_id", "application_id", "inner", count_on=t.applications)
    return both.select("application_id", F.md5(G.prompt(F.col("text"), F.col("jd_text"))).alias("prompt"))


PARSED = """
    ok AS (SELECT reply_id, json, json_valid(json) AS valid FROM replies),
    s AS (SELECT reply_id, json, unnest(range(1, least(3, coalesce(json_array_length(json, '$.suggestions'), 0))::BIGINT + 1)) AS ord FROM ok WHERE valid),
    e AS (SELECT reply_id, ord, json_extract(json, '$.suggestions[' || (ord - 1) || ']') AS x FROM s),
    p AS (SELECT ok.reply_id, e.ord AS ord, CASE WHEN valid THEN coalesce(ok.json ->> '$.summary', '') ELSE '' END AS summary,
        CASE WHEN e.ord IS NOT NULL THEN coalesce(x ->> '$.category', 'General') END AS category, CASE WHEN e.ord IS NOT NULL THEN coalesce(x ->> '$.severity', 'medium') END AS severity,
        CASE WHEN e.ord IS NOT NULL THEN coalesce(x ->> '$.original', '') END AS original, CASE WHEN e.ord IS NOT NULL THEN coalesce(x ->> '$.suggestion', '') END AS suggestion,
        CASE WHEN e.ord IS NOT NULL THEN coalesce(x ->> '$.explanation', '') END AS explanation, CASE WHEN NOT valid THEN 'reply is not valid JSON' END AS error
        FROM ok LEFT JOIN e USING (reply_id))"""


@query("llm_parse_rows", f"WITH {PARSED} SELECT reply_id, ord::INT AS ord, summary, category, severity, original, suggestion, explanation, error FROM p")
def llm_parse_rows(t):
    return G.parse_replies(t.replies, "reply_id", "json", 3)


@query("llm_severity_rank", f"""
    WITH {PARSED} SELECT CASE lower(severity) WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank, count(*) AS rows FROM p WHERE ord IS NOT NULL GROUP BY 1""")
def llm_severity_rank(t):
    rows = G.parse_replies(t.replies, "reply_id", "json", 3).filter("ord IS NOT NULL")
    return rows.groupBy(S.severity_rank(F.col("severity")).alias("severity_rank")).agg(F.count("*").alias("rows"))


@query("report_suggestions", f"""
    WITH {PARSED} SELECT reply_id, 'suggestions' AS section, ord::INT AS ord, '[' || category || '] ' || upper(severity) AS label, suggestion AS value,
        CASE lower(severity) WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS band FROM p WHERE ord IS NOT NULL""")
def report_suggestions(t):
    return suggestion_lines(G.parse_replies(t.replies, "reply_id", "json", 3), "reply_id")
