"""Similarity, recommendation, text vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import text as T
from talentloom.functions.numeric import clamp
from talentloom.operators import recommend as R
from talentloom.operators import topk
from talentloom.operators import vectors as V
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.registry import query
from talentloom.plans.queries.texts import SECTION_ROWS
from talentloom.plans.report import job_lines

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("sim_cosine", f"""
    WITH head AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), b AS (SELECT e.label AS label, embedding FROM embeddings e JOIN head USING (vec_id))
    SELECT a.vec_id AS vec_id, round(least(greatest({_DOT}, 0), 1) * 100, 2) AS similarity FROM embeddings a JOIN b ON a.label = b.label""")
def sim_cosine(t):
    """Each vector against the first vector of its label: given pairs, one multiplication each."""
    head = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    pairs = t.embeddings.join(head, "label")
    return pairs.select("vec_id", V.similarity_score(V.dot(F.col("embedding"), F.col("first"))).alias("similarity"))


@query("rec_exact", f"""
    WITH heads AS (SELECT arg_min(struct_pack(vec_id := vec_id, embedding := embedding), vec_id) AS h FROM embeddings GROUP BY label),
    b AS (SELECT h.vec_id AS vec_id, h.embedding AS embedding FROM heads),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_DOT}, 6) + 0.0 AS similarity FROM embeddings a, b)
    SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id)::INT AS rank FROM s) WHERE rank <= 10""")
def rec_exact(t):
    """All vectors against a catalogue of one vector per label."""
    heads = t.embeddings.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("h"))
    return topk.top_n(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
                      heads.select(F.col("h.vec_id").alias("item_id"), F.col("h.embedding").alias("vector")), 10, 64)


_CATALOGUE = "cat AS (SELECT role AS id, coalesce(arg_min(features, row_id) FILTER (WHERE features IS NOT NULL), '') AS text FROM jobs WHERE role IS NOT NULL GROUP BY role)"
TOPN = f"""
    WITH {_CATALOGUE}, posts AS (SELECT 'p' || resume_id AS id, text FROM resumes),
    {Q.tfidf_ctes('cat', 'id', 'tc')}, {Q.tfidf_ctes('posts', 'id', 'tp', corpus='cat')},
    dots AS (SELECT tp.id AS q, tc.id AS role, sum(tp.w * tc.w) AS d FROM tp JOIN tc USING (term) GROUP BY 1, 2),
    s AS (SELECT p.id AS q, c.id AS role, c.text AS features, round(coalesce(d, 0), 6) AS similarity FROM posts p, cat c LEFT JOIN dots ON dots.q = p.id AND dots.role = c.id),
    best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, role)::INT AS rank FROM s),
    recs AS (SELECT q[2:]::BIGINT AS resume_id, rank, role, {Q.round1('least(greatest(similarity * 100, 0), 100)')} AS score,
             CASE WHEN length(features) > 200 THEN features[1:200] || '...' ELSE features END AS snippet FROM best WHERE rank <= 10)"""


def recommended(t, resumes=None):
    catalogue = R.job_catalogue(t.jobs, "role", "features", "row_id")
    return R.recommend(t.resumes.select("resume_id", "text") if resumes is None else resumes, catalogue, "resume_id", "text")


@query("rec_topn", f"{TOPN} SELECT * FROM recs")
def rec_topn(t):
    return recommended(t)


@query("win_rank_number", f"{TOPN} SELECT rank, count(*) AS rows, max(score) AS best, min(score) AS worst FROM recs GROUP BY rank")
def win_rank_number(t):
    return recommended(t).groupBy("rank").agg(F.count("*").alias("rows"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query("report_jobs", f"""{TOPN} SELECT resume_id, 'jobs' AS section, rank AS ord, role AS label,
       printf('%d.%d%%', floor(score)::INT, round_even((score - floor(score)) * 10, 0)::INT) AS value, {Q.band('score')} AS band FROM recs WHERE rank <= 8""")
def report_jobs(t):
    return job_lines(recommended(t))


@query("rec_build", f"WITH {_CATALOGUE}, {Q.tfidf_ctes('cat', 'id', 'v')} SELECT id AS role, term, round(w, 9) AS weight FROM v")
def rec_build(t):
    catalogue = R.job_catalogue(t.jobs, "role", "features", "row_id").toDF("role", "text")
    return _long(V.tfidf_vectors(catalogue, "role", "text"), "role")


def _long(vectors, key):
    return vectors.select(key, F.inline(F.arrays_zip("terms", "weights"))).select(key, F.col("terms").alias("term"), F.round("weights", 9).alias("weight"))


@query("cls_tfidf_default", f"WITH d AS (SELECT doc_id, text FROM documents), {Q.tfidf_ctes('d', 'doc_id', 'v')} SELECT doc_id, term, round(w, 9) AS weight FROM v")
def cls_tfidf_default(t):
    return _long(V.tfidf_vectors(t.documents, "doc_id", "text"), "doc_id")


@query("cls_tfidf", f"""
    WITH d AS (SELECT doc_id, text FROM documents), {Q.tfidf_ctes('d', 'doc_id', 'v', grams2=True, sublinear=True, top=10000)} SELECT doc_id, term, round(w, 9) AS weight FROM v""")
def cls_tfidf(t):
    return _long(V.tfidf_vectors(t.documents, "doc_id", "text", max_features=10_000, with_bigrams=True, sublinear=True), "doc_id")


_NEXT = "lead(id) OVER (ORDER BY id)"


@query("sim_text_tfidf", f"""
    WITH d AS (SELECT doc_id, text FROM documents), {Q.tfidf_ctes('d', 'doc_id', 'v')}, m AS (SELECT source, min(doc_id) AS head FROM documents GROUP BY source),
    pr AS (SELECT doc_id, head FROM documents JOIN m USING (source)),
    s AS (SELECT pr.doc_id AS doc_id, sum(a.w * b.w) AS c FROM pr JOIN v a ON a.doc_id = pr.doc_id JOIN v b ON b.doc_id = pr.head AND a.term = b.term GROUP BY 1)
    SELECT pr.doc_id, head, round(least(greatest(coalesce(c, 0), 0), 1) * 100, 2) AS similarity FROM pr LEFT JOIN s ON s.doc_id = pr.doc_id""")
def sim_text_tfidf(t):
    """Each document against the first document of its source."""
    docs = t.documents.select("doc_id", "text", "source")
    vectors = V.tfidf_vectors(docs, "doc_id", "text")
    heads = docs.groupBy("source").agg(F.min("doc_id").alias("head"))
    head_vectors = vectors.join(heads, F.col("doc_id") == F.col("head")).select("source", "head", F.col("terms").alias("h_terms"), F.col("weights").alias("h_weights"))
    placed = docs.select("doc_id", "source").join(vectors, "doc_id", "left")
    from talentloom.operators.joins import skew_join
    pairs = skew_join(placed, heads.join(head_vectors.drop("head"), "source", "left"), "source", "doc_id", count_on=docs)
    cosine = V.sparse_dot(F.col("terms"), F.col("weights"), F.col("h_terms"), F.col("h_weights"))
    return pairs.select("doc_id", "head", V.similarity_score(cosine).alias("similarity"))


@query("sim_sections", f"""
    WITH {SECTION_ROWS}, apps AS (SELECT application_id, resume_id, jd_id FROM applications WHERE jd_id IS NOT NULL),
    parts AS (SELECT resume_id, section, body FROM secs WHERE regexp_matches(body, '\\S') UNION ALL
              SELECT resume_id, 'overall', text FROM resumes WHERE regexp_matches(text, '\\S') AND resume_id NOT IN (SELECT resume_id FROM secs)),
    rdoc AS (SELECT resume_id::VARCHAR AS id, text FROM resumes), sdoc AS (SELECT resume_id || ':' || section AS id, body AS text FROM parts), jdoc AS (SELECT jd_id::VARCHAR AS id, text FROM jds),
    {Q.tfidf_ctes('sdoc', 'id', 'ts', corpus='rdoc')}, {Q.tfidf_ctes('jdoc', 'id', 'tj', corpus='rdoc')},
    pr AS (SELECT application_id, r.resume_id AS resume_id, jd_id, section, r.resume_id || ':' || section AS sid, jd_id::VARCHAR AS jid FROM parts r JOIN apps a ON a.resume_id = r.resume_id),
    dots AS (SELECT sid, jid, sum(ts.w * tj.w) AS c FROM (SELECT DISTINCT sid, jid FROM pr) JOIN ts ON ts.id = sid JOIN tj ON tj.id = jid AND tj.term = ts.term GROUP BY sid, jid)
    SELECT application_id, resume_id, jd_id, section, round(least(greatest(coalesce(c, 0), 0), 1) * 100, 2) AS similarity FROM pr LEFT JOIN dots USING (sid, jid)""")
def sim_sections(t):
    """Every non-blank section of a résumé against every opening it was sent to, one row for each application.

    A text of headings only has no section and is compared as a whole, as section "overall". Vectors of openings, which are
    short, travel to the applications; those of sections meet them last and are shuffled once a résumé, not once an application.
    """
    from talentloom.operators.joins import skew_join
    found = T.split_sections(F.col("text"))
    whole = F.array(F.struct(F.lit("overall").alias("section"), F.col("text").alias("body")))
    sections = t.resumes.select("resume_id", F.inline(F.when(F.size(found) > 0, found).otherwise(whole))).filter(~T.is_blank(F.col("body")))
    parts = sections.select(F.concat(F.col("resume_id").cast("string"), F.lit(":"), "section").alias("id"), "resume_id", "section", F.col("body").alias("text"))
    corpus = t.resumes.select(F.col("resume_id").cast("string").alias("id"), "text")
    vocab = V.vocabulary(V.term_counts(corpus, "id", "text"))
    part_vectors = V.tfidf(V.term_counts(parts, "id", "text"), vocab, "id")
    jd_vectors = V.tfidf(V.term_counts(t.jds, "jd_id", "text"), vocab, "jd_id").toDF("jd_id", "h_terms", "h_weights")
    sent = t.applications.filter("jd_id IS NOT NULL").select("application_id", "resume_id", "jd_id")
    with_vectors = parts.drop("text").join(part_vectors, "id", "left").drop("id")
    asked = skew_join(sent, jd_vectors, "jd_id", "application_id")
    both = skew_join(asked, with_vectors, "resume_id", "application_id", "inner", count_on=sent)
    cosine = V.sparse_dot(F.col("terms"), F.col("weights"), F.col("h_terms"), F.col("h_weights"))
    return both.select("application_id", "resume_id", "jd_id", "section", V.similarity_score(cosine).alias("similarity"))
