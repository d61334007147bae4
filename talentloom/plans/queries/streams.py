"""Arriving files: the batch definitions run as streams, in several batches with a restart after each."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import vectors as V
from talentloom.plans import match as M
from talentloom.plans.inputs import AS_OF_YEAR
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.matching import MATCH_CTES
from talentloom.plans.queries.registry import query
from talentloom.session import scratch_path, stored
from talentloom.streaming import arrivals as A

BATCHES = 3


def arrive(t, rows, batch, name, run):
    """Land the rows batch by batch; after each, ``run(stream, out, checkpoint)`` takes the stream up where it stopped."""
    landing, out, mark = (scratch_path(t.spark, f"{name}-{x}") for x in ("landing", "out", "mark"))
    held = stored(rows.withColumn("_batch", batch.cast("int")), name)
    for k in range(BATCHES):
        held.filter(F.col("_batch") == k).drop("_batch").write.mode("append").parquet(landing)
        run(A.read_arrivals(t.spark, landing, rows.schema), out, mark)
    return out


@query("st_score_arrivals", f"""
    WITH {MATCH_CTES} SELECT application_id, resume_id, jd_id, has_jd, overall, {Q.round1('semantic')} AS semantic, skill_pct, experience_match, education_match, ats_total FROM sc""")
def st_score_arrivals(t):
    """Arriving résumés meet openings, applications and dictionary in the very plan of a table; vocabulary of the résumés known."""
    resumes = t.resumes.select("resume_id", "text")
    vocab = V.vocabulary(V.term_counts(resumes, "resume_id", "text"))
    applications = stored(t.applications, "applications")
    columns = ["application_id", "resume_id", "jd_id", "has_jd", "overall", "semantic", "skill_pct", "experience_match", "education_match", "ats_total"]

    def plan(batch):
        sent = applications.join(batch.select("resume_id"), "resume_id", "left_semi").select(*applications.columns)
        return M.match(sent, batch, t.jds, t.skill_rules, AS_OF_YEAR, missing_words=False, vocab=vocab).select(*columns)

    out = arrive(t, resumes, F.pmod(F.xxhash64("resume_id"), F.lit(BATCHES)), "resumes", lambda stream, out, mark: A.score_arrivals(stream, plan, out, mark))
    return t.spark.read.parquet(out).select(*columns)


@query("st_dedup_uploads", """
    WITH k AS (SELECT sha256(concat_ws(chr(31), coalesce(user_id::VARCHAR, ''), coalesce(event_type, ''), coalesce(props::VARCHAR, ''))) AS upload_key, ts, event_id FROM events)
    SELECT upload_key, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM k GROUP BY upload_key""")
def st_dedup_uploads(t):
    """The earliest upload of each (user, kind, properties), from batches in which late and early ones are mixed."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    key = A.content_key(F.col("user_id"), F.col("event_type"), F.col("props"))

    def run(stream, out, mark):
        A.run_batches(A.dedup_uploads(stream, "ts", "event_id", key, "400 days"), lambda batch, _: batch, out, mark, "update")

    out = arrive(t, events, F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)), "uploads", run)
    told = t.spark.read.schema("upload_key string, ts_us long, row_id long").parquet(out)
    return A.survivors(told).select("upload_key", F.col("row_id").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))


#: Events come in order of their days, but one in twenty a batch late.
_ARRIVAL = f"least({BATCHES - 1}, (datediff('day', d0, ts::DATE) * {BATCHES}) // (datediff('day', d0, d1) + 1) + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END)"


@query("st_running_bands", f"""
    WITH e AS (SELECT event_id, ts, value, date_trunc('day', ts) + INTERVAL 1 DAY AS e, {_ARRIVAL} AS batch FROM events, (SELECT min(ts)::DATE AS d0, max(ts)::DATE AS d1 FROM events)),
    latest AS (SELECT batch, max(ts) AS ts FROM e GROUP BY batch),
    marked AS (SELECT e.*, coalesce(e.e <= (SELECT max(l.ts) - INTERVAL 1 HOUR FROM latest l WHERE l.batch < e.batch), false) AS late FROM e)
    SELECT e - INTERVAL 1 DAY AS window_start, {Q.band('value')} AS band, (count(*) FILTER (NOT late))::BIGINT AS rows, (count(*) FILTER (late))::BIGINT AS late,
           any_value(e) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS final FROM marked GROUP BY e, 2""")
def st_running_bands(t):
    """All days: closed ones final, open ones provisional, with the rows that came too late counted apart."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.struct(F.min("ts").cast("date").alias("d0"), F.max("ts").cast("date").alias("d1")).alias("s")).scalar()
    dated = events.withColumn("_span", span)
    turn = F.floor(F.datediff(F.col("ts").cast("date"), F.col("_span.d0")) * BATCHES / (F.datediff("_span.d1", "_span.d0") + 1))
    batch = F.least(F.lit(BATCHES - 1), turn + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0))
    placed = dated.withColumn("_turn", batch).drop("_span")
    out = arrive(t, placed, F.col("_turn"), "bands", lambda stream, out, mark: A.run_bands(stream, "ts", "value", out, mark))
    return A.running_bands(A.read_bands(t.spark, out)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
