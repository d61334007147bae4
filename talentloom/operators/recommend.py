"""Job recommendations: a job catalogue with one row per role, and the best roles per text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.functions import text as T
from talentloom.functions.numeric import clamp, round1
from talentloom.operators import metrics, topk
from talentloom.operators import vectors as V


def job_catalogue(jobs: DataFrame, role: str, features: str, row_id: str) -> DataFrame:
    """(role, features): duplicates go before anything costly is computed.  A role without features stays, as empty text."""
    first = metrics.first_per_role(jobs, role, features, row_id)
    return first.select(F.col(role).alias("role"), F.coalesce(F.col(features), F.lit("")).alias("features"))


def recommend(texts: DataFrame, catalogue: DataFrame, text_id: str, text: str, top_n: int = 10) -> DataFrame:
    """(text_id, rank, role, score, snippet): the roles nearest to each text.

    The vocabulary is the catalogue's, whole. Blocks of roles are inverted indexes that give each text its best ``top_n``
    (:func:`topk.top_n_sparse`); a pair of a text and a role that is not among them leaves no task. A text or a role
    without a common term has a similarity of zero, where the name decides.
    """
    jobs = V.term_counts(catalogue, "role", "features")
    vocab = V.vocabulary(jobs)
    roles = catalogue.select("role").join(V.tfidf(jobs, vocab, "role"), "role", "left").withColumnRenamed("role", "item_id")
    said = texts.select(text_id).join(V.tfidf(V.term_counts(texts, text_id, text), vocab, text_id), text_id, "left").withColumnRenamed(text_id, "query_id")
    best = topk.top_n_sparse(said, roles, top_n, query_rows=texts.count(), item_rows=jobs.count()).withColumnsRenamed({"query_id": text_id, "item_id": "role"})
    return best.join(catalogue, "role").select(text_id, "rank", "role", score(F.col("similarity")).alias("score"), T.snippet(F.col("features")).alias("snippet"))


def score(similarity):
    """Similarity to 0..100 with one decimal."""
    return round1(clamp(similarity * F.lit(100.0), 0.0, 100.0))
