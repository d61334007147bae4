"""What an opening asks for and a text lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import text as T
from talentloom.functions.numeric import bind


def word_frequency(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, word, freq, first_pos) of words with four or more letters, stopwords included."""
    said = docs.select(doc_id, F.posexplode(T.long_words(F.col(text))).alias("pos", "word"))
    return said.groupBy(doc_id, "word").agg(
        F.count("*").alias("freq"), F.min("pos").cast("long").alias("first_pos"))


def repeated_words(docs: DataFrame, doc_id: str, text: str, min_freq: int = 2) -> DataFrame:
    """(doc, repeated): words said at least ``min_freq`` times, most frequent first, then by place.

    One opening is one group here, and its words are the words of one text row.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("f"), "first_pos", "word")))
    return (
        word_frequency(docs, doc_id, text).filter(F.col("freq") >= min_freq)
        .groupBy(doc_id).agg(F.transform(ordered, lambda w: w["word"]).alias("repeated"))
    )


def missing_keywords(resume_text: Column, repeated: Column, limit: int = rules.MAX_MISSING_KEYWORDS) -> Column:
    """Repeated words that occur nowhere in the text, not even inside a longer word; the top 15.

    The cut is the feature (a short list for the reader), in a fixed order.
    """
    return F.slice(absent_words(resume_text, repeated), 1, limit)


def absent_words(resume_text: Column, words: Column) -> Column:
    """The words that the lower-cased text nowhere contains; the text is lower-cased once."""
    listed = F.coalesce(words, F.array().cast("array<string>"))
    return bind(F.lower(T.blank_if_null(resume_text)), lambda low: F.filter(listed, lambda w: ~F.contains(low, w)))
