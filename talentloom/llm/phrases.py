"""Repeated phrases: windows of 20 words that start earlier in the corpus, found by automata.

``repeats`` brings together, shard by shard, the fragments whose windows may recur. In a shard, windows
that occur at least twice are confirmed passages; they are compiled into an Aho-Corasick automaton
(pyahocorasick) over the shard's words, one character for each distinct word, and all fragments are
streamed through it. Every hit is an occurrence of a passage; the earliest (doc_id, start) stays and the
others are marked.

Words are runs of characters other than the six white-space ones, taken unchanged. Defined cases: a null
text has no words; a document of fewer than 20 words loses none; rows that share doc_id and text are one place
each to the order of places, so neither removes the other; an empty table gives an empty table.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.repeats import Fragment, Kind, report

WINDOW = 20
GRAM = 6
#: Characters that may stand for words: all but the surrogates.
LETTERS = 0x10FFFF - 0x800


def letter(code: int) -> str:
    return chr(code + 1 if code + 1 < 0xD800 else code + 1 + 0x800)


def spelled(fragments: list[Fragment]) -> tuple[list[str], int]:
    """Each fragment as a string with ``width`` characters for each word."""
    codes: dict[bytes, int] = {}
    coded = [[codes.setdefault(w, len(codes)) for w in f.content.split(b" ")] for f in fragments]
    if len(codes) < LETTERS:
        letters = [letter(i) for i in range(len(codes))]
        return ["".join([letters[c] for c in x]) for x in coded], 1
    return ["".join([letter(c // LETTERS) + letter(c % LETTERS) for c in x]) for x in coded], 2


def judge(fragments: list[Fragment]) -> list[np.ndarray]:
    """For each window of each fragment: does its phrase also start earlier?

    Blocks often send the same fragment; its text passes the automaton once, for its earliest place.
    """
    copies: dict[bytes, int] = {}
    earliest: dict[bytes, Fragment] = {}
    for f in fragments:
        copies[f.content] = copies.get(f.content, 0) + 1
        known = earliest.get(f.content)
        if known is None or (f.doc, f.start) < (known.doc, known.start):
            earliest[f.content] = f
    distinct = list(earliest.values())
    texts, width = spelled(distinct)
    size = WINDOW * width
    seen: dict[str, int] = {}
    for f, t in zip(distinct, texts):
        n = copies[f.content]
        for j in range(0, f.windows * width, width):
            phrase = t[j: j + size]
            seen[phrase] = seen.get(phrase, 0) + n
    automaton = ahocorasick.Automaton()
    known = [phrase for phrase, count in seen.items() if count > 1]
    del seen
    if not known:
        return [np.zeros(f.windows, bool) for f in fragments]
    for i, phrase in enumerate(known):
        automaton.add_word(phrase, i)
    automaton.make_automaton()
    # for every hit its phrase and place; places are put in order once, then compared as numbers
    hits = [[(end + 1 - size, i) for end, i in automaton.iter(t)] for t in texts]
    n_hits = np.array([len(x) for x in hits])
    at, phrase = np.array([x for h in hits for x in h], np.int64).reshape(-1, 2).T
    owner = np.repeat(np.arange(len(distinct)), n_hits)
    aligned = at % width == 0
    at, phrase, owner = at[aligned] // width, phrase[aligned], owner[aligned]
    docs = np.unique(np.array([f.doc for f in fragments], np.int64))
    base = np.searchsorted(docs, np.array([f.doc for f in distinct], np.int64)) << 32 | np.array([f.start for f in distinct], np.int64)
    first = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(first, phrase, base[owner] + at)
    # the first place of each window's phrase; windows without a hit have none but their own
    windows = np.array([f.windows for f in distinct])
    offset = np.cumsum(windows) - windows
    place = np.full(windows.sum(), np.iinfo(np.int64).max)
    place[offset[owner] + at] = first[phrase]
    per_text = dict(zip(earliest, np.split(place, offset[1:])))
    own = (np.searchsorted(docs, np.array([f.doc for f in fragments], np.int64)) << 32 | np.array([f.start for f in fragments], np.int64)).tolist()
    steps = np.arange(max(f.windows for f in fragments))
    return [per_text[f.content] < o + steps[: f.windows] for f, o in zip(fragments, own)]


KIND = Kind(words=True, window=WINDOW, gram=GRAM, within=True, judge=judge)


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, text): what stays of each document, words joined by one space, and the removed runs of words."""
    return report(docs, KIND, with_text=True).select("doc_id", "spans", F.col("text").cast("string").alias("text"))


def phrase_rows(docs: DataFrame) -> DataFrame:
    return report(docs, KIND).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")
