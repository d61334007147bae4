"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (always reported, whatever their score): email; ip with parts of at most 255; card of 16
to 19 digits that pass Luhn's test; phone with a plus sign and 8 to 15 digits. Each takes the
leftmost matches that do not overlap; a match that fails its test is dropped, and the search goes on
behind it. Beyond these the method adds, from the score ``SURE`` on and where no base span lies:

* ``iban``: country, check digits and 11 to 30 characters; the mod-97 test decides;
* ``card`` of 13 to 15 digits: Luhn's test and a word such as "card" or "visa" shortly before;
* ``phone`` without a plus sign, in groups of 3, 3 and 4 digits: a word such as "phone" shortly before;
* ``ssn``: groups of 3, 2 and 4 digits outside the ranges never given out, and a word such as "ssn" shortly before.

Offsets are code points, ends are exclusive. All searches are linear in the text, so very long texts
and long runs of digits or letters take their share of time and no more. A null text has no spans.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import or_empty

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
SURE = 0.8
#: How many characters before a span its context words may stand.
NEAR = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits that fails fails from each of its digits, so a search begins at the run's first one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_CONTEXT = {
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|telephone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Left of an @ the part before it, as far back as the last match allows, right of it the domain."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        # what a failed part before an @ holds cannot begin a later match, which has to reach past this @
        free = domain.end() if domain else at + 1
        if domain:
            found.append((start, domain.end()))
        at = text.find("@", free)
    return found


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text, by kind as listed and start: (kind, start, end, score, base)."""
    found: list[tuple[str, int, int, float, bool]] = []

    def near(kind: str, start: int) -> bool:
        return _CONTEXT[kind].search(text, max(0, start - NEAR), start) is not None

    def propose(kind: str, start: int, end: int, score: float, base: bool = False) -> None:
        found.append((kind, start, end, round(min(1.0, score), 2), base))

    if "@" in text:
        for start, end in emails(text):
            propose("email", start, end, 0.9, True)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                propose("ip", *m.span(), 0.9, True)
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                score = 0.6 + 0.3 * near("card", m.start())
                propose("card", *m.span(), score, len(digits) >= 16)
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    propose("phone", *m.span(), 0.7 + 0.3 * near("phone", m.start()), True)
        for m in _LOCAL_PHONE.finditer(text):
            propose("phone", *m.span(), 0.5 + 0.4 * near("phone", m.start()))
        for m in _IBAN.finditer(text):
            if mod97(m[0].replace(" ", "")):
                propose("iban", *m.span(), 0.85 + 0.15 * near("iban", m.start()))
        for m in _SSN.finditer(text):
            propose("ssn", *m.span(), 0.5 + 0.4 * near("ssn", m.start()))
    taken = sorted((s, e) for _, s, e, _, base in found if base)
    free = [x for x in found if x[4] or x[3] >= SURE and not _overlaps(taken, x[1], x[2])]
    return sorted(free, key=lambda x: (KINDS.index(x[0]), x[1]))


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in taken)


def found_in(text: Column) -> Column:
    """The spans of a text column, as an array of structs."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
    names = [f.name for f in kind.value_type]

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, s)) for s in spans(t.as_py() or "")] for t in texts], kind)

    return find(or_empty(text))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; other columns stay."""

    @F.arrow_udf("string")
    def blank(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is not None:
                done, parts = 0, []
                for kind, start, end, _, _ in sorted(spans(t), key=lambda s: s[1:3]):
                    if end > done:
                        parts += [t[done:max(done, start)], f"[{kind}]"]
                        done = end
                t = "".join(parts) + t[done:]
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn(text, blank(F.col(f"`{text}`")))


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, a hash of the base spans, and all spans as a string."""
    found = docs.select("doc_id", found_in(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
