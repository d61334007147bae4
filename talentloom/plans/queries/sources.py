"""Files and tables in, tables out."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import text as T
from talentloom.operators import skills as K
from talentloom.operators.encode import encode_texts
from talentloom.operators.recommend import job_catalogue
from talentloom.plans.queries import sql as Q
from talentloom.plans.queries.registry import joined, joined_sql, query
from talentloom.session import scratch_path
from talentloom.sources import files as S
from talentloom.sources import tables as B

# --- files made from documents -------------------------------------------------------------------

_PATH = "CASE doc_id % 5 WHEN 0 THEN 'in/' || lang || '.v1/cv.PDF' WHEN 1 THEN 'in/cv.docx' WHEN 2 THEN 'cv.doc' WHEN 3 THEN '' ELSE 'in.pdf/notes.txt' END"
_HEAD = "CASE doc_id % 3 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'PK..' ELSE '' END || text"


@query("src_documents", f"""
    WITH f AS (SELECT doc_id, {_PATH} AS path, {_HEAD} AS head, octet_length(encode({_HEAD})) AS bytes FROM documents)
    SELECT doc_id, path, bytes::BIGINT AS bytes, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.doc' OR path LIKE '%.docx' THEN 'docx' ELSE 'unknown' END AS by_path,
        CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.doc' OR path LIKE '%.docx' THEN 'docx' WHEN head LIKE '%PDF%' AND head[1:4] = '%PDF' THEN 'pdf'
             WHEN head[1:2] = 'PK' THEN 'docx' ELSE 'unknown' END AS by_stream FROM f""")
def src_documents(t):
    f = t.documents.select("doc_id", F.expr(_PATH).alias("path"), F.encode(F.expr(_HEAD), "UTF-8").alias("content"))
    return f.select("doc_id", "path", F.octet_length("content").cast("long").alias("bytes"), S.file_type(F.col("path")).alias("by_path"),
                    S.file_type(F.col("path"), F.col("content")).alias("by_stream"))


def docx_files(df, path: str, paragraphs: str, cells: str):
    """DOCX bytes from two text columns: a paragraph per line, and a one-row table of cells."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def run(text: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    def build(batches):
        for batch in S.portions(batches):
            out = []
            for body, row in zip(batch[paragraphs], batch[cells]):
                table = "".join(f"<w:tc>{run(c)}</w:tc>" for c in row.split("\n"))
                xml = f'<w:document {ns}><w:body>{"".join(map(run, body.split(chr(10))))}<w:tbl><w:tr>{table}</w:tr></w:tbl></w:body></w:document>'
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", xml)
                out.append(buffer.getvalue())
            yield pd.DataFrame({"path": batch[path], "content": out})

    return df.select(path, paragraphs, cells).mapInPandas(build, "path string, content binary")


_PARAS = "list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))"
_DOCX = f"array_to_string(list_concat({_PARAS}, list_filter([lang, source, lang], lambda c, i: NOT list_contains({_PARAS}, c) AND i <> 3)), chr(10))"


def _docx(t, df):
    made = df.select(F.concat(F.lit("cv/"), "doc_id", F.lit(".docx")).alias("name"), "text", F.concat_ws("\n", "lang", "source", "lang").alias("cells"))
    return docx_files(made, "name", "text", "cells")


@query("src_docx_text", f"SELECT 'cv/' || doc_id || '.docx' AS path, md5({_DOCX}) AS digest, length({_DOCX}) AS chars FROM documents")
def src_docx_text(t):
    return S.parse_docx(_docx(t, t.documents)).select("path", F.md5("raw_text").alias("digest"), F.length("raw_text").cast("long").alias("chars"))


_LINES = "string_split(text, chr(10))"
_PDF = f"array_to_string(list_filter({_LINES}, lambda l: l <> ''), chr(10) || chr(10))"
_PDF_WARN = f"list_transform(list_filter(range(1, len({_LINES})::BIGINT + 1), lambda i: {_LINES}[i] = ''), lambda i: 'Page ' || i || ': {S.EMPTY_PAGE}')"
_SHORT = "length(" + Q.strip("raw") + ") < 50"


@query("src_permissive", f"""
    WITH b AS (SELECT doc_id, text, lang, source, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'broken' WHEN 2 THEN 'pdf' ELSE 'txt' END AS kind FROM documents),
    r AS (SELECT doc_id, kind, CASE kind WHEN 'docx' THEN {_DOCX} WHEN 'pdf' THEN {_PDF} ELSE '' END AS raw, CASE WHEN kind = 'pdf' THEN {_PDF_WARN} ELSE [] END AS pw FROM b)
    SELECT 'cv/' || doc_id || CASE kind WHEN 'txt' THEN '.txt' WHEN 'pdf' THEN '.pdf' ELSE '.docx' END AS path,
        CASE kind WHEN 'txt' THEN 'unknown' WHEN 'pdf' THEN 'pdf' ELSE 'docx' END AS file_type, md5(raw) AS digest,
        array_to_string(CASE kind WHEN 'txt' THEN [{Q.q(S.UNSUPPORTED)}] WHEN 'broken' THEN ['{S.DOCX_ERROR}File is not a zip file']
            WHEN 'pdf' THEN list_concat(pw, CASE WHEN {_SHORT} THEN [{Q.q(S.SHORT_PDF)}] ELSE [] END) ELSE CASE WHEN {_SHORT} THEN [{Q.q(S.SHORT_DOCX)}] ELSE [] END END, '; ') AS warnings,
        {_SHORT} AS is_empty, length(raw) AS char_count FROM r""")
def src_permissive(t):
    """A mixed upload folder: good and broken DOCX, PDF page texts, other files."""
    d, kind = t.documents, F.col("doc_id") % 4

    def raw(k, ext):
        return d.filter(kind == k).select(F.concat(F.lit("cv/"), "doc_id", F.lit(ext)).alias("path"), F.encode("text", "UTF-8").alias("content"))

    uploads = _docx(t, d.filter(kind == 0)).unionByName(raw(1, ".docx")).unionByName(raw(2, ".pdf")).unionByName(raw(3, ".txt"))
    pages = d.filter(kind == 2).select(F.concat(F.lit("cv/"), "doc_id", F.lit(".pdf")).alias("path"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return S.parse_documents(uploads, pages).select("path", "file_type", F.md5("raw_text").alias("digest"), joined(F.col("warnings")).alias("warnings"),
                                                    "is_empty", F.col("char_count").cast("long").alias("char_count"))


@query("src_page_concat", f"""
    SELECT conv_id, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '')) AS digest,
        coalesce(string_agg('Page ' || (turn + 1) || ': {S.EMPTY_PAGE}', '; ' ORDER BY turn) FILTER (WHERE coalesce(text, '') = ''), '') AS warnings FROM conversations GROUP BY conv_id""")
def src_page_concat(t):
    return S.join_pages(t.conversations, "conv_id", "turn", "text").select("conv_id", F.md5("raw_text").alias("digest"), joined(F.col("warnings")).alias("warnings"))


@query("src_wholetext", "SELECT item_id, md5(text || chr(10)) AS digest, length(text) + 1 AS chars FROM benchmark")
def src_wholetext(t):
    """Openings stored as text files of bounded size, read back whole and taken apart."""
    path = scratch_path(t.spark, "openings")
    B.write_texts(t.benchmark.select("item_id", F.concat("text", F.lit("\n")).alias("text")), "item_id", "text", path)
    return B.read_texts(t.spark, path, "item_id").select("item_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query("src_csv", "SELECT doc_id, source, lang, n_chars, md5(text) AS digest FROM documents")
def src_csv(t):
    path = scratch_path(t.spark, "documents-csv")
    B.write_csv(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), path)
    back = B.read_csv(t.spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    return back.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("digest"))


@query("src_peek", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def src_peek(t):
    return B.peek(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id", 5)


@query("src_resolve_columns", "SELECT source AS category, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def src_resolve_columns(t):
    df = B.resolve_resumes(t.documents.withColumnRenamed("source", "Category"))
    return df.groupBy("category").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("src_taxonomy", f"""
    WITH raw AS (SELECT p_partkey AS entry, p_name AS name, p_type AS category, unnest([p_name, p_brand, p_brand || ' ' || p_name]) AS spelled, unnest([0, 1, 2]) AS pos FROM part)
    SELECT array_to_string(regexp_extract_all(lower(spelled), {Q.q(Q.PHRASE_TOKEN)}), ' ') AS form, arg_min(name, entry * 10 + pos) AS canonical, arg_min(category, entry * 10 + pos) AS category
    FROM raw GROUP BY form""")
def src_taxonomy(t):
    """A taxonomy document per part, parsed from JSON text and flattened to spellings."""
    entry = F.struct(F.col("p_name").alias("name"), F.array("p_brand", F.concat_ws(" ", "p_brand", "p_name")).alias("aliases"), F.col("p_type").alias("category"))
    text = t.part.select("p_partkey", F.to_json(F.struct(F.array(entry).alias("skills"))).alias("json"))
    nested = text.select("p_partkey", F.from_json("json", B.TAXONOMY_SCHEMA).alias("j")).select("p_partkey", "j.skills")
    entries = nested.select("p_partkey", F.inline("skills"))
    return K.taxonomy_forms(entries, "p_partkey")


@query("sink_artifacts", "SELECT role, coalesce(arg_min(features, row_id) FILTER (WHERE features IS NOT NULL), '') AS features FROM jobs WHERE role IS NOT NULL GROUP BY role")
def sink_artifacts(t):
    """The catalogue is built on first use, stored, and read back on the next."""
    path = scratch_path(t.spark, "catalogue")
    B.load_or_build(t.spark, path, lambda: job_catalogue(t.jobs, "role", "features", "row_id"))
    return B.load_or_build(t.spark, path, lambda: 1 / 0)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTS = ", ".join(f"(length(t) - length(replace(t, '{ch}', '')))::DOUBLE" for ch in LETTERS)


@query("udf_encoder", f"""
    WITH c AS (SELECT doc_id, [{_COUNTS}] AS v FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE regexp_matches(text, '\\S'))),
    n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c)
    SELECT doc_id, list_transform(v, lambda x: round(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 4)) AS embedding FROM n""")
def udf_encoder(t):
    """The encoder hook with a toy encoder: letter counts at unit length, shown to four digits."""
    def load():
        import numpy as np
        return lambda texts: np.array([[s.lower().count(ch) for ch in LETTERS] for s in texts], dtype=float)
    vectors = encode_texts(t.documents, "doc_id", "text", load)
    return vectors.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))
