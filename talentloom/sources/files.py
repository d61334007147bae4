"""Uploaded files to documents.

Input is a table ``(path, content)`` as ``binaryFile`` gives it.  Nothing raises: a file that cannot
be read becomes an empty text with one warning.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.functions import text as T

# --- fixed values: warnings -----------------------------------------------------------------------
UNSUPPORTED = "Unsupported file format. Please upload a PDF or DOCX file."
SHORT_PDF = (
    "Extracted text is very short or empty. This file may be a scanned document. "
    "OCR support is not yet enabled."
)
SHORT_DOCX = "Extracted text is very short or empty."
EMPTY_PAGE = "no text extracted (may be scanned/image-based)"
DOCX_ERROR = "DOCX parsing error: "

# --- fixed values: files whose texts a Python worker holds at once
FILES_AT_ONCE = 256

DOCUMENT_COLUMNS = ["doc_id", "path", "file_type", "parsing_method", "raw_text", "warnings", "is_empty", "char_count"]


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content); columns left out of a select are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)


def file_type(path: Column, content: Column | None = None) -> Column:
    """pdf, docx or unknown: by extension, and by the first bytes where ``content`` is a stream's.

    A path decides by its extension alone; a stream may have no name or a foreign extension.
    """
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/](\.[^./]*)$", 1))
    by_name = F.when(ext == ".pdf", "pdf").when(ext.isin(".docx", ".doc"), "docx")
    if content is None:
        return F.coalesce(by_name, F.lit("unknown"))
    head = F.hex(F.substring(content, 1, 8))
    by_bytes = F.when(F.startswith(head, F.lit("25504446")), "pdf").when(F.startswith(head, F.lit("504B")), "docx")
    return F.coalesce(by_name, by_bytes, F.lit("unknown"))


# --- DOCX -------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _run_text(node: ElementTree.Element) -> str:
    marks = {_W + "t": None, _W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join((n.text or "") if marks[n.tag] is None else marks[n.tag] for n in node.iter() if n.tag in marks)


def docx_text(content: bytes) -> str:
    """Non-blank body paragraphs, then table cells not said before, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
    if body is None:
        return ""
    said = [t for t in map(_run_text, body.findall(_W + "p")) if t.strip()]
    seen = set(said)
    for cell in (c for table in body.findall(_W + "tbl") for c in table.findall(f"{_W}tr/{_W}tc")):
        t = "\n".join(map(_run_text, cell.findall(_W + "p"))).strip()
        if t and t not in seen:
            seen.add(t)
            said.append(t)
    return "\n".join(said)


def portions(batches: Iterator[pd.DataFrame], rows: int = FILES_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The rows of the batches, a few at a time: what is made of a batch leaves Python before the next part is made."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


def _parse_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(content: bytes) -> tuple[str, str | None]:
        try:
            return docx_text(content), None
        except Exception as error:  # any broken upload is a row with a warning
            return "", DOCX_ERROR + re.sub(r"\s+", " ", str(error))

    for part in portions(batches):
        parsed = [one(c) for c in part["content"]]
        yield pd.DataFrame({"path": part["path"], "raw_text": [t for t, _ in parsed], "error": [e for _, e in parsed]})


def parse_docx(files: DataFrame) -> DataFrame:
    """(path, raw_text, error); one file is one row, read where it lies."""
    return files.select("path", "content").mapInPandas(_parse_docx, "path string, raw_text string, error string")


# --- pages ------------------------------------------------------------------------------------------

def join_pages(pages: DataFrame, doc_id: str, page: str, text: str) -> DataFrame:
    """(doc, raw_text, warnings): page texts with a blank line between, a warning per empty page.

    ``page`` counts from 0.  The pages of one document are one text, so the group is one row's worth.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    grouped = pages.groupBy(doc_id).agg(ordered.alias("pages"))
    return grouped.select(
        doc_id,
        F.array_join(F.transform(F.filter("pages", lambda x: x["t"] != ""), lambda x: x["t"]), "\n\n").alias("raw_text"),
        F.transform(F.filter("pages", lambda x: x["t"] == ""), lambda x: F.concat(
            F.lit("Page "), (x["p"] + 1).cast("string"), F.lit(": " + EMPTY_PAGE))).alias("warnings"),
    )


# --- all types ----------------------------------------------------------------------------------------

def parse_documents(files: DataFrame, pdf_pages: DataFrame | None = None, streams: bool = False) -> DataFrame:
    """Documents from files (path, content) and, for PDFs, page texts (path, page, text) made elsewhere."""
    typed = files.withColumn("file_type", file_type(F.col("path"), F.col("content") if streams else None))
    none = F.array().cast("array<string>")

    docx = parse_docx(typed.filter("file_type = 'docx'")).select(
        "path", F.lit("docx").alias("file_type"), F.lit("zip+xml").alias("parsing_method"), "raw_text",
        F.when(F.col("error").isNotNull(), F.array("error"))
        .when(T.is_empty_document(F.col("raw_text")), F.array(F.lit(SHORT_DOCX))).otherwise(none).alias("warnings"))
    pdf = typed.filter("file_type = 'pdf'").select("path")
    if pdf_pages is None:
        pdf = pdf.select("path", F.lit("").alias("raw_text"), none.alias("warnings"))
    else:
        joined = join_pages(pdf_pages, "path", "page", "text")
        pdf = pdf.join(joined, "path", "left").select(
            "path", F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.coalesce("warnings", none).alias("warnings"))
    short = F.when(T.is_empty_document(F.col("raw_text")), F.array(F.lit(SHORT_PDF))).otherwise(none)
    pdf = pdf.select("path", F.lit("pdf").alias("file_type"), F.lit("pages").alias("parsing_method"), "raw_text",
                     F.concat("warnings", short).alias("warnings"))
    other = typed.filter("file_type = 'unknown'").select(
        "path", "file_type", F.lit("none").alias("parsing_method"), F.lit("").alias("raw_text"),
        F.array(F.lit(UNSUPPORTED)).alias("warnings"))
    every = docx.unionByName(pdf).unionByName(other)
    return every.select(
        F.sha2("path", 256).alias("doc_id"), "path", "file_type", "parsing_method", "raw_text", "warnings",
        T.is_empty_document(F.col("raw_text")).alias("is_empty"), F.length("raw_text").alias("char_count"))


def file_inventory(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """(file, exists, size_mb) of required files; reads names and sizes, no content."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    there = read_files(spark, folder).select(name.alias("file"), "length").groupBy("file").agg(F.sum("length").alias("bytes"))
    wanted = spark.createDataFrame([(f,) for f in required], "file string")
    return wanted.join(there, "file", "left").select(
        "file", F.col("bytes").isNotNull().alias("exists"), F.round(F.col("bytes") / (1024 * 1024), 1).alias("size_mb"))
