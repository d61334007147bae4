"""Delimited and JSON tables, column lookup, artefacts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from talentloom import rules

TAXONOMY_SCHEMA = "skills array<struct<name: string, aliases: array<string>, category: string>>"


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV with header, texts over several lines, doubled quotes.  The schema spares a pass over the data.

    A file whose texts may hold line breaks cannot be split: one task reads it whole, so such tables should lie in files
    of some megabytes, as :func:`write_csv` makes them. Without line breaks in texts, ``multi_line=False`` splits files of any size.
    """
    return spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, quote='"', escape='"')


def write_csv(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """The counterpart of :func:`read_csv`: quotes everything, keeps line breaks and blanks, begins a new file after so many rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).csv(path, header=True, quote='"', escape='"', quoteAll=True,
                                                            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Separators of :func:`write_texts`: after a text, between its key and itself, before an escaped character.
RECORD, UNIT, ESCAPE = "\x1e", "\x1f", "\x1b"
_ESCAPED = [(ESCAPE, ESCAPE + "0"), (RECORD, ESCAPE + "1"), (UNIT, ESCAPE + "2")]
_NULL = ESCAPE + "-"


def write_texts(df: DataFrame, key: str, text: str, path: str, texts_per_file: int = 1_000) -> None:
    """Texts as files of at most ``texts_per_file`` texts each, for tables of which every row is a text of its own.

    One file a text would be as many files and folders as rows. Texts come back unchanged whatever they hold; a null stays null. Keys are whole numbers.
    """
    plain = F.col(text)
    for c, code in _ESCAPED:
        plain = F.replace(plain, F.lit(c), F.lit(code))
    record = F.concat(F.col(key).cast("long").cast("string"), F.lit(UNIT), F.coalesce(plain, F.lit(_NULL)))
    df.filter(F.col(key).isNotNull()).select(record).write.option("lineSep", RECORD).option("maxRecordsPerFile", texts_per_file).text(path)


def read_texts(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """(key, text) of :func:`write_texts`; a file is one row until it is taken apart."""
    records = read_whole_texts(spark, path).select(F.explode(F.split("text", RECORD)).alias("r")).filter("r != ''")
    at = F.locate(UNIT, F.col("r"))
    text = F.substr(F.col("r"), at + 1)
    for c, code in reversed(_ESCAPED):
        text = F.replace(text, F.lit(code), F.lit(c))
    found = F.when(~F.col("r").endswith(UNIT + _NULL), text)
    return records.select(F.substr(F.col("r"), F.lit(1), at - 1).cast("long").alias(key), found.alias("text"))


def peek(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    return df.orderBy(order).limit(rows)


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate the table has; looks at the schema only."""
    return next((c for c in candidates if c in df.columns), None)


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rename the found columns to their standard names; a missing one is an error that names it."""
    found = {std: find_column(df, names) for std, names in wanted.items()}
    lost = [std for std, name in found.items() if name is None]
    if lost:
        raise ValueError(f"no column for {lost}; the table has {df.columns}")
    return df.select(*[F.col(name).alias(std) for std, name in found.items()])


def resolve_resumes(df: DataFrame) -> DataFrame:
    return resolve_columns(df, {"category": rules.CATEGORY_COLUMNS, "text": rules.TEXT_COLUMNS})


def resolve_jobs(df: DataFrame) -> DataFrame:
    return resolve_columns(df, {"role": rules.ROLE_COLUMNS, "features": rules.FEATURE_COLUMNS})


def taxonomy_entries(nested: DataFrame) -> DataFrame:
    """(entry, name, aliases, category) from rows that hold a ``skills`` list."""
    return nested.select(F.posexplode("skills").alias("entry", "s")).select("entry", "s.name", "s.aliases", "s.category")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Skill taxonomy JSON; a missing file gives an empty taxonomy."""
    try:
        nested = spark.read.schema(TAXONOMY_SCHEMA).json(path, multiLine=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        nested = spark.createDataFrame([], TAXONOMY_SCHEMA)
    return taxonomy_entries(nested)


# --- artefacts ----------------------------------------------------------------------------------------

def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """A stored table, or ``build()`` stored there first when nothing lies at the path.

    Later use reads the file, so a lost executor never repeats the build. A path that holds something
    else, or nothing readable, is an error: it may be a good table that this reader cannot open.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """A stored model, or None when there is none."""
    try:
        return PipelineModel.load(path)
    except Exception as error:  # the reader reports a missing path through Py4J or AnalysisException
        if "does not exist" in str(error) or "PATH_NOT_FOUND" in str(error) or "NoSuchElement" in str(error):
            return None
        raise
