"""Files, tables, streams."""

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from places import SMALL
from talentloom.plans.inputs import Inputs
from talentloom.sources import files as S
from talentloom.sources import tables as B
from talentloom.streaming import arrivals as A


def _docx(path, paragraphs, cells):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(map(p, paragraphs)) + "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")


def test_upload_folder(spark, tmp_path):
    _docx(tmp_path / "good.docx", ["John Doe", "", "Python and SQL for many long and happy years in teams"], ["John Doe", "cell", "cell"])
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "notes.xyz").write_text("hello")
    pages = spark.createDataFrame([("scan.pdf", 0, "page one"), ("scan.pdf", 1, ""), ("scan.pdf", 2, "page three")], "path string, page int, text string")
    uploads = S.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    rows = {r["path"]: r for r in S.parse_documents(uploads, pages).collect()}
    assert rows["good.docx"]["raw_text"].split("\n") == ["John Doe", "Python and SQL for many long and happy years in teams", "cell"]
    assert not rows["good.docx"]["is_empty"] and rows["good.docx"]["warnings"] == []
    assert rows["bad.docx"]["is_empty"] and rows["bad.docx"]["warnings"][0].startswith("DOCX parsing error")
    assert rows["scan.pdf"]["raw_text"] == "page one\n\npage three" and rows["scan.pdf"]["warnings"][0].startswith("Page 2:")
    assert rows["notes.xyz"]["file_type"] == "unknown" and rows["notes.xyz"]["warnings"] == [S.UNSUPPORTED]


def test_file_type_by_bytes(value):
    assert value(lambda p, c: S.file_type(p, c), "", b"%PDF-1.7") == "pdf"
    assert value(lambda p, c: S.file_type(p, c), "x.bin", b"PK\x03\x04") == "docx"
    assert value(lambda p: S.file_type(p), "a.pdf/x") == "unknown"
    assert value(lambda p: S.file_type(p), "dir/A.DOC") == "docx"


def test_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 1024 * 1024)
    rows = {r["file"]: r for r in S.file_inventory(spark, str(tmp_path), ["a.csv", "b.csv"]).collect()}
    assert rows["a.csv"]["exists"] and rows["a.csv"]["size_mb"] == 1.0 and not rows["b.csv"]["exists"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line "one"\nline two, end'), (2, " spaced "), (3, "")], "id int, text string")
    B.write_csv(df, str(tmp_path / "csv"))
    back = B.read_csv(spark, str(tmp_path / "csv"), "id int, text string")
    # an empty field is a missing value, as in any CSV reader of the field's data
    assert sorted(map(tuple, back.fillna("").collect())) == sorted(map(tuple, df.collect()))
    assert back.filter("text IS NULL").count() == 1


def test_texts_in_bounded_files_come_back_unchanged(spark, tmp_path):
    texts = ["plain", "", None, "two\nlines\n", "\x1e\x1f\x1b", "\x1b0\x1b1\x1b-", "\x1b-", "é 漢 🙂", "a\x1fb\x1ec"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    B.write_texts(df, "k", "text", str(tmp_path / "texts"), texts_per_file=7)
    assert len(list((tmp_path / "texts").glob("part-*"))) == 7
    assert sorted((r.key, r.text) for r in B.read_texts(spark, str(tmp_path / "texts")).collect()) == list(enumerate(texts))


def test_csv_files_are_bounded(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "concat('line\n', id) AS text").coalesce(1)
    B.write_csv(df, str(tmp_path / "csv"), rows_per_file=10)
    assert len(list((tmp_path / "csv").glob("part-*"))) == 3
    assert sorted(map(tuple, B.read_csv(spark, str(tmp_path / "csv"), "id long, text string").collect())) == [(i, f"line\n{i}") for i in range(25)]


def test_resolve_columns(spark):
    df = spark.createDataFrame([("IT", "text", 1)], "Category string, Feature string, other int")
    assert B.resolve_resumes(df).columns == ["category", "text"]
    with pytest.raises(ValueError, match="role"):
        B.resolve_jobs(df)


def test_taxonomy_file(spark, tmp_path):
    path = tmp_path / "skills.json"
    path.write_text(json.dumps({"_meta": {"v": 1}, "skills": [{"name": "C++", "aliases": ["cpp"], "category": "L"}, {"name": "Go", "aliases": [], "category": "L"}]}, indent=1))
    rows = B.read_taxonomy(spark, str(path)).orderBy("entry").collect()
    assert [(r["entry"], r["name"], r["aliases"]) for r in rows] == [(0, "C++", ["cpp"]), (1, "Go", [])]
    assert B.read_taxonomy(spark, str(tmp_path / "none.json")).count() == 0


def test_load_or_build_builds_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert B.load_or_build(spark, path, build).count() == 3 and B.load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def test_stream_equals_batch_and_goes_on_after_a_failure(spark, tmp_path):
    docs = Inputs(spark, SMALL).documents
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    plan = lambda df: df.select("doc_id", F.length("text").alias("n"))
    state = {"batches": 0}

    def breaks(batch):
        state["batches"] += 1
        if state["batches"] == 2:
            plan(batch).write.parquet(str(tmp_path / "half"))  # work that a lost batch leaves behind
            raise RuntimeError("lost")
        return plan(batch)

    def run(f):
        A.score_arrivals(A.read_arrivals(spark, str(tmp_path / "in"), docs.schema, files_per_batch=2), f, str(tmp_path / "out"), str(tmp_path / "mark"))

    with pytest.raises(Exception, match="lost"):
        run(breaks)
    run(plan)
    run(plan)  # nothing new
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 3
    assert sorted(map(tuple, got.select("doc_id", "n").collect())) == sorted(map(tuple, plan(docs).collect()))


def test_registered_stream_scores_equal_the_table(spark):
    import __spark_entry__ as entry
    queries = entry.queries()
    got, want = (sorted(map(tuple, queries[k](spark, SMALL).collect())) for k in ("st_score_arrivals", "sc_overall"))
    assert got == want


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2]])
def test_the_earliest_upload_stays_whatever_the_order(spark, tmp_path, order):
    df = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id / 2 as int)) AS ts, id % 4 AS k FROM range(40)")
    told = str(tmp_path / "out")
    for part in order:
        df.filter(F.floor(F.col("id") / 10) == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = A.read_arrivals(spark, str(tmp_path / "in"), df.schema)
        A.run_batches(A.dedup_uploads(stream, "ts", "id", F.col("k").cast("string")), lambda b, _: b, told, str(tmp_path / "mark"), "update")
    got = A.survivors(spark.read.schema("upload_key string, ts_us long, row_id long").parquet(told)).collect()
    assert sorted((r.upload_key, r.row_id) for r in got) == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]


def test_state_of_a_key_ends_with_its_timer():
    class State:
        exists, hasTimedOut, get, removed, until = False, False, None, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.removed = True

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, ms):
            self.until = ms

    state = State()
    rows = lambda *r: iter([pd.DataFrame(r, columns=["ts_us", "row_id"])])
    (out,) = A._earliest(("k",), rows((5_000_000, 9), (5_000_000, 7)), state)
    assert out.values.tolist() == [["k", 5_000_000, 7]] and state.until == 5_000 + 1 + A._HORIZON_MS
    assert list(A._earliest(("k",), rows((6_000_000, 1)), state)) == []
    (out,) = A._earliest(("k",), rows((1, 99)), state)
    assert out.values.tolist() == [["k", 1, 99]]
    state.hasTimedOut = True
    assert list(A._earliest(("k",), iter([]), state)) == [] and state.removed


def test_bands_are_final_provisional_or_late(spark, tmp_path):
    """Four days in three batches; the last batch brings a row of a closed day, one of the open day and a new day."""
    out = str(tmp_path / "out")
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {})"
    batches = [[1, 2, 20, 30], [50, 60], [3, 61, 80]]
    for hours in batches:
        rows = spark.sql(" UNION ALL ".join(f"SELECT {at.format(h)} AS ts, 80.0D AS v" for h in hours))
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        A.run_bands(A.read_arrivals(spark, str(tmp_path / "in"), rows.schema), "ts", "v", out, str(tmp_path / "mark"))
    got = {r.window_start.day: (r.rows, r.late, r.final) for r in A.running_bands(A.read_bands(spark, out)).collect()}
    assert got == {1: (3, 1, True), 2: (1, 0, True), 3: (3, 0, True), 4: (1, 0, False)}


def test_registered_bands_cover_every_event(spark):
    import __spark_entry__ as entry
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = A.bands(events, "ts", "value").select(F.col("window_start").cast("timestamp_ntz"), "band", "rows")
    got = entry.queries()["st_running_bands"](spark, SMALL).collect()
    assert sorted((r.window_start, r.band, r["rows"] + r["late"]) for r in got) == sorted(map(tuple, want.collect()))
    assert any(r["late"] for r in got) and any(r["final"] for r in got) and not all(r["final"] for r in got)


def test_uploads_are_told_by_spark_itself_and_none_is_lost(spark, tmp_path):
    """No call of Python for a key; a key without any time stays, and one with a time keeps its earliest row."""
    rows = [(1, "2024-01-02 00:00:00", "a"), (2, "2024-01-01 00:00:00", "a"), (3, None, "a"), (4, None, "b"), (5, None, "b"), (6, "2024-01-01 00:00:00", "a")]
    df = spark.createDataFrame(rows, "id long, at string, k string").selectExpr("id", "cast(at AS timestamp) AS ts", "k")
    told, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for part in ("id IN (1, 5, 6)", "id IN (2, 3, 4)"):
        df.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = A.dedup_uploads(A.read_arrivals(spark, str(tmp_path / "in"), df.schema), "ts", "id", F.col("k"), "400 days")
        assert "FlatMapGroups" not in stream._jdf.queryExecution().analyzed().toString()
        A.run_batches(stream, lambda b, _: b, told, mark, "update")
    got = A.survivors(spark.read.schema("upload_key string, ts_us long, row_id long").parquet(told)).collect()
    assert sorted((r.upload_key, r.row_id, r.ts is None) for r in got) == [("a", 2, False), ("b", 4, True)]


def test_files_are_parsed_a_few_at_a_time():
    """A worker holds the texts of a few files, whatever the size of a batch; all rows come out in order."""
    rows = 2 * S.FILES_AT_ONCE + 3
    out = list(S._parse_docx(iter([pd.DataFrame({"path": [f"p{i}" for i in range(rows)], "content": [b"no zip"] * rows}), pd.DataFrame({"path": [], "content": []})])))
    assert [len(part) for part in out] == [S.FILES_AT_ONCE, S.FILES_AT_ONCE, 3]
    assert [p for part in out for p in part["path"]] == [f"p{i}" for i in range(rows)]
    assert all(part["error"].tolist() == [S.DOCX_ERROR + "File is not a zip file"] * len(part) for part in out)
