"""Word files, the versioned table, state files, logs, grids and streams of files."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters, ingest, registry
from tessera.operators.matrix import cells
from tessera.operators.ranking import recent
from tessera.operators.vectors import nearest_to_each
from tessera.sources import documents, models, tables, workbooks
from tessera.streaming.feeds import ingest_files


@pytest.fixture
def store(tmp_path):
    for project, name, body in (("oem_a", "x_rfq.docx", "first\nsecond"), ("oem_b", "y_summary.docx", "third")):
        (tmp_path / "kb" / project).mkdir(parents=True)
        documents.write_docx(str(tmp_path / "kb" / project / name), "Title", body)
    (tmp_path / "kb" / "oem_b" / "broken.docx").write_bytes(b"no archive")
    return tmp_path


def test_scan_and_extract(spark, store):
    rows = documents.described(documents.scan(spark, str(store / "kb")), str(store / "kb")).withColumn("x", documents.extract("content")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["project_name"], r["doc_type"]) for r in rows] == [("oem_a/x_rfq.docx", "Oem A", "rfq"), ("oem_b/broken.docx", "Oem B", "summary"), ("oem_b/y_summary.docx", "Oem B", "summary")]
    assert rows[0]["x"]["text"] == "Title\nfirst\nsecond"
    assert rows[1]["x"]["text"] is None and rows[1]["x"]["error"]
    assert documents.scan(spark, str(store / "nowhere")).count() == 0


def test_files_as_a_stream_are_taken_once(spark, store):
    versions = ingest.Versions(spark, str(store / "table"))
    for _ in range(2):
        ingest_files(spark, str(store / "kb"), versions, str(store / "dead"), str(store / "state")).start().awaitTermination()
    assert versions.read().count() == 2
    assert spark.read.json(str(store / "dead")).count() == 1
    documents.write_docx(str(store / "kb" / "oem_a" / "z.docx"), "New", "text")
    ingest_files(spark, str(store / "kb"), versions, str(store / "dead"), str(store / "state")).start().awaitTermination()
    assert versions.read().count() == 3
    versions.expire(1)
    assert len(versions.names()) == 1


def test_classify_twice(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, hash string")
    none = rows.limit(0)
    assert ingest.counters(ingest.classify(rows, none)).first()["n_new"] == 2
    again = ingest.counters(ingest.classify(rows, rows)).first()
    assert (again["n_new"], again["n_unchanged"], again["n_total"]) == (0, 2, 2)
    assert ingest.pending(rows, rows).count() == 0


def test_state_and_log(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.read_state(spark, path).count() == 0
    state = spark.createDataFrame([("2026-01-01T00:00:00Z", [("a", "bad")])], tables.STATE)
    tables.write_state(state, path)
    assert tables.read_state(spark, path).first()["failed_files"][0]["doc_id"] == "a"
    log = str(tmp_path / "log")
    for k in range(3):
        tables.append_log(spark.createDataFrame([(str(k), k)], "created_at string, feedback_id int"), log)
    assert [r["feedback_id"] for r in tables.read_log(spark, log, "created_at string, feedback_id int", 2, 1).collect()] == [1, 2]


def test_resolve(spark):
    catalog = spark.createDataFrame([("a.docx",), ("b.docx",)], "filename string")
    files = spark.createDataFrame([("a.docx",)], "filename string")
    assert [tables.resolve(catalog, files, n).first()["error"] for n in ("a.docx", "b.docx", "../a.docx")] == [None, 404, 400]


def test_grids(spark, tmp_path):
    rows = spark.createDataFrame([(1, "why?", "PM", "高", "")], "no int, question string, function string, impact string, history_reference string")
    grid = registry.create("questions")(rows, title="List")
    assert {(r["row"], r["col"]): r["value"] for r in grid.collect()}[(3, 2)] == "why?"
    workbooks.write_xlsx(grid, str(tmp_path / "q.xlsx"))
    assert (tmp_path / "q.xlsx").stat().st_size > 500
    assert registry.names() == ["project_information", "questions", "staffing", "staffing_summary"]
    with pytest.raises(KeyError):
        registry.create("unknown")


def test_uploads(spark):
    rows = spark.createDataFrame([("a.docx", bytearray(b"x")), ("../b.DOCX", bytearray(b"x" * 10)), ("c.pdf", bytearray(b"x"))], "name string, content binary")
    got = filters.uploads(rows, 10).select(F.regexp_replace("stored_name", "^[0-9a-f]{32}_", "").alias("n")).collect()
    assert sorted(r["n"] for r in got) == ["a.docx", "b.DOCX"]


def test_recent_takes_the_newest_of_each_file(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 3)], "task_id int, file_name string, created_at int")
    assert [r["task_id"] for r in recent(rows, 20).collect()] == [2, 3]
    assert [r["task_id"] for r in recent(rows, 2, unique=False).collect()] == [2, 3]


def test_empty_inputs(spark):
    projects = spark.createDataFrame([], "proj_ord int, project_name string, dimensions map<string,struct<value:string,match:boolean>>, summary string, actual_man_days int, deviation_rate string")
    assert cells(projects, ["平台类型"]).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    assert {(r["query_id"], r["vec_id"]) for r in nearest_to_each(vectors, queries, 5).collect()} == {(1, 2), (2, 1)}
    assert nearest_to_each(vectors, queries.limit(0), 5).count() == 0


def test_neighbours_of_many_batches(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (5000, 3)).astype(float)  # few values, so that there are many ties
    vectors[:, 0] += 0.5
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(9000, [1.0, None, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    queries = corpus.where("vec_id % 1000 = 0 and vec_id < 9000").withColumnRenamed("vec_id", "query_id")
    got = nearest_to_each(corpus, queries, 7, block=2).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 5000, 1000):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        similar = np.delete(unit @ unit[q], q)
        assert len(own) == 7 and np.allclose([r["similarity"] for r in own], np.sort(similar)[::-1][:7])
        assert all(r["vec_id"] not in (q, 9000) for r in own)


def test_a_list_too_long_for_an_expression_is_joined(spark, monkeypatch):
    from tessera.operators import joins

    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key_ord int, key string")
    projects = spark.createDataFrame([("xBx",), (None,)], "project_name string")
    assert [r["baseline_key"] for r in joins.baseline_of(projects, names).collect()] == ["b", "default"]
    monkeypatch.setattr(joins, "LIST_ROWS", 2)
    assert sorted(r["baseline_key"] for r in joins.baseline_of(projects, names).collect()) == ["b", "default"]


def test_a_failing_model_is_a_value(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "id int, prompt string")

    def call(prompt):
        if prompt.startswith("q"):
            raise OSError("down")
        return '{"ok": true}'

    got = {r["id"]: r for r in models.complete(rows, call).collect()}
    assert got[1]["answer"] and got[1]["attempts"] == 1
    assert got[2]["answer"] is None and got[2]["attempts"] == 3 and "down" in got[2]["error"]


def test_workbooks_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "why <b>?", "PM", "高", None), (3, "how", "", "低", "A / B")], "no int, question string, function string, impact string, history_reference string")
    workbooks.write_xlsx(registry.create("questions")(rows), str(tmp_path / "q.xlsx"))
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    files = documents.scan(spark, str(tmp_path), "*.xlsx")
    grid = workbooks.read_workbooks(files)
    assert [r["error"] is not None for r in grid.where("path like '%bad.xlsx'").collect()] == [True]
    got = workbooks.question_rows(grid.where("error is null")).orderBy("row").collect()
    assert [(r["row"], r["no"], r["question"], r["function"], r["history_reference"]) for r in got] == [(2, "1", "why <b>?", "PM", None), (4, "3", "how", None, "A / B")]


def test_baselines_come_back_from_a_quote(spark, tmp_path):
    from tessera.operators.planning import baseline, plan

    projects = spark.createDataFrame([(1, "default", 20, False)], "project_id int, baseline_key string, months int, is_complex boolean")
    planned = plan(projects, baseline(spark))
    grid = workbooks.staffing_grid(planned).unionByName(workbooks.summary_grid(planned))
    assert {(r["row"], r["col"]): r["value"] for r in grid.where("sheet = 'Manpower'").collect()} == {(3, 1): "PM", (3, 2): "Project Management", (3, 3): "8.0", (4, 1): "Chassis", (4, 2): "Chassis Engineering", (4, 3): "50.0"}
    workbooks.write_xlsx(grid, str(tmp_path / "quote.xlsx"))
    got = workbooks.baselines_of(workbooks.read_workbooks(documents.scan(spark, str(tmp_path), "*.xlsx")))
    rows = {r["position"]: (r["function"], r["tariff"], r["man_days"], r["share"]) for r in got.collect()}
    assert rows["PM"] == ("PM", "TE", 132.0, 0.75) and rows["PMA"][3] == 0.25 and len(rows) == 7
    none = workbooks.summary_grid(planned.limit(0))
    assert [r["value"] for r in none.where("col = 3").collect()] == ["0.0", "0.0"]


def test_jobs_count_what_they_take(spark, store):
    from tessera import jobs
    from tessera.streaming.feeds import reindex

    table = str(store / "table")
    assert jobs.ingest(spark, str(store / "kb"), table) == {"n_new": 2, "n_changed": 0, "n_unchanged": 0, "n_deleted": 0, "n_total": 2}
    assert jobs.ingest(spark, str(store / "kb"), table)["n_unchanged"] == 2
    documents.write_docx(str(store / "kb" / "oem_a" / "x_rfq.docx"), "Title", "changed")
    (store / "kb" / "oem_b" / "y_summary.docx").unlink()
    again = reindex(spark, str(store / "kb"), ingest.Versions(spark, table)).first().asDict()
    assert (again["n_changed"], again["n_deleted"], again["n_total"]) == (1, 1, 1)


def test_uploads_are_stored_with_their_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("a.docx", bytearray(b"xy")), ("c.pdf", bytearray(b"x"))], "name string, content binary")
    for _ in range(2):
        filters.store_uploads(rows, str(tmp_path / "uploads"))
    got = spark.read.parquet(str(tmp_path / "uploads")).collect()
    assert [bytes(r["content"]) for r in got] == [b"xy"] * 2 and len({r["stored_name"] for r in got}) == 2


def test_word_files_of_odd_texts(spark):
    from tessera.sources import documents

    rows = spark.createDataFrame([(1, "T", "a & <b>\n\n  c\t"), (2, None, None), (3, "x\x00y", "\U0001f600\r\nend"), (4, "", "")], "id int, title string, body string")
    got = {r["id"]: (r["x"]["text"], r["x"]["error"]) for r in rows.withColumn("x", documents.extract(documents.word_file("title", "body"))).collect()}
    assert got[1] == ("T\na & <b>\nc", None) and got[3] == ("x y\n\U0001f600\nend", None)
    assert got[2] == got[4] == (None, "ValueError: document is empty")


def test_files_are_unpacked_a_few_at_once(spark, tmp_path, monkeypatch):
    """A batch of a hundred files never has more than ``FILES_AT_ONCE`` of them unpacked; rows stay in their order."""
    import pyarrow as pa

    from tessera.sources import documents, templates, workbooks

    batch = pa.array(range(100))
    parts = list(tables.in_slices([batch, batch.slice(0, 0)]))
    assert max(map(len, parts)) <= tables.FILES_AT_ONCE < 100 and pa.concat_arrays(parts) == batch
    docx, xlsx = documents.docx_bytes("T", "body"), workbooks.xlsx_bytes([("A", 1, 1, "x")])
    for udf, value in ((documents.extract, pa.array([docx] * 100)), (workbooks.read_cells, pa.array([xlsx] * 100)), (documents.word_file, (pa.array(["t"] * 100), pa.array(["b"] * 100)))):
        sizes = [len(part) for part in udf.func(iter([value]))]
        assert sum(sizes) == 100 and max(sizes) <= tables.FILES_AT_ONCE
    grid = spark.range(100, numPartitions=1).selectExpr("id AS book", "'A' AS sheet", "1 AS row", "1 AS col", "CAST(id AS string) AS value")
    made = templates.fill_template(grid, xlsx)
    assert {(r.path, r.value) for r in workbooks.read_workbooks(made.selectExpr("book AS path", "content")).collect()} == {(k, str(k)) for k in range(100)}
