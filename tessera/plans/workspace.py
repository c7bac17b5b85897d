"""Queries over stored projects, workbooks, task rows and requests that the other plans do not ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import aggregates, filters, ingest, joins, ranking, registry, workflow
from tessera.plans.projects import _PLAN, _plan, _sets, _sets_sql
from tessera.plans.retrieval import _NEAR, _neighbours
from tessera.sources import documents, models, tables, templates, workbooks
from tessera.sources.tables import table


def _names(*values: str):
    return F.array(*map(F.lit, values))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05, SRC-06: stored metadata as text of every second asked id."""
    docs = table(spark, d, "documents")
    meta = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("doc_id") % 3 == 0, F.col("source"))), lambda _, v: v.isNotNull())
    stored = docs.where("doc_id % 2 = 0").select(*ingest.chunk_record(F.col("doc_id"), F.col("text"), meta))
    got = ingest.metadata_of(stored.select("doc_id", "meta"), docs.select("doc_id"))
    return got.select("doc_id", "found", F.try_element_at("meta", F.lit("lang")).alias("lang"), F.try_element_at("meta", F.lit("source")).alias("source"))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05, SF-15: chunks of stored length, replaced by id."""
    docs = table(spark, d, "documents").select(*ingest.chunk_record(F.col("doc_id"), F.col("text"), F.create_map(F.lit("lang"), F.col("lang"))))
    old = docs.where("doc_id % 3 <> 0").withColumn("text", F.lit("old"))
    got = ingest.upsert(old, docs.where("doc_id % 3 <> 1"))
    return got.select("doc_id", F.length("text").alias("n_stored"), "hash")


def updated_tasks(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08, FIL-09: changes laid over task rows; progress text as a number."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("progress"), F.col("o_custkey").cast("string").alias("file_name"))
    changes = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "completed").alias("status"), F.lit("100").alias("progress"))
    got = ingest.updated(rows, changes, "o_orderkey")
    return got.select("o_orderkey", "status", workflow.progress_value(F.col("progress")).alias("progress"), "file_name")


def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG-03, SRC-07"""
    return aggregates.store_stats(table(spark, d, "documents"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") % 7), "source")


def inferred(spark: SparkSession, d: str) -> DataFrame:
    """FIL-12, AG-08: profiles of parsed requests that have none."""
    names = F.slice(_names("PM", "Chassis", "BIW", "CAE", "EE"), 1, (F.col("p_size") % 6).cast("int"))
    module = lambda n: F.struct(F.slice(_names("a", "a", "b"), 1, n.cast("int")).alias("deliverables"))
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("platform"), names.alias("f"), F.array(module(F.col("p_size") % 4), module(F.col("p_partkey") % 3)).alias("modules"))
    p = T.inferred_profile(F.col("platform"), F.col("f"), T.deliverable_total(F.col("modules")))
    return rows.select("p_partkey", F.explode(p).alias("dimension", "value"))


def summary_sheet(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: the summary sheet of all plans together."""
    return registry.create("staffing_summary")(_plan(spark, d))


def staffing_sheets(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10, AG-05: the function sheets of each plan."""
    plans = _plan(spark, d)
    first = plans.groupBy("function").agg(F.min("pos_ord").alias("first"))
    plans = plans.join(F.broadcast(first), "function").withColumn("pos_ord", F.col("pos_ord") - F.col("first"))  # a row for each function of the baseline
    grid = workbooks.staffing_grid(plans.select(F.concat_ws("-", "project_id", "function").alias("function"), "pos_ord", "position", "tariff", "monthly"))
    return grid.where("value is not null").select("sheet", "row", "col", F.coalesce(F.round(F.col("value").try_cast("double"), 1).cast("string"), "value").alias("value"))


def information_sheet(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10, WN-04: the information sheet of each order."""
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    marks = F.map_filter(F.create_map(F.lit("SOP"), F.lit("2030-01-01"), F.lit("P1"), start, F.lit("P3"), F.when(F.col("o_orderkey") % 2 == 0, start)), lambda _, v: v.isNotNull())
    rows = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("customer"), F.lit("p").alias("project_name"), F.lit("q").alias("quotation_no"), F.lit("e").alias("edit_by"), start.alias("start"), F.lit(3).alias("months"), marks.alias("milestones"))
    return registry.create("project_information")(rows).groupBy("row", "col").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def question_sheet(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: question lists with a title, cell by cell."""
    rows = table(spark, d, "conversations").select(F.col("turn").alias("no"), F.col("role").alias("question"), F.lit("PM").alias("function"), F.lit("高").alias("impact"), F.lit("").alias("history_reference"))
    return registry.create("questions")(rows, title="List").groupBy("sheet", "row", "col", "value").agg(F.count("*").alias("n"))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    """FIL-06, SRC-26, SF-28"""
    some = lambda k: F.when(F.col("event_id") % k == 0, F.col("props")).when(F.col("event_id") % k == 1, "")
    rows = table(spark, d, "events").select("event_type", *(some(k).alias(c) for k, c in enumerate(("parsed", "comparison", "draft", "questions", "workbook"), 2)), F.when(F.col("event_id") % 4 > 0, F.col("user_id") % 2 == 0).alias("there"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))).alias("name"))
    got = workflow.readiness(rows).withColumn("state", workflow.artefact_state(F.col("workbook"), F.col("there")))
    got = got.withColumn("named", workflow.with_project_name(F.struct(F.lit("draft").alias("project_name"), F.lit(1).alias("n")), F.col("name"))["project_name"])
    return got.groupBy("has_parsed", "has_comparison", "has_draft", "has_questions", "has_workbook", "state", "named").agg(F.count("*").alias("n"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15, JN-07: customers of a nation that has a supplier."""
    files = table(spark, d, "supplier").select(F.col("s_nationkey").alias("filename"))
    return tables.existing(table(spark, d, "customer").select(F.col("c_nationkey").alias("filename"), "c_custkey"), files).select("c_custkey")


def top_three(spark: SparkSession, d: str) -> DataFrame:
    """SL-07: labels with fewer than three vectors of a small norm part warn."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first")).where("first > 0.25")
    return ranking.top_with_warning(rows, "label", [F.desc("first"), "vec_id"]).select("label", "rank", "vec_id", "warning")


def ratio_order(spark: SparkSession, d: str) -> DataFrame:
    """SL-05: functions by falling coverage."""
    ratios = aggregates.coverage_ratios(_sets(spark, d, 97.0), "functions", ["purchase", "view", "error", "signup", "click", "none"])
    ordered = ranking.by_ratio(ratios.withColumn("ratio", F.round("ratio", 6)), "ratio", "function").limit(4)
    return ranking.numbered(ordered, [F.desc("ratio"), "function"]).withColumn("no", F.col("no").cast("int"))


def newest(spark: SparkSession, d: str) -> DataFrame:
    """SL-03, WN-01: the newest tasks, and the newest of each file among them."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("file_name"), F.col("ts").alias("created_at"))
    kinds = [ranking.recent(rows, n, u).select(F.lit(f"{n} {u}").alias("asked"), "task_id", "file_name") for n, u in ((20, True), (500, False), (0, True))]
    return kinds[0].union(kinds[1]).union(kinds[2])


def search_requests(spark: SparkSession, d: str) -> DataFrame:
    """FIL-03, FIL-10, FIL-13"""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 7 > 0, F.left("p_type", (F.col("p_partkey") % 7).cast("int"))).alias("q"))
    return rows.select(
        "p_partkey", filters.valid_search(F.col("q"), F.col("p_size"), (F.col("p_partkey") % 12) / 10).alias("valid"),
        T.model_installed(_names("Qwen:14b", "other"), F.when(F.col("p_size") % 3 == 0, "qwen:7b").when(F.col("p_size") % 3 == 1, "OTHER").otherwise("none")).alias("installed"),
        T.query_text(F.when(F.col("p_size") > 25, F.col("p_brand")), F.slice(_names("PM", "BIW", "EE"), 1, (F.col("p_size") % 4).cast("int"))).alias("query"),
    )


def matrix_edits(spark: SparkSession, d: str) -> DataFrame:
    """FIL-15, FIL-19, FIL-22, FIL-23, ST-06, WN-03"""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("dimension"), F.col("n_regionkey").cast("string").alias("new_project"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey") > 2).alias("in_scope"), F.col("n_name").alias("content"))
    got = filters.in_scope_only(filters.set_cell(rows, "NATION_3", "edited"))
    steps = V.step_status(F.array(F.col("n_regionkey") > 0, F.col("n_regionkey") > 1, F.lit(False)), F.col("n_regionkey").cast("int"))
    laid = V.overlay(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.col("new_project"), F.lit("c"), F.col("dimension")))
    first = V.first_places(F.array(F.nullif("new_project", F.lit("1")), F.nullif("new_project", F.lit("2")), F.col("dimension")))
    return got.select("n_nationkey", "new_project", "content", F.array_join(steps, ",").alias("steps"), F.concat_ws(",", *(F.element_at(laid, k) for k in "abc")).alias("laid"), F.array_join(first, ",").alias("first"))


def written_forms(spark: SparkSession, d: str) -> DataFrame:
    """SF-15, SF-17, SF-26, SF-29, SF-30, SF-31, SRC-12, UD-04"""
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "props", (F.col("event_id") % 9 + 1).cast("int").alias("m"))
    question = F.concat(F.lit("Load "), F.when(F.col("event_id") % 3 == 0, "case").when(F.col("event_id") % 3 == 1, "meeting").otherwise(""))
    asked = F.when(F.col("event_id") % 2 == 0, F.replace(question, F.lit("Load"), F.lit("Any"))).otherwise(question)
    return rows.select(
        "event_id", V.iso_utc(F.col("ts")).alias("stamp"), T.fill_prompt(F.lit("ask {x} twice {x}"), "{x}", F.col("event_type")).alias("prompt"), T.history_reference(F.col("event_type"), F.nullif(F.col("m"), F.lit(2)).cast("string"), F.lit(2024)).alias("reference"),
        T.impact_by_keyword(asked).alias("impact"), F.array_join(V.remap_timeline(F.array(*(F.lit(float(x)) for x in (1, 2, 4, 8))), F.col("m")).cast("array<int>").cast("array<string>"), ",").alias("timeline"), F.left("props", F.lit(5)).alias("short"), F.lit(models.versioned("prompts/", "v1", "parse")).alias("path"),
    )


def quotations(spark: SparkSession, d: str) -> DataFrame:
    """SF-21"""
    return table(spark, d, "orders").select("o_orderkey", V.quotation_number(F.col("o_orderdate"), F.concat(F.lit("project "), F.col("o_custkey").cast("string"))).alias("quotation"))


def word_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02, SRC-18, FIL-04, SF-16: every document as a Word file of its project, read back as an import would."""
    kind = F.element_at(_names("rfq", "qa", "quote", "notes"), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/kb/"), "source", F.lit("_team/"), F.col("doc_id").cast("string"), F.lit("_"), kind, F.lit(".docx"))
    docs = table(spark, d, "documents").select(path.alias("path"), documents.word_file("lang", "text").alias("content"))
    files = docs.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.length("content").cast("long").alias("length"), "content")
    got = documents.described(files, "/kb").withColumn("x", documents.extract("content"))
    return got.select("doc_id", "project_name", "doc_type", F.length("x.text").alias("n_chars"), F.sha2("x.text", 256).alias("text_sha256"), "x.error")


def quote_books(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10, SRC-18: each project's plan filled into a copy of the quote template, and what the workbooks then hold, read back."""
    plans = _plan(spark, d)
    grid = workbooks.staffing_grid(plans.select(F.concat_ws("-", "project_id", "function").alias("function"), "pos_ord", "position", "tariff", "monthly"))
    place = F.split(F.col("sheet"), "-")
    cells = grid.select(place[0].alias("book"), place[1].alias("sheet"), "row", "col", "value")
    made = templates.fill_template(cells, templates.quote_template())
    held = workbooks.read_workbooks(made.select(F.col("book").alias("path"), "content"))
    number = F.when((F.col("row") >= workbooks.FIRST_ROW) & (F.col("col") >= workbooks.FIRST_MONTH_COLUMN), F.col("value").try_cast("double"))
    return held.groupBy(F.col("path").alias("project"), "sheet").agg(F.count("*").alias("n_cells"), F.round(F.coalesce(F.sum(number), F.lit(0.0)), 1).alias("total"), F.max("error").alias("error"))


def question_records(spark: SparkSession, d: str) -> DataFrame:
    """SRC-22: conversations as question workbooks of eight columns, each of 256 turns, read back one record a row."""
    book = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 256))
    rows = table(spark, d, "conversations").select(book.alias("book"), (F.col("turn") % 256 + 2).cast("int").alias("row"), "turn", "role", "text")
    values = (F.col("turn").cast("string"), F.col("role"), F.lit(None).cast("string"), F.md5(F.col("text").cast("binary")), F.lit("a"), F.when(F.col("turn") % 2 == 0, "yes"), F.lit("高"), F.lit("3 / p"))
    body = rows.select("book", F.lit("Q&A").alias("sheet"), "row", F.inline(F.array(*(F.struct(F.lit(i).alias("col"), v.alias("value")) for i, v in enumerate(values, 1)))))
    head = [("Q&A", 1, i, c) for i, c in enumerate(workbooks.QUESTION_RECORD, 1)]
    made = templates.fill_template(body, workbooks.xlsx_bytes(head))
    grid = workbooks.read_workbooks(made.select(F.col("book").alias("path"), "content")).where("error is null")
    return workbooks.question_rows(grid, workbooks.QUESTION_RECORD).select("path", "row", *workbooks.QUESTION_RECORD)


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """SRC-25, SRC-19: texts cut at numbered headings; what is older than thirty days."""
    text = F.concat(F.lit("intro\n1 First "), F.col("c_name"), F.lit("\nbody 2 x\n2.1 Second\nend\n\n"), F.when(F.col("c_nationkey") > 12, "3. Third").otherwise(""))
    rows = table(spark, d, "customer").select("c_custkey", text.alias("text"), F.make_timestamp(F.lit(2026), F.lit(1), (F.col("c_nationkey") + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("modificationTime"))
    old = documents.expired(rows, F.lit("2026-02-10 00:00:00").cast("timestamp")).select("c_custkey", F.lit(True).alias("old"))
    got = documents.chapters(rows).join(old, "c_custkey", "left")
    return got.select("c_custkey", F.col("chapter_ord").cast("int").alias("ord"), F.btrim("chapter", F.lit("\n ")).alias("chapter"), F.coalesce("old", F.lit(False)).alias("old"))


def hit_chunks(spark: SparkSession, d: str) -> DataFrame:
    """JN-10: each source with the start of its first document."""
    docs = table(spark, d, "documents")
    hits = docs.select(F.col("doc_id").alias("hit_id"), F.col("source").alias("project_name"), F.col("text").alias("content"))
    got = joins.with_hit(docs.select(F.when(F.col("doc_id") % 5 > 0, F.col("source")).otherwise("none").alias("project_name")).distinct(), hits)
    return got.select("project_name", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("digest"))


def scope_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """JN-14: functions of requests that no mapping covers."""
    scope = _sets(spark, d, 95.0).select("user_id", F.explode("functions").alias("item"))
    return joins.unmapped(scope, spark.createDataFrame([("view",), ("click",), ("view",)], "item string"))


def top_questions(spark: SparkSession, d: str) -> DataFrame:
    """JN-15: question rows of the packages of the three most similar projects."""
    hits = _neighbours(spark, d, 5).select("query_id", F.col("vec_id").alias("engagement_id"), "rank")
    packages = table(spark, d, "conversations").select(F.col("conv_id").alias("engagement_id"), F.concat(F.lit("qa/"), F.col("conv_id").cast("string")).alias("path")).distinct()
    questions = table(spark, d, "conversations").where("role = 'user'").select(F.concat(F.lit("qa/"), F.col("conv_id").cast("string")).alias("path"), "turn", "text")
    return joins.questions_of_top(hits, packages, questions).select("query_id", "rank", "path", "turn", F.length("text").alias("n"))


def best_baselines(spark: SparkSession, d: str) -> DataFrame:
    """JN-16, AG-16: baseline rows of the best matching project, for the functions in scope."""
    best = joins.best_scope(
        _sets(spark, d, 98.0).select(F.col("user_id").alias("request_id"), F.col("functions").alias("scope")),
        _sets(spark, d, 96.0).select(F.col("user_id").alias("project_id"), F.col("functions").alias("scope"), (F.col("user_id") % 7).cast("double").alias("score")),
    )
    days = table(spark, d, "events").groupBy(F.col("user_id").alias("project_id"), F.col("event_type").alias("function")).agg(F.count("*").alias("days"))
    scope = _sets(spark, d, 98.0).select(F.col("user_id").alias("request_id"), F.explode("functions").alias("function"))
    return joins.baselines_of_best(best, days, scope).select("request_id", "project_id", "function", "days")



QUERIES = {
    "metadata_lookup": metadata,
    "chunk_upsert": upserted,
    "task_update": updated_tasks,
    "store_statistics": store_statistics,
    "inferred_profiles": inferred,
    "staffing_summary_sheet": summary_sheet,
    "staffing_function_sheets": staffing_sheets,
    "project_information_sheet": information_sheet,
    "question_sheet": question_sheet,
    "artefact_readiness": readiness,
    "catalogue_of_existing": catalogue,
    "top_three_with_warning": top_three,
    "coverage_by_ratio": ratio_order,
    "recent_tasks": newest,
    "search_request_checks": search_requests,
    "matrix_edits": matrix_edits,
    "written_forms": written_forms,
    "quotation_numbers": quotations,
    "quote_workbooks": quote_books,
    "question_records": question_records,
    "word_files": word_files,
    "chapter_chunks": chapters,
    "project_chunks": hit_chunks,
    "scope_unmapped": scope_unmapped,
    "questions_of_top_projects": top_questions,
    "baselines_of_best_match": best_baselines,
}
ORACLE = {
    "metadata_lookup": "SELECT doc_id, doc_id % 2 = 0 AS found, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 6 = 0 THEN source END AS source FROM documents",
    "chunk_upsert": "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 1 THEN 3 ELSE least(length(text), 8000) END AS INTEGER) AS n_stored, sha256(text) AS hash FROM documents",
    "task_update": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'completed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END AS progress,
        CAST(o_custkey AS VARCHAR) AS file_name FROM orders""",
    "store_statistics": "SELECT count(*) AS n_documents, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n_chars % 7 ELSE 10 END) AS BIGINT) AS n_chunks, count(DISTINCT source) AS n_projects FROM documents",
    "inferred_profiles": """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '未知' END AS b, ['PM', 'Chassis', 'BIW', 'CAE', 'EE'][1:least(p_size % 6, 5)] AS f, p_size % 4 + p_partkey % 3 AS n FROM part),
        y AS (SELECT p_partkey, unnest([{'d': '平台类型', 'v': b}, {'d': '车身材料', 'v': '未知'}, {'d': '仿真类型', 'v': '未知'},
          {'d': '内外饰范围', 'v': CASE len(f) WHEN 0 THEN '未知' ELSE array_to_string(f[1:3], '、') END}, {'d': '交付物数量', 'v': CASE WHEN n > 0 THEN concat(n, '项') ELSE '未知' END}]) AS c FROM x)
        SELECT p_partkey, c.d AS dimension, c.v AS value FROM y""",
    "staffing_summary_sheet": f"""WITH {_PLAN}, t AS (SELECT function, CAST(round(sum(fte), 1) AS VARCHAR) AS v FROM cells GROUP BY function),
        x AS (SELECT CASE function WHEN 'PM' THEN 3 ELSE 4 END AS r, unnest([{{'c': 1, 'v': function}}, {{'c': 2, 'v': CASE function WHEN 'PM' THEN 'Project Management' ELSE 'Chassis Engineering' END}}, {{'c': 3, 'v': v}}]) AS c FROM t)
        SELECT 'Manpower' AS sheet, r AS "row", c.c AS col, c.v AS value FROM x""",
    "staffing_function_sheets": f"""WITH {_PLAN}, o(position, o, tariff) AS (VALUES ('PM', 0, 'TE'), ('PMA', 1, 'M'), ('Chassis module leader', 0, 'TE'), ('Front suspension', 1, 'H & SW'), ('Rear suspension', 2, 'M & SW'), ('Steering', 3, 'M & SW'), ('Brake&Wheel', 4, 'M & SW')),
        s AS (SELECT concat(project_id, '-', function) AS sheet, 5 + o AS "row", position, tariff, month, fte FROM cells JOIN o USING (position))
        SELECT sheet, "row", 3 + month AS col, CAST(fte AS VARCHAR) AS value FROM s UNION ALL SELECT DISTINCT sheet, "row", 1, position FROM s UNION ALL SELECT DISTINCT sheet, "row", 2, tariff FROM s
        UNION ALL SELECT sheet, "row", 3, CAST(round(sum(fte), 1) AS VARCHAR) FROM s GROUP BY sheet, "row" """,
    "project_information_sheet": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS c, strftime(o_orderdate, '%Y-%m-%d') AS s, month(o_orderdate) + 2 AS i, year(o_orderdate) AS y, day(o_orderdate) AS q, o_orderkey % 2 = 0 AS e FROM orders),
        x AS (SELECT unnest([{'r': 6, 'c': 2, 'v': c}, {'r': 7, 'c': 2, 'v': 'p'}, {'r': 8, 'c': 2, 'v': 'q'}, {'r': 10, 'c': 2, 'v': 'e'}, {'r': 12, 'c': 2, 'v': s}, {'r': 13, 'c': 2, 'v': '3'},
          {'r': 14, 'c': 2, 'v': CAST(make_date(y + i // 12, i % 12 + 1, least(q, 28)) AS VARCHAR)}, {'r': 2, 'c': 4, 'v': 'P1'}, {'r': 2, 'c': 5, 'v': CASE WHEN e THEN 'P3' ELSE 'SOP' END}, {'r': 2, 'c': 6, 'v': CASE WHEN e THEN 'SOP' END},
          {'r': 3, 'c': 4, 'v': s}, {'r': 3, 'c': 5, 'v': CASE WHEN e THEN s ELSE '2030-01-01' END}, {'r': 3, 'c': 6, 'v': CASE WHEN e THEN '2030-01-01' END}]) AS x FROM o)
        SELECT x.r AS "row", x.c AS col, count(*) AS n, min(x.v) AS least, max(x.v) AS most FROM x WHERE x.v IS NOT NULL GROUP BY ALL""",
    "question_sheet": """WITH x AS (SELECT turn + 2 AS r, unnest([{'c': 1, 'v': CAST(turn AS VARCHAR)}, {'c': 2, 'v': role}, {'c': 3, 'v': 'PM'}, {'c': 4, 'v': '高'}, {'c': 5, 'v': ''}]) AS x FROM conversations
        UNION ALL VALUES (1, {'c': 1, 'v': 'List'}), (2, {'c': 1, 'v': 'no'}), (2, {'c': 2, 'v': 'question'}), (2, {'c': 3, 'v': 'function'}), (2, {'c': 4, 'v': 'impact'}), (2, {'c': 5, 'v': 'history_reference'}))
        SELECT 'Q&A' AS sheet, CAST(r AS INTEGER) AS "row", x.c AS col, x.v AS value, count(*) AS n FROM x GROUP BY ALL""",
    "artefact_readiness": """SELECT event_id % 2 = 0 AS has_parsed, event_id % 3 = 0 AS has_comparison, event_id % 4 = 0 AS has_draft, event_id % 5 = 0 AS has_questions, event_id % 6 = 0 AS has_workbook,
        CASE WHEN event_id % 6 > 0 THEN 'never generated' WHEN event_id % 4 > 0 AND user_id % 2 = 0 THEN 'ready' ELSE 'missing' END AS state, CASE WHEN event_id % 4 > 0 THEN concat('u', user_id % 3) ELSE 'draft' END AS named, count(*) AS n FROM events GROUP BY ALL""",
    "catalogue_of_existing": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)",
    "top_three_with_warning": """WITH x AS (SELECT vec_id, label, round(embedding[1]::DOUBLE, 4) AS f FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM x WHERE f > 0.25)
        SELECT label, CAST(k AS INTEGER) AS rank, vec_id, CASE WHEN n < 3 THEN 'fewer than 3 similar projects' END AS warning FROM r WHERE k <= 3""",
    "coverage_by_ratio": f"""WITH x AS (SELECT s.x AS function, round(avg(CAST(list_contains(f, s.x) AS INTEGER)), 6) AS ratio FROM {_sets_sql(97.0)}, (SELECT unnest(['purchase', 'view', 'error', 'signup', 'click', 'none']) AS x) s GROUP BY s.x)
        SELECT function, ratio, CAST(row_number() OVER (ORDER BY ratio DESC, function) AS INTEGER) AS no FROM x QUALIFY no <= 4""",
    "recent_tasks": """WITH a AS (SELECT event_id AS task_id, user_id AS file_name, ts FROM events ORDER BY ts DESC, event_id LIMIT 100),
        u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY ts DESC, task_id) = 1 ORDER BY ts DESC, task_id LIMIT 20)
        SELECT '20 True' AS asked, task_id, file_name FROM u UNION ALL SELECT '500 False', task_id, file_name FROM a""",
    "search_request_checks": """SELECT p_partkey, p_partkey % 7 >= 2 AND length(left(p_type, CAST(p_partkey % 7 AS BIGINT))) >= 2 AND p_size BETWEEN 1 AND 20 AND p_partkey % 12 <= 10 AS valid, p_size % 3 <> 2 AS installed,
        coalesce(nullif(trim(concat_ws(' ', CASE WHEN p_size > 25 THEN p_brand END, array_to_string(['PM', 'BIW', 'EE'][1:least(p_size % 4, 2)], ' '))), ''), 'similar project') AS query FROM part""",
    "matrix_edits": """WITH x AS (SELECT *, CASE WHEN n_name = 'NATION_3' THEN 'edited' ELSE CAST(n_regionkey AS VARCHAR) END AS p FROM nation)
        SELECT n_nationkey, p AS new_project, CASE WHEN n_regionkey IN (1, 2) THEN '—' ELSE n_name END AS content,
          CASE n_regionkey WHEN 0 THEN 'process,wait,wait' WHEN 1 THEN 'finish,process,wait' WHEN 2 THEN 'finish,finish,process' ELSE 'finish,finish,wait' END AS steps,
          concat('1,', p, ',', n_name) AS laid, CASE WHEN p IN ('1', '2') THEN p ELSE concat(p, ',', p) END AS "first" FROM x""",
    "written_forms": """WITH x AS (SELECT *, CAST(event_id % 9 + 1 AS INTEGER) AS m FROM events)
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, concat('ask ', event_type, ' twice ', event_type) AS prompt, concat_ws(' / ', event_type, CAST(nullif(m, 2) AS VARCHAR), '2024') AS reference,
          CASE WHEN event_id % 2 = 1 THEN '高' WHEN event_id % 3 = 1 THEN '低' ELSE '中' END AS impact,
          array_to_string(list_transform(range(0, m), lambda i: CAST(pow(2, least(3, i * 4 // m)) AS INTEGER)), ',') AS timeline, left(props, 5) AS short, 'prompts/v1/parse.txt' AS path FROM x""",
    "quote_workbooks": f"""WITH {_PLAN},
        t(sheet, n) AS (VALUES ('How to Use', 1), ('Project information', 27), ('Manpower', 4), ('PM', 24), ('BIW', 24), ('Interior', 24), ('GI', 24), ('Test validation', 24), ('Chassis', 24), ('CAE', 24), ('EE', 24), ('PS', 24)),
        f AS (SELECT project_id, function AS sheet, count(DISTINCT position) * 23 AS n, round(sum(fte), 1) AS total FROM cells GROUP BY ALL)
        SELECT CAST(s_suppkey AS VARCHAR) AS project, t.sheet, t.n + coalesce(f.n, 0) AS n_cells, coalesce(total, 0) AS total, NULL::VARCHAR AS error FROM supplier CROSS JOIN t LEFT JOIN f ON f.project_id = s_suppkey AND f.sheet = t.sheet""",
    "question_records": """SELECT concat(conv_id, '-', turn // 256) AS path, CAST(turn % 256 + 2 AS INTEGER) AS "row", CAST(turn AS VARCHAR) AS no, role AS area, NULL::VARCHAR AS author, md5(text) AS question, 'a' AS assumption,
        CASE WHEN turn % 2 = 0 THEN 'yes' END AS answer_by_customer, '高' AS impact, '3 / p' AS history_reference FROM conversations""",
    "quotation_numbers": """SELECT o_orderkey, concat(strftime(o_orderdate, '%y'), lpad(CAST(('0x' || left(md5(concat('project ', o_custkey)), 8))::BIGINT % 10000 AS VARCHAR), 4, '0'), 'B000') AS quotation FROM orders""",
    "word_files": r"""WITH x AS (SELECT doc_id, source, list_aggregate(list_filter(list_transform(list_concat([lang], string_split(text, chr(10))), lambda l: trim(l, chr(32) || chr(9) || chr(13))), lambda l: l <> ''), 'string_agg', chr(10)) AS t FROM documents)
        SELECT concat(source, '_team/', doc_id, '_', ['rfq', 'qa', 'quote', 'notes'][doc_id % 4 + 1], '.docx') AS doc_id, concat(upper(source[1]), source[2:], ' Team') AS project_name, ['rfq', 'qa', 'quote_manpower', 'summary'][doc_id % 4 + 1] AS doc_type,
          CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS text_sha256, NULL::VARCHAR AS error FROM x""",
    "chapter_chunks": """WITH x AS (SELECT c_custkey, c_nationkey, unnest([{'i': 0, 'c': 'intro'}, {'i': 1, 'c': concat('1 First ', c_name, chr(10), 'body 2 x')}, {'i': 2, 'c': concat('2.1 Second', chr(10), 'end')}, {'i': 3, 'c': CASE WHEN c_nationkey > 12 THEN '3. Third' END}]) AS c FROM customer)
        SELECT c_custkey, c.i AS ord, c.c AS chapter, c_nationkey < 10 AS old FROM x WHERE c.c IS NOT NULL""",
    "project_chunks": """WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 5 > 0 THEN source ELSE 'none' END AS project_name FROM documents), f AS (SELECT source, left(arg_min(text, doc_id), 300) AS c FROM documents GROUP BY source)
        SELECT project_name, CAST(length(c) AS INTEGER) AS n, sha256(c) AS digest FROM p LEFT JOIN f ON source = project_name""",
    "scope_unmapped": f"SELECT user_id, item FROM (SELECT user_id, unnest(f) AS item FROM {_sets_sql(95.0)}) WHERE item NOT IN ('view', 'click')",
    "questions_of_top_projects": f"WITH {_NEAR} SELECT query_id, rank, concat('qa/', vec_id) AS path, turn, CAST(length(text) AS INTEGER) AS n FROM ranked JOIN conversations ON conv_id = vec_id WHERE rank <= 3 AND role = 'user'",
    "baselines_of_best_match": f"""WITH p AS (SELECT r.user_id AS request_id, r.f AS rf, p.user_id AS project_id, len(list_intersect(r.f, p.f)) / len(list_distinct(list_concat(r.f, p.f)))::DOUBLE AS m, p.user_id % 7 AS score FROM {_sets_sql(98.0)} r JOIN {_sets_sql(96.0)} p ON list_has_any(r.f, p.f)),
        b AS (SELECT request_id, project_id, unnest(rf) AS function FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY m DESC, score DESC, project_id) = 1)),
        d AS (SELECT user_id, event_type, count(*) AS days FROM events GROUP BY ALL)
        SELECT request_id, project_id, function, days FROM b LEFT JOIN d ON user_id = project_id AND event_type = function""",
}
