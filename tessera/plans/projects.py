"""Queries over projects, staffing plans, imports, question lists and task feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators import aggregates, filters, ingest, joins, matrix, planning, questions, ranking
from tessera.sources.tables import shared_folder, table
from tessera.streaming import feeds


def _sets(spark: SparkSession, d: str, above: float) -> DataFrame:
    """``user_id, functions``: for each user the event types that reach a value above a bound (none of them: empty), sorted."""
    reached = F.collect_set(F.when(F.col("value") > above, F.col("event_type")))  # as many as there are types
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(reached).alias("functions"))


def latest_task(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return ranking.latest(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    got = filters.overlapping(_sets(spark, d, 97.0), "functions", ["purchase", "error"])
    return got.select("user_id", F.array_join("functions", ",").alias("functions"))


def type_filter(spark: SparkSession, d: str) -> DataFrame:
    got = filters.among(table(spark, d, "documents").select("source", "lang"), "lang", ["en", "fr"])
    return got.groupBy("source", "lang").agg(F.count("*").alias("n"))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels")
    failed = marks.where("toxic = 1").select("doc_id", F.lit("rejected").alias("error"))
    got = filters.index_status(table(spark, d, "documents").select("doc_id"), failed, marks.where("quality = 1"))
    return got.groupBy("status", "error").agg(F.count("*").alias("n"))


def first_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    hits = docs.select(
        F.col("doc_id").alias("hit_id"), F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("project_name"),
        F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 100) / 100).alias("score"), F.col("lang").alias("source_doc"), F.col("n_chars").cast("string").alias("content"),
    )
    good = docs.join(table(spark, d, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    reference = good.select(
        F.col("doc_id").alias("ord"), F.col("source").alias("project_name"), F.lit(0.25).alias("score"), F.col("lang").alias("source_doc"),
        F.col("n_chars").cast("string").alias("actual_man_days"), F.lit("+8%").alias("deviation_rate"), F.concat(F.lit("project "), F.col("doc_id").cast("string")).alias("summary"),
    )
    return joins.projects_of_hits(hits, reference)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", ingest.content_hash(F.col("text")).alias("hash"))
    known = rows.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    gone = rows.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "hash")
    return ingest.classify(rows, known.union(gone))


def import_counters(spark: SparkSession, d: str) -> DataFrame:
    return ingest.counters(_outcomes(spark, d))


def _projects(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda value, match: F.struct(value.alias("value"), match.alias("match"))
    nation = F.concat(F.lit("platform "), F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 5).alias("group"), F.col("s_suppkey").alias("proj_ord"), F.col("s_name").alias("project_name"),
        F.create_map(F.lit("平台类型"), cell(nation, F.col("s_nationkey") < 10), F.lit("仿真类型"), cell(F.lit("正面+偏置"), F.lit(True))).alias("dimensions"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("about "), F.col("s_name"))).alias("summary"), F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey") * 10).alias("actual_man_days"),
        F.when(F.col("s_acctbal") > 5000, "+8%").alias("deviation_rate"),
    )


def project_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.cells(_projects(spark, d), ["平台类型", "车身材料"])


def derived_rows(spark: SparkSession, d: str) -> DataFrame:
    projects = _projects(spark, d)
    long = matrix.cells(projects, ["平台类型", "车身材料"]).join(projects.select("group", "proj_ord"), "proj_ord")
    rows = matrix.with_new_project(matrix.nest(long, ["group"]), {"平台类型": "MEB"})
    return rows.select("group", "dim_ord", "dimension", "new_project", F.array_join(F.transform("history", lambda h: F.concat_ws("=", h["project_name"], h["value"])), ";").alias("history"))


BASELINE_NAMES = ((1, "9"), (2, "PART 1"), (3, "part"), (4, "default"))


def substring_join(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame(list(BASELINE_NAMES), "key_ord int, key string")
    return joins.baseline_of(table(spark, d, "part").select("p_partkey", "p_name"), names, "p_name").select("p_partkey", "baseline_key")


_SCOPE = ("purchase", "view", "error", "signup", "click")


def uncovered(spark: SparkSession, d: str) -> DataFrame:
    got = _sets(spark, d, 95.0).withColumn("left", V.without(F.array(*map(F.lit, _SCOPE)), F.col("functions")))
    return got.select("user_id", F.array_join("left", ",").alias("uncovered"), V.coverage_bucket(F.size("functions") / len(_SCOPE)).alias("bucket"))


def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.coverage_ratios(_sets(spark, d, 95.0), "functions", list(_SCOPE)).select("function", F.round("ratio", 6).alias("ratio"))


def argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / 100000).alias("score"))
    return ranking.argmax_first(rows, "o_custkey", F.col("score"), "o_orderkey", "o_orderpriority")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("project_id"), F.when(F.col("s_suppkey") % 2 == 0, "hozon").otherwise("default").alias("baseline_key"),
        F.col("s_nationkey").alias("months"), (F.col("s_acctbal") > 0).alias("is_complex"),
    )
    return planning.plan(projects, planning.baseline(spark))


def monthly_plan(spark: SparkSession, d: str) -> DataFrame:
    return planning.months_long(_plan(spark, d), ["project_id", "function", "position"])


def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.function_totals(planning.months_long(_plan(spark, d), ["function"]))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Staffing plans on the timeline of another project: what was done up to half time is done in the first quarter."""
    months = F.greatest(F.lit(1), F.least(F.col("s_nationkey"), F.lit(20))).cast("double")
    new = (F.col("s_suppkey") % 20 + 1).cast("double")
    part = lambda a, b, x, y: F.struct(*(v.alias(n) for n, v in zip(("old_from", "old_to", "new_from", "new_to"), (a, b, x, y))))
    zero = F.lit(0.0)
    segments = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project_id"), F.inline(F.array(part(zero, months / 2, zero, new / 4), part(months / 2, months, new / 4, new))))
    keys = ["project_id", "function", "position"]
    return planning.remapped(planning.months_long(_plan(spark, d), keys), segments, "project_id", keys)


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks kept in hash buckets: a first import, then a batch of changes and deletions that rewrites the buckets it touches."""
    docs = table(spark, d, "documents").select(*ingest.chunk_record(F.col("doc_id"), F.col("text"), F.create_map(F.lit("lang"), F.col("lang"))))
    store = ingest.Buckets(spark, f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}", 16)
    store.upsert(docs.where("doc_id % 3 <> 0").withColumn("text", F.lit("old")))
    store.upsert(docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 = 1 and doc_id % 5 = 0"))
    return store.read().select("doc_id", F.length("text").alias("n_stored"), "hash")


def end_dates(spark: SparkSession, d: str) -> DataFrame:
    end = V.project_end(F.col("o_orderdate"), (F.col("o_orderkey") % 36 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", end.cast("string").alias("end_date"))


def qa_normalised(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "conversations").select(
        F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("no"), F.col("turn").alias("place"), F.col("text").alias("question"), F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("function"),
        F.col("role").alias("area"), F.when(F.col("role") == "assistant", "高").alias("impact"), F.lit(None).cast("string").alias("history_reference"),
    )
    return filters.qa_rows(items).groupBy("no", "function", "impact", "history_reference").agg(F.count("*").alias("n"), F.max("question").alias("last_question"))


def qa_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("source", F.col("conv_id").cast("string"))
    got = questions.renumber(questions.merge(rows, "role", "text", "source", ["conv_id", "turn"]), ["question_key"])
    return got.select("area", F.col("no").cast("int").alias("no"), "question", F.array_join("merged_from", ",").alias("merged_from"), "n_merged")


def qa_similar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("area"), "text")
    return questions.similar_questions(rows, "area", "text", ["conv_id", "turn"]).select("conv_id", "turn", "area", "no", "kept", "n_merged")


KEYWORDS = (("contact", "@"), ("licence", "MIT License"), ("licence", "apache"), ("number", "1"), ("code", "="))


def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame(list(KEYWORDS), "dimension string, keyword string")
    got = joins.mentions(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), words)
    return got.groupBy(F.array_join("dimensions", ",").alias("dimensions")).agg(F.count("*").alias("n"))


def module_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("module"), (F.col("l_quantity") > 49).alias("in_scope"))
    return aggregates.module_summary(rows)


def best_scope(spark: SparkSession, d: str) -> DataFrame:
    requests = _sets(spark, d, 98.0).select(F.col("user_id").alias("request_id"), F.col("functions").alias("scope"))
    projects = _sets(spark, d, 96.0).select(F.col("user_id").alias("project_id"), F.col("functions").alias("scope"), (F.col("user_id") % 7).cast("double").alias("score"))
    return joins.best_scope(requests, projects).select("request_id", "project_id", F.round("match", 6).alias("match"))


def queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    return ranking.queue(rows, "o_custkey", ["o_orderdate", "o_orderkey"], 90).select("o_orderkey", F.col("position").cast("int").alias("position"), F.col("eta_seconds").cast("long").alias("eta_seconds"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"))
    return ranking.status_durations(rows, "user_id", F.col("t"), ["t", "event_id"]).select("event_id", "seconds")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page(table(spark, d, "labels").select("doc_id", "quality", "toxic"), ["doc_id", "quality", "toxic"], 20, 40)


def _streamed(spark: SparkSession, d: str, build) -> DataFrame:
    """Runs ``build`` over the events as a stream in complete mode; each trigger's whole result replaces the one before."""
    # the pattern names a file and a folder of files alike; a plain path could only be a folder
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = feeds.read_events(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/result-{number}")

    run = build(events).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = max(p["batchId"] for p in run.recentProgress)
    return spark.read.parquet(f"{base}/result-{last}")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    got = _streamed(spark, d, feeds.status_counts)
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def stream_states(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, feeds.task_states)


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return feeds.sessions(events).select("user_id", text("start").alias("start"), text("end").alias("end"), "n")


def _sets_sql(above: float) -> str:
    return f"(SELECT user_id, coalesce(list_sort(list_distinct(list(event_type) FILTER (WHERE value > {above}))), []) AS f FROM events GROUP BY user_id)"


_OUTCOMES = """n AS (SELECT doc_id, sha256(text) AS h FROM documents),
  o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE h END AS h FROM n WHERE doc_id % 10 <> 0 UNION ALL SELECT -doc_id - 1, h FROM n WHERE doc_id % 50 = 0),
  x AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS outcome FROM n FULL JOIN o ON n.doc_id = o.doc_id)"""
_CELLS = """cells AS (SELECT s_nationkey % 5 AS g, s_suppkey AS proj_ord, s_name AS project_name, unnest([
    {'o': 0, 'd': '平台类型', 'v': concat('platform ', s_nationkey), 'm': s_nationkey < 10}, {'o': 1, 'd': '车身材料', 'v': '未知', 'm': NULL},
    {'o': 2, 'd': '技术差异总结', 'v': CASE WHEN s_acctbal > 0 THEN concat('about ', s_name) ELSE '' END, 'm': NULL},
    {'o': 3, 'd': '实际人天', 'v': CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey * 10 AS VARCHAR) ELSE '—' END, 'm': NULL},
    {'o': 4, 'd': '偏差率（估→实）', 'v': CASE WHEN s_acctbal > 5000 THEN '+8%' ELSE '—' END, 'm': NULL}]) AS c FROM supplier)"""
_PLAN = """pos(function, position, share, days) AS (VALUES ('PM', 'PM', 0.65::DOUBLE, 180.0::DOUBLE), ('PM', 'PMA', 0.35, 180), ('Chassis', 'Chassis module leader', 0.12, 1100),
    ('Chassis', 'Front suspension', 0.28, 1100), ('Chassis', 'Rear suspension', 0.28, 1100), ('Chassis', 'Steering', 0.18, 1100), ('Chassis', 'Brake&Wheel', 0.14, 1100)),
  plan AS (SELECT s_suppkey AS project_id, function, position, unnest(range(1, 21)) AS month, greatest(1, least(s_nationkey, 20)) AS m,
    days * CASE WHEN s_acctbal > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END / greatest(1, least(s_nationkey, 20)) / 22 AS people, share FROM supplier, pos),
  whole AS (SELECT *, CAST(round(CAST(CAST(round(CAST(people AS DECIMAL(30, 18)), 1) AS DOUBLE) * share AS DECIMAL(30, 18)), 1) AS DOUBLE) AS v FROM plan),
  cells AS (SELECT project_id, function, position, CAST(month AS INTEGER) AS month, CASE WHEN month <= m THEN v ELSE 0.0::DOUBLE END AS fte FROM whole)"""

QUERIES = {
    "latest_task_per_key": latest_task,
    "function_overlap_filter": overlap_filter,
    "doc_type_filter": type_filter,
    "index_status": index_status,
    "first_match_left_join": first_match,
    "incremental_hash_ingest": _outcomes,
    "import_counters": import_counters,
    "dim_project_matrix": project_matrix,
    "matrix_with_derived_rows": derived_rows,
    "substring_theta_join": substring_join,
    "uncovered_functions": uncovered,
    "function_coverage_ratio": coverage_ratio,
    "argmax_first_tie": argmax,
    "manpower_monthly_plan": monthly_plan,
    "manpower_totals": plan_totals,
    "project_end_date": end_dates,
    "timeline_remap": timeline,
    "bucketed_upsert": bucketed,
    "qa_normalize_renumber": qa_normalised,
    "qa_merge_dedupe": qa_merged,
    "qa_similar_merge": qa_similar,
    "keyword_dimension_match": keyword_match,
    "module_summary": module_summary,
    "scope_jaccard_best_match": best_scope,
    "queue_position_eta": queue,
    "status_durations": durations,
    "feedback_page": feedback,
    "stream_status_counts": stream_counts,
    "stream_task_states": stream_states,
    "session_windows": session_windows,
}
ORACLE = {
    "latest_task_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "function_overlap_filter": f"SELECT user_id, array_to_string(f, ',') AS functions FROM {_sets_sql(97.0)} WHERE list_has_any(f, ['purchase', 'error'])",
    "doc_type_filter": "SELECT source, lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY ALL",
    "index_status": """SELECT CASE WHEN f THEN 'failed' WHEN g THEN 'indexed' ELSE 'pending' END AS status, CASE WHEN f THEN 'rejected' END AS error, count(*) AS n FROM
        (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS f, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS g FROM documents) GROUP BY ALL""",
    "first_match_left_join": """WITH r AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1),
        h AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN source ELSE '未知项目' END AS p, CASE WHEN doc_id % 2 = 0 THEN (n_chars % 100) / 100.0::DOUBLE END AS s, lang, n_chars FROM documents)
        SELECT h.doc_id AS hit_id, p AS project_name, coalesce(s, CASE WHEN r.doc_id IS NOT NULL THEN 0.25::DOUBLE END, 0.5::DOUBLE) AS score, coalesce(r.lang, h.lang) AS source_doc,
          CASE WHEN r.doc_id IS NOT NULL THEN CAST(r.n_chars AS VARCHAR) ELSE '—' END AS actual_man_days, CASE WHEN r.doc_id IS NOT NULL THEN '+8%' ELSE '—' END AS deviation_rate,
          CASE WHEN r.doc_id IS NOT NULL THEN concat('project ', r.doc_id) ELSE CAST(h.n_chars AS VARCHAR) END AS summary FROM h LEFT JOIN r ON r.source = p""",
    "incremental_hash_ingest": f"WITH {_OUTCOMES} SELECT doc_id, outcome FROM x",
    "import_counters": f"""WITH {_OUTCOMES} SELECT count(*) FILTER (WHERE outcome = 'new') AS n_new, count(*) FILTER (WHERE outcome = 'changed') AS n_changed,
        count(*) FILTER (WHERE outcome = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE outcome = 'deleted') AS n_deleted, count(*) FILTER (WHERE outcome <> 'deleted') AS n_total FROM x""",
    "dim_project_matrix": f"WITH {_CELLS} SELECT proj_ord, project_name, c.o AS dim_ord, c.d AS dimension, c.v AS value, c.m AS match FROM cells",
    "matrix_with_derived_rows": f"""WITH {_CELLS} SELECT g AS "group", c.o AS dim_ord, c.d AS dimension, CASE c.d WHEN '平台类型' THEN 'MEB' WHEN '实际人天' THEN '待预测' WHEN '车身材料' THEN '未知' ELSE '—' END AS new_project,
        string_agg(concat(project_name, '=', c.v), ';' ORDER BY proj_ord) AS history FROM cells GROUP BY ALL""",
    "substring_theta_join": "SELECT p_partkey, CASE WHEN contains(lower(p_name), '9') THEN '9' WHEN contains(lower(p_name), 'part 1') THEN 'PART 1' WHEN contains(lower(p_name), 'part') THEN 'part' ELSE 'default' END AS baseline_key FROM part",
    "uncovered_functions": f"""SELECT user_id, array_to_string(list_filter({list(_SCOPE)}, lambda x: NOT list_contains(f, x)), ',') AS uncovered,
        CASE WHEN len(f) / 5.0::DOUBLE >= 0.7 THEN 'high' WHEN len(f) / 5.0::DOUBLE >= 0.4 THEN 'medium' ELSE 'low' END AS bucket FROM {_sets_sql(95.0)}""",
    "function_coverage_ratio": f"SELECT s.x AS function, round(avg(CAST(list_contains(f, s.x) AS INTEGER)), 6) AS ratio FROM {_sets_sql(95.0)}, (SELECT unnest({list(_SCOPE)}) AS x) s GROUP BY s.x",
    "argmax_first_tie": """SELECT o_custkey, o_orderpriority, round(o_totalprice / 100000) AS max_score FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(round(o_totalprice / 100000), 0) DESC, o_orderkey) = 1""",
    "manpower_monthly_plan": f"WITH {_PLAN} SELECT * FROM cells",
    "manpower_totals": f"WITH {_PLAN} SELECT function, round(sum(fte), 1) AS total FROM cells GROUP BY function",
    "project_end_date": """WITH x AS (SELECT o_orderkey, o_orderdate AS t, month(o_orderdate) - 1 + o_orderkey % 36 + 1 AS i FROM orders)
        SELECT o_orderkey, CAST(make_date(year(t) + i // 12, i % 12 + 1, least(day(t), 28)) AS VARCHAR) AS end_date FROM x""",
    "qa_normalize_renumber": """SELECT coalesce(CASE WHEN turn % 2 = 0 THEN turn END, turn + 1) AS no, role AS function, CASE WHEN role = 'assistant' THEN '高' ELSE '' END AS impact, '' AS history_reference,
        count(*) AS n, max(coalesce(text, '')) AS last_question FROM conversations GROUP BY 1, 2, 3""",
    "timeline_remap": f"""WITH {_PLAN},
  b AS (SELECT s_suppkey AS project_id, greatest(1, least(s_nationkey, 20))::DOUBLE AS m, (s_suppkey % 20 + 1)::DOUBLE AS n FROM supplier),
  g AS (SELECT project_id, 0::DOUBLE AS of, m / 2 AS ot, 0::DOUBLE AS nf, n / 4 AS nt FROM b UNION ALL SELECT project_id, m / 2, m, n / 4, n FROM b),
  c AS (SELECT project_id, function, position, fte * (least(month, ot) - greatest(month - 1, of)) AS work, round(nf + (greatest(month - 1, of) - of) * (nt - nf) / (ot - of), 9) AS lo, round(nf + (least(month, ot) - of) * (nt - nf) / (ot - of), 9) AS hi
    FROM cells JOIN g USING (project_id) WHERE fte <> 0 AND month - 1 < ot AND month > of),
  x AS (SELECT *, unnest(range(floor(lo)::BIGINT + 1, ceil(hi)::BIGINT + 1)) AS mm FROM c),
  y AS (SELECT project_id, function, position, mm AS month, sum(work * (least(mm, hi) - greatest(mm - 1, lo)) / (hi - lo)) AS work FROM x GROUP BY ALL),
  z AS (SELECT *, round(round(sum(work) OVER (PARTITION BY project_id, function, position ORDER BY month) * 10, 6)) AS t FROM y)
  SELECT project_id, function, position, CAST(month AS INTEGER) AS month, round((t - coalesce(lag(t) OVER (PARTITION BY project_id, function, position ORDER BY month), 0)) / 10, 1) AS fte FROM z""",
    "bucketed_upsert": """SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 1 THEN 3 ELSE least(length(text), 8000) END AS INTEGER) AS n_stored, sha256(text) AS hash FROM documents WHERE NOT (doc_id % 3 = 1 AND doc_id % 5 = 0)""",
    "qa_similar_merge": r"""WITH RECURSIVE w AS (SELECT conv_id, turn, role AS area, length(text) AS n,
    list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS words FROM conversations),
  k AS MATERIALIZED (SELECT area, words, row_number() OVER (ORDER BY area, words) AS id FROM (SELECT DISTINCT area, words FROM w)),
  p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.area = b.area AND a.id <> b.id WHERE len(list_intersect(a.words, b.words)) * 9 >= (len(a.words) + len(b.words)) * 4),
  reach(a, b) AS (SELECT id, id FROM k UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
  c AS (SELECT a AS id, min(b) AS class FROM reach GROUP BY a),
  r AS (SELECT w.*, class, rank() OVER (PARTITION BY class ORDER BY n DESC, conv_id, turn) = 1 AS kept, count(*) OVER (PARTITION BY class) AS n_merged FROM w JOIN k USING (area, words) JOIN c USING (id)),
  f AS (SELECT class, row_number() OVER (PARTITION BY area ORDER BY conv_id, turn) AS no FROM r WHERE kept)
  SELECT conv_id, turn, area, no, kept, n_merged FROM r JOIN f USING (class)""",
    "qa_merge_dedupe": r"""WITH k AS (SELECT role AS area, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS key, text, conv_id, turn FROM conversations),
        b AS (SELECT area, key, arg_min(text, ROW(-length(text), conv_id, turn)) AS question, array_to_string(list_sort(list_distinct(list(CAST(conv_id AS VARCHAR)))), ',') AS merged_from, count(*) AS n_merged FROM k GROUP BY area, key)
        SELECT area, CAST(row_number() OVER (PARTITION BY area ORDER BY key) AS INTEGER) AS no, question, merged_from, n_merged FROM b""",
    "keyword_dimension_match": """SELECT array_to_string(list_filter(['code', 'contact', 'licence', 'number'], lambda x: CASE x WHEN 'code' THEN contains(t, '=') WHEN 'contact' THEN contains(t, '@')
        WHEN 'licence' THEN contains(t, 'mit license') OR contains(t, 'apache') ELSE contains(t, '1') END), ',') AS dimensions, count(*) AS n FROM (SELECT lower(text) AS t FROM documents) GROUP BY 1""",
    "module_summary": "SELECT concat(l_returnflag, l_linestatus, l_linenumber) AS module, bool_or(l_quantity > 49) AS needed, count(*) FILTER (WHERE l_quantity > 49) AS in_scope_count FROM lineitem GROUP BY 1",
    "scope_jaccard_best_match": f"""WITH p AS (SELECT r.user_id AS request_id, p.user_id AS project_id, len(list_intersect(r.f, p.f)) / len(list_distinct(list_concat(r.f, p.f)))::DOUBLE AS m, p.user_id % 7 AS score
        FROM {_sets_sql(98.0)} r JOIN {_sets_sql(96.0)} p ON list_has_any(r.f, p.f))
        SELECT request_id, project_id, round(m, 6) AS match FROM p QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY m DESC, score DESC, project_id) = 1""",
    "queue_position_eta": """SELECT o_orderkey, CAST(p AS INTEGER) AS position, CAST((p - 1) * 90 AS BIGINT) AS eta_seconds FROM
        (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders WHERE o_orderstatus <> 'F')""",
    "status_durations": "SELECT event_id, CAST(epoch(t) - lag(epoch(t)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS seconds FROM (SELECT event_id, user_id, date_trunc('second', ts) AS t FROM events)",
    "feedback_page": "SELECT doc_id, quality, toxic FROM labels ORDER BY doc_id, quality, toxic LIMIT 20 OFFSET 40",
    "stream_status_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_task_states": "SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS status, count(*) AS n_events, 0 AS progress FROM events GROUP BY user_id",
    "session_windows": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
        s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
}
