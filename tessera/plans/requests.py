"""Queries over request texts, names, JSON and workflow states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import filters, workflow
from tessera.operators.joins import labelled
from tessera.operators.planning import complexity
from tessera.sources.tables import evolve, manifest, table

#: One request text per customer, in SQL that both engines read.
REQUESTS = """SELECT c_custkey AS request_id, concat_ws(chr(10),
  concat('RFQ — ', c_name, ' chassis programme'), concat('Customer: ', c_mktsegment, ' works '),
  concat('Platform: ', CASE WHEN c_nationkey < 5 THEN 'MEB' WHEN c_nationkey < 10 THEN 'mqb' WHEN c_nationkey < 15 THEN 'Custom BEV' WHEN c_nationkey < 20 THEN 'Compact SUV' ELSE 'open' END),
  concat('Project Duration: ', CAST(c_nationkey + 1 AS VARCHAR(10)), ' months'),
  CASE WHEN c_mktsegment < 'C' THEN 'Scope: front and rear axle, aluminum body' WHEN c_mktsegment < 'I' THEN 'Scope: steering, load cases, CAE' ELSE 'Scope: interior trim, pm' END,
  '- M1 3D data', '- meeting notes', 'M2: DMU report',
  CASE WHEN c_acctbal > 5000 THEN '- Assumption: loads from customer' ELSE 'no further notes' END,
  concat('P1: 2026-0', CAST(c_nationkey % 9 + 1 AS VARCHAR(10)), '-15'), CASE WHEN c_acctbal > 0 THEN 'SOP | 2028-01-31' ELSE 'SOP open' END) AS text FROM customer"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(REQUESTS.replace("FROM customer", "FROM {customer}").replace("{customer}", f"parquet.`{d}/customer.parquet`"))


def extract(spark: SparkSession, d: str) -> DataFrame:
    return T.request_records(_requests(spark, d), name="r").select(
        "request_id", "r.project_name", "r.customer", "r.platform_type", "r.timeline_months", F.array_join("r.functions_in_scope", ",").alias("functions"),
        F.array_join(F.transform("r.modules", lambda m: m["module_name"]), ",").alias("modules"), complexity("r.modules").alias("is_complex"), F.col("r.deliverable_count").alias("deliverable_count"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    got = T.request_records(_requests(spark, d), name="r").select("request_id", F.col("r.modules").alias("modules"), F.col("r.special_requirements").alias("asked"), F.col("r.milestones").alias("marks"), T.deliverables("text").alias("listed"))
    got = got.withColumn("slots", V.compact_milestones(F.col("marks")))
    return got.select(
        "request_id", F.array_join("listed", "|").alias("deliverables"), F.array_join("asked", "|").alias("requirements"),
        F.try_element_at("marks", F.lit("P1")).alias("p1"), F.try_element_at("marks", F.lit("SOP")).alias("sop"),
        F.array_join(F.transform("slots", lambda m: m["milestone"]), ",").alias("given"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    got = T.request_records(_requests(spark, d), name="r").select(F.col("r.profile").alias("p"))
    return got.select(F.explode("p").alias("dimension", "value")).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.safe_filename(F.concat(F.lit("__"), F.col("p_name"), F.lit(" / 底盘 "), F.col("p_type"), F.lit(" (v1)"))).alias("file_name"))


def url_classes(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "pages").select(T.document_class(T.basename(F.regexp_replace("url", "[?#].*", ""))).alias("by_name"), T.document_class(F.concat(F.col("url"), F.lit("_"), F.col("html"))).alias("by_content"))
    return got.groupBy("by_name", "by_content").agg(F.count("*").alias("n"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.project_of_path(F.concat(F.lit("2023"), F.regexp_replace("p_name", " ", "_"), F.lit("_oem-a/"), F.col("p_type"))).alias("project"), T.download_name(F.concat_ws("_", "p_brand", "p_name")).alias("download"))


ANSWER = "CASE WHEN event_type = 'click' THEN concat('```json', chr(10), props, chr(10), '```') WHEN event_type = 'error' THEN substr(props, 1, 4) ELSE props END"


def json_parse(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "events").select("event_id", F.expr(ANSWER.replace("chr(10)", "'\\n'")).alias("a")).select("event_id", "a", V.safe_json(F.col("a"), "k int").alias("j"))
    return got.select("event_id", "j.parse_error", F.col("j.value.k").alias("k"), F.length("j.raw_output").alias("raw_chars"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.concat(F.col("url"), F.when(F.col("url").contains("/en/"), ".docx").otherwise(".DOC")).alias("name"), F.col("html").cast("binary").alias("content"))
    return filters.uploads(files).groupBy(T.basename(F.split_part("stored_name", F.lit("_"), F.lit(2))).alias("name")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("parsing").alias("status"),
        F.element_at(F.array(*map(F.lit, ("draft", "in_review", "approved", "exported", "draft"))), F.left("o_orderpriority", F.lit(1)).cast("int")).alias("review"), (F.col("o_totalprice") > 1000).alias("parsed"), F.when(F.col("o_orderkey") % 3 == 0, "approved").when(F.col("o_orderkey") % 3 == 1, "").alias("asked"),
    )
    reason = workflow.gate(F.col("status"), F.col("review"), F.col("parsed"))
    after = workflow.review(F.col("review"), F.col("asked"), F.col("parsed"))
    return got.groupBy("status", "review", F.coalesce("asked", F.lit("")).alias("asked"), F.coalesce(reason, F.lit("")).alias("reason"), after.alias("after_confirm"), workflow.after_quote(F.col("review")).alias("after_quote"), workflow.progress(F.col("status")).alias("progress")).agg(F.count("*").alias("n"))


def display(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 37).alias("b"), ((F.col("n_chars") % 100) / 100).alias("ratio"))
    return got.select("doc_id", V.bytes_text(F.col("b")).alias("size"), V.coverage_bucket(F.col("ratio")).alias("bucket"), V.percent_text(F.col("ratio")).alias("percent"))


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French")], "key string, label string")
    return labelled(table(spark, d, "documents").select("doc_id", "lang"), "lang", labels).groupBy("label").agg(F.count("*").alias("n"))


def evolved(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return evolve(old, new).groupBy("segment").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def editable(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("平台类型", "技术差异总结", "实际人天", "车身材料", "偏差率（估→实）"))), F.left("o_orderpriority", F.lit(1)).cast("int"))
    rows = table(spark, d, "orders").select(names.alias("dimension"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("new_project"))
    return filters.editable_requirements(rows)


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Each customer as an engagement whose package holds a document type for each order priority seen."""
    kinds = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("k"))
    text = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("engagement_id"), F.transform("k", lambda x: F.struct(x.alias("doc_type"), F.concat(x, F.lit(".docx")).alias("path"))).alias("documents")))
    return manifest(kinds.select(text.alias("m")), "m", ["1-URGENT", "5-LOW"]).groupBy("doc_type", "present").agg(F.count("*").alias("n"))


_REQ = f"requests AS ({REQUESTS})"
_LOW = "lower(text)"
_FUNCTIONS = "list_filter([" + ", ".join(f"CASE WHEN contains({_LOW}, '{n.lower()}') THEN '{n}' END" for n in ("PM", "Chassis", "BIW", "CAE", "EE", "Interior", "GI", "Test validation")) + "], lambda x: x IS NOT NULL)"
_PLATFORM = "CASE " + " ".join(f"WHEN contains({_LOW}, '{p.lower()}') THEN '{p}'" for p in ("MEB", "MQB", "BEV", "Custom BEV", "Compact SUV")) + " ELSE '未知' END"
_FIELDS = rf"""fields AS (SELECT request_id, text, left(trim(regexp_extract(text, 'RFQ\s*[—\-]\s*(.+)', 1)), 80) AS project_name, trim(regexp_extract(text, '(?i)Customer:\s*(.+)', 1)) AS customer,
  {_PLATFORM} AS platform_type, CAST(regexp_extract(text, '(?i)(?:Period|Duration|周期)[^0-9]*(\d{{1,2}})\s*(?:months?|月)', 1) AS INTEGER) AS timeline_months,
  {_FUNCTIONS} AS f, contains({_LOW}, 'front') AS fr, contains({_LOW}, 'rear') AS re, contains({_LOW}, 'steering') AS st,
  [trim(x[3:]) for x in list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '- ') AND regexp_matches(x, 'M1|M2|M3|data|report|3D'))] AS bullets FROM requests)"""

QUERIES = {
    "rfq_regex_extract": extract,
    "deliverable_lines": lines,
    "request_profiles": profiles,
    "safe_filename": safe_names,
    "doc_type_from_name": url_classes,
    "title_case_paths": titles,
    "json_safe_parse": json_parse,
    "upload_gate": uploads,
    "workflow_gates": gates,
    "display_formats": display,
    "label_dictionary": dictionary,
    "schema_evolution": evolved,
    "editable_requirements": editable,
    "manifest_completeness": manifests,
}
ORACLE = {
    "rfq_regex_extract": f"""WITH {_REQ}, {_FIELDS}
        SELECT request_id, project_name, customer, platform_type, timeline_months, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE ['PM', 'Chassis'] END, ',') AS functions,
          array_to_string(list_filter([CASE WHEN list_contains(f, 'PM') THEN 'Project Management' END, CASE WHEN fr THEN 'Front suspension' END, CASE WHEN re THEN 'Rear suspension' END, CASE WHEN st THEN 'Steering' END], lambda x: x IS NOT NULL), ',') AS modules,
          (fr OR re) AS is_complex,
          CAST(CASE WHEN (CASE WHEN list_contains(f, 'PM') THEN 2 ELSE 0 END) + (CASE WHEN fr OR re THEN 2 ELSE 0 END) + (CASE WHEN st THEN 1 ELSE 0 END) = 0 THEN 2
            ELSE (CASE WHEN list_contains(f, 'PM') THEN 2 ELSE 0 END) + (CASE WHEN fr OR re THEN 2 ELSE 0 END) + (CASE WHEN st THEN 1 ELSE 0 END) END AS INTEGER) AS deliverable_count
        FROM fields""",
    "deliverable_lines": f"""WITH {_REQ} SELECT request_id, 'M1 3D data|M2: DMU report' AS deliverables,
          CASE WHEN contains(text, 'Assumption') THEN 'Assumption: loads from customer' ELSE '边界载荷是否由客户提供' END AS requirements,
          regexp_extract(text, 'P1: ([0-9-]+)', 1) AS p1, nullif(regexp_extract(text, 'SOP [|] ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS sop,
          CASE WHEN contains(text, 'SOP |') THEN 'P1,SOP' ELSE 'P1' END AS given FROM requests""",
    "request_profiles": f"""WITH {_REQ}, {_FIELDS}, n AS (SELECT *, (CASE WHEN list_contains(f, 'PM') THEN 2 ELSE 0 END) + (CASE WHEN fr OR re THEN 2 ELSE 0 END) + (CASE WHEN st THEN 1 ELSE 0 END) AS c FROM fields),
        long AS (SELECT unnest([{{'d': '平台类型', 'v': platform_type}}, {{'d': '车身材料', 'v': CASE WHEN contains({_LOW}, 'aluminum') THEN '钢铝混合' ELSE '全钢' END}},
          {{'d': '仿真类型', 'v': CASE WHEN contains({_LOW}, 'load') THEN '正面+偏置' ELSE '基础载荷' END}}, {{'d': '内外饰范围', 'v': 'Chassis'}}, {{'d': '交付物数量', 'v': concat(greatest(c, 2), '项')}}]) AS x FROM n)
        SELECT x.d AS dimension, x.v AS value, count(*) AS n FROM long GROUP BY ALL""",
    "safe_filename": r"SELECT p_partkey, left(trim(regexp_replace(concat('__', p_name, ' / 底盘 ', p_type, ' (v1)'), '[^\p{L}\p{N}_\-]+', '_', 'g'), '_'), 40) AS file_name FROM part",
    "doc_type_from_name": r"""WITH x AS (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '[^/\\]*$')) AS a, lower(concat(url, '_', html)) AS b FROM pages)
        SELECT by_name, by_content, count(*) AS n FROM (SELECT CASE WHEN contains(a, 'rfq') THEN 'rfq' WHEN contains(a, 'qa') OR contains(a, 'q_a') THEN 'qa' WHEN contains(a, 'quote') THEN 'quote_manpower' ELSE 'summary' END AS by_name,
          CASE WHEN contains(b, 'rfq') THEN 'rfq' WHEN contains(b, 'qa') OR contains(b, 'q_a') THEN 'qa' WHEN contains(b, 'quote') THEN 'quote_manpower' ELSE 'summary' END AS by_content FROM x) GROUP BY ALL""",
    "title_case_paths": r"""SELECT p_partkey, array_to_string([concat(upper(x[1]), x[2:]) for x in regexp_extract_all(lower(concat('2023', replace(p_name, ' ', ' '), ' oem-a')), '\p{L}+|\P{L}+')], '') AS project,
        concat_ws('_', p_name) AS download FROM part""",
    "json_safe_parse": rf"""WITH a AS (SELECT event_id, {ANSWER} AS a FROM events), b AS (SELECT event_id, a, trim(coalesce(nullif(regexp_extract(a, '(?s)```(?:json)?\s*(.*?)\s*```', 1), ''), a)) AS j FROM a)
        SELECT event_id, NOT json_valid(j) AS parse_error, CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.k') AS INTEGER) END AS k, CAST(CASE WHEN NOT json_valid(j) THEN length(a) END AS INTEGER) AS raw_chars FROM b""",
    "upload_gate": r"""WITH f AS (SELECT regexp_extract(concat(url, CASE WHEN contains(url, '/en/') THEN '.docx' ELSE '.DOC' END), '[^/\\]*$') AS name, octet_length(encode(html)) AS b FROM pages)
        SELECT split_part(name, '_', 1) AS name, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM f WHERE ends_with(lower(name), '.docx') AND b <= 52428800 GROUP BY 1""",
    "workflow_gates": """WITH t AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'parsing' END AS status, ['draft', 'in_review', 'approved', 'exported', 'draft'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS review, o_totalprice > 1000 AS parsed, CASE o_orderkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN '' END AS asked FROM orders)
        SELECT status, review, coalesce(asked, '') AS asked, CASE WHEN status <> 'completed' THEN 'not completed' WHEN review NOT IN ('in_review', 'approved', 'exported') THEN 'not reviewed' WHEN NOT parsed THEN 'not parsed' ELSE '' END AS reason,
          CASE WHEN parsed AND coalesce(nullif(asked, ''), review) = 'draft' THEN 'in_review' ELSE coalesce(nullif(asked, ''), review) END AS after_confirm, CASE WHEN review = 'in_review' THEN 'approved' ELSE review END AS after_quote, CASE status WHEN 'completed' THEN 100 ELSE 20 END AS progress, count(*) AS n FROM t GROUP BY ALL""",
    "display_formats": """SELECT doc_id, CASE WHEN n_chars * 37 < 1024 THEN concat(n_chars * 37, ' B') WHEN n_chars * 37 < 1048576 THEN printf('%.1f KB', round(n_chars * 37 / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round(n_chars * 37 / 1024.0::DOUBLE / 1024.0::DOUBLE, 1)) END AS size,
        CASE WHEN n_chars % 100 >= 70 THEN 'high' WHEN n_chars % 100 >= 40 THEN 'medium' ELSE 'low' END AS bucket, concat(n_chars % 100, '%') AS percent FROM documents""",
    "label_dictionary": "SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE lang END AS label, count(*) AS n FROM documents GROUP BY 1",
    "schema_evolution": "SELECT segment, count(*) AS n, min(name) AS first_name FROM (SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer) GROUP BY segment",
    "editable_requirements": """SELECT dimension, arg_max(s, o_orderkey) AS new_project FROM (SELECT ['平台类型', '技术差异总结', '实际人天', '车身材料', '偏差率（估→实）'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS dimension, o_orderkey, o_orderstatus AS s FROM orders)
        WHERE NOT (starts_with(dimension, '技术') OR contains(dimension, '人天') OR contains(dimension, '偏差')) GROUP BY dimension""",
    "manifest_completeness": """WITH e AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS k FROM orders GROUP BY o_custkey) SELECT doc_type, list_contains(k, doc_type) AS present, count(*) AS n FROM e, (VALUES ('1-URGENT'), ('5-LOW')) v(doc_type) GROUP BY ALL""",
}
