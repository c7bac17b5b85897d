"""Expressions over request texts, names, JSON, dates and plans, on fixed values."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators.aggregates import confidence
from tessera.operators.planning import baseline, plan

REQUEST = """RFQ — Rear axle carrier, second series
Customer: Nordwagen AB
Platform: MEB
Project Duration: 14 months
Scope: front axle, steering, development
- M1 3D data
M2: clash list
P1: 2026-03-01
SOP | 2028-01-31"""


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def record(spark, text):
    return T.request_records(spark.createDataFrame([(text,)], "text string")).first()["record"]


def test_request(spark):
    r = record(spark, REQUEST)
    assert (r["customer"], r["platform_type"], r["timeline_months"], r["project_name"]) == ("Nordwagen AB", "MEB", 14, "Rear axle carrier, second series")
    assert r["milestones"] == {"P1": "2026-03-01", "SOP": "2028-01-31"}
    assert [m["module_name"] for m in r["modules"]] == ["Project Management"]  # "pm" is in "development"; nothing says chassis
    assert r["deliverable_count"] == 2 and r["profile"]["交付物数量"] == "2项"


def test_request_of_nothing(spark):
    for text in (None, "", "   "):
        r = record(spark, text)
        assert (r["customer"], r["timeline_months"], list(r["functions_in_scope"])) == ("未知", 20, ["PM", "Chassis"])


def test_names(spark):
    assert one(spark, T.safe_filename("s"), s="__a / 底盘 (v1)") == "a_底盘_v1"
    assert one(spark, T.safe_filename("s"), s="///") == "project"
    assert one(spark, T.title_case("s"), s="2023 abc oem-a") == "2023 Abc Oem-A"
    assert one(spark, T.download_name("s"), s="abc_my_file.docx") == "my_file.docx"
    assert one(spark, T.document_class("s"), s="Project_RFQ_v1.docx") == "rfq"


def test_json(spark):
    good = one(spark, V.safe_json(F.col("s"), "a int"), s='```json\n{"a": 1}\n```')
    assert (good["value"]["a"], good["parse_error"], good["raw_output"]) == (1, False, None)
    bad = one(spark, V.safe_json(F.col("s"), "a int"), s="not json")
    assert (bad["value"], bad["parse_error"], bad["raw_output"]) == (None, True, "not json")


def test_dates_and_numbers(spark):
    assert one(spark, V.project_end(F.lit("2026-01-31"), F.lit(2))) == dt.date(2026, 3, 28)
    assert one(spark, V.project_end(F.lit("soon"), F.lit(2))) is None
    assert one(spark, V.score(F.lit(1.7))) == 0.0
    assert one(spark, V.without(F.array(*map(F.lit, ["PM", "Chassis", "PM", "BIW"])), F.array(F.lit("Chassis")))) == ["PM", "PM", "BIW"]
    assert one(spark, V.bytes_text(F.lit(47360))) == "46.3 KB"
    assert one(spark, V.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0


def test_confidence(spark):
    for n, top, want in ((3, 0.92, "高"), (2, 0.80, "中"), (1, 0.65, "低"), (0, None, "低")):
        assert one(spark, confidence(F.lit(n), F.lit(top).cast("double"))) == want


def test_plan(spark):
    projects = spark.createDataFrame([(1, "default", 20, False), (2, "default", 20, True)], "project_id int, baseline_key string, months int, is_complex boolean")
    rows = plan(projects, baseline(spark)).groupBy("project_id", "function").agg(F.round(F.sum("row_total"), 1).alias("t")).collect()
    assert {(r["project_id"], r["function"]): r["t"] for r in rows} == {(1, "PM"): 8.0, (1, "Chassis"): 50.0, (2, "PM"): 10.0, (2, "Chassis"): 56.0}


def test_a_page_is_classified_by_its_whole_text(spark, tmp_path):
    from tessera.plans import requests

    page = spark.createDataFrame([("https://x.org/a", "<p>" + "word " * 200 + "see the RFQ</p>")], "url string, html string")
    page.write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in requests.url_classes(spark, str(tmp_path)).collect()] == [("summary", "rfq", 1)]
