"""Joins with a fixed order of preference among matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.text import or_else
from tessera.functions.values import jaccard
from tessera.operators.keywords import contained


def first_per(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the columns ``order``, ascending, nulls first (give a total order, else ties are arbitrary).
    An aggregate, so rows fall together before the shuffle however many a key has."""
    keys = [key] if isinstance(key, str) else key
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first"))
    return best.select("_first.*")


def projects_of_hits(hits: DataFrame, reference: DataFrame) -> DataFrame:
    """Hits ``(hit_id, project_name, score, source_doc, content)`` with the first reference project ``(ord, project_name,
    score, source_doc, actual_man_days, deviation_rate, summary)`` of their name.

    A match is overlaid with the hit's score. Without one the hit's own values stand, score 0.5 if it has none, dashes
    and the first 120 characters. There is no fallback for an empty result.
    """
    first = first_per(reference, "project_name", ["ord"]).select(
        "project_name", F.lit(True).alias("matched"), *(F.col(c).alias(f"r_{c}") for c in ("score", "source_doc", "actual_man_days", "deviation_rate", "summary"))
    )
    name = or_else(F.col("project_name"), F.lit(K.UNKNOWN_PROJECT))
    joined = hits.withColumn("project_name", name).join(first, "project_name", "left")
    hit = F.col("matched").isNotNull()
    return joined.select(
        "hit_id", "project_name", F.coalesce("score", "r_score", F.lit(0.5)).alias("score"),
        F.when(hit, F.col("r_source_doc")).otherwise(F.coalesce("source_doc", F.lit(""))).alias("source_doc"),
        F.when(hit, F.col("r_actual_man_days")).otherwise(K.DASH).alias("actual_man_days"),
        F.when(hit, F.col("r_deviation_rate")).otherwise(K.DASH).alias("deviation_rate"),
        F.when(hit, F.col("r_summary")).otherwise(F.left(F.coalesce("content", F.lit("")), F.lit(K.SUMMARY_CHARS))).alias("summary"),
    )


LIST_ROWS = 10_000  # longest list that becomes one expression; a longer one is joined through an index of its parts


def _listed(rows: DataFrame) -> list | None:
    """The rows of a list set by hand, or None where it is longer than one expression should be."""
    got = rows.limit(LIST_ROWS + 1).collect()
    return got if len(got) <= LIST_ROWS else None


def baseline_of(projects: DataFrame, baselines: DataFrame, name: str = "project_name") -> DataFrame:
    """``projects`` and ``baseline_key``: the first key (by ``key_ord``) inside the name, case aside; else ``default``.

    ``baselines(key_ord, key)``: a list set by hand becomes one expression a row; a longer one meets the different names through an index.
    """
    keys = baselines.where("key <> 'default'")
    listed = _listed(keys.orderBy("key_ord"))
    if listed is None:
        names = projects.select(F.col(name).alias("_name")).distinct()
        hits = contained(names, keys.select(F.col("key").alias("keyword")), "_name", "_name").join(keys.select(F.col("key").alias("keyword"), "key_ord"), "keyword")
        first = hits.groupBy("_name").agg(F.min_by("keyword", F.struct("key_ord", "keyword")).alias("baseline_key"))
        joined = projects.drop("baseline_key").join(first, F.col(name) == F.col("_name"), "left").drop("_name")
        return joined.withColumn("baseline_key", F.coalesce("baseline_key", F.lit("default")))
    low = F.lower(F.coalesce(F.col(name), F.lit("")))
    hit = F.coalesce(*(F.when(low.contains(r["key"].lower()), r["key"]) for r in listed), F.lit("default")) if listed else F.lit("default")
    return projects.withColumn("baseline_key", hit)


def labelled(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """``rows`` and ``label`` from the dictionary ``labels(key, label)``, the key itself where it has none."""
    return rows.join(labels.select(F.col("key").alias(key), "label"), key, "left").withColumn("label", F.coalesce("label", F.col(key)))


def mentions(texts: DataFrame, text: Column, keywords: DataFrame) -> DataFrame:
    """Specified only: ``texts`` and ``dimensions``, the dimensions with a keyword (``dimension, keyword``) in the text, sorted.

    A keyword list set by hand (some hundreds) becomes one expression, so the texts are read once and not joined. A longer list meets the different texts
    through an index.
    """
    listed = _listed(keywords.orderBy("dimension", "keyword"))
    if listed is None:
        rows = texts.withColumn("_text", F.coalesce(text, F.lit("")))
        kinds = rows.select("_text").distinct()
        hits = contained(kinds, keywords, "_text", "_text").join(keywords, "keyword")
        found = hits.groupBy("_text").agg(F.array_sort(F.collect_set("dimension")).alias("dimensions"))
        return rows.drop("dimensions").join(found, "_text", "left").drop("_text").withColumn("dimensions", F.coalesce("dimensions", F.array().cast("array<string>")))
    by: dict[str, list[str]] = {}
    for r in listed:
        by.setdefault(r["dimension"], []).append(r["keyword"].lower())
    low = F.lower(text)
    found = []
    for dimension, words in by.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        found.append(F.when(hit, dimension))
    return texts.withColumn("dimensions", F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>"))


def best_scope(requests: DataFrame, projects: DataFrame, weight: Column | None = None) -> DataFrame:
    """Specified only: for each request ``(request_id, scope)`` the project ``(project_id, scope, score)`` with the largest
    Jaccard coefficient, ties to the higher score, then the smaller id. Requests without a common item get no row.

    Pairs are formed through common scope items, and each distinct scope is compared once.
    """
    r, p = requests.select(F.array_sort(F.array_distinct("scope")).alias("scope_r"), "request_id"), projects.select(F.array_sort(F.array_distinct("scope")).alias("scope_p"), "project_id", "score")
    kinds_p = p.groupBy("scope_p").agg(F.max(F.struct("score", (-F.col("project_id")).alias("n"))).alias("top"))
    kinds_r = r.select("scope_r").distinct()
    pairs = kinds_r.select("scope_r", F.explode("scope_r").alias("item")).join(kinds_p.select("scope_p", "top", F.explode("scope_p").alias("item")), "item").select("scope_r", "scope_p", "top").distinct()
    value = jaccard(F.col("scope_r"), F.col("scope_p")) + (F.lit(0.0) if weight is None else weight)
    best = pairs.groupBy("scope_r").agg(F.max(F.struct(value.alias("match"), F.col("top.score").alias("score"), F.col("top.n").alias("n"))).alias("b"))
    return r.join(best, "scope_r").select("request_id", (-F.col("b.n")).alias("project_id"), F.col("b.match").alias("match"), F.col("b.score").alias("score"))


def unmapped(scope: DataFrame, mapping: DataFrame, item: str = "item") -> DataFrame:
    """Specified only: scope items that no ``mapping(item)`` covers."""
    return scope.join(mapping.select(item).distinct(), item, "left_anti")


def with_hit(projects: DataFrame, hits: DataFrame, chars: int = 300) -> DataFrame:
    """``projects`` and ``chunk``: the start of the content of the first hit (by ``hit_id``) of that ``project_name``."""
    first = first_per(hits.select("project_name", "hit_id", "content"), "project_name", ["hit_id"])
    return projects.join(first.select("project_name", F.left("content", F.lit(chars)).alias("chunk")), "project_name", "left")


def questions_of_top(hits: DataFrame, manifests: DataFrame, questions: DataFrame, top: int = 3) -> DataFrame:
    """Specified only: the question rows of the ``top`` best hits ``(query_id, engagement_id, rank)``: through the package
    manifest ``(engagement_id, path)`` to ``questions(path, ...)``. A hit without a package, or a package without rows, gives none."""
    best = hits.where(F.col("rank") <= top).select("query_id", "engagement_id", "rank")
    return best.join(manifests.select("engagement_id", "path"), "engagement_id").join(questions, "path")


def baselines_of_best(best: DataFrame, baselines: DataFrame, scope: DataFrame) -> DataFrame:
    """Specified only: for each request the baseline rows of its best project, of the functions in its scope; a function in
    scope without a baseline row has nulls. ``best(request_id, project_id)``, ``baselines(project_id, function, ...)``, ``scope(request_id, function)``."""
    wanted = scope.join(best.select("request_id", "project_id"), "request_id")
    return wanted.join(baselines, ["project_id", "function"], "left")
