"""Task states, review states and what they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K


def progress(status: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in K.TASK_STATES for x in kv))
    return F.coalesce(F.try_element_at(known, status), F.lit(0))


def progress_value(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def readiness(tasks: DataFrame) -> DataFrame:
    """``tasks`` and booleans for what is there: a parse, a comparison, a draft, questions, a workbook."""
    full = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return tasks.withColumns({f"has_{c}": full(F.col(c)) for c in ("parsed", "comparison", "draft", "questions", "workbook")})


def gate(status: Column, review: Column, parsed: Column) -> Column:
    """Null if a quote may be made, else the reason why not."""
    return (
        F.when(~status.eqNullSafe("completed"), "not completed").when(~F.coalesce(review.isin(*K.QUOTABLE_REVIEWS), F.lit(False)), "not reviewed")
        .when(~F.coalesce(parsed, F.lit(False)), "not parsed")
    )


def review(current: Column, asked: Column, confirmed: Column) -> Column:
    """The review state after an update: what is asked for, else in_review for a confirmed draft, else as before."""
    state = F.coalesce(F.nullif(asked, F.lit("")), current)
    return F.when(F.coalesce(confirmed, F.lit(False)) & (state == "draft"), "in_review").otherwise(state)


def after_quote(current: Column) -> Column:
    return F.when(current == "in_review", "approved").otherwise(current)


def current_states(events: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """The latest state and its progress of each task, from its events; combines before the shuffle."""
    last = F.max_by(status, F.struct(*order))
    return events.groupBy(key).agg(last.alias(status), F.count("*").alias("n_events")).withColumn("progress", progress(F.col(status)))


def artefact_state(path: Column, exists: Column) -> Column:
    """``ready`` for a stored artefact, ``never generated`` without a path, ``missing`` where its file is gone."""
    return F.when(F.coalesce(F.length(path), F.lit(0)) == 0, "never generated").when(F.coalesce(exists, F.lit(False)), "ready").otherwise("missing")


def with_project_name(draft: Column, name: Column) -> Column:
    """A copy of a draft (a struct with ``project_name``) under the task's project name, if it has one."""
    return draft.withField("project_name", F.coalesce(F.nullif(name, F.lit("")), draft["project_name"]))
