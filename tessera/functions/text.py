"""Column functions over request texts and names. All are native expressions; a null text gives the function's default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_else(c: Column, *others: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (c, *others)))


def first_group(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The first match's group, trimmed; null where nothing (or an empty group) matches."""
    return F.nullif(F.btrim(F.regexp_extract(_col(text), pattern, group), F.lit(" \t\r\n")), F.lit(""))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def matching(text: Column | str, names: Sequence[str], word_boundary: bool = False) -> Column:
    """Array of the names that occur in the text, case aside, in the order of ``names``.

    By default a name may be part of a word ("EE" in "steering"); ``word_boundary`` asks for whole words.
    """
    t = F.coalesce(_col(text), F.lit(""))
    if word_boundary:
        hits = [F.when(t.rlike(rf"(?i)\b\Q{n}\E\b"), n) for n in names]
    else:
        hits = [F.when(F.lower(t).contains(n.lower()), n) for n in names]
    return F.array_compact(F.array(*hits))


def customer(text: Column | str) -> Column:
    return F.coalesce(first_group(text, r"(?i)Customer:\s*(.+)"), first_group(text, r"客户[：:]\s*(.+)"))


def project_name(text: Column | str, compat: bool = False) -> Column:
    """From the title behind a dash, else from a ``Project:`` line; at most 80 characters.

    ``compat`` keeps the narrow title pattern (no blank before the dash), which lets ``Project Duration:`` take over.
    """
    title = r"RFQ[—\-]\s*(.+)" if compat else r"RFQ\s*[—\-]\s*(.+)"
    line = r"(?i)Project(?:\s+Duration)?[：:]\s*(.+)" if compat else r"(?i)Project[：:]\s*(.+)"
    return F.left(F.coalesce(first_group(text, title), first_group(text, line)), F.lit(K.NAME_CHARS))


def platform(text: Column | str, longest_first: bool = False) -> Column:
    """The first listed platform that occurs; ``longest_first`` prefers "Custom BEV" to the "BEV" inside it."""
    names = sorted(K.PLATFORMS, key=len, reverse=True) if longest_first else K.PLATFORMS
    return F.coalesce(F.get(matching(text, names), F.lit(0)), F.lit(K.UNKNOWN))


def months(text: Column | str) -> Column:
    """Months of a period or duration; 20 where none is given."""
    digits = first_group(text, r"(?i)(?:Period|Duration|周期)[^0-9]*(\d{1,2})\s*(?:months?|月)")
    return F.coalesce(digits.try_cast("int"), F.lit(K.DEFAULT_MONTHS))


def functions_in_scope(text: Column | str, word_boundary: bool = False) -> Column:
    found = matching(text, K.FUNCTIONS, word_boundary)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, K.DEFAULT_FUNCTIONS)))


def lines(text: Column | str) -> Column:
    """The trimmed lines of a text."""
    return F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" \t")))


def or_default(found: Column, default: Sequence[str]) -> Column:
    """An array, or the default where it is empty."""
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default)))


def deliverables_of(rows: Column) -> Column:
    bullet = lambda x: x.startswith("- ") & contains_any(x, K.DELIVERABLE_WORDS)
    return F.transform(
        F.filter(rows, lambda x: bullet(x) | x.rlike("(?i)^M[1-5]:")),
        lambda x: F.when(x.startswith("- "), F.btrim(F.substring(x, F.lit(3), F.length(x)))).otherwise(x),
    )


def deliverables(text: Column | str) -> Column:
    """Bulleted lines with a (case-sensitive) deliverable word, and ``M1:`` to ``M5:`` lines; a default pair if none."""
    return or_default(deliverables_of(lines(text)), K.DEFAULT_DELIVERABLES)


def milestones(text: Column | str) -> Column:
    """Map of milestone to date text, for those that are given."""
    pairs = [x for k in K.MILESTONES for x in (F.lit(k), F.regexp_extract(F.coalesce(_col(text), F.lit("")), rf"(?i){k}\s*[：:|]\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


def requirements_of(rows: Column) -> Column:
    return F.filter(F.transform(F.filter(rows, lambda x: contains_any(x, K.REQUIREMENT_WORDS)), lambda x: F.btrim(x, F.lit("- "))), lambda x: x != "")


def special_requirements(text: Column | str) -> Column:
    return or_default(requirements_of(lines(text)), (K.DEFAULT_REQUIREMENT,))


def modules(text: Column | str, functions: Column, delivered: Column) -> Column:
    """Array of (function, module_name, description, deliverables, complexity): project management first, then chassis parts."""
    t = F.coalesce(_col(text), F.lit(""))
    low = F.lower(t)

    def module(function: str, name: str, about: str, given: Column, complexity: str) -> Column:
        return F.struct(F.lit(function).alias("function"), F.lit(name).alias("module_name"), F.lit(about).alias("description"), given.alias("deliverables"), F.lit(complexity).alias("complexity"))

    chassis = F.array_contains(functions, "Chassis") | low.contains("chassis")
    has = lambda word, label: chassis & (low.contains(word) | t.contains(label))
    fixed = lambda *names: F.array(*map(F.lit, names))
    return F.array_compact(F.array(
        F.when(F.array_contains(functions, "PM"), module("PM", "Project Management", "项目协调与里程碑管理", fixed("Project plan", "Status reports"), K.MEDIUM)),
        F.when(has("front", "前悬"), module("Chassis", "Front suspension", "前悬架结构设计开发", delivered, K.HIGH)),
        F.when(has("rear", "后悬"), module("Chassis", "Rear suspension", "后悬架结构设计开发", delivered, K.HIGH)),
        F.when(has("steering", "转向"), module("Chassis", "Steering", "转向系统集成", fixed("Steering integration report"), K.MEDIUM)),
    ))


def profile(text: Column | str, platform_: Column, count: Column) -> Column:
    """Map of comparison dimension to the new project's value, by keyword."""
    t = F.coalesce(_col(text), F.lit(""))
    low = F.lower(t)
    values = (
        platform_,
        F.when(low.contains("aluminum") | t.contains("铝"), "钢铝混合").otherwise("全钢"),
        F.when(low.contains("load") | t.contains("载荷"), "正面+偏置").otherwise("基础载荷"),
        F.when(low.contains("chassis"), "Chassis").otherwise("多 Function"),
        F.concat(count.cast("string"), F.lit("项")),
    )
    return F.create_map(*(x for k, v in zip(K.DIMENSIONS, values, strict=True) for x in (F.lit(k), v)))


def inferred_profile(platform_: Column, functions: Column, n_deliverables: Column) -> Column:
    """Profile of a parsed request without one: map of the platform, the scope (the one function, or the first three) and the
    number of deliverables; what is not known is said to be so."""
    names = F.coalesce(functions, F.array().cast("array<string>"))
    scope = F.when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.size(names) > 1, F.array_join(F.slice(names, 1, 3), "、")).otherwise(K.UNKNOWN)
    count = F.when(n_deliverables > 0, F.concat(n_deliverables.cast("string"), F.lit("项"))).otherwise(K.UNKNOWN)
    values = (or_else(platform_, F.lit(K.UNKNOWN)), F.lit(K.UNKNOWN), F.lit(K.UNKNOWN), or_else(scope, F.lit(K.UNKNOWN)), count)
    return F.create_map(*(x for k, v in zip(K.DIMENSIONS, values, strict=True) for x in (F.lit(k), v)))


def deliverable_total(modules_: Column) -> Column:
    """How many deliverables the modules list, repeats counted; 0 without modules."""
    each = F.transform(modules_, lambda m: F.greatest(F.size(m["deliverables"]), F.lit(0)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(0))


def request_records(rows: DataFrame, text: str = "text", name: str = "record", compat: bool = False) -> DataFrame:
    """``rows`` and a column ``name``: the whole structured record of a request text.

    The parts build on one another (the count on the modules, these on functions and deliverables), so they are columns of
    their own, step by step: each is computed once, which one nested expression would not do. The last step is a generator of
    one row, below which the optimiser moves no later filter, as that would paste all steps into its condition.
    """
    kept, t = rows.columns, F.col("_rq_text")
    step = rows.withColumn("_rq_text", F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n")))
    step = step.withColumns({"_rq_lines": lines(t), "_rq_found": matching(t, K.FUNCTIONS), "_rq_platform": platform(t)})
    step = step.withColumns({"_rq_given": deliverables_of(F.col("_rq_lines")), "_rq_asked": requirements_of(F.col("_rq_lines")), "_rq_functions": or_default(F.col("_rq_found"), K.DEFAULT_FUNCTIONS)})
    step = step.withColumns({"_rq_delivered": or_default(F.col("_rq_given"), K.DEFAULT_DELIVERABLES), "_rq_special": or_default(F.col("_rq_asked"), (K.DEFAULT_REQUIREMENT,))})
    step = step.withColumn("_rq_modules", modules(t, F.col("_rq_functions"), F.col("_rq_delivered")))
    step = step.withColumn("_rq_distinct", F.size(F.array_distinct(F.flatten(F.transform("_rq_modules", lambda m: m["deliverables"])))))
    step = step.withColumn("_rq_count", F.when(F.col("_rq_distinct") > 0, F.col("_rq_distinct")).otherwise(F.size("_rq_delivered")))
    record = F.struct(
        F.coalesce(project_name(t, compat), F.lit(K.UNNAMED_PROJECT)).alias("project_name"), F.coalesce(customer(t), F.lit(K.UNKNOWN)).alias("customer"),
        F.col("_rq_platform").alias("platform_type"), F.col("_rq_functions").alias("functions_in_scope"), milestones(t).alias("milestones"), F.col("_rq_modules").alias("modules"),
        F.col("_rq_special").alias("special_requirements"), months(t).alias("timeline_months"), F.col("_rq_count").alias("deliverable_count"),
        profile(t, F.col("_rq_platform"), F.greatest("_rq_count", F.size("_rq_delivered"))).alias("profile"),
    )
    return step.select(*(c for c in kept if c != name), F.inline_outer(F.array(F.struct(record.alias(name)))))


def document_class(name: Column | str) -> Column:
    """Class of a document by its file name; the order of the tests matters."""
    n = F.lower(_col(name))
    return (
        F.when(n.contains("rfq"), "rfq").when(n.contains("qa") | n.contains("q_a"), "qa")
        .when(n.contains("quote"), "quote_manpower").otherwise("summary")
    )


def title_case(c: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter (digits and hyphens too), lower-case the others."""
    pieces = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")


def project_of_path(path: Column | str) -> Column:
    """Project from the first part of a relative path: underscores become blanks, in title case."""
    return title_case(F.replace(F.split_part(_col(path), F.lit("/"), F.lit(1)), F.lit("_"), F.lit(" ")))


def safe_filename(c: Column | str, default: str = "project") -> Column:
    """Runs of anything but letters, digits, ``_`` and ``-`` become ``_``; ends stripped of it; at most 40 characters."""
    clean = F.left(F.btrim(F.regexp_replace(_col(c), r"(?U)[^\w\-]+", "_"), F.lit("_")), F.lit(40))
    return or_else(clean, F.lit(default))


def download_name(stored: Column | str) -> Column:
    """The name behind the first underscore (the upload prefix); the whole name without one."""
    s = _col(stored)
    return F.when(F.instr(s, "_") > 0, F.substring(s, F.instr(s, "_") + 1, F.length(s))).otherwise(s)


def basename(name: Column | str) -> Column:
    return F.element_at(F.split(_col(name), r"[/\\]"), -1)


def model_installed(available: Column, target: Column) -> Column:
    """Whether an installed model has the wanted name, case aside, or the same name before the colon."""
    base = lambda x: F.split_part(F.lower(x), F.lit(":"), F.lit(1))
    return F.exists(available, lambda a: (F.lower(a) == F.lower(target)) | (base(a) == base(target)))


def fill_prompt(template: Column, placeholder: str, text: Column) -> Column:
    return F.replace(template, F.lit(placeholder), text)


def query_text(platform_: Column, functions: Column, default: str = "similar project") -> Column:
    """Search text of a request: platform and the first two functions."""
    return or_else(F.btrim(F.concat_ws(" ", platform_, F.array_join(F.slice(functions, 1, 2), " "))), F.lit(default))


def history_reference(project: Column, area: Column, year: Column) -> Column:
    return F.concat_ws(" / ", project, area, year.cast("string"))


def impact_by_keyword(question: Column | str) -> Column:
    """Specified only: high for boundary, load or freeze, low for language and meetings, else medium."""
    q = F.lower(_col(question))
    return F.when(q.rlike("边界|载荷|冻结|boundary|load|freeze"), K.HIGH).when(q.rlike("语言|例会|language|meeting"), K.LOW).otherwise(K.MEDIUM)
