"""Chat formatting in budgeted windows, on DataFrame functions alone.

A turn is written ``### <role>:`` line end, the text, ``</turn>`` line end. In roles and texts a backslash, ``<`` and
``#`` are written as two characters that begin with a backslash, so no text can hold a mark, and reading is exact.

Windows follow from prefix sums of the tokens of the written turns. With a budget B, system turns of H tokens kept in
front and room R for repeated history, S = B - H - R is left for new turns. A turn whose tokens end at prefix sum p is in
cell (p - 1) // S. At most one turn of a cell began in an earlier one; a cell whose turns have more than S tokens
becomes two windows, that turn alone and the others (which then lie inside the cell, so they have S tokens at most).
Each window repeats the system turns and, of the turns before it, those that lie wholly within the last R tokens (or in what a
longer turn leaves of the budget), all of them masked: a turn is a target in exactly one window. So a window has at most B
tokens, unless the system turns and one single turn have more already (a turn is never cut); such a window repeats nothing else.

The prefix sums are taken in blocks of ``BLOCK`` turn numbers, first over the blocks' sums and then inside each block, and
windows are put together by cell, so that a conversation that holds a large part of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

BUDGET, HISTORY = 1024, 384
BLOCK = 256
#: What counts as a token where the caller gives no count: two letters, three digits, any other mark, a line end. Byte-pair
#: encoders take fewer on nearly all texts, so a budget kept in these is kept in theirs.
TOKEN = r"[A-Za-z]{1,2}|[0-9]{1,3}|[^\sA-Za-z0-9]|\n"


def escape(c: Column) -> Column:
    """Reversible: backslash -> \\b, < -> \\l, # -> \\h."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    """As ``escape``, and a line end as \\n: the first line end of a written turn ends its role."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escape_role(role), F.lit(":\n"), escape(text), F.lit("</turn>\n"))


def token_count(piece: Column) -> Column:
    return F.regexp_count(piece, F.lit(TOKEN)).cast("long")


def placed(conversations: DataFrame, tokens: str | None = None) -> DataFrame:
    """One row per turn: ``conv_id, place`` (from 1), ``role, piece`` (as written), ``tokens``, ``head`` (tokens of all system
    turns) and, for other turns, ``upto`` (tokens of the turns up to and with this one)."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), *([tokens] if tokens else []))
    rows = rows.withColumn("piece", render(F.col("role"), F.col("text")))
    count = F.greatest(F.coalesce(F.col(tokens), F.lit(1)) if tokens else token_count(F.col("piece")), F.lit(1)).cast("long")
    key = F.struct("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))  # a struct, so that null ids and turns meet
    system = F.col("role") == "system"
    rows = rows.select(key.alias("key"), "turn", "role", "text", "piece", count.alias("tokens"))
    sums = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.when(system, 0).otherwise(F.col("tokens"))).alias("t"), F.sum(F.when(system, F.col("tokens")).otherwise(0)).alias("s")
    )
    whole = Window.partitionBy("key.conv_id")
    earlier = whole.orderBy(F.col("key.block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.sum("s").over(whole).alias("head"), F.sum("t").over(whole).alias("total"),
    )
    joined = rows.join(sums, "key")
    inside = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = F.sum(F.when(system, 0).otherwise(F.col("tokens"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(
        "key.conv_id", "role", "piece", "tokens", "head", "total", (F.col("n0") + F.row_number().over(inside)).alias("place"), (F.col("t0") + upto).alias("upto")
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """``conv_id, window, formatted, mask, n_tokens, places, is_new``: the written windows; ``mask`` has (start, length) of
    the targets' texts.

    Offsets are code points of ``formatted``, on the escaped text of assistant turns that are new in the window. ``tokens``
    may name a column with the tokens of each turn as written; else they are estimated (``TOKEN``). Rows of
    a conversation are taken by turn, then role, then text; null texts and roles count as empty, rows with a null
    ``conv_id`` are one conversation, repeated rows are repeated turns. Other columns are not looked at.
    """
    system = F.col("role") == "system"
    room = F.greatest(F.lit(budget) - F.col("head"), F.lit(0))
    back = F.least(F.lit(history), F.floor(room / 2)).cast("long")
    rows = placed(conversations, tokens).withColumn("back", back).withColumn("span", F.greatest(room - F.col("back"), F.lit(1)))
    cell_of = lambda at: F.floor((at - 1) / F.col("span")).cast("long")
    rows = rows.withColumn("begin", F.col("upto") - F.col("tokens"))
    rows = rows.withColumn("cell", F.when(system, 0).otherwise(F.greatest(cell_of(F.col("upto")), F.lit(0).cast("long"))))
    # a system turn goes to all cells, another one to its own and, if it is short enough to be repeated, to those whose windows may repeat it
    last = F.greatest(cell_of(F.col("total")), F.lit(0).cast("long"))
    short = F.col("tokens") <= F.col("back")
    later = F.least(last, F.greatest(F.col("cell"), cell_of(F.col("begin") + 2 * F.col("back") + F.col("span"))))
    until = F.when(system, last).when(short, later).otherwise(F.col("cell"))
    lead = F.length(escape_role(F.col("role"))) + 6
    rows = rows.select(
        "conv_id", "place", "role", "piece", "tokens", "begin", "upto", "back", "span", "head", "total", short.alias("short"), lead.alias("lead"), F.col("cell").alias("own"),
        F.explode(F.sequence("cell", F.greatest("cell", until))).alias("cell"),
    )
    cells = Window.partitionBy("conv_id", "cell")
    new = ~system & (F.col("own") == F.col("cell"))
    over = F.sum(F.when(new, F.col("tokens"))).over(cells) > F.col("span")
    crossing = F.col("begin") < F.col("cell") * F.col("span")
    # half 0: the turn that began before the cell, alone; half 1: the others; turns of other cells are offered to both
    half = F.when(new, F.when(over & crossing, F.lit(0)).otherwise(1))
    halves = F.when(F.col("half") == 1, F.array(F.lit(1))).when((F.col("half") == 0) & ~F.col("short"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = rows.withColumn("half", half).withColumn("h", F.explode(halves))
    group = Window.partitionBy("conv_id", "cell", "h")
    mine = new & F.coalesce(F.col("half") == F.col("h"), F.lit(False))
    rows = rows.withColumn("mine", mine)
    rows = rows.withColumn("first", F.min(F.when(F.col("mine"), F.col("begin"))).over(group)).withColumn("n_new", F.sum(F.when(F.col("mine"), F.col("tokens"))).over(group))
    reach = F.least(F.col("back"), F.greatest(F.lit(budget) - F.col("head") - F.col("n_new"), F.lit(0)))
    kept = system | F.col("mine") | ((F.col("upto") <= F.col("first")) & (F.col("begin") >= F.col("first") - reach))
    # a conversation of system turns alone has one window of them
    alone = system & (F.col("total") == 0) & (F.col("h") == 1)
    rows = rows.where((F.col("first").isNotNull() & kept) | alone)
    within = group.orderBy(F.when(system, 0).otherwise(1), "place")
    start = F.sum(F.length("piece")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")
    rows = rows.withColumn("start", start)
    target = (F.col("role") == "assistant") & F.col("mine")
    rows = rows.withColumn("target", F.when(target, F.struct((F.col("start") + F.col("lead")).alias("start"), (F.length("piece") - F.col("lead") - 8).alias("length"))))
    is_new = F.coalesce(F.col("mine"), F.lit(False)) | (system & (F.coalesce(F.col("first"), F.lit(0)) == 0))  # system turns count as new in the first window
    rows = rows.withColumn("is_new", is_new)
    part = F.struct("start", "place", "is_new", "piece", "target")
    got = rows.groupBy("conv_id", "cell", "h").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("tokens").alias("n_tokens"))
    return got.select(
        "conv_id", (F.col("cell") * 2 + F.col("h")).alias("window"), F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["target"].isNotNull()), lambda p: p["target"]).alias("mask"), "n_tokens",
        F.transform(F.filter("parts", lambda p: p["is_new"]), lambda p: p["place"]).alias("places"),
        F.transform("parts", lambda p: p["is_new"]).alias("is_new"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of each conversation from its windows: ``conv_id, turns`` (array of place, role, text), ``loss`` and sizes."""
    pieces = F.filter(F.split("formatted", "</turn>\n"), lambda p: p != "")
    turn = lambda p: F.struct(unescape_role(F.regexp_extract(p, "^### ([^\n]*):\n", 1)).alias("role"), unescape(F.regexp_replace(p, "^### [^\n]*:\n", "")).alias("text"))
    own = F.transform(F.filter(F.arrays_zip(pieces.alias("p"), F.col("is_new").alias("n")), lambda z: z["n"]), lambda z: turn(z["p"]))
    placed_ = F.transform(F.arrays_zip(F.col("places").alias("place"), own.alias("turn")), lambda z: F.struct(z["place"].alias("place"), z["turn"]["role"].alias("role"), z["turn"]["text"].alias("text")))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    rows = formatted.select("conv_id", "window", placed_.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return got.select("conv_id", F.array_sort(F.flatten(F.col("w.turns"))).alias("turns"), F.array_join(F.col("w.loss"), "").alias("loss"), "formatted_chars")


PROBE = "\\### Assistant: </turn> ok"


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of what reading the windows back gives; a conversation is one row of it, so its turns come together in one task here."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(windows(conversations.unionByName(probe)))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
