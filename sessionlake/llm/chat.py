"""Chat formatting into budgeted windows, in Spark SQL only.

Running sums of turn tokens cut a conversation into turn-aligned spans. Each
span becomes one training text: the system turn, a limited history of turns
that stood before the span, then the span's own turns. Only the own assistant
turns count for the loss, so a repeated target is masked.

A turn is written `<|role|>\\n` text `<|end|>\\n`. In roles and texts, each of
`<`, `[` and `\\` gets a `\\` after it, in roles `|` too. So neither the
template's own marks nor `</s>` or `[INST]` can occur in a text, nor the end of
its head in a role, and dropping the `\\` after each of them restores both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that control strings start with (and the escape itself).
SPECIAL = r"([<\[\\])"
#: In roles, also what the end of the head starts with.
OF_ROLE = r"([<\[\\|])"
END = "<|end|>\n"


def escape(text: Column, special: str = SPECIAL) -> Column:
    return F.regexp_replace(text, special, r"$1\\")


def unescape(text: Column, special: str = SPECIAL) -> Column:
    return F.regexp_replace(text, special + r"\\", "$1")


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role, OF_ROLE), F.lit("|>\n"), escape(text), F.lit(END))


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 3, system: int = 256, section: int = 1024) -> DataFrame:
    """Training texts of conversations (conv_id, turn, role, text): conv_id, section, window, repeated (leading turns that only give context), formatted, loss (array of start and length, in code points of formatted).

    Tokens are estimated as a quarter of the UTF-8 bytes, plus 4 for each turn. A window's own turns have at most budget - history - system tokens together, or are a single longer turn. History: up to `history_turns` turns right before the span, of at most `history` tokens together. The conversation's first system turn starts every window, once; where it has more than `system` tokens, these are taken off what the window's own turns may have.

    A conversation is laid out in sections of `section` consecutive turns, so one endless conversation is spread over many tasks. The last turns of a section are copied into the next one, as history only. Null texts count as empty, null roles as ''; roles may hold anything, marks too; null conv_ids are one conversation; rows with the same or a null turn number are ordered by role and text, and repeated rows are turns of their own; an empty table gives an empty table; other columns are ignored.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / section), F.lit(-(2**62))).cast("long")).withColumn("tokens", F.ceil(F.octet_length("text") / 4) + 4)
    first_system = rows.where("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("turn", "text", "tokens"), F.struct("turn", "text")).alias("s"))
    # the running place of a turn: the turns in lower ranges of turn numbers, and its place in its own range
    ranges = rows.groupBy("conv_id", "range").agg(F.count("*").alias("held"))
    lower = F.sum("held").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(F.col("conv_id").alias("__id"), F.col("range").alias("__range"), F.coalesce(lower, F.lit(0)).alias("lower"))
    rows = rows.join(ranges, F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("range") == F.col("__range"))).drop("__id", "__range")
    in_order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    at = F.col("lower") + F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*in_order)) - 1
    rows = rows.withColumn("at", at).withColumn("section", F.floor(F.col("at") / section).cast("long")).drop("range", "lower")
    # the last turns of a section stand before the next section's own turns, without a window of their own
    past = F.when(F.col("at") % section >= section - history_turns, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("past", F.explode(past)).withColumn("section", F.col("section") + F.col("past").cast("long"))
    # a system turn over its share leaves less to a window's own turns
    large = first_system.where(F.col("s.tokens") > system).select(F.col("conv_id").alias("__id"), F.col("s.tokens").alias("large"))
    rows = rows.join(large, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    rows = rows.withColumn("free", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.coalesce("large", F.lit(system))) / 2)))
    free = F.col("free")
    place = Window.partitionBy("conv_id", "section").orderBy("at")
    whole = Window.partitionBy("conv_id", "section")
    earlier = F.sum(F.when(F.col("past"), F.col("tokens")).otherwise(0)).over(whole)
    rows = rows.withColumn("n", F.row_number().over(place)).withColumn("before", F.sum("tokens").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") - earlier)
    # cells of `free` tokens; a turn that leaves its cell closes it, with the cell's other turns if both halves of the budget hold them
    rows = rows.withColumn("cell", F.floor(F.col("before") / free)).withColumn("leaves", (F.col("before") + F.col("tokens") > (F.col("cell") + 1) * free))
    cell = Window.partitionBy("conv_id", "section", "cell")
    inside = F.sum(F.when(~F.col("leaves"), F.col("tokens")).otherwise(0)).over(cell)
    rows = rows.withColumn("window", 2 * F.col("cell") + F.when(F.col("leaves") & (inside > 0) & (inside + F.col("tokens") > 2 * free), 1).otherwise(0))
    starts = F.lag("window").over(place)
    rows = rows.withColumn("starts", ~F.col("past") & (starts.isNull() | (starts != F.col("window"))))
    # a turn is history of the windows that start within the next few turns
    later = [F.when(F.lead("starts", k).over(place) & (F.lead("before", k).over(place) - F.col("before") <= history), F.struct(F.lead("window", k).over(place).alias("window"), F.lit(1).alias("kind"))) for k in range(1, history_turns + 1)]
    own = F.when(~F.col("past"), F.struct(F.col("window"), F.lit(2).alias("kind")))
    uses = rows.withColumn("uses", F.filter(F.array(own, *later), lambda u: u.isNotNull()))
    uses = uses.select("conv_id", "section", "turn", "n", "role", "text", F.explode("uses").alias("u")).select("conv_id", "section", "turn", "n", "role", "text", "u.*")
    seg = segment(F.col("role"), F.col("text"))
    lead = F.length(F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")))
    parts = uses.withColumn("seg", seg).withColumn("lead", lead).withColumn("body", F.length(escape(F.col("text")))).withColumn("loss", (F.col("kind") == 2) & (F.col("role") == "assistant"))
    grouped = parts.groupBy("conv_id", "section", "window").agg(F.array_sort(F.collect_list(F.struct("kind", "n", "seg", "lead", "body", "loss"))).alias("p"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("history"), F.min(F.struct("n", "turn")).alias("from"))
    grouped = grouped.join(first_system.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    # the system turn leads where it is not in the window or its history anyway
    kept = F.transform("p", lambda x: x["seg"])
    system_seg = segment(F.lit("system"), F.col("s.text"))
    leads = F.col("s").isNotNull() & ~F.array_contains(kept, system_seg)
    head = F.when(leads, system_seg).otherwise(F.lit(""))
    grouped = grouped.withColumn("head", head)
    at = F.aggregate(
        "p",
        F.struct(F.length("head").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct((a["at"] + F.length(x["seg"])).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["lead"]).alias("start"), x["body"].alias("length"))))).otherwise(a["spans"]).alias("spans")),
    )
    return grouped.select("conv_id", "section", "window", (F.col("history") + F.when(leads, 1).otherwise(0)).cast("int").alias("repeated"), F.concat("head", F.array_join(kept, "")).alias("formatted"), at["spans"].alias("loss"))


def read_back(texts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from formatted texts: marks split the turns, repeated ones are left out, and texts are unescaped."""
    turns = F.filter(F.split(F.col("formatted"), r"<\|end\|>\n"), lambda x: x != "")
    own = F.slice(turns, F.col("repeated") + 1, F.greatest(F.size(turns), F.lit(1)))
    said = F.transform(own, lambda x: F.concat(unescape(F.regexp_extract(x, r"(?s)^<\|(.*?)\|>\n", 1), OF_ROLE), F.lit("\n"), unescape(F.regexp_replace(x, r"(?s)^<\|.*?\|>\n", "")), F.lit("\n")))
    target = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    parts = texts.select("conv_id", F.struct("section", "window", F.array_join(said, "").alias("said"), F.array_join(target, "").alias("target"), F.size(own).alias("n")).alias("w"), F.length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"), F.sum("w.n").alias("n_turns"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"), F.length(joined("target")).cast("long").alias("loss_chars"), F.sha2(joined("target").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
