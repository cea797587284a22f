"""Named time windows, and how the sessions in them compare with those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import base_name, file_argument, tool_class
from sessionlake.functions.medians import medians
from sessionlake.functions.places import kept
from sessionlake.operators.navtime import nav_shares


EXPERIMENT = "name string, scope string, source string, start_ns long, end_ns long"


def created(experiments: DataFrame, name: str, start_ns: int, end_ns: int | None = None, scope: str | None = None, source: str | None = None) -> DataFrame:
    """The experiments and one more, open where it has no end. Names are unique, and a window may not end before it starts."""
    if end_ns is not None and end_ns < start_ns:
        raise ValueError("an experiment cannot end before it starts")
    if not got(experiments, name).isEmpty():
        raise ValueError(f"an experiment named {name!r} exists")
    return experiments.unionByName(experiments.sparkSession.createDataFrame([(name, scope, source, start_ns, end_ns)], EXPERIMENT), allowMissingColumns=True)


def stopped(experiments: DataFrame, name: str, end_ns: int) -> DataFrame:
    """The experiments, the open one of this name ended; one that is ended keeps its end."""
    if got(experiments, name).isEmpty():
        raise ValueError(f"no experiment is named {name!r}")
    return experiments.withColumn("end_ns", F.when(F.col("name") == name, F.coalesce("end_ns", F.lit(end_ns))).otherwise(F.col("end_ns")))


def got(experiments: DataFrame, name: str) -> DataFrame:
    return experiments.where(F.col("name") == name)


def tagged(sessions: DataFrame, experiments: DataFrame) -> DataFrame:
    """Sessions with `tags`: the names of the windows (name, scope, start_ns, end_ns) that hold their start, both ends included, and whose scope and source are null or their project and source. Tags are never stored, so a changed window changes them at once. Windows are few and hand-written."""
    of = F.col("source") if "source" in experiments.columns else F.lit(None).cast("string")
    e = F.broadcast(experiments.select("name", "scope", of.alias("of_source"), "start_ns", F.coalesce("end_ns", F.lit(2**63 - 1)).alias("end_ns")))
    inside = F.col("started_at_ns").between(F.col("start_ns"), F.col("end_ns")) & (F.col("scope").isNull() | (F.col("scope") == F.col("project"))) & (F.col("of_source").isNull() | (F.col("of_source") == F.col("source")))
    hit = sessions.select("session_id", "source", "project", "started_at_ns").join(e, inside)
    tags = hit.groupBy("session_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return sessions.join(tags, "session_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def members(sessions_tagged: DataFrame, name: str) -> DataFrame:
    return sessions_tagged.where(F.array_contains("tags", name) & (F.col("is_subagent") == 0))


def listed(experiments: DataFrame, sessions_tagged: DataFrame) -> DataFrame:
    """Experiments with their number of sessions."""
    n = sessions_tagged.select(F.explode("tags").alias("name")).groupBy("name").agg(F.count("*").alias("sessions"))
    return experiments.join(n, "name", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def retagged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions whose tags differ between two taggings."""
    return new.join(old.select("session_id", F.col("tags").alias("was")), "session_id", "left").where(~F.col("tags").eqNullSafe(F.col("was")))


def baseline(sessions_tagged: DataFrame, name: str, start_ns: int, scope: str | None = None, days: int = 10, source: str | None = None) -> DataFrame:
    """Top-level sessions of the same scope and source in the days before the window that do not belong to it."""
    rows = sessions_tagged.where((F.col("is_subagent") == 0) & (F.col("started_at_ns") >= start_ns - days * 86_400 * 10**9) & (F.col("started_at_ns") < start_ns) & ~F.array_contains("tags", name))
    rows = rows if scope is None else rows.where(F.col("project") == scope)
    return rows if source is None else rows.where(F.col("source") == source)


def duplicate_reads(calls: DataFrame) -> DataFrame:
    """Reads of a session beyond the first with the same arguments."""
    groups = calls.where("name = 'Read'").groupBy("session_id", "args_hash").agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("session_id").agg(F.sum(F.col("n") - 1).cast("long").alias("duplicates"))


def grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(q))))


def held_names(names: DataFrame, texts: DataFrame, q: int = 3, piece: int = 65_536, few: int = 4_096, share: int = 4_000_000) -> DataFrame:
    """(session_id, base) of the distinct names (session_id, base) that a text (session_id, text) of their session holds, as contains() does. Null and empty names and texts hold nothing.

    Where a session has at most `few` names, each of its texts meets the list of them once, so the work grows with the texts. Long sessions are dealt into parts of about `share` characters, each with the list. In sessions of more names, texts and names meet by runs of characters (by_grams), and names without white space only need the distinct words of a session, as none of them goes on beyond a word.
    """
    names = kept(names.select("session_id", "base").where("base <> '' and session_id is not null").distinct(), "names")
    texts = texts.select("session_id", "text").where("text <> ''")
    # what is broadcast has a row for each `few` names or `share` characters at most
    rich = kept(names.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > few).select("session_id"), "names-rich")
    long = F.broadcast(kept(texts.groupBy("session_id").agg(F.ceil(F.sum(F.length("text").cast("long")) / share).cast("int").alias("parts")).where("parts > 1"), "names-long"))
    parts = F.coalesce("parts", F.lit(1))
    lists = names.join(F.broadcast(rich), "session_id", "left_anti").groupBy("session_id").agg(F.collect_list("base").alias("names"))
    lists = lists.join(long, "session_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    dealt = texts.join(long, "session_id", "left").select("session_id", "text", (F.monotonically_increasing_id() % parts).cast("int").alias("part"))
    held = dealt.join(lists, ["session_id", "part"]).select("session_id", F.explode(F.filter("names", lambda name: F.contains(F.col("text"), name))).alias("base"))
    if not rich.isEmpty():
        many, of = (df.join(F.broadcast(rich), "session_id", "left_semi") for df in (names, texts))
        spaced = F.col("base").rlike(r"\s")
        words = of.select("session_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("text")).where("text <> ''").distinct()
        held = held.unionByName(by_grams(many.where(~spaced), words, q, piece)).unionByName(by_grams(many.where(spaced), of, q, piece))
    return held.distinct()


def by_grams(names: DataFrame, texts: DataFrame, q: int, piece: int) -> DataFrame:
    """(session_id, base) of the distinct names that a text of their session holds, neither null nor empty.

    Names and texts meet by a run of q characters (shorter names: as many as they have): a name asks for the one of its runs that the fewest texts of its session have, none if a run is in no text. Texts are cut into overlapping pieces of bounded size, and only the runs of names are kept of them. Each candidate is looked at exactly.
    """
    texts = texts.join(names.select("session_id").distinct(), "session_id", "left_semi")
    texts = kept(texts.withColumn("id", F.monotonically_increasing_id()), "names-texts")
    asked = kept(names.withColumn("gram", F.explode(F.when(F.length("base") >= q, grams(F.col("base"), q)).otherwise(F.array("base")))), "names-grams")
    wanted = asked.select("session_id", "gram").distinct()
    have = None
    for k in range(1, q + 1):
        some = wanted.where(F.length("gram") == k) if k < q else wanted.where(F.length("gram") >= q)
        of = texts.join(some.select("session_id").distinct(), "session_id", "left_semi")
        pieces = of.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(piece)))).select("session_id", "id", F.substr("text", "at", F.lit(piece + k - 1)).alias("piece"))
        got = pieces.select("session_id", "id", F.explode(grams(F.col("piece"), k)).alias("gram")).join(some, ["session_id", "gram"], "left_semi").distinct()
        have = got if have is None else have.unionByName(got)
    have = kept(have, "names-have")
    rare = have.groupBy("session_id", "gram").agg(F.count("*").alias("texts"))
    chosen = asked.join(rare, ["session_id", "gram"], "left").groupBy("session_id", "base").agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.count(F.when(F.col("texts").isNull(), 1)).alias("absent")).where("absent = 0")
    near = chosen.join(have, ["session_id", "gram"]).select("id", "session_id", "base")
    return near.join(texts.select("id", "text"), "id").where(F.contains("text", "base")).select("session_id", "base").distinct()


def read_used(calls: DataFrame, contents: DataFrame) -> DataFrame:
    """Share of a session's read files that it also edits, at any time, or whose base name an assistant message holds. Each file is looked at once, and kept in the shared folder; messages are searched for those that are not edited."""
    named = calls.where(F.col("name").isin("Read", "Edit", "Write", "NotebookEdit")).select("session_id", "name", file_argument().alias("path")).where(F.col("path").isNotNull() & ~F.col("path").contains("_docnav"))
    read = F.col("name") == "Read"
    files = named.groupBy("session_id", "path").agg(F.max(read).alias("read"), F.max(~read & F.col("session_id").isNotNull()).alias("edited")).where("read")
    files = kept(files.select("session_id", base_name("path").alias("base"), "edited"), "read-files")
    cited = held_names(files.where("not edited").select("session_id", "base"), contents.where("kind = 'assistant_message'")).withColumn("cited", F.lit(True))
    used = files.join(cited, ["session_id", "base"], "left").withColumn("used", (F.col("edited") | F.coalesce("cited", F.lit(False))).cast("long"))
    return used.groupBy("session_id").agg(F.count("*").alias("reads"), F.sum("used").alias("used")).withColumn("share", F.col("used") / F.col("reads"))


def compare(groups: DataFrame, turns: DataFrame, calls: DataFrame, contents: DataFrame, idle_s: float = 300, least_s: float = 60) -> DataFrame:
    """Ten measures for each group of sessions: `groups` has rolled-up sessions with a column grp. One plan serves all groups. The groups are worked out once, and only their sessions' turns, calls and messages are looked at."""
    groups = kept(groups, "compare-groups")
    of = groups.select("session_id", "grp")
    ids = of.select("session_id").distinct()
    turns, calls, contents = (df.join(ids, "session_id", "left_semi") for df in (turns, calls, contents))
    shape = groups.groupBy("grp").agg(F.count("*").alias("sessions"), F.sum("input_tokens").alias("inp"), F.sum("cache_read_tokens").alias("read"), F.round(F.avg("tool_call_count"), 1).alias("avg_tools"))
    mine = calls.join(groups.select("session_id", "source", "grp"), "session_id")
    nav = mine.where(tool_class() == "navigation").groupBy("grp").agg(F.count("*").alias("nav_calls"), F.sum("result_chars").alias("chars"))
    one_each = groups.dropDuplicates(["session_id"])  # a session may belong to several groups
    shares = kept(nav_shares(one_each, turns, calls, idle_s).join(of, "session_id").where(F.col("active_s") >= least_s).select("grp", "nav_share", "active_s", "nav_s"), "compare-shares")
    time = shares.groupBy("grp").agg(F.count("*").alias("measured"), F.round(F.sum("active_s") / 3600, 1).alias("active_hours"), F.round(F.sum("nav_s") / 3600, 1).alias("nav_hours"))
    middle = medians(shares, ["grp"], "nav_share", "m").select("grp", F.round("m", 4).alias("nav_share_median"))
    dups = duplicate_reads(calls).join(of, "session_id").groupBy("grp").agg(F.sum("duplicates").alias("duplicate_reads"))
    used = medians(read_used(calls, contents).join(of, "session_id"), ["grp"], "share", "m").select("grp", F.round("m", 3).alias("read_used_share"))
    got = shape
    for other in (nav, time, middle, dups, used):
        got = got.join(other, "grp", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    whole = F.col("read") + F.col("inp")
    return got.select("grp", "sessions", zero("measured"), "nav_share_median", "active_hours", "nav_hours", zero("nav_calls"), F.round(F.col("chars") / F.col("nav_calls") / 1000, 1).alias("kb_per_nav_call"), zero("duplicate_reads"), "read_used_share", F.when(whole > 0, F.round(F.col("read") / whole, 3)).alias("cache_hit"), "avg_tools")
