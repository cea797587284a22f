"""Column expressions over session logs. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tool names by kind, and by class for each log source.
KINDS: dict[str, tuple[str, ...]] = {
    "shell": ("Bash", "exec_command", "write_stdin"),
    "web": ("WebFetch", "WebSearch"),
    "subagent": ("Agent", "Task", "spawn_agent", "wait_agent"),
    "file": ("Read", "Glob", "Grep", "LS"),
    "edit": ("Edit", "Write", "MultiEdit", "NotebookEdit", "apply_patch"),
}
CLASSES: dict[str, dict[str, tuple[str, ...]]] = {
    "claude-code": {"navigation": ("Read", "Grep", "Glob", "LS"), "shell": ("Bash", "BashOutput"), "subagent": ("Agent", "Task"), "editing": ("Edit", "Write", "MultiEdit", "NotebookEdit")},
    "codex": {"navigation": ("read_file",), "shell": ("exec_command", "exec", "write_stdin", "shell"), "subagent": ("spawn_agent", "wait_agent"), "editing": ("apply_patch",)},
    "harness": {"shell": ("bash", "Bash")},
}
#: Fixed value: commands that read or navigate, at a word boundary of a shell line or of its JSON form.
NAVIGATION = r'(?:^|[\s"(;|&]|\\n)(rg|grep|cat|sed|head|tail|find|tree|ls|wc|nl|repo-nav)\s'
#: Marks of an inline script, and the operations that make up its shape.
SCRIPT_MARKS = ("python3 -", "python -", "<<EOF", "<<'EOF'", "<<'PY'", "<< 'PY'")
SCRIPT_OPS = r"\b(json\.load\w*|Counter|glob|read_text|splitlines|fetchall|groupby|defaultdict|re\.findall|sqlite3)\b"
#: Fixed value: a hook's mark in a tool result: event, matcher, kind, command, message.
HOOK = r"(?s)([A-Za-z]+):([A-Za-z_|]+) hook (error|feedback):?\s*(?:\[([^\]]*)\]:?\s*)?(.*)"


def tool_kind(name: str = "name") -> Column:
    """mcp, shell, web, subagent, file, edit or other."""
    c = F.when(F.col(name).startswith("mcp__"), "mcp")
    for kind, names in KINDS.items():
        c = c.when(F.col(name).isin(*names), kind)
    return c.otherwise("other")


def tool_vendor(name: str = "name") -> Column:
    """The server part of an mcp tool's name, else null."""
    return F.when(F.col(name).startswith("mcp__"), F.nullif(F.split_part(F.col(name), F.lit("__"), F.lit(2)), F.lit("")))


def token_estimate(chars: str = "result_chars") -> Column:
    return F.expr(f"{chars} div 4")


def is_navigation(args: str = "args_preview") -> Column:
    return F.coalesce(F.col(args).rlike(NAVIGATION), F.lit(False))


def class_for(source: str, name: str = "name", args: str = "args_preview") -> Column:
    """Tool class within one source."""
    by_command = F.when(is_navigation(args), "navigation")
    c = F.when(F.lit(False), "")
    for label, names in CLASSES[source].items():
        c = c.when(F.col(name).isin(*names), by_command.otherwise("bash-other") if label == "shell" else F.lit(label))
    return c.otherwise("other")


def tool_class(name: str = "name", args: str = "args_preview", source: str = "source") -> Column:
    """navigation, editing, subagent, bash-other or other; tools of unknown sources are judged by their command alone."""
    c = F.when(F.lit(False), "")
    for label in CLASSES:
        c = c.when(F.col(source) == label, class_for(label, name, args))
    return c.otherwise(F.when(is_navigation(args), "navigation").otherwise("other"))


def source_bit(source: str = "source") -> Column:
    """The bit of navigation_bits that counts for a source."""
    c = F.when(F.lit(False), 0)
    for i, label in enumerate(CLASSES):
        c = c.when(F.col(source) == label, i)
    return c.otherwise(len(CLASSES))


def navigation_bits(name: str = "name", args: str = "args_preview") -> Column:
    """One bit for each source, and one for unknown sources: whether tool_class calls it navigation there. For calls that meet their sessions later."""
    ways = [class_for(label, name, args) == "navigation" for label in CLASSES] + [is_navigation(args)]
    return reduce(add, [F.when(way, 1 << i).otherwise(0) for i, way in enumerate(ways)])


def ns_of(iso: Column) -> Column:
    """Epoch nanoseconds of an ISO-8601 text, in UTC where it names no zone; null if it is none."""
    zoned = iso.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$") & iso.rlike(r"[Tt ]")
    day = F.when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(iso, F.lit("T00:00:00Z")))
    return F.unix_micros(F.try_to_timestamp(F.coalesce(day, F.when(zoned, iso), F.concat(iso, F.lit("Z"))))) * 1000


def time_of(ns: str) -> Column:
    return F.timestamp_micros(F.expr(f"{ns} div 1000"))


def day_of(ns: str) -> Column:
    """The UTC day, whatever the session's time zone."""
    return F.expr(f"date_add(DATE'1970-01-01', CAST(({ns} - pmod({ns}, 86400000000000)) div 86400000000000 AS INT))")


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def span_id(namespace: str, session: Column, suffix: Column) -> Column:
    return short_hash(F.concat_ws(":", F.lit(namespace), session, suffix))


def trace_id(namespace: str, session: Column) -> Column:
    return short_hash(F.concat_ws(":", F.lit(namespace), session), 32)


def canonical(v: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(v)


def is_string(v: Column) -> Column:
    """Whether a variant is a string; a plain cast would render anything as JSON."""
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def result_text(v: Column) -> Column:
    """Text of a result: a string as it is, the non-empty texts of a list of blocks joined by newlines, another value as JSON, nothing as ''."""
    blocks = F.try_variant_get(v, "$", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull() & (t != ""))
    return F.when(v.isNull(), "").when(is_string(v), F.try_variant_get(v, "$", "string")).when(blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(F.coalesce(F.to_json(v), F.lit("")))


def project_of(cwd: Column) -> Column:
    """The last two parts of a working directory, without the home folder and anything from /.claude/ on; `~` for the home folder itself."""
    bare = F.regexp_replace(cwd, r"^/(?:Users|home)/[^/]+", "")
    bare = F.split_part(bare, F.lit("/.claude/"), F.lit(1))
    parts = F.array_remove(F.split(bare, "/"), "")
    parts = F.when(F.try_element_at(parts, F.lit(1)) == "Code", F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.when(cwd.isNull() | (cwd == ""), F.lit(None).cast("string")).when(F.size(parts) == 0, "~").otherwise(F.array_join(last, "/"))


def file_argument(args: str = "args_preview") -> Column:
    """The file_path in JSON arguments, null if none."""
    return F.nullif(F.regexp_extract(F.col(args), r'"file_path":\s*"([^"]+)"', 1), F.lit(""))


def base_name(path: str) -> Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def growth(previous: Column, current: Column) -> Column:
    """Relative change, null where it means nothing."""
    return F.when(previous.isNotNull() & (previous != 0), (current - previous) / F.abs(previous))


def imports(text: str = "text") -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"import (\w+)"), F.lit(1)))), "+")


def operations(text: str = "text") -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(SCRIPT_OPS), F.lit(1)))), "+")


def is_script(text: str = "text") -> Column:
    c = F.lit(False)
    for mark in SCRIPT_MARKS:
        c = c | F.col(text).contains(mark)
    return c


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, rounded; 0 where there is no whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def any_of(columns: Sequence[Column]) -> Column:
    c = F.lit(False)
    for x in columns:
        c = c | x
    return c
