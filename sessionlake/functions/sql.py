"""The column functions as SQL functions, so that ad-hoc SQL can use them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import columns

#: Name, parameters and expression of each function.
FUNCTIONS: dict[str, tuple[dict[str, str], Column]] = {}


def functions() -> dict[str, tuple[dict[str, str], Column]]:
    """Expressions over columns named like the parameters; none takes a lambda, as these have no SQL text."""
    if not FUNCTIONS:
        text = {"name": "string"}
        FUNCTIONS.update(
            {
                "tool_kind": (text, columns.tool_kind()),
                "tool_vendor": (text, columns.tool_vendor()),
                "token_estimate": ({"result_chars": "bigint"}, columns.token_estimate()),
                "is_navigation": ({"args_preview": "string"}, columns.is_navigation()),
                "tool_class": ({"source": "string", "name": "string", "args_preview": "string"}, columns.tool_class()),
                "ns_of": ({"iso": "string"}, columns.ns_of(F.col("iso"))),
                "day_of": ({"ns": "bigint"}, columns.day_of("ns")),
                "short_hash": ({"value": "string"}, columns.short_hash(F.col("value"))),
                "project_of": ({"cwd": "string"}, columns.project_of(F.col("cwd"))),
                "file_argument": ({"args_preview": "string"}, columns.file_argument()),
                "base_name": ({"path": "string"}, columns.base_name("path")),
                "growth": ({"previous": "double", "now": "double"}, columns.growth(F.col("previous"), F.col("now"))),
                "script_imports": ({"text": "string"}, columns.imports()),
                "script_operations": ({"text": "string"}, columns.operations()),
                "is_script": ({"text": "string"}, columns.is_script()),
            }
        )
    return FUNCTIONS


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary SQL functions of the session; returns their names. Their bodies are the SQL of the expressions, so Catalyst inlines and pushes them down like any other."""
    for name, (parameters, expression) in functions().items():
        typed = spark.createDataFrame([], ", ".join(f"{p} {t}" for p, t in parameters.items()))
        chosen = typed.select(expression.alias("result"))
        body = chosen._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} {t}' for p, t in parameters.items())}) RETURNS {chosen.schema['result'].dataType.simpleString()} RETURN {body}")
    return list(functions())
