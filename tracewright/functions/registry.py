"""SQL names for the functions analysts use in queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewright.functions.hashing import canonical_json
from tracewright.functions.text import CONTROL_TOKENS, STOP_WORDS
from tracewright.functions.values import json_leaves

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _neutral() -> str:
    body = "regexp_replace(t, '[\\u202A-\\u202E\\u2066-\\u2069\\u200B-\\u200F\\u2060\\uFEFF]', '')"
    for name, token in CONTROL_TOKENS:
        body = f"regexp_replace({body}, '(?i)\\\\Q{token}\\\\E', '[neutralized:{name}]')"
    return body


_DECIMAL = "CASE WHEN lower(trim({0})) RLIKE '^0x[0-9a-f]{{1,16}}$' THEN CAST(conv(substr(trim({0}), 3), 16, 10) AS DECIMAL(38,0)) WHEN trim({0}) RLIKE '^[+-]?(0+|[1-9][0-9]*)$' THEN CAST(trim({0}) AS DECIMAL(38,0)) END"

# name, parameters, return type, body
SQL_FUNCTIONS = (
    ("tw_percent_decode", "t STRING", "STRING",
     "lower(url_decode(regexp_replace(replace(lower(url_decode(regexp_replace(t, '%(?![0-9a-fA-F]{2})', '%25'))), '+', '%2B'), '%(?![0-9a-fA-F]{2})', '%25')))"),
    ("tw_word_tokens", "t STRING", "ARRAY<STRING>", "array_distinct(regexp_extract_all(lower(t), '([a-z0-9_]+)', 1))"),
    ("tw_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE",
     "if(size(array_union(a, b)) = 0, 1.0D, size(array_intersect(a, b)) / size(array_union(a, b)))"),
    ("tw_tokens", "t STRING", "ARRAY<STRING>", f"array_except(regexp_extract_all(lower(t), '([a-z0-9]{{3,}})', 1), array({_STOP}))"),
    ("tw_neutralize", "t STRING", "STRING", _neutral()),
    ("tw_value_match", "expected STRING, leaf STRING, mode STRING", "BOOLEAN",
     "coalesce(CASE mode WHEN 'int' THEN " + _DECIMAL.format("expected") + " = " + _DECIMAL.format("leaf")
     + " WHEN 'iso_ts' THEN try_cast(expected AS TIMESTAMP) = try_cast(leaf AS TIMESTAMP) WHEN 'contains' THEN contains(lower(leaf), lower(trim(expected))) ELSE trim(leaf) = trim(expected) END, false)"),
    ("tw_run_entry", "t STRING", "STRING",
     "regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm'), '^UEME_RUNPATH:', '')"),
    ("tw_downgrade", "c STRING", "STRING", "CASE c WHEN 'CONFIRMED' THEN 'INFERRED' WHEN 'INFERRED' THEN 'HYPOTHESIS' ELSE c END"),
    ("tw_tier", "s DOUBLE", "STRING", "CASE WHEN s >= 0.80 THEN 'CONFIRMED' WHEN s >= 0.50 THEN 'INFERRED' ELSE 'HYPOTHESIS' END"),
    ("tw_rot13", "t STRING", "STRING",
     "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"),
)


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions for this session."""
    for name, params, returns, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    spark.udf.register("tw_canonical_json", canonical_json)
    spark.udf.register("tw_json_leaves", json_leaves)
