"""The engine's functions for SQL users: temporary functions of a session, made of built-in ones alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..vocab import TRACKING, S

_ORIGIN = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
#: Name: arguments, result, body. Literals are raw strings.
FUNCTIONS = {
    "url_domain": ("url STRING", "STRING", f"regexp_extract(url, r'{_ORIGIN}', 1)"),
    "url_normalize": ("url STRING", "STRING", f"regexp_replace(regexp_replace(substring_index(url, '#', 1), r'/+$', ''), r'{TRACKING}', '')"),
    "text_words": ("t STRING", "ARRAY<STRING>", f"filter(split(t, r'[{S}]+'), w -> w <> '')"),
    "content_hash": ("html STRING", "STRING", "md5(html)"),
    "keyed_order": ("seed INT, k STRING", "STRING", "md5(concat(cast(seed AS STRING), ':', k))"),
}


def register(spark: SparkSession, prefix: str = "lontar_") -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
