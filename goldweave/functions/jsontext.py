"""Values inside JSON texts that may not be valid."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(*parts: str) -> str:
    """A path of quoted names."""
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in parts)


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_value(text: Column, *parts: str) -> Column:
    """The scalar at a path as text; null where the text is no JSON or has nothing there."""
    return F.when(is_json(text), F.get_json_object(text, json_path(*parts)))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """The value by ``schema``, or ``default`` where the text is no JSON."""
    return F.when(is_json(text), F.from_json(text, schema)).otherwise(default)


def chosen_title(value: Column) -> Column:
    """A title that may be wrapped: the chosen_title or title of an object, a JSON text's content, else the text itself."""
    x = F.coalesce(value.cast("string"), F.lit(""))
    first = F.coalesce(F.nullif(F.get_json_object(x, "$.chosen_title"), F.lit("")), F.get_json_object(x, "$.title"), F.lit(""))
    kind = F.when(is_json(x), F.substring(F.trim(x), 1, 1))
    return F.when(kind == "{", first).when(kind == '"', F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")).otherwise(x)


def mask_url(url: str) -> str:
    """A connection URL without its password."""
    return re.sub(r"(//[^:/@]+):[^@]*@", r"\1:***@", url)
