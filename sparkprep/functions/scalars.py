"""Small scalar column functions: text, numbers, time, JSON replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are not allowed in values and names.
VALUE_CHARS = r"""[\[\]{}"':,<>]"""
NAME_CHARS_REPLACED = r'[\[\]<>{}:",\s]'
NAME_CHARS_DELETED = r"""[\[\]{}"'<>]"""
NAME_CHARS_UNDERSCORED = r"[:,]"


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def number_or(x: Column, default: float = 0.0) -> Column:
    """Parse as a number; what cannot be parsed becomes `default`."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clean_value(x: Column) -> Column:
    return F.regexp_replace(x, VALUE_CHARS, "")


def word_count(x: Column) -> Column:
    """Whitespace-separated tokens; NULL and blank text have none."""
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda t: t != ""))


def duration_seconds(x: Column) -> Column:
    """'10m', '30s', '2h' or a bare number of minutes, in seconds."""
    text = F.lower(F.trim(x))
    number = F.regexp_replace(text, "[smh]$", "").try_cast("double")
    scale = (
        F.when(text.endswith("s"), 1.0).when(text.endswith("h"), 3600.0).otherwise(F.lit(60.0))
    )
    return number * scale


def safe_file_name(path: Column) -> Column:
    """Last part of a path without its extension, unsafe characters replaced by '_'."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(base.rlike(r"^\.*[^.].*\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(
        base
    )
    return F.regexp_replace(stem, r'[\\/*?:"<>|]', "_")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def json_reply(text: Column) -> Column:
    """The JSON text inside a model reply.

    The whole reply if it is JSON; else, without its think block, a fenced json block; else the span
    from the first '{' to the last '}'. NULL when none of them parses.
    """
    def valid(candidate: Column) -> Column:
        return F.when(F.try_parse_json(candidate).isNotNull(), candidate)

    bare = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(bare, r"(?s)```json\s*(.*?)\s*```", 1)
    span = F.regexp_extract(bare, r"\{[\s\S]*\}", 0)
    blank = F.lit("")
    return F.coalesce(
        valid(F.nullif(F.trim(text), blank)), valid(F.nullif(fenced, blank)), valid(F.nullif(span, blank))
    )


def approval(text: Column) -> Column:
    """The boolean 'approved' of a reply, or a keyword decision when the reply holds no JSON."""
    bare = F.lower(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    reply = json_reply(text)
    keyword = F.when(bare.contains("rejected") | bare.contains("false"), F.lit(False)).when(
        bare.contains("approved") | bare.contains("true"), F.lit(True)
    )
    return F.when(
        reply.isNotNull(), F.get_json_object(reply, "$.approved").try_cast("boolean")
    ).otherwise(keyword)
