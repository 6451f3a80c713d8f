"""Tolerant JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(c: Column) -> Column:
    """The content of the first fenced block, else the text."""
    p = r"(?s)```(?:json)?\s*(.*?)```"
    return F.trim(F.when(c.rlike(p), F.regexp_extract(c, p, 1)).otherwise(c))


def tolerant(c: Column) -> Column:
    """A variant from text: itself, a fenced block, the outermost object, the outermost array; null if none parses."""
    obj, arr = F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(unfenced(c)), F.try_parse_json(F.nullif(obj, F.lit(""))), F.try_parse_json(F.nullif(arr, F.lit(""))))


def missing_fields(v: Column, fields: tuple[str, ...]) -> Column:
    """Names of required fields that a variant lacks."""
    return F.array_compact(F.array(*[F.when(F.try_variant_get(v, f"$.{f}", "string").isNull(), F.lit(f)) for f in fields]))


def canonical_map(c: Column) -> Column:
    """A map as JSON with sorted keys, for identity."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(c))))


def objects_in(c: Column) -> Column:
    """All flat objects of a text, for answers cut off midway."""
    return F.regexp_extract_all(c, F.lit(r"(\{[^{}]*\})"), F.lit(1))


def judge_score(c: Column) -> Column:
    """A score from 0 to 1: the field 'score', else the first number starting with 0 or 1, else 0."""
    by_field = F.try_variant_get(tolerant(c), "$.score", "double")
    by_text = F.nullif(F.regexp_extract(c, r"\b([01](?:\.\d+)?)\b", 1), F.lit("")).try_cast("double")
    s = F.coalesce(by_field, by_text, F.lit(0.0))
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
