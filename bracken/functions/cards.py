"""Checks of character cards as columns: an error, or the cleaned card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

VERSION = 1
ZONES = ("education", "entertainment")
#: Texts of a card that are taken over stripped.
TEXTS = ("role_prompt", "personality", "scenario", "mes_example", "voice_directive", "post_history_instructions", "tagline", "ability", "background")


def _text(card: Column, field: str) -> Column:
    """A field's text, stripped; empty if it is missing or no text."""
    of_kind = F.schema_of_variant(F.try_variant_get(card, f"$.{field}", "variant")) == "STRING"
    return T.strip(F.coalesce(F.when(of_kind, F.try_variant_get(card, f"$.{field}", "string")), F.lit("")))


def _or(value: Column, other: Column | str) -> Column:
    return F.when(value != "", value).otherwise(other if isinstance(other, Column) else F.lit(other))


def checked(raw: Column, form: str, version: int = VERSION) -> Column:
    """MIS-03 of a card's JSON: a struct of ``error`` and ``card``, one of them null.

    The first of these is the error: ``json`` (no object), ``format`` (another one than ``form``; none is allowed), ``version``
    (no whole number, or a newer one; none is allowed), ``name``, ``content`` (neither role nor background). Entries of the
    lorebook without keyword or content go; a zone that is not known is the second one; a description that is missing is the
    name, and a first message the older field greeting."""
    card = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(card, path, "variant"))
    told = F.try_variant_get(card, "$.format", "string")
    number = F.try_variant_get(card, "$.version", "long")
    name, zone = _text(card, "name"), _text(card, "zone")
    texts = {f: _text(card, f) for f in TEXTS}
    error = (
        F.when(card.isNull() | ~F.coalesce(F.startswith(F.schema_of_variant(card), F.lit("OBJECT")), F.lit(False)), "json")
        .when((kind("$.format") != "VOID") & (~F.coalesce(told == form, F.lit(False)) | (kind("$.format") != "STRING")), "format")
        .when(kind("$.version").isNotNull() & (~F.coalesce(kind("$.version") == "BIGINT", F.lit(False)) | (number > version)), "version")
        .when(name == "", "name")
        .when((texts["role_prompt"] == "") & (texts["background"] == ""), "content")
    )
    entries = F.coalesce(F.try_variant_get(card, "$.lorebook", "array<variant>"), F.array().cast("array<variant>"))
    entries = F.transform(entries, lambda e: F.struct(_text(e, "keyword").alias("keyword"), _text(e, "content").alias("content")))
    entries = F.filter(entries, lambda e: (e["keyword"] != "") & (e["content"] != ""))
    made = F.struct(
        name.alias("name"), _or(_text(card, "description"), name).alias("description"), *[c.alias(f) for f, c in texts.items()],
        _or(_text(card, "first_mes"), _text(card, "greeting")).alias("first_mes"), entries.alias("lorebook"),
        F.when(zone.isin(*ZONES), zone).otherwise(ZONES[1]).alias("zone"), _or(_text(card, "theme"), "original").alias("theme"),
        F.coalesce(F.when(kind("$.enable_verification") == "BOOLEAN", F.try_variant_get(card, "$.enable_verification", "boolean")), F.lit(False)).alias("enable_verification"),
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), made).alias("card"))
