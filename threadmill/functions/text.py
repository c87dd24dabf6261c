"""Text functions in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 punctuation marks of ASCII.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def title_normal_form(c: Column) -> Column:
    """Without ASCII punctuation, lower case; null is the empty text."""
    return F.lower(strip_punctuation(F.coalesce(c, F.lit(""))))


def ordinal(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, ..."""
    teens = (c % 100).between(11, 13)
    suffix = F.when(teens, "th").when(c % 10 == 1, "st").when(c % 10 == 2, "nd").when(c % 10 == 3, "rd").otherwise("th")
    return F.concat(c.cast("string"), suffix)


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def occurrences(c: Column, marks: str) -> Column:
    """How often any of the characters occurs."""
    return F.length(c) - F.length(F.translate(c, marks, ""))


def word_count(c: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def normalize_name_native(c: Column) -> Column:
    """The part of name normalisation that needs no Unicode tables: exact for ASCII text.

    Null stays null. Accents and composed characters need ``names.normalize_name``.
    """
    s = F.regexp_replace(c, r"(?i)\[\s*No Value\s*\]", "")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, '^"+|"+$', ""), "^'+|'+$", "")
    s = F.replace(s, F.lit("Supervisor:"), F.lit(""))
    s = F.regexp_replace(s, r"[†‡*⁎⁑§¶‖¤※]+", "")
    s = F.regexp_replace(s, "[–—‐]", "-")
    s = F.regexp_replace(s, r"\.\.+", ".")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"\s*,\s*", ", ")
    s = F.regexp_replace(s, r"(?:,\s*){2,}", ", ")
    return F.regexp_replace(s, r"^[ ,]+|[ ,]+$", "")


def links_with_extension(html: Column, extension: str) -> Column:
    """Distinct href targets that end in ``extension``, of a page's source."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*' + extension.replace(".", r"\.") + r')"'), 1))


def raw_file_url(listing: str, path: Column) -> Column:
    """Where a file of a repository listing can be fetched."""
    return F.concat(F.lit(listing.rstrip("/").replace("/tree/", "/raw/refs/heads/") + "/"), F.element_at(F.split(path, "/"), -1))


def json_fields(json: Column, fields: dict[str, tuple[str, object]]) -> dict[str, Column]:
    """The named fields of a JSON text, as (type, default): the default stands for null, a missing field and no JSON."""
    parsed = F.from_json(json, ", ".join(f"`{name}` {kind}" for name, (kind, _) in fields.items()))
    return {name: F.coalesce(parsed[name], F.lit(default)) for name, (_, default) in fields.items()}


def json_records(*columns: Column | str) -> Column:
    """A list of one record with these columns, as JSON text."""
    return F.to_json(F.array(F.struct(*columns)))
