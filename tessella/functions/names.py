"""Names, hashes and dictionaries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_parts(name: Column, separator: str = "_") -> Column:
    """struct<prefix, subject, session> of a name like PREFIX_SUBJECT_SESSION; missing parts are null."""
    parts = F.split(name, separator)
    return F.struct(F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("subject"), F.get(parts, F.lit(2)).alias("session"))


def joined_name(*parts: Column, separator: str = "_") -> Column:
    """Parts joined in upper case; null and empty ones are left out."""
    return F.upper(F.concat_ws(separator, *[F.when(p != "", p) for p in parts]))


def twin_name(feature: Column, suffix: str = "_2d") -> Column:
    """Name of the two-dimensional twin of a circular feature; a twin keeps its name."""
    return F.when(feature.endswith(suffix), feature).otherwise(F.concat(feature, F.lit(suffix)))


def parent_name(feature: Column, suffix: str = "_2d") -> Column:
    """Name of the feature that a twin was made of, empty for other features."""
    return F.regexp_extract(feature, f"^(.*){suffix}$", 1)


def row_hash(*columns: Column, bits: int = 256) -> Column:
    """SHA-2 of the columns' texts, null written as a word of its own, a unit separator between them."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), bits)


def number_at(json: Column, key: str) -> Column:
    """A top-level number of a JSON text; null where it isn't there."""
    return F.get_json_object(json, f"$.{key}").try_cast("double")
